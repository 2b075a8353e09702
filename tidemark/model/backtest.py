"""Walk-forward evaluation: every match predicted from strictly earlier matches, then scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import outcome_of, with_markets
from tidemark.model import metrics
from tidemark.model.fit import BLOCK_US, fit_many
from tidemark.model.predict import expected_goals
from tidemark.model.profiles import MIN_TRAINING_MATCHES, Config
from tidemark.operators.ordered import earlier_totals, with_earlier_totals


def observations_before(matches: DataFrame, cutoff: Column | int) -> DataFrame:
    """The training set of a cutoff: strictly earlier kickoffs, in a total order."""
    bound = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return matches.filter(F.col("k") < bound).orderBy("k", "home", "away")


def _window_sums() -> dict[str, Column]:
    outcome = outcome_of(F.col("hg"), F.col("ag"))
    wins = {f"wins_{name}": (outcome == name).cast("bigint") for name in metrics.OUTCOMES}
    return {"training_matches": F.lit(1).cast("bigint"), **wins}


def training_window(matches: DataFrame) -> DataFrame:
    """Per (scope, k): number and 1X2 counts of strictly earlier matches."""
    return earlier_totals(matches, ["scope"], "k", _window_sums())


def with_training_window(matches: DataFrame) -> DataFrame:
    """The same on every match."""
    return with_earlier_totals(matches, ["scope"], "k", _window_sums())


def with_class_frequency(window: DataFrame) -> DataFrame:
    """Laplace-smoothed 1X2 rate of the training window."""
    total = F.col("training_matches") + 3.0
    return window.withColumns({
        f"frequency_p_{name}": (F.col(f"wins_{name}") + 1.0) / total for name in metrics.OUTCOMES
    })


def distinct_cutoffs(matches: DataFrame) -> DataFrame:
    return matches.select("scope", F.col("k").alias("cutoff")).distinct()


def month_cutoffs(matches: DataFrame) -> DataFrame:
    """The first instant of each month with matches: a cheaper, still leak-free grain."""
    month = F.unix_micros(F.date_trunc("month", F.timestamp_micros("k")))
    return matches.select("scope", month.alias("cutoff")).distinct()


def _with_league(fits: DataFrame) -> DataFrame:
    """Each fit with the 1X2 triple of its level and home edge alone."""
    rates = fits.withColumns({"league_home": F.exp(F.col("mu") + F.col("home_advantage")), "league_away": F.exp("mu")})
    triple = [f"league_p_{name}" for name in metrics.OUTCOMES]
    return with_markets(rates, "league_home", "league_away", prefix="league_").select(*fits.columns, *triple)


def walk_forward(
    matches: DataFrame,
    candidates: Sequence[Config],
    min_training: int = MIN_TRAINING_MATCHES,
    skip_cold_start: bool = False,
    grain: str = "kickoff",
    block_us: int = BLOCK_US,
) -> DataFrame:
    """Scored rows: one per (candidate, match) whose window is large enough.

    `grain='kickoff'` fits at each match's own kickoff; `grain='month'` at the
    first instant of its month (fewer fits, another definition).
    """
    halves = list(dict.fromkeys(c.half_life for c in candidates))
    if grain == "month":
        matches = matches.withColumn("cutoff", F.unix_micros(F.date_trunc("month", F.timestamp_micros("k"))))
        cutoffs = month_cutoffs(matches)
    else:
        matches = matches.withColumn("cutoff", F.col("k"))
        cutoffs = distinct_cutoffs(matches)
    fits = fit_many(matches, candidates, cutoffs, min_training, block_us).filter("usable")
    # The league baseline depends on the fit alone, so it is derived per fit and not per scored row.
    fits = _with_league(fits)
    listed = F.array(*[
        F.struct(
            F.lit(c.name).alias("candidate"), F.lit(c.complexity).alias("complexity"),
            F.lit(halves.index(c.half_life)).alias("half"), F.lit(c.dixon_coles).alias("corrected"),
        ) for c in candidates
    ])
    rated = expected_goals(matches.join(fits, ["scope", "cutoff"]), candidates[0].min_matches)
    rated = rated.drop("teams", "attack", "defence", "matches")
    own = F.filter(listed, lambda c: c["half"] == F.col("half"))
    rows = rated.withColumn("c", F.explode(own)).withColumns({
        "candidate": F.col("c.candidate"), "complexity": F.col("c.complexity"),
        "rho": F.when(F.col("c.corrected"), F.col("rho")),
        "outcome": outcome_of(F.col("hg"), F.col("ag")),
    }).drop("c", "half")
    if skip_cold_start:
        rows = rows.filter(F.size("cold_started") == 0)
    scored = with_markets(rows, rho="rho")
    window = with_class_frequency(training_window(matches)).drop("training_matches", "wins_home", "wins_draw", "wins_away")
    keep = [
        "candidate", "complexity", "id", "scope", "season", "k", "cutoff", "home", "away", "hg", "ag", "outcome",
        "training_matches", "lambda_home", "lambda_away", "rho", "cold_started",
        "p_home", "p_draw", "p_away", "low_score", "league_p_home", "league_p_draw", "league_p_away",
    ]
    return scored.select(*keep).join(window, ["scope", "k"])


def backtest_report(scored: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Counts and scores of the model and its two baselines, one row per group."""
    outcome = F.col("outcome")
    measures = []
    for name, prefix in (("", "p_"), ("frequency_", "frequency_p_"), ("league_", "league_p_")):
        measures += [
            F.avg(metrics.log_score(metrics.triple(prefix), outcome)).alias(f"{name}log_loss"),
            F.avg(metrics.brier_score(metrics.triple(prefix), outcome)).alias(f"{name}brier"),
        ]
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"), F.countDistinct("scope", "cutoff").alias("fits"),
        F.min("k").alias("first_prediction"), F.max("k").alias("last_prediction"), *measures,
        F.avg("lambda_home").alias("mean_predicted_home"), F.avg("lambda_away").alias("mean_predicted_away"),
        F.avg("hg").alias("mean_actual_home"), F.avg("ag").alias("mean_actual_away"),
        F.sum((F.size("cold_started") > 0).cast("bigint")).alias("cold_start"),
    )


def split_rows(scored: DataFrame, development: Sequence[int]) -> DataFrame:
    """Label scored rows by season; the chronological pass itself is never restarted."""
    label = F.when(F.col("season").isin(*development), "development").otherwise("held_out")
    return scored.withColumn("split", label)


def cold_start_by_season(scored: DataFrame, by: Sequence[str] = ("candidate", "season")) -> DataFrame:
    return (
        scored.select(*by, "id", F.explode("cold_started").alias("team"))
        .groupBy(*by)
        .agg(F.countDistinct("id").alias("cold_predictions"), F.array_sort(F.collect_set("team")).alias("teams"))
    )


def combined_candidate(report: DataFrame, candidates: Sequence[Config]) -> Config:
    """The decay candidate with the best walk-forward log loss, joined with the low-score correction."""
    decays = {c.name: c for c in candidates if c.half_life is not None and not c.dixon_coles}
    best = report.filter(F.col("candidate").isin(*decays)).agg(F.min_by("candidate", "log_loss").alias("best")).first().best
    chosen = decays[best]
    return Config(f"G. decay {chosen.half_life:g}d + DC", chosen.half_life, True, chosen.complexity + 1)
