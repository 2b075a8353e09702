"""Football analytics over results, and the comparison of providers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.probability import OVER_UNDER_LINES, line_name
from tidemark.operators.ordered import GRAIN_US, earlier_totals, neighbours, same_key_join
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.temporal import history_from_log


def team_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each side: team, at_home, gf, ga, points."""
    sides = F.explode(F.array(
        F.struct(F.col("home").alias("team"), F.lit(1).alias("at_home"), F.col("hg").alias("gf"), F.col("ag").alias("ga")),
        F.struct(F.col("away").alias("team"), F.lit(0).alias("at_home"), F.col("ag").alias("gf"), F.col("hg").alias("ga")),
    )).alias("s")
    rows = matches.select("id", "scope", "season", "k", sides).select("id", "scope", "season", "k", "s.*")
    return rows.withColumn("points", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))


def standings(matches: DataFrame) -> DataFrame:
    """League table per (scope, season). Rows are combined per team before they are ranked."""
    c = F.col
    table = team_sides(matches).groupBy("scope", "season", "team").agg(
        F.count(F.lit(1)).alias("played"),
        F.sum((c("gf") > c("ga")).cast("bigint")).alias("won"), F.sum((c("gf") == c("ga")).cast("bigint")).alias("drawn"),
        F.sum((c("gf") < c("ga")).cast("bigint")).alias("lost"),
        F.sum("gf").cast("bigint").alias("gf"), F.sum("ga").cast("bigint").alias("ga"), F.sum("points").cast("bigint").alias("points"),
    )
    order = Window.partitionBy("scope", "season").orderBy(c("points").desc(), (c("gf") - c("ga")).desc(), c("gf").desc(), c("team"))
    return table.withColumn("position", F.row_number().over(order).cast("bigint"))


def form_snapshot(matches: DataFrame, last: Sequence[int] = (5, 10), grain_us: int = GRAIN_US) -> DataFrame:
    """Per (scope, team, k): totals of the last n playing instants and of the season, strictly before k.

    They come from running totals: the sums over the last n are the difference
    of two of them, found by an equi-join on the instant's number.
    """
    side = team_sides(matches)
    keys = ["scope", "team"]
    sums = {
        "games": F.lit(1).cast("bigint"), "points": F.col("points").cast("bigint"), "gf": F.col("gf").cast("bigint"),
        "ga": F.col("ga").cast("bigint"), "clean_sheets": (F.col("ga") == 0).cast("bigint"),
        "home_games": F.col("at_home").cast("bigint"),
        "home_points": (F.col("points") * F.col("at_home")).cast("bigint"),
    }
    names = list(sums)
    instants = side.groupBy(*keys, "season", "k").agg(*[F.sum(e).alias(x) for x, e in sums.items()])
    # Playing instants are counted in the same pass as what they sum up.
    numbered = earlier_totals(instants.groupBy(*keys, "k").agg(*[F.sum(x).alias(x) for x in names]), keys, "k", {x: F.col(x) for x in names} | {"ordinal": F.lit(1).cast("bigint")}, grain_us)
    out = numbered
    for n in last:
        back = numbered.select(*keys, (F.col("ordinal") + n).alias("ordinal"), *[F.col(x).alias(f"__{x}") for x in names])
        out = same_key_join(out, back, [*keys, "ordinal"], "left").select(
            *out.columns, *[(F.col(x) - F.coalesce(F.col(f"__{x}"), F.lit(0))).alias(f"last{n}_{x}") for x in names]
        )
    season = earlier_totals(instants, [*keys, "season"], "k", {x: F.col(x) for x in names}, grain_us).select(
        *keys, "k", "season", *[F.col(x).alias(f"season_{x}") for x in names]
    )
    return same_key_join(out.drop("ordinal", *names), season, [*keys, "k"])


def settle_selection(market: Column, line: Column, selection: Column, home: Column, away: Column) -> Column:
    """won, lost, void or, on a quarter line, half_won / half_lost."""
    margin = home - away + F.coalesce(line, F.lit(0))
    signed = F.when(selection == "home", margin).otherwise(-margin)
    handicap = (
        F.when(signed == 0, "void").when(signed == 0.25, "half_won").when(signed == -0.25, "half_lost")
        .when(signed > 0, "won").otherwise("lost")
    )
    total = home + away
    over = F.when(total > line, "over").when(total < line, "under")
    result = F.when(home > away, "home").when(home == away, "draw").otherwise("away")
    both = F.when((home > 0) & (away > 0), "yes").otherwise("no")

    def verdict(actual: Column) -> Column:
        return F.when(actual.isNull(), "void").when(actual == selection, "won").otherwise("lost")

    return (
        F.when(market == "1x2", verdict(result)).when(market == "over_under", verdict(over))
        .when(market == "btts", verdict(both)).when(market == "asian_handicap", handicap)
    )


def settlements(series: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of each series as revisions: a corrected score that changes the outcome settles again.

    `series`: fixture_id, series_id, market_type, line, selection; a series belongs to one fixture. The join deals everything
    by fixture, and so it stays: a fixture's corrected scores are few, and its series are settled where they lie.
    """
    facts = results.select("fixture_id", "ft_home", "ft_away", "known_at")
    # Both sides are shuffled. Spark takes an exploded list of series for as small as the columns of the file it reads, and
    # would send all of it through the driver.
    log = series.hint("merge").join(facts.hint("merge"), "fixture_id").withColumn("outcome", settle_selection(
        F.col("market_type"), F.col("line"), F.col("selection"), F.col("ft_home"), F.col("ft_away")
    ))
    rows = log.select("fixture_id", "series_id", "known_at", "outcome")
    return history_from_log(rows, ["fixture_id", "series_id"], ["outcome"], grain_us=None).drop("fixture_id")


def markets_long(predictions: DataFrame, *keys: str) -> DataFrame:
    """One row per (prediction, market, line, selection) with probability and fair odds."""
    def entry(market: str, line: float | None, selection: str, p: Column) -> Column:
        return F.struct(
            F.lit(market).alias("market_type"), F.lit(line).cast("double").alias("line"), F.lit(selection).alias("selection"), p.alias("probability")
        )

    entries = [entry("1x2", None, s, F.col(f"p_{s}")) for s in ("home", "draw", "away")]
    for line in OVER_UNDER_LINES:
        over = F.col(f"p_over_{line_name(line)}")
        entries += [entry("over_under", line, "over", over), entry("over_under", line, "under", 1 - over)]
    entries += [entry("btts", None, "yes", F.col("p_btts_yes")), entry("btts", None, "no", 1 - F.col("p_btts_yes"))]
    rows = predictions.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
    return rows.withColumn("fair_odds", F.when(F.col("probability") > 0, 1 / F.col("probability")))


def invalidated_by_reschedule(predictions: DataFrame, schedule: DataFrame, more_than_us: int) -> DataFrame:
    """Predictions with `superseded_at` brought forward to the first later schedule revision that moves the kickoff by more than the bound."""
    moved = neighbours(schedule, ["fixture_id"], ["known_at"], previous={"__was": F.col("kickoff")}).filter(
        F.abs(F.col("kickoff") - F.col("__was")) > more_than_us
    ).select("fixture_id", F.col("known_at").alias("__at"))
    hits = predictions.join(moved, "fixture_id").filter("__at > known_at").groupBy("fixture_id", "known_at").agg(F.min("__at").alias("__at"))
    closed = F.least(F.col("superseded_at"), F.col("__at"))
    return predictions.join(hits, ["fixture_id", "known_at"], "left").withColumn("superseded_at", closed).drop("__at")


def majority_vote(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cell the value most sources give; a tie goes to review. `cells`: keys, source, value."""
    votes = cells.filter("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("votes"))
    tally = votes.groupBy(*keys).agg(
        F.max("votes").alias("top"), F.count(F.lit(1)).alias("values"), F.sum("votes").alias("sources"),
        F.max_by("value", F.struct("votes", "value")).alias("first"), F.max(F.struct("votes", "value")).alias("hi"),
        F.min_by("value", F.struct(-F.col("votes"), "value")).alias("other"),
    )
    tied = F.col("first") != F.col("other")
    return tally.select(
        *keys, F.when(~tied, F.col("first")).alias("value"), "sources", (F.col("values") > 1).alias("disputed"), tied.alias("review")
    )


def feed_metrics(truth: DataFrame, feed: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """How well a provider feed reproduces the ground truth, one row per group.

    `truth`: key, by, hg, ag, k. `feed`: key (NULL when unmatched), by, hg, ag,
    k, shots, shots_on_target, xg, arrived_at.
    """
    expected = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    matched = feed.join(
        truth.select(key, F.col("hg").alias("t_hg"), F.col("ag").alias("t_ag"), F.col("k").alias("t_k")), key, "left"
    )
    known = F.col("t_k").isNotNull()
    late = F.abs(F.col("k") - F.col("t_k"))

    def share(condition: Column, of: Column) -> Column:
        return F.sum((of & F.coalesce(condition, F.lit(False))).cast("double")) / F.sum(of.cast("double"))

    goals = F.col("t_hg") + F.col("t_ag")
    out = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(known, F.col(key))).alias("found"),
        (F.sum(known.cast("double")) / F.count(F.lit(1))).alias("precision"),
        share((F.col("hg") == F.col("t_hg")) & (F.col("ag") == F.col("t_ag")), known).alias("full_time_accuracy"),
        share(late == 0, known).alias("kickoff_exact"), share(late <= 15 * 60_000_000, known).alias("kickoff_within_15"),
        F.avg(F.col("shots").isNotNull().cast("double")).alias("shots_fill"),
        share(F.col("shots_on_target") <= F.col("shots"), F.col("shots").isNotNull()).alias("plausible"),
        (F.sum(F.when(known, F.col("xg"))) / F.sum(F.when(known & F.col("xg").isNotNull(), goals))).alias("xg_ratio"),
        F.corr(F.when(known, F.col("xg")), F.when(known, goals.cast("double"))).alias("xg_correlation"),
    )
    waits = matched.filter(known).select(*by, (F.col("arrived_at") - F.col("t_k")).alias("__us"))
    latency = exact_quantiles(waits, by, "__us", {"latency_median": 0.5, "latency_p95": 0.95})
    latency = latency.select(*by, *[(F.col(c) / F.lit(6e7)).alias(c) for c in ("latency_median", "latency_p95")])
    return same_key_join(same_key_join(out, latency, by, "left"), expected, by).withColumn("recall", F.col("found") / F.col("expected"))


def union_violations(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of several rules as (rule, key): what a quarantine table holds."""
    out = None
    for rule, df in parts.items():
        part = df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(c).cast("string") for c in df.columns]).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out
