"""Proper scores and summaries as aggregate expressions over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import neighbours

OUTCOMES = ("home", "draw", "away")
EPS = 1e-15


def chosen(triple: Sequence[Column], outcome: Column) -> Column:
    return F.when(outcome == "home", triple[0]).when(outcome == "draw", triple[1]).otherwise(triple[2])


def log_score(triple: Sequence[Column], outcome: Column) -> Column:
    """-ln of the probability given to what happened, clamped away from 0 and 1."""
    return -F.ln(F.least(F.greatest(chosen(triple, outcome), F.lit(EPS)), F.lit(1.0 - EPS)))


def brier_score(triple: Sequence[Column], outcome: Column) -> Column:
    """Sum of squared errors over the three classes, 0 to 2."""
    parts = [F.pow(p - F.when(outcome == name, 1.0).otherwise(0.0), F.lit(2.0)) for p, name in zip(triple, OUTCOMES)]
    return parts[0] + parts[1] + parts[2]


def triple(prefix: str = "p_") -> list[Column]:
    return [F.col(f"{prefix}{name}") for name in OUTCOMES]


def slice_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, scores, goal means and bias, cold starts per group of scored rows."""
    goals = F.avg(F.col("lambda_home") + F.col("lambda_away")) - F.avg(F.col("hg") + F.col("ag"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg(log_score(triple(), F.col("outcome"))).alias("log_loss"),
        F.avg(brier_score(triple(), F.col("outcome"))).alias("brier"),
        F.avg("lambda_home").alias("predicted_home"), F.avg("lambda_away").alias("predicted_away"),
        F.avg("hg").alias("actual_home"), F.avg("ag").alias("actual_away"),
        goals.alias("goal_bias"),
        F.sum((F.size("cold_started") > 0).cast("bigint")).alias("cold_start"),
    )


def calibration(scored: DataFrame, by: Sequence[str] = (), prefix: str = "p_") -> DataFrame:
    """Mean forecast against observed frequency per outcome."""
    long = scored.select(
        *by, F.col("outcome").alias("__happened"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("outcome"), p.alias("p")) for name, p in zip(OUTCOMES, triple(prefix))
        ])).alias("x"),
    ).select(*by, "__happened", "x.*")
    return long.groupBy(*by, "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"),
        F.avg((F.col("__happened") == F.col("outcome")).cast("double")).alias("observed"),
    ).withColumn("bias", F.col("mean_predicted") - F.col("observed"))


def low_score_cells(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Actual and mean predicted frequency of 0-0, 0-1, 1-0, 1-1 over scored rows."""
    cells = ((0, 0), (0, 1), (1, 0), (1, 1))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(((F.col("hg") == h) & (F.col("ag") == a)).cast("bigint")).alias(f"actual_{h}{a}") for h, a in cells],
        *[F.avg(F.get("low_score", F.lit(i))).alias(f"predicted_{h}{a}") for i, (h, a) in enumerate(cells)],
    )


def rho_summary(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distribution of the fitted dependence parameter over cutoffs, with sign changes in time order."""
    ordered = neighbours(fits.filter("rho IS NOT NULL"), by, ["cutoff"], previous={"__prev": F.col("rho")})
    flips = ordered.withColumn(
        "__flip", (F.col("__prev").isNotNull() & ((F.col("__prev") > 0) != (F.col("rho") > 0))).cast("bigint")
    )
    return flips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fits"), F.avg("rho").alias("mean"), F.median("rho").alias("median"),
        F.min("rho").alias("min"), F.max("rho").alias("max"), F.sum("__flip").alias("sign_changes"),
        F.avg((F.col("rho") < 0).cast("double")).alias("negative_share"),
        F.min_by("rho", "cutoff").alias("first"), F.max_by("rho", "cutoff").alias("last"),
    )


def rho_by_year(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    year = F.year(F.timestamp_micros("cutoff"))
    return fits.filter("rho IS NOT NULL").groupBy(*by, year.alias("year")).agg(
        F.round(F.median("rho"), 4).alias("median")
    )


def select_candidate(slices: DataFrame, baseline: str, min_gain: float, max_brier_cost: float) -> DataFrame:
    """One row: the simplest candidate clearing both bars on the given slices, or NULL.

    `slices`: candidate, complexity, log_loss, brier, one row per candidate, so
    the list gathered here is as long as the candidate grid.
    """
    listed = slices.agg(F.collect_list(F.struct("candidate", "complexity", "log_loss", "brier")).alias("all"))
    base = F.get(F.filter("all", lambda c: c["candidate"] == baseline), F.lit(0))
    qualifying = F.filter("all", lambda c: (
        (c["candidate"] != baseline)
        & (base["log_loss"] - c["log_loss"] >= min_gain)
        & (c["brier"] - base["brier"] <= max_brier_cost)
    ))
    ranked = F.transform(qualifying, lambda c: F.struct(c["complexity"], c["log_loss"], c["candidate"].alias("candidate")))
    return listed.select(F.array_min(ranked)["candidate"].alias("selected"))
