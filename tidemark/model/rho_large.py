"""The dependence parameter as grouped aggregates, for scopes whose pairings outgrow one task; stands beside fit_distributed.

The log likelihood is a sum of logs of affine functions of rho, so it is concave and its slope falls. A round sums the slope at
`POINTS` evenly spaced places of every scope's bracket in one grouped aggregate and keeps the piece in which it changes sign;
seven rounds leave a bracket of 3e-11 of the first. Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import same_key_join
from tidemark.session import ensure_checkpoint_dir

ROUNDS, POINTS = 7, 32
MARGIN = 1e-6


def estimate_rho_distributed(rated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and rho. `rated`: a row a pairing with keys, lambda_home, lambda_away and the weighted counts w00, w01, w10, w11.

    Every pairing narrows the interval in which all corrected probabilities stay positive; only low scores pull. Without low
    scores, or without an open interval, rho is 0. NULL keys are scopes like any other.
    """
    ensure_checkpoint_dir(rated.sparkSession)
    l1, l2 = F.col("lambda_home"), F.col("lambda_away")
    counts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("w00", "w01", "w10", "w11")]
    # Factors 1 + c * rho of the four low scores, and their weights.
    slopes = [-l1 * l2, l1, l2, F.lit(-1.0)]
    rows = rated.select(*keys, *[c.alias(f"c{i}") for i, c in enumerate(slopes)], *[w.alias(f"n{i}") for i, w in enumerate(counts)])
    rows = rows.groupBy(*keys, *[f"c{i}" for i in range(4)]).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]).checkpoint()
    low = F.max(F.greatest(-1 / F.col("c1"), -1 / F.col("c2"))) + MARGIN
    high = F.min(F.least(-1 / F.col("c0"), F.lit(1.0))) - MARGIN
    state = rows.groupBy(*keys).agg(low.alias("a"), high.alias("b"), (F.sum(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")) > 0).alias("pulled"))
    state = state.withColumn("open", F.col("pulled") & (F.col("a") < F.col("b"))).select(*keys, "a", "b", "open").checkpoint()
    informative = rows.filter("n0 + n1 + n2 + n3 > 0")

    def slope(rho: Column) -> Column:
        parts = [F.col(f"n{i}") * F.col(f"c{i}") / (1 + F.col(f"c{i}") * rho) for i in range(4)]
        return parts[0] + parts[1] + parts[2] + parts[3]

    width = (F.col("b") - F.col("a")) / POINTS
    for _ in range(ROUNDS):
        at = same_key_join(informative, state.filter("open"), keys)
        sums = at.groupBy(*keys).agg(*[F.sum(slope(F.col("a") + width * i)).alias(f"s{i}") for i in range(1, POINTS)])
        rising = sums.select(*keys, F.aggregate(F.array(*[(F.col(f"s{i}") > 0).cast("int") for i in range(1, POINTS)]), F.lit(0), lambda n, x: n + x).alias("rising"))
        low = F.col("a") + width * F.coalesce("rising", F.lit(0))
        state = same_key_join(state, rising, keys, "left").select(*keys, low.alias("a"), (low + width).alias("b"), "open").checkpoint()
    return state.select(*keys, F.when(F.col("open"), (F.col("a") + F.col("b")) / 2).otherwise(0.0).alias("rho"))
