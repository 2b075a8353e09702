"""Exact ranks and quantiles of groups of any size.

A value is found digit by digit: the values are counted per (group, leading digits), running counts over the digits of one
prefix say which of them holds a rank, and only values with that prefix are counted again, one digit further. Counts combine
before the shuffle, a window sees the 65,536 digits of a prefix at most, and no task holds a group or its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import same_key_join
from tidemark.session import ensure_checkpoint_dir

DIGIT_BITS = 16


def at_ranks(df: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """The value at each wanted rank: `wanted` has by and rank (from 0), the result also `value`.

    `value` is a bigint; its NULLs have no rank. Ranks outside a group's values, and groups without values, are left out.
    NULL parts of `by` make a group like any other.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    found = wanted.select(*by, "rank", F.col("rank").alias("_left"), F.lit(0).cast("bigint").alias("_prefix")).distinct()
    if ends.lo is None:
        return found.select(*by, "rank", F.lit(None).cast("bigint").alias(value)).limit(0)
    # Offsets from the smallest value, as unsigned digits; a range beyond 63 bits starts from the values themselves.
    wide = ends.hi - ends.lo >= 1 << 63
    offset = F.col("_v") if wide else F.col("_v") - F.lit(ends.lo)
    digits = 4 if wide else -(-max(1, (ends.hi - ends.lo).bit_length()) // DIGIT_BITS)
    rows = rows.select(*by, offset.alias("_v"))
    for step in reversed(range(digits)):
        shift = DIGIT_BITS * step
        first = step == digits - 1
        parts = rows.select(*by, F.shiftright("_v", shift).alias("_digit"), (F.lit(0).cast("bigint") if first else F.shiftright("_v", shift + DIGIT_BITS)).alias("_prefix"))
        if not first:
            parts = same_key_join(parts, found.select(*by, "_prefix").distinct(), [*by, "_prefix"], "left_semi")
        counts = parts.groupBy(*by, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*by, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = same_key_join(found, counts, [*by, "_prefix"]).filter("_before <= _left AND _left < _before + _n")
        # One row a wanted rank, read twice by the next digit.
        found = hit.select(*by, "rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_digit").alias("_prefix")).checkpoint()
    back = F.col("_prefix") if wide else F.col("_prefix") + F.lit(ends.lo)
    return found.select(*by, "rank", back.alias(value))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float], lower: bool = False) -> DataFrame:
    """One row a group with values: by, and a column for each named fraction.

    Between two values a quantile is interpolated (a double); with `lower` it is the lower of the two (a bigint): the value
    at rank floor(fraction * (count - 1)).
    """
    place = {name: F.lit(q) * (F.col("_count") - 1) for name, q in fractions.items()}
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_count"))

    def rank(at: Column, up: bool) -> Column:
        return (F.ceil(at) if up else F.floor(at)).cast("bigint")

    asked = sizes.select(*by, "_count", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), rank(p, False).alias("low"), rank(p, True).alias("high"), (p - F.floor(p)).alias("part")) for n, p in place.items()])).alias("_q")).select(*by, "_q.*")
    ranks = asked.select(*by, F.explode(F.array("low", *([] if lower else ["high"]))).alias("rank")).distinct()
    values = at_ranks(df, by, value, ranks)
    out = same_key_join(asked, values.select(*by, F.col("rank").alias("low"), F.col(value).alias("_a")), [*by, "low"])
    if lower:
        result = F.col("_a")
    else:
        out = same_key_join(out, values.select(*by, F.col("rank").alias("high"), F.col(value).alias("_b")), [*by, "high"])
        result = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("part")
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, result)).alias(n) for n in fractions])
