"""Ordered reads (strictly-earlier totals, previous and next row) that survive hot keys.

A plain window sorts a whole key in one task. Here a key is always cut into
time buckets: the heavy step runs per (key, bucket), the rows or sums at bucket
edges go on to buckets `COARSE` times as wide, and only the edges of those are
ordered per key. So one key may hold most of the data, and a burst inside a
bucket is narrowed by a smaller `grain_us`. Nothing is counted beforehand and
every size of input runs the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Width of a bucket unless a caller knows better: a key's rows of a month fit a task.
GRAIN_US = 30 * DAY_US
#: Buckets per coarse bucket.
COARSE = 64


def earlier_totals(df: DataFrame, scope: Sequence[str], at: str, sums: Mapping[str, Column], grain_us: int = GRAIN_US) -> DataFrame:
    """Per (scope, at): the sum of each expression over rows of the scope with a strictly smaller `at`.

    Equal instants never see each other. Rows are combined per instant before
    the shuffle; sums then run inside a bucket and across buckets. NULL key
    parts make a key of their own, and rows without an instant come first.
    """
    names = list(sums)
    instant = df.groupBy(*scope, at).agg(*[F.sum(expr).alias(n) for n, expr in sums.items()])
    instant = instant.withColumn("__bucket", F.floor(F.col(at) / F.lit(grain_us)))
    inside = Window.partitionBy(*scope, "__bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    coarse = Window.partitionBy(*scope, "__coarse")
    near = coarse.orderBy("__bucket")
    past = (Window.unboundedPreceding, -1)
    far = _ends(scope, F.col("__end")).rowsBetween(*past)
    # One row per bucket: sums before it in its coarse bucket, and, handed on by the coarse buckets' last rows, before that.
    before = (
        instant.groupBy(*scope, "__bucket").agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("__coarse", F.floor(F.col("__bucket") / F.lit(COARSE)))
        .select("*", F.lead(F.lit(1)).over(near).isNull().alias("__end"), *[F.sum(n).over(coarse).alias(f"__all_{n}") for n in names], *[F.sum(n).over(near.rowsBetween(*past)).alias(f"__near_{n}") for n in names])
        .select("*", *[F.when(F.col("__end"), F.sum(f"__all_{n}").over(far)).alias(f"__far_{n}") for n in names])
        .select(*scope, "__bucket", *[(F.coalesce(F.col(f"__near_{n}"), F.lit(0)) + F.coalesce(F.max(f"__far_{n}").over(coarse), F.lit(0))).alias(f"__{n}") for n in names])
    )
    here = instant.select(*scope, at, "__bucket", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in names])
    return same_key_join(here, before, [*scope, "__bucket"]).select(*scope, at, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names])


def _ends(keys: Sequence[str], end: Column) -> Window:
    """A window over the rows of a key marked by `end` alone, in bucket order; every other row stands by itself."""
    return Window.partitionBy(*keys, F.when(~end, F.col("__bucket"))).orderBy("__bucket")


def with_earlier_totals(df: DataFrame, scope: Sequence[str], at: str, sums: Mapping[str, Column], grain_us: int = GRAIN_US) -> DataFrame:
    """Every row with the totals of strictly earlier rows of its scope."""
    return same_key_join(df, earlier_totals(df, scope, at, sums, grain_us), [*scope, at])


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Hash-joinable equi-join under which NULL key parts match each other; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    grain_us: int = GRAIN_US,
) -> DataFrame:
    """Add `previous` / `following` expressions taken from the row before / after within the key.

    `order[0]` is a bigint instant; the remaining columns break ties.
    """
    previous, following = previous or {}, following or {}
    sides = [("p", previous, F.lag, F.max_by), ("f", following, F.lead, F.min_by)]
    sides = [(s, F.struct(*[e.alias(n) for n, e in wanted.items()]), list(wanted), step, edge) for s, wanted, step, edge in sides if wanted]
    rows = df.withColumn("__bucket", F.floor(F.col(order[0]) / F.lit(grain_us)))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    near = Window.partitionBy(*keys, "__coarse").orderBy("__bucket")
    # One row per bucket with the values its edges lend to its neighbours; they pass within coarse buckets, then between.
    edges = (
        rows.groupBy(*keys, "__bucket").agg(*[edge(value, F.struct(*order)).alias(f"__{s}") for s, value, _, _, edge in sides])
        .withColumn("__coarse", F.floor(F.col("__bucket") / F.lit(COARSE)))
        .select(
            "*", (F.lag(F.lit(1)).over(near).isNull() | F.lead(F.lit(1)).over(near).isNull()).alias("__end"),
            *[step(f"__{s}").over(near).alias(f"__near_{s}") for s, _, _, step, _ in sides],
        )
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__k_bucket"),
            *[F.coalesce(F.col(f"__near_{s}"), F.when(F.col("__end"), step(f"__{s}").over(_ends(keys, F.col("__end"))))).alias(f"__far_{s}") for s, _, _, step, _ in sides],
        )
    )
    here = rows.select("*", *[step(value).over(inside).alias(f"__here_{s}") for s, value, _, step, _ in sides])
    same = F.col("__bucket").eqNullSafe(F.col("__k_bucket"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = here.join(edges, same).select(*df.columns, *[F.coalesce(f"__here_{s}", f"__far_{s}").alias(f"__{s}") for s, *_ in sides])
    return joined.select(*df.columns, *[F.col(f"__{s}.{n}").alias(n) for s, _, names, _, _ in sides for n in names])


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, grain_us: int = DAY_US
) -> DataFrame:
    """Add the last non-NULL `value` at or before each row of its key, in `order` (bigint instant first).

    Inside a bucket by a window, across buckets by the last value of each
    bucket, first within coarse buckets and then across those.
    """
    bucketed = df.withColumn("__bucket", F.floor(F.col(order[0]) / F.lit(grain_us)))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = bucketed.groupBy(*keys, "__bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    last = last.withColumn("__coarse", F.floor(F.col("__bucket") / F.lit(COARSE)))
    near = Window.partitionBy(*keys, "__coarse").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    far = (
        last.groupBy(*keys, "__coarse").agg(F.max_by("__last", F.when(F.col("__last").isNotNull(), F.col("__bucket"))).alias("__end"))
        .select(*keys, "__coarse", F.last("__end", ignorenulls=True).over(across).alias("__far"))
    )
    before = (
        same_key_join(last.withColumn("__near", F.last("__last", ignorenulls=True).over(near)), far, [*keys, "__coarse"])
        .select(*keys, "__bucket", F.coalesce("__near", "__far").alias("__before"))
    )
    return (
        same_key_join(bucketed.withColumn("__here", F.last(value, ignorenulls=True).over(inside)), before, [*keys, "__bucket"])
        .withColumn(name, F.coalesce("__here", "__before"))
        .drop("__bucket", "__here", "__before")
    )
