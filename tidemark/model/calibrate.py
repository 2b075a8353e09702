"""Out-of-sample recalibration of forecast probabilities: logistic with Spark ML, monotone by pooled blocks of all markets at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.intervals import LEVELS, as_of_cutoffs
from tidemark.operators.temporal import null_safe_join


def _logit(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(kept / (1 - kept))


def platt(past: DataFrame, future: DataFrame, probability: str, label: str, name: str) -> DataFrame:
    """Logistic regression of the outcome on the log-odds of past scored rows, applied to future rows."""
    assemble = VectorAssembler(inputCols=["__x"], outputCol="__f")

    def prepared(df: DataFrame) -> DataFrame:
        return assemble.transform(df.withColumn("__x", _logit(F.col(probability))))

    model = LogisticRegression(featuresCol="__f", labelCol=label).fit(prepared(past))
    slope, shift = float(model.coefficients[0]), float(model.intercept)
    return future.withColumn(name, 1 / (1 + F.exp(-(F.lit(slope) * _logit(F.col(probability)) + F.lit(shift)))))


def probability_steps(probability: Column, digits: int = 9) -> Column:
    """A probability as a whole number of 10^-digits, so that ties and order are exact."""
    return F.floor(probability * F.lit(10.0**digits) + F.lit(0.5)).cast("bigint")


class _Pool:
    """Pool adjacent violators over blocks (low, high, rows, hits) that come in order; all comparisons are between integers."""

    def __init__(self) -> None:
        self.blocks: list[list[int]] = []

    def add(self, low: int, high: int, rows: int, hits: int) -> None:
        top = [low, high, rows, hits]
        while self.blocks and self.blocks[-1][3] * top[2] >= top[3] * self.blocks[-1][2]:
            before = self.blocks.pop()
            top = [before[0], top[1], before[2] + top[2], before[3] + top[3]]
        self.blocks.append(top)


_BLOCK = "low long, high long, rows long, hits long"


def isotonic_blocks(past: DataFrame, by: Sequence[str], at: str, label: str) -> DataFrame:
    """Monotone least-squares fit of a 0/1 label on the whole number `at`, for every group at once: by, low, high, rows, hits.

    A block is a maximal run of `at` values with one fitted mean hits / rows, and means rise from block to block. Equal values
    are summed before the shuffle; ranges of the sorted values are pooled as they stream past, then the blocks that are left
    are pooled per group. That is exact: pooling may begin anywhere. A group of N rows keeps O(N^(2/3)) blocks at most, the
    number of rising fractions whose denominators sum to N, so 10^10 rows leave a task a few million. Rows without a value or
    label teach nothing; NULL keys make a group of their own.
    """
    key = F.to_json(F.struct(F.lit(1).alias("_"), *by)).alias("_g")
    known = past.filter(F.col(at).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(key, F.col(at).cast("long").alias("low")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("hits"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pool = None, _Pool()
        for batch in batches:
            for g, low, rows, hits in zip(*[batch.column(c).to_pylist() for c in ("_g", "low", "rows", "hits")]):
                if g != group:
                    yield from emitted(group, pool)
                    group, pool = g, _Pool()
                pool.add(low, low, rows, hits)
        yield from emitted(group, pool)

    def emitted(group: str | None, pool: _Pool) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pool.blocks), 10_000):
            part = np.array(pool.blocks[i : i + 10_000], np.int64)
            yield pa.RecordBatch.from_pydict({"_g": [group] * len(part)} | {c: part[:, j] for j, c in enumerate(("low", "high", "rows", "hits"))})

    def whole(table: pa.Table) -> pa.Table:
        pool, table = _Pool(), table.sort_by("low")
        for block in zip(*[table.column(c).to_pylist() for c in ("low", "high", "rows", "hits")]):
            pool.add(*block)
        part = np.array(pool.blocks, np.int64)
        return pa.table({"_g": [table.column("_g")[0].as_py()] * len(part)} | {c: part[:, j] for j, c in enumerate(("low", "high", "rows", "hits"))})

    pooled = points.repartitionByRange("_g", "low").sortWithinPartitions("_g", "low").mapInArrow(ranges, f"_g string, {_BLOCK}")
    blocks = pooled.groupBy("_g").applyInArrow(whole, f"_g string, {_BLOCK}")
    kinds = StructType([past.schema[c] for c in by])
    return blocks.select(F.from_json("_g", kinds).alias("_k"), "low", "high", "rows", "hits").select("_k.*", "low", "high", "rows", "hits")


def apply_isotonic(future: DataFrame, blocks: DataFrame, by: Sequence[str], at: str, name: str, digits: int = 9) -> DataFrame:
    """Every row of `future` with the fitted mean at its value: constant on a block, straight lines between, flat beyond the ends.

    NULL where the value is, or where the group was never fitted. Values meet their block by an equi-join on dyadic ranges,
    each distinct value once.
    """
    order = Window.partitionBy(*by).orderBy("low")  # a group's blocks, bounded as told above
    mean = F.col("hits") / F.col("rows")
    ends = blocks.select(
        *by, "high", mean.alias("_fit"), F.lead(mean).over(order).alias("_next"), F.lead("low").over(order).alias("superseded_at"),
        F.when(F.lag("low").over(order).isNull(), -(1 << 60)).otherwise(F.col("low")).alias("known_at"),
    )
    asked = future.select(*by, F.col(at).cast("long").alias(at)).distinct()
    grain = max(1, 10**digits >> (LEVELS - 1))
    met = as_of_cutoffs(ends, asked, at, grain, ["high", "_fit", "_next", "superseded_at"], by)
    share = (F.col(at) - F.col("high")) / (F.col("superseded_at") - F.col("high"))
    between = F.when(F.col("_next").isNull() | (F.col(at) <= F.col("high")), F.col("_fit")).otherwise(F.col("_fit") + (F.col("_next") - F.col("_fit")) * share)
    return null_safe_join(future, met.select(*by, at, between.alias(name)), [*by, at], "left")
