"""A stated set of query vectors meets every row: shards of rows times lanes of queries, both of bounded size.

Rows are dealt into shards by a hash of id and vector, queries into lanes. The rows of a (shard, lane) reach a task first and
are indexed once; its queries then stream past in Arrow batches. So a task holds one shard and one batch, a row travels once
a lane and a query once a shard. Shard and lane counts come from counted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
LANE_QUERIES = 65_536
#: Integers below this are exact as doubles.
EXACT = 1 << 53


def finite(vector: str) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


def matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """floor(256 * x) of every component x as a double: integers, as doubles where these hold them, else as Python's."""
    column = table.column("v")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) and np.abs(values).max() >= EXACT >> 9:
        values = np.array([int(x) * 256 if abs(x) >= EXACT else int(np.floor(x * 256)) for x in values.tolist()], dtype=object)
    else:
        values = np.floor(values * 256)
    return values.reshape(len(column), len(values) // len(column) if len(column) else 0)


def as_long(scores: list[int]) -> np.ndarray:
    """Integers of any size as 64-bit integers; those beyond become the nearest of these."""
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores], np.int64)


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, higher first, equal scores in the order of their places."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.argsort(~scores[some], kind="stable")][:k]


def meet(
    rows: DataFrame,
    queries: DataFrame,
    index: Callable[[pa.Table], Any],
    ask: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
    shard_rows: int = SHARD_ROWS,
    lane_queries: int = LANE_QUERIES,
) -> DataFrame:
    """`ask(index(shard), batch)` for every shard of rows and every batch of queries whose vectors have the shard's length.

    rows and queries are stored tables with the same columns, id and v (an array) among them. A shard reaches `index` in the
    order of id; either side may be empty.
    """
    shards, lanes = -(-rows.count() // shard_rows) or 1, -(-queries.count() // lane_queries) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spot = F.xxhash64("id", "v")
    columns = rows.columns
    held = rows.select(F.size("v").alias("_size"), F.pmod(spot, F.lit(shards)).cast("int").alias("_shard"), every(lanes).alias("_lane"), F.lit(0).alias("_asks"), *columns)
    asked = queries.select(F.size("v").alias("_size"), every(shards).alias("_shard"), F.pmod(spot, F.lit(lanes)).cast("int").alias("_lane"), F.lit(1).alias("_asks"), *columns)
    place = ["_size", "_shard", "_lane"]
    dealt = held.unionByName(asked).repartition(shards * lanes, *place).sortWithinPartitions(*place, "_asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*place, "_asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                spot_of = tuple(keys[a, :3].tolist())
                if spot_of != here:
                    here, held, ready = spot_of, [], None
                if not keys[a, 3]:
                    held.append(part)
                    continue
                if held:
                    ready, held = index(pa.Table.from_batches(held)), []
                if ready is not None:
                    yield from ask(ready, part)

    return dealt.mapInArrow(run, schema)
