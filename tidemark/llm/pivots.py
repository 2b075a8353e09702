"""Exact top-k search by integer inner product, with a pivot table.

A component x counts as floor(256 * x). Rows get one more component, sqrt(M^2 - |x|^2) with M the largest norm of their shard
and the pivots, queries a zero there: squared distances are then |q|^2 + M^2 - 2 q.x and fall as inner products rise. Pivots
are rows far from each other, chosen from a sample of at most `sample` rows. A shard's table holds the distance of every row
to every pivot. No row is nearer to a query than the largest difference between the two's distances to one pivot. Rows are
scored in the order of these bounds until the next bound lies beyond the k-th best; the pivots' own scores set the first
such mark, and the last rows with a tie are scored too, so the search is exact whatever the pivots.

The bounds only leave out rows where distances differ much, as in data with clusters or with few dimensions; on evenly spread
vectors of many components all rows are scored. README has measured shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.llm.shared import stored

PIVOTS = 64
SAMPLE = 2_048
#: Rows scored first in bound order; every further step takes twice as many.
FIRST = 256


def choose(vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of at most n vectors, each the one farthest from those before it; equal vectors are chosen once."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    near = ((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    while len(chosen) < n:
        at = int(near.argmax())
        gap = ((vectors - vectors[at]) ** 2).sum(axis=1)
        if chosen and near[at] <= 0:
            break
        near = gap if not chosen else np.minimum(near, gap)
        chosen.append(at)
    return np.array(chosen, np.int64)


class Table:
    """The pivot table of a shard: rows in the order of their ids, and their distances to the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray):
        self.ids, self.vectors, self.pivot_ids, self.pivots = ids, vectors, pivot_ids, pivots
        self.seen = self.scored = 0
        self.bounded = vectors.dtype != object and pivots.dtype != object and len(pivots) > 0
        if self.bounded:
            square, own = (vectors**2).sum(axis=1), (pivots**2).sum(axis=1)
            self.top = max(float(square.max()), float(own.max()))
            self.bounded = self.top < shards.EXACT
        if self.bounded:
            lift, own_lift = np.sqrt(self.top - square), np.sqrt(self.top - own)
            apart = 2 * self.top - 2 * (pivots @ vectors.T + own_lift[:, None] * lift)
            self.table = np.sqrt(np.maximum(apart, 0)).astype(np.float32)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """No row has a larger inner product with the query than this; widened by far more than rounding may be off."""
        square = float(query @ query)
        away = np.sqrt(np.maximum(square + self.top - 2 * (self.pivots @ query), 0)).astype(np.float32)
        least = np.zeros(len(self.ids), np.float32)
        gap = np.empty_like(least)
        for k in range(len(away)):
            np.subtract(self.table[k], away[k], out=gap)
            np.abs(gap, out=gap)
            np.maximum(least, gap, out=least)
        scale = np.sqrt(square + self.top)
        least = np.maximum(least.astype(np.float64) - 1e-5 * scale, 0)
        return (square + self.top - least**2) / 2 + 1e-9 * scale**2

    def products(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: by doubles while these hold all sums, else by Python's integers."""
        some = self.vectors[rows]
        if query.dtype != object and some.dtype != object and len(query) and len(some):
            if len(query) * float(np.abs(query).max()) * float(np.abs(some).max()) < shards.EXACT:
                return (some @ query).astype(np.int64)
        asked = [int(x) for x in query.tolist()]
        return shards.as_long([sum(int(x) * y for x, y in zip(row, asked)) for row in some.tolist()])

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows for a query, the query's own id excepted."""
        open_rows = np.flatnonzero(self.ids != own)
        self.seen += len(open_rows)
        square = 0.0 if query.dtype == object else float(query @ query)
        if not self.bounded or query.dtype == object or square >= shards.EXACT or len(open_rows) <= FIRST:
            self.scored += len(open_rows)
            scores = self.products(query, open_rows)
            best = shards.first_rows(scores, k)
            return open_rows[best], scores[best]
        limit = self.bounds(query)[open_rows]
        known = self.pivots[self.pivot_ids != own] @ query  # scores of rows of the whole table
        mark = float(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else -np.inf
        keep = np.flatnonzero(limit >= mark)
        keep = keep[np.argsort(-limit[keep], kind="stable")]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, FIRST
        while at < len(keep) and limit[keep[at]] >= mark:
            rows = open_rows[keep[at : at + step]]
            self.scored += len(rows)
            rows = np.concatenate([places, rows])
            found = np.concatenate([scores, self.products(query, rows[len(places) :])])
            order = np.argsort(rows, kind="stable")
            best = order[shards.first_rows(found[order], k)]
            places, scores = rows[best], found[best]
            if len(scores) == k:
                mark = max(mark, float(scores[-1]))
            at, step = at + step, 2 * step
        return places, scores


def top(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, shard_rows: int = shards.SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), `key` and score: for each row where `queries` holds, the k rows of largest integer inner
    product, ties to the smaller id, rows with the query's own id excepted; fewer if there are fewer.

    Rows without an id and vectors that are null or hold a null or non-finite component take no part. Zero and empty vectors
    do; vectors meet those of their own length only. Repeated rows count once; different vectors under one id are candidates
    each, and as queries the k best of all of them are ranked together. Components of any finite size are exact: where
    doubles can't hold the products, a shard is searched in Python's integers without bounds; a score beyond 64 bits counts
    as the nearest 64-bit integer. An empty table, or no query, gives an empty result. Other columns of rows are not read,
    whatever their names.
    """
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & shards.finite("v"))
    usable = stored(usable.groupBy("id", "v").agg(F.max("asks").alias("asks")))
    drawn = usable.select("id", "v").orderBy(F.xxhash64("id", "v"), "id", "v").limit(sample).collect()  # `sample` rows
    chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["v"]) for r in drawn}:
        own = [r for r in drawn if len(r["v"]) == size]
        values = shards.matrix(pa.table({"v": pa.array([r["v"] for r in own], pa.list_(pa.float64()))}))
        if values.dtype != object and size:
            at = choose(values, pivots)
            chosen[size] = np.array([own[i]["id"] for i in at], np.int64), values[at]
    shared = rows.sparkSession.sparkContext.broadcast(chosen)  # `pivots` vectors a length, all of them from the sample

    def index(table: pa.Table) -> Table:
        vectors = shards.matrix(table)
        none = np.zeros(0, np.int64), np.zeros((0, vectors.shape[1]))
        return Table(table.column("id").to_numpy(), vectors, *shared.value.get(vectors.shape[1], none))

    def ask(table: Table, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("id").to_numpy()
        found = [table.search(own, query, k) for own, query in zip(ids.tolist(), shards.matrix(batch))]
        places = np.concatenate([f[0] for f in found])
        yield pa.RecordBatch.from_arrays([np.repeat(ids, [len(f[0]) for f in found]), table.ids[places], np.concatenate([f[1] for f in found])], ["query_id", "_id", "score"])

    found = shards.meet(usable.select("id", "v"), usable.filter("asks").select("id", "v"), index, ask, "query_id long, _id long, score long", shard_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")  # k rows a shard
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(key), "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM v
  WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM p QUALIFY rank <= 5
"""
