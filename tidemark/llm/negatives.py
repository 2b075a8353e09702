"""Hard negatives with Kronecker-packed products.

A component x counts as floor(256 * x). The components of several candidates, biased so that none is negative, stand in
separate fields of one wide integer; an anchor's component, biased likewise, multiplies all of them at once. A field is as wide
as the largest sum it may hold, so the sums over the components never run into each other, and unpacking a field and taking
the biases off gives the exact score. Integers below 2^53 are exact as doubles, so where at least one field fits into 53 bits a
matrix product does the work of a whole batch of anchors; else the fields lie in Python's integers of any width.

Two visits: the first finds each anchor's nearest rows of its own label, its positives; the second, knowing their scores, the
best rows of other labels within each positive's range of scores. Both send every anchor past every shard of rows (`shards`),
which is the work that a stated set of anchors needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.llm.shared import stored

#: Rows of candidates packed together where fields lie in Python's integers.
WIDE_ROWS = 256
#: Bytes of scores that a task holds at once.
SCORE_BYTES = 32 << 20


def _biased(values: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The smallest component, the values less it, and the largest of these."""
    if not values.size:
        return 0, values, 0
    low = int(values.min())
    above = values - low
    return low, above, int(above.max())


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of every anchor with every row, as 64-bit integers."""
    n, size = rows.shape
    low, above, most = _biased(rows)
    own_low, own, own_most = _biased(anchors)
    width = max(1, (size * most * own_most).bit_length())
    fields = (shards.EXACT.bit_length() - 1) // width
    plain = anchors.dtype != object and rows.dtype != object
    if plain and fields and size * abs(low) * own_most < shards.EXACT and size * abs(own_low) * most < shards.EXACT and size * abs(low * own_low) < shards.EXACT:
        packed = np.zeros((-(-n // fields), size))
        for f in range(fields):
            part = above[f::fields]
            packed[: len(part)] += part * float(1 << width * f)
        sums = (own @ packed.T).astype(np.int64)
        total = np.empty((len(own), packed.shape[0], fields), np.int64)
        for f in range(fields):
            total[:, :, f] = (sums >> (width * f)) & ((1 << width) - 1)
        # (a - A)(c - C) summed is a.c - C sum(a) - A sum(c) + size A C.
        bias = (low * anchors.sum(axis=1)).astype(np.int64)[:, None] + (own_low * rows.sum(axis=1)).astype(np.int64)[None, :] - size * low * own_low
        return total.reshape(len(own), -1)[:, :n] + bias
    return np.concatenate([_wide(anchors, rows[a : a + WIDE_ROWS], width) for a in range(0, n, WIDE_ROWS)], axis=1)


def _wide(anchors: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The same with one integer of any width a component."""
    low, above, _ = _biased(rows)
    own_low, own, _ = _biased(anchors)
    span, size = -(-width // 8), rows.shape[1]
    packed = [int.from_bytes(b"".join(int(x).to_bytes(span, "little") for x in above[:, j].tolist()), "little") for j in range(size)]
    sums = [sum(int(x) for x in row) for row in rows.tolist()]
    out = np.empty((len(anchors), len(rows)), np.int64)
    for i, (anchor, shifted) in enumerate(zip(anchors.tolist(), own.tolist())):
        raw = sum(int(x) * p for x, p in zip(shifted, packed)).to_bytes(span * len(rows), "little")
        bias = low * sum(int(x) for x in anchor) - size * low * own_low
        out[i] = shards.as_long([int.from_bytes(raw[span * r : span * (r + 1)], "little") + bias + own_low * sums[r] for r in range(len(rows))])
    return out


class Rows:
    """A shard's rows in the order of their ids, their labels as numbers."""

    def __init__(self, table: pa.Table):
        self.ids, self.values = table.column("id").to_numpy(), shards.matrix(table)
        self.names, self.labels = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per anchor of the batch: its place, and for all rows scores, same label, other id."""
        values, ids = shards.matrix(batch), batch.column("id").to_numpy()
        number = {name: i for i, name in enumerate(self.names.tolist())}
        labels = [number.get(x, -1) for x in batch.column("label").to_pylist()]
        step = max(1, SCORE_BYTES // (8 * len(self.ids)))
        for a in range(0, len(ids), step):
            for i, scores in enumerate(products(values[a : a + step], self.values), a):
                yield i, scores, self.labels == labels[i], self.ids != ids[i]


def mine(
    rows: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    shard_rows: int = shards.SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    For each row where `anchors` holds, its positives are the `positives` rows of its label with the highest scores; for each
    of these, the negatives are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score. Higher scores come first, ties go to the smaller id; fewer if there are fewer.

    Rows without an id or label and vectors that are null or hold a null or non-finite component take no part; zero and empty
    vectors do. Vectors meet those of their own length only. Rows with an anchor's own id are neither its positives nor its
    negatives. Repeated rows count once; different rows under one id are candidates each, and anchors each with a list of
    their own. Components of any finite size are exact; a score beyond 64 bits counts as the nearest 64-bit integer. An empty
    table, or no anchor, gives an empty result. Other columns of rows are not read, whatever their names.
    """
    usable = rows.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & shards.finite("v"))
    usable = usable.groupBy("id", "label", "v").agg(F.max("asks").alias("asks")).withColumn("tag", F.xxhash64("label", "v"))  # tells rows of one id apart
    usable = stored(usable.withColumn("near", F.lit(None).cast("array<struct<number:int,id:bigint,score:bigint>>")))
    held = usable.drop("asks")

    def near(shard: Rows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        taken, places, values = [], [], []
        for i, scores, same, other in shard.scored(batch):
            some = np.flatnonzero(same & other)
            best = some[shards.first_rows(scores[some], positives)]
            taken.append(np.full(len(best), i)), places.append(best), values.append(scores[best])
        at = pa.array(np.concatenate(taken))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("tag").take(at), shard.ids[np.concatenate(places)], np.concatenate(values)], ["id", "tag", "there", "score"])

    found = shards.meet(held, usable.filter("asks").drop("asks"), Rows, near, "id long, tag long, there long, score long", shard_rows)
    best = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "there")  # `positives` rows a shard
    ranked = found.withColumn("number", F.row_number().over(best)).filter(F.col("number") <= positives)
    listed = ranked.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("number", F.col("there").alias("id"), "score"))).alias("near"))
    asked = stored(usable.filter("asks").drop("near", "asks").join(listed, ["id", "tag"]).select(*held.columns[:-1], F.col("near").cast(held.schema["near"].dataType).alias("near")))

    def hard(shard: Rows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, tags, wanted = batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("near").to_pylist()
        out: list[tuple[int, ...]] = []
        for i, scores, same, other in shard.scored(batch):
            # Each positive's range of whole scores: from low percent of its own, rounded up, to high percent, rounded down.
            ranges = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in wanted[i]]
            least, most = min(r[0] for r in ranges), max(r[1] for r in ranges)
            some = np.flatnonzero(~same & other & (scores >= _clip(least)) & (scores <= _clip(most)))
            some = some[np.argsort(~scores[some], kind="stable")]
            falling = ~scores[some]
            for p, (a, b) in zip(wanted[i], ranges):
                start = int(np.searchsorted(falling, ~_clip(b), "left"))
                out += [(ids[i], tags[i], p["number"], p["id"], p["score"], int(shard.ids[at]), int(scores[at])) for at in some[start : start + negatives].tolist() if a <= scores[at] <= b]
        names = ("anchor_id", "_tag", "_number", "positive_id", "positive_score", "negative_id", "negative_score")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, list(names))

    hits = shards.meet(held, asked, Rows, hard, "anchor_id long, _tag long, _number long, positive_id long, positive_score long, negative_id long, negative_score long", shard_rows)
    order = Window.partitionBy("anchor_id", "_tag", "_number").orderBy(F.desc("negative_score"), "negative_id")  # `negatives` rows a shard
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _clip(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
),
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM v
  WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: a.e[i] * c.e[i])), 0) AS score
  FROM u a JOIN u c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, CAST(p.positive_score AS BIGINT) AS positive_score, CAST(n.score AS BIGINT) AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
