"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Rows are dealt into shards of about `shard_rows` by a hash of their id, and a task builds the tree of one shard. Inner
products have no triangle inequality, so a shard's vectors get one more component, sqrt(M^2 - |x|^2) with M its largest
norm, and queries get a zero there: distances then fall as inner products rise. A subtree whose distances from the vantage
point lie in [low, high] can't hold anything nearer than max(low - d, d - high) to a query at distance d. It is left out if
that bound times `factor` exceeds the distance of the k-th best: factor 1 is exact search, larger factors prune more.

Queries are packed in blocks, and a block visits every shard, which is the work that a stated query set needs; each visit
returns the k best, and a window over a query's few returns ranks them. Scores are sums of products in component order, in
double precision, over the original vectors, so equal vectors have equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

SHARD_ROWS = 8_192
BLOCK_QUERIES = 256
LEAF = 256


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in component order."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * vectors[:, j]
    return total


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A vantage-point tree: points in leaf order, and per node its point, range of points, children and distance rings."""
    norms = (vectors**2).sum(axis=1)
    lifted = np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)
    order = np.argsort(ids, kind="stable")
    nodes: list[list[float]] = []  # first, last, left, right, low and high of the left, low and high of the right
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([a, b, -1, -1, 0, 0, 0, 0])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a <= LEAF:
            continue
        own = order[a:b]
        far = ((lifted[own] - lifted[own[0]]) ** 2).sum(axis=1).argmax()  # a corner makes a good vantage point
        own[[0, far]] = own[[far, 0]]
        d = np.sqrt(((lifted[own[1:]] - lifted[own[0]]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        own[1:], d = own[1:][by], d[by]
        half = len(d) // 2
        nodes[me][4:] = [d[0], d[half - 1], d[half], d[-1]]
        todo += [(a + 1, a + 1 + half, me, 0), (a + 1 + half, b, me, 1)]
    return {"ids": ids[order], "vectors": vectors[order], "last": lifted[order, -1], "nodes": np.array(nodes, float)}


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best points of a tree for each query, without the query's own id."""
    ids, vectors, nodes = tree["ids"], tree["vectors"], tree["nodes"]
    n = len(queries)
    score = np.full((n, k), -np.inf)
    found = np.full((n, k), np.iinfo(np.int64).max)
    square = (queries**2).sum(axis=1)
    lift = float((vectors[0] ** 2).sum() + tree["last"][0] ** 2)  # M^2

    size = np.sqrt(square * max(lift, 0.0))  # bounds every inner product of a query
    slack = 1e-6 * np.sqrt(max(lift, 0.0))  # far wider than rounding, also after a square root

    def offer(who: np.ndarray, a: int, b: int) -> np.ndarray:
        """Take points a to b for the queries; the matrix product finds what may matter, the score is then summed in order."""
        rough = queries[who] @ vectors[a:b].T
        may = (rough >= (score[who, -1] - 1e-12 * size[who])[:, None]) & (query_ids[who][:, None] != ids[None, a:b])
        some = np.flatnonzero(may.any(axis=1))
        if len(some):
            rows, (i, j) = who[some], np.nonzero(may[some])
            gained = np.full((len(rows), b - a), -np.inf)
            gained[i, j] = products(queries[rows[i]], vectors[a + j])
            both = np.concatenate([score[rows], gained], axis=1)
            names = np.concatenate([found[rows], np.broadcast_to(ids[a:b], (len(rows), b - a))], axis=1)
            names = np.where(both > -np.inf, names, np.iinfo(np.int64).max)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        return rough

    def reach(who: np.ndarray) -> np.ndarray:
        """Distance of the k-th best."""
        return np.sqrt(np.maximum(square[who] + lift - 2 * score[who, -1], 0)) + slack

    todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(n), np.zeros(n))]
    while todo:
        at, who, bound = todo.pop()
        keep = bound * factor <= reach(who)  # the k-th best may have come nearer since
        who = who[keep]
        if not len(who):
            continue
        a, b, left, right = nodes[at, :4].astype(int)
        if left < 0:
            offer(who, a, b)
            continue
        d = np.sqrt(np.maximum(square[who] + lift - 2 * offer(who, a, a + 1)[:, 0], 0))
        low = [np.maximum(np.maximum(nodes[at, 4 + 2 * s] - d, d - nodes[at, 5 + 2 * s]), 0) - slack for s in (0, 1)]
        first = low[0] <= low[1]
        # The nearer side first: the last pushed is the next looked at.
        todo += [(right, who[first], low[1][first]), (left, who[~first], low[0][~first]), (left, who[first], low[0][first]), (right, who[~first], low[1][~first])]
    number, place = np.nonzero(score > -np.inf)
    return number, found[number, place], score[number, place]


def neighbours(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), `key` and score: for each row where `queries` holds, its k nearest rows, ties to the smaller
    id, a row with the query's own id excepted; fewer if there are fewer.

    Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite component take no part, neither
    as queries nor as candidates. Repeated rows count once; different vectors under one id are candidates each, and as
    queries the k best of all of them are ranked together. Vectors meet those of their own length only. An empty table, or
    no query, gives an empty result. Other columns of rows are not read, whatever their names.
    """
    body = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(body, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(body, lambda x: x != 0)
    usable = rows.select(F.col(key).cast("long").alias("id"), body.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    usable = stored(usable.withColumn("size", F.size("v")).groupBy("id", "size", "v").agg(F.max("asks").alias("asks")))
    counts = usable.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = -(-counts["n"] // shard_rows) or 1, -(-counts["q"] // BLOCK_QUERIES) or 1

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table.column("v").combine_chunks()
        return table.column("id").to_numpy(), values.flatten().to_numpy().reshape(len(values), -1)

    def plant(group: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"size": pa.array([group[0].as_py()], pa.int32()), "shard": pa.array([group[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(build(*arrays(table)))], pa.binary())})

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        ids, values = arrays(table)
        order = np.argsort(ids, kind="stable")
        return pa.table({"size": pa.array([group[0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps((ids[order], values[order]))], pa.binary())})

    spot = F.xxhash64("id", "v")
    trees = usable.withColumn("shard", F.pmod(spot, F.lit(shards)).cast("int")).groupBy("size", "shard").applyInArrow(plant, "size int, shard int, tree binary")
    packed = usable.filter("asks").withColumn("block", F.pmod(spot, F.lit(blocks)).cast("int")).groupBy("size", "block").applyInArrow(pack, "size int, queries binary")
    visits = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, ["size", "shard"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values = pickle.loads(batch.column("queries")[i].as_py())
                number, there, score = search(pickle.loads(batch.column("tree")[i].as_py()), ids, values, k, factor)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[number]), key: pa.array(there), "score": pa.array(score)})

    near = visits.select("queries", "tree").mapInArrow(visit, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)  # k rows a shard
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
