"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct five-word shingles, kept as 64-bit fingerprints; documents with equal sets are one
class from the start. Shingles are ordered by rarity. A similarity of 0.75 needs an overlap of three quarters of the larger
set, so two similar sets share a shingle within their prefixes, and shingles that only one class has never join at all:

1. every class sends its shingles to buckets by value, packed; a bucket counts the classes of each shingle and returns
   those that at least two have;
2. a class that shares too few shingles to reach three quarters of its own size is done; the others order theirs by
   rarity (powers of two of the class count, ties by value) and cut the prefix;
3. classes with equal prefixes and size form a group; groups meet on prefix shingles, filtered by size and position;
4. group pairs are expanded to members and verified on whole sets.

A list of a common prefix shingle may hold a third of all groups, nearly all of them similar to each other. So each group
meets one hub of its list first, the text that has fewest shingles of its own, and then come the pairs whose components still
differ, all of them. A pair within a component needs no link of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.components import components
from tidemark.llm.shared import stored, text_batches

WORDS = 5
PERCENT = 75
MOST_BUCKETS = 1 << 16


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of word shingles and their text numbers, in text order; a shorter text is one shingle as a whole."""
    lower = columnar.LOWER[data]
    s, e, d = columnar.word_spans(lower, offs, columnar.WHITE_SPACE)
    prints = columnar.fingerprints(columnar.running(lower), s, e)
    n = len(offs) - 1
    count = np.bincount(d, minlength=n)
    first = np.cumsum(count) - count
    if len(prints) >= words:
        whole = np.flatnonzero(d[: len(d) - words + 1] == d[words - 1 :])
        found, owner = [columnar.fold(prints[whole + j] for j in range(words))], [d[whole]]
    else:
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        if len(short):
            found.append(columnar.mix(columnar.fold(prints[first[short] + j] for j in range(k)) + np.uint64(k)))
            owner.append(short)
    tokens, owners = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(owners, kind="stable")
        tokens, owners = tokens[order], owners[order]
    return tokens, owners


def _sets(block: pa.Table, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their numbers, and the classes: fingerprints of the sets."""
    data, offs = columnar.utf8(block.column("t"))
    sets = []
    for i, j in columnar.pieces(offs):
        own = offs[i : j + 1] - offs[i]
        tokens, owners = shingles(data[offs[i] : offs[j]], own, words)
        edges = np.searchsorted(owners, np.arange(len(own)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            x = np.sort(tokens[a:b])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    sizes = np.array([len(x) for x in sets], np.int64)
    sums = np.array([np.add.reduce(x, dtype=np.uint64) for x in sets], np.uint64)
    twisted = np.array([np.bitwise_xor.reduce(x * np.uint64(0x9FB21C651E98DF25)) if len(x) else 0 for x in sets], np.uint64)
    return sets, sizes, columnar.mix(sums + columnar.mix(twisted + sizes.astype(np.uint64)))


def _pack(sets: list[np.ndarray], classes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: its number, and how many classes, the classes, their sizes, how many of their shingles fall here,
    and the low 48 bits of those."""
    counts = np.array([len(x) for x in sets], np.int64)
    tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), counts)
    bucket = ((tokens >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    low = np.ascontiguousarray(tokens).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    names = np.unique(bucket)
    rows = []
    for a, b in zip(np.searchsorted(bucket, names).tolist(), np.searchsorted(bucket, names, "right").tolist()):
        there = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        rows.append(b"".join([
            np.uint32(len(there)).tobytes(), classes[owner[a:b][there]].tobytes(), counts[owner[a:b][there]].astype(np.uint32).tobytes(),
            np.diff(np.append(there, b - a)).astype(np.uint32).tobytes(), low[a:b].tobytes(),
        ]))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(names.astype(np.int32)), "packed": pa.array(rows, pa.binary())})


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    classes = np.frombuffer(packed, "<u8", n, 4)
    sizes, counts = np.frombuffer(packed, "<u4", 2 * n, 4 + 8 * n).reshape(2, n)
    low = np.frombuffer(packed, np.uint8, -1, 4 + 16 * n).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    return classes, sizes, counts.astype(np.int64), wide.view("<u8").ravel()


def _shared(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: the shingles that several classes have, with the powers of two of their class counts; packed by
        ranges of classes."""
        classes, sizes, counts, tokens = (np.concatenate(x) for x in zip(*[_unpack(x) for x in table.column("packed").to_pylist()]))
        once = np.zeros(len(classes), bool)
        once[np.unique(classes, return_index=True)[1]] = True  # a class that several blocks sent counts once
        tokens = tokens[np.repeat(once, counts)]
        owner = np.repeat(np.arange(int(once.sum()), dtype=np.int32), counts[once])
        classes, sizes = classes[once], sizes[once]
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        runs = np.diff(np.append(starts, len(tokens)))
        common = np.repeat(runs, runs)
        keep = common >= 2
        tokens, owner, power = tokens[keep] | np.uint64(int(key[0].as_py()) << 48), owner[keep], np.log2(common[keep]).astype(np.uint8)
        order = np.lexsort((owner, classes[owner]))  # by class, and so by part
        tokens, owner, power = tokens[order], owner[order], power[order]
        part = _part(classes[owner], buckets)
        names = np.unique(part)
        rows = []
        for i, j in zip(np.searchsorted(part, names).tolist(), np.searchsorted(part, names, "right").tolist()):
            there = np.flatnonzero(np.concatenate([[True], owner[i + 1 : j] != owner[i : j - 1]]))
            who = owner[i:j][there]
            rows.append(b"".join([
                np.uint32(len(who)).tobytes(), classes[who].tobytes(), sizes[who].astype("<u4").tobytes(), np.diff(np.append(there, j - i)).astype("<u4").tobytes(),
                tokens[i:j].astype("<u8").tobytes(), power[i:j].tobytes(),
            ]))
        return pa.table({"part": pa.array(names, pa.int32()), "packed": pa.array(rows, pa.binary())})

    return run


def _part(classes: np.ndarray, buckets: int) -> np.ndarray:
    return ((classes >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def _live(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one part: the classes with enough shared shingles, those in order of rarity, and their prefixes."""
        found = []
        for x in table.column("packed").to_pylist():
            n = int(np.frombuffer(x, "<u4", 1)[0])
            classes = np.frombuffer(x, "<u8", n, 4)
            sizes, counts = np.frombuffer(x, "<u4", 2 * n, 4 + 8 * n).reshape(2, n).astype(np.int64)
            total = int(counts.sum())
            found.append((np.repeat(classes, counts), np.repeat(sizes, counts), np.frombuffer(x, "<i8", total, 4 + 16 * n), np.frombuffer(x, "u1", total, 4 + 16 * n + 8 * total)))
        classes, sizes, tokens, power = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((tokens, power, classes))
        classes, sizes, tokens = classes[order], sizes[order], tokens[order]
        first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        last = np.append(first[1:], len(classes))
        need = -(-percent * sizes[first] // 100)
        enough = np.flatnonzero(last - first >= need)
        out = [(classes[a], sizes[a], tokens[a:b], tokens[a : b - q + 1]) for a, b, q in zip(first[enough].tolist(), last[enough].tolist(), need[enough].tolist())]
        long = pa.list_(pa.int64())
        return pa.table({
            "class": pa.array(np.array([x[0] for x in out], np.uint64).view(np.int64)), "n": pa.array([x[1] for x in out], pa.int64()),
            "k": pa.array([len(x[2]) for x in out], pa.int64()), "tokens": pa.array([x[2] for x in out], long), "prefix": pa.array([x[3] for x in out], long),
        })

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
    return overlap.filter(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: `key`, uid (a fingerprint of key and text), n_shingles, component_id, the smallest key that
    links reach, and component, a number of the component; two rows link when their sets have a Jaccard similarity of at least percent / 100.

    A null or empty text, or one without words, has an empty set, is linked with nothing and is a component of its own.
    Equal sets are linked, so repeated rows and ties share a component. A row whose key is null takes part and gets the
    smallest key of its component that isn't null. Very long texts are sets like any other. An empty table gives an empty
    result. Other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    taken = docs.select(F.col(key).alias("k"), _uid(key, text).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t", 4 << 20):
            _, n, classes = _sets(block, words)
            yield pa.RecordBatch.from_arrays([block.column("k").combine_chunks(), block.column("uid").combine_chunks(), pa.array(n), pa.array(classes.view(np.int64))], ["k", "uid", "n", "class"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t"):
            sets, n, classes = _sets(block, words)
            _, first = np.unique(classes, return_index=True)  # copies within a block are sent once
            first = first[n[first] > 0]
            yield _pack([sets[i] for i in first], classes[first], buckets)

    kind = taken.schema["k"].dataType.simpleString()
    rows = stored(taken.mapInArrow(sizes, f"k {kind}, uid long, n long, class long"))
    classes = rows.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.min("k").alias("least"))
    shared = taken.select("t").mapInArrow(packed, "bucket int, packed binary").groupBy("bucket").applyInArrow(_shared(buckets), "part int, packed binary")
    live = shared.groupBy("part").applyInArrow(_live(percent), "class long, n long, k long, tokens array<long>, prefix array<long>")
    live = stored(live.withColumn("group", F.xxhash64("n", "prefix")))

    groups = live.groupBy("group").agg(F.min("class").alias("head"))
    member = live.join(groups, "group").select("class", "head", "n", "k", "group")
    band = F.floor(F.log("n") / math.log(100 / percent))
    heads = live.join(groups.select(F.col("head").alias("class")), "class", "left_semi")
    entries = stored(heads.select(F.col("class").alias("head"), "n", "k", band.alias("band"), F.posexplode("prefix").alias("pos", "token")))
    # A list's hub is the class with the least share of shingles of its own: the text that others were made from.
    central = F.struct(((F.col("n") - F.col("k")) / F.col("n")).alias("own"), F.col("head").alias("head"))
    lists = entries.groupBy("token", "band").agg(F.min(central).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    near = entries.join(lists, ["token", "band"]).filter("head <> hub.head").select(F.col("head").alias("a"), F.col("hub.head").alias("b"))
    inner = member.filter("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    links = stored(_verified(near.unionByName(inner).distinct(), live, percent))

    # Members of groups on lists where components still differ, with their roots.
    roots = components(links)
    placed = member.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    spans = placed.groupBy("head").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_lists = entries.join(spans, "head").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("token")
    left = stored(entries.join(open_lists, "token").select("token", "head", "pos").join(placed.select("head", "class", "n", "k", "root"), "head"))
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    one = left.select("token", F.col("class").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), (F.col("n") - F.col("k") + F.col("pos")).alias("pa"))
    two = one.toDF("token", "b", "nb", "rb", "pb")
    least_overlap = f"ceil({percent} * (na + nb) / {100 + percent}D - 1e-9)"
    rest = one.join(two, "token").filter("a < b AND ra <> rb").filter(fits).filter(f"1 + least(na - pa - 1, nb - pb - 1) >= {least_overlap}").select("a", "b").distinct()
    links = stored(links.unionByName(_verified(rest, live, percent)).distinct())

    roots = components(links)
    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    reached = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(reached, "root").select("class", "root", "component")
    joined = rows.join(named, (rows["class"] == named["class"]) & (rows["n"] > 0), "left")
    smallest = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k"))
    return joined.select(F.col("k").alias(key), "uid", F.col("n").alias("n_shingles"), smallest.alias("component_id"), F.col("root").alias("component"))


def _uid(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs of which one stands for each component: the one with the smallest key, null keys last.

    Rows without words are linked with nothing and all stay. Of repeated rows one stays.
    """
    wordy = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    joined = join(docs, text, key).filter("n_shingles > 0")
    first = joined.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), "uid")).alias("first"))
    chosen = first.select(F.col("first.uid").alias("_uid"))
    kept = docs.filter(wordy).withColumn("_uid", _uid(key, text)).join(chosen, "_uid", "left_semi").dropDuplicates(["_uid"])
    return kept.select(*docs.columns).unionByName(docs.filter(~wordy))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
