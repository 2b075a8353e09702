"""Suffix-array deduplication: every byte covered by a string of `length` bytes that also starts earlier is removed.

All suffixes of a corpus, sorted by their first hundred bytes, would be shuffled at many times the size of the text. So the
array is sparse: of the 32-byte grams inside each window of `length` bytes the one with the smallest fingerprint is the
window's anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and
only suffixes that begin at anchors are sorted. An anchor's context is the bytes of all windows it serves.

1. Sampled splitters deal the anchored suffixes into ranges of their leading bytes. A bucket sorts its suffixes key by key
   (leading bytes, gram, context, place) as a multikey quicksort would. Of equal contexts all but the earliest are repeats as
   a whole. A context alone with its gram holds no repeat. The earliest of several contexts under one gram stay open.
2. Open contexts are cut from the texts, and their windows compared within a range again.
3. Repeats of both kinds are united per document and taken out of its text.

A gram that fills whole ranges of the sample is common: its suffixes are dealt over those ranges by context, are always left
open, and their windows are compared by content, so no key has to meet in one task and nothing is missed at the boundaries.
Copies within a block of text are told apart before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import stored, text_batches

LENGTH = 100
GRAM = 32
#: Documents sampled for the splitters, and anchors taken of each.
SAMPLE_DOCS, SAMPLE_ANCHORS = 2_000, 64
MOST_BUCKETS = 1 << 16
_NO_ID = np.iinfo(np.int64).min


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The anchors of a block of texts in text order: text number, place, offsets, sort key, rest of the gram, context.

    `first` is where the anchor's first window starts and `more` how many windows follow it, one byte apart each.
    """
    n, width = len(data), length - GRAM + 1
    none = {k: np.zeros(0, np.int64) for k in ("doc", "first", "at", "more", "key", "rest", "context")}
    long_enough = np.flatnonzero(np.diff(offs) >= length)
    if not len(long_enough):
        return none
    sums = columnar.running(data)
    at = np.arange(n - GRAM + 1)
    grams = columnar.fingerprints(sums, at, at + GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    fits = np.zeros(len(low) + 1, np.int32)
    np.add.at(fits, offs[long_enough], 1)
    np.add.at(fits, offs[long_enough + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    anchor = (low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last, at = windows[start], windows[np.append(start[1:], len(windows)) - 1], anchor[start]
    lead = np.zeros(len(at), np.uint64)
    for j in range(6):
        lead = (lead << np.uint64(8)) | data[at + j].astype(np.uint64)
    gram = grams[at]
    context = columnar.fingerprints(sums, first, last + length)
    context = columnar.mix(context + ((at - first) * 256 + (last - first)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return {
        "doc": np.searchsorted(offs, at, "right") - 1, "first": first, "at": at, "more": last - first,
        "key": (lead << np.uint64(16)) | (gram >> np.uint64(48)), "rest": (gram >> np.uint64(32)) & np.uint64(0xFFFF), "context": context,
    }


def block_anchors(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """anchors() of a block of texts, piece by piece."""
    parts = []
    for i, j in columnar.pieces(offs):
        found = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
        found["doc"] = found["doc"] + i
        found["first"], found["at"] = found["first"] + offs[i], found["at"] + offs[i]
        parts.append(found)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


class Ranges:
    """Splitters of the sort key, and the keys that fill whole ranges."""

    def __init__(self, sample: np.ndarray, buckets: int):
        sample = np.sort(sample)
        self.buckets = buckets
        cuts = sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else np.zeros(0, np.uint64)
        self.cuts = cuts
        names, counts = np.unique(cuts, return_counts=True)
        self.common = names[counts > 1]

    def deal(self, key: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each key, and whether the key is common; common keys go over their ranges by `spread`."""
        low = np.searchsorted(self.cuts, key, "left")
        common = np.isin(key, self.common)
        ranges = np.searchsorted(self.cuts, key, "right") - low + 1
        return np.where(common, low + (spread % np.maximum(ranges, 1).astype(np.uint64)).astype(np.int64), low), common


#: Records that travel: documents by id and tag, and per record its document's place in the block.
_ANCHOR = np.dtype([("doc", "<u4"), ("key", "<u8"), ("rest", "<u2"), ("context", "<u8"), ("first", "<u4"), ("more", "u1"), ("at", "u1"), ("kind", "u1")])
_REPEAT, _PLAIN, _COMMON = 0, 1, 2


def _ids(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return block.column("id").to_numpy(), block.column("tag").to_numpy()


def _rank(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Equal for equal (id, tag), and in their order."""
    order = np.lexsort((tags, ids))
    new = np.concatenate([[0], ((ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])).astype(np.int64)])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _packed(buckets: np.ndarray, records: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per bucket: count of documents, their ids and tags, and the records with documents renumbered."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    names = np.unique(buckets)
    for b, i, j in zip(names.tolist(), np.searchsorted(buckets, names).tolist(), np.searchsorted(buckets, names, "right").tolist()):
        part = records[i:j].copy()
        docs, part["doc"] = np.unique(part["doc"], return_inverse=True)
        yield b, b"".join([np.uint32(len(docs)).tobytes(), ids[docs].astype("<i8").tobytes(), tags[docs].astype("<i8").tobytes(), part.tobytes()])


def _unpacked(packed: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags, records, base = [], [], [], 0
    for x in packed:
        n = int(np.frombuffer(x, "<u4", 1)[0])
        ids.append(np.frombuffer(x, "<i8", n, 4))
        tags.append(np.frombuffer(x, "<i8", n, 4 + 8 * n))
        part = np.frombuffer(x, kind, -1, 4 + 16 * n).copy()
        part["doc"] += base
        base += n
        records.append(part)
    return np.concatenate(ids), np.concatenate(tags), np.concatenate(records)


def _by_document(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """One entry per document that has values (rows of integers): its id, tag and the values' bytes."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], np.ascontiguousarray(values[order].astype("<u4"))
    names = np.unique(doc)
    pieces = [values[i:j].tobytes() for i, j in zip(np.searchsorted(doc, names).tolist(), np.searchsorted(doc, names, "right").tolist())]
    return ids[names], tags[names], pieces


def _sorted(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: per document the spans that repeat and the anchors left open, as (start, end) and (first, at, more)."""
        ids, tags, r = _unpacked(table.column("packed").to_pylist(), _ANCHOR)
        rank = _rank(ids, tags)[r["doc"]]
        known = r["kind"] == _REPEAT
        spans_doc, spans = [r["doc"][known]], [np.stack([r["first"][known], r["first"][known].astype(np.int64) + r["more"][known] + length], axis=1)]
        r, rank = r[~known], rank[~known]
        context = r["context"].astype(np.uint64)
        order = np.lexsort((r["first"], rank, context, r["rest"], r["key"]))
        r, rank, context = r[order], rank[order], context[order]
        new_gram = np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["rest"][1:] != r["rest"][:-1])])[: len(r)]
        new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])[: len(r)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else np.zeros(0, np.int64)
        again = (rank != rank[head]) | (r["first"] != r["first"][head])
        spans_doc.append(r["doc"][again])
        spans.append(np.stack([r["first"][again], r["first"][again].astype(np.int64) + r["more"][again] + length], axis=1))
        gram = np.cumsum(new_gram) - 1
        contexts = np.bincount(gram[new], minlength=int(gram[-1]) + 1 if len(gram) else 0)
        left = new & ((contexts[gram] > 1) | (r["kind"] == _COMMON)) if len(r) else np.zeros(0, bool)
        o = r[left]
        a = _by_document(ids, tags, np.concatenate(spans_doc), np.concatenate(spans))
        b = _by_document(ids, tags, o["doc"], np.stack([o["first"], o["at"], o["more"], o["kind"]], axis=1))
        return pa.table({
            "id": pa.array(np.concatenate([a[0], b[0]]), pa.int64()), "tag": pa.array(np.concatenate([a[1], b[1]]), pa.int64()),
            "spans": pa.array(a[2] + [None] * len(b[2]), pa.binary()), "open": pa.array([None] * len(a[2]) + b[2], pa.binary()),
        })

    return run


#: Windows that travel: content, and (document, start).
_WINDOW = np.dtype([("doc", "<u4"), ("print", "<u8"), ("start", "<u4")])


def _cut_windows(packed: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, tags and windows of contexts cut from texts. They are fingerprinted some at a time and joined once."""
    ids, tags, parts, held, base, size = [], [], [], [], 0, 0

    def settle() -> None:
        doc, first, more = (np.concatenate(x) for x in zip(*[(d, f, m) for d, f, m, _ in held]))
        data = np.concatenate([x for *_, x in held])
        edges = np.concatenate([[0], np.cumsum(more + length)])
        each = np.repeat(np.arange(len(doc)), more + 1)
        j = np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        part = np.zeros(len(each), _WINDOW)
        part["doc"], part["start"] = doc[each], first[each] + j
        part["print"] = columnar.fingerprints(columnar.running(data), edges[each] + j, edges[each] + j + length)
        parts.append(part)
        held.clear()

    for x in packed:
        n, m = np.frombuffer(x, "<u4", 2).tolist()
        ids.append(np.frombuffer(x, "<i8", n, 8))
        tags.append(np.frombuffer(x, "<i8", n, 8 + 8 * n))
        doc, first, more = np.frombuffer(x, "<u4", 3 * m, 8 + 16 * n).reshape(3, m).astype(np.int64)
        held.append((doc + base, first, more, np.frombuffer(x, np.uint8, -1, 8 + 16 * n + 12 * m)))
        base, size = base + n, size + len(x)
        if size >= columnar.PIECE_BYTES:
            settle()
            size = 0
    if held:
        settle()
    return np.concatenate(ids), np.concatenate(tags), np.concatenate(parts)


def _windows(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: the windows that start earlier elsewhere, as spans per document."""
        packed, kinds = table.column("packed").to_pylist(), table.column("kind").to_pylist()
        whole = [x for x, k in zip(packed, kinds) if k == _COMMON]
        cut = [x for x, k in zip(packed, kinds) if k == _PLAIN]
        ids, tags, r = _unpacked(whole, _WINDOW) if whole else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _WINDOW))
        if cut:
            some = _cut_windows(cut, length)
            some[2]["doc"] += len(ids)
            ids, tags, r = (np.concatenate(x) for x in zip((ids, tags, r), some))
        # Most windows are alone with their content and need no order.
        content = np.sort(r["print"])
        r = r[np.isin(r["print"], np.unique(content[1:][content[1:] == content[:-1]]))]
        rank = _rank(ids, tags)[r["doc"]] if len(r) else np.zeros(0, np.int64)
        order = np.lexsort((r["start"], rank, r["print"]))
        r, rank = r[order], rank[order]
        new = np.concatenate([[True], r["print"][1:] != r["print"][:-1]])[: len(r)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else np.zeros(0, np.int64)
        again = (rank != rank[head]) | (r["start"] != r["start"][head])
        doc, start = r["doc"][again].astype(np.int64), r["start"][again].astype(np.int64)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)])[: len(doc)]
        i = np.flatnonzero(edge)
        stop = start[np.append(i[1:], len(doc)) - 1] + length if len(i) else start
        found = _by_document(ids, tags, doc[i], np.stack([start[i], stop], axis=1))
        return pa.table({"id": pa.array(found[0], pa.int64()), "tag": pa.array(found[1], pa.int64()), "spans": pa.array(found[2], pa.binary())})

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal runs of (start, end) rows; runs that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], axis=1)


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: `key`, n_bytes, spans (removed [start, end) byte runs, maximal and sorted) and kept, the
    remaining bytes of the text as UTF-8.

    Earlier means a smaller key, or the same document and an earlier start; strings are judged on the input. A null or empty
    text, or one under `length` bytes, keeps all. Keys are integers; a null key counts as smaller than any other. Repeated
    rows (same key and text) are one document and get equal results; different texts under one key are ordered by a hash of
    the text, which, with 64 bits, is also what tells rows of a null key apart. An empty table gives an empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(int(_NO_ID))).alias("id"), F.xxhash64(body).alias("tag"), body.alias("t")
    )

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t", 4 << 20):
            data, offs = columnar.utf8(block.column("t"))
            found = block_anchors(data, offs, length)
            order = np.lexsort((columnar.mix(found["context"].astype(np.uint64)), found["doc"]))
            doc = found["doc"][order]
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_pydict({"key": pa.array(found["key"][order][nth < SAMPLE_ANCHORS].astype(np.uint64).view(np.int64), pa.int64())})

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = taken.select("t").sample(fraction=share, seed=7).mapInArrow(sampled, "key long").toPandas()["key"].to_numpy(np.int64)  # bounded by the sample
    ranges = spark.sparkContext.broadcast(Ranges(sample.view(np.uint64), buckets))  # a key per bucket

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t", 8 << 20):
            data, offs = columnar.utf8(block.column("t"))
            ids, tags = _ids(block)
            rank = _rank(ids, tags)
            found = block_anchors(data, offs, length)
            doc = found["doc"]
            once = np.zeros(len(ids), bool)
            once[np.unique(rank, return_index=True)[1]] = True  # repeated rows are one document
            keep = once[doc] if len(doc) else np.zeros(0, bool)
            found = {k: v[keep] for k, v in found.items()}
            doc = found["doc"]
            r = np.zeros(len(doc), _ANCHOR)
            r["doc"], r["key"], r["rest"], r["more"] = doc, found["key"], found["rest"], found["more"]
            r["context"] = found["context"]
            r["first"], r["at"] = found["first"] - offs[doc], found["at"] - found["first"]
            bucket, common = ranges.value.deal(found["key"].astype(np.uint64), found["context"].astype(np.uint64))
            r["kind"] = np.where(common, _COMMON, _PLAIN)
            same = columnar.mix(columnar.mix(found["key"].astype(np.uint64)) + found["rest"].astype(np.uint64) * np.uint64(3) + found["context"].astype(np.uint64))
            order = np.lexsort((r["first"], rank[doc], same))
            again = np.zeros(len(doc), bool)
            again[order[1:]] = same[order][1:] == same[order][:-1]
            r["kind"][again] = _REPEAT
            bucket = np.where(again, columnar.mix(ids[doc].astype(np.uint64) ^ columnar.mix(tags[doc].astype(np.uint64))) % np.uint64(buckets), bucket.astype(np.uint64)).astype(np.int64)
            rows = list(_packed(bucket, r, ids, tags))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in rows], pa.int32()), "packed": pa.array([x[1] for x in rows], pa.binary())})

    judged = taken.mapInArrow(dealt, "bucket int, packed binary").groupBy("bucket").applyInArrow(_sorted(length), "id long, tag long, spans binary, open binary")
    marks = stored(judged.groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"), F.collect_list("open").alias("open")))  # of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t", 2 << 20):
            data, offs = columnar.utf8(block.column("t"))
            ids, tags = _ids(block)
            lists = [np.frombuffer(b"".join(x), "<u4").reshape(-1, 4) for x in block.column("open").to_pylist()]
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
            first, at, more, kind = np.concatenate(lists).astype(np.int64).T
            place = first + offs[doc]
            out: dict[str, list] = {"bucket": [], "kind": [], "packed": []}
            common = kind == _COMMON
            each = np.repeat(np.flatnonzero(common), more[common] + 1)
            j = np.arange(len(each)) - np.repeat(np.cumsum(more[common] + 1) - (more[common] + 1), more[common] + 1)
            r = np.zeros(len(each), _WINDOW)
            r["doc"], r["start"] = doc[each], first[each] + j
            if len(each):
                r["print"] = columnar.fingerprints(columnar.running(data), place[each] + j, place[each] + j + length)
            for b, packed in _packed((r["print"] % np.uint64(buckets)).astype(np.int64), r, ids, tags):
                out["bucket"].append(b), out["kind"].append(_COMMON), out["packed"].append(packed)
            doc, first, at, more, place = (x[~common] for x in (doc, first, at, more, place))
            lead = np.zeros(len(doc), np.uint64)
            for k in range(6):
                lead = (lead << np.uint64(8)) | data[place + at + k].astype(np.uint64)
            grams = columnar.fingerprints(columnar.running(data), place + at, place + at + GRAM) if len(doc) else lead
            bucket, _ = ranges.value.deal((lead << np.uint64(16)) | (grams >> np.uint64(48)), lead)
            order = np.argsort(bucket, kind="stable")
            names = np.unique(bucket)
            for b, x, y in zip(names.tolist(), np.searchsorted(bucket[order], names).tolist(), np.searchsorted(bucket[order], names, "right").tolist()):
                i = order[x:y]
                some, number = np.unique(doc[i], return_inverse=True)
                sizes = more[i] + length
                steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out["bucket"].append(b), out["kind"].append(_PLAIN), out["packed"].append(b"".join([
                    np.array([len(some), len(i)], "<u4").tobytes(), ids[some].astype("<i8").tobytes(), tags[some].astype("<i8").tobytes(),
                    np.stack([number, first[i], more[i]]).astype("<u4").tobytes(), data[np.repeat(place[i], sizes) + steps].tobytes(),
                ]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), (pa.int32(), pa.int32(), pa.binary()))], list(out))

    unsettled = marks.filter(F.size("open") > 0).select("id", "tag", "open")
    cuts = taken.join(unsettled, ["id", "tag"]).select("id", "tag", "t", "open").mapInArrow(cut, "bucket int, kind int, packed binary")
    more = cuts.groupBy("bucket").applyInArrow(_windows(length), "id long, tag long, spans binary")
    spans = marks.select("id", "tag", F.explode("spans").alias("spans")).unionByName(more).groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))

    def taken_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for block in columnar.blocks(batches, "t", 8 << 20):
            data, offs = columnar.utf8(block.column("t"))
            runs, kept = [], []
            for i, x in enumerate(block.column("spans").to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                found = merged(np.frombuffer(b"".join(x or []), "<u4").reshape(-1, 2).astype(np.int64))
                keep = np.ones(len(own), bool)
                for a, b in found.tolist():
                    keep[a:b] = False
                runs.append([{"start": a, "end": b} for a, b in found.tolist()])
                kept.append(own[keep].tobytes() if len(found) else own.tobytes())
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(np.diff(offs), pa.int64()), pa.array(runs, run), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    whole = taken.join(spans, ["id", "tag"], "left").select("id", "t", "spans").mapInArrow(taken_out, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return whole.select(F.when(F.col("id") != int(_NO_ID), F.col("id")).cast(docs.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
b AS (SELECT DISTINCT doc_id, unnest(range(s, s + {LENGTH})) AS p FROM r),
e AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b),
g AS (SELECT doc_id, g, min(p) AS a, max(p) + 1 AS z FROM e GROUP BY doc_id, g),
k AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM g GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda i:
    substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END, (CASE WHEN i = n_spans THEN length(h) // 2 ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ends[i] END) * 2)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
