"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams in falling order. A document gets such a list too, and its
distance to a language is the sum, over the document's n-grams, of how far each stands out of place in the profile; an
n-gram the profile lacks costs the profile's length. N-grams are one to three letters, a letter being a-z or a byte of a
multi-byte character, with every run of other bytes as one gap. There are fewer than 155^3 + 155^2 + 155 of them, which
bounds the counts of a task and the profiles alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import stored, text_batches

PROFILE = 300
#: Languages whose profiles a task holds at once; more are compared block by block.
LANGUAGES = 2_000
UNKNOWN = "und"

_BASE = 155  # the gap, 26 letters, 128 bytes of multi-byte characters
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)
_PIECE = 1 << 20
_KEYS = _BASE + _BASE**2 + _BASE**3


def _grams(letters: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of one text's letters; 0 is a gap, runs of gaps count as one, and the ends are gaps."""
    kept = letters[(letters > 0) | (np.concatenate([np.zeros(1, np.uint32), letters[:-1]]) > 0)]
    if not len(kept):
        return kept
    x = np.concatenate([np.zeros(1, np.uint32), kept, np.zeros(1 if kept[-1] else 0, np.uint32)])
    two = x[:-1] * _BASE + x[1:]
    three = two[:-1] * _BASE + x[2:]
    return np.concatenate([x[x > 0], two + _BASE, three + (_BASE + _BASE**2)])


def _counted(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts; a very long text is counted piece by piece."""
    if len(letters) > _PIECE:
        total = np.zeros(_KEYS, np.int64)
        for i in range(0, len(letters), _PIECE):
            total += np.bincount(_grams(letters[i : i + _PIECE]), minlength=_KEYS)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    keys = np.sort(_grams(letters))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first].astype(np.int64), np.diff(np.append(first, len(keys)))


def _top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent keys, ties to the smaller key."""
    order = (counts.astype(np.int64) << 24) + (_KEYS - keys)
    if len(order) > n:
        keep = np.argpartition(order, len(order) - n)[len(order) - n :]
        keys, order = keys[keep], order[keep]
    return keys[np.argsort(-order)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The rows of `profiles` on the driver, for a column that is known to name few languages."""
    rows = profiles(docs, text, lang, size).collect()
    return {r["lang"]: r["grams"] for r in sorted(rows, key=lambda r: r["lang"])}


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """One row per language of docs: lang, grams (keys of n-grams from the most frequent on, ties to the smaller key).

    Counts cover every text; rows without a language teach nothing, an empty table gives no row, and a language without a
    letter in any text has none either. N-grams are summed per block of text before they are shuffled.
    """
    text_batches(docs.sparkSession)
    taken = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t"):
            data, offs = columnar.utf8(block.column("t"))
            letters = _LETTER[data]
            names = np.array(block.column("l").to_pylist(), dtype=object)
            for name in sorted(set(names)):
                total = np.zeros(_KEYS, np.int64)
                for i in np.flatnonzero(names == name):
                    keys, counts = _counted(letters[offs[i] : offs[i + 1]])
                    total[keys] += counts
                keys = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(keys), pa.string()), "gram": keys, "n": total[keys]})

    sums = taken.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"])  # `size` entries each
    return ranked.groupBy(F.col("l").alias("lang")).agg(listed.alias("grams"))


class _Profiles:
    """Profiles of a block of languages by n-gram: which languages have it, and in which place."""

    def __init__(self, given: dict[str, list[int]], size: int):
        self.names, self.size = sorted(given), size
        grams = np.concatenate([np.asarray(given[x], np.int64) for x in self.names] or [np.zeros(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.language = np.repeat(np.arange(len(self.names)), [len(given[x]) for x in self.names])[order]
        self.place = np.concatenate([np.arange(len(given[x])) for x in self.names] or [np.zeros(0, np.int64)])[order]

    def nearest(self, top: np.ndarray) -> tuple[int, str]:
        """The smallest distance of a document's n-grams and its language, of equal ones the first."""
        at = np.searchsorted(self.grams, top)
        mine = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == top) if len(self.grams) else np.zeros(0, np.int64)
        first, n = self.starts[at[mine]], self.starts[at[mine] + 1] - self.starts[at[mine]]
        entries = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        near = self.size - np.abs(self.place[entries] - np.repeat(mine, n))
        away = self.size * len(top) - np.bincount(self.language[entries], near, len(self.names))
        best = int(np.argmin(away))
        return int(away[best]), self.names[best]


def _blocks(given: dict[str, list[int]] | DataFrame) -> Iterator[dict[str, list[int]]]:
    """The profiles in blocks of about LANGUAGES; one block at a time is on the driver."""
    if isinstance(given, dict):
        names = sorted(given)
        yield from ({x: given[x] for x in names[i : i + LANGUAGES]} for i in range(0, len(names), LANGUAGES))
        return
    given = stored(given)
    parts = -(-given.count() // LANGUAGES)
    for i in range(parts):
        yield {r["lang"]: r["grams"] for r in given.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == i).collect()}


def predict(docs: DataFrame, profiles: dict[str, list[int]] | DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """One row per row of docs: the columns `keep`, lang_pred and score.

    score is 1 minus the distance as a share of the largest possible one, between 0 and 1. Equal distances go to the
    language that sorts first. A text that is null or has no letter, and every text when there is no profile, is `und` with
    score 0. Only the text is read: other columns, whatever their names, and repeated rows make no difference. A very long
    text is counted piece by piece. Any number of languages is compared: the first block of profiles meets the texts, each
    further one the n-grams kept of them.
    """
    text_batches(docs.sparkSession)
    source = F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.when(source.rlike(r"\p{L}"), F.lower(source)).otherwise("").alias("t"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(taken.schema.fields[:-1]))
    schema = f"{kinds}, top array<bigint>, best string, away bigint, n bigint"
    names = [*[f"k{i}" for i in range(len(keep))], "top", "best", "away", "n"]

    def judged(block: pa.RecordBatch, tops: list[np.ndarray], before: list[tuple[int, str] | None], held: _Profiles, more: bool) -> pa.RecordBatch:
        found = []
        for top, old in zip(tops, before):
            new = held.nearest(top) if len(top) and held.names else None
            found.append(min(x for x in (old, new) if x) if old or new else None)
        arrays = [
            pa.array(tops if more else [None] * len(tops), pa.list_(pa.int64())), pa.array([x and x[1] for x in found], pa.string()),
            pa.array([x and x[0] for x in found], pa.int64()), pa.array([len(t) for t in tops], pa.int64()),
        ]
        first = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (block.column(i) for i in range(len(keep)))]
        return pa.RecordBatch.from_arrays([*first, *arrays], names)

    def counted(block: pa.RecordBatch, held: _Profiles, more: bool) -> pa.RecordBatch:
        data, offs = columnar.utf8(block.column("t"))
        letters = _LETTER[data]
        tops = [_top(*_counted(letters[a:b]), size) if a < b else np.zeros(0, np.int64) for a, b in zip(offs[:-1], offs[1:])]
        return judged(block, tops, [None] * len(tops), held, more)

    def first_pass(shared, more: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in columnar.blocks(batches, "t", 4 << 20):
                yield counted(block, shared.value, more)

        return run

    def next_pass(shared, more: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tops = [np.asarray(t, np.int64) for t in batch.column("top").to_pylist()]
                before = [None if b is None else (a, b) for a, b in zip(batch.column("away").to_pylist(), batch.column("best").to_pylist())]
                yield judged(batch, tops, before, shared.value, more)

        return run

    rows, spark, blocks = None, docs.sparkSession, _blocks(profiles)
    given = next(blocks, None)
    while given is not None:
        shared = spark.sparkContext.broadcast(_Profiles(given, size))  # at most `size` n-grams for each of about LANGUAGES languages
        given = next(blocks, None)
        more = given is not None
        rows = taken.mapInArrow(first_pass(shared, more), schema) if rows is None else stored(rows).mapInArrow(next_pass(shared, more), schema)
    if rows is None:
        rows = taken.select(*names[: len(keep)], F.lit(None).cast("string").alias("best"), F.lit(0).alias("away"), F.lit(0).alias("n"))
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(1 - F.col("away") / (F.lit(size) * F.col("n"))).alias("score"),
    )


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
