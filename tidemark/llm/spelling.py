"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted in one pass over the documents and summed; the vocabulary is a stored table.
2. The gram dictionary holds every gram of 2 to `LONGEST` letters that more than a share of the words have; its size is bounded
   by that share. A word, between two end marks, is cut into variable grams: at each place the shortest gram that is not in
   the dictionary, at most `reach` letters, without those that lie inside an earlier one.
3. One edit at a place touches only grams that end within the next `reach` letters, so the most ends in any such window bound
   the affected grams of a word. Two words one edit apart share a gram among the rarest (bound + 1) of each. `reach` is at
   most half a word, which always leaves the first or the last gram untouched, so no pair is missed.
4. Words are listed under these rarest grams. A list is merged by forms: two words of a list are near if they agree with one
   letter taken out of both at one place, or of the longer one. The words themselves are compared last. Short lists are packed
   into buckets of a task each; the forms of a list longer than `list_rows` are shuffled, where equal forms are few.

Forms of words are chained by pointer doubling, in a logarithmic number of joins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import small_side, stored, text_batches

SHORTEST, LONGEST = 2, 6
#: A gram is in the dictionary if more than one in so many words has it, and more than COMMON_LEAST.
COMMON_SHARE, COMMON_LEAST = 4_096, 32
BUCKET_ROWS = 100_000
LIST_ROWS = 30_000
WORDS_HELD = 300_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # a-z and U+00C0 to U+00FF in UTF-8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 5, least_count: int = 3, typos: int | None = None) -> DataFrame:
    """word and n, its occurrences: runs of A-Z, a-z and U+00C0 to U+00FF in the whole texts, with A-Z in lower case.

    Words of less than `least_length` code points or `least_count` occurrences are left out. With `typos`, misspellings are
    put in: where that number divides crc32("<key>:<run>"), the run loses its code point at crc32 modulo its length. A null
    text has no words, a null key counts as empty text. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    taken = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, body in zip(batch.column("k").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist()):
                body = body.lower()  # of bytes: A-Z only
                found = Counter(_RUN.findall(body) if len(body) < 1 << 20 else (m.group() for m in _RUN.finditer(body)))
                seed = zlib.crc32(f"{name}:".encode())
                for word, n in found.items():
                    if typos and zlib.crc32(word, seed) % typos == 0:
                        letters = word.decode()
                        at = zlib.crc32(word, seed) % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") >= least_length:
                        held[word] += n
                if len(held) > WORDS_HELD:
                    yield flush()
        if held:
            yield flush()

    return taken.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Letters:
    """Words as code points between end marks, and running sums that give the fingerprint of any range."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64) + 2
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.zeros(int(self.lengths.sum()), np.uint32)
        inner = np.ones(len(self.data), bool)
        inner[self.starts], inner[self.ends - 1] = False, False
        self.data[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.data[self.starts], self.data[self.ends - 1] = 0x110000, 0x110001
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(columnar.mix((self.data.astype(np.uint64) + np.uint64(1)) * _ODD) * columnar.powers(columnar._ODD, len(self.data)), out=self.sums[1:])
        self.owner = np.repeat(np.arange(len(words)), self.lengths)

    def prints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return columnar.fingerprints(self.sums, starts, ends)

    def without(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Fingerprints of words with the letter at `place` taken out."""
        inverse = columnar.powers(columnar._INVERSE, len(self.sums) + 1)
        s, e = self.starts[word], self.ends[word]
        raw = (self.sums[place] - self.sums[s]) * inverse[s] + (self.sums[e] - self.sums[place + 1]) * inverse[s + 1]
        return columnar.mix(raw + (e - s - 1).astype(np.uint64) * _ODD)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of so many letters that begin at a and b are equal."""
        total = np.cumsum(length)
        step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - length, length)
        differ = self.data[np.repeat(a, length) + step] != self.data[np.repeat(b, length) + step]
        return np.bincount(np.repeat(np.arange(len(a)), length)[differ], minlength=len(a)) == 0


def reach_of(length: np.ndarray) -> np.ndarray:
    """The longest gram where the longer word of a pair has so many letters: at most half of the shorter, marks included."""
    return np.clip((length + 1) // 2, SHORTEST, LONGEST)


def decompose(letters: Letters, which: np.ndarray, reach: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, start and end of every variable gram of the words `which`; `common` are the dictionary's fingerprints, sorted."""
    at = np.flatnonzero(np.isin(letters.owner, which))
    stop = letters.ends[letters.owner[at]]
    inside = at + SHORTEST <= stop
    at, stop = at[inside], stop[inside]
    end = at + SHORTEST
    open_ = np.arange(len(at))
    for size in range(SHORTEST, reach):
        open_ = open_[end[open_] < stop[open_]]
        found = letters.prints(at[open_], at[open_] + size)
        place = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
        open_ = open_[common[place] == found] if len(common) else open_[:0]
        end[open_] += 1
    # Positions grow with the words, so one running maximum serves all: an earlier word's ends never pass a later start.
    before = np.maximum.accumulate(end) if len(end) else end
    kept = np.ones(len(end), bool)
    kept[1:] = end[1:] > before[:-1]
    return letters.owner[at[kept]], at[kept], end[kept]


def rarest(letters: Letters, word: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and fingerprint of the grams a word is listed under: one more than a single edit can affect, the rarest first."""
    place = np.arange(len(end))
    window = place - np.searchsorted(end, end - reach, "right") + 1
    # Ends of the word before may lie in the window; a word's own are those from its first gram on.
    first = np.searchsorted(word, word)
    window = np.minimum(window, place - first + 1)
    affected = np.zeros(int(word.max()) + 1 if len(word) else 0, np.int64)
    np.maximum.at(affected, word, window)
    found = letters.prints(start, end)
    spot = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
    weight = np.where(common[spot] == found, often[spot], 0) if len(common) else np.zeros(len(found), np.int64)
    order = np.lexsort((start, found, weight, word))
    rank = place - np.searchsorted(word[order], word[order])
    listed = order[rank <= affected[word[order]]]
    once = np.sort(listed[np.unique(np.stack([word[listed].astype(np.uint64), found[listed]]), axis=1, return_index=True)[1]])
    return word[once], found[once]


def _pairs(letters: Letters, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words one edit apart among (key, word) rows with equal keys; each pair once, in no order."""
    size = letters.lengths[word] - 2
    row = np.repeat(np.arange(len(word)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + letters.starts[word[row]] + 1
    form = letters.without(word[row], place)
    a, b = [], []
    # One letter replaced: equal keys, places and forms.
    spot = (place - letters.starts[word[row]]).astype(np.uint64)
    group = columnar.fold([key[row], form, spot])
    order = np.argsort(group, kind="stable")
    step = 1
    open_ = np.arange(len(order) - 1)
    while len(open_):
        open_ = open_[open_ + step < len(order)]
        open_ = open_[group[order[open_]] == group[order[open_ + step]]]
        x, y = order[open_], order[open_ + step]
        u, v, p, q = word[row[x]], word[row[y]], place[x], place[y]
        good = (letters.lengths[u] == letters.lengths[v]) & (u != v) & (p - letters.starts[u] == q - letters.starts[v])
        u, v, p, q = u[good], v[good], p[good], q[good]
        good = letters.equal(letters.starts[u], letters.starts[v], p - letters.starts[u]) & letters.equal(p + 1, q + 1, letters.ends[u] - p - 1)
        a.append(u[good]), b.append(v[good])
        step += 1
    # One letter more: the longer word's form is the shorter word.
    whole = columnar.fold([key, letters.prints(letters.starts[word], letters.ends[word])])
    order = np.argsort(whole, kind="stable")
    taken = columnar.fold([key[row], form])
    low, high = np.searchsorted(whole[order], taken, "left"), np.searchsorted(whole[order], taken, "right")
    hit = np.flatnonzero(high > low)
    u, v, p = word[row[hit]], word[order[low[hit]]], place[hit]
    good = letters.lengths[u] == letters.lengths[v] + 1
    u, v, p = u[good], v[good], p[good]
    before = p - letters.starts[u]
    good = letters.equal(letters.starts[u], letters.starts[v], before) & letters.equal(p + 1, letters.starts[v] + before, letters.ends[u] - p - 1)
    a.append(u[good]), b.append(v[good])
    return _distinct(np.concatenate(a), np.concatenate(b))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))
    return pair >> 32, pair & ((1 << 32) - 1)


def dictionary(vocabulary: DataFrame, n_words: int, share: int = COMMON_SHARE, least: int = COMMON_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, sorted, and word counts of the grams that more than n_words / share words, and more than `least`, have.

    Grams are counted per task before the shuffle. As each word of c letters has fewer than 5 c + 5 grams, at most
    share * (5 c + 5) reach the driver, c being the mean length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column("word").to_pylist())
            found = []
            for size in range(SHORTEST, LONGEST + 1):
                at = np.flatnonzero(np.arange(len(letters.data)) + size <= letters.ends[letters.owner])
                gram = letters.prints(at, at + size)
                order = np.lexsort((gram, letters.owner[at]))
                new = np.ones(len(order), bool)
                new[1:] = (gram[order[1:]] != gram[order[:-1]]) | (letters.owner[at[order[1:]]] != letters.owner[at[order[:-1]]])
                found.append(gram[order[new]])
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

    most = max(least, n_words // share)
    rows = vocabulary.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > most).collect()
    grams, n = np.array([r["gram"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(grams)
    return grams[order], n[order]


def _listed(vocabulary: DataFrame, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """gram, word, n: every word under its rarest grams, for the lengths that the longer word of a pair may have."""
    shared = vocabulary.sparkSession.sparkContext.broadcast((common, often))  # bounded, see dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            letters = Letters(batch.column("word").to_pylist())
            size = letters.lengths - 2
            own, more = reach_of(size), reach_of(size + 1)
            for reach in range(SHORTEST, LONGEST + 1):
                which = np.flatnonzero((own == reach) | (more == reach))
                if not len(which):
                    continue
                word, gram = rarest(letters, *decompose(letters, which, reach, known), reach, known, counts)
                at = pa.array(word)
                names = columnar.mix(gram + np.uint64(reach * int(_ODD) % (1 << 64)))
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), batch.column("word").take(at), batch.column("n").take(at)], ["gram", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "gram long, word string, n long")


def _both_ways(a: np.ndarray, b: np.ndarray, words: pa.Array, n: pa.Array) -> pa.RecordBatch:
    one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    return pa.RecordBatch.from_arrays([words.take(one), words.take(two), n.take(two)], ["word", "near", "near_n"])


def near_words(vocabulary: DataFrame, bucket_rows: int = BUCKET_ROWS, list_rows: int = LIST_ROWS, share: int = COMMON_SHARE, least: int = COMMON_LEAST) -> DataFrame:
    """word, near, near_n: every ordered pair of different words one inserted, deleted or replaced code point apart.

    vocabulary is a stored table of distinct words of at least three code points and their counts n. A pair may come more than
    once, in one place of the cluster each. An empty vocabulary gives an empty result.
    """
    kind = "word string, near string, near_n long"
    common, often = dictionary(vocabulary, vocabulary.count(), share, least)
    listed = stored(_listed(vocabulary, common, often))
    buckets = -(-listed.count() // bucket_rows) or 1
    long = small_side(stored(listed.groupBy("gram").count().filter(F.col("count") > list_rows).select("gram")), 8)

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        words = table.column("word").combine_chunks().dictionary_encode()
        letters, word = Letters(words.dictionary.to_pylist()), words.indices.to_numpy().astype(np.int64)
        n = np.zeros(len(words.dictionary), np.int64)
        n[word] = table.column("n").to_numpy()
        return pa.Table.from_batches([_both_ways(*_pairs(letters, table.column("gram").to_numpy().view(np.uint64), word), words.dictionary, pa.array(n))])

    short = listed.join(long, "gram", "left_anti").withColumn("_bucket", F.pmod("gram", F.lit(buckets)))
    found = short.groupBy("_bucket").applyInArrow(merge, kind)
    if not long.isEmpty():
        found = found.unionByName(_merged_by_forms(listed.join(long, "gram", "left_semi")))
    return found


def _merged_by_forms(rows: DataFrame) -> DataFrame:
    """The pairs of long lists. Words travel as fingerprints under each of their forms; how many share one the alphabet bounds."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column("word").to_pylist())
            marks = np.zeros(len(letters.data), bool)
            marks[letters.starts], marks[letters.ends - 1] = True, True
            place = np.flatnonzero(~marks)
            word = letters.owner[place]
            own, form = letters.prints(letters.starts, letters.ends), letters.without(word, place)
            replaced = columnar.fold([form, (place - letters.starts[word]).astype(np.uint64)])
            for kind, forms, ids in (("replaced", replaced, own[word]), ("less", form, own[word]), ("whole", own, own)):
                for a in range(0, len(forms), 100_000):
                    some = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(forms[some])), pa.array(forms[some].view(np.int64)), pa.array(ids[some].view(np.int64))], ["kind", "form", "id"])

    words = stored(rows.select("word", "n").distinct())
    forms = stored(words.mapInArrow(spread, "kind string, form long, id long").distinct())
    of = lambda kind, name: forms.filter(F.col("kind") == kind).select("form", F.col("id").alias(name))
    pairs = of("replaced", "a").join(of("replaced", "b"), "form").filter("a < b").unionByName(of("less", "a").join(of("whole", "b"), "form")).select("a", "b").distinct()
    named = words.mapInArrow(_identified, "id long, word string, n long")
    one, two = named.toDF("a", "word", "n"), named.toDF("b", "near", "near_n")
    found = pairs.join(one, "a").join(two, "b").filter(F.levenshtein("word", "near", 1) == 1)
    return found.select("word", "near", "near_n").unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = Letters(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(letters.prints(letters.starts, letters.ends).view(np.int64)), batch.column("word"), batch.column("n")], ["id", "word", "n"])


def variants(vocabulary: DataFrame, factor: int = 2, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words of at least three code points and their counts n.

    A word's form is its near word of the largest n, ties to the smallest in code-point order, where that n is at least
    `factor` (2 or more) times its own; its root is where following the forms ends. Words without near words have themselves
    as root, 0 near words and a null form and form_n. An empty vocabulary gives an empty result.
    """
    vocabulary = stored(vocabulary.select("word", "n"))
    near = near_words(vocabulary, **limits).repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    takes = F.col("near_n") >= factor * F.col("n")
    whole = stored(joined.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")))
    return whole.join(_roots(whole), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(whole: DataFrame) -> DataFrame:
    """word and root for the words with a form; as a form's n is at least twice the word's, there are no circles."""
    chain = stored(whole.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not chain.filter("moved").isEmpty():
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = stored(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return chain.select("word", "root")
