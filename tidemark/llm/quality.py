"""Quality classifier: a label model over overlapping heuristic labellers, and a hashed linear scorer taught by it.

1. Every document gets a vote of each labeller, 0 or 1 or none, in one pass; annotations, where a table of them is given,
   vote too. Only counts of vote patterns reach the driver, at most 3^8 of them.
2. Expectation-maximisation over those counts estimates how often each labeller says 1 for clean, junk and toxic documents,
   and so the probability of each class given a pattern. No labeller is taken for the truth.
3. A softmax over hashed features learns these probabilities from at most `fit_rows` documents: those annotated, or any
   where there is no annotation, in the order of a hash of the id; one row an id. Which features mark a class is decided from
   sums over these documents; of them only the `fit_features` that mark one best, and which documents have them, reach the
   driver, so its memory is bounded however long the documents are.
4. The scorer rates every whole document in one narrow pass, in which only these features are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import stored, text_batches

FIT_ROWS = 12_000
FIT_FEATURES = 4_096
BITS = 20
SIGMAS, LIFT = 4.0, 3.0
CLASSES = ("clean", "junk", "toxic")
LABELLERS = ("repeats", "symbols", "capitals", "shouts", "menus", "insults", "annotated_low", "annotated_toxic")

# Insults that the labeller `insults` looks for, as whole words.
INSULTS = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless")

#: Share of words that repeat the one before, of symbol bytes, of capitals among letters, of "!!" and of "|" per word.
LIMITS = (0.2, 0.03, 0.5, 0.2, 0.1)
_BINS = (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.8)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|@^~+=<>")] = True
_APART_BY = 0x9E3779B97F4A7C15  # sets kinds of features apart
_APART = columnar.byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _insult_prints() -> np.ndarray:
    data = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in INSULTS])
    return np.sort(columnar.fingerprints(columnar.running(data), np.concatenate([[0], ends[:-1]]), ends))


def measure(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, the five shares of LIMITS, and insults; and hashed features as (text, feature) pairs.

    A table `wanted` of 2^BITS truth values names the features to keep; an empty one leaves them all out.

    Features are whole words, the first 4 and 5 letters of longer words, every 1 to 3 neighbouring multi-byte characters, as
    a run of these may be a sentence in a script without spaces, and the bins of the shares.
    """
    n = len(offs) - 1
    per = lambda rows, weights=None: np.bincount(rows, weights, minlength=n)[:n]
    lower = columnar.LOWER[data]
    owner = np.repeat(np.arange(n), np.diff(offs))
    s, e, d = columnar.word_spans(data, offs, columnar.WHITE_SPACE)
    sums = columnar.running(lower)
    whole = columnar.fingerprints(sums, s, e)
    words = per(d)
    some = np.maximum(words, 1)
    again = np.zeros(len(s), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (d[1:] == d[:-1])
    capital = (data >= 65) & (data <= 90)
    letter = (lower >= 97) & (lower <= 122)
    bang = np.zeros(len(data), bool)
    bang[:-1] = (data[:-1] == 33) & (data[1:] == 33)
    shares = np.stack([
        per(d, again) / some, per(owner, _SYMBOL[data]) / np.maximum(np.diff(offs), 1), per(owner, capital) / np.maximum(per(owner, letter), 20),
        per(owner, bang) / some, per(d[(e - s == 1) & (data[s] == 124)]) / some,
    ])
    s, e, d = columnar.word_spans(lower, offs, _APART)
    insults = per(d[np.isin(columnar.fingerprints(sums, s, e), _insult_prints())])
    if wanted is not None and not len(wanted):
        return words, shares, insults, np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)

    def hashed(d: np.ndarray, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        feature = (columnar.fingerprints(sums, s, e) + np.uint64(kind * _APART_BY & 0xFFFFFFFFFFFFFFFF)) >> shift
        if wanted is not None:
            some = np.flatnonzero(wanted[feature])
            d, feature = d[some], feature[some]
        return (d.astype(np.uint64) << np.uint64(BITS)) | feature

    found = [hashed(d, s, e, 0)]
    first = (lower & 0xC0) != 0x80  # bytes that begin a character
    marks = np.append(np.flatnonzero(first), len(lower))
    at = (np.cumsum(first) - 1)[s]
    for k in (4, 5):
        cut = marks[np.minimum(at + k, len(marks) - 1)]
        longer = cut < e
        found.append(hashed(d[longer], s[longer], cut[longer], k))
    wide = np.flatnonzero(lower[marks[:-1]] >= 0x80)
    text = owner[marks[wide]]
    for k in (1, 2, 3):
        run = np.flatnonzero((wide[k - 1 :] - wide[: len(wide) - k + 1] == k - 1) & (text[k - 1 :] == text[: len(wide) - k + 1]))
        found.append(hashed(text[run], marks[wide[run]], marks[wide[run] + k], 10 + k))
    bins = np.digitize(shares, _BINS)
    shape = columnar.mix((np.arange(5)[:, None] * 64 + bins + 1_000_003).astype(np.uint64)) >> shift
    pairs = (np.arange(n, dtype=np.uint64)[None, :] << np.uint64(BITS)) | shape
    found.append(pairs[wanted[shape]] if wanted is not None else pairs.ravel())
    return words, shares, insults, np.unique(np.concatenate(found))


def votes(words: np.ndarray, shares: np.ndarray, insults: np.ndarray) -> list[str]:
    """One sign per heuristic labeller, "-" where it abstains: texts of less than three words have no shape to judge."""
    said = np.concatenate([shares > np.array(LIMITS)[:, None], (insults > 0)[None, :]]).astype(int)
    return ["".join("-" if w < 3 and k < 5 else str(x) for k, x in enumerate(col)) for w, col in zip(words.tolist(), said.T.tolist())]


def label_model(patterns: dict[str, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over counts of vote patterns: class shares, and per class and labeller the probability of voting 1.

    The start says which class each labeller is meant for; pseudo-counts keep rare classes and unused labellers finite.
    """
    start = np.full((3, len(LABELLERS)), 0.02)
    start[1, :5], start[2, 5], start[1, 6], start[2, 7] = 0.3, 0.4, 0.9, 0.9
    share, says = np.array([0.8, 0.1, 0.1]), start.copy()
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    ones = np.array([[c == "1" for c in k] for k in keys], float).reshape(len(keys), len(LABELLERS))
    seen = np.array([[c != "-" for c in k] for k in keys], float).reshape(len(keys), len(LABELLERS))
    for _ in range(rounds):
        weight = posterior(ones, seen, share, says) * counts[:, None]
        share = (weight.sum(axis=0) + 1) / (counts.sum() + 3)
        says = (weight.T @ ones + 10 * start) / (weight.T @ seen + 10)
    return share, says


def posterior(ones: np.ndarray, seen: np.ndarray, share: np.ndarray, says: np.ndarray) -> np.ndarray:
    logs = np.log(share) + ones @ np.log(says).T + (seen - ones) @ np.log1p(-says).T
    logs -= logs.max(axis=1, keepdims=True, initial=-np.inf) if len(logs) else 0
    odds = np.exp(logs)
    return odds / odds.sum(axis=1, keepdims=True)


def telling(sums: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Which rows of `sums` (per feature its documents, and the sums of their class probabilities) mark a class: places.

    A class must be found among a feature's documents `LIFT` times as often as among all, and more often than chance allows
    by `SIGMAS` standard deviations; frequent words that only lean a little one way would add up to noise. Of more than
    `most` features those stay that exceed chance by the most standard deviations.
    """
    total = sums[:, :1]
    expected = total * share
    excess = (sums[:, 1:] - expected) / np.sqrt(np.maximum(expected * (1 - share), 0.25))
    marks = (excess > SIGMAS) & (sums[:, 1:] > LIFT * expected) & (total > 1)
    best = np.where(marks, excess, 0).max(axis=1, initial=0)
    order = np.argsort(-best, kind="stable")[:most]
    return np.sort(order[best[order] > 0])


class Scorer:
    """Softmax weights (3, features) and biases of the features `names`."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias

    def rate(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Class probabilities (3, texts)."""
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.names] = True
        pairs = measure(data, offs, wanted)[3]
        row = (pairs >> np.uint64(BITS)).astype(np.int64)
        at = np.searchsorted(self.names, (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64))
        logits = np.stack([np.bincount(row, w[at], minlength=len(offs) - 1) + b for w, b in zip(self.weights, self.bias)])
        odds = np.exp(logits - logits.max(axis=0))
        return odds / odds.sum(axis=0)


def fit(names: np.ndarray, rows: list[np.ndarray], target: np.ndarray, steps: int = 150, rate: float = 0.3, shrink: float = 2e-5) -> Scorer:
    """A scorer by gradient steps with per-weight rates; rows hold the features of each document, all of them in `names`."""
    if not rows:
        return Scorer(names[:0], np.zeros((3, 0)), np.array([1.0, 0.0, 0.0]))
    at = np.searchsorted(names, np.concatenate(rows).astype(np.int64))
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    w, bias, past, past_b = np.zeros((3, len(names))), np.zeros(3), np.full((3, len(names)), 1e-8), np.full(3, 1e-8)
    scale = 1.0 / len(rows)
    for _ in range(steps):
        logits = np.stack([np.bincount(row, w[c][at], minlength=len(rows)) + bias[c] for c in range(3)], axis=1)
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        error = (p / p.sum(axis=1, keepdims=True) - target) * scale
        grad = np.stack([np.bincount(at, error[row, c], minlength=len(names)) for c in range(3)]) + shrink * w
        past += grad**2
        past_b += error.sum(axis=0) ** 2
        w -= rate * grad / np.sqrt(past)
        bias -= rate * error.sum(axis=0) / np.sqrt(past_b)
    return Scorer(names, w, bias)


def _measured(docs: DataFrame, text: str, key: str, with_features: bool) -> DataFrame:
    text_batches(docs.sparkSession)
    taken = docs.select(F.col(key).alias("k0"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columnar.blocks(batches, "t", 1 << 20):
            data, offs = columnar.utf8(block.column("t"))
            words, shares, insults, pairs = measure(data, offs, None if with_features else np.zeros(0, bool))
            arrays = [block.column("k0").combine_chunks(), pa.array(votes(words, shares, insults), pa.string())]
            if with_features:
                edges = np.searchsorted(pairs >> np.uint64(BITS), np.arange(len(offs), dtype=np.uint64))
                own = (pairs & np.uint64((1 << BITS) - 1)).astype("<u4")
                arrays.append(pa.array([own[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["k0", "votes", *["features"] * with_features])

    return taken.mapInArrow(run, f"k0 {taken.schema['k0'].dataType.simpleString()}, votes string" + ", features binary" * with_features)


def train(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Scorer:
    """The scorer. labels (key, quality 0/1, toxic 0/1) may cover some documents, with repeats and nulls.

    Null texts vote like texts without words, documents without a key vote but don't teach, and of different texts under one
    key the one with the smallest hash teaches. Very long texts are read whole. Empty tables give a scorer that rejects nothing.
    """
    empty = docs.select(F.col(key).alias("k0"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("x")).limit(0)
    notes = empty if labels is None else labels.select(F.col(key).alias("k0"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x"))
    notes = notes.filter("k0 is not null").groupBy("k0").agg(F.min("q").alias("q"), F.max("x").alias("x"))
    vote = lambda c, yes: F.when(F.col(c).isNull(), "-").when(F.col(c) == yes, "1").otherwise("0")
    pattern = F.concat("votes", vote("q", 0), vote("x", 1))
    counted = _measured(docs, text, key, False).join(notes, "k0", "left").groupBy(pattern.alias("p")).count()
    patterns = {r["p"]: r["count"] for r in counted.collect()}  # at most 3^8 rows
    share, says = label_model(patterns)
    spread = F.xxhash64(F.col("k0").cast("string"))
    chosen = notes.orderBy(spread, "k0").limit(fit_rows)
    if not any(p[6:] != "--" for p in patterns):
        chosen = docs.select(F.col(key).alias("k0")).filter("k0 is not null").distinct().orderBy(spread, "k0").limit(fit_rows).join(notes, "k0", "left")
    chosen = F.broadcast(chosen.select(F.col("k0").alias("_id"), "q", "x"))  # at most fit_rows ids
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(chosen, F.col("_k") == F.col("_id"), "left_semi")
    one = own.groupBy("_k").agg(F.min(F.xxhash64("_t")).alias("_h"))
    picked = own.join(F.broadcast(one.withColumnRenamed("_k", "_o")), (F.col("_k") == F.col("_o")) & (F.xxhash64("_t") == F.col("_h")), "left_semi")
    rows = _measured(picked, "_t", "_k", True).dropDuplicates(["k0"]).join(chosen, F.col("k0") == F.col("_id"), "left")
    sample = stored(rows.select("k0", "features", pattern.alias("p")))  # at most fit_rows documents

    keys = sorted(patterns)
    ones, seen = (np.array([[c != sign for c in k] for k in keys], float).reshape(len(keys), len(LABELLERS)) for sign in "0-")
    target = dict(zip(keys, posterior(ones * seen, seen, share, says)))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
            names, at = np.unique(np.concatenate(some), return_inverse=True)
            p = np.repeat(np.array([target[x] for x in batch.column("p").to_pylist()]), [len(x) for x in some], axis=0)
            sums = [np.bincount(at, minlength=len(names)).astype(float), *[np.bincount(at, p[:, c], minlength=len(names)) for c in range(3)]]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *map(pa.array, sums)], ["feature", "n", "c0", "c1", "c2"])

    sums = sample.mapInArrow(marks, "feature long, n double, c0 double, c1 double, c2 double").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1", "c2")])
    means = [target[r["p"]] * r["count"] for r in sample.groupBy("p").count().collect()]  # at most 3^8 rows
    total = sample.count()
    mean = (np.sum(means, axis=0) / max(total, 1) if means else np.ones(3)).tolist()
    over = F.greatest(*[F.col(f"c{c}") / F.col("n") / max(x, 1e-9) for c, x in enumerate(mean)])
    excess = F.greatest(*[(F.col(f"c{c}") - x * F.col("n")) / F.sqrt(F.greatest(x * (1 - x) * F.col("n"), F.lit(0.25))) for c, x in enumerate(mean)])
    # The features that telling() may keep; the rest never leaves the executors.
    found = sums.filter((F.col("n") > 1) & (over > LIFT)).orderBy(excess.desc(), "feature").limit(4 * fit_features).collect()
    table = np.array([[r["n"], r["c0"], r["c1"], r["c2"]] for r in found]).reshape(len(found), 4)
    names = np.sort(np.array([r["feature"] for r in found], np.int64)[telling(table, np.array(mean), fit_features)])

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[np.isin(x, names)].tobytes() for x in some], pa.binary()), batch.column("p")], ["features", "p"])

    taught = sample.select("features", "p").mapInArrow(only, "features binary, p string").collect()  # fit_rows x fit_features at most
    taught.sort(key=lambda r: (r["p"], bytes(r["features"])))
    return fit(names, [np.frombuffer(r["features"], "<u4") for r in taught], np.array([target[r["p"]] for r in taught]).reshape(len(taught), 3))


def _ratings(spark: SparkSession, scorer: Scorer) -> Callable[[Column], Column]:
    """A column function: text to class probabilities. Only the text travels to Python, and three numbers back."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)  # at most fit_features features

    @F.arrow_udf("struct<clean:double,junk:double,toxic:double>")
    def rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            parts, at = [], 0
            while at < len(texts):  # about 1 MB of text at once
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at] - lengths[at]) + (1 << 20), "right")))
                parts.append(shared.value.rate(*columnar.utf8(texts.slice(at, stop - at))))
                at = stop
            p = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0))
            yield pa.StructArray.from_arrays([pa.array(x) for x in p], ["clean", "junk", "toxic"])

    return lambda text: rated(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, weights: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns `keep`, p_clean, p_junk, p_toxic and rejected (p_clean under one half).

    A null or empty text has the features of a text without words and is scored like any other; very long texts are read
    whole. Rows are independent: repeated rows get equal scores, null keys pass through, and other columns of docs are not
    read, whatever their names. An empty table gives an empty result.
    """
    rated = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], _ratings(docs.sparkSession, weights)(F.col(text)).alias("p"))
    return rated.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"p.{c}").alias(f"p_{c}") for c in CLASSES], (F.col("p.clean") < 0.5).alias("rejected"))


def clean(docs: DataFrame, weights: Scorer, text: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; nulls, empty and long texts as in `score`."""
    return docs.filter(_ratings(docs.sparkSession, weights)(F.col(text)).getField("clean") >= 0.5)
