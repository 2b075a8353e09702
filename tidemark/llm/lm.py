"""Language-model scoring by deleted interpolation.

    P(w | context) = l2 * c(context, w) / c(context) + l1 * c(w) / N + l0 / (V + 1)

The context of a token is the word before it, or the start; words and pairs are told apart by 64-bit fingerprints. The
weights l depend on the bucket of the context's frequency (powers of two) and come from expectation-maximisation on a
deleted part of the training documents, against counts of the rest; afterwards all training documents count.

1. Texts become blocks, stored once: the distinct words of a block, and its tokens as numbers of these.
2. A block asks for the counts of its distinct words and (word before, word) pairs, dealt by ranges of their fingerprints.
   A range sums what its blocks have and answers each block in the order in which it asked. However frequent a word or
   pair is, a block names it once.
3. Blocks meet their answers: those of the deleted part make a histogram of the two estimates per bucket, on which the
   weights are learned; then all blocks score their documents.

A text ends with an end token, and the start counts as the context "end": it occurs as often, so c(context) is the count of
the word before in every case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import columnar
from tidemark.llm.shared import stored, text_batches

LEVELS = 48  # buckets of context frequency
STEPS = 4  # histogram steps per octave of an estimate
END = np.uint64(0x1F83D9ABFB41BD6B)
BLOCK = 8 << 20
MOST_BUCKETS = 1 << 16
HELD, DELETED, REST = 0, 1, 2  # what a block's documents are for; a block has documents of one kind
PRIOR = np.array([0.05, 0.35, 0.6])  # weights of the uniform, word and context estimates where nothing was deleted


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context (the word before) and text number of every token in text order, one end a text."""
    lower = columnar.LOWER[data]
    s, e, d = columnar.word_spans(lower, offs, columnar.WHITE_SPACE)
    n = len(offs) - 1
    words = columnar.fingerprints(columnar.running(lower), s, e)
    place = np.arange(len(words)) + d
    all_words = np.full(len(words) + n, END, np.uint64)
    all_words[place] = words
    owner = np.empty(len(all_words), np.int64)
    owner[place] = d
    owner[np.cumsum(np.bincount(d, minlength=n) + 1) - 1] = np.arange(n)
    return all_words, np.concatenate([[END], all_words[:-1]]), owner


def block_words(block: pa.Table) -> np.ndarray:
    """The words of tokens() of a block of texts, piece by piece."""
    data, offs = columnar.utf8(block.column("t"))
    return np.concatenate([tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0] for i, j in columnar.pieces(offs)])


def _buckets(words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of fingerprints, so words in order have buckets in order."""
    return ((words >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0), LEVELS - 1).astype(np.int64)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length as planes of bytes, which compress better than whole numbers."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns))


def _restored(packed: bytes, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(data) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def _block(names: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a block in order, and the word number of each token."""
    return np.cumsum(_restored(names, "<u8")[0]), _restored(numbers, "<u4")[0].astype(np.int64)


def _pairs(names: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a block in the order of their fingerprints, their two words and counts; the pair of each token."""
    before = np.concatenate([[np.searchsorted(names, END)], number[:-1]])
    code, pair, count = np.unique(before * len(names) + number, return_inverse=True, return_counts=True)
    before, word = code // len(names), code % len(names)
    prints = columnar.fold([names[before], names[word]])
    order = np.argsort(prints, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return prints[order], before[order], word[order], count[order], place[pair]


def _asked(word_buckets: int, pair_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and range the fingerprints whose counts it needs, with its own counts where it teaches."""
        for batch in batches:
            for row in batch.to_pylist():
                names, number = _block(row["names"], row["numbers"])
                prints, _, _, count, _ = _pairs(names, number)
                out = []
                for base, n, keys, counts in ((0, word_buckets, names, np.bincount(number, minlength=len(names))), (word_buckets, pair_buckets, prints, count)):
                    counts = (counts * (row["role"] != HELD)).astype("<u4")
                    bucket = _buckets(keys, n)
                    for b in np.unique(bucket).tolist():
                        i, j = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
                        out.append((base + b, _squeezed(_steps(keys[i:j]), counts[i:j])))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([row["block"]] * len(out), pa.int64()),
                    "role": pa.array([row["role"]] * len(out), pa.int32()), "packed": pa.array([x[1] for x in out], pa.binary()),
                })

    return run


def _answered(word_buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of one range: per block the counts that it asked for, those of the rest beside them for a deleted block.

        A range of words adds a row without a block: distinct words and tokens of the training documents and of the rest.
        """
        bucket, roles = key[0].as_py(), table.column("role").to_numpy()
        parts = [_restored(x, "<u8", "<u4") for x in table.column("packed").to_pylist()]
        edges = np.cumsum([0, *[len(p[0]) for p in parts]]).tolist()
        names, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        counts = np.concatenate([p[1] for p in parts])
        total = np.bincount(at, counts, minlength=len(names)).astype("<u8")
        gone = np.repeat(roles == DELETED, np.diff(edges))
        rest = total - np.bincount(at[gone], counts[gone], minlength=len(names)).astype("<u8")
        packed = [_squeezed(total[at[i:j]], *([rest[at[i:j]]] if r == DELETED else [])) for i, j, r in zip(edges[:-1], edges[1:], roles.tolist())]
        sums = [int((total > 0).sum()), int((rest > 0).sum()), int(total.sum()), int(rest.sum())]
        extra = 1 if bucket < word_buckets else 0
        n = len(packed)
        return pa.table({
            "block": pa.array(table.column("block").to_pylist() + [None] * extra, pa.int64()), "role": pa.array(roles.tolist() + [None] * extra, pa.int32()),
            "bucket": pa.array([bucket] * (n + extra), pa.int32()), "packed": pa.array(packed + [None] * extra, pa.binary()),
            **{c: pa.array([None] * n + [x] * extra, pa.int64()) for c, x in zip(("words", "rest_words", "tokens", "rest_tokens"), sums)},
        })

    return run


def _counts(answers: pa.Table, word_buckets: int, role: int, of_rest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The counts in the answers to a block, of all training documents or of the rest: of its words and of its pairs."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist()))
    got = [(b < word_buckets, _restored(x, *["<u8"] * (2 if role == DELETED else 1))[of_rest].astype(np.int64)) for b, x in rows]
    return np.concatenate([x for of_word, x in got if of_word]), np.concatenate([x for of_word, x in got if not of_word])


def _histogram(word_buckets: int, rest_tokens: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one deleted block: its tokens by level of context and by both estimates from the rest."""
        names, number = _block(block.column("names")[0].as_py(), block.column("numbers")[0].as_py())
        _, before, word, count, _ = _pairs(names, number)
        of_word, of_pair = _counts(answers, word_buckets, DELETED, True)
        context = of_word[before]
        two = np.where(context > 0, of_pair / np.maximum(context, 1), 0.0)
        one = of_word[word] / max(1, rest_tokens)
        step = lambda p: np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-30))), -1).astype(np.int64)
        codes, at = np.unique((_level(context) * 512 + step(two) + 1) * 512 + step(one) + 1, return_inverse=True)
        sums = {"n": count, "two": count * two, "one": count * one}
        return pa.table({"code": pa.array(codes, pa.int64()), **{c: pa.array(np.bincount(at, x, minlength=len(codes)), pa.float64()) for c, x in sums.items()}})

    return run


def learn_weights(level: np.ndarray, n: np.ndarray, two: np.ndarray, one: np.ndarray, none: float, rounds: int = 60) -> np.ndarray:
    """EM over held-out counts: rows (uniform, word, context) of weights per level of context frequency.

    A level with few counts leans on the weights of all levels together, by a pseudo-count of ten tokens. Contexts that
    never occurred have no estimate of their own, so their weight goes to the other two.
    """

    def em(rows: np.ndarray, start: np.ndarray, lean: float) -> np.ndarray:
        weights = start
        p = np.stack([np.full(int(rows.sum()), none), one[rows], two[rows]], axis=1)
        for _ in range(rounds):
            mixed = p * weights
            share = mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300)
            weights = (share * n[rows][:, None]).sum(axis=0) + lean * start
            weights = weights / weights.sum()
        return weights

    every = em(np.ones(len(n), bool), PRIOR, 1.0) if len(n) else PRIOR
    weights = np.tile(every, (LEVELS, 1))
    for b in np.unique(level).tolist():
        weights[b] = em(level == b, every, 10.0)
    weights[0, 2] = 0
    weights[0] /= weights[0].sum()
    return weights


def _scored(word_buckets: int, n_train: int, vocabulary: int, weights: np.ndarray):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one block: per document its tokens, known tokens and both sums of logarithms."""
        names, number = _block(block.column("names")[0].as_py(), block.column("numbers")[0].as_py())
        role = block.column("role")[0].as_py()
        _, before, word, _, pair = _pairs(names, number)
        of_word, of_pair = _counts(answers, word_buckets, role, False)
        context = of_word[before]
        l0, l1, l2 = weights[_level(context)].T
        p = l2 * of_pair / np.maximum(context, 1) + l1 * of_word[word] / max(1, n_train) + l0 / (vocabulary + 1)
        plain = (of_word + 0.1) / (n_train + 0.1 * (vocabulary + 1))
        ends = number == np.searchsorted(names, END)
        doc = np.cumsum(ends) - ends
        keys = block.column("keys").combine_chunks().flatten()
        per = lambda values: np.bincount(doc, values, minlength=len(keys))
        return pa.table({
            "k": keys, "held": pa.array(np.full(len(keys), role == HELD)), "n_tokens": pa.array(np.bincount(doc, minlength=len(keys)), pa.int64()),
            "n_known": pa.array(per((of_word > 0)[number]).astype(np.int64)),
            "base_score": pa.array(per(np.log10(plain)[number])), "score": pa.array(per(np.log10(p)[pair])),
        })

    return run


def score(docs: DataFrame, held_out: Column, deleted: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: `key`, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out and deleted are conditions on rows of docs: the first are scored but never learned from, the second teach the
    weights. A null or empty text has one token, its end. Repeated rows count as often as they stand there and get equal
    scores, up to the last digits of a sum. A null key is scored like any other. Without training documents every token has
    probability one. Very long texts are one row like any other; an empty table gives an empty result; other columns of docs
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    pair_buckets = min(MOST_BUCKETS, max(12, int(spark.conf.get("spark.sql.shuffle.partitions")) * 3 // 4))
    word_buckets = -(-pair_buckets // 4)
    held = F.coalesce(held_out, F.lit(True))
    role = F.when(held, HELD).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(REST)
    taken = docs.select(F.col(key).alias("k"), role.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = taken.schema["k"].dataType.simpleString()

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for texts in columnar.blocks(batches, "t", BLOCK):
            roles = texts.column("role").to_numpy()
            for r in np.unique(roles).tolist():
                block = texts.filter(pa.array(roles == r))
                names, number = np.unique(block_words(block), return_inverse=True)
                keys = block.column("k").combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    pa.array([at], pa.int64()), pa.array([r], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([_squeezed(_steps(names))], pa.binary()), pa.array([_squeezed(number.astype("<u4"))], pa.binary()),
                ], ["block", "role", "keys", "names", "numbers"])
                at += 1

    blocks = stored(taken.mapInArrow(told_apart, f"block long, role int, keys array<{kind}>, names binary, numbers binary"))
    asked = blocks.select("block", "role", "names", "numbers").mapInArrow(_asked(word_buckets, pair_buckets), "bucket int, block long, role int, packed binary")
    sums = ("words", "rest_words", "tokens", "rest_tokens")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answered(word_buckets), "block long, role int, bucket int, packed binary, " + ", ".join(f"{c} long" for c in sums)))
    vocabulary, rest_vocabulary, n_train, rest_tokens = (x or 0 for x in answers.agg(*[F.sum(c) for c in sums]).first())
    answers = answers.filter("block is not null").select("block", "role", "bucket", "packed")

    gone, told = blocks.filter(F.col("role") == DELETED), answers.filter(F.col("role") == DELETED)
    counted = gone.select("block", "names", "numbers").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_histogram(word_buckets, rest_tokens), "code long, n double, two double, one double")
    rows = counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).orderBy("code").toPandas()  # bounded by the steps
    n = rows["n"].to_numpy(float)
    weights = learn_weights(rows["code"].to_numpy(np.int64) >> 18, n, rows["two"].to_numpy(float) / n, rows["one"].to_numpy(float) / n, 1 / (rest_vocabulary + 1))
    if not n_train:
        weights[:] = 1.0, 0.0, 0.0

    met = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    scores = met.applyInArrow(_scored(word_buckets, n_train, vocabulary, weights), f"k {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select(F.col("k").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
