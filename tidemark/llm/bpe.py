"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that stands inside no vocabulary token can never be merged across, so a word may be cut there:
the fragments are encoded independently and their ids concatenated. Only the last fragment of a word carries the end-of-word
mark. The merges are done by the tokenizers library, some thousands of a block's different fragments a call: no word
crosses a blank, so the block's texts are told apart by what stands between blanks, each such chunk is cut into words once,
each word into fragments once, and the ids are gathered back by offsets.

Everything is one narrow pass over the documents: no shuffle, and a lost task is simply run again. A block is 2 MB of text; a
longer text makes a block of its own.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

from tidemark.llm import columnar
from tidemark.llm.shared import text_batches

BLOCK_BYTES = 2 << 20
#: Fragments given to the tokenizers library at once: it holds some 500 bytes for each until it returns.
FRAGMENTS = 8192
MARK = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges of such starts and lengths, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class Encoder:
    """Encodes and decodes whole texts; built once per worker from the tokenizer's JSON text."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.split = regex.compile(f" |{pattern}")
        self.space = regex.compile(r"\s+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.letters = np.array([ord(x) for x in letters], np.uint32)
        number = {x: b for b, x in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)  # byte pairs that stand inside some token
        for token in vocab:
            b = [number[x] for x in token.removesuffix(MARK)]
            self.joined[b[:-1], b[1:]] = True
        self.last, self.inner = Tokenizer(BPE(vocab, merges, end_of_word_suffix=MARK)), Tokenizer(BPE(vocab, merges))
        for one in (self.last, self.inner):
            one.pre_tokenizer = Split("\n", "removed")

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where fragments of the words in `data` begin: at a word's start and between bytes that stand in no token."""
        begins = np.zeros(len(data), bool)
        begins[1:] = ~self.joined[data[:-1], data[1:]]
        begins[offs[:-1]] = True
        return np.flatnonzero(begins)

    def fragments(self, word: str) -> list[bytes]:
        raw = word.encode()
        at = self.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]

    def _merged(self, tokenizer: Tokenizer, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments of such starts and lengths, and the fragment's number of each."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, numbers = [], []
        for at in range(0, len(starts), FRAGMENTS):
            first, sizes = starts[at : at + FRAGMENTS], lengths[at : at + FRAGMENTS]
            text = np.full(int(sizes.sum()) + len(sizes), ord("\n"), np.uint32)
            text[ragged(offsets(sizes + 1)[:-1], sizes)] = self.letters[data[ragged(first, sizes)]]
            found = tokenizer.encode(text.tobytes().decode("utf-32-le"), add_special_tokens=False)
            ids.append(np.array(found.ids, np.int64))
            numbers.append(np.array(found.word_ids, np.int64) + at)
        return np.concatenate(ids), np.concatenate(numbers)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each word has. A special token is given with a line end before it."""
        data, offs = columnar.utf8(pa.array(words, pa.string()))
        starts = self.cuts(data, offs)
        ends = np.append(starts[1:], len(data))
        word = np.searchsorted(offs, starts, "right") - 1
        given = np.array([w[0] == "\n" for w in words], bool)[word]
        last = np.flatnonzero((ends == offs[word + 1]) & ~given)
        inner = np.flatnonzero((ends < offs[word + 1]) & ~given)
        found = [(ids, which[at]) for which, (ids, at) in ((some, self._merged(one, data, starts[some], (ends - starts)[some])) for some, one in ((last, self.last), (inner, self.inner)))]
        marks = [(i, self.special[w[1:]]) for i, w in enumerate(words) if w[0] == "\n"]
        found.append((np.array([x for _, x in marks], np.int64), np.searchsorted(word, np.array([i for i, _ in marks], np.int64))))
        ids, fragment = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(fragment, kind="stable")
        return ids[order], np.bincount(word[fragment], minlength=len(words))

    def normal(self, text: str) -> str:
        """NFC, one blank for white space, lower case letter by letter (a capital sigma doesn't look at its neighbours)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = self.space.sub(" ", text)
        return "".join([x.lower() for x in text]) if "Σ" in text else text.lower()

    def _words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks, and how many each has. Chunks with special tokens or other white space come one by one.

        A chunk without text has no words and stands in no row of chunks: white space beside it would be taken for one blank.
        """
        odd = [i for i, x in enumerate(chunks) if "<|" in x or self.space.search(x)]
        apart = set(odd)
        plain = [i for i, x in enumerate(chunks) if x and i not in apart]
        found = self.split.findall(self.normal(" ".join([chunks[i] for i in plain])))
        ends = np.flatnonzero(pc.equal(pa.array([*found, " "], pa.string()), " ").to_numpy(zero_copy_only=False))
        count = np.zeros(len(chunks), np.int64)
        if plain:
            count[plain] = np.diff(ends, prepend=-1) - 1
        ready = [w for w in found if w != " "]
        if not odd:
            return ready, count
        before, at, words = offsets(count), 0, []
        for i in odd:
            pieces = self.marks.split(chunks[i]) if self.marks else [chunks[i]]
            own = [w for p in pieces for w in (["\n" + p] if p in self.special else self.words.findall(self.normal(p)))]
            words += ready[at : before[i]]
            words += own
            at, count[i] = before[i], len(own)
        return words + ready[at:], count

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        for mark in "\n\t\r":  # they part words as a blank does; other white space is left to the expressions
            texts = pc.replace_substring(texts, mark, " ")
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        chunks = parts.flatten().dictionary_encode()
        words, n_words = self._words(chunks.dictionary.to_pylist())
        known = pa.array(words, pa.string()).dictionary_encode()
        ids, n_ids = self.encode_words(known.dictionary.to_pylist())
        # From words to chunks to texts: every level takes the ranges of the one below.
        code = known.indices.to_numpy()
        some = n_ids[code]
        chunk_ids = ids[ragged(offsets(n_ids)[:-1][code], some)]
        per_chunk = np.diff(offsets(some)[offsets(n_words)])
        code = chunks.indices.to_numpy()
        flat = chunk_ids[ragged(offsets(per_chunk)[:-1][code], per_chunk[code])]
        return flat, np.diff(offsets(per_chunk[code])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])

    def texts_of(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The tokens' texts joined by blanks, for texts of so many ids each."""
        lists = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")

    def encode(self, text: str) -> tuple[bytes, str]:
        ids, counts = self.encode_block(pa.array([text], pa.string()))
        return ids.astype("<u4").tobytes(), self.texts_of(ids, counts)[0].as_py()

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the tokenizer's file, the tokens' texts joined by blanks."""
        known = [i for i in ids if i < len(self.tokens) and self.tokens[i].is_valid]
        return self.texts_of(np.array(known, np.int64), np.array([len(known)]))[0].as_py()


_BUILT: dict[int, Encoder] = {}


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns `keep`, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    A null or empty text has no tokens, empty ids and an empty decoding. Rows are independent, so repeated rows give
    repeated results; null keys pass through; other columns of docs, whatever their names, are not read. Words are encoded
    whole whatever their length. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)  # the vocabulary file, whose size does not grow with the data
    key = hash(tokenizer_json)
    taken = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _BUILT.get(key)
        if encoder is None:
            encoder = _BUILT[key] = Encoder(shared.value)
        for block in columnar.blocks(batches, "t", BLOCK_BYTES):
            ids, counts = encoder.encode_block(block.column("t").combine_chunks())
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets(4 * counts).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            arrays = [block.column(i).combine_chunks() for i in range(len(keep))]
            arrays += [pa.array(counts, pa.int64()), raw, encoder.texts_of(ids, counts)]
            yield pa.RecordBatch.from_arrays(arrays, [*[f"k{i}" for i in range(len(keep))], "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()  # workers go on to other stages

    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(taken.schema.fields[:-1]))
    rows = taken.mapInArrow(run, f"{kinds}, n_tokens long, ids binary, decoded string")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text."""
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
