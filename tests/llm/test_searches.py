"""Exact top-k search, hard negatives and spelling variants, against SQL or plain versions."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, pivots, queries, shards, spelling


@pytest.mark.parametrize("name", ["op11_topk", "op13_negatives"])
def test_matches_sql(spark, small_dir, twin, name):
    twin(queries.QUERIES[name](spark, small_dir), queries.ORACLES[name], small_dir)
    twin(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLES[name], "/root/testdata/sf0.001")


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, size string, rank string, score string")


def rows_with(vectors, labels=None):
    return [(i, v, None if labels is None else labels[i], "s", "r", "c") for i, v in enumerate(vectors)]


def dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(int(np.floor(x * 256)) * int(np.floor(y * 256)) if abs(x) < 2**44 and abs(y) < 2**44 else whole(x) * whole(y) for x, y in zip(a, b))))


def whole(x):
    return int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256))


def plain_top(vectors, asks, k):
    out = []
    for q in asks:
        near = sorted((-dot(vectors[q], v), i) for i, v in enumerate(vectors) if i != q and v is not None and vectors[q] is not None and len(v) == len(vectors[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_top_in_small_shards_with_ties_and_lengths(spark):
    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in np.round(rng.normal(size=(300, 5)), 1)]
    vectors += [vectors[7]] * 40 + [[0.0] * 5] * 3 + [[], [], [1.5, -2.0], [0.5, 0.5], None]
    want = plain_top(vectors, [i for i in range(len(vectors)) if i % 10 == 7 or i > 340], 5)
    df = vectors_of(spark, rows_with(vectors))
    asks = (F.col("vec_id") % 10 == 7) | (F.col("vec_id") > 340)
    for twice, kw in ((False, {"shard_rows": 64, "pivots": 6}), (True, {"sample": 20}), (False, {"pivots": 0})):
        got = pivots.top(df.unionByName(df) if twice else df, asks, **kw).collect()
        assert sorted(tuple(r) for r in got) == want
    assert pivots.top(df.limit(0), asks).collect() == [] and pivots.top(df, F.lit(None).cast("boolean")).collect() == []


def test_wide_components_are_exact(spark):
    """Products that doubles can't hold, sums beyond 64 bits, and components that 256 times a double can't hold."""
    rng = np.random.default_rng(4)
    vectors = [(v * 10.0 ** rng.integers(0, 8)).tolist() for v in rng.normal(size=(60, 3))] + [[1e300, 1.0, 0.0], [1.7e308, -1.7e308, 1.0], [1e16 + 2, 1.0, 3.0]]
    df = vectors_of(spark, rows_with(vectors, [i % 3 for i in range(len(vectors))]))
    got = pivots.top(df, F.col("vec_id") % 4 == 2, k=4).collect()
    assert sorted(tuple(r) for r in got) == plain_top(vectors, range(2, len(vectors), 4), 4)
    assert plain_negatives(vectors, [i % 3 for i in range(len(vectors))], range(2, len(vectors), 4)) == sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 4 == 2, F.col("label")).collect())


def test_bounds_hold_and_leave_out_clusters():
    """No score lies above its bound, and on data with clusters few rows are scored."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64)) * 40
    values = np.floor(centres[rng.integers(40, size=8_000)] + rng.normal(size=(8_000, 64)) * 3)
    at = pivots.choose(values, 64)
    table = pivots.Table(np.arange(8_000), values, at, values[at])
    for i in range(0, 8_000, 200):
        scores = values @ values[i]
        assert (scores <= table.bounds(values[i])).all()
        places, found = table.search(i, values[i], 5)
        order = sorted(((-int(s), j) for j, s in enumerate(scores) if j != i))[:5]
        assert [(int(s), int(p)) for p, s in zip(places, found)] == [(-s, j) for s, j in order]
    assert table.scored < 0.35 * table.seen
    assert len(pivots.choose(np.zeros((9, 2)), 5)) == 1 and len(pivots.choose(np.zeros((0, 2)), 5)) == 0


def plain_negatives(vectors, labels, anchors, low=80, high=100, k=5):
    out = []
    for a in anchors:
        if labels[a] is None or vectors[a] is None:
            continue
        near = sorted((-dot(vectors[a], v), i) for i, v in enumerate(vectors) if i != a and v is not None and labels[i] is not None and len(v) == len(vectors[a]))
        for p, pos in [(-s, i) for s, i in near if labels[i] == labels[a]][:k]:
            some = [(-s, i) for s, i in near if labels[i] != labels[a] and low * p <= -100 * s <= high * p][:k]
            out += [(a, pos, r, i, p, s) for r, (s, i) in enumerate(some, 1)]
    return sorted(out)


def test_negatives_plain(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 6))
    vectors = [(centres[i % 4] + rng.normal(size=6)).round(2).tolist() for i in range(400)] + [[0.0] * 6, [], [], None, [1.0, 2.0]]
    labels = [None if i % 17 == 3 else int(rng.integers(2)) * 5 + i % 4 for i in range(len(vectors))]
    df, asks = vectors_of(spark, rows_with(vectors, labels)), F.col("vec_id") % 5 == 0
    want = plain_negatives(vectors, labels, range(0, len(vectors), 5))
    assert len(want) > 500
    for rows in (df, df.unionByName(df)):
        assert sorted(tuple(r) for r in negatives.mine(rows, asks, F.col("label"), shard_rows=128).collect()) == want
    assert negatives.mine(df.limit(0), asks, F.col("label")).collect() == [] and negatives.mine(df, F.lit(False), F.col("label")).collect() == []


def test_packed_products_at_every_width():
    """Several fields in a double, one field, and fields in wide integers all unpack to the exact products."""
    rng = np.random.default_rng(7)
    for most in (1, 3, 100, 1 << 12, 1 << 21, 1 << 23):
        a, b = (rng.integers(-most, most + 1, size=(n, 5)).astype(float) for n in (7, 61))
        assert (negatives.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    a = np.array([[10**12, -5], [3, 7]], dtype=object)
    assert negatives.products(a, a).tolist() == [[2**63 - 1, 3 * 10**12 - 35], [3 * 10**12 - 35, 58]]
    assert negatives.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
    scores = np.array([-(2**63), 2**63 - 1, 5, 5, -1])
    assert shards.first_rows(scores, 9).tolist() == [1, 2, 3, 4, 0] and shards.first_rows(scores, 2).tolist() == [1, 2]


def plain_words(rows):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    best = {w: min(x, key=lambda y: (-counts[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=repr)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_spelling_query_is_plain(spark, small_dir, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, small_dir, "documents").collect()]
    want = plain_variants(plain_words(docs))
    assert sum(r[4] for r in want) > 100 and any(r[1] for r in want)
    assert sorted_rows(queries.QUERIES["op12_spelling"](spark, small_dir)) == want
    found = sorted_rows(spelling.variants(spelling.count_words(odd, typos=97)))
    assert found == plain_variants(plain_words([(r["doc_id"], r["text"]) for r in odd.collect()])) and found
    assert spelling.variants(spelling.count_words(none)).collect() == []


def test_spelling_in_short_and_long_lists(spark):
    """Words of three letters to hundreds over two letters, whose lists are long, and over many scripts."""
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("ab"), int(n))) for n in rng.integers(3, 9, 500)}
    words |= {"".join(rng.choice(list("aé日😀"), int(n))) for n in rng.integers(3, 7, 300)}
    words |= {"prefix" + "".join(rng.choice(list("xyz"), 3)) + "suffix" for _ in range(60)}
    long = "".join(rng.choice(list("abc"), 700))
    words |= {long, long[:350] + long[351:], long[:350] + "z" + long[351:], "a" * 400, "a" * 401, "a" * 402}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.zipf(1.5, len(words)) % 1000 + 3)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = plain_variants(counts)
    for limits in ({}, {"list_rows": 10, "bucket_rows": 300, "share": 20, "least": 1}, {"list_rows": 0, "bucket_rows": 300, "share": 5, "least": 3}):
        assert sorted_rows(spelling.variants(table, **limits)) == want, limits


def test_one_edit_leaves_a_listed_gram():
    """Whatever the dictionary, two words one edit apart are listed under a common gram."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        letters = list("abcd")
        one = "".join(rng.choice(letters, int(rng.integers(3, 16))))
        k, x = int(rng.integers(len(one))), str(rng.choice(letters))
        others = [w for w in (one[:k] + x + one[k + 1 :], one[:k] + one[k + 1 :], one[:k] + x + one[k:], one + x) if w != one and len(w) >= 3]
        pool = spelling.Letters([one, *others] * 2)
        grams = [pool.prints(np.flatnonzero(np.arange(len(pool.data)) + q <= pool.ends[pool.owner]), np.flatnonzero(np.arange(len(pool.data)) + q <= pool.ends[pool.owner]) + q) for q in range(2, 7)]
        common = np.unique(np.concatenate([rng.permutation(g)[: int(rng.integers(len(g) + 1))] for g in grams]))
        often = rng.integers(1, 9, len(common))
        for w in others:
            pair = spelling.Letters([one, w])
            reach = int(spelling.reach_of(np.array([max(len(one), len(w))]))[0])
            word, gram = spelling.rarest(pair, *spelling.decompose(pair, np.arange(2), reach, common), reach, common, often)
            assert set(gram[word == 0].tolist()) & set(gram[word == 1].tolist()), (one, w)
