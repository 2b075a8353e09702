"""Benchmark decontamination: a prefix-filtered set join over item-sized windows, in DataFrame functions only.

A window is ten consecutive words of a benchmark item, or a whole shorter item; as a set it is its three-word shingles (one
or two words where the window is shorter). The documents' words are run past the benchmark's shingles once, and only the
occurrences that some item has are written. From there:

1. shingles are ordered by rarity, the count of their occurrences in all documents; a window with a shingle that never
   occurs is out;
2. a window must be wholly contained, so its necessary prefix is its rarest shingle, and only that one is joined;
3. an occurrence fixes where the window would start; windows that would start before the first word or end after the last
   are out;
4. the rest is verified shingle by shingle at consecutive places.

The documents are read once and their texts are never shuffled. The benchmark's shingles are broadcast if their counted
size allows, else the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small_side, stored

WINDOW = 10
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _print(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct (item, window): the window as its words and as the fingerprints of its shingles in order."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("words")).distinct()
    q = F.least(F.lit(SHINGLE), F.size("words"))

    def shingled(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _print([F.element_at("words", i + j) for j in range(k)]))

    prints = F.when(q == 1, shingled(1)).when(q == 2, shingled(2)).otherwise(shingled(3))
    return cut.select("item", "words", q.alias("q"), F.size("words").alias("length"), prints.alias("prints"), F.array_join("words", " ").alias("window"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of docs: the columns `keep`, n_words, n_hit (words inside an occurring window), items (the sorted
    ids, as text, of items with occurring windows).

    A null or empty text has no words and no hits. Items without words have no window; repeated items and windows count
    once; a null item id is the empty text. Repeated documents get equal rows. With an empty benchmark nothing is hit;
    with no documents the result is empty. Other columns of either table are not read, whatever their names.
    """
    known = stored(windows(items, item, item_text, size))
    shingle = known.select("q", "words", F.posexplode("prints").alias("i", "print"))
    parts = [F.when(F.col("q") >= j + 1, F.element_at("words", F.col("i") + j + 1)).alias(f"s{j}") for j in range(SHINGLE)]
    # The first row lets one header row of each document through.
    vocabulary = stored(shingle.select("q", "print", *parts).distinct().unionByName(
        docs.sparkSession.range(1).select(F.lit(0).alias("q"), F.lit(0).cast("long").alias("print"), *[F.lit(None).cast("string").alias(f"s{j}") for j in range(SHINGLE)])
    ))
    lengths = sorted(r["q"] for r in vocabulary.select("q").distinct().collect() if r["q"])  # 1, 2 or 3

    listed = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words(text).alias("w"))
    listed = listed.withColumn("n", F.size("w")).withColumn("w", F.concat(F.array(F.lit("")), F.col("w")))
    zipped = F.arrays_zip(*[F.slice("w", F.lit(j + 1), F.col("n") + 1).alias(f"w{j}") for j in range(SHINGLE)])
    each = listed.select("rid", "n", *[f"k{i}" for i in range(len(keep))], F.posexplode(zipped).alias("pos", "z"))
    w = [F.col("z").getField(f"w{j}") for j in range(SHINGLE)]
    each = each.select("rid", "n", *[f"k{i}" for i in range(len(keep))], "pos", *[w[j].alias(f"w{j}") for j in range(SHINGLE)])
    kinds = [F.struct(F.lit(k).alias("q"), F.when(F.col("pos") == 0, F.lit(0 if k == max(lengths) else None).cast("long")).otherwise(_print([F.col(f"w{j}") for j in range(k)])).alias("print")) for k in lengths] if lengths else [F.struct(F.lit(0).alias("q"), F.when(F.col("pos") == 0, F.lit(0).cast("long")).alias("print"))]
    each = each.withColumn("x", kinds[0]) if len(kinds) == 1 else each.withColumn("x", F.explode(F.array(*kinds)))
    each = each.select("*", F.col("x.q").alias("size"), F.col("x.print").alias("print")).drop("x")
    met = each.join(small_side(vocabulary, 120).alias("v").withColumnRenamed("print", "p"), (F.col("print") == F.col("p")) & ((F.col("q") == 0) | (
        (F.col("q") == F.col("size")) & (F.col("w0") == F.col("s0")) & ((F.col("q") < 2) | (F.col("w1") == F.col("s1"))) & ((F.col("q") < 3) | (F.col("w2") == F.col("s2")))
    )))
    met = stored(met.select("rid", "n", *[f"k{i}" for i in range(len(keep))], "pos", "q", "print"))
    heads = met.filter("q = 0").select("rid", *[F.col(f"k{i}") for i in range(len(keep))], F.col("n").cast("long").alias("n_words"))
    hits = met.filter("q > 0").select("rid", "n", "pos", "q", "print")

    # 1. rarity
    rarity = hits.groupBy("print").count()
    each_window = known.select("window", "q", "length", "prints").distinct()
    ranked = each_window.select("*", F.posexplode("prints").alias("at", "print")).join(rarity, "print", "left")
    # 2. the necessary prefix: the rarest shingle
    rarest = ranked.groupBy("window", "q", "length", "prints").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "print", "at")).alias("least"))
    prefix = rarest.filter("least.count > 0").select("window", "length", "prints", F.col("least.print").alias("print"), F.col("least.at").alias("at"))
    # 3. positional and length bounds
    candidate = hits.join(prefix, "print").withColumn("start", F.col("pos") - F.col("at")).filter("start >= 1 AND start + length - 1 <= n")
    # 4. verification at consecutive places
    order = Window.partitionBy("rid", "q").orderBy("pos")  # within one document
    chain = F.array(*[F.when(F.lead("pos", j).over(order) == F.col("pos") + j, F.lead("print", j).over(order)) for j in range(size - SHINGLE + 1)])
    chains = hits.select("rid", F.col("pos").alias("start"), F.col("q").alias("chain_q"), chain.alias("chain"))
    verified = stored(
        candidate.join(chains, ["rid", "start"]).filter((F.col("q") == F.col("chain_q")) & (F.slice("chain", 1, F.size("prints")) == F.col("prints"))).select("rid", "start", "length", "window").distinct()
    )
    before = Window.partitionBy("rid").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ends = verified.select("rid", "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    counts = ends.withColumn("new", covered).groupBy("rid").agg(F.sum("new").cast("long").alias("n_hit"))
    of = known.select("window", "item").distinct()
    lists = verified.select("rid", "window").distinct().join(of, "window").select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))  # benchmark ids
    joined = heads.join(counts, "rid", "left").join(lists, "rid", "left")
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    uid = F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))
    marked = docs.withColumn("_uid", uid)
    found = stored(find(marked, items, text, keep=("_uid",)).filter("n_hit > 0").select("_uid").distinct())
    return marked.join(small_side(found, 16), "_uid", "left_anti").select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[s:s + {WINDOW - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM iw),
dw AS (SELECT rid, l, s, w[s:s + l - 1] AS win FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT rid, s, l, item_id FROM dw JOIN iw USING (win)),
cov AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + l)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
