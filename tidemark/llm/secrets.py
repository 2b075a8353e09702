"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates of three base kinds and of a fourth, wider one are found in whole texts. Their hashes are then counted over the
corpus by distinct repositories and owners: a value that several owners share is a copied example, a value of one owner
looks live. Base spans always stay; the wider kind (long runs that mix letters and digits) is added where it looks live.

Positions come from the lengths between matches: a text split at its matches gives the gaps, and a running sum over gaps
and matches of a document gives the offsets, in code points. The texts are read once and never shuffled; what is stored,
joined and counted is the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

KINDS = ("assign", "access", "hex", "key")
BASE_KINDS = 3
COMMON_OWNERS = 3

# The patterns of the kinds and the least length of what they capture. The runs of access, hex and key are
# maximal, so their least length can stand in the pattern; an assignment too short is matched first and then dropped.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"[A-Za-z0-9_-]{20,}"
LEAST_ASSIGNED = 6


def _hits(kind: int, pattern: str, group: int) -> Column:
    """Matches of a pattern in the column t as an array of (kind, number, gap before, length, value)."""
    matches = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split("t", pattern, -1), F.length)
    values = F.regexp_extract_all("t", F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("long"), values.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["long"].alias("long"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,long:int,value:string>>")
    return F.when(F.col("t").rlike(pattern), F.filter(rows, lambda x: x["value"].isNotNull())).otherwise(none)


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), common_owners: int = COMMON_OWNERS) -> DataFrame:
    """One row per row of docs: the columns `keep`, rid (a row number), and spans, an array of (start, kind, end, live)
    sorted by start and kind, kind being a place in KINDS, offsets in code points with the end exclusive.

    A null or empty text has no spans. Candidates without a repository or owner count as of one unknown repository or
    owner. Repeated rows get equal spans and count once per repository and owner. Spans of different kinds may overlap;
    equal starts are ordered by kind. An empty table gives an empty result, and other columns of docs are not read.
    """
    taken = docs.select(
        F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    found = F.concat(_hits(0, ASSIGN, 1), _hits(1, ACCESS, 0), _hits(2, HEX, 0), _hits(3, KEY, 0))
    rows = stored(taken.withColumn("hits", found).drop("t"))  # rid and the candidates, fixed by being written
    hit = rows.filter(F.size("hits") > 0).select("rid", "repository", "owner", F.explode("hits").alias("h")).select("rid", "repository", "owner", "h.*")
    passed = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a document's matches
    placed = hit.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(passed)).withColumn("start", F.col("end") - F.col("long"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    good = F.when(F.col("kind") == 0, F.length("value") >= LEAST_ASSIGNED).when(F.col("kind") == 3, mixed).otherwise(True)
    spans = placed.filter(good).withColumn("hash", F.sha2(F.col("value").cast("binary"), 256))
    owned = spans.select("hash", "repository", "owner").distinct()  # combined before the shuffle, so copies cost one row each
    spread = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    judged = spans.join(spread, "hash").withColumn("live", (F.col("owners") < common_owners) & (F.col("repositories") < common_owners * 2))
    kept = judged.filter((F.col("kind") < BASE_KINDS) | F.col("live"))
    lists = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), "live"))).alias("spans"))  # of one document
    empty = F.array().cast(lists.schema["spans"].dataType)
    return rows.join(lists, "rid", "left").select("rid", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("spans", empty).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def repository_of_source() -> Column:
    """Documents name a source: it is the owner, and its texts of one language are a repository of it."""
    return F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit("/"), F.coalesce(F.col("lang"), F.lit("")))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, all spans as text, and how many look live or copied."""
    spans = F.col("spans")

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(spans, test)).cast("long")

    def of(kind: int) -> Column:
        return count(lambda s: s["kind"] == kind)

    return scanned.select(
        "doc_id", *[of(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)],
        F.sha2(_written(F.filter(spans, lambda s: s["kind"] < BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        _written(spans).alias("spans"), count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs, with every span of the text replaced by a mark; spans that overlap become one. Other columns are unchanged.

    Texts without a candidate pass by; only the others are stored and joined with their spans.
    """
    any_kind = F.lit(False)
    for pattern in (ASSIGN, ACCESS, HEX, KEY):
        any_kind = any_kind | F.coalesce(F.col(text), F.lit("")).rlike(pattern)
    touched = stored(docs.filter(any_kind).withColumn("_row", F.monotonically_increasing_id()))
    named = touched.select("_row", F.col(text).alias("_text"), repository.alias("_repository"), owner.alias("_owner"))
    found = scan(named, F.col("_repository"), F.col("_owner"), "_text", keep=("_row",)).select("_row", F.col("spans").alias("_spans"))
    begin = F.aggregate("_spans", F.array(F.lit(0).cast("long")), lambda done, s: F.concat(done, F.array(F.greatest(F.element_at(done, -1), s["end"]))))
    numbers = F.sequence(F.lit(1), F.size("_spans"))
    cut = touched.join(found, "_row").withColumn("_done", begin)

    def piece(i: Column) -> Column:
        """The text before a span, and the mark; nothing where an earlier span reaches over its start."""
        start, done = F.element_at("_spans", i)["start"], F.element_at("_done", i)
        gap = F.substring(F.col(text), (done + 1).cast("int"), (start - done).cast("int"))
        return F.when((i == 1) | (start >= done), F.concat(gap, F.lit(mark))).otherwise("")

    tail = F.substring(F.col(text), (F.element_at("_done", -1) + 1).cast("int"), F.length(text))
    cleaned = F.when(F.size("_spans") > 0, F.concat(F.array_join(F.transform(numbers, piece), ""), tail)).otherwise(F.col(text))
    return docs.filter(~any_kind).unionByName(cut.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns]))


_SPLIT = "SELECT rid, source, lang, {kind} AS kind, '{name}' AS name, unnest(range(1, len(m) + 1)) AS i, string_split_regex(t, {pattern}) AS gaps, m, v FROM (SELECT *, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {group}) AS v FROM d)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
m AS (
{" UNION ALL ".join(_SPLIT.format(kind=k, name=KINDS[k], pattern=_sql(p), group=g) for k, (p, g) in enumerate(((ASSIGN, 1), (ACCESS, 0), (HEX, 0), (KEY, 0))))}
),
p AS (
  SELECT rid, source, lang, kind, name, length(m[i]) AS long, v[i] AS value,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM m
),
s AS (SELECT *, start + long AS stop FROM p WHERE CASE kind WHEN 0 THEN length(value) >= {LEAST_ASSIGNED} WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
f AS (SELECT value, count(DISTINCT source) < {COMMON_OWNERS} AND count(DISTINCT source || '/' || lang) < {2 * COMMON_OWNERS} AS live FROM s GROUP BY value),
k AS (SELECT s.*, live, name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS written FROM s JOIN f USING (value) WHERE kind < {BASE_KINDS} OR live),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(written, ',' ORDER BY start, kind) FILTER (kind < {BASE_KINDS}) AS base, string_agg(written, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM k GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (rid)
"""
