"""Registered queries: identity resolution, registries, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators import temporal as T
from tidemark.plans import views
from tidemark.plans.registry import query

NOW = 1706486400000000

RESOLVE_SQL = r"""+ keys AS (SELECT DISTINCT name FROM refs),
 mp AS (SELECT external_id AS name, list(DISTINCT internal_id ORDER BY internal_id) AS ids FROM mappings GROUP BY 1),
 al AS (SELECT alias_norm, list(DISTINCT team_id ORDER BY team_id) AS ids FROM aliases WHERE source = 'A' OR source IS NULL GROUP BY 1),
 ans AS (SELECT k.name, coalesce(mp.ids, al.ids) AS ids, mp.ids IS NOT NULL AS by_mapping FROM keys k LEFT JOIN mp ON mp.name = k.name
  LEFT JOIN al ON al.alias_norm = lower(regexp_replace(k.name, '^\s+|\s+$', '', 'g'))),
 res AS (SELECT ref_id, r.name, ids, CASE WHEN ids IS NULL THEN 'unknown' WHEN len(ids) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome,
  CASE WHEN len(ids) = 1 THEN ids[1] END AS internal_id,
  CASE WHEN ids IS NULL THEN 'no mapping and no alias' WHEN by_mapping AND len(ids) = 1 THEN 'mapping' WHEN by_mapping THEN 'overlapping mappings'
  WHEN len(ids) = 1 THEN 'alias' ELSE 'alias matches several teams' END AS reason FROM refs r JOIN ans USING (name))
"""


def _resolver(spark, sf_dir):
    return views.mappings(spark, sf_dir), views.aliases(spark, sf_dir), "A", NOW


@query("resolve", ["refs", "mappings", "aliases"], RESOLVE_SQL + """SELECT ref_id, outcome, internal_id, reason,
 CASE WHEN outcome = 'ambiguous' THEN array_to_string(ids, ',') ELSE '' END AS candidates FROM res""")
def resolve(spark, sf_dir):
    out = I.resolve(views.refs(spark, sf_dir), "name", *_resolver(spark, sf_dir))
    return out.select("ref_id", "outcome", "internal_id", "reason", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"))


@query("alias_lookup", ["refs", "aliases"], r"""SELECT ref_id, count(DISTINCT team_id) AS teams, min(team_id) AS first_team FROM refs
 JOIN aliases ON alias_norm = lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) AND (source = 'A' OR source IS NULL) GROUP BY ref_id""")
def alias_lookup(spark, sf_dir):
    usable = views.aliases(spark, sf_dir).filter("source = 'A' OR source IS NULL")
    ids = I.distinct_ids(usable, "alias_norm", "team_id", "ids")
    named = views.refs(spark, sf_dir).withColumn("alias_norm", I.normalize_alias(F.col("name")))
    return named.join(ids, "alias_norm").select("ref_id", F.size("ids").cast("bigint").alias("teams"), F.get("ids", F.lit(0)).alias("first_team"))


@query("distinct_mapping", ["mappings"], "SELECT external_id, count(DISTINCT internal_id) AS n, min(internal_id) AS first_id FROM mappings GROUP BY external_id")
def distinct_mapping(spark, sf_dir):
    ids = I.distinct_ids(views.mappings(spark, sf_dir), "external_id", "internal_id", "ids")
    return ids.select("external_id", F.size("ids").cast("bigint").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))


def _sides(spark, sf_dir) -> DataFrame:
    """Pairs of neighbouring references play the two sides of a fixture."""
    refs = views.refs(spark, sf_dir)
    away = refs.select((F.col("ref_id") - 1).alias("ref_id"), F.col("name").alias("away_name"))
    return refs.withColumnRenamed("name", "home_name").join(away, "ref_id")


@query("resolve_sides", ["refs", "mappings", "aliases"], RESOLVE_SQL + """SELECT h.ref_id, CASE WHEN h.outcome <> 'resolved' THEN 'home: ' || h.outcome
 WHEN a.outcome <> 'resolved' THEN 'away: ' || a.outcome END AS failure, h.internal_id AS home_id, a.internal_id AS away_id
 FROM res h JOIN res a ON a.ref_id = h.ref_id + 1""")
def resolve_sides(spark, sf_dir):
    out = I.resolve_sides(_sides(spark, sf_dir), "home_name", "away_name", *_resolver(spark, sf_dir))
    return out.select("ref_id", "failure", F.col("home_internal_id").alias("home_id"), F.col("away_internal_id").alias("away_id"))


def _wanted(spark, sf_dir) -> DataFrame:
    """Mappings a resolution run asks for: one per distinct resolved spelling."""
    out = I.resolve(views.refs(spark, sf_dir), "name", *_resolver(spark, sf_dir)).filter("outcome = 'resolved'")
    return out.select(F.col("name").alias("external_id"), (F.col("internal_id") + F.when(F.length("name") % 3 == 0, 1).otherwise(0)).alias("internal_id")).distinct()


_ENSURE_SQL = RESOLVE_SQL + """, want AS (SELECT DISTINCT name AS external_id, internal_id + CASE WHEN length(name) % 3 = 0 THEN 1 ELSE 0 END AS internal_id FROM res WHERE outcome = 'resolved'),
 held AS (SELECT external_id, min(internal_id) AS lo, max(internal_id) AS hi FROM mappings WHERE superseded_at IS NULL GROUP BY 1),
 ens AS (SELECT w.external_id, w.internal_id, CASE WHEN lo IS NULL THEN 'created' WHEN lo = w.internal_id AND hi = lo THEN 'unchanged' ELSE 'conflict' END AS outcome, lo
  FROM want w LEFT JOIN held USING (external_id))
"""


@query("ensure_mapping", ["refs", "mappings", "aliases"], _ENSURE_SQL + "SELECT external_id, internal_id, outcome FROM ens")
def ensure_mapping(spark, sf_dir):
    return I.ensure_mappings(views.mappings(spark, sf_dir), _wanted(spark, sf_dir)).select("external_id", "internal_id", "outcome")


@query("conflict_report", ["refs", "mappings", "aliases"], _ENSURE_SQL + "SELECT external_id, internal_id, lo AS held FROM ens WHERE outcome = 'conflict'")
def conflict_report(spark, sf_dir):
    out = I.ensure_mappings(views.mappings(spark, sf_dir), _wanted(spark, sf_dir))
    return out.filter("outcome = 'conflict'").select("external_id", "internal_id", "held")


def _reviews(spark, sf_dir) -> DataFrame:
    out = I.resolve(views.refs(spark, sf_dir), "name", *_resolver(spark, sf_dir)).filter("outcome <> 'resolved'")
    return out.select(F.lit("team").alias("entity_type"), F.lit("A").alias("source"), F.col("name").alias("external_id"), "reason")


@query("file_review", ["refs", "mappings", "aliases"], RESOLVE_SQL + "SELECT DISTINCT name AS external_id, reason FROM res WHERE outcome <> 'resolved' AND length(name) % 2 = 0")
def file_review(spark, sf_dir):
    """Spellings of odd length already have an open item; a second run would file nothing."""
    items = _reviews(spark, sf_dir)
    queue = items.filter(F.length("external_id") % 2 == 1).select("entity_type", "source", "external_id", F.lit("open").alias("status"))
    return I.file_reviews(queue, items).select("external_id", "reason")


@query("resolution_job", ["refs", "mappings", "aliases"], _ENSURE_SQL + """, cnt AS (SELECT 'resolved' AS item, count(*) AS n FROM res WHERE outcome = 'resolved'
 UNION ALL SELECT 'ambiguous', count(*) FROM res WHERE outcome = 'ambiguous' UNION ALL SELECT 'unknown', count(*) FROM res WHERE outcome = 'unknown'
 UNION ALL SELECT 'mapping ' || outcome, count(*) FROM ens GROUP BY outcome
 UNION ALL SELECT 'review', count(DISTINCT name) FROM res WHERE outcome <> 'resolved') SELECT * FROM cnt""")
def resolution_job(spark, sf_dir):
    """Counts of one run: resolution outcomes, mapping decisions, review items."""
    answers = I.resolve(views.refs(spark, sf_dir), "name", *_resolver(spark, sf_dir)).groupBy(F.col("outcome").alias("item"))
    decided = I.ensure_mappings(views.mappings(spark, sf_dir), _wanted(spark, sf_dir))
    one = F.count(F.lit(1)).alias("n")
    reviews = _reviews(spark, sf_dir).select("external_id").distinct().agg(one).select(F.lit("review").alias("item"), "n")
    return answers.agg(one).unionByName(
        decided.groupBy(F.concat(F.lit("mapping "), F.col("outcome")).alias("item")).agg(one)
    ).unionByName(reviews)


@query("stable_mapping", ["mappings", "aliases"], """SELECT external_id, internal_id AS team_id FROM mappings
 WHERE internal_id - 200 NOT IN (SELECT team_id FROM aliases) OR CAST(substr(external_id, 8) AS INT) % 3 = 0""")
def stable_mapping(spark, sf_dir):
    """Mappings of entities 200 + n, whose current name is its alias except for every third, which was renamed."""
    m = views.mappings(spark, sf_dir).withColumn("internal_id", F.col("internal_id"))
    names = m.select("external_id").distinct().select(
        "external_id", F.when(F.substring("external_id", 8, 9).cast("int") % 3 == 0, F.concat("external_id", F.lit(" fc"))).otherwise(F.col("external_id")).alias("name")
    )
    aliases = views.aliases(spark, sf_dir).withColumn("team_id", F.col("team_id") + 200)
    return I.unstable_mappings(m, names, aliases).select("external_id", "team_id")


@query("match_candidates", ["m"], """+ b AS (SELECT id + 1000000 AS id, scope, home, away, k + (id % 9 - 4) * 86400000000 AS k FROM m WHERE id % 3 <> 0),
 j AS (SELECT m.id, count(b.id) AS n, CASE WHEN count(b.id) = 1 THEN min(b.id) END AS candidate FROM m LEFT JOIN b
  ON b.scope = m.scope AND b.home = m.home AND b.away = m.away AND b.k BETWEEN m.k - 3 * 86400000000 AND m.k + 3 * 86400000000 GROUP BY m.id)
 SELECT id, n, candidate, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'review' END AS decision FROM j""")
def match_candidates(spark, sf_dir):
    """A second provider's fixtures, moved by up to four days, against ours."""
    m = views.matches(spark, sf_dir).select("id", "scope", "home", "away", "k")
    theirs = m.filter("id % 3 <> 0").withColumns({"id": F.col("id") + 1000000, "k": F.col("k") + (F.col("id") % 9 - 4) * views.DAY_US})
    return I.match_candidates(m, theirs, ["scope", "home", "away"]).select("id", "n", "candidate", "decision")


@query("seed_registry", ["m"], "SELECT scope, season, count(*) AS rows FROM (SELECT DISTINCT scope, season FROM m) GROUP BY ALL")
def seed_registry(spark, sf_dir):
    """Seasons seeded from all matches onto those known before 1998: every natural key exactly once."""
    seasons = views.matches(spark, sf_dir).select("scope", "season", "k")
    registry = seasons.filter("k < 883612800000000").select("scope", "season").distinct()
    after = I.seed(registry, seasons.select("scope", "season"), ["scope", "season"])
    return after.groupBy("scope", "season").agg(F.count(F.lit(1)).alias("rows"))


@query("seed_alias_existing", ["aliases"], """+ t AS (SELECT lower(n_name) AS slug, n_nationkey AS team_id FROM nation WHERE n_nationkey % 4 <> 3),
 s AS (SELECT DISTINCT lower(n_name) AS slug, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE n_name || ' fc' END AS spelling, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'A' END AS source
  FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT s.slug, lower(spelling) AS alias_norm, s.source, t.slug IS NOT NULL AS attached FROM s LEFT JOIN t USING (slug)
 WHERE NOT EXISTS (SELECT 1 FROM aliases a WHERE a.alias_norm = lower(spelling) AND a.source IS NOT DISTINCT FROM s.source)""")
def seed_alias_existing(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation")
    teams = nation.filter("n_nationkey % 4 <> 3").selectExpr("lower(n_name) AS slug", "n_nationkey AS team_id")
    customer = views.table(spark, sf_dir, "customer")
    spellings = customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "lower(n_name) AS slug", "CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE concat(n_name, ' fc') END AS spelling",
        "CASE WHEN c_custkey % 3 <> 0 THEN 'A' END AS source",
    ).distinct()
    return I.seed_aliases_for_existing(teams, views.aliases(spark, sf_dir), spellings).select("slug", "alias_norm", "source", "attached")
