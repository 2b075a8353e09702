"""Registered queries: bitemporal reads, revisions, keys and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quality, sql_functions
from tidemark.operators import temporal as T
from tidemark.operators.intervals import as_of_cutoffs
from tidemark.operators.corpus import eligible_fixtures, training_corpus
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import DAY_US, HOUR_US

CUT = 1705276800000000  # 2024-01-15
CUTS = (1704672000000000, CUT, 1705881600000000, 1706486400000000)
ASOF = 883612800000000  # 1998-01-01


def history(spark, sf_dir) -> DataFrame:
    return T.history_from_log(views.revlog(spark, sf_dir), ["key_id", "source"], ["p1"], ["event_id"])


# Canonical tables derived from matches: fixtures never move, their schedule,
# results and statistics are revised.
def canonical(spark, sf_dir) -> dict[str, DataFrame]:
    m = views.matches(spark, sf_dir)
    schedule = m.selectExpr("id AS fixture_id", f"""explode(CASE WHEN id % 5 = 0 THEN array(
        struct(k - {DAY_US} AS kickoff, 'scheduled' AS status, 'A' AS source, k - {30 * DAY_US} AS known_at, k - {10 * DAY_US} AS superseded_at),
        struct(k AS kickoff, 'ft' AS status, 'A' AS source, k - {10 * DAY_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at))
        ELSE array(struct(k AS kickoff, 'ft' AS status, 'A' AS source, k - {30 * DAY_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at)) END) AS r
        """).select("fixture_id", "r.*")
    results = m.selectExpr("id AS fixture_id", "id % 50 <> 0 AS is_trainable", f"""explode(CASE WHEN id % 7 = 0 THEN array(
        struct(hg AS ft_home, ag + 1 AS ft_away, k + {2 * HOUR_US} AS known_at, k + {50 * HOUR_US} AS superseded_at),
        struct(hg AS ft_home, ag AS ft_away, k + {50 * HOUR_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at))
        ELSE array(struct(hg AS ft_home, ag AS ft_away, k + {2 * HOUR_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at)) END) AS r""",
        f"CASE WHEN id % 3 = 0 THEN k + {HOUR_US} END AS occurred_at").select("fixture_id", "is_trainable", "r.*", "occurred_at", F.lit("A").alias("source"))
    stats = m.selectExpr("id AS fixture_id", "'A' AS source", "CAST(hg * 3 + id % 7 AS INT) AS home_shots", "CAST(ag * 3 + id % 5 AS INT) AS away_shots",
        f"k + {72 * HOUR_US} AS known_at", f"CASE WHEN id % 11 = 0 THEN k + {240 * HOUR_US} END AS superseded_at")
    return {
        "fixtures": m.selectExpr("id AS fixture_id", "concat(scope, '/', season) AS season_id", "home AS home_team_id", "away AS away_team_id"),
        "schedule": schedule, "results": results, "stats": stats,
        "seasons": m.selectExpr("concat(scope, '/', season) AS season_id", "scope AS competition_id", "CAST(season AS STRING) AS label").distinct(),
        "competitions": m.selectExpr("scope AS competition_id", "lower(scope) AS slug").distinct(),
        "names": m.select(F.explode(F.array("home", "away")).alias("team_id")).distinct().selectExpr(
            "team_id", """explode(array(
            struct(concat('T', lpad(CAST(team_id AS STRING), 2, '0')) AS name, 'official' AS name_type, DATE'1998-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to),
            struct(concat('Old T', team_id) AS name, 'official' AS name_type, DATE'1990-01-01' AS valid_from, DATE'1998-01-01' AS valid_to),
            struct(concat('Team ', team_id) AS name, 'common' AS name_type, DATE'1990-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to))) AS n""").select("team_id", "n.*"),
    }


CANONICAL_SQL = f"""+ sched AS (SELECT id AS fixture_id, k - {DAY_US} AS kickoff, 'scheduled' AS status, 'A' AS source, k - {30 * DAY_US} AS known_at,
  k - {10 * DAY_US} AS superseded_at FROM m WHERE id % 5 = 0
  UNION ALL SELECT id, k, 'ft', 'A', k - CASE WHEN id % 5 = 0 THEN 10 ELSE 30 END * {DAY_US}, NULL FROM m),
 res AS (SELECT id AS fixture_id, id % 50 <> 0 AS is_trainable, hg AS ft_home, ag + 1 AS ft_away, k + {2 * HOUR_US} AS known_at,
  k + {50 * HOUR_US} AS superseded_at, CASE WHEN id % 3 = 0 THEN k + {HOUR_US} END AS occurred_at FROM m WHERE id % 7 = 0
  UNION ALL SELECT id, id % 50 <> 0, hg, ag, k + CASE WHEN id % 7 = 0 THEN 50 ELSE 2 END * {HOUR_US}, NULL,
  CASE WHEN id % 3 = 0 THEN k + {HOUR_US} END FROM m),
 st AS (SELECT id AS fixture_id, CAST(hg * 3 + id % 7 AS INT) AS home_shots, CAST(ag * 3 + id % 5 AS INT) AS away_shots,
  k + {72 * HOUR_US} AS known_at, CASE WHEN id % 11 = 0 THEN k + {240 * HOUR_US} END AS superseded_at FROM m)
"""


def _vis(cut: int | str, alias: str = "") -> str:
    return f"{alias}known_at <= {cut} AND ({alias}superseded_at IS NULL OR {alias}superseded_at > {cut})"


@query("history_from_log", ["rev"], "SELECT key_id, source, p1, known_at, superseded_at FROM rev")
def history_from_log(spark, sf_dir):
    return history(spark, sf_dir).select("key_id", "source", "p1", "known_at", "superseded_at")


@query("visible_at", ["rev"], f"SELECT key_id, source, p1, known_at, ({_vis(CUT)}) AS visible FROM rev")
def visible_at(spark, sf_dir):
    return history(spark, sf_dir).select(
        "key_id", "source", "p1", "known_at", T.visible_at("known_at", "superseded_at", CUT).alias("visible")
    )


@query("current_rows", ["rev"], "SELECT key_id, source, p1, known_at FROM rev WHERE superseded_at IS NULL")
def current_rows(spark, sf_dir):
    return T.current_rows(history(spark, sf_dir)).select("key_id", "source", "p1", "known_at")


@query("sql_as_of", ["rev"], f"SELECT source, count(*) AS n, CAST(sum(p1) AS BIGINT) AS p1 FROM rev WHERE {_vis(CUT)} GROUP BY source")
def sql_as_of(spark, sf_dir):
    """The same read through the SQL table function."""
    sql_functions.register(spark, {"fact_history": history(spark, sf_dir)})
    return spark.sql(f"SELECT source, count(*) AS n, sum(p1) AS p1 FROM fact_history_as_of({CUT}) GROUP BY source")


@query("as_of_multi_cutoff", ["rev"], "SELECT c AS cutoff, key_id, source, count(*) AS revisions, max(p1) AS p1 FROM rev JOIN (VALUES "
       + ", ".join(f"({c})" for c in CUTS) + f") AS x(c) ON {_vis('c')} GROUP BY ALL")
def as_of_multi_cutoff(spark, sf_dir):
    return T.as_of_many(history(spark, sf_dir), CUTS).groupBy("cutoff", "key_id", "source").agg(
        F.count(F.lit(1)).alias("revisions"), F.max("p1").alias("p1")
    )


@query("as_of_cutoff_table", ["rev", "ticks"], f"""+ cuts AS (SELECT DISTINCT known_at // 60000000 * 60000000 AS cutoff FROM ticks)
 SELECT cutoff, count(*) AS visible, count(DISTINCT (key_id, source)) AS keys, CAST(sum(p1) AS BIGINT) AS p1 FROM rev JOIN cuts ON {_vis('cutoff')} GROUP BY cutoff""")
def as_of_cutoff_table(spark, sf_dir):
    """The history at every minute at which a tick became known: one revision of each key at any cutoff."""
    cutoffs = views.ticks(spark, sf_dir).select((F.floor(F.col("known_at") / 60_000_000) * 60_000_000).alias("cutoff")).distinct()
    seen = as_of_cutoffs(history(spark, sf_dir), cutoffs, columns=["key_id", "source", "p1"])
    per_key = seen.groupBy("cutoff", "key_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("p1").alias("p1"))
    return per_key.groupBy("cutoff").agg(F.sum("n").alias("visible"), F.count(F.lit(1)).alias("keys"), F.sum("p1").alias("p1"))


@query("as_of_external_ids", ["mappings"], f"SELECT external_id, internal_id FROM mappings WHERE {_vis(CUT)}")
def as_of_external_ids(spark, sf_dir):
    return T.as_of(views.mappings(spark, sf_dir), CUT).select("external_id", "internal_id")


@query("as_of_fixture_schedule", ["m"], CANONICAL_SQL + f"SELECT fixture_id, kickoff, status FROM sched WHERE {_vis(ASOF)}")
def as_of_fixture_schedule(spark, sf_dir):
    return T.as_of(canonical(spark, sf_dir)["schedule"], ASOF).select("fixture_id", "kickoff", "status")


@query("as_of_match_results", ["m"], CANONICAL_SQL + f"SELECT fixture_id, ft_home, ft_away FROM res WHERE {_vis(ASOF)}")
def as_of_match_results(spark, sf_dir):
    return T.as_of(canonical(spark, sf_dir)["results"], ASOF).select("fixture_id", "ft_home", "ft_away")


@query("as_of_match_stats", ["m"], CANONICAL_SQL + f"SELECT fixture_id, home_shots, away_shots FROM st WHERE {_vis(ASOF)}")
def as_of_match_stats(spark, sf_dir):
    return T.as_of(canonical(spark, sf_dir)["stats"], ASOF).select("fixture_id", "home_shots", "away_shots")


@query("as_of_odds_ticks", ["ticks"], f"SELECT event_id, series_id, price_c FROM ticks WHERE {_vis(CUT)}")
def as_of_odds_ticks(spark, sf_dir):
    return T.as_of(views.ticks(spark, sf_dir), CUT).select("event_id", "series_id", "price_c")


# Stored forecasts with revisions: the identity is (fixture, profile); every fourth was regenerated a day later.
def stored_predictions(spark, sf_dir) -> DataFrame:
    return views.matches(spark, sf_dir).selectExpr("id AS fixture_id", "'production' AS profile", f"""explode(CASE WHEN id % 4 = 0 THEN array(
        struct(id % 90 AS p_home_pct, k - {3 * DAY_US} AS known_at, k - {2 * DAY_US} AS superseded_at),
        struct(id % 90 + 1 AS p_home_pct, k - {2 * DAY_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at))
        ELSE array(struct(id % 90 AS p_home_pct, k - {3 * DAY_US} AS known_at, CAST(NULL AS BIGINT) AS superseded_at)) END) AS r""",
        f"k - {4 * DAY_US} AS data_cutoff").select("fixture_id", "profile", "data_cutoff", "r.*")


PREDICTIONS_SQL = f"""+ pred AS (SELECT id AS fixture_id, 'production' AS profile, k - {4 * DAY_US} AS data_cutoff, id % 90 AS p_home_pct, k - {3 * DAY_US} AS known_at,
  CASE WHEN id % 4 = 0 THEN k - {2 * DAY_US} END AS superseded_at FROM m
  UNION ALL SELECT id, 'production', k - {4 * DAY_US}, id % 90 + 1, k - {2 * DAY_US}, NULL FROM m WHERE id % 4 = 0)
"""


@query("as_of_predictions", ["m"], PREDICTIONS_SQL + f"SELECT fixture_id, profile, p_home_pct FROM pred WHERE {_vis(ASOF)}")
def as_of_predictions(spark, sf_dir):
    return T.as_of(stored_predictions(spark, sf_dir), ASOF).select("fixture_id", "profile", "p_home_pct")


@query("name_valid_at", ["m"], """SELECT id, CASE WHEN k < 883612800000000 THEN concat('Old T', home) ELSE concat('T', lpad(CAST(home AS VARCHAR), 2, '0')) END AS home_name FROM m""")
def name_valid_at(spark, sf_dir):
    """The official name on the day of the match: an equi-join on team with a half-open date range."""
    tables = canonical(spark, sf_dir)
    names = tables["names"].filter("name_type = 'official'").withColumnRenamed("team_id", "home")
    m = views.matches(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_micros("k")))
    return m.join(names, "home").filter(T.valid_on("valid_from", "valid_to", "day")).select("id", F.col("name").alias("home_name"))


_TRAIN_SQL = CANONICAL_SQL + f"""SELECT r.fixture_id, lower(m.scope) AS competition, CAST(m.season AS VARCHAR) AS season, concat('T', lpad(CAST(m.home AS VARCHAR), 2, '0')) AS home_team,
 concat('T', lpad(CAST(m.away AS VARCHAR), 2, '0')) AS away_team, r.ft_home, r.ft_away, coalesce(r.occurred_at, s.kickoff) AS k
 FROM res r JOIN m ON m.id = r.fixture_id JOIN sched s ON s.fixture_id = r.fixture_id
 WHERE {_vis(ASOF, 'r.')} AND {_vis(ASOF, 's.')} AND r.is_trainable"""


@query("scan_observations", ["m"], _TRAIN_SQL + " AND m.scope = '1-URGENT' AND m.season IN (1996, 1997)")
def scan_observations(spark, sf_dir):
    return training_corpus(canonical(spark, sf_dir), "1-urgent", ["1996", "1997"], ASOF, "A")


@query("training_join", ["m"], _TRAIN_SQL)
def training_join(spark, sf_dir):
    return training_corpus(canonical(spark, sf_dir), None, None, ASOF, "A")


_ELIGIBLE_SQL = CANONICAL_SQL + f"""SELECT m.id AS fixture_id, lower(m.scope) AS competition, CAST(m.season AS VARCHAR) AS season, concat('T', lpad(CAST(m.home AS VARCHAR), 2, '0')) AS home_team,
 concat('T', lpad(CAST(m.away AS VARCHAR), 2, '0')) AS away_team, s.kickoff, s.status
 FROM m JOIN sched s ON s.fixture_id = m.id WHERE {_vis(ASOF, 's.')} AND s.kickoff >= {ASOF}"""


@query("scan_eligible", ["m"], _ELIGIBLE_SQL + " AND m.scope = '1-URGENT'")
def scan_eligible(spark, sf_dir):
    return eligible_fixtures(canonical(spark, sf_dir), "1-urgent", ASOF, ASOF)


@query("eligible_join", ["m"], _ELIGIBLE_SQL + " AND s.status = 'scheduled'")
def eligible_join(spark, sf_dir):
    return eligible_fixtures(canonical(spark, sf_dir), None, ASOF, ASOF, statuses=["scheduled"])


@query("season_in", ["m"], _ELIGIBLE_SQL + " AND m.season = 1998")
def season_in(spark, sf_dir):
    return eligible_fixtures(canonical(spark, sf_dir), None, ASOF, ASOF, ["1998"])


@query("role_playing_join", ["m"], """SELECT id, concat('T', lpad(CAST(home AS VARCHAR), 2, '0')) AS home_name,
 concat('T', lpad(CAST(away AS VARCHAR), 2, '0')) AS away_name FROM m""")
def role_playing_join(spark, sf_dir):
    names = canonical(spark, sf_dir)["names"].filter("name_type = 'official' AND valid_to IS NULL")
    home = names.select(F.col("team_id").alias("home"), F.col("name").alias("home_name"))
    away = names.select(F.col("team_id").alias("away"), F.col("name").alias("away_name"))
    return views.matches(spark, sf_dir).join(home, "home").join(away, "away").select("id", "home_name", "away_name")


@query("trainable_filter", ["m"], CANONICAL_SQL + "SELECT fixture_id, ft_home, ft_away, known_at FROM res WHERE is_trainable")
def trainable_filter(spark, sf_dir):
    return canonical(spark, sf_dir)["results"].filter("is_trainable").select("fixture_id", "ft_home", "ft_away", "known_at")


@query("coalesce_valid_time", ["m"], CANONICAL_SQL + """SELECT r.fixture_id, r.known_at, coalesce(r.occurred_at, m.k) AS valid_time FROM res r JOIN m ON m.id = r.fixture_id""")
def coalesce_valid_time(spark, sf_dir):
    m = views.matches(spark, sf_dir).select(F.col("id").alias("fixture_id"), "k")
    return canonical(spark, sf_dir)["results"].join(m, "fixture_id").select(
        "fixture_id", "known_at", F.coalesce("occurred_at", "k").alias("valid_time")
    )


@query("content_differs", ["ticks"], """SELECT event_id, (price_c IS DISTINCT FROM CASE WHEN event_id % 3 = 0 THEN 101 END
 OR is_available IS DISTINCT FROM true) AS differs FROM ticks""")
def content_differs(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    other = F.struct(F.when(F.col("event_id") % 3 == 0, F.lit(101)).cast("bigint"), F.lit(True))
    mine = F.struct(F.col("price_c").cast("bigint"), F.col("is_available"))
    return t.select("event_id", T.content_differs(mine, other).alias("differs"))


# Open revisions of (key, source) at the cutoff, then one batch of incoming rows per key and source.
def _open_at(spark, sf_dir, cut: int = CUT) -> DataFrame:
    log = views.revlog(spark, sf_dir).filter(F.col("known_at") <= cut)
    return T.history_from_log(log, ["key_id", "source"], ["p1"], ["event_id"]).select("key_id", "source", "p1", "known_at", "superseded_at")


def _incoming(spark, sf_dir, cut: int = CUT) -> DataFrame:
    late = views.revlog(spark, sf_dir).filter(F.col("known_at") > cut)
    return late.groupBy("key_id", "source").agg(F.max_by("p1", "known_at").alias("p1"), F.max("known_at").alias("known_at"))


REVISE_SQL = f"""+ log1 AS (SELECT *, lag(p1) OVER (PARTITION BY key_id, source ORDER BY known_at, event_id) AS prev FROM revlog WHERE known_at <= {CUT}),
 tab AS (SELECT key_id, source, p1, known_at, lead(known_at) OVER (PARTITION BY key_id, source ORDER BY known_at, event_id) AS superseded_at
  FROM log1 WHERE prev IS NULL OR prev <> p1),
 inc AS (SELECT key_id, source, max_by(p1, known_at) AS p1, max(known_at) AS known_at FROM revlog WHERE known_at > {CUT} GROUP BY ALL)
"""


@query("revise", ["revlog"], REVISE_SQL + """SELECT t.key_id, t.source, t.p1, t.known_at,
 CASE WHEN t.superseded_at IS NULL AND i.p1 <> t.p1 THEN i.known_at ELSE t.superseded_at END AS superseded_at FROM tab t LEFT JOIN inc i USING (key_id, source)
 UNION ALL SELECT i.key_id, i.source, i.p1, i.known_at, NULL FROM inc i LEFT JOIN tab t ON t.key_id = i.key_id AND t.source = i.source AND t.superseded_at IS NULL
 WHERE t.key_id IS NULL OR t.p1 <> i.p1""")
def revise(spark, sf_dir):
    return T.revise(_open_at(spark, sf_dir), _incoming(spark, sf_dir), ["key_id", "source"], ["p1"])


@query("store_prediction", ["revlog"], REVISE_SQL + """SELECT coalesce(i.key_id, t.key_id) AS key_id, coalesce(i.source, t.source) AS source,
 CASE WHEN i.key_id IS NULL THEN 'kept' WHEN t.key_id IS NULL THEN 'created' WHEN t.p1 = i.p1 THEN 'unchanged' ELSE 'revised' END AS outcome
 FROM (SELECT * FROM tab WHERE superseded_at IS NULL) t FULL JOIN inc i ON t.key_id = i.key_id AND t.source = i.source""")
def store_prediction(spark, sf_dir):
    """What storing a batch would do to each identity."""
    out = T.compare_revisions(_open_at(spark, sf_dir), _incoming(spark, sf_dir), ["key_id", "source"], ["p1"])
    return out.select(
        F.coalesce("new.key_id", "old.key_id").alias("key_id"), F.coalesce("new.source", "old.source").alias("source"), "outcome"
    )


def _revised(name: str, table: str, keys: tuple[str, ...], fields: tuple[tuple[str, str, str | None], ...], source: str):
    """Register a revision query: every third key arrives changed, every third equal, every third not at all.

    `fields`: name, kind and, unless the canonical table has it, an expression. Changed keys differ in one field, each field in turn.
    """
    payload = tuple(f for f, _, _ in fields)
    made = [f"CAST({expr} AS {kind}) AS {f}" for f, kind, expr in fields if expr]
    other = {"STRING": "concat({f}, 'x')", "BOOLEAN": "NOT {f}", "INT": "CAST(coalesce({f}, 0) + 1 AS INT)", "BIGINT": "{f} + 1"}
    change = [
        f"CASE WHEN fixture_id % 3 = 1 AND (fixture_id - 1) % {3 * len(fields)} = {3 * i} THEN {other[kind].format(f=f)} ELSE {f} END AS {f}"
        for i, (f, kind, _) in enumerate(fields)
    ]
    differs = " OR ".join(f"i.{f} IS DISTINCT FROM {{0}}.{f}" for f in payload)
    sql = CANONICAL_SQL + f""", w AS (SELECT {', '.join(['*', *made])} FROM {table}), cur AS (SELECT * FROM w WHERE superseded_at IS NULL),
 inc AS (SELECT fixture_id, {', '.join(change)}, known_at + {400 * DAY_US} AS known_at FROM cur WHERE fixture_id % 3 < 2)
 SELECT t.fixture_id, {', '.join('t.' + f for f in payload)}, t.known_at, CASE WHEN t.superseded_at IS NULL AND i.fixture_id IS NOT NULL
 AND ({differs.format('t')}) THEN i.known_at ELSE t.superseded_at END AS superseded_at
 FROM w t LEFT JOIN inc i USING (fixture_id)
 UNION ALL SELECT i.fixture_id, {', '.join('i.' + f for f in payload)}, i.known_at, NULL FROM inc i JOIN cur c USING (fixture_id) WHERE {differs.format('c')}"""

    @query(name, ["m"], sql)
    def run(spark, sf_dir):
        whole = canonical(spark, sf_dir)[source].selectExpr("*", *made)
        incoming = T.current_rows(whole).filter("fixture_id % 3 < 2").selectExpr(*keys, *change, f"known_at + {400 * DAY_US} AS known_at")
        out = T.revise(whole, incoming, keys, payload)
        return out.select("fixture_id", *payload, "known_at", "superseded_at")

    return run


_revised("revise_schedule", "sched", ("fixture_id",), (
    ("kickoff", "BIGINT", None), ("local_day", "BIGINT", f"(kickoff - kickoff % {DAY_US}) / {DAY_US}"), ("local_tz", "STRING", "'Europe/London'"),
    ("status", "STRING", None), ("is_neutral", "BOOLEAN", "fixture_id % 2 = 0"),
), "schedule")
_revised("revise_result", "res", ("fixture_id", "source"), (
    ("ft_home", "INT", None), ("ft_away", "INT", None), ("ht_home", "INT", "CASE WHEN fixture_id % 4 > 0 THEN 0 END"),
    ("ht_away", "INT", "CASE WHEN fixture_id % 4 > 0 THEN 0 END"), ("result_source", "STRING", "'played'"), ("is_trainable", "BOOLEAN", None),
), "results")
_revised("revise_stats", "st", ("fixture_id", "source"), (("home_shots", "INT", None), ("away_shots", "INT", None), *[
    (f"{side}_{what}", "INT", f"CASE WHEN fixture_id % 5 <> {i % 5} THEN fixture_id % {i + 2} END")
    for i, (what, side) in enumerate((what, side) for what in ("shots_on_target", "fouls", "corners", "yellow_cards", "red_cards") for side in ("home", "away"))
]), "stats")


@query("revise_tick", ["ticks"], f"""+ cur AS (SELECT series_id, source, observed_at, price_kind, price_c, is_available, known_at, superseded_at FROM ticks),
 inc AS (SELECT series_id, source, observed_at, price_kind, price_c + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS price_c, is_available, known_at + {DAY_US} AS known_at FROM ticks WHERE superseded_at IS NULL)
 SELECT t.series_id, t.source, t.observed_at, t.price_kind, t.price_c, t.known_at,
 CASE WHEN t.superseded_at IS NULL AND i.price_c IS DISTINCT FROM t.price_c THEN i.known_at ELSE t.superseded_at END AS superseded_at
 FROM cur t LEFT JOIN inc i USING (series_id, source, observed_at, price_kind)
 UNION ALL SELECT i.series_id, i.source, i.observed_at, i.price_kind, i.price_c, i.known_at, NULL FROM inc i
 JOIN cur c USING (series_id, source, observed_at, price_kind) WHERE c.superseded_at IS NULL AND i.price_c IS DISTINCT FROM c.price_c""")
def revise_tick(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    keys, payload = ["series_id", "source", "observed_at", "price_kind"], ["price_c", "is_available"]
    incoming = T.current_rows(t).selectExpr(
        *keys, "price_c + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS price_c", "is_available", f"known_at + {DAY_US} AS known_at"
    )
    return T.revise(t, incoming, keys, payload).select(*keys, "price_c", "known_at", "superseded_at")


@query("retract", ["ticks"], f"""SELECT event_id, price_c, known_at, CASE WHEN superseded_at IS NULL AND event_id % 10 = 3
 THEN known_at + {DAY_US} ELSE superseded_at END AS superseded_at FROM ticks""")
def retract(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    mistakes = t.filter("event_id % 10 = 3").select("event_id", (F.col("known_at") + DAY_US).alias("retracted_at"))
    return T.retract(t, mistakes, ["event_id"]).select("event_id", "price_c", "known_at", "superseded_at")


@query("supersede_and_remap", ["revlog"], REVISE_SQL + """, cur AS (SELECT * FROM tab WHERE superseded_at IS NULL)
 SELECT c.key_id, c.source, c.p1, c.known_at, CASE WHEN i.p1 <> c.p1 THEN i.known_at END AS superseded_at FROM cur c LEFT JOIN inc i USING (key_id, source)
 UNION ALL SELECT i.key_id, i.source, i.p1, i.known_at, NULL FROM inc i JOIN cur c USING (key_id, source) WHERE c.p1 <> i.p1""")
def supersede_and_remap(spark, sf_dir):
    """Close and open at one shared instant; an equal mapping is a no-op; unknown keys are left alone."""
    open_rows = T.current_rows(_open_at(spark, sf_dir))
    known = _incoming(spark, sf_dir).join(open_rows.select("key_id", "source"), ["key_id", "source"], "left_semi")
    return T.revise(open_rows, known, ["key_id", "source"], ["p1"])


@query("idempotent_rerun", ["revlog"], REVISE_SQL + """SELECT outcome, count(*) AS n FROM (
 SELECT CASE WHEN i.key_id IS NULL THEN 'kept' ELSE 'unchanged' END AS outcome
 FROM (SELECT DISTINCT key_id, source FROM revlog) a LEFT JOIN inc i USING (key_id, source)) GROUP BY outcome""")
def idempotent_rerun(spark, sf_dir):
    """The same batch a second time writes nothing."""
    incoming = _incoming(spark, sf_dir)
    once = T.revise(_open_at(spark, sf_dir), incoming, ["key_id", "source"], ["p1"])
    again = T.compare_revisions(once, incoming, ["key_id", "source"], ["p1"])
    return again.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("insert_identity", ["m"], """SELECT DISTINCT scope, season, home, away FROM m b WHERE NOT EXISTS
 (SELECT 1 FROM m a WHERE a.k < 883612800000000 AND a.scope = b.scope AND a.season = b.season AND a.home = b.home AND a.away = b.away)""")
def insert_identity(spark, sf_dir):
    """Fixture identities not yet present: matches known before 1998 against all matches."""
    m = views.matches(spark, sf_dir)
    keys = ["scope", "season", "home", "away"]
    fresh = T.insert_absent(m.filter("k < 883612800000000").select(*keys), m.select(*keys), keys)
    return fresh.withColumn("fixture_id", T.surrogate_id(keys)).select(*keys)


_SERIES_SQL = """+ s AS (SELECT DISTINCT id AS fixture_id, book, CASE WHEN id % 2 = 0 THEN 2.5 END AS line FROM books)
 SELECT fixture_id, book, CAST(line * 10 AS INT) AS line10 FROM s WHERE NOT (fixture_id % 3 = 0)"""


@query("get_or_create_series", ["books"], _SERIES_SQL)
def get_or_create_series(spark, sf_dir):
    """Series keys with a NULL-able line: those a third of the fixtures already have are not created again."""
    line = F.when(F.col("id") % 2 == 0, F.lit(2.5)).cast("decimal(6,2)")
    series = views.books(spark, sf_dir).select(F.col("id").alias("fixture_id"), "book", line.alias("line"))
    keys = ["fixture_id", "book", "line"]
    created = T.insert_absent(series.filter("fixture_id % 3 = 0"), series, keys)
    return created.select("fixture_id", "book", (F.col("line") * 10).cast("int").alias("line10"))


@query("null_safe_key", ["books"], """+ l AS (SELECT id, book, CASE WHEN book % 2 = 0 THEN book END AS line FROM books)
 SELECT a.id, a.book, count(*) AS matched FROM l a JOIN l b ON a.id = b.id AND a.line IS NOT DISTINCT FROM b.line GROUP BY ALL""")
def null_safe_key(spark, sf_dir):
    """Rows agreeing on a NULL-able key part: counted per key and joined back, never paired up."""
    rows = views.books(spark, sf_dir).select("id", "book", F.when(F.col("book") % 2 == 0, F.col("book")).alias("line"))
    counts = rows.groupBy("id", "line").agg(F.count(F.lit(1)).alias("matched"))
    return T.null_safe_join(rows, counts, ["id", "line"], "inner").select("id", "book", "matched")


@query("anti_insert", ["refs", "aliases"], """SELECT DISTINCT lower(trim(name)) AS alias_norm FROM refs WHERE NOT EXISTS
 (SELECT 1 FROM aliases a WHERE a.alias_norm = lower(trim(refs.name)) AND a.source = 'A')""")
def anti_insert(spark, sf_dir):
    incoming = views.refs(spark, sf_dir).select(F.lower(F.trim("name")).alias("alias_norm"), F.lit("A").alias("source"))
    return T.insert_absent(views.aliases(spark, sf_dir), incoming, ["alias_norm", "source"]).select("alias_norm")


@query("source_disagreement", ["rev"], """+ cur AS (SELECT key_id, source, p1 FROM rev WHERE superseded_at IS NULL),
 d AS (SELECT key_id FROM cur GROUP BY key_id HAVING min(p1) <> max(p1)) SELECT key_id, source, p1 FROM cur WHERE key_id IN (SELECT key_id FROM d)""")
def source_disagreement(spark, sf_dir):
    """Open rows of every key on which the sources disagree; found per key, so sources are never paired."""
    rows = T.current_rows(history(spark, sf_dir)).select("key_id", "source", "p1")
    split = rows.groupBy("key_id").agg(F.min("p1").alias("lo"), F.max("p1").alias("hi")).filter(~F.col("lo").eqNullSafe(F.col("hi")))
    return rows.join(split.select("key_id"), "key_id", "left_semi")


@query("cross_join_seed", None, """SELECT o_orderkey AS id, CAST(i AS BIGINT) AS step, epoch_us(o_orderdate) + i * 60000000 AS at
 FROM orders, LATERAL (SELECT unnest(range(o_orderkey % 4 + 1)) AS i)""")
def cross_join_seed(spark, sf_dir):
    """Bulk rows per order from a bounded sequence instead of a cross join."""
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{views.micros('o_orderdate')} AS at0")
    return o.select("id", "at0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") % 4)).alias("step")).selectExpr(
        "id", "step", "at0 + step * 60000000 AS at"
    )


@query("duplicate_current", ["ticks"], """SELECT series_id, source, count(*) AS n FROM ticks WHERE superseded_at IS NULL
 GROUP BY ALL HAVING count(*) > 1""")
def duplicate_current(spark, sf_dir):
    return quality.duplicate_current(views.ticks(spark, sf_dir), ["series_id", "source"])


@query("assert_current_unique", ["rev"], """SELECT key_id, source, count(*) AS n FROM rev WHERE superseded_at IS NULL OR key_id % 10 = 0
 GROUP BY ALL HAVING count(*) > 1""")
def assert_current_unique(spark, sf_dir):
    """Every tenth key has lost its close times, so all its revisions look open."""
    closed = F.when(F.col("key_id") % 10 != 0, F.col("superseded_at"))
    return quality.duplicate_current(history(spark, sf_dir).withColumn("superseded_at", closed), ["key_id", "source"])


@query("orphans", None, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id")
    return quality.orphans(documents, "doc_id", views.table(spark, sf_dir, "labels"), "doc_id")


@query("assert_foreign_keys", None, """SELECT kind, count(*) AS n FROM (
 SELECT 'labels' AS kind FROM labels WHERE doc_id + 700 NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'lineitem' FROM lineitem WHERE l_orderkey + 5000 NOT IN (SELECT o_orderkey FROM orders)) GROUP BY kind""")
def assert_foreign_keys(spark, sf_dir):
    """Typed references checked against the union of their registries; shifted so that some are broken."""
    labels = views.table(spark, sf_dir, "labels").select(F.lit("labels").alias("entity_type"), (F.col("doc_id") + 700).alias("internal_id"))
    items = views.table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("entity_type"), (F.col("l_orderkey") + 5000).alias("internal_id"))
    registries = {
        "labels": (views.table(spark, sf_dir, "documents"), "doc_id"),
        "lineitem": (views.table(spark, sf_dir, "orders"), "o_orderkey"),
    }
    lost = quality.polymorphic_orphans(labels.unionByName(items), registries)
    return lost.groupBy(F.col("entity_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("assert_immutable", ["ticks"], "SELECT event_id FROM ticks WHERE event_id % 17 = 0 AND price_c IS NOT NULL")
def assert_immutable(spark, sf_dir):
    """A second snapshot in which every seventeenth price was rewritten."""
    t = views.ticks(spark, sf_dir)
    after = t.withColumn("price_c", F.when(F.col("event_id") % 17 == 0, F.col("price_c") + 1).otherwise(F.col("price_c")))
    return quality.rewritten(t, after, ["event_id"], ["series_id", "observed_at", "price_c"]).select("event_id")


@query("assert_months_contiguous", ["m"], """+ mo AS (SELECT DISTINCT date_trunc('month', make_timestamp(k)) AS mo FROM m WHERE month(make_timestamp(k)) <> 7)
 SELECT CAST(x AS DATE) AS month FROM (SELECT unnest(generate_series((SELECT min(mo) FROM mo), (SELECT max(mo) FROM mo), INTERVAL 1 MONTH)) AS x)
 WHERE x NOT IN (SELECT mo FROM mo)""")
def assert_months_contiguous(spark, sf_dir):
    rows = views.matches(spark, sf_dir).filter(F.month(F.timestamp_micros("k")) != 7)
    return quality.missing_months(rows, "k")


@query("assert_interval_order", ["ticks"], f"SELECT event_id FROM ticks WHERE superseded_at - {2 * DAY_US} * (event_id % 2) <= known_at")
def assert_interval_order(spark, sf_dir):
    broken = views.ticks(spark, sf_dir).withColumn("superseded_at", F.col("superseded_at") - F.lit(2 * DAY_US) * (F.col("event_id") % 2))
    return quality.inverted(broken).select("event_id")


@query("assert_no_overlap", ["rev"], """+ x AS (SELECT key_id, source, known_at, superseded_at + CASE WHEN key_id % 10 = 0 THEN 3600000000 ELSE 0 END AS superseded_at FROM rev),
 y AS (SELECT *, lead(known_at) OVER (PARTITION BY key_id, source ORDER BY known_at) AS nxt FROM x)
 SELECT key_id, source, known_at FROM y WHERE nxt IS NOT NULL AND (superseded_at IS NULL OR superseded_at > nxt)""")
def assert_no_overlap(spark, sf_dir):
    """Revisions of every tenth key are closed an hour too late."""
    late = F.when(F.col("key_id") % 10 == 0, F.lit(HOUR_US)).otherwise(F.lit(0))
    rows = history(spark, sf_dir).withColumn("superseded_at", F.col("superseded_at") + late)
    return quality.overlapping(rows, ["key_id", "source"]).select("key_id", "source", "known_at")


@query("assert_provenance", ["bodies"], """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'incomplete' ELSE 'body not archived' END AS reason
 FROM bodies WHERE doc_id % 9 = 0 OR (doc_id % 9 <> 0 AND body_hash NOT IN (SELECT body_hash FROM bodies WHERE source = (SELECT min(source) FROM bodies)))""")
def assert_provenance(spark, sf_dir):
    """Facts over documents: every ninth lacks a source; only the first source's bodies count as archived."""
    b = views.bodies(spark, sf_dir)
    first = b.agg(F.min("source").alias("source"))
    facts = b.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"), "body_hash", F.col("fetched_at").alias("known_at"))
    return quality.without_provenance(facts, b.join(first, "source", "left_semi")).select("doc_id", "reason")


@query("snapshot_diff", ["m"], """SELECT id, 'hg' AS "column", CAST(hg AS VARCHAR) AS old, CAST(hg + 1 AS VARCHAR) AS new, id % 2 = 0 AS flagged FROM m WHERE id % 101 = 0
 UNION ALL SELECT id, c, CASE c WHEN 'hg' THEN CAST(hg AS VARCHAR) ELSE CAST(ag AS VARCHAR) END, NULL, false FROM m CROSS JOIN (VALUES ('hg'), ('ag')) v(c) WHERE id % 103 = 0 AND id % 101 <> 0
 UNION ALL SELECT id, 'ag', CAST(ag AS VARCHAR), NULL, false FROM m WHERE id % 103 = 0 AND id % 101 = 0 AND false""")
def snapshot_diff(spark, sf_dir):
    """Two pulls of the same matches: some scores rewritten, some rows gone."""
    m = views.matches(spark, sf_dir).select("id", "hg", "ag")
    after = m.filter("id % 103 <> 0 OR id % 101 = 0").select(
        "id", F.when(F.col("id") % 101 == 0, F.col("hg") + 1).otherwise(F.col("hg")).alias("hg"), "ag", (F.col("id") % 2 == 0).alias("changed")
    )
    return quality.snapshot_diff(m, after, ["id"], ["hg", "ag"], "changed")


_WORDS = ", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("manifest_hash", ["rev"], f"""+ h AS (SELECT key_id, sha256(concat_ws('|', source, CAST(known_at AS VARCHAR), CAST(p1 AS VARCHAR))) AS h FROM rev)
 SELECT key_id, count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_WORDS})) AS manifest FROM h GROUP BY key_id""")
def manifest_hash(spark, sf_dir):
    return quality.manifest_hash(history(spark, sf_dir), ["key_id"], ["source", "known_at", "p1"])
