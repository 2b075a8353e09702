"""Registered queries: provider files, archive, scalar functions, record rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as X
from tidemark.functions.probability import with_markets
from tidemark.operators.quality import rule_violations
from tidemark.operators.shape import spread
from tidemark.operators.temporal import null_safe_join
from tidemark.plans import views
from tidemark.plans.jobs import staged
from tidemark.plans.registry import query, scaled, sql_scaled
from tidemark.session import shared_dir
from tidemark.sources import archive, matches_json, season_csv

LONDON = "Europe/London"
NOON_SQL = "date_trunc('day', make_timestamp(k)) + INTERVAL 12 HOUR + CAST(id % 4 AS INT) * INTERVAL 1 HOUR"

# Season files written from matches. Four layouts by file: plain; byte-order
# mark, CRLF, reordered columns and an unknown one; no Time and short years;
# quoted names with commas. Every so many rows carries a defect.
_PLAIN = ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST",
          "B365CH", "B365CD", "B365CA", "BWCH", "PC>2.5", "PC<2.5", "AHCh", "PCAHH", "PCAHA", "MaxCH", "B365H")
_LAYOUTS = (
    _PLAIN,
    ("Xtra", "HomeTeam", "AwayTeam", *[c for c in _PLAIN if c not in ("HomeTeam", "AwayTeam", "BWCH")], "BWCH"),
    tuple(c for c in _PLAIN if c != "Time"),
    _PLAIN,
)


def season_documents(spark, sf_dir) -> DataFrame:
    """One text per 400 consecutive match ids: (file, text)."""
    blank = "id % 37 = 0"
    cells = {
        "Div": "'D1'",
        "Date": "CASE WHEN id % 43 = 0 THEN '31/02/1999' WHEN file % 4 = 2 THEN date_format(timestamp_micros(k), 'dd/MM/yy') ELSE date_format(timestamp_micros(k), 'dd/MM/yyyy') END",
        "Time": "concat(12 + id % 4, ':00')",
        "HomeTeam": f"CASE WHEN {blank} OR id % 47 = 0 THEN ' ' WHEN file % 4 = 3 THEN concat('\"T', home, ', FC\"') ELSE concat('T', home, ' ') END",
        "AwayTeam": f"CASE WHEN {blank} THEN '' WHEN file % 4 = 3 THEN concat('\"T', away, ', FC\"') ELSE concat('T', away) END",
        "FTHG": "CASE WHEN id % 41 = 0 THEN '' ELSE CAST(hg AS STRING) END", "FTAG": "CAST(ag AS STRING)",
        "HTHG": "CASE WHEN id % 67 = 0 THEN CAST(hg + 1 AS STRING) ELSE '0' END", "HTAG": "'0'",
        "HS": "CASE WHEN id % 53 = 0 THEN 'x' WHEN id % 5 = 0 THEN '' ELSE CAST(hg + 5 AS STRING) END",
        "AS": "CASE WHEN id % 5 = 0 THEN '' ELSE CAST(ag + 4 AS STRING) END",
        "HST": "CASE WHEN id % 5 = 0 THEN '' ELSE CAST(hg AS STRING) END", "AST": "CASE WHEN id % 5 = 0 THEN '' ELSE CAST(ag AS STRING) END",
        "B365CH": "CASE WHEN id % 59 = 0 THEN '' ELSE CAST(CAST(1.2 + (id * 7 % 200) / 100.0 AS DECIMAL(9,4)) AS STRING) END",
        "B365CD": "CAST(CAST(2.8 + (id * 3 % 120) / 100.0 AS DECIMAL(9,4)) AS STRING)",
        "B365CA": "CASE WHEN id % 61 = 0 THEN 'abc' ELSE CAST(CAST(1.5 + (id * 5 % 300) / 100.0 AS DECIMAL(9,4)) AS STRING) END",
        "BWCH": "CASE WHEN id % 2 = 0 THEN '1.95' ELSE '' END", "PC>2.5": "'1.9'", "PC<2.5": "'1.92'",
        "AHCh": "CASE WHEN id % 3 = 0 THEN '-0.5' ELSE '' END", "PCAHH": "'1.85'", "PCAHA": "'2.05'", "MaxCH": "'9.99'", "B365H": "'8.88'",
        "Xtra": "'?'",
    }
    line = "CASE " + " ".join(
        f"WHEN file % 4 = {i} THEN concat_ws(',', {', '.join(cells[c] for c in layout)})" for i, layout in enumerate(_LAYOUTS)
    ) + " END"
    header = "CASE " + " ".join(f"WHEN file % 4 = {i} THEN '{','.join(layout)}'" for i, layout in enumerate(_LAYOUTS)) + " END"
    dealt = spread(views.matches(spark, sf_dir).withColumn("file", F.floor(F.col("id") / 400)), "file")
    lines = dealt.selectExpr("file", "id", f"{line} AS line")
    body = lines.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda r: r["line"]).alias("lines"))
    return body.selectExpr(
        "file",
        f"concat(CASE WHEN file % 4 = 1 THEN '\\uFEFF' ELSE '' END, {header}, CASE WHEN file % 4 = 1 THEN '\\r\\n' ELSE '\\n' END, "
        "array_join(lines, CASE WHEN file % 4 = 1 THEN '\\r\\n' ELSE '\\n' END), '\\n\\n') AS text",
    )


def season_typed(spark, sf_dir) -> DataFrame:
    rows = season_csv.csv_rows(season_documents(spark, sf_dir), "file")
    return season_csv.season_rows(rows, F.lit(LONDON))


SEASON_SQL = f"""+ f AS (SELECT *, id // 400 AS file, 1 + row_number() OVER (PARTITION BY id // 400 ORDER BY id) AS "row" FROM m),
 t AS (SELECT *, concat('T', home, CASE WHEN file % 4 = 3 THEN ', FC' ELSE '' END) AS home_team,
  concat('T', away, CASE WHEN file % 4 = 3 THEN ', FC' ELSE '' END) AS away_team,
  CASE WHEN id % 47 = 0 THEN 'a side has no name' WHEN id % 41 = 0 THEN 'no full-time score' WHEN id % 43 = 0 THEN 'unreadable date or time' END AS problem,
  CASE WHEN id % 67 = 0 THEN 1 END AS bad_result, CASE WHEN id % 53 = 0 THEN 1 END AS bad_stats,
  epoch_us(timezone('Europe/London', date_trunc('day', make_timestamp(k)) + CASE WHEN file % 4 = 2 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR + CAST(id % 4 AS INT) * INTERVAL 1 HOUR END)) AS kick
  FROM f WHERE id % 37 <> 0)
"""


@query("scan_season_csv", ["m"], SEASON_SQL + """SELECT file, CAST("row" AS INT) AS "row", CASE WHEN id % 47 <> 0 THEN home_team END AS home_team, away_team,
 CASE WHEN id % 41 <> 0 THEN hg END AS ft_home, ag AS ft_away, problem FROM t""")
def scan_season_csv(spark, sf_dir):
    return season_typed(spark, sf_dir).select("file", "row", "home_team", "away_team", "ft_home", "ft_away", "problem")


@query("map_fixture_result", ["m"], SEASON_SQL + """SELECT file, CAST("row" AS INT) AS "row", home_team, away_team, kick AS kickoff_us,
 CAST(CAST(make_timestamp(k) AS DATE) AS VARCHAR) AS local_date, CASE WHEN bad_result IS NULL THEN hg END AS ft_home, CASE WHEN bad_result IS NULL THEN ag END AS ft_away,
 CASE WHEN bad_result IS NULL THEN 0 END AS ht_home FROM t WHERE problem IS NULL""")
def map_fixture_result(spark, sf_dir):
    typed = staged(season_typed(spark, sf_dir).drop("cells"), "season-typed")  # parsed once for both sides
    scores = season_csv.results(typed, "file").select("file", "row", "ft_home", "ft_away", "ht_home")
    return season_csv.fixtures(typed, "file").join(scores, ["file", "row"], "left").select(
        "file", "row", "home_team", "away_team", F.unix_micros("kickoff").alias("kickoff_us"),
        F.col("local_date").cast("string").alias("local_date"), "ft_home", "ft_away", "ht_home",
    )


@query("map_stats", ["m"], SEASON_SQL + """SELECT file, CAST("row" AS INT) AS "row", hg + 5 AS home_shots, ag + 4 AS away_shots, hg AS home_shots_on_target,
 ag AS away_shots_on_target FROM t WHERE problem IS NULL AND bad_result IS NULL AND bad_stats IS NULL AND id % 5 <> 0""")
def map_stats(spark, sf_dir):
    return season_csv.statistics(season_typed(spark, sf_dir), "file").select(
        "file", "row", "home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target"
    )


@query("unpivot_closing_odds", ["m"], SEASON_SQL + """, ok AS (SELECT * FROM t WHERE problem IS NULL AND bad_result IS NULL AND bad_stats IS NULL),
 q AS (SELECT file, "row", 'bet365' AS bookmaker, '1x2' AS market_type, NULL AS line100, 'home' AS selection, 12000 + id * 7 % 200 * 100 AS price_e4 FROM ok WHERE id % 59 <> 0
 UNION ALL SELECT file, "row", 'bet365', '1x2', NULL, 'draw', 28000 + id * 3 % 120 * 100 FROM ok
 UNION ALL SELECT file, "row", 'bet365', '1x2', NULL, 'away', 15000 + id * 5 % 300 * 100 FROM ok WHERE id % 61 <> 0
 UNION ALL SELECT file, "row", 'bwin', '1x2', NULL, 'home', 19500 FROM ok WHERE id % 2 = 0
 UNION ALL SELECT file, "row", 'pinnacle', 'over_under', 250, 'over', 19000 FROM ok
 UNION ALL SELECT file, "row", 'pinnacle', 'over_under', 250, 'under', 19200 FROM ok
 UNION ALL SELECT file, "row", 'pinnacle', 'asian_handicap', -50, 'home', 18500 FROM ok WHERE id % 3 = 0
 UNION ALL SELECT file, "row", 'pinnacle', 'asian_handicap', -50, 'away', 20500 FROM ok WHERE id % 3 = 0)
 SELECT file, CAST("row" AS INT) AS "row", bookmaker, market_type, CAST(line100 AS INT) AS line100, selection, CAST(price_e4 AS BIGINT) AS price_e4 FROM q""")
def unpivot_closing_odds(spark, sf_dir):
    return season_csv.closing_odds(season_typed(spark, sf_dir), "file").select(
        "file", "row", "bookmaker", "market_type", (F.col("line") * 100).cast("int").alias("line100"), "selection",
        (F.col("price") * 10000).cast("bigint").alias("price_e4"),
    )


# Match listings as JSON, one document per 200 consecutive ids; every tenth is
# not JSON, every eleventh has no array.
def match_documents(spark, sf_dir) -> DataFrame:
    entry = """CASE WHEN id % 71 = 0 THEN '17' ELSE to_json(named_struct(
      'id', id, 'utcDate', CASE WHEN id % 23 = 0 THEN 'not-a-date' WHEN id % 29 = 0 THEN date_format(timestamp_micros(k), "yyyy-MM-dd'T'HH:mm:ss") ELSE date_format(timestamp_micros(k), "yyyy-MM-dd'T'HH:mm:ss'Z'") END,
      'status', element_at(array('SCHEDULED', 'TIMED', 'FINISHED', 'POSTPONED', 'AWARDED', 'IN_PLAY'), CAST(id % 6 + 1 AS INT)),
      'stage', CASE WHEN id % 19 = 0 THEN 'SEMI_FINALS' WHEN id % 2 = 0 THEN 'REGULAR_SEASON' END,
      'season', named_struct('id', season, 'startDate', CASE WHEN id % 31 = 0 THEN CAST(NULL AS STRING) ELSE concat(season, '-08-01') END),
      'homeTeam', named_struct('id', home, 'name', CASE WHEN id % 17 = 0 THEN ' ' ELSE concat(' T', home) END),
      'awayTeam', named_struct('id', away, 'name', CASE WHEN id % 13 = 0 THEN concat('T', home) ELSE concat('T', away) END))) END"""
    rows = views.matches(spark, sf_dir).withColumn("doc", F.floor(F.col("id") / 200)).selectExpr("doc", "id", f"{entry} AS entry")
    body = rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "entry"))), lambda r: r["entry"]), ",").alias("body"))
    return body.selectExpr("doc", """CASE WHEN doc % 10 = 9 THEN concat('<html>', body) WHEN doc % 11 = 10 THEN concat('{"items":[', body, ']}')
        ELSE concat('{"matches":[', body, ']}') END AS text""")


MATCH_SQL = """+ d AS (SELECT *, id // 200 AS doc, CAST(row_number() OVER (PARTITION BY id // 200 ORDER BY id) - 1 AS INT) AS "position" FROM m),
 doc AS (SELECT DISTINCT doc, CASE WHEN doc % 10 = 9 THEN 'response is not JSON' WHEN doc % 11 = 10 THEN 'response has no matches array' END AS defect FROM d),
 t AS (SELECT d.doc, "position", id, home, away, season, k,
  (['scheduled', 'scheduled', 'ft', 'postponed', NULL, 'live'])[CAST(id % 6 + 1 AS INT)] AS status,
  CASE WHEN id % 17 <> 0 THEN concat('T', home) END AS home_team, CASE WHEN id % 13 = 0 THEN concat('T', home) ELSE concat('T', away) END AS away_team,
  CASE WHEN id % 71 = 0 THEN 'match entry is not an object' WHEN id % 19 = 0 THEN 'unsupported stage' WHEN id % 6 = 4 THEN 'status has no canonical equivalent'
  WHEN id % 17 = 0 THEN 'a side has no name' WHEN id % 13 = 0 THEN 'a team plays itself'
  WHEN id % 23 = 0 OR id % 29 = 0 THEN 'utcDate is not an instant with an offset' WHEN id % 31 = 0 THEN 'season has no startDate' END AS problem
  FROM d JOIN doc USING (doc) WHERE defect IS NULL)
"""


def _upcoming(spark, sf_dir) -> DataFrame:
    entries = matches_json.match_entries(match_documents(spark, sf_dir), "doc")
    return matches_json.upcoming_fixtures(entries, LONDON, "doc")


@query("scan_matches_json", ["m"], MATCH_SQL + """SELECT doc, "position", CASE WHEN id % 71 = 0 THEN 'match entry is not an object' END AS problem FROM t
 UNION ALL SELECT doc, NULL, defect FROM doc WHERE defect IS NOT NULL""")
def scan_matches_json(spark, sf_dir):
    return matches_json.match_entries(match_documents(spark, sf_dir), "doc").select("doc", "position", "problem")


@query("map_upcoming", ["m"], MATCH_SQL + """SELECT doc, "position", CAST(id AS VARCHAR) AS match_id, home_team, away_team, k AS kickoff_us,
 CAST(CAST(timezone('Europe/London', timezone('UTC', make_timestamp(k))) AS DATE) AS VARCHAR) AS local_date,
 concat(season, '/', lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) AS season, status FROM t WHERE problem IS NULL""")
def map_upcoming(spark, sf_dir):
    return _upcoming(spark, sf_dir).filter("problem IS NULL").select(
        "doc", "position", "match_id", "home_team", "away_team", F.unix_micros("kickoff").alias("kickoff_us"),
        F.col("local_date").cast("string").alias("local_date"), "season", "status",
    )


@query("map_upcoming_problems", ["m"], MATCH_SQL + """SELECT problem, count(*) AS n FROM (SELECT problem FROM t WHERE problem IS NOT NULL
 UNION ALL SELECT defect FROM doc WHERE defect IS NOT NULL) GROUP BY problem""")
def map_upcoming_problems(spark, sf_dir):
    return _upcoming(spark, sf_dir).filter("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("status_map", None, """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'live' WHEN 3 THEN 'live'
 WHEN 4 THEN 'suspended' WHEN 5 THEN 'ft' WHEN 6 THEN NULL ELSE NULL END AS status FROM events""")
def status_map(spark, sf_dir):
    given = F.element_at(
        F.array(*[F.lit(s) for s in ("SCHEDULED", "TIMED", "IN_PLAY", "PAUSED", "SUSPENDED", "FINISHED", "AWARDED")]),
        F.least(F.col("event_id") % 8 + 1, F.lit(7)).cast("int"),
    )
    status = F.when(F.col("event_id") % 8 < 7, given)
    return views.table(spark, sf_dir, "events").select("event_id", matches_json.map_status(status).alias("status"))


@query("stage_filter", None, "SELECT event_id FROM events WHERE event_id % 3 <> 1")
def stage_filter(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id")
    stage = F.when(F.col("event_id") % 3 == 0, "REGULAR_SEASON").when(F.col("event_id") % 3 == 1, "GROUP_STAGE")
    return e.filter(matches_json.stage_supported(stage))


def _meetings(spark, sf_dir) -> DataFrame:
    month = F.month(F.timestamp_micros("k")).cast("string")
    return views.matches(spark, sf_dir).select(
        "id", F.concat_ws("/", "scope", "season", month).alias("file"), F.col("home").alias("home_team"), F.col("away").alias("away_team"),
        F.lit(None).cast("string").alias("problem"),
    )


_MEET_SQL = "+ x AS (SELECT id, concat_ws('/', scope, season, month(make_timestamp(k))) AS file, home, away FROM m), c AS (SELECT file, home, away, count(*) AS n FROM x GROUP BY ALL)\n"


@query("pairing_counts", ["m"], "SELECT scope, season, home, away, count(*) AS n, count(*) > 1 AS repeated FROM m GROUP BY ALL")
def pairing_counts(spark, sf_dir):
    return views.matches(spark, sf_dir).groupBy("scope", "season", "home", "away").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "repeated", F.col("n") > 1
    )


@query("meeting_plan", ["m"], _MEET_SQL + "SELECT id, n > 1 AS refused FROM x JOIN c USING (file, home, away)")
def meeting_plan(spark, sf_dir):
    """Row policy: every row of a repeated pairing is refused, the rest of the scope stands."""
    out = matches_json.refuse_repeated(_meetings(spark, sf_dir), ["file"])
    return out.select("id", F.col("problem").isNotNull().alias("refused"))


@query("meeting_plan_scope", ["m"], _MEET_SQL + "SELECT id, (SELECT max(n) FROM c WHERE c.file = x.file) > 1 AS refused FROM x")
def meeting_plan_scope(spark, sf_dir):
    """Scope policy: one repeated pairing refuses the whole file."""
    out = matches_json.refuse_repeated(_meetings(spark, sf_dir), ["file"], "scope")
    return out.select("id", F.col("problem").isNotNull().alias("refused"))


# Scalar functions over strings derived from the tables.
@query("clean_text", None, r"""SELECT c_custkey, nullif(regexp_replace(CASE c_custkey % 4 WHEN 0 THEN chr(9) || c_name || ' ' WHEN 1 THEN '   ' WHEN 2 THEN c_name ELSE chr(10) END, '^\s+|\s+$', '', 'g'), '') AS cleaned FROM customer""")
def clean_text(spark, sf_dir):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(char(9), c_name, ' ') WHEN 1 THEN '   ' WHEN 2 THEN c_name ELSE char(10) END")
    return views.table(spark, sf_dir, "customer").select("c_custkey", X.clean_text(raw).alias("cleaned"))


@query("to_int_strict", None, """SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN CAST(event_id % 1000 AS INT) * CASE WHEN event_id % 5 = 2 THEN -1 ELSE 1 END END AS parsed,
 event_id % 5 IN (3, 4) AS is_bad FROM events""")
def to_int_strict(spark, sf_dir):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN concat(' ', event_id % 1000) WHEN 2 THEN concat('-', event_id % 1000) WHEN 3 THEN 'x1' ELSE '1.5' END")
    return views.table(spark, sf_dir, "events").select(
        "event_id", X.to_int(raw).alias("parsed"), F.coalesce(X.is_bad_int(raw), F.lit(False)).alias("is_bad")
    )


@query("to_decimal_lenient", None, """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS BIGINT) * 10000 + 12346 END AS e4 FROM events""")
def to_decimal_lenient(spark, sf_dir):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN concat(event_id % 1000 + 1, '.23456 ') WHEN 1 THEN '' ELSE 'n/a' END")
    return views.table(spark, sf_dir, "events").select("event_id", (X.to_decimal(raw) * 10000).cast("bigint").alias("e4"))


_LOCAL = "date_trunc('day', make_timestamp(k)) + CAST(id % 4 AS INT) * INTERVAL 1 HOUR + INTERVAL 30 MINUTE"


@query("parse_kickoff", ["m"], f"""+ l AS (SELECT id, {_LOCAL} AS t FROM m), u AS (SELECT id, t, timezone('Europe/London', t) AS u FROM l)
 SELECT id, epoch_us(CASE WHEN timezone('Europe/London', u - INTERVAL 1 HOUR) = t THEN u - INTERVAL 1 HOUR ELSE u END) AS kickoff_us,
 CAST(CAST(t AS DATE) AS VARCHAR) AS local_date FROM u""")
def parse_kickoff(spark, sf_dir):
    """London wall clock in both date formats, through every change of the clocks; an ambiguous hour is its first occurrence."""
    day = F.when(F.col("id") % 2 == 0, F.date_format(F.timestamp_micros("k"), "dd/MM/yyyy")).otherwise(
        F.date_format(F.timestamp_micros("k"), "d/M/yy")
    )
    out = views.matches(spark, sf_dir).select("id", X.parse_kickoff(day, F.concat(F.col("id") % 4, F.lit(":30")), F.lit(LONDON)).alias("w"))
    return out.select("id", F.unix_micros("w.kickoff").alias("kickoff_us"), F.col("w.local_date").cast("string").alias("local_date"))


@query("iso_utc", ["m"], """SELECT id, CASE id % 4 WHEN 0 THEN k WHEN 1 THEN k - 7200000000 END AS instant_us FROM m""")
def iso_utc(spark, sf_dir):
    text = F.expr("""CASE id % 4 WHEN 0 THEN date_format(timestamp_micros(k), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        WHEN 1 THEN date_format(timestamp_micros(k), "yyyy-MM-dd'T'HH:mm:ss'+02:00'") WHEN 2 THEN date_format(timestamp_micros(k), "yyyy-MM-dd'T'HH:mm:ss") ELSE 'soon' END""")
    return views.matches(spark, sf_dir).select("id", F.unix_micros(X.iso_instant(text)).alias("instant_us"))


@query("local_date", ["m"], """SELECT id, CASE WHEN id % 4 < 3 THEN CAST(CAST(timezone((['Europe/London', 'America/New_York', 'Asia/Tokyo'])[CAST(id % 4 + 1 AS INT)], timezone('UTC', make_timestamp(k))) AS DATE) AS VARCHAR) END AS local_date,
 id % 4 < 3 AS zone_known FROM m""")
def local_date(spark, sf_dir):
    zone = F.element_at(F.array(*[F.lit(z) for z in ("Europe/London", "America/New_York", "Asia/Tokyo", "Mars/Olympus")]), (F.col("id") % 4 + 1).cast("int"))
    return views.matches(spark, sf_dir).select(
        "id", X.local_date(F.timestamp_micros("k"), zone).cast("string").alias("local_date"), X.known_zone(zone).alias("zone_known")
    )


@query("season_label_folder", ["m"], """+ f AS (SELECT id, CASE WHEN id % 50 = 0 THEN '95x6' ELSE concat(lpad(CAST(season % 100 AS VARCHAR), 2, '0'), lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) END AS f, season FROM m)
 SELECT id, CASE WHEN id % 50 <> 0 THEN concat(season, '/', substr(f, 3, 2)) END AS label, CASE WHEN id % 50 <> 0 THEN season END AS start_year FROM f""")
def season_label_folder(spark, sf_dir):
    folder = F.expr("CASE WHEN id % 50 = 0 THEN '95x6' ELSE concat(lpad(season % 100, 2, '0'), lpad((season + 1) % 100, 2, '0')) END")
    out = views.matches(spark, sf_dir).select("id", X.season_of_folder(folder).alias("s"))
    return out.select("id", "s.label", "s.start_year")


@query("season_label_date", ["m"], """SELECT id, concat(year(make_timestamp(k)), '/', lpad(CAST((year(make_timestamp(k)) + 1) % 100 AS VARCHAR), 2, '0')) AS label FROM m""")
def season_label_date(spark, sf_dir):
    return views.matches(spark, sf_dir).select("id", X.season_of_date(F.to_date(F.timestamp_micros("k")))["label"].alias("label"))


@query("season_external_id", ["m"], "SELECT DISTINCT concat_ws('/', CAST(season AS VARCHAR), scope) AS external_id FROM m")
def season_external_id(spark, sf_dir):
    return views.matches(spark, sf_dir).select(X.season_external_id(F.col("season").cast("string"), F.col("scope")).alias("external_id")).distinct()


@query("normalize_alias", ["refs"], r"SELECT ref_id, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) AS alias FROM refs")
def normalize_alias(spark, sf_dir):
    return views.refs(spark, sf_dir).select("ref_id", X.normalize_alias(F.col("name")).alias("alias"))


@query("sha256_body", None, "SELECT page_id, sha256(html) AS body_hash FROM pages")
def sha256_body(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", X.body_hash(F.col("html")).alias("body_hash"))


@query("request_signature", None, """SELECT event_id, sha256('{"endpoint":"/v3/' || event_type || '","params":{"page":"' || event_id || '","user":"\\u00fc' || user_id || '"}}') AS signature FROM events""")
def request_signature(spark, sf_dir):
    """Credentials differ per row and must not matter; one parameter is not ASCII."""
    e = views.table(spark, sf_dir, "events")
    params = F.create_map(
        F.lit("user"), F.concat(F.lit("ü"), F.col("user_id")), F.lit("Api-Key"), F.col("value").cast("string"),
        F.lit("page"), F.col("event_id").cast("string"),
    )
    return e.select("event_id", X.request_signature(F.concat(F.lit(" /v3/"), F.col("event_type")), params).alias("signature"))


@query("scrub_params", None, """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"auth":{"Auth Token":"[REDACTED]","user":' || user_id || '},"list":[{"password":"[REDACTED]"}]}' AS scrubbed,
 '[REDACTED]' AS flat_key, event_type AS flat_kept FROM events""".replace('"auth":{', '"login":{'))
def scrub_params(spark, sf_dir):
    """Nested redaction of JSON text and flat redaction of a map."""
    e = views.table(spark, sf_dir, "events")
    nested = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"login":{"Auth Token":"abc","user":'), F.col("user_id"),
        F.lit('},"list":[{"password":"p"}]}'),
    )
    flat = X.scrub_map(F.create_map(F.lit("X-Api-Key"), F.col("props"), F.lit("type"), F.col("event_type")))
    return e.select("event_id", X.scrub_json(nested).alias("scrubbed"), flat["X-Api-Key"].alias("flat_key"), flat["type"].alias("flat_kept"))


@query("persistable_headers", None, """SELECT event_id, event_type AS content_type, CAST(event_id AS VARCHAR) AS etag, 2 AS kept FROM events""")
def persistable_headers(spark, sf_dir):
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    entries = F.array(
        header("Content-Type", F.col("event_type")), header("X-Session-Token", F.col("props")),
        header(" content-type", F.col("user_id")), header("ETag", F.col("event_id")),
    )
    out = views.table(spark, sf_dir, "events").select("event_id", X.persistable_headers(entries).alias("h"))
    return out.select("event_id", F.col("h")["content-type"].alias("content_type"), F.col("h")["etag"].alias("etag"), F.size("h").alias("kept"))


_STATUS = "CAST(([200, 204, 301, 400, 401, 403, 404, 407, 429, 500, 503])[CAST(event_id % 11 + 1 AS INT)] AS INT)"


@query("status_to_problem", None, f"""+ s AS (SELECT event_id, {_STATUS} AS status FROM events)""".replace("+ s", "WITH s") + """
 SELECT event_id, CASE WHEN status < 300 THEN NULL WHEN status IN (401, 407) THEN 'authentication' WHEN status = 403 THEN 'authorization'
 WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'provider_server' ELSE 'malformed_payload' END AS problem,
 status IN (429, 500, 503) AS transient FROM s""")
def status_to_problem(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 204, 301, 400, 401, 403, 404, 407, 429, 500, 503)]), (F.col("event_id") % 11 + 1).cast("int"))
    kind = X.status_to_problem(status)
    return views.table(spark, sf_dir, "events").select("event_id", kind.alias("problem"), X.is_transient(kind).alias("transient"))


# Archive and run log.
@query("archive_bodies", ["bodies"], """SELECT body_hash, min(fetched_at) AS first_seen_at, min(n_chars_body) AS n_chars FROM bodies
 WHERE body_hash NOT IN (SELECT body_hash FROM bodies WHERE doc_id % 5 = 0) GROUP BY body_hash""")
def archive_bodies(spark, sf_dir):
    """Documents as payloads; every fifth body is archived already."""
    docs = views.table(spark, sf_dir, "documents")
    fetched = docs.selectExpr("doc_id", "text AS body", f"{views.EPOCH_2024} + doc_id * {views.HOUR_US} AS fetched_at")
    archived = views.bodies(spark, sf_dir).filter("doc_id % 5 = 0").select("body_hash")
    return archive.new_bodies(archived, fetched).select("body_hash", "first_seen_at", F.length("body").alias("n_chars"))


@query("archive_observations", ["bodies"], "SELECT doc_id, body_hash, strftime(make_timestamp(fetched_at), '%Y-%m') AS year_month FROM bodies")
def archive_observations(spark, sf_dir):
    return views.bodies(spark, sf_dir).select("doc_id", "body_hash", archive.month_of(F.col("fetched_at")).alias("year_month"))


@query("partition_by_month", ["bodies"], "SELECT strftime(make_timestamp(fetched_at), '%Y-%m') AS year_month, count(*) AS n, count(DISTINCT body_hash) AS bodies FROM bodies GROUP BY 1")
def partition_by_month(spark, sf_dir):
    """The observation log written by month and read back."""
    path = f"{shared_dir(spark)}/observations-{uuid.uuid4().hex}"
    archive.append_observations(views.bodies(spark, sf_dir).select("doc_id", "body_hash", "fetched_at"), path)
    return spark.read.parquet(path).groupBy(F.col("year_month").cast("string").alias("year_month")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("body_hash").alias("bodies")
    )


@query("seen_counts", ["bodies"], "SELECT body_hash, count(*) AS seen_count, min(fetched_at) AS first_seen_at, max(fetched_at) AS last_seen_at FROM bodies GROUP BY body_hash")
def seen_counts(spark, sf_dir):
    return archive.seen_counts(views.bodies(spark, sf_dir))


def _runs(spark, sf_dir) -> DataFrame:
    """Run log: one attempt per (type, user, day), numbered by how many events came before on that day."""
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("event_type").alias("job_name"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("scope_key"), F.to_date("ts").alias("run_date")
    ).agg(F.count(F.lit(1)).cast("int").alias("attempt"))


_RUNS_SQL = "WITH runs AS (SELECT event_type AS job_name, 'u' || (user_id % 10) AS scope_key, CAST(ts AS DATE) AS run_date, CAST(count(*) AS INT) AS attempt FROM events GROUP BY ALL)\n"


@query("next_attempt", None, _RUNS_SQL + """, w AS (SELECT DISTINCT job_name, scope_key, run_date + CAST(attempt % 2 AS INT) AS run_date FROM runs)
 SELECT w.job_name, w.scope_key, CAST(w.run_date AS VARCHAR) AS run_date, coalesce(attempt, 0) + 1 AS attempt FROM w LEFT JOIN runs USING (job_name, scope_key, run_date)""")
def next_attempt(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    wanted = runs.select("job_name", "scope_key", F.date_add("run_date", F.col("attempt") % 2).alias("run_date")).distinct()
    return archive.next_attempt(runs, wanted).select("job_name", "scope_key", F.col("run_date").cast("string").alias("run_date"), "attempt")


@query("sink_job_run", None, _RUNS_SQL + """SELECT job_name, scope_key, CAST(run_date AS VARCHAR) AS run_date, attempt,
 CASE WHEN attempt % 5 = 0 THEN CASE WHEN attempt > 5 THEN 'partial' ELSE 'failed' END WHEN attempt % 3 = 0 THEN 'partial' ELSE 'ok' END AS status,
 '{"rows_accepted":' || attempt || ',"rows_rejected":' || CASE WHEN attempt % 3 = 0 THEN 1 ELSE 0 END || '}' AS stats FROM runs""")
def sink_job_run(spark, sf_dir):
    """Closed runs with terminal status and JSON counters."""
    runs = _runs(spark, sf_dir)
    rejected = F.when(F.col("attempt") % 3 == 0, 1).otherwise(0)
    accepted = F.when(F.col("attempt") > 5, F.col("attempt")).otherwise(0)
    status = archive.classify_run(F.col("attempt") % 5 != 0, accepted, rejected, F.lit(0))
    stats = F.to_json(F.struct(F.col("attempt").alias("rows_accepted"), rejected.alias("rows_rejected")))
    return runs.select("job_name", "scope_key", F.col("run_date").cast("string").alias("run_date"), "attempt", status.alias("status"), stats.alias("stats"))


@query("classify_run", None, """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 > 0 THEN 'partial' ELSE 'failed' END
 WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'partial' ELSE 'ok' END AS status FROM events""")
def classify_run(spark, sf_dir):
    e = F.col("event_id")
    status = archive.classify_run(e % 4 != 0, e % 3, F.when(e % 5 == 0, 1).otherwise(0), F.when(e % 7 == 0, 1).otherwise(0))
    return views.table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("run_counters", None, f"""WITH r AS (SELECT event_type AS run, CASE WHEN event_id % 17 <> 0 THEN {_STATUS} END AS status, CAST(floor(value) AS BIGINT) AS ms,
 event_id % 1000 AS bytes, event_id % 3 AS attempts FROM events),
 o AS (SELECT run, ms, row_number() OVER (PARTITION BY run ORDER BY ms) AS i, count(*) OVER (PARTITION BY run) AS n FROM r WHERE status IS NOT NULL),
 p AS (SELECT run, ms AS latency_p50 FROM o WHERE i = (n - 1) // 2 + 1)
 SELECT run, count(*) AS requests, CAST(sum(greatest(0, attempts - 1)) AS BIGINT) AS retries, count(*) FILTER (status IS NULL) AS timeouts,
 CAST(coalesce(sum(bytes) FILTER (status IS NOT NULL), 0) AS BIGINT) AS bytes, max(ms) FILTER (status IS NOT NULL) AS latency_max, any_value(latency_p50) AS latency_p50,
 count(*) FILTER (status = 404) AS not_found FROM r JOIN p USING (run) GROUP BY run""")
def run_counters(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 204, 301, 400, 401, 403, 404, 407, 429, 500, 503)]), (F.col("event_id") % 11 + 1).cast("int"))
    requests = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.when(F.col("event_id") % 17 != 0, status).alias("status"),
        F.floor("value").alias("elapsed_ms"), (F.col("event_id") % 1000).alias("bytes"), (F.col("event_id") % 3).alias("attempts"),
    )
    out = archive.run_counters(requests, ["run"])
    return out.select("run", "requests", "retries", "timeouts", "bytes", "latency_max", "latency_p50", F.col("http_status_counts")["404"].alias("not_found"))


@query("season_bounds", ["m"], "SELECT scope, season, CAST(min(CAST(make_timestamp(k) AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(make_timestamp(k) AS DATE)) AS VARCHAR) AS last_day FROM m GROUP BY ALL")
def season_bounds(spark, sf_dir):
    day = F.to_date(F.timestamp_micros("k"))
    return views.matches(spark, sf_dir).groupBy("scope", "season").agg(
        F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day")
    )


@query("scope_union", ["m"], "SELECT scope, season, id FROM m")
def scope_union(spark, sf_dir):
    """Several scopes as one corpus: the competitions asked for and all their seasons, in one scan."""
    return archive.in_scopes(views.matches(spark, sf_dir), views.matches(spark, sf_dir).select("scope", "season").distinct()).select("scope", "season", "id")


@query("latest_n", ["m"], "SELECT scope, id AS latest, k FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY k DESC, id DESC) AS i FROM m) WHERE i = 1")
def latest_n(spark, sf_dir):
    return views.matches(spark, sf_dir).groupBy("scope").agg(
        F.max_by("id", F.struct("k", "id")).alias("latest"), F.max("k").alias("k")
    )


@query("group_bundle", ["books"], """SELECT id, m.hg, m.ag, (m.id % 5 <> 0) AS has_stats, count(*) AS n_quotes,
 string_agg(book || ':' || home_c || '/' || draw_c || '/' || away_c, ',' ORDER BY book) AS quotes FROM m JOIN books USING (id) GROUP BY ALL""")
def group_bundle(spark, sf_dir):
    """One row per fixture with result, statistics flag and its books; the list is as long as the book catalogue."""
    m = views.matches(spark, sf_dir).select("id", "hg", "ag")
    quote = F.struct("book", F.concat_ws("/", "home_c", "draw_c", "away_c").alias("q"))
    quotes = views.books(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list(quote)).alias("q"))
    return m.join(quotes, "id").select(
        "id", "hg", "ag", (F.col("id") % 5 != 0).alias("has_stats"), F.size("q").cast("bigint").alias("n_quotes"),
        F.array_join(F.transform("q", lambda x: F.concat(x["book"], F.lit(":"), x["q"])), ",").alias("quotes"),
    )


# Record rules, over rows with planted defects.
@query("validate_fixture", ["m"], """SELECT id, 'unknown_zone' AS rule FROM m WHERE id % 20 = 1 UNION ALL SELECT id, 'local_date_disagrees' FROM m WHERE id % 20 = 2
 UNION ALL SELECT id, 'leg_out_of_range' FROM m WHERE id % 20 = 3 UNION ALL SELECT id, 'negative_replay' FROM m WHERE id % 20 = 4
 UNION ALL SELECT id, 'team_plays_itself' FROM m WHERE id % 20 = 5 UNION ALL SELECT id, 'unknown_status' FROM m WHERE id % 20 = 6
 UNION ALL SELECT id, 'kickoff_missing' FROM m WHERE id % 20 = 7""")
def validate_fixture(spark, sf_dir):
    rows = views.matches(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id % 20 <> 7 THEN timestamp_micros(k + 43200000000) END AS kickoff",
        "date_add(to_date(timestamp_micros(k)), CASE WHEN id % 20 = 2 THEN 1 ELSE 0 END) AS local_date",
        f"CASE WHEN id % 20 = 1 THEN 'Mars/Olympus' ELSE '{LONDON}' END AS local_tz",
        "CASE WHEN id % 20 = 3 THEN 3 ELSE 1 END AS leg", "CASE WHEN id % 20 = 4 THEN -1 ELSE 0 END AS replay_number",
        "home AS home_team", "CASE WHEN id % 20 = 5 THEN home ELSE away END AS away_team",
        "CASE WHEN id % 20 = 6 THEN 'awarded' ELSE 'ft' END AS status",
    )
    return rule_violations(rows, ["id"], R.fixture_rules())


@query("validate_result", ["m"], """+ r AS (SELECT id, hg, ag, CASE WHEN id % 9 = 1 THEN NULL ELSE hg END AS hh, CASE WHEN id % 9 = 2 THEN ag + 1 ELSE ag END AS ha FROM m)
 SELECT id, 'half_time_one_sided' AS rule FROM r WHERE id % 9 = 1 UNION ALL SELECT id, 'half_time_above_full_time' FROM r WHERE id % 9 = 2
 UNION ALL SELECT id, 'extra_time_below_full_time' FROM r WHERE id % 9 = 3 AND hg > 0 UNION ALL SELECT id, 'shootout_without_extra_time' FROM r WHERE id % 9 = 4
 UNION ALL SELECT id, 'shootout_level' FROM r WHERE id % 9 = 5 UNION ALL SELECT id, 'awarded_trainable' FROM r WHERE id % 9 = 6
 UNION ALL SELECT id, 'negative_score' FROM r WHERE id % 9 = 7 UNION ALL SELECT id, 'half_time_above_full_time' FROM r WHERE id % 9 = 7
 UNION ALL SELECT id, 'extra_time_one_sided' FROM r WHERE id % 9 = 8""")
def validate_result(spark, sf_dir):
    rows = views.matches(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id % 9 = 7 THEN -1 ELSE hg END AS ft_home", "ag AS ft_away",
        "CASE WHEN id % 9 = 1 THEN NULL ELSE hg END AS ht_home", "CASE WHEN id % 9 = 2 THEN ag + 1 ELSE ag END AS ht_away",
        "CASE WHEN id % 9 = 3 THEN 0 WHEN id % 9 IN (5, 8) THEN hg END AS aet_home", "CASE WHEN id % 9 IN (3, 5) THEN ag END AS aet_away",
        "CASE WHEN id % 9 IN (4, 5) THEN 4 END AS pens_home", "CASE WHEN id % 9 = 4 THEN 3 WHEN id % 9 = 5 THEN 4 END AS pens_away",
        "CASE WHEN id % 9 = 6 THEN 'awarded' ELSE 'played' END AS result_source", "true AS is_trainable",
    )
    return rule_violations(rows, ["id"], R.result_rules())


@query("validate_stats", ["m"], """SELECT id, 'negative_count' AS rule FROM m WHERE id % 7 = 1 UNION ALL SELECT id, 'home_on_target_above_shots' FROM m WHERE id % 7 IN (1, 2)
 UNION ALL SELECT id, 'possession_sum' FROM m WHERE id % 7 = 3 UNION ALL SELECT id, 'possession_one_sided' FROM m WHERE id % 7 = 4 UNION ALL SELECT id, 'negative_xg' FROM m WHERE id % 7 = 5""")
def validate_stats(spark, sf_dir):
    rows = views.matches(spark, sf_dir).selectExpr(
        "id", "CASE WHEN id % 7 = 1 THEN -1 ELSE hg + 3 END AS home_shots", "CASE WHEN id % 7 = 2 THEN hg + 4 ELSE hg END AS home_shots_on_target",
        "CAST(CASE WHEN id % 7 = 3 THEN 60 ELSE 50 END AS DECIMAL(5,2)) AS home_possession",
        "CAST(CASE WHEN id % 7 = 4 THEN NULL ELSE 50 END AS DECIMAL(5,2)) AS away_possession",
        "CAST(CASE WHEN id % 7 = 5 THEN -0.1 ELSE 1.2 END AS DECIMAL(6,3)) AS home_xg", "CAST(0.8 AS DECIMAL(6,3)) AS away_xg",
    )
    return rule_violations(rows, ["id"], R.stats_rules(rows.columns))


@query("validate_odds", ["books"], """SELECT id, book, 'line_missing' AS rule FROM books WHERE (id + book) % 11 = 1 UNION ALL SELECT id, book, 'line_forbidden' FROM books WHERE (id + book) % 11 = 2
 UNION ALL SELECT id, book, 'suspended_with_price' FROM books WHERE (id + book) % 11 = 3 UNION ALL SELECT id, book, 'price_out_of_range' FROM books WHERE (id + book) % 11 = 4
 UNION ALL SELECT id, book, 'lay_without_exchange' FROM books WHERE (id + book) % 11 = 5 UNION ALL SELECT id, book, 'convention_missing' FROM books WHERE (id + book) % 11 = 6
 UNION ALL SELECT id, book, 'unknown_market' FROM books WHERE (id + book) % 11 = 7""")
def validate_odds(spark, sf_dir):
    k = "(id + book) % 11"
    rows = views.books(spark, sf_dir).selectExpr(
        "id", "book", f"CASE WHEN {k} = 1 THEN 'over_under' WHEN {k} = 7 THEN 'corners' ELSE '1x2' END AS market_type",
        f"CAST(CASE WHEN {k} = 2 THEN 2.5 END AS DECIMAL(6,2)) AS line",
        f"CAST(CASE WHEN {k} = 4 THEN 1.0 ELSE home_c / 100 END AS DECIMAL(9,4)) AS price", f"{k} <> 3 AS is_available",
        f"CASE WHEN {k} = 5 THEN 'lay' ELSE 'back' END AS side", "'bookmaker' AS bookmaker_kind",
        "'provider_closing' AS price_kind", f"CASE WHEN {k} = 6 THEN '' ELSE 'kickoff' END AS convention",
    )
    return rule_violations(rows, ["id", "book"], R.odds_rules())


@query("validate_bookmaker", None, """SELECT s_suppkey, 'commission_without_exchange' AS rule FROM supplier WHERE s_suppkey % 5 IN (1, 2)
 UNION ALL SELECT s_suppkey, 'commission_out_of_range' FROM supplier WHERE s_suppkey % 5 = 2 UNION ALL SELECT s_suppkey, 'unknown_kind' FROM supplier WHERE s_suppkey % 5 = 3""")
def validate_bookmaker(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "CASE s_suppkey % 5 WHEN 3 THEN 'aggregator' WHEN 4 THEN 'exchange' ELSE 'bookmaker' END AS kind",
        "CAST(CASE s_suppkey % 5 WHEN 1 THEN 0.02 WHEN 2 THEN 1.5 WHEN 4 THEN 0.05 END AS DECIMAL(5,4)) AS commission_rate",
    )
    return rule_violations(rows, ["s_suppkey"], R.bookmaker_rules())


@query("validate_entities", None, """SELECT 'competition' AS entity, p_partkey AS id, 'unknown_type' AS rule FROM part WHERE p_partkey % 6 = 1
 UNION ALL SELECT 'competition', p_partkey, 'tier_below_one' FROM part WHERE p_partkey % 6 = 2 UNION ALL SELECT 'competition', p_partkey, 'unknown_gender' FROM part WHERE p_partkey % 6 = 3
 UNION ALL SELECT 'season', c_custkey, 'start_year_out_of_range' FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'season', c_custkey, 'dates_inverted' FROM customer WHERE c_custkey % 4 = 2
 UNION ALL SELECT 'alias', s_suppkey, 'alias_not_lower_case' FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'alias', s_suppkey, 'alias_empty' FROM supplier WHERE s_suppkey % 3 = 2
 UNION ALL SELECT 'alias', s_suppkey, 'confidence_out_of_range' FROM supplier WHERE s_suppkey % 10 = 0""")
def validate_entities(spark, sf_dir):
    competitions = views.table(spark, sf_dir, "part").selectExpr(
        "'competition' AS entity", "p_partkey AS id", "CASE WHEN p_partkey % 6 = 1 THEN 'friendly' ELSE 'league' END AS type",
        "CASE WHEN p_partkey % 6 = 3 THEN 'mixed' ELSE 'men' END AS gender", "CASE WHEN p_partkey % 6 = 2 THEN 0 ELSE 1 END AS tier",
    )
    seasons = views.table(spark, sf_dir, "customer").selectExpr(
        "'season' AS entity", "c_custkey AS id", "CASE WHEN c_custkey % 4 = 1 THEN 1492 ELSE 1999 END AS start_year", "'1999/00' AS label",
        "DATE'1999-08-01' AS start_date", "CASE WHEN c_custkey % 4 = 2 THEN DATE'1999-05-01' ELSE DATE'2000-05-01' END AS end_date",
    )
    names = views.table(spark, sf_dir, "supplier").selectExpr(
        "'alias' AS entity", "s_suppkey AS id", "CASE s_suppkey % 3 WHEN 1 THEN upper(s_name) WHEN 2 THEN '' ELSE lower(s_name) END AS normalized_alias",
        "CASE WHEN s_suppkey % 10 = 0 THEN 101 ELSE 90 END AS confidence",
    )
    keys = ["entity", "id"]
    parts = [rule_violations(competitions, keys, R.competition_rules()), rule_violations(seasons, keys, R.season_rules()), rule_violations(names, keys, R.alias_rules())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("validate_prediction", ["m"], """SELECT id, 'wrong_cell_count' AS rule FROM m WHERE id % 10 = 1 UNION ALL SELECT id, 'mass_not_one' FROM m WHERE id % 10 IN (1, 2)
 UNION ALL SELECT id, 'one_x_two_not_one' FROM m WHERE id % 10 = 3 UNION ALL SELECT id, 'over_ladder_rises' FROM m WHERE id % 10 = 4
 UNION ALL SELECT id, 'cold_flag_disagrees' FROM m WHERE id % 10 = 5 UNION ALL SELECT id, 'cutoff_after_known_at' FROM m WHERE id % 10 = 6
 UNION ALL SELECT id, 'probability_out_of_range' FROM m WHERE id % 10 = 7""")
def validate_prediction(spark, sf_dir):
    rated = views.matches(spark, sf_dir).selectExpr("id", "k", "0.2D + (id % 300) / 100D AS lambda_home", "0.2D + (id * 7 % 250) / 100D AS lambda_away")
    good = with_markets(rated, scoreline=True)
    rows = good.withColumns({
        "scoreline": F.expr("CASE id % 10 WHEN 1 THEN slice(scoreline, 17, 240) WHEN 2 THEN transform(scoreline, p -> p * 0.99) ELSE scoreline END"),
        "p_draw": F.expr("CASE WHEN id % 10 = 3 THEN p_draw / 2 ELSE p_draw END"),
        "p_over_2_5": F.expr("CASE WHEN id % 10 = 4 THEN 1.0D ELSE p_over_2_5 END"),
        "p_btts_yes": F.expr("CASE WHEN id % 10 = 7 THEN -0.1D ELSE p_btts_yes END"),
        "is_cold_start": F.expr("id % 10 = 5"), "cold_started_teams": F.array().cast("array<string>"),
        "known_at": F.col("k"), "data_cutoff": F.expr("CASE WHEN id % 10 = 6 THEN k + 1 ELSE k END"),
    })
    return rule_violations(rows, ["id"], R.prediction_rules())
