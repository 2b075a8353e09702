"""Registered queries: price ticks, margins, consensus, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import with_markets
from tidemark.operators import odds as O
from tidemark.operators.shape import spread
from tidemark.plans import views
from tidemark.plans.registry import query, scaled, sql_scaled
from tidemark.plans.views import DAY_US

CUT = 1705276800000000


@query("latest_tick_as_of", ["ticks"], f"""SELECT series_id, observed_at, source, price_c, is_available FROM (
 SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC, source DESC, price_kind DESC, price_c DESC NULLS LAST) AS i FROM ticks
 WHERE known_at <= {CUT} AND (superseded_at IS NULL OR superseded_at > {CUT}) AND observed_at <= {CUT} AND price_kind = 'observed') WHERE i = 1""")
def latest_tick_as_of(spark, sf_dir):
    return O.latest_tick_as_of(views.ticks(spark, sf_dir), CUT).select("series_id", "observed_at", "source", "price_c", "is_available")


_PRE_SQL = """SELECT series_id, observed_at, source, price_c FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC) AS i FROM ticks
 WHERE superseded_at IS NULL AND price_kind = 'observed' AND observed_at < {bound}) WHERE i = 1"""


@query("last_observed_pre_kickoff", ["ticks"], _PRE_SQL.format(bound="kickoff"))
def last_observed_pre_kickoff(spark, sf_dir):
    return O.last_before_kickoff(views.ticks(spark, sf_dir)).select("series_id", "observed_at", "source", "price_c")


@query("last_observed_pre_live", ["ticks"], _PRE_SQL.format(bound=f"kickoff + series_id % 5 * {DAY_US}"))
def last_observed_pre_live(spark, sf_dir):
    """The other definition: bounded by the instant play began, which a postponement moves."""
    t = views.ticks(spark, sf_dir).withColumn("live_at", F.col("kickoff") + F.col("series_id") % 5 * DAY_US)
    return O.last_before_kickoff(t, "live_at").select("series_id", "observed_at", "source", "price_c")


@query("price_path", ["ticks"], "SELECT event_id, series_id, observed_at, price_c, row_number() OVER (PARTITION BY series_id ORDER BY observed_at, source, price_kind, event_id) AS position FROM ticks")
def price_path(spark, sf_dir):
    return O.price_path(views.ticks(spark, sf_dir)).select("event_id", "series_id", "observed_at", "price_c", "position")


@query("change_only_ticks", ["ticks"], """SELECT event_id, price_c, is_available FROM (SELECT *, row_number() OVER w AS i, lag(price_c) OVER w AS pp, lag(is_available) OVER w AS pa FROM ticks
 WINDOW w AS (PARTITION BY series_id, source, price_kind ORDER BY observed_at, event_id))
 WHERE i = 1 OR price_c IS DISTINCT FROM pp OR is_available IS DISTINCT FROM pa""")
def change_only_ticks(spark, sf_dir):
    return O.change_only(views.ticks(spark, sf_dir)).select("event_id", "price_c", "is_available")


@query("step_function_price", ["ticks"], f"""+ ask AS (SELECT DISTINCT series_id, observed_at // {DAY_US} * {DAY_US} + 43200000000 AS at FROM ticks)
 SELECT a.series_id, a.at, CASE WHEN t.is_available THEN t.price_c END AS price_c, t.series_id IS NOT NULL AS quoted
 FROM ask a ASOF LEFT JOIN ticks t ON t.series_id = a.series_id AND a.at >= t.observed_at""")
def step_function_price(spark, sf_dir):
    """Each series priced at noon of every day it traded."""
    t = views.ticks(spark, sf_dir)
    noon = F.floor(F.col("observed_at") / DAY_US) * DAY_US + 43200000000
    return O.step_price(t, t.select("series_id", noon.alias("at")).distinct())


@query("lay_requires_exchange", ["books"], """SELECT id, book FROM books WHERE (id + book) % 4 = 0 AND book % 3 <> 0""")
def lay_requires_exchange(spark, sf_dir):
    series = views.books(spark, sf_dir).select(
        "id", "book", F.col("book").alias("bookmaker_id"), F.when((F.col("id") + F.col("book")) % 4 == 0, "lay").otherwise("back").alias("side")
    )
    makers = views.books(spark, sf_dir).select(F.col("book").alias("bookmaker_id")).distinct().withColumn(
        "kind", F.when(F.col("bookmaker_id") % 3 == 0, "exchange").otherwise("bookmaker")
    )
    return O.lay_without_exchange(series, makers).select("id", "book")


SELECTIONS = ("home", "draw", "away")


def markets(spark, sf_dir) -> DataFrame:
    """Wide quotes with the raw probability array and the overround."""
    prices = F.array(*[F.col(f"{s}_c") / F.lit(100.0) for s in SELECTIONS])
    out = views.books(spark, sf_dir).withColumn("raw", O.raw_probabilities(prices))
    return out.withColumn("overround", O.total(F.col("raw")))


_RAW_SQL = """+ r AS (SELECT id, book, 100.0 / home_c::DOUBLE AS h, 100.0 / draw_c::DOUBLE AS d, 100.0 / away_c::DOUBLE AS a FROM books),
 o AS (SELECT *, h + d + a AS w FROM r)
"""


@query("implied_overround", ["books"], _RAW_SQL + f"SELECT id, book, {sql_scaled('h')} AS p_home, {sql_scaled('w')} AS overround, {sql_scaled('w - 1')} AS margin FROM o")
def implied_overround(spark, sf_dir):
    return markets(spark, sf_dir).select(
        "id", "book", scaled(F.get("raw", F.lit(0))).alias("p_home"), scaled("overround").alias("overround"), scaled(F.col("overround") - 1).alias("margin")
    )


def _three(df: DataFrame, name: str, digits: int = 9) -> DataFrame:
    return df.select("id", "book", *[scaled(F.get(name, F.lit(i)), digits).alias(f"p_{s}") for i, s in enumerate(SELECTIONS)])


@query("devig_multiplicative", ["books"], _RAW_SQL + f"SELECT id, book, {sql_scaled('h / w')} AS p_home, {sql_scaled('d / w')} AS p_draw, {sql_scaled('a / w')} AS p_away FROM o")
def devig_multiplicative(spark, sf_dir):
    return _three(markets(spark, sf_dir).withColumn("fair", O.devig_multiplicative(F.col("raw"), F.col("overround"))), "fair")


@query("devig_additive", ["books"], _RAW_SQL + f"""SELECT id, book, {sql_scaled('h - (w - 1) / 3')} AS p_home, {sql_scaled('d - (w - 1) / 3')} AS p_draw,
 {sql_scaled('a - (w - 1) / 3')} AS p_away FROM o""")
def devig_additive(spark, sf_dir):
    return _three(markets(spark, sf_dir).withColumn("fair", O.devig_additive(F.col("raw"), F.col("overround"))), "fair")


_DISTINCT_SQL = _RAW_SQL + ", u AS (SELECT DISTINCT h, d, a, w FROM o)"


@query("devig_power", ["books"], _DISTINCT_SQL + f""", it AS (SELECT h, d, a, 0.01::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS n FROM u
  UNION ALL SELECT h, d, a, CASE WHEN power(h, (lo + hi) / 2) + power(d, (lo + hi) / 2) + power(a, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
  CASE WHEN power(h, (lo + hi) / 2) + power(d, (lo + hi) / 2) + power(a, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM it WHERE n < 60),
 k AS (SELECT h, d, a, (lo + hi) / 2 AS k FROM it WHERE n = 60)
 SELECT id, book, {sql_scaled('power(o.h, k)', 7)} AS p_home, {sql_scaled('power(o.d, k)', 7)} AS p_draw, {sql_scaled('power(o.a, k)', 7)} AS p_away FROM o JOIN k USING (h, d, a)""")
def devig_power(spark, sf_dir):
    solved = markets(spark, sf_dir).withColumn("k", O.power_exponent(F.col("raw")))
    return _three(solved.withColumn("fair", O.devig_power(F.col("raw"), F.col("k"))), "fair", 7)


def _shin_sql(p: str, z: str) -> str:
    return f"((sqrt({z} * {z} + 4 * (1 - {z}) * {p} * {p} / w) - {z}) / (2 * (1 - {z})))"


_MID = "((lo + hi) / 2)"
_SHIN_SUM = " + ".join(_shin_sql(p, _MID) for p in "hda")


@query("devig_shin", ["books"], _DISTINCT_SQL + f""", it AS (SELECT h, d, a, w, 0.0::DOUBLE AS lo, 0.999999::DOUBLE AS hi, 0 AS n FROM u WHERE w > 1
  UNION ALL SELECT h, d, a, w, CASE WHEN {_SHIN_SUM} > 1 THEN {_MID} ELSE lo END, CASE WHEN {_SHIN_SUM} > 1 THEN hi ELSE {_MID} END, n + 1 FROM it WHERE n < 60),
 z AS (SELECT h, d, a, (lo + hi) / 2 AS z FROM it WHERE n = 60)
 SELECT id, book, {sql_scaled(_shin_sql('h', 'z'), 7)} AS p_home, {sql_scaled(_shin_sql('d', 'z'), 7)} AS p_draw, {sql_scaled(_shin_sql('a', 'z'), 7)} AS p_away
 FROM o LEFT JOIN z USING (h, d, a)""")
def devig_shin(spark, sf_dir):
    solved = markets(spark, sf_dir).withColumn("z", O.shin_share(F.col("raw"), F.col("overround")))
    return _three(solved.withColumn("fair", O.devig_shin(F.col("raw"), F.col("overround"), F.col("z"))), "fair", 7)


def quotes(spark, sf_dir) -> DataFrame:
    """Long quotes; every thirteenth (match, book) is suspended, every seventeenth stale."""
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("selection"), (F.col(f"{s}_c") / F.lit(100.0)).alias("price")) for s in SELECTIONS])).alias("q")
    rows = views.books(spark, sf_dir).select("id", "book", listed).select("id", "book", "q.*")
    return rows.withColumns({
        "is_available": (F.col("id") + F.col("book")) % 13 != 0,
        "observed_at": F.when((F.col("id") * 3 + F.col("book")) % 17 == 0, F.lit(0)).otherwise(F.lit(CUT)),
    })


_CONS_SQL = _RAW_SQL + """, f AS (SELECT id, unnest(['home', 'draw', 'away']) AS selection, unnest([h / w, d / w, a / w]) AS p FROM o
  WHERE (id + book) % 13 <> 0 AND (id * 3 + book) % 17 <> 0),
 l AS (SELECT id, selection, count(*) AS books, 1 / (1 + exp(-avg(ln(p / (1 - p))))) AS p FROM f GROUP BY ALL),
 c AS (SELECT id, selection, books, p / sum(p) OVER (PARTITION BY id) AS p_fair FROM l)
"""


def _consensus(spark, sf_dir) -> DataFrame:
    return O.consensus(quotes(spark, sf_dir), ["id"], F.lit(O.MARKET_WIDTH["1x2"]), 15 * 60 * 1_000_000, F.lit(CUT))


@query("consensus", ["books"], _CONS_SQL + f"SELECT id, selection, books, {sql_scaled('p_fair', 8)} AS p_fair FROM c")
def consensus(spark, sf_dir):
    return _consensus(spark, sf_dir).select("id", "selection", "books", scaled("p_fair", 8).alias("p_fair"))


# The model's side of a bet: markets from rates derived from the match id.
def _model(spark, sf_dir) -> DataFrame:
    rated = views.matches(spark, sf_dir).selectExpr("id", "0.2D + (id % 300) / 100D AS lambda_home", "0.2D + (id * 7 % 250) / 100D AS lambda_away")
    listed = F.explode(F.array(*[F.struct(F.lit(s).alias("selection"), F.col(f"p_{s}").alias("p_model")) for s in SELECTIONS])).alias("q")
    return with_markets(spread(rated, "id")).select("id", listed).select("id", "q.*")


_MODEL_SQL = _CONS_SQL + """, rt AS (SELECT id, 0.2 + (id % 300) / CAST(100 AS DOUBLE) AS lh, 0.2 + (id * 7 % 250) / CAST(100 AS DOUBLE) AS la FROM m),
 g AS (SELECT CAST(range AS INT) AS x, CAST(factorial(CAST(range AS INT)) AS DOUBLE) AS fact FROM range(16)),
 q AS (SELECT id, h.x AS i, a.x AS j, exp(-lh) * power(lh, h.x) / h.fact * exp(-la) * power(la, a.x) / a.fact AS q FROM rt CROSS JOIN g h CROSS JOIN g a),
 pm AS (SELECT id, unnest(['home', 'draw', 'away']) AS selection, unnest([sum(q) FILTER (i > j) / sum(q), sum(q) FILTER (i = j) / sum(q), sum(q) FILTER (i < j) / sum(q)]) AS p_model FROM q GROUP BY id),
 best AS (SELECT id, unnest(['home', 'draw', 'away']) AS selection, unnest([max(home_c), max(draw_c), max(away_c)]) / 100.0::DOUBLE AS price FROM books GROUP BY id),
 v AS (SELECT id, selection, p_model, p_fair, price, id % 2 = 0 AS is_exchange, CASE WHEN id % 4 = 0 THEN 0.05 END AS commission FROM pm JOIN c USING (id, selection) JOIN best USING (id, selection))
"""


@query("edge_ev_kelly", ["m", "books"], _MODEL_SQL + f"""SELECT id, selection, {sql_scaled('p_model - p_fair', 7)} AS edge, {sql_scaled('p_model / p_fair - 1', 6)} AS relative_edge,
 {sql_scaled('CASE WHEN is_exchange THEN p_model * (price - 1) * (1 - commission) - (1 - p_model) ELSE p_model * price - 1 END', 7)} AS ev,
 {sql_scaled('(p_model * price - 1) / (price - 1)', 7)} AS kelly, {sql_scaled('least(greatest((p_model * price - 1) / (price - 1) / 4, 0), 0.05)', 7)} AS stake FROM v""")
def edge_ev_kelly(spark, sf_dir):
    """Model against consensus at the best price; on an exchange without a stated commission the value is refused."""
    best = quotes(spark, sf_dir).groupBy("id", "selection").agg(F.max("price").alias("price"))
    v = _model(spark, sf_dir).join(_consensus(spark, sf_dir), ["id", "selection"]).join(best, ["id", "selection"])
    p, fair, price = F.col("p_model"), F.col("p_fair"), F.col("price")
    ev = O.expected_value(p, price, F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, F.lit(0.05)))
    return v.select(
        "id", "selection", scaled(O.edge(p, fair), 7).alias("edge"), scaled(O.relative_edge(p, fair), 6).alias("relative_edge"),
        scaled(ev, 7).alias("ev"), scaled(O.kelly(p, price), 7).alias("kelly"), scaled(O.recommended_stake(O.kelly(p, price), 0.05), 7).alias("stake"),
    )


@query("clv", ["books"], _RAW_SQL + f""", t AS (SELECT id, book, unnest(['home', 'draw', 'away']) AS selection, unnest([home_c, draw_c, away_c]) AS c FROM books WHERE book <> 0),
 x AS (SELECT id, unnest(['home', 'draw', 'away']) AS selection, unnest([h / w, d / w, a / w]) AS p FROM o WHERE book = 0)
 SELECT id, book, selection, {sql_scaled('c / 100.0 * p - 1', 8)} AS clv, 'provider_closing' AS reference_kind FROM t JOIN x USING (id, selection)""")
def clv(spark, sf_dir):
    """Prices of the other books against the fair closing probabilities of book 0; the reference kind stays with the number."""
    fair = O.devig_multiplicative(F.col("raw"), F.col("overround"))
    close = markets(spark, sf_dir).filter("book = 0").select("id", fair.alias("fair"), F.lit("provider_closing").alias("reference_kind"))
    prices = F.array(*[F.struct(F.lit(s).alias("selection"), F.lit(i).alias("place"), (F.col(f"{s}_c") / F.lit(100.0)).alias("price")) for i, s in enumerate(SELECTIONS)])
    taken = views.books(spark, sf_dir).filter("book <> 0").select("id", "book", F.explode(prices).alias("q")).select("id", "book", "q.*")
    return taken.join(close, "id").withColumn("p_close", F.get("fair", F.col("place"))).select(
        "id", "book", "selection", scaled(O.closing_line_value(F.col("price"), F.col("p_close")), 8).alias("clv"), "reference_kind"
    )
