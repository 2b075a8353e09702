"""Bitemporal worked examples and the rules every history obeys."""

import pathlib
import random

from pyspark.sql import functions as F

from tidemark.operators import odds, quality, sql_functions
from tidemark.operators import temporal as T
from tidemark.operators.ordered import carry_forward, earlier_totals, neighbours
from tidemark.plans import jobs, q_jobs, views

DAY = 86_400_000_000
HISTORY = "key string, source string, home int, away int, known_at bigint, superseded_at bigint"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_corrected_result_reads_as_it_stood(spark):
    table = spark.createDataFrame([("f", "a", 2, 1, 1, None)], HISTORY)
    fix = spark.createDataFrame([("f", "a", 2, 2, 3)], "key string, source string, home int, away int, known_at bigint")
    after = T.revise(table, fix, ["key", "source"], ["home", "away"])
    assert rows(after, "known_at") == [("f", "a", 2, 1, 1, 3), ("f", "a", 2, 2, 3, None)]
    assert [tuple(r)[2:4] for r in T.as_of(after, 2).collect()] == [(2, 1)]
    assert [tuple(r)[2:4] for r in T.as_of(after, 3).collect()] == [(2, 2)]
    assert T.as_of(after, F.lit(None).cast("bigint")).count() == 0


def test_equal_content_writes_nothing_and_late_difference_is_named(spark):
    table = spark.createDataFrame([("f", None, 1, None, 5, None), ("g", None, 1, 1, 5, None)], HISTORY)
    batch = spark.createDataFrame(
        [("f", None, 1, None, 9), ("g", None, 2, 1, 5), ("h", None, 0, 0, 9)],
        "key string, source string, home int, away int, known_at bigint",
    )
    outcome = {
        (r.old or r.new).key: r.outcome for r in T.compare_revisions(table, batch, ["key", "source"], ["home", "away"]).collect()
    }
    assert outcome == {"f": "unchanged", "g": "late", "h": "created"}
    after = T.revise(table, batch, ["key", "source"], ["home", "away"])
    assert after.count() == 3 and quality.inverted(after).isEmpty()


def test_history_has_one_visible_revision_at_every_instant(spark, sf):
    history = T.history_from_log(views.revlog(spark, sf), ["key_id", "source"], ["p1"], ["event_id"])
    assert quality.overlapping(history, ["key_id", "source"]).isEmpty()
    assert quality.inverted(history).isEmpty()
    start = history.groupBy("key_id", "source").agg(F.min("known_at").alias("first"))
    seen = T.as_of_many(history, [1704672000000000, 1705276800000000]).groupBy("cutoff", "key_id", "source").count()
    expected = sum(start.filter(F.col("first") <= c).count() for c in (1704672000000000, 1705276800000000))
    assert seen.filter("count <> 1").isEmpty() and seen.count() == expected


def test_ties_at_one_instant_keep_the_last(spark):
    log = spark.createDataFrame([("k", 1, 10, 5), ("k", 2, 10, 6), ("k", 3, 11, 6)], "key string, event bigint, known_at bigint, p int")
    out = T.history_from_log(log, ["key"], ["p"], ["event"])
    assert [(r.p, r.known_at, r.superseded_at) for r in out.collect()] == [(6, 10, None)]


def test_retraction_keeps_the_past_readable(spark):
    table = spark.createDataFrame([("t", "s", 3, 5, 1, None)], HISTORY)
    marks = spark.createDataFrame([("t", "s", 4)], "key string, source string, retracted_at bigint")
    after = T.retract(table, marks, ["key", "source"])
    assert T.as_of(after, 3).count() == 1 and T.as_of(after, 4).count() == 0


def test_a_batch_with_several_rows_of_a_key_is_chained(spark):
    table = spark.createDataFrame([("t", None, 1, 0, 2, None), ("t", "x", 4, 0, 1, 9), ("u", "s", 7, 0, 2, None)], HISTORY)
    batch = spark.createDataFrame(
        [("t", None, 2, 0, 3, 1), ("t", None, 9, 0, 5, 1), ("t", None, 3, 0, 5, 2), ("t", None, 3, 0, 6, 1), ("t", None, 8, 0, 2, 1), ("v", "s", 1, 0, 1, 1)],
        "key string, source string, home int, away int, known_at bigint, event int",
    )
    after = T.revise(table, batch, ["key", "source"], ["home", "away"], ["event"])
    assert rows(after, "key", "known_at") == [
        ("t", "x", 4, 0, 1, 9), ("t", None, 1, 0, 2, 3), ("t", None, 2, 0, 3, 5), ("t", None, 3, 0, 5, None), ("u", "s", 7, 0, 2, None), ("v", "s", 1, 0, 1, None)
    ]
    assert [(r.home, r.known_at) for r in T.refused(table, batch, ["key", "source"], ["home", "away"]).collect()] == [(8, 2)]


def test_null_key_parts_match_each_other(spark):
    have = spark.createDataFrame([(1, None), (2, 2.5)], "id int, line double")
    want = spark.createDataFrame([(1, None), (2, None), (2, 2.5), (2, None)], "id int, line double")
    assert rows(T.insert_absent(have, want, ["id", "line"]), "id") == [(2, None)]
    one, other = (T.surrogate_id(["line"]),) * 2
    assert want.select(one.alias("h")).distinct().count() == 2


def test_split_keys_give_the_same_neighbours_and_totals(spark):
    random.seed(7)
    data = [("hot" if random.random() < 0.6 else f"k{i % 5}", random.randrange(0, 40 * DAY, DAY // 4), i, random.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(data, "key string, at bigint, id bigint, v int")
    take = dict(previous={"p": F.col("v")}, following={"n": F.col("v")})
    plain = neighbours(df, ["key"], ["at", "id"], grain_us=1 << 60, **take)
    split = neighbours(df, ["key"], ["at", "id"], grain_us=3 * DAY, **take)
    assert rows(plain, "id") == rows(split.select(*plain.columns), "id")
    got = {(r.key, r["at"]): r.s for r in earlier_totals(df, ["key"], "at", {"s": F.col("v")}).collect()}
    for key, at, _, _ in data:
        assert got[key, at] == sum(v for k, a, _, v in data if k == key and a < at)


def test_carry_forward_matches_brute_force(spark):
    random.seed(3)
    data = [(random.choice("ab"), random.randrange(0, 20 * DAY, DAY // 2), i, random.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(data, "key string, at bigint, id bigint, v int")
    got = {r.id: r.held for r in carry_forward(df, ["key"], ["at", "id"], "v", "held").collect()}
    for key, at, i, _ in data:
        past = sorted((a, j, v) for k, a, j, v in data if k == key and (a, j) <= (at, i) and v is not None)
        assert got[i] == (past[-1][2] if past else None)


def test_late_rows_are_not_emitted_as_changes(spark):
    from tidemark.streaming.batches import change_only_step

    kind = "key string, at bigint, id bigint, v int"
    step = change_only_step(["key"], ["v"], ["at", "id"])
    held = spark.createDataFrame([("a", 20, 1, 7)], kind)
    out, state = step(held, spark.createDataFrame([("a", 5, 2, 1), ("a", 15, 3, 2), ("a", 30, 4, 7), ("a", 40, 5, 8), ("b", 1, 6, 3)], kind), 1)
    assert rows(out, "key", "at") == [("a", 8, 40, 5), ("b", 3, 1, 6)]
    assert sorted((r.key, r["at"], r.v) for r in state.collect()) == [("a", 40, 8), ("b", 1, 3)]


def test_closing_price_example(spark):
    ticks = spark.createDataFrame(
        [(1, "s", 10, 260, True, "observed", 100, None), (1, "s", 20, 255, True, "observed", 100, None),
         (1, "s", 30, 250, True, "provider_closing", 100, None), (1, "s", 40, 248, True, "exchange_sp", 100, None),
         (1, "s", 100, 240, True, "observed", 100, None)],
        "series_id int, source string, observed_at bigint, price_c int, is_available boolean, price_kind string, kickoff bigint, superseded_at bigint",
    )
    assert odds.last_before_kickoff(ticks).first().price_c == 255


def test_filter_on_knowledge_time_reaches_the_scan(spark, folder, sf):
    path = f"{folder}/history"
    T.history_from_log(views.revlog(spark, sf), ["key_id", "source"], ["p1"], ["event_id"]).write.parquet(path)
    plan = T.as_of(spark.read.parquet(path), 1705276800000000).select("p1")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(known_at,1705276800000000)" in plan
    assert "event_id" not in plan
    sql_functions.register(spark, {"stored": spark.read.parquet(path)})
    plan = spark.sql("SELECT p1 FROM stored_as_of(1705276800000000)")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(known_at,1705276800000000)" in plan


def test_visibility_is_spelled_once():
    root = pathlib.Path(__file__).parent.parent / "tidemark"
    spelled = [p.name for p in root.rglob("*.py") if "superseded.isNull() | (superseded >" in p.read_text()]
    assert spelled == ["temporal.py"]


def test_manifest_hash_sees_order_changes_only_in_content(spark):
    df = spark.createDataFrame([("s", i, i * i) for i in range(50)], "scope string, a int, b int")
    one = quality.manifest_hash(df, ["scope"], ["a", "b"]).first().manifest
    assert quality.manifest_hash(df.orderBy(F.desc("a")), ["scope"], ["a", "b"]).first().manifest == one
    changed = df.withColumn("b", F.when(F.col("a") == 3, 0).otherwise(F.col("b")))
    assert quality.manifest_hash(changed, ["scope"], ["a", "b"]).first().manifest != one


def test_form_and_totals_agree_with_and_without_splitting(spark, sf):
    from tidemark.operators.analytics import form_snapshot
    from tidemark.operators.ordered import with_earlier_totals

    m = views.matches(spark, sf)
    plain, split = (form_snapshot(m, grain_us=g) for g in (1 << 60, 9 * DAY))
    assert plain.count() == split.count() and plain.select(*sorted(plain.columns)).exceptAll(split.select(*sorted(plain.columns))).isEmpty()
    sums = {"n": F.lit(1).cast("bigint"), "g": F.col("hg").cast("bigint")}
    one, two = (with_earlier_totals(m, ["scope"], "k", sums, g).select("id", "n", "g") for g in (1 << 60, DAY))
    assert one.exceptAll(two).isEmpty() and one.count() == two.count()


def test_facts_with_few_rows_are_revised_with_one_shuffle(spark):
    rng = random.Random(11)
    keys = [None, "a", "b", *(f"k{i}" for i in range(30))]
    table, batch = [], []
    for key in keys:
        at = [rng.randrange(60) * T.GRAIN_US // 7 + 10 for _ in range(3)]
        table += [(key, "s", rng.choice([None, 1, 2]), min(at), None)] if rng.random() < 0.6 else []
        table += [(key, "s", 9, min(at) - 5, min(at))]
        # One row per instant and file, several files at an instant, some not newer than the open revision.
        batch += [(key, "s", rng.choice([None, 1, 2]), rng.choice(at) + rng.choice([-1, 0, 1]), f"f{i}") for i in range(12)]
    table = spark.createDataFrame(table, "key string, source string, v int, known_at bigint, superseded_at bigint")
    batch = spark.createDataFrame(batch, "key string, source string, v int, known_at bigint, file string")
    few = T.revise(table, batch, ["key", "source"], ["v"], ["file"], grain_us=None)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(few) == order(T.revise(table, batch, ["key", "source"], ["v"], ["file"])) and few.count() > 100


def test_import_shuffles_each_fact_table_once(spark, sf):
    store, _ = jobs.import_seasons(jobs.empty_store(spark), q_jobs.job_documents(spark, sf), q_jobs._everyone(spark, sf), "Europe/London", "A")
    for name in ("fixtures", *jobs.REVISED):
        assert store[name]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1, name
