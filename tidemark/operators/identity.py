"""Names to internal ids: exact matches only, and a refusal whenever there is doubt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_alias
from tidemark.operators.ordered import DAY_US, earlier_totals, same_key_join
from tidemark.operators.temporal import as_of, current_rows, insert_absent, null_safe_join, visible_at


def distinct_ids(rows: DataFrame, key: str, internal: str, name: str) -> DataFrame:
    """Per key the sorted distinct internal ids: two rows for one entity are not ambiguous."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(internal)).alias(name))


def resolve(
    refs: DataFrame, key: str, mappings: DataFrame, aliases: DataFrame | None, source: str, cutoff: Column | int
) -> DataFrame:
    """Add outcome (resolved, ambiguous, unknown), internal_id, candidates and reason to each reference.

    An explicit mapping as of `cutoff` outranks an alias; aliases (teams only)
    match on the normalised text, for this source or globally. Distinct keys are
    resolved once and joined back, so repeated names cost nothing extra.
    `mappings`: external_id, internal_id, known_at, superseded_at.
    `aliases`: alias_norm, team_id, source, optionally created_at.
    """
    keys = refs.select(F.col(key).alias("__key")).distinct()
    mapped = distinct_ids(as_of(mappings, cutoff), "external_id", "internal_id", "__mapped")
    found = keys.join(mapped.withColumnRenamed("external_id", "__key"), "__key", "left")
    if aliases is not None:
        usable = aliases.filter((F.col("source") == source) | F.col("source").isNull())
        if "created_at" in aliases.columns:
            usable = usable.filter(visible_at("created_at", F.lit(None).cast("bigint"), cutoff))
        matched = distinct_ids(usable, "alias_norm", "team_id", "__matched").withColumnRenamed("alias_norm", "__norm")
        found = found.withColumn("__norm", normalize_alias(F.col("__key"))).join(matched, "__norm", "left").drop("__norm")
    else:
        found = found.withColumn("__matched", F.lit(None).cast("array<int>"))
    n_mapped = F.coalesce(F.size("__mapped"), F.lit(0))
    n_matched = F.coalesce(F.size("__matched"), F.lit(0))
    ids = F.when(n_mapped > 0, F.col("__mapped")).otherwise(F.coalesce("__matched", F.array().cast("array<int>")))
    reason = (
        F.when(n_mapped == 1, "mapping").when(n_mapped > 1, "overlapping mappings")
        .when(n_matched == 1, "alias").when(n_matched > 1, "alias matches several teams").otherwise("no mapping and no alias")
    )
    outcome = F.when(F.size(ids) == 1, "resolved").when(F.size(ids) > 1, "ambiguous").otherwise("unknown")
    answers = found.select(
        F.col("__key"), outcome.alias("outcome"), F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("internal_id"),
        F.when(F.size(ids) > 1, ids).otherwise(F.array().cast("array<int>")).alias("candidates"), reason.alias("reason"),
    )
    return null_safe_join(refs, answers.withColumnRenamed("__key", key), [key], "left")


def resolve_sides(fixtures: DataFrame, home: str, away: str, *resolver) -> DataFrame:
    """Both sides must resolve; the first failure (home before away) decides `failure`."""

    def side(df: DataFrame, column: str, prefix: str) -> DataFrame:
        added = ("outcome", "internal_id", "candidates", "reason")
        return resolve(df, column, *resolver).withColumnsRenamed({c: f"{prefix}_{c}" for c in added})

    both = side(side(fixtures, home, "home"), away, "away")
    failure = F.when(F.col("home_outcome") != "resolved", F.concat(F.lit("home: "), F.col("home_outcome"))).when(
        F.col("away_outcome") != "resolved", F.concat(F.lit("away: "), F.col("away_outcome"))
    )
    return both.withColumn("failure", failure)


def ensure_mappings(mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    """created, unchanged or conflict per wanted (external_id, internal_id); a conflict is never overwritten.

    A key wanted with two different ids in one batch is a conflict too.
    """
    held = current_rows(mappings).groupBy("external_id").agg(F.min("internal_id").alias("held"), F.max("internal_id").alias("held_hi"))
    asked = wanted.groupBy("external_id").agg(F.min("internal_id").alias("internal_id"), F.max("internal_id").alias("hi"))
    outcome = (
        F.when(F.col("internal_id") != F.col("hi"), "conflict")
        .when(F.col("held").isNull(), "created")
        .when((F.col("held") == F.col("internal_id")) & (F.col("held_hi") == F.col("held")), "unchanged")
        .otherwise("conflict")
    )
    return asked.join(held, "external_id", "left").select("external_id", "internal_id", "held", outcome.alias("outcome"))


def file_reviews(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Review items not yet open for their (entity_type, source, external_id)."""
    keys = ["entity_type", "source", "external_id"]
    return insert_absent(queue.filter("status = 'open'"), items, keys)


def seed(registry: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The registry after an idempotent insert by natural key."""
    return registry.unionByName(insert_absent(registry, incoming, keys).select(*registry.columns))


def seed_aliases_for_existing(teams: DataFrame, aliases: DataFrame, spellings: DataFrame) -> DataFrame:
    """Spellings as new aliases of teams that exist; unknown slugs create nothing.

    `spellings`: slug, spelling, source. Returns slug, alias_norm, source, attached.
    """
    known = spellings.join(teams.select("slug", "team_id"), "slug", "left")
    rows = known.select(
        "slug", "team_id", normalize_alias(F.col("spelling")).alias("alias_norm"), "source",
        F.col("team_id").isNotNull().alias("attached"),
    )
    return null_safe_join(rows, aliases.select("alias_norm", "source").distinct(), ["alias_norm", "source"], "left_anti")


def unstable_mappings(mappings: DataFrame, current_names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mapped ids whose current provider name no longer matches any alias of the mapped entity."""
    named = current_rows(mappings).join(current_names, "external_id").select(
        "external_id", F.col("internal_id").alias("team_id"), normalize_alias(F.col("name")).alias("alias_norm")
    )
    return named.join(aliases.select("team_id", "alias_norm").distinct(), ["team_id", "alias_norm"], "left_anti")


def match_candidates(
    ours: DataFrame, theirs: DataFrame, keys: Sequence[str], days: int = 3
) -> DataFrame:
    """For each of our rows: how many of theirs share `keys` within +-days, and which one if exactly one.

    Both sides: keys, id (bigint), k. Counted by differences of running totals,
    so no pair is ever formed; with a count of one, the total of ids is the id.
    """
    span = days * DAY_US
    events = theirs.select(*keys, F.col("k").alias("at"), F.lit(1).cast("bigint").alias("n"), F.col("id").cast("decimal(38,0)").alias("s"))
    asked = ours.select(*keys, F.explode(F.array(F.col("k") - span, F.col("k") + span + 1)).alias("at")).distinct()
    probes = asked.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("s"))
    totals = earlier_totals(events.unionByName(probes), list(keys), "at", {"n": F.col("n"), "s": F.col("s")})
    low = totals.select(*keys, F.col("at").alias("lo"), F.col("n").alias("n0"), F.col("s").alias("s0"))
    high = totals.select(*keys, F.col("at").alias("hi"), F.col("n").alias("n1"), F.col("s").alias("s1"))
    bounded = ours.withColumns({"lo": F.col("k") - span, "hi": F.col("k") + span + 1})
    counted = same_key_join(same_key_join(bounded, low, [*keys, "lo"]), high, [*keys, "hi"]).withColumn("n", F.col("n1") - F.col("n0"))
    single = F.when(F.col("n") == 1, (F.col("s1") - F.col("s0")).cast("bigint"))
    decision = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("review")
    return counted.select(*ours.columns, "n", single.alias("candidate"), decision.alias("decision"))
