"""Scalar functions on provider text: cleaning, numbers, dates, labels, signatures, redaction."""

from __future__ import annotations

import json
import zoneinfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of credentials, headers worth keeping, status handling.
SENSITIVE_NAMES = (
    "api_key", "apikey", "authorization", "access_token", "auth_token", "auth", "token", "password", "passwd", "pwd",
    "secret", "client_secret", "client_id", "private_key", "session", "cookie", "x_api_key", "x_auth_token", "key",
)
PERSISTED_HEADERS = (
    "content-type", "content-length", "content-encoding", "date", "etag", "last-modified", "retry-after",
    "x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-reset",
)
REDACTED = "[REDACTED]"
TRANSIENT_KINDS = ("rate_limit", "timeout", "network", "provider_server")
ARCHIVE_FIRST_SHORT_YEAR = 93
SHORT_YEAR_PIVOT = 69


def strip(text: Column) -> Column:
    """Both-end strip of all white space; Spark's plain trim removes blanks only."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def clean_text(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def to_int(text: Column) -> Column:
    """Blank and malformed give NULL; tell them apart with `is_bad_int`."""
    return clean_text(text).try_cast("int")


def is_bad_int(text: Column) -> Column:
    return clean_text(text).isNotNull() & to_int(text).isNull()


def to_decimal(text: Column, precision: int = 9, scale: int = 4) -> Column:
    """Blank and malformed give NULL, without a problem."""
    return clean_text(text).try_cast(f"decimal({precision},{scale})")


def parse_day(text: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy; a two-digit year from 69 on is in the 1900s."""
    parts = [F.regexp_extract(strip(text), r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", i) for i in (1, 2, 3)]
    short = F.length(parts[2]) == 2
    century = F.when(short & (parts[2].try_cast("int") >= SHORT_YEAR_PIVOT), "19").when(short, "20").otherwise("")
    return F.concat(
        F.lpad(F.concat(century, parts[2]), 4, "0"), F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0")
    ).try_cast("date")


def parse_kickoff(day: Column, clock: Column, zone: Column) -> Column:
    """struct(kickoff, local_date): a local date and clock in an IANA zone to a UTC instant.

    A missing clock is local midnight; an unreadable date or clock gives NULL.
    """
    local_date = parse_day(day)
    text = clean_text(clock)
    hour = F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2})", 2).try_cast("int")
    readable = text.isNull() | ((hour < 24) & (minute < 60))
    seconds = F.coalesce(hour, F.lit(0)) * 3600 + F.coalesce(minute, F.lit(0)) * 60
    local = F.timestamp_seconds(F.unix_seconds(local_date.cast("timestamp")) + seconds)
    instant = F.to_utc_timestamp(local, zone)
    return F.when(local_date.isNotNull() & F.coalesce(readable, F.lit(False)), F.struct(
        instant.alias("kickoff"), local_date.alias("local_date")
    ))


def iso_instant(text: Column) -> Column:
    """ISO-8601 with an explicit offset; text without one is refused (NULL)."""
    cleaned = clean_text(text)
    shaped = cleaned.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(shaped, F.try_to_timestamp(cleaned))


def known_zone(zone: Column) -> Column:
    names = sorted(z for z in zoneinfo.available_timezones() if z not in ("Factory", "ROC", "localtime", "posixrules"))
    return zone.isin(names)


def local_date(instant: Column, zone: Column) -> Column:
    """Calendar date of an instant in a zone; NULL for an unknown zone."""
    return F.when(known_zone(zone), F.to_date(F.from_utc_timestamp(instant, zone)))


def season_of_folder(folder: Column) -> Column:
    """'2324' -> struct('2023/24', 2023); NULL unless four digits."""
    first = F.substring(folder, 1, 2).try_cast("int")
    year = first + F.when(first >= ARCHIVE_FIRST_SHORT_YEAR, 1900).otherwise(2000)
    label = F.concat(year.cast("string"), F.lit("/"), F.substring(folder, 3, 2))
    return F.when(folder.rlike(r"^\d{4}$"), F.struct(label.alias("label"), year.alias("start_year")))


def season_of_date(day: Column) -> Column:
    """A season's start date -> struct('2026/27', 2026)."""
    year = F.year(day)
    label = F.concat(year.cast("string"), F.lit("/"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))
    return F.when(day.isNotNull(), F.struct(label.alias("label"), year.alias("start_year")))


def season_external_id(season: Column, division: Column) -> Column:
    return F.concat_ws("/", season, division)


def normalize_alias(name: Column) -> Column:
    return F.lower(strip(name))


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def canonical_name(name: Column) -> Column:
    return F.translate(F.lower(strip(name)), "- ", "__")


def is_sensitive(name: Column) -> Column:
    return canonical_name(name).isin(*SENSITIVE_NAMES)


@F.pandas_udf(StringType())
def _canonical_json(endpoint: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([
        json.dumps({"endpoint": e.strip(), "params": dict(p or [])}, sort_keys=True, separators=(",", ":"))
        for e, p in zip(endpoint, params)
    ])


def request_signature(endpoint: Column, params: Column) -> Column:
    """sha256 of endpoint and non-credential parameters as compact sorted ASCII JSON; `params` is map<string,string>."""
    kept = F.map_filter(params, lambda k, v: ~is_sensitive(k))
    return F.sha2(_canonical_json(endpoint, kept), 256)


def scrub_map(params: Column) -> Column:
    """Credential values of a flat map replaced by a marker."""
    return F.transform_values(params, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))


def _scrub(value):
    if isinstance(value, dict):
        hidden = {k: k.strip().lower().replace("-", "_").replace(" ", "_") in SENSITIVE_NAMES for k in value}
        return {k: REDACTED if hidden[k] else _scrub(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_scrub(v) for v in value]
    return value


@F.pandas_udf(StringType())
def scrub_json(text: pd.Series) -> pd.Series:
    """The same at any depth of a JSON document."""
    return text.map(lambda t: None if t is None else json.dumps(_scrub(json.loads(t)), separators=(",", ":")))


def persistable_headers(entries: Column) -> Column:
    """array<struct<name,value>> -> map: lower-cased names, first occurrence wins, whitelist only."""
    lowered = F.transform(entries, lambda e: F.struct(F.lower(strip(e["name"])).alias("name"), e["value"].alias("value")))
    names = F.transform(lowered, lambda e: e["name"])
    kept = F.filter(
        lowered, lambda e, i: e["name"].isin(*PERSISTED_HEADERS) & (F.array_position(names, e["name"]) == i + 1)
    )
    return F.map_from_entries(kept)


def status_to_problem(status: Column) -> Column:
    """HTTP status -> problem kind; NULL for success. A request without a status timed out."""
    return (
        F.when(status.isNull(), "timeout")
        .when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status.isin(401, 407), "authentication")
        .when(status == 403, "authorization")
        .when(status == 404, "not_found")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "provider_server")
        .otherwise("malformed_payload")
    )


def is_transient(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TRANSIENT_KINDS), F.lit(False))
