"""Scalar column functions (X*): codes, names, lookups, durations.

All are built-in expressions (``when`` chains, map lookups, regex extracts), so
they fold into the surrounding whole-stage-codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.frames import let

# ---------------------------------------------------------------------------
# Enumerations of the data model.
# ---------------------------------------------------------------------------
LEVELS = {"fatal": 1, "error": 2, "warning": 3, "info": 4, "debug": 5, "trace": 6, "unknown": 7}
PLATFORM_CODES = {"go": 1, "rust": 2}  # anything else -> 0
PLATFORM_NAMES = {1: "Go", 2: "Rust"}  # anything else -> "unknown"
SDK_IDS = {"sentry.go": 1, "sentry.rust": 2}  # anything else -> 0
PRIORITY_NAMES = {1: "Low", 2: "Med", 3: "High"}  # anything else -> "Unknown"
PRIORITY_HIGH = 3
EVENT_TYPE_EXCEPTION = 1
ALERT_ACTIVE, ALERT_INACTIVE, ALERT_TRIGGERED = "Active", "Inactive", "Triggered"
CONDITION_OCCURRENCES, CONDITION_USERS = 1, 2
# UI texts (default "occurrences" / "1 hour") and webhook payload names (default "unknown").
CONDITION_TEXT = {1: "occurrences", 2: "users affected"}
CONDITION_NAME = {1: "occurrences", 2: "users_affected"}
TIMEFRAME_TEXT = {1: "1 minute", 2: "5 minutes", 3: "15 minutes", 4: "1 hour", 5: "1 day", 6: "1 week", 7: "30 days"}
TIMEFRAME_NAME = {1: "1m", 2: "5m", 3: "15m", 4: "1h", 5: "1d", 6: "1w", 7: "30d"}
TIMEFRAME_SECONDS = {1: 60, 2: 300, 3: 900, 4: 3600, 5: 86400, 6: 604800, 7: 2592000}  # unknown -> 3600
DURATION_UNIT_SECONDS = {"h": 3600, "m": 60, "s": 1, "d": 86400, "w": 604800}
NO_VALUE = "(no value)"


def _lookup(c: Column, mapping: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def level_code(name: Column) -> Column:
    """Level name -> code, case-insensitive; anything else -> 7."""
    return _lookup(F.lower(name), LEVELS, LEVELS["unknown"]).cast("smallint")


def platform_code(name: Column) -> Column:
    """X8: 'go' -> 1, 'rust' -> 2 (case-sensitive), else 0."""
    return _lookup(name, PLATFORM_CODES, 0).cast("smallint")


def platform_name(code: Column) -> Column:
    return _lookup(code, PLATFORM_NAMES, "unknown")


def sdk_id(name: Column) -> Column:
    """Exact SDK name -> id, else 0."""
    return _lookup(name, SDK_IDS, 0).cast("smallint")


def priority_name(code: Column) -> Column:
    return _lookup(code, PRIORITY_NAMES, "Unknown")


def condition_text(c: Column) -> Column:
    return _lookup(c, CONDITION_TEXT, "occurrences")


def condition_name(c: Column) -> Column:
    return _lookup(c, CONDITION_NAME, "unknown")


def timeframe_text(c: Column) -> Column:
    return _lookup(c, TIMEFRAME_TEXT, "1 hour")


def timeframe_name(c: Column) -> Column:
    return _lookup(c, TIMEFRAME_NAME, "unknown")


def timeframe_seconds(c: Column) -> Column:
    """A3: rule timeframe code -> seconds; unknown -> one hour."""
    return _lookup(c, TIMEFRAME_SECONDS, 3600).cast("bigint")


def display_user(email: Column, username: Column, user_ref: Column, name: Column) -> Column:
    """First non-empty of email, username, id, name, else '(no value)'."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (email, username, user_ref, name)], F.lit(NO_VALUE))


def percents_floor(c: Column) -> Column:
    """X11: whole percent (floor)."""
    return F.floor(c).cast("bigint")


def id_no_dashes(c: Column) -> Column:
    """Canonical id text without dashes."""
    return F.replace(c, F.lit("-"), F.lit(""))


def tag_value(tags: Column, key: str | Column) -> Column:
    """Value of the first tag named ``key`` (case-sensitive), '' if absent."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.get(F.transform(F.filter(tags, lambda t: t["key"] == k), lambda t: t["value"]), 0),
                      F.lit(""))


def context_map(contexts: Column) -> Column:
    """Contexts as a map; a later duplicate key wins."""
    last = F.filter(
        contexts,
        lambda t, i: ~F.exists(F.slice(contexts, i + 2, F.greatest(F.size(contexts), F.lit(1))),
                               lambda y: y["key"] == t["key"]),
    )
    return F.map_from_entries(last)


def parse_duration(text: Column) -> Column:
    """X1: '<int><h|m|s|d|w>' -> seconds (absolute value); '' -> 0; anything else -> NULL."""
    m = F.regexp_extract(text, r"^([+-]?[0-9]+)([hmsdw])$", 1)
    unit = F.regexp_extract(text, r"^([+-]?[0-9]+)([hmsdw])$", 2)
    mult = _lookup(unit, DURATION_UNIT_SECONDS, None)
    secs = F.abs(m.try_cast("bigint")) * mult
    return F.when(text == "", F.lit(0).cast("bigint")).when(m != "", secs.cast("bigint"))


def parse_time(text: Column) -> Column:
    """X2: 'yyyy-MM-ddTHH:mm:ss' with an optional fraction, UTC; NULL when invalid."""
    t = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
    )
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?$")
    return F.when(ok, t.cast("timestamp_ntz"))


def parse_time_range(start: Column, end: Column) -> Column:
    """Both bounds required; struct(start, end) or NULL when either is invalid."""
    a, b = parse_time(start), parse_time(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


# Literal patterns replaced by '?' when grouping a query log (RE2 syntax).
QUERY_LITERAL_RULES = [(r"'(?:[^'\\]|\\.)*'", "?"), (r"\b\d+(?:\.\d+)?\b", "?"), (r"\s+", " ")]


def strip_query_literals(q: Column) -> Column:
    """Query text with string and number literals replaced by '?' (Q19)."""
    from faultline.functions.normalize import to_java_regex

    out = q
    for pattern, repl in QUERY_LITERAL_RULES:
        out = F.regexp_replace(out, to_java_regex(pattern), repl)
    return out


def ts_lit(t) -> Column:
    """A zone-free TIMESTAMP_NTZ literal from a naive datetime (UTC wall clock) or text."""
    text = t if isinstance(t, str) else t.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def trunc_ntz(unit: str, c: Column) -> Column:
    """``date_trunc`` that keeps TIMESTAMP_NTZ (the session zone is UTC)."""
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def stack_details(frames: Column) -> Column:
    """Stored frames as (filepath, function, lineno, in_app) in reverse order
    (innermost call first)."""
    return F.reverse(F.transform(frames, lambda f: F.struct(
        f["abs_path"].alias("filepath"), f["function"].alias("function"), f["lineno"].alias("lineno"),
        (f["in_app"] == 1).alias("in_app"))))


def context_groups(contexts: Column) -> Column:
    """Contexts (a later duplicate key wins) grouped by the key part before the
    first '.', keys without a '.' dropped; groups sorted by prefix, each with a
    map of the remaining key parts."""
    # Entries are read once for each prefix: they are computed before.
    def grouped(entries: Column) -> Column:
        prefixes = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.substring_index(e["key"], ".", 1))))
        return F.transform(prefixes, lambda p: F.struct(
            p.alias("prefix"),
            F.map_from_entries(F.transform(
                F.filter(entries, lambda e: F.substring_index(e["key"], ".", 1) == p),
                lambda e: F.struct(F.regexp_extract(e["key"], r"^[^.]*\.(.*)$", 1).alias("k"), e["value"].alias("v")),
            )).alias("fields")))

    return let(contexts, lambda c: let(F.filter(F.map_entries(context_map(c)), lambda e: F.instr(e["key"], ".") > 0), grouped))
