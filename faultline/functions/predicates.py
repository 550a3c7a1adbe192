"""Predicates (P*) and the search mini-language, as Column expressions.

The search language is parsed twice over: ``parse_query`` parses one ad-hoc
query string (a request parameter, a few bytes) on the driver into tokens that
become a Column predicate; ``query_tokens`` parses a *column* of query texts
(a table of saved searches) with SQL array functions, so thousands of saved
searches are matched against the events in one distributed join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
IS, IS_NOT = "is", "is not"


def ascii_lower(c: Column) -> Column:
    """Lower-case ASCII letters only (case folding of the store's substring search)."""
    return F.translate(c, _UPPER, _LOWER)


def contains_ci(haystack: Column, needle: str | Column) -> Column:
    """ASCII case-insensitive substring test; an empty needle always matches."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.instr(ascii_lower(F.coalesce(haystack, F.lit(""))), ascii_lower(n)) > 0


def stored_tag_token(key: Column, value: Column) -> Column:
    """Stored side of a tag probe: escape(key) + '=' + value (escape puts a backslash before '=' and '\\')."""
    return F.concat(F.regexp_replace(key, r"([=\\])", r"\\$1"), F.lit("="), value)


def has_tag(tags: Column, key: str | Column, value: str | Column) -> Column:
    """P5: does any stored tag token equal the raw probe ``key=value`` (probe is *not* escaped)."""
    k = F.lit(key) if isinstance(key, str) else key
    v = F.lit(value) if isinstance(value, str) else value
    probe = F.concat(k, F.lit("="), v)
    return F.coalesce(F.exists(tags, lambda t: stored_tag_token(t["key"], t["value"]) == probe), F.lit(False))


def tag_filter(tags: Column, key: str, value: str, negate: bool = False) -> Column:
    """P5: tag equals / not equals; negation keeps events lacking the tag."""
    c = has_tag(tags, key, value)
    return ~c if negate else c


def in_range(c: Column, frm, to, closed_upper: bool) -> Column:
    """``frm <= c < to`` or ``frm <= c <= to``."""
    lo = c >= F.lit(frm)
    return lo & ((c <= F.lit(to)) if closed_upper else (c < F.lit(to)))


# ---------------------------------------------------------------------------
# Search mini-language
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Token:
    key: str = ""
    operator: str = ""
    value: str = ""
    is_raw_text: bool = False


#: A piece of a query: quoted segments and characters other than space and quotes (an unclosed quote runs to the end).
PIECE = r"""(?:"[^"]*"?|'[^']*'?|[^ "'])+"""
GROUPED = r"""(?:"([^"]*)"?|'([^']*)'?)"""


def _unquoted(v: str) -> str:
    """A value without a pair of equal quotes around it."""
    return re.sub(r"""^(["'])([\s\S]*)\1$""", r"\2", v)


def _pieces(q: str) -> list[str]:
    texts = (re.sub(GROUPED, r"\1\2", p) for p in re.findall(PIECE, q))
    return [t for t in texts if t]


def parse_query(q: str) -> list[Token]:
    """P6 for one request parameter: 'k:v', 'k:!v' or raw text (``query_tokens`` for a column)."""
    found = (re.fullmatch(r"(?:([^:]*):(!?))?([\s\S]*)", t).groups() for t in _pieces(q))
    return [
        Token(value=_unquoted(value), is_raw_text=True) if key is None else Token(key, IS_NOT if no else IS, _unquoted(value))
        for key, no, value in found
    ]


def parse_query_v2(q: str) -> list[Token]:
    """The second dialect, 'key:value' or 'key:op:value' (the value keeps further colons); op '' is ``is``, '!'
    is ``is not``, any other stays as it is; raw text is dropped."""
    names = {"": IS, "!": IS_NOT}
    found = (re.fullmatch(r"([^:]*):(?:([^:]*):)?([\s\S]*)", t) for t in _pieces(q))
    return [Token(m[1], names.get(m[2] or "", m[2]), _unquoted(m[3])) for m in found if m]


def event_list_predicate(tokens: list[Token], message: Column, tags: Column) -> Column:
    """Raw tokens joined by one space into one phrase searched in the message;
    tag tokens become tag tests, and a repeated key keeps only its last token."""
    raw = " ".join(t.value for t in tokens if t.is_raw_text)
    structured: dict[str, Token] = {}
    for t in tokens:
        if not t.is_raw_text:
            structured[t.key] = t
    cond = F.lit(True)
    if raw:
        cond = cond & contains_ci(message, raw)
    for k, t in structured.items():
        cond = cond & tag_filter(tags, k, t.value, t.operator == IS_NOT)
    return cond


def group_search_predicate(tokens: list[Token], message: Column, title: Column, tags: Column) -> Column:
    """Every token applies; raw text matches message OR title."""
    cond = F.lit(True)
    for t in tokens:
        if t.is_raw_text:
            cond = cond & (contains_ci(message, t.value) | contains_ci(title, t.value))
        else:
            cond = cond & tag_filter(tags, t.key, t.value, t.operator == IS_NOT)
    return cond


def tag_probes(tokens: list[Token]) -> list[str]:
    """Stored tag tokens that an event must have to match the query (its positive tag tests)."""
    return [f"{t.key}={t.value}" for t in tokens if not t.is_raw_text and t.operator == IS]


def query_tokens(q: Column) -> Column:
    """P6 over a column of query texts -> array<struct<key, operator, value, is_raw_text>>.

    A piece is a maximal run of quoted segments and characters other than
    space and quotes (an unclosed quote runs to the end); its grouping quotes
    are then dropped, empty pieces give no token, and each piece is split into
    key / operator / value at its first ':' exactly like ``parse_query``.
    """
    texts = F.filter(F.transform(F.regexp_extract_all(q, F.lit(PIECE), 0), _group_unquote),
                     lambda t: F.length(t) > 0)

    def to_struct(t: Column) -> Column:
        has_colon = F.instr(t, ":") > 0
        key = F.substring_index(t, ":", 1)
        rest = F.regexp_extract(t, r"^[^:]*:([\s\S]*)$", 1)
        neg = rest.startswith("!")
        val = F.when(neg, F.substring(rest, 2, 1 << 30)).otherwise(rest)
        return F.when(
            has_colon,
            F.struct(key.alias("key"), F.when(neg, F.lit(IS_NOT)).otherwise(F.lit(IS)).alias("operator"),
                     _strip_quotes_col(val).alias("value"), F.lit(False).alias("is_raw_text")),
        ).otherwise(
            F.struct(F.lit("").alias("key"), F.lit("").alias("operator"), _strip_quotes_col(t).alias("value"),
                     F.lit(True).alias("is_raw_text"))
        )

    return F.transform(texts, to_struct)


def _group_unquote(p: Column) -> Column:
    """Drop the grouping quote characters of one piece (an unclosed quote runs to the end)."""
    return F.regexp_replace(p, GROUPED, "$1$2")


def _strip_quotes_col(v: Column) -> Column:
    first, last = F.substring(v, 1, 1), F.substring(v, -1, 1)
    quoted = (F.length(v) >= 2) & (first == last) & first.isin('"', "'")
    return F.when(quoted, F.regexp_extract(v, r"^.([\s\S]*).$", 1)).otherwise(v)


def tokens_match(tokens: Column, message: Column, title: Column, tags: Column) -> Column:
    """P8 over a token array column: all tokens hold for the event."""
    def one(t: Column) -> Column:
        tag_hit = has_tag(tags, t["key"], t["value"])
        return F.when(t["is_raw_text"], contains_ci(message, t["value"]) | contains_ci(title, t["value"])).when(
            t["operator"] == IS_NOT, ~tag_hit).otherwise(tag_hit)

    return F.forall(tokens, one)
