"""Message normalization and fingerprints (T7-T10) as native Column expressions.

Everything here compiles to ``regexp_replace`` / ``md5`` / higher-order array
functions, so it stays inside whole-stage codegen: no Python UDF anywhere.

The rule set is written in RE2 syntax (the dialect the grouping rules were
defined in).  Java's regex engine differs in three places that matter for
byte-identical fingerprints, so each pattern is rewritten before use:

* ``\\b`` is Unicode-aware in Java 17 (``é1`` has no boundary there, but has one
  in RE2) -> explicit ASCII look-around;
* ``\\s`` in Java also matches vertical tab -> explicit ``[\\t\\n\\f\\r ]``;
* ``\\S`` accordingly -> ``[^\\t\\n\\f\\r ]``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.frames import let

# ---------------------------------------------------------------------------
# The normalization rules (RE2 syntax), applied in this order,
# each replacing all matches.  They must equal the original grouping rules or
# fingerprints (and with them issue ids) change.
# ---------------------------------------------------------------------------
TIMESTAMP_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z",
    r"\b\d{10}\b",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{2}:\d{2}:\d{2}",
    r"\d{1,2}:\d{2}\s*(?:AM|PM)",
]
UUID_PATTERN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
URL_PATTERNS = [
    r"https?://\S+",
    r"(?:/[^/\s]+)+/[^/\s]*",
    r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*',
]
IP_PATTERNS = [
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
]
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
VERSION_PATTERN = r"\bv?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9]+)?\b"
# (pattern, replacement).  The replacement is the pattern text before "[=:]"
# followed by "=<id>", so it keeps a literal backslash-b: "id=7" -> "\bid=<id>".
ID_PATTERNS = [
    (r"\bid[=:]\s*\d+\b", r"\bid=<id>"),
    (r"\buserid[=:]\s*\d+\b", r"\buserid=<id>"),
    (r"\buser_id[=:]\s*\d+\b", r"\buser_id=<id>"),
    (r"\bsession[=:]\s*[a-zA-Z0-9]+\b", r"\bsession=<id>"),
    (r"\btoken[=:]\s*[a-zA-Z0-9]+\b", r"\btoken=<id>"),
]
NUMBER_PATTERNS = [
    r"\b\d{6,}\b",
    r"\b\d+\.\d+\b",
    r"\b0x[a-fA-F0-9]+\b",
    r"\b[a-fA-F0-9]{8,}\b",
]
WHITESPACE_PATTERN = r"\s+"
# Modules whose frames never name the culprit.
IGNORED_CULPRIT_MODULES = [
    "github.com/buger/jsonparser",
    "github.com/rs/zerolog",
    "github.com/getsentry/sentry-go",
]
# Characters trimmed from both ends of a normalized message (Unicode White_Space).
TRIM_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + (
    "\u2028\u2029\u202f\u205f\u3000")
# Placeholder texts.
NO_ERROR_MESSAGE = "(No error message)"
DEFAULT_EXCEPTION_TYPE = "Error"


def rules() -> list[tuple[str, str]]:
    """The whole pipeline as ordered (RE2 pattern, replacement text) pairs.

    Replacement texts are literal, except that a backslash is written doubled
    (the escape both Java and RE2 rewrite strings use for a literal one).
    """
    steps: list[tuple[str, str]] = [(p, "<timestamp>") for p in TIMESTAMP_PATTERNS]
    steps.append((UUID_PATTERN, "<uuid>"))
    steps += [(p, "<path>") for p in URL_PATTERNS]
    steps += [(p, "<ip>") for p in IP_PATTERNS]
    steps.append((EMAIL_PATTERN, "<email>"))
    steps.append((VERSION_PATTERN, "<version>"))
    steps += [(p, r.replace("\\", "\\\\")) for p, r in ID_PATTERNS]
    steps += [(p, "<number>") for p in NUMBER_PATTERNS]
    steps.append((WHITESPACE_PATTERN, " "))
    return steps


_WORD = "[0-9A-Za-z_]"
_ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_AFTER_WORD = f"(?<!{_WORD})"
_NOT_BEFORE_WORD = f"(?!{_WORD})"
# A token that can only match word characters: \d, a class of letters/digits
# ranges, a literal letter/digit (optionally behind "(?:" or "v?").
_WORD_TOKEN_AHEAD = re.compile(r"^(?:\(\?:)?(?:v\?)?(?:\\d|\[[0-9A-Za-z-]+\]|[0-9A-Za-z_])")
_WORD_TOKEN_BEHIND = re.compile(r"(?:\\d|\[[0-9A-Za-z-]+\])(?:\+|\{\d+(?:,\d*)?\})$")


def _boundary(re2: str, i: int) -> str:
    """Java form of the RE2 ``\b`` at position ``i``.

    Next to a token that always matches a word character a boundary only has
    to look at the other side, which is much cheaper than the general form
    that is evaluated at every start position of the scan.
    """
    if _WORD_TOKEN_AHEAD.match(re2[i + 2:]):
        return _NOT_AFTER_WORD
    if i + 2 == len(re2) and _WORD_TOKEN_BEHIND.search(re2[:i]):
        return _NOT_BEFORE_WORD
    return _ASCII_BOUNDARY


def to_java_regex(re2: str) -> str:
    """Rewrite RE2 shorthands whose Java meaning differs into explicit ASCII forms."""
    out = []
    i = 0
    in_class = False
    while i < len(re2):
        ch = re2[i]
        if ch == "\\" and i + 1 < len(re2):
            nxt = re2[i + 1]
            if nxt == "b" and not in_class:
                out.append(_boundary(re2, i))
            elif nxt == "s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            elif nxt == "S" and not in_class:
                out.append(r"[^\t\n\f\r ]")
            else:
                out.append(re2[i : i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class and out and out[-1] not in ("[", "[^"):
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


#: A text that every match of the pattern contains: where it is missing, the pattern needs no scan.
NEEDS = {
    **dict(zip(TIMESTAMP_PATTERNS, ["-", "-", None, "-", "/", "-", ":", "M"], strict=True)),
    UUID_PATTERN: "-",
    **dict(zip(URL_PATTERNS, ["://", "/", ":\\"], strict=True)),
    **dict(zip(IP_PATTERNS, [".", ":"], strict=True)),
    EMAIL_PATTERN: "@",
    VERSION_PATTERN: ".",
    **dict(zip([p for p, _ in ID_PATTERNS], ["id", "userid", "user_id", "session", "token"], strict=True)),
    **dict(zip(NUMBER_PATTERNS, [None, ".", "0x", None], strict=True)),
}
_JAVA_RULES = [(to_java_regex(p), r, NEEDS.get(p)) for p, r in rules()]


def normalize_message(c: Column) -> Column:
    """One pass of the normalization pipeline; '' stays ''.  NULL stays NULL."""

    def step(pattern: str, repl: str, need: str | None) -> Callable[[Column], Column]:
        return lambda x: F.when(x.contains(F.lit(need)), F.regexp_replace(x, pattern, repl)).otherwise(x)

    out = c
    for pattern, repl, need in _JAVA_RULES:
        out = F.regexp_replace(out, pattern, repl) if need is None else let(out, step(pattern, repl, need))
    return F.trim(out, F.lit(TRIM_CHARS))


def normalize_exceptions(exceptions: Column) -> Column:
    """Normalize the ``value`` of every exception (context lines are never stored)."""
    return F.transform(exceptions, lambda e: e.withField("value", normalize_message(e["value"])))


def frame_module(frame: Column) -> Column:
    """A frame's module, falling back to its package when the module is empty."""
    m = F.coalesce(frame["module"], F.lit(""))
    return F.when(m != "", m).otherwise(F.coalesce(frame["package"], F.lit("")))


def _str(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _frames_of(e: Column) -> Column:
    return F.coalesce(e["stacktrace"]["frames"], F.array())


def stack_fingerprint(exceptions: Column) -> Column:
    """T9 stack path: md5 over exceptions of type + hashed frames + normalized value.

    Frames are the in-app ones, or all of them when none is in-app; each adds
    module + function + line number floored to a multiple of ten.  ``exceptions``
    must already be normalized once (T8): the value is normalized again here.
    """

    def frame_text(f: Column) -> Column:
        line = F.floor(F.coalesce(f["lineno"], F.lit(0)).cast("bigint") / 10) * 10
        return F.concat(frame_module(f), _str(f["function"]), line.cast("bigint").cast("string"))

    def exc_text(e: Column) -> Column:
        frames = _frames_of(e)
        in_app = F.filter(frames, lambda f: F.coalesce(f["in_app"], F.lit(False)))
        chosen = F.when(F.size(in_app) > 0, in_app).otherwise(frames)
        return F.concat(
            _str(e["type"]),
            F.array_join(F.transform(chosen, frame_text), ""),
            _str(normalize_message(e["value"])),
        )

    return F.md5(F.array_join(F.transform(exceptions, exc_text), ""))


def message_fingerprint(message: Column, level: Column, platform: Column) -> Column:
    """T9 message path: md5(normalize(message) + level + platform), level/platform raw."""
    return F.md5(F.concat(_str(normalize_message(message)), _str(level), _str(platform)))


def has_stack(exceptions: Column) -> Column:
    """Stack path iff the first exception has at least one frame."""
    first = F.get(exceptions, 0)
    return F.coalesce(F.size(_frames_of(first)) > 0, F.lit(False))


def fingerprint(message: Column, level: Column, platform: Column, exceptions: Column | None) -> Column:
    """The grouping hash of an event.

    The message and the exception values are normalized before the dispatch
    and once more inside each path (the rule applies normalization twice).
    """
    norm_msg = normalize_message(_str(message))
    if exceptions is None:  # events without exception data: message path only
        return message_fingerprint(norm_msg, level, platform)
    exc = F.coalesce(exceptions, F.array())
    # Normalizing leaves the frames alone: the path is chosen first, and only its texts are normalized.
    return F.when(has_stack(exc), stack_fingerprint(normalize_exceptions(exc))).otherwise(
        message_fingerprint(norm_msg, level, platform)
    )


def raw_fingerprint(message: Column, exceptions: Column) -> Column:
    """Legacy hash without normalization.

    Stack path: per exception the frames' module + function, then its type.
    Message path: md5(message).
    """
    exc = F.coalesce(exceptions, F.array())

    def exc_text(e: Column) -> Column:
        frames = F.array_join(
            F.transform(_frames_of(e), lambda f: F.concat(frame_module(f), _str(f["function"]))), ""
        )
        return F.concat(frames, _str(e["type"]))

    return F.when(has_stack(exc), F.md5(F.array_join(F.transform(exc, exc_text), ""))).otherwise(
        F.md5(_str(message))
    )


def issue_id(pid: Column, fp: Column) -> Column:
    """Stable issue id of (project, fingerprint): first 60 bits of md5, as a positive bigint.

    Deterministic and computed row-locally, so new issues need no global sort
    or counter, and any engine with md5 can reproduce it.
    """
    key = F.concat(pid.cast("string"), F.lit(":"), fp)
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
