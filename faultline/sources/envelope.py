"""Envelope source (S1) and the header / body field parsers.

An envelope is the raw text an SDK posts: a header line, an item header line
and the event JSON on the **third** line.  ``parse_envelopes`` turns a
DataFrame of envelopes (one row each; read them with ``spark.read.text(...,
wholetext=True)``, ``binaryFile`` or from a stream) into typed event rows plus
a dead-letter DataFrame with a ``reason`` column.

The event JSON is parsed once into a VARIANT (``try_parse_json``; of a repeated
key the last value counts, as in the original's decoder).  Spark's
``from_json`` silently turns ``"level": 5`` into the string "5", while the
original decoder rejects a wrong JSON type; so every field is type-checked on
the variant before the typed struct is extracted with ``try_variant_get``: an
object or a list is opened by one cast to variants of its members, and only
scalars are asked for their type (``schema_of_variant`` of an object would
describe everything below it).  The polymorphic fields (timestamp: string or number;
exception / threads: list or ``{"values": list}``) are read by shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.frames import freeze, let

MAX_ENVELOPE_BYTES = 1024 * 1024  # fixed value: 1 MiB per envelope

# Reject reasons, in the order the checks run.
R_PROJECT_ID = "invalid project identifier"
R_DSN = "invalid dsn"
R_SIZE = "envelope too large"
R_LINES = "premature end of input"
R_BODY = "invalid event body"
R_PROJECT = "project not found"
R_ADDR = "invalid remote addr"

FRAME = T.StructType([
    T.StructField("function", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("package", T.StringType()),
    T.StructField("abs_path", T.StringType()),
    T.StructField("context_line", T.StringType()),
    T.StructField("pre_context", T.ArrayType(T.StringType())),
    T.StructField("post_context", T.ArrayType(T.StringType())),
    T.StructField("lineno", T.LongType()),
    T.StructField("in_app", T.BooleanType()),
])
STACKTRACE = T.StructType([T.StructField("frames", T.ArrayType(FRAME))])
EXCEPTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("stacktrace", STACKTRACE),
])
THREAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("stacktrace", STACKTRACE),
    T.StructField("current", T.BooleanType()),
])
USER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])
SDK = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("integrations", T.ArrayType(T.StringType())),
    T.StructField("packages", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))),
])
CONTEXTS = T.StructType([
    T.StructField("os", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("device", T.StructType([
        T.StructField("arch", T.StringType()), T.StructField("num_cpu", T.LongType())])),
    T.StructField("runtime", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("go_maxprocs", T.LongType()), T.StructField("go_numcgocalls", T.LongType()),
        T.StructField("go_numroutines", T.LongType())])),
])
# The event body minus its polymorphic fields (timestamp, exception, threads, extra).
BODY = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("modules", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("user", USER),
    T.StructField("sdk", SDK),
    T.StructField("contexts", CONTEXTS),
])

_INTS = ("TINYINT", "SMALLINT", "INT", "BIGINT")
_NUMS = _INTS + ("FLOAT", "DOUBLE")


def _vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _opened(dtype: T.DataType) -> str:
    """The type that a value of ``dtype`` is cast to in order to see its members, each as a variant."""
    if isinstance(dtype, T.StructType):
        return f"struct<{','.join(f'`{f.name}`:variant' for f in dtype.fields)}>"
    return "array<variant>" if isinstance(dtype, T.ArrayType) else "map<string,variant>"


def valid_as(base: Column, dtype: T.DataType, path: str = "$") -> Column:
    """Does the VARIANT value at ``path`` of ``base`` decode into ``dtype`` the way a
    strict JSON decoder would?

    JSON null (and an absent key) decodes into any type.  Strings must be
    strings, integers whole numbers, booleans booleans; objects and lists are
    checked field by field / element by element.  Every object and list is
    opened once, and its members are read from that.
    """
    v = base if path == "$" else F.try_variant_get(base, path, "variant")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return v.isNull() | F.is_variant_null(v) | let(
            F.try_variant_get(v, "$", _opened(dtype)), lambda x: x.isNotNull() & _members_valid(x, dtype))
    k = F.coalesce(_kind(v), F.lit("VOID"))
    if isinstance(dtype, T.DoubleType):
        return let(k, lambda x: x.isin("VOID", *_NUMS) | x.startswith("DECIMAL"))
    if isinstance(dtype, T.StringType):
        return k.isin("VOID", "STRING")
    if isinstance(dtype, T.BooleanType):
        return k.isin("VOID", "BOOLEAN")
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        return k.isin("VOID", *_INTS)
    return F.lit(True)  # pragma: no cover - every declared type is handled above


def _members_valid(x: Column, dtype: T.DataType) -> Column:
    """The members of an opened object or list decode; true, false, or null where ``x`` is null."""
    if isinstance(dtype, T.StructType):
        ok = F.lit(True)
        for f in dtype.fields:
            ok = ok & valid_as(x[f.name], f.dataType)
        return ok
    if isinstance(dtype, T.ArrayType):
        return F.forall(x, lambda e: valid_as(e, dtype.elementType))
    return F.forall(F.map_values(x), lambda e: valid_as(e, dtype.valueType))


def _list_or_values(v: Column, elem: T.StructType) -> tuple[Column, Column]:
    """T4: ``[...]`` or ``{"values": [...]}``; null / absent -> empty.  Returns (list, valid)."""
    arr_t = T.ArrayType(elem)
    as_list = F.try_variant_get(v, "$", arr_t.simpleString())  # null unless it is a list
    as_obj = F.try_variant_get(v, "$.values", arr_t.simpleString())
    valid = v.isNull() | F.is_variant_null(v) | let(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(
        x.isNotNull(), _members_valid(x, arr_t)).otherwise(valid_as(v, T.StructType([T.StructField("values", arr_t)]))))
    return F.coalesce(as_list, as_obj, F.array().cast(arr_t)), valid


def sdk_timestamp(v: Column) -> tuple[Column, Column]:
    """JSON string -> RFC 3339 time; JSON number -> unix seconds with fraction.

    Returns (timestamp as UTC wall clock, valid).  The value is parsed but,
    as in the original, not stored: the event time is the receive time.
    """
    k = _kind(v)
    text = F.when(k == "STRING", F.try_variant_get(v, "$", "string"))
    secs = F.try_variant_get(v, "$", "double")
    as_text = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]X")),
    )
    as_num = F.timestamp_micros(F.round(secs * 1_000_000).cast("bigint"))
    ts = F.when(k == "STRING", as_text).when(k.isin(*_NUMS) | k.startswith("DECIMAL"), as_num)
    valid = v.isNull() | (k == "VOID") | ((k == "STRING") & as_text.isNotNull()) | k.isin(*_NUMS) | k.startswith(
        "DECIMAL")
    return ts.cast("timestamp_ntz"), valid


def project_key(header: Column) -> Column:
    """The ``sentry_key=`` part of an auth header ('' if none or empty).

    Parts are split on ',' and trimmed; the first part starting with
    ``sentry_key=`` wins even when its value is empty.  If the raw header
    gives no key, the header without a leading ``Sentry `` is tried.
    """

    def from_text(h: Column) -> Column:
        parts = F.transform(F.split(h, ","), lambda p: F.trim(p))
        hit = F.get(F.filter(parts, lambda p: p.startswith("sentry_key=")), 0)
        return F.coalesce(F.substring(hit, len("sentry_key=") + 1, 1 << 30), F.lit(""))

    h = F.coalesce(header, F.lit(""))
    first = from_text(h)
    stripped = F.when(h.startswith("Sentry "), F.substring(h, len("Sentry ") + 1, 1 << 30)).otherwise(h)
    return F.when(first != "", first).otherwise(from_text(stripped))


def extra_entries(v: Column) -> Column:
    """``extra`` as array<struct<key, value>>: strings raw, anything else as JSON text.

    Keys come out sorted (VARIANT objects keep their keys sorted); the
    original prints non-strings as indented JSON, this prints compact JSON.
    """
    m = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(
        F.transform(
            F.map_entries(m),
            lambda e: F.struct(
                e["key"].alias("key"),
                F.when(_kind(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string"))
                .otherwise(F.to_json(e["value"])).alias("value"),
            ),
        ),
        F.array().cast("array<struct<key:string,value:string>>"),
    )


#: The fields that the checks read, each as a variant.
_TOP = T.StructType([*BODY.fields, *(T.StructField(n, T.VariantType()) for n in ("timestamp", "exception", "threads", "extra"))])


def _staged(raw: DataFrame, body: str, project_id: str, auth: str) -> tuple[DataFrame, dict[str, Column]]:
    """Envelopes with ``_reason`` (null: accepted), and the columns of an accepted event."""
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = F.split(F.col(body), "\n", -1)
    staged = freeze(
        raw,
        _pid=F.col(project_id).try_cast("int"),
        _key=project_key(F.col(auth)),
        _n_lines=F.size(lines),
        _bytes=F.octet_length(F.col(body)),
        _v=F.try_parse_json(F.get(lines, 2)),
    )
    staged = freeze(staged, _top=F.try_variant_get(F.col("_v"), "$", _opened(_TOP)))  # null unless it is an object
    v, top = F.col("_v"), F.col("_top")
    ts, ts_ok = sdk_timestamp(top["timestamp"])
    exc, exc_ok = _list_or_values(top["exception"], EXCEPTION)
    thr, thr_ok = _list_or_values(top["threads"], THREAD)
    extra_v = top["extra"]
    extra_ok = extra_v.isNull() | F.is_variant_null(extra_v) | F.try_variant_get(extra_v, "$", "map<string,variant>").isNotNull()
    body_ok = top.isNotNull() & _members_valid(top, BODY) & ts_ok & exc_ok & thr_ok & extra_ok
    reason = (
        F.when(F.col("_pid").isNull(), F.lit(R_PROJECT_ID))
        .when(F.col("_key") == "", F.lit(R_DSN))
        .when(F.col("_bytes") > MAX_ENVELOPE_BYTES, F.lit(R_SIZE))
        .when(F.col("_n_lines") < 3, F.lit(R_LINES))
        .when(~F.coalesce(body_ok, F.lit(False)), F.lit(R_BODY))
    )
    return freeze(staged, _reason=reason), {
        "project_id": F.col("_pid"),
        "project_key": F.col("_key"),
        "event": F.try_variant_get(v, "$", BODY.simpleString()),
        "sdk_ts": ts,
        "exceptions": exc,
        "threads": thr,
        "extra": extra_entries(extra_v),
    }


def parse_envelopes(raw: DataFrame, body: str = "body", project_id: str = "project_id",
                    auth: str = "auth") -> tuple[DataFrame, DataFrame]:
    """Envelopes -> (events, rejects).

    ``raw`` needs columns ``body`` (envelope text), ``project_id`` (text from
    the URL) and ``auth`` (the auth header); every other column is carried
    through.  ``events`` gets ``project_id`` (int), ``project_key``, ``body``
    (typed struct of the fixed fields), ``sdk_ts``, ``exceptions``,
    ``threads`` and ``extra``.  ``rejects`` keeps the input columns plus
    ``reason``.  Everything is row-local: no shuffle.
    """
    staged, fields = _staged(raw, body, project_id, auth)
    rejects = staged.where(F.col("_reason").isNotNull()).select(*raw.columns, F.col("_reason").alias("reason"))
    events = staged.where(F.col("_reason").isNull()).select(
        *[c for c in raw.columns if c != project_id], *[c.alias(n) for n, c in fields.items()])
    return events, rejects


def parse_all(raw: DataFrame) -> DataFrame:
    """S1 in one pass: every envelope with the columns of ``events`` (null if rejected), ``reason`` (null if accepted)
    and its input columns as the struct ``raw``."""
    staged, fields = _staged(raw, "body", "project_id", "auth")
    ok = F.col("_reason").isNull()
    return staged.select(
        *[c for c in raw.columns if c != "project_id"], *[F.when(ok, c).alias(n) for n, c in fields.items()],
        F.struct(*raw.columns).alias("raw"), F.col("_reason").alias("reason"))
