"""Secret scan with multipart credential linking, in DataFrame functions.

Strong findings (always reported), leftmost and non-overlapping by kind:
``assign`` (a credential word with a value of 6 characters or more), ``access`` (access identifiers), ``hex`` (runs of
24 hexadecimal digits or more).

Weak candidates alone say little: ``login`` (a user or client id that is assigned), ``blob`` (a run of 32 or more
base64 characters with a digit, an upper and a lower case letter), ``endpoint`` (a URL or an IPv4 address).  They are
reported only where at most ``WITHIN`` code points lie between them and complementary parts in the same scope (scopes end
at blank lines), whichever comes first and however long they are: a login next to a secret, a blob next to an identifier, an endpoint next to both.  Identifiers are access
and login, secrets assign, hex and blob.  A weak candidate that overlaps a strong finding is part of it and dropped.

The interval join is two running windows over the parts of one scope in order of position: the largest end of the parts
before a part, and the smallest start of those after it, are its nearest ones, so pairs are never listed.  Offsets come from the lengths of matches and of the pieces
between them, summed along the text.  One shuffle moves the parts (not the texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import materialize

WITHIN = 200

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_id|[Aa]ccount)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[a-z]{2,10}://[A-Za-z0-9.:/_-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"""
BREAK = r"\n[\x20\t]*\n"
#: In the order that ties in start follow.
KINDS = ["assign", "access", "hex", "login", "blob", "endpoint"]


def _matches(no: int, pattern: str, ok=None) -> Column:
    """Matches in order: (kind, pos, gap before, length, ok)."""
    text = F.col("__text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), found.alias("text"))
    if ok is None:
        rows = F.transform(both, lambda m, i: F.struct(F.lit(no).alias("kind"), i.alias("pos"), m["gap"].alias("gap"), F.length(m["text"]).alias("len"), F.lit(True).alias("ok")))
    else:
        rows = F.transform(both, lambda m, i: F.struct(F.lit(no).alias("kind"), i.alias("pos"), m["gap"].alias("gap"), F.length(m["text"]).alias("len"), ok(m["text"]).alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"))


def parts() -> Column:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    strong = F.concat(
        _matches(0, ASSIGN, value), _matches(1, ACCESS, lambda m: F.length(m) >= 20), _matches(2, HEX),
        _matches(3, LOGIN), _matches(4, BLOB, mixed), _matches(5, ENDPOINT),
    )
    # Scopes matter only to texts with findings.
    return F.when(F.size(strong) > 0, F.concat(strong, _matches(6, BREAK))).otherwise(strong)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_key, n_assign, n_access, n_hex, base_sha256, spans, n_weak, found (array
    of start, kind number, text, end), one row per input row.

    spans and the digest's text: ``kind:start:end`` by start, then kind, comma-joined; code points, end exclusive.
    Null texts are empty.  Rows are told apart by their place in the input, which has to be read in the same order
    when a task is repeated (files are).
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.select("__row", "doc_id", "text_key", parts().alias("part"))
    rows = rows.select("__row", "doc_id", "text_key", F.explode_outer("part").alias("part")).select("__row", "doc_id", "text_key", "part.*")
    rows = rows.repartition("__row")
    order = Window.partitionBy("__row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.where("ok OR kind IS NULL")
    along = Window.partitionBy("__row").orderBy("start", "kind")
    rows = rows.withColumn("scope", F.sum((F.col("kind") == 6).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    strong_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("__row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    strong_start = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(back)
    weak = F.col("kind").isin(3, 4, 5)
    inside = weak & (F.coalesce(strong_end > F.col("start"), F.lit(False)) | F.coalesce(strong_start < F.col("end"), F.lit(False)))
    rows = rows.withColumn("inside", inside).where("kind IS NULL OR NOT inside")
    scope = Window.partitionBy("__row", "scope")
    before = scope.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    sides = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4)}
    for name, mine in sides.items():
        rows = rows.withColumn(f"{name}_end", F.max(F.when(mine, F.col("end"))).over(before))
    for name, mine in sides.items():
        rows = rows.withColumn(f"{name}_start", F.min(F.when(mine, F.col("start"))).over(after))
    near = {n: F.coalesce(F.col("start") - F.col(f"{n}_end") <= WITHIN, F.lit(False)) | F.coalesce(F.col(f"{n}_start") - F.col("end") <= WITHIN, F.lit(False)) for n in sides}
    linked = (
        F.when(F.col("kind") == 3, near["secret"]).when(F.col("kind") == 4, near["id"])
        .when(F.col("kind") == 5, near["id"] & near["secret"]).otherwise(F.col("kind") < 3)
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    name = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start"), F.col("end"))
    span = F.struct("start", "kind", name.alias("text"), "end")
    out = rows.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sort_array(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(linked, span))).alias("every"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), ",")
    return out.select(
        "doc_id", "text_key", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_weak"), F.col("every").alias("found"),
    )


def redacted(text: str, found: str) -> Column:
    """The text with every finding replaced by ``[kind]``; of overlapping ones the first gives the name."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        out = F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; findings in its text become ``[kind]`` and n_chars, if there, the new
    length.  Only documents with findings are joined (by id and text hash), from a written table."""
    hits = scan(docs.select("doc_id", "text")).where("spans <> ''").select("doc_id", "text_key", "found")
    hits = materialize(hits.dropDuplicates(["doc_id", "text_key"]), "findings").toDF("__id", "__key", "__found")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    out = docs.join(hits, same, "left")
    out = out.withColumn("text", F.when(F.col("__found").isNotNull(), redacted("text", "__found")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__found").isNotNull(), changed).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
