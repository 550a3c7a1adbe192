"""Order MinHash fingerprints in DataFrame functions.

The k-mers of a text are its runs of ``K`` words (A-Z as they are; a text with fewer words is one k-mer), numbered by
occurrence, so a repeated k-mer counts as often as it occurs.  Hashes of (k-mer, occurrence) are dealt to ``BINS`` bins
by their own bits; each bin selects the ``L`` smallest, puts them back into text order and hashes the tuple.  Moving a
passage changes tuples although the set of k-mers stays, which is what makes the signature follow edit distance.  One
hash serves all bins (one-permutation hashing), and bins look at all hashes of a text: only one without k-mers has no
entry, and one with fewer than L k-mers a shorter tuple.

The work is in arrays inside the row: longs packed as (hash | position) are sorted as primitives, so the cost is
n log n in the words of a text and no k-mer is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.frames import freeze
from faultline.llm.shared import materialize

K = 3
L = 2
BINS = 64
#: Most hashes of a text that the bins look at: all.
POOL = None
#: Bits for the position of a word (the hash keeps the others, of which the lowest BIN are the bin); texts beyond 2 ** 24 words keep their order in steps of 2 ** 24.
POS = 24
BIN = 6
#: Rows of one bucket of neighbouring ids, and most buckets (their table is broadcast: 2.4 MB).
BUCKET_ROWS = 4096
MAX_BUCKETS = 100_000


def _let(df: DataFrame, keep: list[str], carry: list[str], **exprs: str) -> DataFrame:
    """``keep``, ``carry`` and new columns, each computed once per row: behind a generator they can't be copied into the
    lambdas that read them."""
    return freeze(df, **{k: F.expr(e) for k, e in exprs.items()}).select(*keep, *carry, *exprs)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of longs, (bin << 32) | 32-bit tuple hash, by bin; empty for a text without words."""
    keep = df.columns
    low = f"{(1 << POS) - 1}L"
    head = f"~{low}"
    none, ints = "cast(array() AS array<bigint>)", "cast(array() AS array<int>)"
    words = f"split(trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+')"
    df = _let(df, keep, [], __w=f"transform({words}, x -> CASE WHEN x <> '' THEN xxhash64(x) END)")
    # k-mer hashes in text order, the low bits free for the position.
    more = ", ".join(f"__w[i + {j}]" for j in range(1, K))
    df = _let(df, keep, [], __q=f"""CASE WHEN __w[0] IS NULL THEN {none} WHEN size(__w) < {K} THEN array(xxhash64(__w) & {head})
        ELSE transform(slice(__w, 1, size(__w) - {K - 1}), (x, i) -> xxhash64(x, {more}) & {head}) END""")
    # Of texts with repeated k-mers: (k-mer | position) sorted, so that equal ones stand together in text order ...
    df = _let(df, keep, ["__q"], __k=f"CASE WHEN size(array_distinct(__q)) < size(__q) THEN sort_array(transform(__q, (x, i) -> x | (i & {low}))) ELSE {none} END")
    # ... the first place of each, and 0, 1, 2, ... along its run.
    df = _let(df, keep, ["__q", "__k"], __s=f"filter(transform(__k, (x, i) -> CASE WHEN i > 0 AND (__k[i - 1] & {head}) = (x & {head}) THEN -1 ELSE i END), i -> i >= 0)")
    df = _let(df, keep, ["__q", "__k"], __o=f"CASE WHEN size(__k) = 0 THEN {ints} ELSE flatten(transform(__s, (s, j) -> sequence(0, coalesce(get(__s, j + 1), size(__k)) - s - 1))) END")
    # Hashes of (k-mer, occurrence) with the position, as (bin, rest of the hash, position) in signed order.
    rest_of, top = 64 - POS - BIN, 1 << (63 - POS - BIN)
    packed = lambda x, pos: f"""transform({x}, x -> shiftleft((shiftrightunsigned(x, {POS}) & {BINS - 1}L) ^ {BINS // 2}L, {64 - BIN})
        | shiftleft(shiftrightunsigned(x, {POS + BIN}) ^ {top}L, {POS}) | ({pos}))"""  # noqa: E731
    hashed = f"""CASE WHEN size(__k) = 0 THEN transform(__q, (x, i) -> (xxhash64(x, 0) & {head}) | (i & {low}))
        ELSE transform(__k, (x, i) -> (xxhash64(x & {head}, __o[i]) & {head}) | (x & {low})) END"""
    df = _let(df, keep, [], __p=f"sort_array({packed(hashed, f'x & {low}')})")
    # The first L of each bin.
    df = _let(df, keep, [], __f=f"filter(__p, (x, i) -> i < {L} OR shiftrightunsigned(__p[i - {L}], {64 - BIN}) <> shiftrightunsigned(x, {64 - BIN}))")
    # Back in text order: (bin, position, place in __f), and the hashes.
    df = _let(df, keep, [], __t=f"""sort_array(transform(__f, (x, i) -> shiftleft(shiftrightunsigned(x, {64 - BIN}) ^ {BINS // 2}L, {POS + 16}) | ((x & {low}) << 16) | i))""",
              __h=f"""transform(__f, x -> shiftleft((shiftrightunsigned(x, {POS}) & {(1 << rest_of) - 1}L) ^ {top}L, {POS + BIN})
        | shiftleft(shiftrightunsigned(x, {64 - BIN}) ^ {BINS // 2}L, {POS}))""")
    df = _let(df, keep, ["__h", "__t"], __g=f"filter(transform(__t, (x, i) -> CASE WHEN i > 0 AND shiftright(__t[i - 1], {POS + 16}) = shiftright(x, {POS + 16}) THEN -1 ELSE i END), i -> i >= 0)")
    value = lambda at: f"get(__h, cast(get(__t, {at}) & 65535L AS int))"
    rest = "".join(f", CASE WHEN i + {j} < coalesce(get(__g, j + 1), size(__t)) THEN {value(f'i + {j}')} END" for j in range(1, L))
    return _let(df, keep, [], **{out: f"transform(__g, (i, j) -> (shiftright(__t[i], {POS + 16}) << 32) | (xxhash64({value('i')}{rest}) & 4294967295L))"})


def as_text(c: str) -> Column:
    """``bin.hash`` in hexadecimal, comma-joined."""
    return F.array_join(F.transform(c, lambda x: F.lower(F.concat_ws(".", F.hex(F.shiftright(x, 32)), F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))))), ",")


def likeness(a: str, b: str) -> Column:
    """Bins with equal tuples among the bins that either text has; 1 for two texts without words, else 0 if none."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.col(a), F.col(b))) / either)


def with_neighbours(rows: DataFrame) -> DataFrame:
    """Rows and, at the end of each bucket, a copy of the first row of the next one: columns bucket, is_end.

    The order is by descending doc_id (null last, equal ids by text); after the last row comes the first.  Ids are cut
    into equal ranges (buckets) that hold BUCKET_ROWS rows on average, so a window over one bucket sees every row's
    next.  The bounded table of buckets (two numbers each) is the only thing that is ordered as a whole.
    """
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    lo, hi, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    width = (hi - lo) // buckets + 1
    offset = F.col("doc_id").cast("decimal(38,0)") - F.lit(str(lo)).cast("decimal(38,0)")
    bucket = F.coalesce(F.floor(offset / F.lit(str(width)).cast("decimal(38,0)")).cast("long"), F.lit(-1))
    first = ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.struct(F.max("doc_id").alias("doc_id")).alias("of"))
    order = Window.orderBy(F.col("bucket").desc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = first.select("bucket", F.coalesce(F.lead("of").over(order), F.first("of").over(every))["doc_id"].alias("first_id"))
    ends = materialize(ends, "buckets")  # at most MAX_BUCKETS + 1 rows
    own = rows.withColumn("bucket", bucket).withColumn("is_end", F.lit(0))
    copy = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id")
    return own.unionByName(copy.withColumn("is_end", F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next text.
    Null texts are empty.  One shuffle moves each text and its fingerprint to its bucket.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprint(with_neighbours(rows), "text", "fp")
    order = Window.partitionBy("bucket").orderBy("is_end", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where("is_end = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
