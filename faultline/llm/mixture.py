"""Mixing sources to target weights.

Sizes are numbers of words ``[^\\x20\\x09-\\x0D]+``.  Sources, ordered by code point with null last, weigh 5, 2, 1,
repeating, and share ``SHARE`` times the size of everything by weight; a target stops at ``MOST`` times its source's
size and the excess goes to the others by weight until none is above.  With r = MOST * size / weight in ascending
order, the level x = (all - capped targets) / (weights left) is that of the first source with x <= r; sources before it
are capped and the others get weight * x.  The rate of a source is target / size; a document is emitted floor(rate)
times and once more if its number in [0, 1), seeded by a hash of id and text, is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import materialize

SHARE = 1.5
MOST = 2.0
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from id and text: 52 bits of md5, the same in every run."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))]
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), parts[0], F.lit(":"), parts[1])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame) -> DataFrame:
    """sized(source, size) -> one row per source: source, source_size, target, rate.  Counts are summed before the
    shuffle; the windows see one row per source, all in one task, which takes n log n time in the number of sources."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (no % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(MOST))
    s = s.withColumn("r", F.col("cap") / F.col("weight"))
    order = [F.col("r"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    pool = F.sum("source_size").over(every) * F.lit(SHARE)
    # Weights are small whole numbers, so the difference is exact.
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("x", (pool - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left)
    s = s.withColumn("no", F.row_number().over(Window.orderBy(*order)))
    fits = F.when(F.col("x") <= F.col("r"), F.struct("no", "x"))
    s = s.withColumn("level", F.min(fits).over(every))
    target = F.when(F.col("no") >= F.col("level.no"), F.col("weight") * F.col("level.x")).otherwise(F.col("cap"))
    s = s.withColumn("target", F.least(target, F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "target", rate.alias("rate"))


def _planned(docs: DataFrame) -> DataFrame:
    """docs and __size, __source_size, __target, __copies."""
    targets = source_targets(docs.select("source", n_words().alias("size")))
    targets = materialize(targets.toDF("__source", "__source_size", "__target", "__rate"), "targets")
    out = docs.withColumn("__size", n_words()).join(targets, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.floor("__rate")
    extra = (draw() < F.col("__rate") - whole).cast("long")
    return out.withColumn("__copies", whole + extra).drop("__source", "__rate")


def mixture(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) -> its columns and size, source_size, target, copies (these replace columns of the
    same names).

    Null texts have size 0; null sources are one source.  Draws follow id and text, so documents without an id are drawn
    one by one; rows equal in both are copied alike.  The table of targets is
    written first, so its size decides how it is joined: small ones are broadcast and texts stay where they are.
    """
    new = ["size", "source_size", "target", "copies"]
    return _planned(docs).select(*[c for c in docs.columns if c not in new], *[F.col(f"__{c}").alias(c) for c in new])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mixture takes it, numbered from 1 by the column ``copy`` (which
    replaces one of that name)."""
    number = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy")
    return _planned(docs).where("__copies > 0").select(*[c for c in docs.columns if c != "copy"], number)
