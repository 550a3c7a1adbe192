"""A data-skipping index beside the stored event table.

For every data file the index keeps the range of its issue ids and times and a blocked Bloom filter of its tag tokens and
issue ids.  A filter has one 32,768-bit block (a ``bitmap_construct_agg`` bitmap) for some ``TOKENS_PER_BLOCK`` distinct
tokens, so its size follows the file's tokens; a token sets ``HASHES`` bits of one block (a false positive in a hundred or
less).  A lookup reads the index rows of the probes' blocks, leaves out the files that surely lack them, and scans the rest:
files that are not in the index are always read, entries of files that are gone are ignored.

The index is a dataset ``<table>-skip``; ``update_index`` reads only files that are not in it yet.  The driver holds file
names only, as many as its own listing of the table has.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import predicates as P
from faultline.operators import layout as L

BLOCK_BITS = 32_768
TOKENS_PER_BLOCK = 2_500
HASHES = 5
_SCHEMA = ("file string, n_rows bigint, min_gid bigint, max_gid bigint, min_at timestamp_ntz, max_at timestamp_ntz, "
           "blocks int, block int, bits binary")


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}-skip"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _block(token: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(token), blocks).cast("int")


def _bits(token: Column) -> list[Column]:
    """The positions of a token inside its block: slices of a second hash."""
    h = F.xxhash64(token, F.lit(1))
    own = [F.shiftright(h, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(4)]
    return (own + [F.xxhash64(token, F.lit(2)).bitwiseAND(BLOCK_BITS - 1)])[:HASHES]


def _gid_token(gid: Column) -> Column:
    return F.concat(F.lit("i"), gid.cast("string"))


def _tag_token(text: Column) -> Column:
    return F.concat(F.lit("t"), text)


def _index_rows(rows: DataFrame) -> DataFrame:
    """rows: events with ``file`` -> index rows, one per file and block."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>")),
                       lambda t: _tag_token(P.stored_tag_token(t["key"], t["value"])))
    tokens = F.filter(F.concat(tags, F.array(_gid_token(F.col("gid")))), lambda t: t.isNotNull())
    stats = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("gid").alias("min_gid"), F.max("gid").alias("max_gid"),
        F.min("created_at").alias("min_at"), F.max("created_at").alias("max_at"))
    held = rows.select("file", F.explode(tokens).alias("token")).distinct()
    size = held.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / TOKENS_PER_BLOCK).cast("int").alias("blocks"))
    size = stats.join(size, "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spots = held.join(size.select("file", "blocks"), "file").select(
        "file", _block(F.col("token"), F.col("blocks")).alias("block"), F.explode(F.array(*_bits(F.col("token")))).alias("bit"))
    maps = spots.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return size.join(maps, "file", "left").select(*[c.split()[0] for c in _SCHEMA.split(", ")])


def _named(path: str) -> Column:
    """The file of a row, from its partition folder on, so that entries do not depend on how the path is written."""
    depth = len(L.PARTITION_COLUMNS) + 1
    return F.substring_index(F.col("_metadata.file_path"), "/", -depth)


def update_index(spark: SparkSession, path: str) -> None:
    """Index the files of the event table that are not indexed yet.  Run again after a failure it may index a file
    twice; a lookup takes a file that either entry admits."""
    rows = spark.read.parquet(path).select(_named(path).alias("file"), "gid", "created_at", "tags")
    if _exists(spark, index_path(path)):
        known = {r["file"] for r in spark.read.schema(_SCHEMA).parquet(index_path(path)).select("file").distinct().collect()}
        new = [f for f in spark.read.parquet(path).inputFiles() if _tail(f) not in known]
        if not new:
            return
        rows = spark.read.option("basePath", path).parquet(*new).select(_named(path).alias("file"), "gid", "created_at", "tags")
    _index_rows(rows).write.mode("append").parquet(index_path(path))


def _tail(file: str) -> str:
    from urllib.parse import unquote

    return "/".join(unquote(file).split("/")[-(len(L.PARTITION_COLUMNS) + 1):])


def _admits(bits: Column, token: Column) -> Column:
    """Are all bits of the token set in its block's bitmap."""
    test = F.lit(True)
    for bit in _bits(token):
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        test = test & (F.bit_get(byte, (bit % 8).cast("int")) == 1)
    return F.coalesce(test, F.lit(False))


def candidate_files(spark: SparkSession, path: str, tags: list[str] | None = None, gids: list[int] | None = None) -> list[str]:
    """Files of the table that may hold an event with every tag probe ``key=value`` of ``tags`` and one of ``gids``."""
    listed = spark.read.parquet(path).inputFiles()
    if not _exists(spark, index_path(path)):
        return listed
    index = spark.read.schema(_SCHEMA).parquet(index_path(path))
    probes = [(i, "t" + t, None) for i, t in enumerate(tags or [])]
    n = len(probes) + (1 if gids is not None else 0)
    probes += [(len(probes), f"i{g}", g) for g in dict.fromkeys(gids or [])]
    if not n:
        return listed
    known = index.select("file").distinct()
    probe = spark.createDataFrame(probes, "p int, token string, gid bigint")
    hit = index.join(F.broadcast(probe), F.col("block") == _block(F.col("token"), F.col("blocks")))  # a request's probes
    hit = hit.where(_admits(F.col("bits"), F.col("token")) & (F.col("gid").isNull() | F.col("gid").between(F.col("min_gid"), F.col("max_gid"))))
    may = hit.groupBy("file").agg(F.count_distinct("p").alias("n")).where(F.col("n") == n).select("file", F.lit(True).alias("may"))
    skipped = {r["file"] for r in known.join(may, "file", "left_anti").collect()}
    return [f for f in listed if _tail(f) not in skipped]


def read_where(spark: SparkSession, path: str, frm: _dt.datetime | None = None, to: _dt.datetime | None = None,
               tags: list[str] | None = None, gids: list[int] | None = None) -> DataFrame:
    """Events that may match the probes, from the files the index leaves, in the weeks of [frm, to].

    Only files are left out: the caller's own predicates (P5, id lists) still decide on rows."""
    files = candidate_files(spark, path, tags, gids)
    table = spark.read.parquet(path)
    if len(files) < len(table.inputFiles()):
        table = spark.read.option("basePath", path).schema(table.schema).parquet(*files) if files else table.limit(0)
    return L.in_weeks(table, frm, to)
