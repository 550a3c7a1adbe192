"""Tables in the shared checkpoint folder, row keys, and bounded bitmaps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text modulo n (null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def text_key(text: str = "text") -> Column:
    """With the id it identifies a row up to exact repetition; null and empty differ."""
    return F.struct(F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n"))


BITMAP_BITS = 24


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> bytes:
    """Bit set of a long column's low bits.  Its size is 2**bits / 8 bytes whatever the input; collisions only
    let more rows through to the exact join behind it."""
    slot = F.col(col).bitwiseAND((1 << bits) - 1)
    rows = (
        df.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({col} & 63 AS int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out.tobytes()


def in_bitmap(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x: int64 or uint64 values; words: the bitmap as uint64."""
    x = x.view(np.uint64)
    slot = x & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that their Python workers import it
    wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Freed memory of this process goes back to the system (where the C library can do so)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """``run`` of a task, after which the memory it freed is given back: the worker lives on, idle or for other tasks,
    beside the executor and its other workers."""

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return to_the_end


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)
