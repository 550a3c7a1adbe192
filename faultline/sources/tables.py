"""Relational table scans (S6): the product's tables as stored datasets.

A table in a database is read by ``spark.read.jdbc`` in ranges of its id; nothing here depends on where a table came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored table; with ``schema`` the files are read with it (no inference)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
