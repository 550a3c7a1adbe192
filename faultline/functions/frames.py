"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freeze(df: DataFrame, **cols: Column) -> DataFrame:
    """Add computed columns that later filters cannot re-inline.

    A filter on a computed column is normally pushed below the projection that
    defines it, with the column's expression substituted at every reference.
    For heavy expressions referenced many times (a parsed JSON document read by
    dozens of checks) that multiplies the work per row.  Producing the columns
    from a one-row ``inline`` generator keeps them attributes: they are
    computed once per row, and predicates on them stay above the generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add computed columns that are read several times, for a table that is not filtered by them.  They are computed once
    a row, as columns read more than once are not re-inlined, and unlike frozen ones left out by who reads none of them."""
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` reads it (it is a lambda variable)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spread(df: DataFrame, piece_bytes: int) -> DataFrame:
    """Deal the rows of a table to tasks of about ``piece_bytes`` of stored data, at least one per core.

    The parsing and normalization jobs are CPU-bound per row, and a file of one
    row group is one task.  The number of tasks follows the size of the table, not
    only the cores known at the moment, so the longest task doesn't grow with it.
    A table that comes in that many files stays as it is scanned.
    """
    files = df.inputFiles()
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the files' sizes, as listed
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-stored // piece_bytes))
    return df if len(files) >= pieces else df.repartition(pieces)
