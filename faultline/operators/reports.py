"""System reports (Q19-Q21), re-aimed at query-log / error-log tables and Parquet datasets."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import columns as X

QUERY_FINISH = 2  # fixed: log type of a finished query
TOP_QUERIES = 10  # fixed: rows of the slow-query report


def query_log_report(log: DataFrame, now: _dt.datetime, days: int = 30) -> DataFrame:
    """Q19: per normalized query (initial, finished, last ``days`` days): average
    duration and result rows, calls per minute (count / max(1, minute boundaries
    between first and last call)), total calls and bytes, share of bytes and of
    runtime over all groups; the ``TOP_QUERIES`` largest by bytes, each with its
    share of bytes within those ten (``percent``)."""
    lo = X.ts_lit(now - _dt.timedelta(days=days))
    q = log.where(F.col("is_initial_query") & (F.col("event_time") >= lo) & (F.col("type") == QUERY_FINISH))
    g = q.groupBy(X.strip_query_literals(F.col("query")).alias("normalized_query")).agg(
        F.avg("query_duration_ms").alias("avg_duration"),
        F.avg("result_rows").alias("avg_result_rows"),
        F.count(F.lit(1)).alias("total_calls"),
        F.min("event_time").alias("t0"), F.max("event_time").alias("t1"),
        F.sum("read_bytes").alias("rb"),
        F.sum("query_duration_ms").alias("runtime"))
    minutes = (F.unix_timestamp(X.trunc_ntz("minute", F.col("t1")).cast("timestamp"))
               - F.unix_timestamp(X.trunc_ntz("minute", F.col("t0")).cast("timestamp"))) / 60
    # grand totals: a one-row scalar subquery
    totals = g.agg(F.struct(F.sum("rb").alias("rb"), F.sum("runtime").alias("runtime")).alias("t")).scalar()
    top = g.select(
        "normalized_query", "avg_duration", "avg_result_rows", "total_calls", "rb",
        (F.col("total_calls") / F.greatest(F.lit(1), minutes)).alias("calls_per_minute"),
        (F.col("rb") / totals["rb"] * 100).alias("percentage_iops"),
        (F.col("runtime") / totals["runtime"] * 100).alias("percentage_runtime"),
    ).orderBy(F.desc("rb"), "normalized_query").limit(TOP_QUERIES)
    # share within the ten rows of the report (a window over at most TOP_QUERIES rows)
    return top.withColumn("percent", F.col("rb") / F.sum("rb").over(Window.partitionBy()) * 100)


def error_log_report(log: DataFrame, since: _dt.datetime) -> DataFrame:
    """Q20: per error name with last_error_time strictly after ``since``: count and
    latest time, most frequent first (``rn``)."""
    g = log.where(F.col("last_error_time") > X.ts_lit(since)).groupBy("name").agg(
        F.count(F.lit(1)).alias("error_count"), F.max("last_error_time").alias("max_last_error_time"))
    # one row per error name, ordered as the report shows them
    rank = F.row_number().over(Window.orderBy(F.desc("error_count"), "name"))
    return g.withColumn("rn", rank).orderBy("rn")


def storage_report(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Q21: bytes (sum of file sizes) and rows per Parquet dataset, largest first.

    Reads only the hidden ``_metadata`` columns: Parquet footers give the row
    counts, so no data column is decoded."""
    parts = []
    for name, path in paths.items():
        df = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
        per_file = df.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(per_file.groupBy().agg(F.sum("file_size").alias("total_bytes"),
                                            F.sum("rows").alias("total_rows")).select(
            F.lit(name).alias("name"), "total_bytes", "total_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.orderBy(F.desc("total_bytes"), "name"))  # one row per dataset
    return out.withColumn("rn", rank).orderBy("rn")
