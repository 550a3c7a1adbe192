"""Event table layout (S5, L1-L6): write, version dedup, retention, sampling.

Writes go to a path under the session's shared checkpoint folder
(``spark.checkpoint.dir``) or to any path the caller names; they are plain
Parquet datasets partitioned by (retention_days, week), sorted inside each
file by (pid, day, primary_hash) so row-group min/max statistics prune project
and issue lookups, with a Parquet bloom filter on ``release``.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import columns as X
from faultline.session import ensure_checkpoint_dir

PARTITION_COLUMNS = ["retention_days", "week"]


def with_layout_columns(events: DataFrame) -> DataFrame:
    """L1: ``week`` = Monday of created_at (UTC), ``day`` = its date."""
    return events.withColumn("week", F.to_date(X.trunc_ntz("week", F.col("created_at")))).withColumn(
        "day", F.to_date("created_at"))


def write_events(events: DataFrame, path: str, mode: str = "append", max_rows_per_file: int = 0) -> None:
    """S5 + L1 + L3 + L6: append events as a partitioned, clustered Parquet dataset.

    Rows are rebalanced on (retention_days, week, pid) and sorted inside each
    task by the store's primary-key prefix.  ``skipping.update_index`` adds what
    lookups by tag or issue skip files by.
    """
    df = with_layout_columns(events)
    # REBALANCE: hash on (partition values, project) so a task writes few folders;
    # AQE splits a skewed (week, project) over several tasks and merges small
    # ones - no sampling pass over the input, unlike a range repartition.
    (df.hint("rebalance", *PARTITION_COLUMNS, "pid")
       .sortWithinPartitions(*PARTITION_COLUMNS, "pid", "day", "primary_hash")
       .write.mode(mode)
       .option("parquet.bloom.filter.enabled#release", "true")
       .option("maxRecordsPerFile", max_rows_per_file)
       .partitionBy(*PARTITION_COLUMNS)
       .parquet(path))


def in_weeks(table: DataFrame, frm: _dt.datetime | None = None, to: _dt.datetime | None = None) -> DataFrame:
    """Rows of the event table in [frm, to]; the bounds also become bounds on the ``week`` partition column, so whole
    weeks outside the range are never listed (partition pruning)."""
    if frm is not None:
        monday = (frm - _dt.timedelta(days=frm.weekday())).date()
        table = table.where((F.col("week") >= F.lit(monday)) & (F.col("created_at") >= X.ts_lit(frm)))
    if to is not None:
        table = table.where((F.col("week") <= F.lit(to.date())) & (F.col("created_at") <= X.ts_lit(to)))
    return table


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's output under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: several readers then cost one computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_state(events: DataFrame) -> DataFrame:
    """L2: rows with equal key (pid, day, primary_hash, event_id) collapse to the one with
    the highest ``deleted`` (the version column), the last ingested winning ties; then
    tombstones are dropped.  A partial aggregate (``max_by``), so duplicates are
    collapsed in every task before the shuffle."""
    key = ["pid", F.to_date("created_at").alias("day"), "primary_hash", "event_id"]
    cols = [c for c in events.columns if c not in ("pid", "primary_hash", "event_id")]
    seq = F.col("ingest_seq") if "ingest_seq" in events.columns else F.lit(0)
    newest = events.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct("deleted", seq)).alias("r"))
    return newest.select("pid", "primary_hash", "event_id", "r.*").where(F.col("deleted") == 0)


def retention_sweep(events: DataFrame, now: _dt.datetime) -> DataFrame:
    """L4: rows still alive at ``now`` (created_at + retention_days days > now).  In the stored table a week whose
    last day has expired is not read at all."""
    if "week" in events.columns:
        last = F.date_add("week", F.col("retention_days").cast("int") + 7)
        events = events.where(last >= F.lit(now.date()))
    return events.where(F.col("created_at") + F.make_dt_interval(days=F.col("retention_days").cast("int"))
                        > X.ts_lit(now))


REPORT = "retention_days int, week date, action string, rows_before bigint, rows_after bigint"


def drop_expired(spark: SparkSession, path: str, now: _dt.datetime) -> DataFrame:
    """L4 on the stored table: weeks whose last instant has expired at ``now`` leave it by folder, weeks with expired and
    living rows are rewritten without the former, younger weeks are not touched.

    Only the partition values (weeks times retention periods) come to the driver.  Living rows of mixed weeks are staged
    in the shared folder first and then replace their partitions (dynamic overwrite), so a sweep that fails and runs
    again drops nothing that lives.  Returns a report, one row per partition before the sweep.
    """
    table = spark.read.parquet(path)
    found = table.groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("n")).collect()  # row counts from file footers
    parts = {(r["retention_days"], r["week"]): r["n"] for r in found}

    def ends(days: int, week: _dt.date, more: int) -> _dt.datetime:
        return _dt.datetime.combine(week, _dt.time()) + _dt.timedelta(days=days + more)

    dead = [p for p in parts if ends(*p, 7) <= now]
    mixed = [p for p in parts if p not in dead and ends(*p, 0) <= now]
    left = dict(parts) | {p: 0 for p in dead + mixed}
    if mixed:
        of = F.lit(False)
        for days, week in mixed:
            of = of | ((F.col("retention_days") == days) & (F.col("week") == F.lit(week)))
        staged = scratch_path(spark, "retained")
        alive = table.where(of & (F.col("created_at") + F.make_dt_interval(days=F.col("retention_days").cast("int")) > X.ts_lit(now)))
        alive.sortWithinPartitions(*PARTITION_COLUMNS, "pid", "day", "primary_hash").write.partitionBy(*PARTITION_COLUMNS).parquet(staged)
        if any(parts[p] for p in mixed):
            back = spark.read.schema(table.schema).parquet(staged)
            for r in back.groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("n")).collect():
                left[(r["retention_days"], r["week"])] = r["n"]
            (back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .option("parquet.bloom.filter.enabled#release", "true").partitionBy(*PARTITION_COLUMNS).parquet(path))
    for days, week in [p for p in dead + mixed if not left[p]]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/retention_days={days}/week={week}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    action = lambda p: "kept" if p not in dead + mixed else "rewritten" if left[p] else "dropped"
    return spark.createDataFrame([(int(d), w, action((d, w)), n, left[(d, w)]) for (d, w), n in sorted(parts.items())], REPORT)


def sample_key(event_id):
    """L5 sampling key: the first 32 bits of md5(event_id) (any engine with md5 agrees)."""
    return F.conv(F.substring(F.md5(event_id), 1, 8), 16, 10).cast("bigint")


def event_sample(events: DataFrame, k: int, n: int) -> DataFrame:
    """Deterministic sample by a hash of the event id: about k/n of the rows,
    the same rows on every run and in every engine."""
    return events.where(sample_key(F.col("event_id")) % n < k)


# S7 ----------------------------------------------------------------------------
def outbox_append(rows: DataFrame, path: str) -> None:
    """Append created notifications (id, ..., status, error_message, created_at) to the outbox log; one folder a day."""
    out = rows.withColumn("updated_at", F.col("created_at")).withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    out.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def outbox_update(changes: DataFrame, path: str) -> None:
    """Set status, error and send time of notifications: changes(id, status, error_message, sent_at, updated_at).  A
    change is a row of the log that names only what it sets."""
    changes.withColumn("day", F.to_date("updated_at")).write.mode("append").partitionBy("day").parquet(path)


def outbox_current(spark: SparkSession, path: str) -> DataFrame:
    """The outbox log folded to one row a notification: what its creation says, status, error and send time of its
    latest row.  Changes of unknown notifications are ignored."""
    log = spark.read.option("mergeSchema", "true").parquet(path).drop("day")
    state = ["status", "error_message", "sent_at", "updated_at"]
    made = log.where(F.col("created_at").isNotNull()).drop(*state)
    last = latest_per_id(log.select("id", *state))
    return made.join(last, "id")


def latest_per_id(log: DataFrame, id_col: str = "id", order_col: str = "updated_at") -> DataFrame:
    """S7 status fold: an append-only outbox log -> the latest row of each id."""
    w = Window.partitionBy(id_col).orderBy(F.desc(order_col))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
