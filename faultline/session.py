"""Session helpers: settings the engine relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job assumes.  AQE re-plans joins and coalesces shuffle output
# at runtime; skew-join splitting covers the "one issue holds a third of all
# events" case on the join side.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # streaming state beyond the executor heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "faultline",
                  extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench.  On a cluster, use the cluster's session."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All time logic is UTC (the event store stamps UTC); pin the session zone."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_state_store(spark: SparkSession) -> None:
    """Streaming state beyond the executor heap, whoever made the session.  Set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ENGINE_CONF["spark.sql.streaming.stateStore.providerClass"])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the Python workers once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix=f"{root.name}-src-")) / f"{root.name}-src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a session inside one machine's process (``local[...]``: tests, bench) that names none gets a scratch folder;
    on a cluster a folder of one machine would lose data, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("FAULTLINE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path
