"""Spark session helpers.

The cluster decides where checkpoints live (``spark.checkpoint.dir``);
we only pick a folder ourselves when none is configured, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    STATE_STORE: ROCKSDB,
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the
    session the platform hands out and call :func:`ensure_checkpoint_dir`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """The library's timestamp semantics are UTC (NTZ columns are read as
    UTC wall clock, windows align to the epoch in UTC); pin the session
    time zone, make sure a checkpoint folder is known and that executors
    can import this package."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_keyed_state(spark: SparkSession) -> None:
    """Several states per key (``transformWithStateInPandas``) need the RocksDB
    store; a session the platform hands out has Spark's default, which refuses
    them. A stream takes the setting when it starts."""
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the executors' Python path once per context
    (like ``--py-files``), so grouped pandas functions and stateful
    streaming functions resolve on any worker."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="vigil-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "vigil"), "zip", os.path.dirname(pkg_dir), "vigil")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local master may go
    without one (tests): on a cluster a folder of this machine would be
    another one on every executor, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by all executors (master {master})")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("VIGIL_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: later branches scan it with column pruning instead of
    recomputing its joins, and the lineage is cut (executor loss costs a
    re-read, not a recompute). The written table goes when the driver ends."""
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)
