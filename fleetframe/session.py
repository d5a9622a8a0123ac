"""Session construction and shared-folder discovery."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators rely on.  Everything else is left to the cluster.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # Plan-time broadcasts only for tables that are tiny by their file-size
    # estimate (the estimate of a joined chain is a product and unreliable);
    # AQE broadcasts larger sides only after measuring their shuffle output.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    # Keyed stream state (one entry per entity) lives in RocksDB, off the
    # JVM heap, with changelog checkpoints to the shared folder.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "fleetframe",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a
    cluster they come from the submit configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    return spark


# Used only where the session names no ``spark.checkpoint.dir``: a folder on
# the default file system, which all executors see.
FALLBACK_DIR = "/tmp/checkpoints/fleetframe"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  A cluster whose
    default file system is each machine's own must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not named and sc is not None and not _shares_default(sc.master, _default_fs(sc)):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = (named or FALLBACK_DIR).rstrip("/")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def _default_fs(sc) -> str:
    return sc._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"


def _shares_default(master: str, default_fs: str) -> bool:
    """Whether the driver and the executors see the same default file system."""
    one_process = master == "local" or master.startswith("local[")
    return one_process or not default_fs.startswith("file:")


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None
