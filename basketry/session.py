"""Session construction and shared-storage helpers.

Everything here is plain Spark configuration.  On a cluster the session is
created by the platform; ``get_session`` is for local runs and tests, and
``shared_dir`` only ever invents a folder when the session names none.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins/partition counts from
# runtime sizes, splits skewed join partitions, and UTC keeps timestamps
# comparable with the SQL oracle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # a modest limit for planning-time estimates (compressed file sizes
    # understate rows); AQE converts more joins once actual sizes are known
    "spark.sql.autoBroadcastJoinThreshold": "4MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# JVM options for executors and the driver.  Whole-stage codegen emits one
# large method per stage; HotSpot refuses to JIT methods over 8000 bytecodes
# and runs them interpreted (10x+ slower).  Filters pushed through the retail
# derivations produce such methods, so huge-method compilation is enabled.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "basketry") -> SparkSession:
    """Return the active session, or build a local one configured for tests."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.master(master or os.environ.get("BASKETRY_MASTER", "local[*]"))
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .config("spark.executor.extraJavaOptions", JVM_OPTIONS)
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, and a lost executor costs a re-read only."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The directory comes from ``spark.checkpoint.dir`` (or a checkpoint dir
    already set on the context).  Only a local-mode session without one gets
    a folder under the system temp dir, as in tests; on a cluster a missing
    setting is an error rather than a silent machine-local path.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            root = None
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="basketry-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)      # invented here, so also removed here
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
