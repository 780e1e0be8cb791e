"""Session helpers: a local session for tests and benches, settings, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ROWS_KEY = "spark.sessionlens.maxGroupRows"
GROUP_ROWS_DEFAULT = 2_000_000
BROADCAST_ROWS_KEY = "spark.sessionlens.maxBroadcastRows"
BROADCAST_ROWS_DEFAULT = 500_000

_OWN_DIRS: dict[str, str] = {}  # application -> the folder of a local session without spark.checkpoint.dir


def local_session(cpus: int | str = 8, app: str = "sessionlens") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in spark.checkpoint.dir.

    Only a local[...] session may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="sessionlens-")
    return _OWN_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Hand a table of few partitions to all cores before expensive work per row.

    A small file with one row group is one task however long its texts are. Tables with at least as many
    partitions as there are cores are left alone, so nothing large is ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    A written table survives the loss of executors and keeps an iterative plan short.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the table is small; otherwise leave the choice to the planner."""
    bound = setting(df.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS_DEFAULT)
    small = df.limit(bound + 1).count() <= bound
    return F.broadcast(df) if small else df
