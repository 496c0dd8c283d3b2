"""Session helpers: defaults for local runs and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g"
                  ) -> SparkSession:
    """A session for tests and benchmarks.  On a cluster the caller brings the session."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("credence")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    local = spark.sparkContext.master.startswith("local[") or \
        spark.sparkContext.master == "local"
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="credence-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once below the shared folder and read it from there, for narrow rows that cost much
    and are read several times (a range sort reads its input twice).  The files go when the
    session's JVM ends."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
