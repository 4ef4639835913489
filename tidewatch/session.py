"""Session helpers: shared folder, lineage cuts and size-checked broadcasts."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024


def build_session(app: str = "tidewatch", cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and benchmarks. On a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's ``spark.checkpoint.dir``, else the context's own checkpoint folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return configured.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """New folder for one run under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor does not replay the whole job."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage by files in a new folder. A checkpoint keeps the size estimate of the plan that it replaces, so that loops over joins multiply
    it without end; here the estimate is the size of the files."""
    path = run_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the optimizer's size estimate is under ``limit``; else leave a shuffle join."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:                                   # a product of joins with more digits than Python reads
        return df
    return F.broadcast(df) if size <= limit else df


def block_seconds(spark: SparkSession) -> int:
    """Width of the time blocks that long series are cut into (``spark.tidewatch.block.seconds``)."""
    return int(spark.conf.get("spark.tidewatch.block.seconds", "3600"))
