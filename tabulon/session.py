"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulon.errors import InvalidRequest

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(
    cores: str = "*", partitions: int = 8, app: str = "tabulon", folder: str = "/tmp/tabulon-checkpoints"
) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config(CHECKPOINT_SETTING, folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder that the session names. Where it names none, a session on one machine
    gets a folder of its own, and any other is refused."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise InvalidRequest(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tabulon-checkpoint-")
    context.setCheckpointDir(named)
    return named


def computed_once(df: DataFrame) -> DataFrame:
    """The rows of a small result that is read several times, kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabulon-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for work that costs much more than moving them.

    Files that Spark reads in fewer tasks than there are cores hold at most so many splits, which bounds what is moved;
    anything larger stays as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
