"""Session settings this engine relies on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Java does not compile methods above 8,000 bytes; such stages run faster without fused code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Shares that a shuffle is dealt into at first; small neighbours are read by one task then.
SHARES, SHARE_SIZE = 400, "16MB"
INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def prepare(spark: SparkSession) -> None:
    """The settings results, speed or memory depend on, for a session made elsewhere.

    Rows of ticks shrink some twenty times when shuffled, so a fixed number of shares, or shares of the usual 64 MB, would let the
    memory of a task grow with the input. More shares set by the session stay.
    """
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, SETTINGS[key])
    if int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")) < SHARES:
        spark.conf.set(INITIAL, SHARES)
    spark.conf.set(ADVISORY, SHARE_SIZE)


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("trackspark")
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh temporary one only in local mode with none set.

    On a cluster every executor has a disk of its own, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trackspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never reused between runs."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: With it, the shuffle files of a write go when the write is over: its rows are in the shared folder then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, for a stage whose rows are read more than once.

    Lineage ends here: what follows reads the table, whatever became of the executors that made it.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
