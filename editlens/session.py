"""Session helpers: a local session for tests and bench, and the shared work folder."""

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "editlens", memory: str = "16g") -> SparkSession:
    """Session for tests and bench. On a cluster the caller passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` as the cluster sets it.

    A folder of our own is only made for a local session that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = os.path.join(tempfile.gettempdir(), "editlens-work")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that later stages start from a file scan."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The same, bucketed by keys: joins and groupings on them then start from the files without a shuffle.

    A frame that is dealt by the keys into as many tasks is written as it stands, one file per bucket. The entry in the
    catalog goes at once; the files stay, like those of `materialize`.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", work_path(spark, name))
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    written = spark.table(table)
    written.schema  # noqa: B018 - resolved before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return written
