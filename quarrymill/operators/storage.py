"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def files_for(spark: SparkSession, least: int = 1) -> int:
    """Number of files of a table that needs `least` by its size: two for each core at least, whatever the number of shuffle partitions.

    Without Hadoop's native library an executor starts a `chmod` for each file and its checksum, and until exec such a child stands for the whole JVM where memory is counted."""
    return max(2 * spark.sparkContext.defaultParallelism, least)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame as Parquet to the shared folder, in at most `files` files if given, and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `stored` wrote, once nothing that is still to run reads them."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
