"""Tables written to the folder that all executors share, to end lineage where a result is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session in one process gets a temporary folder; on a cluster that is
    an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="timelines-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table (at `path`, else at a new place in the shared folder), read back: it outlives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/timelines-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's write came to its end."""
    return exists(spark, f"{path}/_SUCCESS")
