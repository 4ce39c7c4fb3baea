"""Session manifests, event lists and run records as JSON; stage tables as Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or pattern, in whatever store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON array."""
    return spark.read.schema(schemas.SESSIONS).json(path, multiLine=True)


def write_manifest(sessions: DataFrame, path: str) -> None:
    """A folder of files that each hold one JSON array, which manifest() reads again: a file's rows stand between brackets."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = "["
        for b in batches:
            for text in b.column("value").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([line + text])], names=["value"])
                line = ","
        if line == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows = sessions.select(F.to_json(F.struct(*sessions.columns)).alias("value"))
    rows.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def settings(spark: SparkSession, path: str) -> dict:
    """A configuration file in YAML (or JSON, which is YAML too); an empty dictionary where there is none or it is empty.
    Layers go to config.resolve()."""
    import yaml

    if not exists(spark, path):
        return {}
    return yaml.safe_load("".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}  # one small file


def events(spark: SparkSession, pattern: str) -> DataFrame:
    """Events of JSON arrays, one file a session, with the folder's name as session_id and the place in the file as seq.
    No matching file gives an empty table of the same schema."""
    kind = T.StructType.fromDDL(schemas.EVENT)
    if not exists(spark, pattern):
        return spark.createDataFrame([], T.StructType([T.StructField("session_id", T.StringType()), T.StructField("seq", T.LongType()), *kind.fields]))
    text = spark.read.text(pattern, wholetext=True).withColumn("session_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    array = F.when(F.trim("value").startswith("{"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value"))
    rows = text.select("session_id", F.posexplode(F.from_json(array, T.ArrayType(kind))).alias("seq", "e"))
    return rows.filter("e.type IS NOT NULL").select("session_id", F.col("seq").cast("long").alias("seq"), "e.*")


def runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records, newest first; files that are not valid JSON are skipped."""
    schema = T.StructType.fromDDL(schemas.RUN + ", _corrupt_record STRING")
    if not exists(spark, pattern):
        return spark.createDataFrame([], T.StructType.fromDDL(schemas.RUN))
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").json(pattern, multiLine=True)
    return read.filter("_corrupt_record IS NULL AND timestamp IS NOT NULL").drop("_corrupt_record").orderBy(F.desc("timestamp"))


def parsed_responses(responses: DataFrame, text: str, schema: str, default_confidence: float = 0.5) -> DataFrame:
    """A model's JSON answers as rows: a single object counts as an array of one, malformed items are skipped."""
    array = F.when(F.trim(text).startswith("{"), F.concat(F.lit("["), F.col(text), F.lit("]"))).otherwise(F.col(text))
    items = responses.withColumn("_o", F.explode(F.from_json(array, f"array<struct<{schema}>>"))).filter("_o.type IS NOT NULL")
    out = items.select(*[c for c in responses.columns if c != text], "_o.*")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(default_confidence)))


def stage(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stage's stored table, or None where there is none; a column of another type is an error."""
    if not exists(spark, path):
        return None
    want, found = T.StructType.fromDDL(schema), spark.read.parquet(path).schema
    for f in want.fields:
        if f.name not in found.names or found[f.name].dataType != f.dataType:
            raise ValueError(f"{path}: column {f.name} is not {f.dataType.simpleString()}")
    return spark.read.schema(want).parquet(path)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_events(found: DataFrame, path: str) -> None:
    """One JSON object a line without the fields that are null, in time order within a session."""
    found.repartition("session_id").sortWithinPartitions("session_id", "time_start", "seq").write.mode("overwrite").json(path)


def write_cursor_events(found: DataFrame, path: str, cursor_types: list[str]) -> None:
    """As write_events, but events of the cursor types keep an explicit null cursor_position."""
    columns = [F.col(c) for c in found.columns]
    text = F.to_json(F.struct(*columns))
    bare = F.col("type").isin(cursor_types) & F.col("cursor_position").isNull()
    keep = F.concat(F.regexp_replace(text, "}$", ""), F.lit(',"cursor_position":null}'))
    found.select("session_id", "time_start", "seq", F.when(bare, keep).otherwise(text).alias("value")).repartition("session_id").sortWithinPartitions(
        "session_id", "time_start", "seq"
    ).select("value").write.mode("overwrite").text(path)
