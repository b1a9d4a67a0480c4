"""Cleaning as files arrive: a file stream with a checkpoint does what resuming from a manifest does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.lines import clean_manifest


def clean_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema, min_chars: int = 1500, text: str = "text", key: str = "doc_id"):
    """A started query that cleans each new file of `source` once and appends to `sink`; it ends when nothing is new."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        stream = reader.parquet(source)
    else:  # a single file: its folder, and of that the file alone
        stream = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    rows = clean_manifest(stream, key, text, F.col(text), F.lit("utf-8"), F.lit(False), min_chars).withColumnRenamed("filename", key)
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clean_available(spark: SparkSession, table: str) -> DataFrame:
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/textloom-checkpoints"
    work = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(table).schema
    clean_stream(spark, table, f"{work}/out", f"{work}/state", schema).awaitTermination()
    return spark.read.parquet(f"{work}/out")
