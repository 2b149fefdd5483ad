"""Streams of events: windowed counts, sessions, and claims that are taken once.

Each function takes a streaming DataFrame and returns one; batch DataFrames give the
same rows. ``run_to_end`` drives a stream over what its source holds and returns what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1_000) -> DataFrame:
    """A stream over the Parquet file or folder at ``path``; new files are read as they come."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(where)
    # a stream takes a folder or a pattern; a pattern that matches just the one file stands for a file
    source = f"{path[:-1]}[{path[-1]}]" if is_file else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def window_totals(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per event type and tumbling window; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    totals = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return totals.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Sessions of each user: events with less than ``gap`` between neighbours."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def claimed_once(events: DataFrame, keys: list[str], late: str = "90 days") -> DataFrame:
    """The first row to arrive of each key within the watermark: a notification is sent once, also after a restart."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs ``stream`` over all that its source holds now and returns the result, written under ``folder``.

    "complete" keeps the last batch's table; "append" and "update" gather the rows of
    all batches. State and progress are in ``folder`` too; give each run its own.
    """
    spark, rows = stream.sparkSession, f"{folder}/rows"

    def put(batch: DataFrame, number: int) -> None:
        place = rows if mode == "complete" else f"{rows}/batch={number}"
        batch.write.mode("overwrite").parquet(place)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(stream.schema).parquet(rows) if there else spark.createDataFrame([], stream.schema)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see; only a local session may do without that
    setting, and gets one under its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
