"""Exact deduplication as a stateful stream.

A file stream reads the table; a streaming aggregate keeps, in a disk-backed keyed
state without watermark or expiry, for each SHA-256 digest: the stable identifier of
the row that stays, the locator of its content (file and row) and the number of
rows. Partial sums are made before the shuffle, so a digest that a third of all
rows share costs one row per task. Every hit is then checked against the full bytes
at the locator; digests whose texts differ are grouped by the text itself.

The same checkpoint folder can be given again later: the stream then reads only new
files and goes on from its state.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, fresh_path, parquet_path, without_places

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each state partition takes 4 MB of disk for an empty manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text: Column) -> Column:
    """Lower-case hex of the UTF-8 bytes; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rows(source: DataFrame, text: str, doc_id: str, digest) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return source.select(
        F.col(doc_id).alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        digest(body).alias("digest"),
        body.alias("body"),
    )


def digest_state(
    spark: SparkSession,
    path: str,
    schema: StructType,
    text: str = "text",
    doc_id: str = "doc_id",
    digest=sha256,
    bytes_per_batch: int = 1 << 36,
    state_path: str | None = None,
) -> DataFrame:
    """``digest``, ``keep`` (doc_id, file, row of the row that stays) and ``n`` for each digest in ``path``.

    The row that stays is the one with the largest doc_id, a null id being the
    smallest; of equal ids, the one at the largest locator.
    """
    state_path = state_path or fresh_path(spark, "dedup-state")
    # a stream takes a folder or a pattern; a pattern that matches just the one file stands for a file
    source = f"{path[:-1]}[{path[-1]}]" if _status(spark, path, "isFile") else path
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)
    seen = (
        _rows(stream, text, doc_id, digest)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    )
    changes = f"{state_path}/changes"

    def keep_changes(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_path}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(keep_changes)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = seen.select("digest", "keep", "n").schema
    found = spark.read.schema(kept).parquet(changes) if _status(spark, changes, "exists") else spark.createDataFrame([], kept)
    if query.lastProgress is not None and json.loads(query.lastProgress.json)["batchId"] == 0:
        return found  # one batch: every digest was written once
    return found.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")).select(
        "digest", F.col("last.keep").alias("keep"), F.col("last.n").alias("n")
    )


def _status(spark: SparkSession, path: str, question: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return getattr(files, question)(where)


def exact_duplicates(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    digest=sha256,
    bytes_per_batch: int = 1 << 36,
    state_path: str | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: ``doc_id``, ``file``, ``row``,
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are, null and empty ones being equal; of equal
    rows the one with the largest doc_id stays (a null id is the smallest; of equal
    ids, the last by file and row). An empty table gives an empty result. Columns of
    other names are not read.
    """
    schema = schema or spark.read.parquet(path).schema
    state = digest_state(spark, path, schema, text, doc_id, digest, bytes_per_batch, state_path)
    rows = _rows(spark.read.schema(schema).parquet(path), text, doc_id, digest)
    several = state.where("n > 1")
    small = several.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    hits = rows.join(hint(several), "digest")
    # the bytes that the locator points at, against those of every other row of the digest
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    at = hits.where(stays).select("digest", F.col("body").alias("kept_body"))
    differ = hits.where(~stays).join(at, "digest").where("body <> kept_body").select("digest")
    ids = rows.select("doc_id", "file", "row", "digest", sha256(F.col("body")).alias("text_sha256"))
    plain = _decided(ids.join(hint(several), "digest", "left"))
    if differ.isEmpty():  # no distinct before this: it would keep Spark from splitting a skewed digest
        return plain
    bad = several.join(differ.distinct(), "digest", "left_semi").select("digest")
    clashing = rows.join(bad, "digest", "left_semi")
    by_text = clashing.groupBy("digest", "body").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n")
    )
    exact = clashing.withColumn("text_sha256", sha256(F.col("body"))).join(by_text, ["digest", "body"])
    return _decided(ids.join(bad, "digest", "left_anti").join(several, "digest", "left")).union(_decided(exact))


def _decided(rows: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    return rows.select(
        "doc_id",
        "file",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of rows with equal texts the one with the largest id.

    A null text equals an empty one; a null id is smaller than any other, and of rows with one id and text the one at the largest
    place in the files stays. Very long texts are read whole, when a digest is met again. An empty table gives an empty
    result; columns of any other name are carried and not read. The stream reads files and a locator points into one, so
    anything but a plain read of Parquet is written first.
    """
    spark, path = docs.sparkSession, parquet_path(docs, "dedup-input")
    found = exact_duplicates(spark, path, docs.schema, text, doc_id)
    return without_places(spark, path, docs.schema, found.where("not kept").select("file", "row"))
