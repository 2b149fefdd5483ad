"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words: space and \t \n \v \f \r. ``bytes.split()`` uses exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, so a
    lost executor costs a re-read instead of a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to this many (ids or places, about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def parquet_path(docs: DataFrame, name: str) -> str:
    """A path whose Parquet files hold exactly the rows of ``docs``: where it was read from if it is
    a plain read of one path without options or partition columns, else a fresh one in the shared folder that it is
    written to. Options can leave files out (``pathGlobFilter``, ``recursiveFileLookup``), so any of them counts."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet":
            roots = relation.location().rootPaths()
            if roots.size() == 1 and relation.options().removed("path").isEmpty() and relation.partitionSchema().isEmpty():
                return roots.head().toString()
    path = fresh_path(docs.sparkSession, name)
    docs.write.parquet(path)
    return path


def place() -> Column:
    """File and row number of a row of a table read from Parquet: names the row even if ids repeat or are null."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def without_places(spark: SparkSession, path: str, schema: StructType, dropped: DataFrame) -> DataFrame:
    """The rows at ``path`` but those that ``dropped(file, row)`` names, with all their columns."""
    gone = written(dropped, "dropped").select(F.struct("file", "row").alias("place"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    names = schema.names
    held = "_place" + "_" * max(map(len, names), default=0)
    rows = spark.read.schema(schema).parquet(path).withColumn(held, place())
    return rows.join(gone.withColumnRenamed("place", held), held, "left_anti").select(*[f"`{n}`" for n in names])


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
