"""Tables that are written once and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.events import own_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder that all executors see, and read back.

    For a narrow table that a query starts from several times: its lineage runs once, and what follows is planned on its
    real size. A lost executor costs reading it again.
    """
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
