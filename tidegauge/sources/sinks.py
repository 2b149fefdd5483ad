"""Forms in which results are written: CSV lines, safe JSON and Markdown rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field


def csv_line(*columns: str) -> Column:
    """The columns as fields of one CSV line; nulls are empty."""
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])


def write_csv(df: DataFrame, path: str, leave_out: tuple[str, ...] = ()) -> None:
    """CSV files with a header and doubled quotes, without the columns ``leave_out``."""
    df.drop(*leave_out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def json_safe(df: DataFrame) -> DataFrame:
    """Values of double and float columns that JSON does not have become null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def markdown_row(*columns: str) -> Column:
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
