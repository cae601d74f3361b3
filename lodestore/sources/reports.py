"""Reports: one JSON object a row, its keys sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_line(df: DataFrame) -> Column:
    """A row as a JSON object with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))


def report_lines(df: DataFrame) -> DataFrame:
    return df.select(report_line(df).alias("value"))


def write_reports(df: DataFrame, path: str) -> None:
    """Each row a line of text files in ``path``, which must not exist."""
    report_lines(df).write.text(path)
