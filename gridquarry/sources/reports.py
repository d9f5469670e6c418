"""Scorecards as CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, places: int = 3) -> DataFrame:
    """One line of a Markdown table a row; null and NaN are blank. The header is ``header(df)``."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.select(line(df.columns, numbers, places).alias("line"))


def line(columns: list[str], numbers: list[str] = (), places: int = 3) -> Column:
    """A line of a Markdown table; of ``numbers`` null and NaN are blank."""
    texts = (F.when(~F.isnan(c), F.format_number(c, places)) if c in numbers else F.col(c).cast("string") for c in columns)
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(t, F.lit("")) for t in texts)), F.lit(" |"))


def header(df: DataFrame) -> str:
    return f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"


def write_csv(df: DataFrame, path: str) -> None:
    """A scorecard is small: one file, NaN blank."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    clean.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
