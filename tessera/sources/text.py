"""Pipe-terminated text tables, and text rows as sinks write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows whose every field ends in |; no quoting, blanks count, empty strings stay empty.

    Rows with too few or too many fields are dropped (a file's last row may be cut off). Numbers that don't parse are null.
    """
    parts = F.split("value", r"\|", -1)
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(schema.fields) + 1)
    return rows.select([F.col("p")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def write_tbl(df: DataFrame, path: str) -> None:
    """Write rows with a | after each field; null is written as an empty field."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat(F.concat_ws("|", *cells), F.lit("|")).alias("value")).write.mode("overwrite").text(path)


def row_text(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One column, text: name:[value], name:[value]; doubles with six decimals. Null shows as an empty value."""
    cells = []
    for f, name in zip(df.schema.fields, names or df.columns, strict=True):
        c = F.col(f"`{f.name}`")
        shown = F.format_string("%.6f", c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        cells.append(F.concat(F.lit(f"{name}:["), F.coalesce(F.when(c.isNotNull(), shown), F.lit("")), F.lit("]")))
    return df.select(F.concat_ws(", ", *cells).alias("text"))


def write_out(df: DataFrame, path: str) -> None:
    """Write row_text() as text files."""
    row_text(df).write.mode("overwrite").text(path)


def print_rows(df: DataFrame, limit: int = 20) -> str:
    """The first rows as text, one per line; doubles as with %g."""
    shown = lambda x: "" if x is None else f"{x:g}" if isinstance(x, float) else str(x)
    return "\n".join(", ".join(f"{k}: [{shown(v)}]" for k, v in zip(df.columns, r, strict=True)) for r in df.take(limit))
