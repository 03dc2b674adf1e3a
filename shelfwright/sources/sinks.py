"""Sinks: partitioned exports, JSON lines, guarded CSV cells and an order-independent content digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder a value of `by`; an existing export is never overwritten."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def guarded_cell(c: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    """Strings guarded, arrays and structs as JSON text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((guarded_cell(c) if kind == "string" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(name))
    df.select(*out).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def content_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): rows counted and their 64-bit hashes summed, so that neither order nor partitioning matters."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
