"""Neighbouring rows within a key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.session import materialize


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the column `name`: the value of the row before, by `order` within equal keys (NULLs are equal); NULL for a key's first row.

    Rows are range-partitioned by keys and order, so a key with a third of all rows is spread over many tasks; the last value of each key
    in each range is carried over to the next range that has the key. The order must be total within a key for a definite result.
    """
    k = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in keys])).alias("_k")
    parts = materialize(df.select("*", k).repartitionByRange("_k", *order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p", "_k").orderBy(*order)
    ends = parts.groupBy("_p", "_k").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # one row a key and range
    carry = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy("_k").orderBy("_p"))).drop("_last")
    here = parts.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    out = here.join(carry, ["_p", "_k"], "left").withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_before")))
    return out.select(*df.columns, name)
