"""The current state of an assignment log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.text import key

#: Split names as they are written in full.
SPLIT_NAMES = {"val": "validation"}


def current_assignments(assignments: DataFrame) -> DataFrame:
    """(record_id, group_id, split): of each record the row with the latest assigned_at.

    Ids and splits are lower-cased and trimmed, short split names written in full; missing groups and splits are NULL.
    Rows without a record_id are left out. Of rows with one time, the one with the greatest (split, group_id) holds;
    a missing time is earlier than any other.
    """
    rows = assignments.select(
        key(F.col("record_id")).alias("record_id"), key(F.col("group_id")).alias("group_id"), key(F.col("split")).alias("split"), F.col("assigned_at")
    ).filter(F.col("record_id").isNotNull())
    full = F.col("split")
    for short, name in SPLIT_NAMES.items():
        full = F.when(F.col("split") == short, F.lit(name)).otherwise(full)
    rows = rows.withColumn("split", full)
    latest = F.max(F.struct("assigned_at", "split", "group_id")).alias("last")
    return rows.groupBy("record_id").agg(latest).select("record_id", "last.group_id", "last.split")
