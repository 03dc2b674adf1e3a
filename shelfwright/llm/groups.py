"""Problem 6: one group identifier for all records that pairwise matches link, directly or indirectly.

Method: seed-tree pruning. In each round every vertex tells its neighbours and itself the smallest vertex it sees (min selection);
the edges this makes lead to neighbourhood minima only. Vertices that no one holds for a minimum then leave the graph and hang
below the smallest minimum they know (pruning); what is left is smaller and has the same components. When no edge is left, the
roots of the forest are the smallest records of their groups, and their identifiers flow down the forest, newest layer first.

Scale: ids become order-preserving 64-bit numbers once; each round is three aggregations with map-side combine and one join, whose hot
keys (a vertex with a third of all edges) adaptive execution splits, as the other side has one row a vertex. Nothing is collected but
counts; each round is a table in the shared folder, so that lost executors cost at most a round. The components themselves are an operator
of the core (operators/components.py), as its graph audits need them, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.operators.components import connected_groups, usable_edges


def group_links(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: records, usable links and the pairs that hold only indirectly (of n records n(n-1)/2 pairs, less the links)."""
    size = groups.groupBy("group_record_id").agg(F.count("*").alias("n_records"))
    links = usable_edges(edges).join(groups.withColumnRenamed("record_id", "a"), "a").groupBy("group_record_id").agg(F.count("*").alias("n_links"))
    n = F.col("n_records")
    return size.join(links, "group_record_id").withColumn("indirect_pairs", F.floor(n * (n - 1) / 2) - F.col("n_links"))


__all__ = ["connected_groups", "group_links", "usable_edges"]
