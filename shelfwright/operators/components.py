"""Connected components of edges between records, of any shape and size.

Method: seed-tree pruning. In each round every vertex tells its neighbours and itself the smallest vertex it sees (min selection);
the edges this makes lead to neighbourhood minima only. Vertices that no one holds for a minimum then leave the graph and hang
below the smallest minimum they know (pruning); what is left is smaller and has the same components. When no edge is left, the
roots of the forest are the smallest records of their groups, and their identifiers flow down the forest, newest layer first.

Scale: ids become order-preserving 64-bit numbers once; each round is three aggregations with map-side combine and one join, whose hot
keys (a vertex with a third of all edges) adaptive execution splits, as the other side has one row a vertex. Nothing is collected but
counts; each round is a table in the shared folder, so that lost executors cost at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.text import key
from shelfwright.session import materialize, release


def usable_edges(edges: DataFrame, left: str = "left_record_id", right: str = "right_record_id", pattern: str = "^[0-9a-f]{64}$") -> DataFrame:
    """(a, b) with a < b, each once: ids lower-cased and trimmed; NULL or malformed endpoints and self pairs are left out."""
    # most ids are well-formed as they are, and only the others need trimming
    whole = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    clean = lambda c: F.when(F.col(c).rlike(whole), F.col(c)).otherwise(F.when(key(F.col(c)).rlike(pattern), key(F.col(c))))
    ends = edges.select(clean(left).alias("x"), clean(right).alias("y")).filter("x <> y")
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex, id) with ids in the order of the vertices, and the edges (u, v) between ids."""
    edges = materialize(edges, "pairs")
    ids = edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    ids = ids.repartitionByRange("vertex").sortWithinPartitions("vertex").withColumn("id", F.monotonically_increasing_id())
    ids = materialize(ids, "vertices")
    u, v = (ids.select(F.col("vertex").alias(x), F.col("id").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    return ids, edges.join(u, "a").join(v, "b").select("u", "v")


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over undirected edges (u < v): the remaining edges, and the vertices that left as (child, parent); both are tables."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    # min selection: vertex x sees the minimum m(x) of itself and its neighbours, and tells it to each of them
    lowest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    told = both.join(lowest, "x").select(F.col("y").alias("x"), "m").unionByName(lowest)
    # pruning: what each vertex was told, without copies
    heard = materialize(told.distinct(), "heard")
    first = heard.groupBy("x").agg(F.min("m").alias("m0"), F.max((F.col("m") == F.col("x")).cast("int")).alias("seed"))
    left = first.filter("seed = 0").select(F.col("x").alias("child"), F.col("m0").alias("parent"))
    rest = heard.join(first.select("x", "m0"), "x").filter("m > m0").select(F.col("m0").alias("u"), F.col("m").alias("v")).distinct()
    rest, left = materialize(rest, "edges"), materialize(left, "layer")
    release(heard)
    return rest, left


def connected_groups(edges: DataFrame, left: str = "left_record_id", right: str = "right_record_id", pattern: str = "^[0-9a-f]{64}$") -> DataFrame:
    """(record_id, group_record_id): each record some usable edge links to another one, with the smallest record of its group.

    Nulls, malformed endpoints and self pairs link nothing; repeated and turned-round pairs count once; no edges give no rows; further
    columns of the edges don't matter. The result is exact for any shape of component.
    """
    ids, pairs = _numbered(usable_edges(edges, left, right, pattern))
    pairs, layers = materialize(pairs, "edges"), []
    while True:
        rest, gone = _round(pairs)
        release(pairs)
        pairs = rest
        layers.append(gone)
        if rest.isEmpty():
            break
    # seeds have no parent; the newest layer hangs below seeds, each older one below those that came after it
    roots = layers[-1].select(F.col("parent").alias("id"), F.col("parent").alias("root")).distinct()
    known = layers[-1].select(F.col("child").alias("id"), F.col("parent").alias("root"))
    for layer in reversed(layers[:-1]):
        above = layer.join(known.withColumnRenamed("id", "parent"), "parent", "left")
        known, old = materialize(known.unionByName(above.select(F.col("child").alias("id"), F.coalesce("root", "parent").alias("root"))), "known"), known
        release(old)
    everyone = known.unionByName(known.select(F.col("root").alias("id"), "root").distinct()) if layers else roots
    name = ids.select(F.col("id").alias("root"), F.col("vertex").alias("group_record_id"))
    return everyone.join(ids, "id").join(name, "root").select(F.col("vertex").alias("record_id"), "group_record_id")
