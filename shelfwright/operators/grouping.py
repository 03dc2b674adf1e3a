"""Grouping of listings by keys, and audits of match graphs and partitions that need components."""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.identifiers import gtin, listing_url, name_key, seller_key
from shelfwright.functions.text import present
from shelfwright.operators.components import connected_groups, usable_edges
from shelfwright.operators.resolution import canonical_edges
from shelfwright.session import materialize, release

LINKS_IN_TASK = 4_000_000  # of a component that a task searches whole
LINKS_IN_BIN = 100_000  # of the components that a task searches together, about
LAYERS = 32  # frontiers that become one table


def key_edges(listings: DataFrame) -> DataFrame:
    """(left, right, reason): star edges of listings that share a GTIN, an address, a seller's stock number, a brand's model number or a name.

    Linear in the listings: each is linked with the smallest one of its key. Missing keys link nothing.
    """
    name, brand = name_key(F.coalesce("ProductName", F.lit(""))), name_key(F.coalesce("Brand", F.lit("")))
    model = name_key(F.coalesce("ProductModelNumber", F.lit("")))
    keys = {
        "gtin": gtin(F.col("Upc")),
        "listing_url": listing_url(F.col("ProductUrl")),
        "retailer_sku": seller_key(F.col("Retailer"), F.col("Sku")),
        "brand_model": F.when((brand != "") & (model != "") & present(F.col("ProductModelNumber")), F.concat_ws("\x00", brand, model)),
        "exact_name": F.when(present(F.col("ProductName")) & (name != ""), name),
    }
    each = listings.select("record_id", F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), k.alias("key")) for r, k in keys.items()])).alias("k"))
    rows = materialize(each.select("record_id", "k.*").filter("key is not null and record_id is not null").withColumn("key", F.concat_ws("\x01", "reason", "key")), "keys")
    return _stars(rows)


def _stars(rows: DataFrame) -> DataFrame:
    least = rows.groupBy("key").agg(F.min("record_id").alias("left"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, "key").filter("record_id <> left").select("left", F.col("record_id").alias("right"), "reason")


def group_by_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, group_id): every row with the smallest record of its component of edges (left, right); a row without one is its own."""
    linked = connected_groups(edges, "left", "right", pattern="^.")
    return rows.select("record_id").join(linked, "record_id", "left").select("record_id", F.coalesce("group_record_id", "record_id").alias("group_id"))


def rule_groups(listings: DataFrame) -> DataFrame:
    """(record_id, group_id) by key_edges(); repeated record_ids count once."""
    rows = listings.filter("record_id is not null").select("record_id").distinct()
    return group_by_edges(rows, key_edges(listings))


def must_link(first: DataFrame, second: DataFrame) -> DataFrame:
    """(record_id, group_id): the finest groups that keep together what either of two partitions (record_id, group_id) does."""
    least = lambda df: df.groupBy("group_id").agg(F.min("record_id").alias("left"))
    star = lambda df: df.join(least(df), "group_id").filter("record_id <> left").select("left", F.col("record_id").alias("right"))
    rows = first.select("record_id").unionByName(second.select("record_id")).distinct()
    return group_by_edges(rows, star(first).unionByName(star(second)))


def pair_amplification(edges: DataFrame) -> DataFrame:
    """(group_id, n_records, n_links, implied_pairs, indirect_pairs) of each component of match edges."""
    e = materialize(usable_edges(edges), "edges")
    groups = materialize(connected_groups(e, "a", "b"), "groups")
    links = e.join(groups, e["a"] == groups["record_id"]).groupBy("group_record_id").agg(F.count("*").alias("n_links"))
    sizes = groups.groupBy("group_record_id").agg(F.count("*").alias("n_records"))
    pairs = F.floor(F.col("n_records") * (F.col("n_records") - 1) / 2)
    return sizes.join(links, "group_record_id").select(F.col("group_record_id").alias("group_id"), "n_records", "n_links", pairs.alias("implied_pairs"), (pairs - F.col("n_links")).alias("indirect_pairs"))


def removal_effect(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(state, n_groups, n_records, implied_pairs) of the components before and after the edges (left, right) of `gone` are removed.

    Records that lose all their edges are in no component afterwards.
    """
    e = materialize(canonical_edges(edges).select("left", "right"), "edges")

    def facts(some: DataFrame, state: str) -> DataFrame:
        sizes = connected_groups(some, "left", "right").groupBy("group_record_id").agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).alias("implied_pairs")).select(F.lit(state).alias("state"), "*")

    return facts(e, "before").unionByName(facts(e.join(gone, ["left", "right"], "left_anti"), "after"))


def partition_agreement(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(n_components, n_spanning_groups, n_groups, n_split_groups): whether edges reconstruct a saved partition.

    Components whose records have several groups, and groups whose linked records are in several components; records without a group count nowhere.
    """
    linked = connected_groups(edges)
    both = materialize(linked.join(now.filter("group_id is not null").select("record_id", "group_id"), "record_id"), "both")
    per = lambda by, of: both.groupBy(by).agg(F.count_distinct(of).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("m")).withColumn("one", F.lit(1))
    a, b = per("group_record_id", "group_id"), per("group_id", "group_record_id")
    return a.toDF("n_components", "n_spanning_groups", "one").join(b.toDF("n_groups", "n_split_groups", "one"), "one").drop("one")


def steps_within(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, n_hops): the fewest links (u, v) from each number to the smallest one of its component, breadth first; linear in the links."""
    ids, ends = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    u, v = np.split(ends.astype(np.int32), 2)
    x, y = np.concatenate([u, v]), np.concatenate([v, u])
    near = memoryview(y[np.argsort(x, kind="stable")])
    first = memoryview(np.searchsorted(np.sort(x), np.arange(len(ids) + 1)).astype(np.int64))
    far = np.full(len(ids), -1, dtype=np.int32)
    steps = memoryview(far)
    for root in range(len(ids)):
        if steps[root] < 0:
            steps[root], queue = 0, deque([root])
            while queue:
                at = queue.popleft()
                for to in near[first[at] : first[at + 1]]:
                    if steps[to] < 0:
                        steps[to] = steps[at] + 1
                        queue.append(to)
    return pd.DataFrame({"id": ids, "n_hops": far})


def _frontiers(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, n_hops) from the roots (id) over links (u, v) of components of any size: a frontier that grows by one link a round.

    What is next to a frontier is in it, in the one before or new, so a round costs one join of the frontier with the links, whatever was found before.
    """
    both = materialize(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    frontier = materialize(roots.withColumn("n_hops", F.lit(0)), "frontier")
    done, layers, n = [], [frontier], 0
    while not frontier.isEmpty():
        n += 1
        step = frontier.join(both, frontier["id"] == both["u"]).select(F.col("v").alias("id")).distinct()
        for old in layers[-2:]:
            step = step.join(old.select("id"), "id", "left_anti")
        frontier = materialize(step.withColumn("n_hops", F.lit(n)), "frontier")
        layers.append(frontier)
        if len(layers) > LAYERS + 2:
            done.append(materialize(reduce(DataFrame.unionByName, layers[:LAYERS]), "layers"))
            release(*layers[:LAYERS])
            layers = layers[LAYERS:]
    return reduce(DataFrame.unionByName, done + layers)


def hops(edges: DataFrame, most: int = LINKS_IN_TASK) -> DataFrame:
    """(record_id, root, n_hops): the fewest edges from each record to the smallest one of its component.

    Components of up to `most` links are searched whole within a task, many of them in one, so that long chains cost no rounds; larger ones by
    a distributed frontier that takes as many rounds as the longest of these distances.
    """
    e = materialize(usable_edges(edges), "edges")
    # numbers in the order of the records, so that a component's root is its least number
    groups = connected_groups(e, "a", "b").select("record_id", F.col("group_record_id").alias("root"))
    groups = groups.repartitionByRange("record_id").sortWithinPartitions("record_id").withColumn("id", F.monotonically_increasing_id()).withColumn("r", F.xxhash64("root"))
    groups = materialize(groups, "groups")
    links = e.join(groups.select(F.col("record_id").alias("a"), F.col("id").alias("u"), "r"), "a").join(groups.select(F.col("record_id").alias("b"), F.col("id").alias("v")), "b")
    links = materialize(links.select("u", "v", "r"), "links")
    large = materialize(links.groupBy("r").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("r"), "large")
    bins = links.count() // LINKS_IN_BIN + 1
    found = links.join(large, "r", "left_anti").select("u", "v", F.pmod("r", F.lit(bins)).alias("bin")).groupBy("bin").applyInPandas(steps_within, "id long, n_hops int")
    if not large.isEmpty():
        found = found.unionByName(_frontiers(links.join(large, "r", "left_semi"), groups.join(large, "r", "left_semi").filter("record_id = root").select("id")))
    return groups.join(found, "id").select("record_id", "root", "n_hops")
