"""Audits of match graphs given their groups: links, indirect pairs, bridges and cut vertices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.operators.resolution import canonical_edges


def degrees(edges: DataFrame) -> DataFrame:
    """(record_id, degree, best_score) over canonical edges."""
    e = canonical_edges(edges)
    both = e.select(F.explode(F.array("left", "right")).alias("record_id"), "best_score")
    return both.groupBy("record_id").agg(F.count("*").alias("degree"), F.max("best_score").alias("best_score"))


def triangles(edges: DataFrame) -> DataFrame:
    """(record_id, n): triangles through each record. Edges point from the lower to the higher degree, which bounds the pairs of a hot vertex."""
    e = canonical_edges(edges).select("left", "right")
    d = degrees(edges).select("record_id", "degree")
    x = e.join(d.select(F.col("record_id").alias("left"), F.col("degree").alias("dl")), "left").join(d.select(F.col("record_id").alias("right"), F.col("degree").alias("dr")), "right")
    up = F.struct("dl", "left") < F.struct("dr", "right")
    out = x.select(F.when(up, F.col("left")).otherwise(F.col("right")).alias("a"), F.when(up, F.col("right")).otherwise(F.col("left")).alias("b"))
    wedge = out.join(out.withColumnRenamed("b", "c"), "a").filter("b < c").select("a", "b", "c")
    closed = wedge.join(e.select(F.col("left").alias("b"), F.col("right").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("record_id")).groupBy("record_id").agg(F.count("*").alias("n"))


def group_link_types(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(kind, n): edges within a group, between groups, and with an endpoint that has none."""
    g = now.filter("group_id is not null").select("record_id", "group_id")
    e = canonical_edges(edges).select("left", "right")
    j = e.join(g.select(F.col("record_id").alias("left"), F.col("group_id").alias("lg")), "left", "left").join(g.select(F.col("record_id").alias("right"), F.col("group_id").alias("rg")), "right", "left")
    kind = F.when(F.col("lg").isNull() | F.col("rg").isNull(), "ungrouped").when(F.col("lg") == F.col("rg"), "within").otherwise("between")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def size_screen(now: DataFrame, thresholds: tuple[int, ...] = (2, 5, 10, 20)) -> DataFrame:
    """(threshold, n_groups, n_records, pairs) of groups with at least that many records."""
    s = now.filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))
    each = s.select("n", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).filter("n >= threshold")
    return each.groupBy("threshold").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_records"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("pairs"))


def cuts_of(pdf: pd.DataFrame) -> tuple[set[tuple[str, str]], set[str]]:
    """Bridges and cut vertices of one component's edges (left, right), by an iterative depth-first search."""
    near: dict[str, list[str]] = {}
    for a, b in zip(pdf["left"], pdf["right"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    bridges, cut = set(), set()
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > seen[u]:
                        bridges.add((min(u, v), max(u, v)))
                    if u != root and low[v] >= seen[u]:
                        cut.add(u)
            elif w not in seen:
                seen[w] = low[w] = len(seen)
                children += v == root
                stack.append((w, v, iter(near[w])))
            elif w != parent:
                low[v] = min(low[v], seen[w])
        if children > 1:
            cut.add(root)
    return bridges, cut
