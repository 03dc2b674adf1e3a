"""Problem 4: splits of given shares that keep all records of a group together.

Method: largest-differencing balance. Units are the components of records that share a group_id or, if links are given, are linked (a
record without either is its own). In each partition the units' weights, sorted, are cut into tuples of as many as there are bins; the two
tuples of the greatest spread are combined again and again, the heaviest entries of one with the lightest of the other. The partitions'
tuples are combined in the same way, FAN at a time in a tree, which gives many nearly equal bins, and whole bins go to the split that lacks
most. Groups are never divided, whatever their size.

Scale: units are spread by the hash of their id, so that a partition has a bounded number of them. Each level of the tree is a grouped map
over `bins` numbers a partition; the driver sees the last level only, at most FAN times `bins` numbers whatever the input.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.text import key
from shelfwright.llm.groups import connected_groups, usable_edges
from shelfwright.operators.assignments import current_assignments
from shelfwright.session import materialize

BINS = 400
GROUPS_A_PARTITION = 50_000
FAN = 64  # tuples that are combined at once


def combine(tuples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest differencing of rows of equal width: (place of each entry's bin, the bins' sums).

    Rows are combined two at a time, those of the greatest spread first, the heaviest entries of one with the lightest of the other,
    until one is left. Ties are broken by the order of the rows.
    """
    width = len(tuples[0])
    place = np.tile(np.arange(width), (len(tuples), 1))
    heap, members, sums = [], {}, {}
    for i, row in enumerate(tuples):
        order = np.argsort(-row, kind="stable")
        place[i, order] = np.arange(width)
        sums[i], members[i] = row[order].astype(np.float64), [i]
        heap.append((-(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    n = len(tuples)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        to = np.empty(width, dtype=np.int64)
        to[order] = np.arange(width)
        ma, mb = members.pop(a), members.pop(b)
        place[ma] = to[place[ma]]
        place[mb] = to[width - 1 - place[mb]]
        members[n], sums[n] = ma + mb, joined[order]
        heapq.heappush(heap, (-(joined[order[0]] - joined[order[-1]]), n))
        n += 1
    return place, next(iter(sums.values()))


def bins_of(weights: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin for each weight, and the bins' sums."""
    order = np.argsort(-weights, kind="stable")
    rows = -(-len(weights) // bins)
    padded = np.zeros(rows * bins)
    padded[: len(weights)] = weights[order]
    place, sums = combine(list(padded.reshape(rows, bins)))
    out = np.empty(len(weights), dtype=np.int64)
    out[order] = place.reshape(-1)[: len(weights)]
    return out, sums


def allocate(sums: np.ndarray, shares: dict[str, float]) -> list[str]:
    """A split for each bin: bins in order of falling weight go to the split that is furthest below its share of all."""
    total, names = float(sums.sum()), sorted(shares)
    whole = sum(shares.values())
    lack = {s: total * shares[s] / whole for s in names}
    out = [""] * len(sums)
    for i in np.argsort(-sums, kind="stable"):
        s = max(names, key=lambda x: lack[x])
        out[i], lack[s] = s, lack[s] - float(sums[i])
    return out


def grouped(assignments: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(record_id, group_id, split, unit): the current rows; unit is the group, or the record itself where it has none.

    links (left_record_id, right_record_id) join the units of their ends, directly or over records that have no assignment; see
    groups.usable_edges for ends that link nothing.
    """
    now = current_assignments(assignments)
    own = F.concat(F.lit("record:"), "record_id")
    now = now.withColumn("unit", F.coalesce(F.concat(F.lit("group:"), "group_id"), own))
    if links is None:
        return now
    ends = usable_edges(links)
    name = lambda c: F.concat(F.lit("record:"), c)
    member = now.filter("group_id is not null").select(name("record_id").alias("left_record_id"), F.col("unit").alias("right_record_id"))
    edges = ends.select(name("a").alias("left_record_id"), name("b").alias("right_record_id")).unionByName(member)
    whole = connected_groups(edges, pattern="^(record|group):.").select(F.col("record_id").alias("unit"), F.col("group_record_id").alias("whole"))
    return now.join(whole, "unit", "left").withColumn("unit", F.coalesce("whole", "unit")).drop("whole")


def group_splits(assignments: DataFrame, plan: DataFrame, bins: int = BINS, groups_a_partition: int = GROUPS_A_PARTITION, links: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """(unit, group_id, n_records, n_current_splits, split): each group with its new split; see grouped() for unit.

    n_current_splits counts the present current splits of the group's records. Rows without record_id are left out; NULL or blank groups
    and splits are missing; repeated rows count once; ties are broken by unit. An empty plan is an error; no assignments give no rows. A unit of
    several linked groups has the least group_id.
    """
    return _unit_splits(grouped(assignments, links), plan, bins, groups_a_partition, fan)


def _unit_splits(rows: DataFrame, plan: DataFrame, bins: int, groups_a_partition: int, fan: int) -> DataFrame:
    shares = {r["split"]: float(r["target_share"]) for r in plan.select(key(F.col("split")).alias("split"), "target_share").filter("split is not null and target_share > 0").collect()}
    if not shares:
        raise ValueError("the plan has no split with a positive target_share")
    units = materialize(rows.groupBy("unit").agg(F.min("group_id").alias("group_id"), F.count("*").alias("n_records"), F.count_distinct("split").alias("n_current_splits")), "units")
    parts = max(1, -(-units.count() // groups_a_partition))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_records", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at, _ = bins_of(pdf["n_records"].to_numpy(), bins)
        return pdf.assign(bin=at)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where each bin of some partitions goes, and the sums."""
        wide = pdf.pivot_table(index="part", columns="bin", values="n", aggfunc="sum", fill_value=0).reindex(columns=range(bins), fill_value=0).sort_index()
        place, sums = combine(list(wide.to_numpy(dtype=np.float64)))
        at = wide.index.to_numpy()
        return pd.DataFrame({"part": np.repeat(at, bins), "bin": np.tile(np.arange(bins), len(at)), "up": int(at[0]) // fan, "to": place.reshape(-1), "n": sums[place.reshape(-1)].astype(np.int64)})

    spread = units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)).cast("long"))
    placed = materialize(spread.groupBy("part").applyInPandas(local, "unit string, group_id string, n_records long, n_current_splits long, part long, bin long"), "bins")
    sums = placed.groupBy("part", "bin").agg(F.sum("n_records").alias("n"))
    levels = []
    while parts > fan:
        level = sums.groupBy(F.floor(F.col("part") / fan).alias("up")).applyInPandas(lambda key, pdf: merge(pdf), "part long, bin long, up long, to long, n long")
        levels.append(materialize(level, "level"))
        sums = levels[-1].groupBy(F.col("up").alias("part"), F.col("to").alias("bin")).agg(F.first("n").alias("n"))
        parts = -(-parts // fan)
    last = sums.toPandas()  # at most fan x bins numbers
    if last.empty:
        return units.withColumn("split", F.lit(None).cast("string"))
    top = merge(last)
    total = np.zeros(bins)
    total[top["to"]] = top["n"]
    names = allocate(total, shares)
    to = units.sparkSession.createDataFrame([(int(p), int(b), names[t]) for p, b, t in zip(top["part"], top["bin"], top["to"], strict=True)], "part long, bin long, split string")
    for level in reversed(levels):  # down the tree
        to = level.join(to.select(F.col("part").alias("up"), F.col("bin").alias("to"), "split"), ["up", "to"]).select("part", "bin", "split")
    return placed.join(to, ["part", "bin"]).select("unit", "group_id", "n_records", "n_current_splits", "split")


def record_splits(assignments: DataFrame, plan: DataFrame, links: DataFrame | None = None, bins: int = BINS, groups_a_partition: int = GROUPS_A_PARTITION, fan: int = FAN) -> DataFrame:
    """(record_id, group_id, current_split, split, torn): every record with the split of its unit; torn: the group has several splits now."""
    rows = grouped(assignments, links)
    if links is not None:
        rows = materialize(rows, "grouped")
    units = _unit_splits(rows, plan, bins, groups_a_partition, fan).select("unit", F.col("split").alias("new"), (F.col("n_current_splits") > 1).alias("wide"))
    out = rows.join(units, "unit")
    if links is None:
        return out.select("record_id", "group_id", F.col("split").alias("current_split"), F.col("new").alias("split"), (F.col("group_id").isNotNull() & F.col("wide")).alias("torn"))
    torn = rows.filter("group_id is not null").groupBy("group_id").agg((F.count_distinct("split") > 1).alias("torn"))
    return out.join(torn, "group_id", "left").select("record_id", "group_id", F.col("split").alias("current_split"), F.col("new").alias("split"), F.coalesce("torn", F.lit(False)).alias("torn"))


def torn_groups(assignments: DataFrame, plan: DataFrame) -> DataFrame:
    """(group_id): groups whose records have more than one current split."""
    return group_splits(assignments, plan).filter(F.col("group_id").isNotNull() & (F.col("n_current_splits") > 1)).select("group_id")


def reached_shares(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(split, target_share, n_records, share) of the result of record_splits."""
    n = records.groupBy("split").agg(F.count("*").alias("n_records"))
    joined = plan.select(key(F.col("split")).alias("split"), "target_share").join(n, "split", "left").fillna(0, ["n_records"])
    everything = Window.partitionBy(F.lit(0))  # one row a split
    return joined.select("split", "target_share", "n_records", (F.col("n_records") / F.sum("n_records").over(everything)).alias("share"))
