"""Problem 8: texts assigned to containers of a fixed number of tokens with little unused room.

Method: bound-certified repacking. Items are spread over partitions by hash and packed best-fit decreasing in each. Lower bounds from
dual feasible functions certify a partition's number of containers; partitions that need more than their bound exchange the items of
their loosest containers, which are packed again, for as long as that saves containers. A single partition with a gap exchanges with the one
that has most room.

Only ids and sizes leave the scan. The number of partitions is the square root of the number of items over ROOT, or what ITEMS_A_PARTITION asks
for, so that there are several at every size and none is too large; what is known of partitions stays in tables, and the driver sees counts.
Tokens are those of the public WordPunct tokenizer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.text import wordpunct_count
from shelfwright.session import materialize, release

ITEMS_A_PARTITION = 200_000
ROOT = 12


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that items of these sizes need at least, by two families of dual feasible functions."""
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    at = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(count), np.cumsum(count * at)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):  # sizes over capacity - k count as whole, those under k as nothing
        whole = n[-1] - n[capacity - k]
        large = n[capacity - k] - n[half]
        large_sum, small_sum = total[capacity - k] - total[half], total[half] - (total[k - 1] if k else 0)
        best = max(best, int(whole + large + max(0, -(-int(small_sum - (large * capacity - large_sum)) // capacity))))
    for k in range(1, 21):  # rounding to k-ths of the capacity
        parts = at * (k + 1)
        value = np.where(parts % capacity == 0, at * k, parts // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each size, sizes in falling order; the fullest container with room takes the item."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r: some container has r tokens of room
    out, bins = np.empty(len(sizes), dtype=np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fit = have >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
        else:
            b, r, bins = bins, capacity, bins + 1
        out[i] = b
        room[r - s].append(b)
        have |= 1 << (r - s)
    return out


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document; NULL and empty texts have 0 tokens."""
    return documents.select(F.col(doc_id).alias("doc_id"), wordpunct_count(F.col(text)).alias("n_tokens"))


def pack(documents: DataFrame, capacity: int, items_a_partition: int = ITEMS_A_PARTITION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part_no, n_parts, first_token, n_tokens, container_id): every document in containers of at most `capacity` tokens.

    Only documents of more than `capacity` tokens have several parts: as many whole containers as they fill, and a rest that is an item
    like any other. Documents without tokens (NULL, empty, blank) are items of size 0. Ties go by doc_id and part_no, repeated texts are
    items each for itself, further columns are not read, no documents give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n, whole = F.col("n_tokens"), F.floor(F.col("n_tokens") / capacity).cast("int")
    parts = sized(documents, doc_id, text).withColumn("n_parts", F.greatest(F.lit(1), F.ceil(n / capacity).cast("int")))
    kind = parts.schema["doc_id"].dataType.simpleString()
    parts = materialize(
        parts.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).select(
            "doc_id",
            "part_no",
            "n_parts",
            (F.col("part_no").cast("long") * capacity).alias("first_token"),
            F.when(F.col("part_no") < whole, F.lit(capacity).cast("long")).otherwise(n - F.col("part_no").cast("long") * capacity).alias("n_tokens"),
        ),
        "parts",
    )
    full = F.col("n_tokens") == capacity
    done = [parts.filter(full).withColumn("container_id", F.concat_ws("-", F.lit("whole"), F.col("doc_id").cast("string"), F.col("part_no").cast("string")))]
    open_items = parts.filter(~full)
    schema = f"doc_id {kind}, part_no int, n_parts int, first_token long, n_tokens long, part int, bin long, filled long, bound long"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy()
        at = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(at, weights=sizes).astype(np.int64)
        return pdf.assign(bin=at, filled=filled[at], bound=lower_bound(sizes, capacity))

    def spread(items: DataFrame, count: int, name: str) -> DataFrame:
        k = max(1, -(-count // items_a_partition), round(math.sqrt(count) / ROOT))
        keyed = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "part_no", F.lit(name)), F.lit(k)).cast("int"))
        return materialize(keyed.groupBy("part").applyInPandas(packed, schema), "packed")

    columns = ["doc_id", "part_no", "n_parts", "first_token", "n_tokens", "container_id"]
    named = lambda df, r: df.withColumn("container_id", F.concat_ws("-", F.lit(str(r)), F.col("part").cast("string"), F.col("bin").cast("string"))).select(columns)
    now, r = spread(open_items, open_items.count(), "0"), 0
    while True:
        # one row a partition: containers, the certified bound, and the mean fill
        bins = now.groupBy("part", "bin").agg(F.first("filled").alias("f"), F.first("bound").alias("bound"))
        facts = bins.groupBy("part").agg(F.count("*").alias("bins"), F.first("bound").alias("bound"), F.avg("f").alias("mean"))
        facts = materialize(facts.withColumn("gap", F.col("bins") > F.col("bound")), "facts")
        gaps, parts_ = facts.agg(F.count_if("gap"), F.count("*")).first()
        if not gaps or parts_ < 2:
            break
        if gaps == 1:  # the partition with most room helps out
            other = facts.filter("not gap").agg(F.min_by("part", F.struct("mean", "part"))).first()[0]
            facts = facts.withColumn("gap", F.col("gap") | (F.col("part") == other))
        loose = bins.join(facts.filter("gap").select("part", "mean"), "part").filter("f < mean").select("part", "bin")
        loose = materialize(loose, "loose")
        before = loose.count()
        pool = materialize(now.join(loose, ["part", "bin"]).select("doc_id", "part_no", "n_parts", "first_token", "n_tokens"), "pool")
        again = spread(pool, pool.count(), str(r + 1))
        after = again.groupBy("part").agg((F.max("bin") + 1).alias("bins")).agg(F.sum("bins")).first()[0] or 0
        if after >= before:
            release(again)
            break
        done.append(named(now.join(loose, ["part", "bin"], "left_anti"), r))
        now, r = again, r + 1
    done.append(named(now, r))
    out = done[0].select(columns)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_items, n_tokens, n_containers, least_containers, unused_share): least_containers is the number that all tokens need at least."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    total = bins.agg(F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.count("*").alias("n_containers"))
    return total.select("n_items", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused_share"))
