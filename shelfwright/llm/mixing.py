"""Problem 9: a selection of texts in which every source has its target share of all tokens.

Method: capped water-filling. A source can give at most its tokens times its maximum number of epochs; sources whose share of the wanted
total exceeds that are clamped to it, and their excess goes to the others in proportion to their targets until all is feasible. Each
source is then taken a whole number of times and, for the fraction, in the order of a seeded hash until the tokens are reached.

Without a given total the mix is the largest in which every source has its target share, as TESTDATA.md asks; with a total, such as that of
the corpus, small sources are clamped and the shares that are reached differ from the targets.

Scale: one pass counts tokens; the driver sees one row a source. The point at which a source's fraction ends is found from sums over
hash buckets, so that only the documents of one bucket in 65,536 a source are ever put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.text import key, wordpunct_count
from shelfwright.session import materialize

BUCKET_DIGITS = 4  # hex digits of the hash: 65,536 buckets
SEED = "mix"


def source_key(c: Column) -> Column:
    """Source names as they are compared: lower case, trimmed, blanks and hyphens as underscores; missing ones NULL."""
    return F.regexp_replace(key(c), r"[\s_-]+", "_")


def water_fill(tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source gives to a mix of `total` tokens; None: the largest total at which every source with texts reaches its share.

    Sources without tokens give nothing. The result is less than total only where all sources together cannot give it.
    """
    most = {s: float(tokens.get(s, 0)) * repeats[s] for s in weights}
    free = {s for s in weights if most[s] > 0 and weights[s] > 0}
    out = dict.fromkeys(weights, 0.0)
    if not free:
        return out
    if total is None:
        whole = sum(weights[s] for s in free)
        total = min(most[s] * whole / weights[s] for s in free)
    rest = float(total)
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / whole > most[s] * (1 + 1e-12)}
        if not over:
            return out | {s: min(most[s], rest * weights[s] / whole) for s in free}
        for s in over:
            out[s] = most[s]
        free -= over
        rest -= sum(most[s] for s in over)
    return out


def mix(documents: DataFrame, plan: DataFrame, total_tokens: float | str | None = None, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) of the selected texts, copies at least 1, and (source, target_share, max_repeats, available_tokens, planned_tokens).

    Sources are compared without regard to case, blanks and hyphens; documents of a missing source or one that is not planned are left
    out, as are texts without tokens (NULL, empty). total_tokens "corpus" is the number of tokens of all planned sources. Repeated texts are texts each for itself. A source ends with the text that comes
    nearest to its planned tokens. A plan with a source twice is an error; no documents give no rows.
    """
    rows = plan.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").collect()
    if len({r["source"] for r in rows}) != len(rows):
        raise ValueError("a source is planned twice")
    spark = documents.sparkSession
    names = [r["source"] for r in rows]
    counted = documents.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).filter(F.col("source").isin(names))
    counted = counted.select("doc_id", "source", wordpunct_count(F.col("text")).alias("n_tokens"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|" + seed))).alias("h"))
    counted = materialize(counted, "counted").filter("n_tokens > 0")  # a filter before it would count twice
    have = {r["source"]: int(r["t"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a planned source
    weights, repeats = {r["source"]: float(r["target_share"] or 0) for r in rows}, {r["source"]: int(r["max_repeats"] or 0) for r in rows}
    give = water_fill(have, weights, repeats, float(sum(have.values())) if total_tokens == "corpus" else total_tokens)
    table = []
    for s in names:
        t = have.get(s, 0)
        whole = min(repeats[s], int(give[s] / t + 1e-9)) if t else 0
        table.append((s, weights[s], repeats[s], t, give[s], whole, max(0.0, give[s] - whole * t) if whole < repeats[s] else 0.0))
    plan_rows = spark.createDataFrame(table, "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double, whole int, fraction double")
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    sums = counted.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # the bucket in which the fraction is reached, and the tokens before it; at most 65,536 rows a source are ordered
    small = F.broadcast(plan_rows.select("source", "whole", "fraction"))  # one row a source
    ends = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(small, "source").filter("before < fraction").groupBy("source").agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    marked = counted.withColumn("bucket", bucket).join(small, "source").join(F.broadcast(ends), "source", "left")
    inside = marked.filter("bucket < last").withColumn("extra", F.lit(1))
    outside = marked.filter("last is null or bucket > last").withColumn("extra", F.lit(0))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = marked.filter("bucket = last").withColumn("extra", (F.col("before") + running - F.col("n_tokens") / 2 <= F.col("fraction")).cast("int"))
    chosen = inside.unionByName(outside).unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0")
    return chosen.select("doc_id", "source", "n_tokens", "copies"), plan_rows.drop("whole", "fraction")


def reached(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, n_texts, used_tokens, most_copies, share) of what mix() returned."""
    used = chosen.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    joined = plan.drop("planned_tokens").join(used, "source", "left").fillna(0, ["n_texts", "used_tokens", "most_copies"])
    return joined.withColumn("share", F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # one row a source
