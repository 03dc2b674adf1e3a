"""Joins that resolve listings: exact keys, blocks, sorted neighbourhoods, weighted and set similarity, and audits of the result."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.identifiers import name_key
from shelfwright.functions.sets import TokenImages, gram_sets, images, near_enough, needed, shared
from shelfwright.functions.text import present
from shelfwright.session import materialize

FREQUENT = 1 << 16  # tokens whose counts every worker knows
BUCKETS = 1 << 18  # hash buckets that grams are counted in


def named(listings: DataFrame) -> DataFrame:
    """(record_id, name, brand): normalised names and brands of listings that have a name."""
    rows = listings.filter(present(F.col("ProductName"))).select("record_id", name_key(F.col("ProductName")).alias("name"), name_key(F.coalesce("Brand", F.lit(""))).alias("brand"))
    return rows.filter("name <> ''")


def exact_key_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, pairs): groups of equal keys with the number of their pairs, none of which is listed."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key", "n", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))


def star_edges(rows: DataFrame, key: str, row: str = "record_id") -> DataFrame:
    """(left, right): each record of an equal key with the smallest one of it; linear in the rows."""
    w = rows.groupBy(key).agg(F.min(row).alias("left"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(w, key).filter(F.col(row) != F.col("left")).select("left", F.col(row).alias("right"))


def _tokens_of(name: str) -> Column:
    return F.array_distinct(F.split(name, " "))


def rare_tokens(rows: DataFrame, k: int = 2) -> DataFrame:
    """(id, brand, m, w0, w1, token): the k rarest tokens of each name and brand, ties by token; id is the name's hash, m and w0, w1 are size and image of its tokens.

    The FREQUENT most frequent tokens are counted on every worker; whatever is not among them is rarer. So only names with more than k such tokens
    need these tokens' counts.
    """
    names = materialize(rows.select("name", "brand").distinct(), "names")
    df = materialize(names.select(_tokens_of("name").alias("t")).select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "df")
    top = df.orderBy(F.desc("df"), F.desc("token")).limit(FREQUENT).toPandas()  # FREQUENT rows at most
    known = dict(zip(top["token"], top["df"].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = TokenImages()
        for batch in batches:
            picked, unsure, sizes, whole = [], [], [], []
            for name in batch.column(2).to_pylist():
                own = dict.fromkeys(name.split(" "))
                rest = [t for t in own if t not in known]
                sure = len(rest) <= k
                picked.append(rest + heapq.nsmallest(k - len(rest), (t for t in own if t in known), key=lambda t: (known[t], t)) if sure else [])
                unsure.append([] if sure else rest)
                sizes.append(len(own))
                whole.append(image.of(own))
            halves = [np.array([(x >> s) & ((1 << 64) - 1) for x in whole], dtype=np.uint64).view(np.int64) for s in (0, 64)]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (picked, unsure)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *map(pa.array, halves), *lists], names=["id", "brand", "m", "w0", "w1", "picked", "unsure"])

    read = names.select(F.xxhash64("name").alias("id"), "brand", "name").mapInArrow(run, "id long, brand string, m int, w0 long, w1 long, picked array<string>, unsure array<string>")
    read = materialize(read, "rare")
    own = ["id", "brand", "m", "w0", "w1"]
    each = read.select(*own, F.explode("unsure").alias("token")).join(df, "token")
    counted = each.groupBy(*own).agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, k).alias("r"))
    return read.select(*own, F.explode("picked").alias("token")).unionByName(counted.select(*own, F.explode("r.token").alias("token")))


def blocked_pairs(rows: DataFrame, k: int = 2, share: float = 0.6) -> DataFrame:
    """(left_name, right_name, similarity): names of one brand that share one of their k rarest tokens and overlap enough in tokens.

    Names are distinct within a block, so copies make no pairs; a block is as large as the names with a token that is rare in one of them. Names
    and blocks are 64-bit hashes until the pairs are known. Sizes and images of the token sets meet in a block, and only pairs that they
    do not rule out leave it, to be verified over whole names.
    """
    branded = rows.filter("brand <> ''")
    r = rare_tokens(branded, k).select(F.xxhash64("brand", "token").alias("block"), "id", "m", "w0", "w1")
    a, b = (r.select("block", F.col("id").alias(x), *[F.col(c).alias(x + c) for c in ("m", "w0", "w1")]) for x in ("a", "b"))
    pairs = materialize(a.join(b, "block").filter((F.col("a") < F.col("b")) & near_enough(share)).select("a", "b").distinct(), "pairs")
    names = branded.select("name").distinct().select(F.xxhash64("name").alias("id"), "name")
    both = _named_pairs(pairs, names).withColumn("at", _tokens_of("left_name")).withColumn("bt", _tokens_of("right_name"))
    common = F.size(F.array_intersect("at", "bt"))
    return both.select("left_name", "right_name", F.round(common / (F.size("at") + F.size("bt") - common), 9).alias("similarity")).filter(F.col("similarity") >= share)


def neighbours(rows: DataFrame, window: int = 12) -> DataFrame:
    """(brand, left_name, right_name, step): names that follow each other within a brand's sorted names, up to `window` apart.

    Names are range-partitioned by brand and name, so a large brand is spread over many tasks. Pairs of two ranges are joined by position;
    only the first and last `window` names of a range take part, and only of brands that are in several ranges.
    """
    names = rows.filter("brand <> ''").select("brand", "name").distinct()
    parts = materialize(names.repartitionByRange("brand", "name").withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p", "brand").orderBy("name")
    before = F.array(*[F.struct(F.lit(s).alias("step"), F.lag("name", s).over(w).alias("left_name")) for s in range(1, window + 1)])
    within = parts.select("brand", F.col("name").alias("right_name"), before.alias("x")).select("brand", "right_name", F.explode("x").alias("x"))
    within = within.select("brand", "x.left_name", "right_name", "x.step").filter("left_name is not null")
    # one row a brand and range
    b = Window.partitionBy("brand")
    sizes = parts.groupBy("brand", "_p").agg(F.count("*").alias("_size"))
    spans = sizes.withColumn("_base", F.sum("_size").over(b.orderBy("_p")) - F.col("_size")).withColumn("_of", F.count("*").over(b)).filter("_of > 1").drop("_of")
    edge = parts.join(spans, ["brand", "_p"]).withColumn("_n", F.row_number().over(w)).withColumn("_at", F.col("_base") + F.col("_n"))
    last = edge.filter(F.col("_n") > F.col("_size") - window).select("brand", F.col("_p").alias("_from"), F.col("name").alias("left_name"), "_at", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("step"))
    first = edge.filter(F.col("_n") <= window).select("brand", "_p", F.col("name").alias("right_name"), "_at")
    across = last.withColumn("_at", F.col("_at") + F.col("step")).join(first, ["brand", "_at"]).filter("_from < _p")
    return within.unionByName(across.select("brand", "left_name", "right_name", "step"))


def _named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(left_name, right_name, ...) of pairs (a, b, ...) of numbers, the smaller name first; names has (id, name)."""
    j = pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    return j.select(F.least("x", "y").alias("left_name"), F.greatest("x", "y").alias("right_name"), *[c for c in pairs.columns if c not in ("a", "b")])


def _bucket_counts(names: DataFrame, k: int) -> np.ndarray:
    """How many names have the k-grams of each of BUCKETS hash buckets, in eighths of powers of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(gram_sets(batch.column(0).to_pylist(), k)[1] & (BUCKETS - 1), minlength=BUCKETS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    got = names.select("name").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    total = np.zeros(BUCKETS)
    total[got["b"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    return np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)


def _prefixes(names: DataFrame, k: int, share: float) -> DataFrame:
    """(gram, id, m, place, w0, w1): of each name (id, name) the m - ceil(share m) + 1 grams of the emptiest buckets, with size and image of its set."""
    rarity = _bucket_counts(names, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, h = gram_sets(batch.column(1).to_pylist(), k)
            _, start, m = np.unique(doc, return_index=True, return_counts=True)
            image = images(h, start)
            h = h[np.lexsort((h, rarity[h & (BUCKETS - 1)], doc))]
            keep = m - np.ceil(m * share - 1e-9).astype(np.int64) + 1
            i = np.repeat(np.arange(len(m)), keep)
            place = np.arange(len(i)) - np.repeat(np.cumsum(keep) - keep, keep)
            columns = [pa.array(h[start[i] + place]), batch.column(0).take(pa.array(i)), pa.array(m[i].astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(w[i]) for w in image)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "id", "m", "place", "w0", "w1"])

    return names.select("id", "name").mapInArrow(run, "gram long, id long, m int, place int, w0 long, w1 long")


def set_similarity(rows: DataFrame, k: int = 5, share: float = 0.85) -> DataFrame:
    """(left_name, right_name, similarity): all pairs of distinct names whose character k-gram sets have at least this Jaccard similarity.

    Lossless: of each set the m - ceil(share m) + 1 rarest grams are joined, with filters by length, by the places of the shared gram and by the
    sets' images, and the pairs verified over whole names. Any order of the grams is as right, so hash buckets are counted in place of grams. Names and
    grams are 64-bit hashes until the pairs are known; sets are made where they are needed, and no set is written.
    """
    names = materialize(rows.filter("name is not null").select("name").distinct().withColumn("id", F.xxhash64("name")), "names")
    first = _prefixes(names, k, share)
    a, b = (first.select("gram", F.col("id").alias(x), *[F.col(c).alias(x + c) for c in ("m", "place", "w0", "w1")]) for x in ("a", "b"))
    at_most = F.least("aplace", "bplace") + F.least(F.col("am") - F.col("aplace"), F.col("bm") - F.col("bplace"))
    near = a.join(b, "gram").filter((F.col("a") < F.col("b")) & (at_most >= needed(share)) & near_enough(share))
    pairs = materialize(near.select("a", "b").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                common, total = shared(batch.column(0).to_pylist(), batch.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(total)], names=["left_name", "right_name", "common", "total"])

    counted = _named_pairs(pairs, names).mapInArrow(verify, "left_name string, right_name string, common long, total long")
    return counted.select("left_name", "right_name", F.round(F.col("common") / F.col("total"), 9).alias("similarity")).filter(F.col("similarity") >= share)


def cosine_pairs(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(left_name, right_name, similarity): distinct names whose token vectors (smoothed inverse document frequency, length 1) have this cosine.

    A cosine of at least `share` needs a common token among those that hold more than 1 - share^2 of either vector's squared length, counted
    from the rarest; only these prefixes are joined, and the pairs verified over whole vectors. Names and tokens are 64-bit hashes until the
    pairs are known.
    """
    names = rows.select("name").distinct().withColumn("id", F.xxhash64("name"))
    t = names.select("id", F.explode(F.transform(F.array_distinct(F.split("name", " ")), lambda x: F.xxhash64(x))).alias("token"))
    n = names.agg(F.count("*").alias("n_all")).withColumn("one", F.lit(1))
    idf = t.groupBy("token").agg(F.count("*").alias("df")).withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select("token", "df", (F.log((1 + F.col("n_all")) / (1 + F.col("df"))) + 1).alias("w"))  # n is one row
    v = t.join(idf, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token", "w"))).alias("v"), F.sum(F.col("w") * F.col("w")).alias("sq"))
    v = materialize(v, "vectors")
    # the tokens whose forerunners hold too little of the length, by one running sum
    none = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<bigint>").alias("ts"))
    bound = (1 - share * share + 1e-9) * F.col("sq")
    prefix = F.aggregate("v", none, lambda acc, x: F.struct((acc["s"] + x["w"] * x["w"]).alias("s"), F.when(acc["s"] <= bound, F.array_append(acc["ts"], x["token"])).otherwise(acc["ts"]).alias("ts")))
    first = v.select("id", F.explode(prefix["ts"]).alias("token"))
    pairs = first.withColumnRenamed("id", "a").join(first.withColumnRenamed("id", "b"), "token").filter("a < b").select("a", "b").distinct()
    m = v.select("id", "sq", F.map_from_arrays("v.token", "v.w").alias("m"))
    p = pairs.join(m.select(F.col("id").alias("a"), F.col("sq").alias("ls"), F.col("m").alias("lm")), "a").join(m.select(F.col("id").alias("b"), F.col("sq").alias("rs"), F.col("m").alias("rm")), "b")
    dot = F.aggregate(F.array_intersect(F.map_keys("lm"), F.map_keys("rm")), F.lit(0.0), lambda acc, k: acc + F.element_at("lm", k) * F.element_at("rm", k))
    similar = p.select("a", "b", F.round(dot / F.sqrt(F.col("ls") * F.col("rs")), 6).alias("similarity")).filter(F.col("similarity") >= share)
    return _named_pairs(similar, names)


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(left, right, n_rows, reasons, best_score): undirected usable edges, repeated rows and reasons merged."""
    a, b = F.lower(F.trim("left_record_id")), F.lower(F.trim("right_record_id"))
    rows = edges.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right"), "reason", "score", a.rlike("^[0-9a-f]{64}$").alias("x"), b.rlike("^[0-9a-f]{64}$").alias("y"))
    rows = rows.filter("x and y and left < right")
    return rows.groupBy("left", "right").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("reason")))), ";").alias("reasons"), F.max("score").alias("best_score"))


def endpoint_splits(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(left_split, right_split, n_edges): how edges cross splits; the splits of a pair are in order."""
    e = canonical_edges(edges)
    s = now.select("record_id", F.coalesce("split", F.lit("none")).alias("split"))
    j = e.join(s.select(F.col("record_id").alias("left"), F.col("split").alias("ls")), "left", "left").join(s.select(F.col("record_id").alias("right"), F.col("split").alias("rs")), "right", "left")
    j = j.fillna("none", ["ls", "rs"])
    return j.groupBy(F.least("ls", "rs").alias("left_split"), F.greatest("ls", "rs").alias("right_split")).agg(F.count("*").alias("n_edges"))


def neighbour_counts(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(record_id, n_train): for records outside train the number of distinct train records they share an edge with."""
    e = canonical_edges(edges).select("left", "right")
    both = e.unionByName(e.select(F.col("right").alias("left"), F.col("left").alias("right")))
    outside = now.filter("split in ('validation', 'test')").select(F.col("record_id").alias("left"))
    train = now.filter("split = 'train'").select(F.col("record_id").alias("right"))
    return both.join(outside, "left").join(train, "right", "left_semi").groupBy(F.col("left").alias("record_id")).agg(F.count_distinct("right").alias("n_train"))


def cross_split_exact(rows: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(split_a, split_b, pairs, keys): pairs of equal keys across two splits, from the counts of each key."""
    n = rows.join(now.filter("split is not null").select("record_id", "split"), "record_id").groupBy(key, "split").agg(F.count("*").alias("n"))
    a, b = n.select(key, F.col("split").alias("split_a"), F.col("n").alias("na")), n.select(key, F.col("split").alias("split_b"), F.col("n").alias("nb"))
    return a.join(b, key).filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.count("*").alias("keys"))


def contingency_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(together_a, together_b, together_both): pairs that two groupings put together, alone and both (Rand-style counts)."""
    two = lambda c: F.floor(c * (c - 1) / 2)
    both = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return (
        both.agg(F.sum(two(F.col("n"))).alias("together_both"))
        .withColumn("one", F.lit(1))
        .join(rows.groupBy(a).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("together_a")).withColumn("one", F.lit(1)), "one")
        .join(rows.groupBy(b).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("together_b")).withColumn("one", F.lit(1)), "one")
        .select("together_a", "together_b", "together_both")
    )


def shares(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, share): the distribution of a value within each group of by."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def total_variation(rows: DataFrame, by: str, value: str, first: str, second: str) -> DataFrame:
    """(distance, largest): half the summed differences of two groups' distributions, and the value of the largest difference (ties by name)."""
    s = shares(rows.filter(F.col(by).isin(first, second)), by, value)
    a, b = s.filter(F.col(by) == first).select(value, F.col("share").alias("p")), s.filter(F.col(by) == second).select(value, F.col("share").alias("q"))
    d = a.join(b, value, "full").fillna(0.0, ["p", "q"]).withColumn("d", F.round(F.abs(F.col("p") - F.col("q")), 12))
    return d.agg(F.round(F.sum("d") / 2, 9).alias("distance"), F.min(F.struct((-F.col("d")).alias("x"), F.col(value).alias("v"))).alias("m")).select("distance", F.col("m.v").alias("largest"))


def copied_texts(rows: DataFrame, text: Column, least: int = 200) -> DataFrame:
    """(digest, n, n_retailers): long texts that occur more than once, by digest."""
    t = rows.select(F.lower(F.trim("Retailer")).alias("retailer"), text.alias("t")).filter(F.length("t") >= least)
    return t.groupBy(F.md5("t").alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("retailer").alias("n_retailers")).filter("n > 1")


def top_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """(name, neighbour, similarity, k): of each name the k most similar ones of pairs (left_name, right_name, similarity), ties by name."""
    both = pairs.select(F.col("left_name").alias("name"), F.col("right_name").alias("neighbour"), "similarity").unionByName(pairs.select(F.col("right_name").alias("name"), F.col("left_name").alias("neighbour"), "similarity"))
    w = Window.partitionBy("name").orderBy(F.desc("similarity"), "neighbour")
    return both.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def oriented_crossings(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(train_id, other_id, other_split): edges between a train record and one of another split, each once."""
    e = canonical_edges(edges).select("left", "right")
    s = now.filter("split is not null").select("record_id", "split")
    j = e.join(s.select(F.col("record_id").alias("left"), F.col("split").alias("ls")), "left").join(s.select(F.col("record_id").alias("right"), F.col("split").alias("rs")), "right")
    first = F.col("ls") == "train"
    j = j.filter(first != (F.col("rs") == "train"))
    pick = lambda a, b, c: F.when(first, F.col(a)).otherwise(F.col(b)).alias(c)
    return j.select(pick("left", "right", "train_id"), pick("right", "left", "other_id"), pick("rs", "ls", "other_split")).distinct()


def coverage(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(only_first, only_second, both): how many distinct keys two tables have alone and in common."""
    side = lambda df, name: df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    j = side(first, "a").join(side(second, "b"), key, "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def partition_check(rows: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    """(n_rows, n_ids, n_in_several, n_in_none, n_parts): whether parts put every key of rows into exactly one part."""
    own = parts.groupBy(key).agg(F.count_distinct(part).alias("k"))
    j = rows.groupBy(key).agg(F.count("*").alias("n")).join(own, key, "left")
    facts = j.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("k") > 1).alias("n_in_several"), F.count_if(F.col("k").isNull()).alias("n_in_none"))
    return facts.withColumn("one", F.lit(1)).join(parts.agg(F.count_distinct(part).alias("n_parts")).withColumn("one", F.lit(1)), "one").drop("one")
