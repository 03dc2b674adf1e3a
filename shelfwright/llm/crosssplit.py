"""Problem 1: records of the evaluation splits that recur, exactly or almost, in the training split.

Method: an exact prefix-filter bipartite join on rare shingles. A record's text (the words of name and description in any script; figures,
markup and damaged characters left out) becomes the set of its five-word shingles. All sets are put in one global order, rare shingles first: two
sets that overlap by the wanted share have a shingle in common among the first ones of each, the prefix. Prefixes of evaluation records are
indexed and probed with those of training records; a pair must pass filters by length, by the places of the shared shingle and by the
bits in which 256-bit images of the sets differ, all of which are exact bounds, before its whole sets are compared.

The wanted share (Jaccard 0.5) is lower than the usual 0.8, as TESTDATA.md states the case by sentences: copies with a sentence dropped,
one added and a few words mistyped still have nearly all sentences in agreement, but only about half of their shingles.

Scale: records of equal text are one class; classes are paired and their members listed beside, so a class with a third of all records is
joined once. How rare a shingle is, is counted over all records in two steps: hash buckets, a table of fixed size, bound every count from
above, and the shingles of buckets that are fuller than most are counted one by one, of which the FREQUENT most frequent are kept with their
exact counts. Both tables have a fixed size; with them prefixes are found where the text is read, and only prefixes are shuffled. Shingles of
a third of all records come last in the order, out of all prefixes. Ids of classes and shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.text import present
from shelfwright.operators.assignments import current_assignments
from shelfwright.session import materialize

SHINGLE = 5
SHARE = 0.5
COUNTERS = 1 << 18
#: Shingles whose exact counts are kept, and how much fuller than the mean a bucket must be for its shingles to be counted.
FREQUENT = 1 << 17
FULL = 3.0
EVALUATION = ("validation", "test")
#: Ids of classes that may be broadcast (a few bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000


#: Letters of other scripts than the Latin one, and those of scripts that are written without blanks.
_FOREIGN = r"[\p{L}\p{M}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]"
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def plain_text(*columns: str) -> Column:
    """Texts in lower case without markup."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("&")), F.regexp_replace(text, r"<[^<>]*>|&#?[a-z0-9]{2,8};", " ")).otherwise(text)


def words(text: Column) -> Column:
    """The words of a plain_text(); figures and all other characters separate them.

    Words are runs of the letters a-z; in texts with more letters of another script also the runs of these, each letter by itself where the script
    has no blanks. (Elsewhere such letters are what wrong decoding leaves behind.) A text without words is empty.
    """
    foreign = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]|[\p{IsLatin}\p{IsCommon}\p{IsInherited}]", "")) > F.length(F.regexp_replace(text, "[^a-z]", ""))
    spaced = F.regexp_replace(F.regexp_replace(text, _UNSPACED, " $1 "), r"[^a-z\p{L}\p{M}]+|[[\p{IsLatin}\p{IsCommon}\p{IsInherited}]&&[^a-z]]+", " ")
    return F.coalesce(F.when(text.rlike(_FOREIGN), F.when(foreign, F.trim(spaced))), F.trim(F.regexp_replace(text, "[^a-z]+", " ")))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct runs of `size` words of each words() text, by text and hash.

    A shorter text is one run; one without words has none. Hashes are the same on every machine.
    """
    seen: dict[str, int] = {}
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        ws = text.split() if text else []
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
        if 0 < len(ws) < size:
            flat.extend([0] * (size - len(ws)))
        lengths[i] = max(len(ws), size) if ws else 0
    words_ = np.array(flat, dtype=np.uint64)
    runs = np.maximum(lengths - (size - 1), 0)
    doc = np.repeat(np.arange(len(texts)), runs)
    if not len(doc):
        return doc, np.empty(0, dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begin, runs)
    h = np.zeros(len(doc), dtype=np.uint64)
    for k in range(size):
        h = (h ^ words_[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h.view(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _texts(listings: DataFrame) -> DataFrame:
    """(record_id, Retailer, text, c): of the listings that have both a name and a description, their words and their class, a hash of these, or of the whole texts where there are none."""
    both = listings.filter(present(F.col("ProductName")) & present(F.col("ProductDescription")) & F.col("record_id").isNotNull())
    whole = F.xxhash64(F.lower(F.trim("ProductName")), F.lower(F.trim("ProductDescription")), F.lit(1))
    rows = both.select(F.lower(F.trim("record_id")).alias("record_id"), "Retailer", plain_text("ProductName", "ProductDescription").alias("plain"), whole.alias("whole"))
    rows = rows.select("record_id", "Retailer", words(F.col("plain")).alias("text"), "whole")
    return rows.select("record_id", "Retailer", "text", F.when(F.col("text") == "", F.col("whole")).otherwise(F.xxhash64("text")).alias("c"))


def _members(texts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(c, record_id, is_eval, split, Retailer) of the assigned records; c is the class, a hash of the text."""
    now = current_assignments(assignments).filter(F.col("split").isin("train", *EVALUATION)).select("record_id", "split")
    rows = texts.select("record_id", "Retailer", "c")
    return rows.join(now, "record_id").select("c", "record_id", (F.col("split") != "train").alias("is_eval"), "split", "Retailer")


class Rarity:
    """How frequent shingles are, on a scale of eighths of powers of two: exact for the most frequent, an upper bound by hash bucket for the rest."""

    def __init__(self, buckets: bytes, known: bytes, counts: bytes, least: int) -> None:
        self.buckets, self.known, self.counts, self.least = np.frombuffer(buckets, dtype=np.uint8), np.frombuffer(known, dtype=np.int64), np.frombuffer(counts, dtype=np.uint8), least

    def __reduce__(self) -> tuple:
        return Rarity, (self.buckets.tobytes(), self.known.tobytes(), self.counts.tobytes(), self.least)

    def rank(self, h: np.ndarray) -> np.ndarray:
        out = self.buckets[h & (COUNTERS - 1)]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[at] == h, self.counts[at], np.minimum(out, self.least))
        return out


def _scale(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(1 + n.astype(np.float64))).astype(np.uint8)


def _counts(texts: DataFrame) -> Rarity:
    """How many records have each shingle: two maps over the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            _, h = shingle_sets(batch.column(0).to_pylist())
            total += np.bincount(h & (COUNTERS - 1), minlength=COUNTERS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    counted = texts.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    total = np.zeros(COUNTERS, dtype=np.int64)
    total[counted["b"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    full = (total > max(2.0, FULL * total.mean())).tobytes()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(full, dtype=bool)
        for batch in batches:
            _, h = shingle_sets(batch.column(0).to_pylist())
            h, n = np.unique(h[wanted[h & (COUNTERS - 1)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    each = texts.select("text").mapInArrow(single, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = each.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas().sort_values("h")  # FREQUENT rows at most; the others rank by bucket, below them
    counts = _scale(top["n"].to_numpy())
    least = int(counts.min()) if len(top) == FREQUENT else 255
    return Rarity(_scale(total).tobytes(), top["h"].to_numpy(dtype=np.int64).tobytes(), counts.tobytes(), least)


def _prefixes(classes: DataFrame, rarity: Rarity, share: float) -> DataFrame:
    """A row (h, place) for each shingle of the prefix of each class, with the class, its size n and the 256-bit image of its set.

    Sets that differ in d elements have images that differ in at most d bits. classes has (c, has_eval, has_train, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h = shingle_sets(batch.column(3).to_pylist())
            if not len(doc):
                continue
            own, start, n = np.unique(doc, return_index=True, return_counts=True)
            bit = np.uint64(1) << (h & 63).astype(np.uint64)
            part = (h >> 6) & 3
            image = [np.bitwise_or.reduceat(np.where(part == k, bit, np.uint64(0)), start).view(np.int64) for k in range(4)]
            h = h[np.lexsort((h, rarity.rank(h), doc))]
            keep = n - np.ceil(n * share - 1e-9).astype(np.int64) + 1
            i = np.repeat(np.arange(len(own)), keep)
            place = np.arange(len(i)) - np.repeat(np.cumsum(keep) - keep, keep)
            who = pa.array(own[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[start[i] + place]), *(batch.column(k).take(who) for k in range(3)), pa.array(n[i].astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(w[i]) for w in image)],
                names=["h", "c", "has_eval", "has_train", "n", "place", "w0", "w1", "w2", "w3"],
            )

    schema = "h long, c long, has_eval boolean, has_train boolean, n int, place int, w0 long, w1 long, w2 long, w3 long"
    return classes.select("c", "has_eval", "has_train", "text").mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """(c, s) of (c, text): s is the whole set of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h = shingle_sets(batch.column(1).to_pylist())
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h))], names=["c", "s"])

    return texts.select("c", "text").mapInArrow(run, "c long, s array<long>")


def candidate_classes(texts: DataFrame, classes: DataFrame, rarity: Rarity, share: float = SHARE) -> DataFrame:
    """(c, d): pairs of classes, c with evaluation and d with training records, that pass all filters; each once.

    texts has the representatives' (record_id, text), classes has (record_id, c, has_eval, has_train).
    """
    read = texts.join(classes, "record_id")
    side = lambda flag, x: _prefixes(read.filter(flag), rarity, share).select("h", *[F.col(k).alias(x + k) for k in ("c", "n", "place", "w0", "w1", "w2", "w3")])
    joined = side("has_eval", "a").join(side("has_train", "b"), "h")
    need = F.ceil((F.col("an") + F.col("bn")) * (share / (1 + share)) - 1e-9)
    differ = sum((F.bit_count(F.col(f"aw{k}").bitwiseXOR(F.col(f"bw{k}"))) for k in range(1, 4)), F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))))
    # what may be shared before this shingle, and from it on
    at_most = F.least("aplace", "bplace") + F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace"))
    near = (F.col("ac") != F.col("bc")) & (F.least("an", "bn") >= F.greatest("an", "bn") * share - 1e-9) & (at_most >= need) & (F.col("an") + F.col("bn") - differ >= 2 * need)
    return joined.filter(near).select(F.col("ac").alias("c"), F.col("bc").alias("d")).distinct()


def _small(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def linked_classes(listings: DataFrame, assignments: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(c, d, similarity) of linked classes, c with evaluation and d with training records, c = d included; and the members."""
    texts = materialize(_texts(listings), "texts")
    members = materialize(_members(texts, assignments), "members")
    roles = members.groupBy("c").agg(F.min("record_id").alias("record_id"), F.max("is_eval").alias("has_eval"), F.max(~F.col("is_eval")).alias("has_train"))
    texts = texts.select("record_id", "text")
    pairs = materialize(candidate_classes(texts, roles, _counts(texts), share), "candidates")
    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("c", "d")).alias("c")).distinct().join(roles.select("c", "record_id"), "c")
    # the texts of the candidates only: their records are few next to all
    sets = materialize(_sets(texts.join(_small(wanted, 2 * n), "record_id")), "sets")
    both = pairs.join(sets.withColumnRenamed("s", "sc"), "c").join(sets.select(F.col("c").alias("d"), F.col("s").alias("sd")), "d")
    common = F.size(F.array_intersect("sc", "sd"))
    similar = both.withColumn("similarity", common / (F.size("sc") + F.size("sd") - common)).filter(F.col("similarity") >= share).select("c", "d", "similarity")
    same = roles.filter("has_eval and has_train").select("c", F.col("c").alias("d"), F.lit(1.0).alias("similarity"))
    return similar.unionByName(same), members


def overlaps(listings: DataFrame, assignments: DataFrame, share: float = SHARE) -> DataFrame:
    """(left_record_id, right_record_id): every pair of an evaluation and a training record whose texts are linked, smaller id first.

    Only records with a current split and both texts take part; NULL, blank and "null" texts are missing. Texts without words are the
    same only if they are equal. Texts of any length are compared whole; repeated assignments count once; empty tables give no rows; other columns
    are not read.
    """
    links, members = linked_classes(listings, assignments, share)
    a = members.filter("is_eval").select("c", F.col("record_id").alias("x"))
    b = members.filter(~F.col("is_eval")).select(F.col("c").alias("d"), F.col("record_id").alias("y"))
    found = links.join(a, "c").join(b, "d")
    return found.select(F.least("x", "y").alias("left_record_id"), F.greatest("x", "y").alias("right_record_id"))


def overlap_classes(listings: DataFrame, assignments: DataFrame, share: float = SHARE) -> DataFrame:
    """(record_id, class_id, split, Retailer, n_links): every assigned record with its class and the number of records of the other side it recurs in."""
    links, members = linked_classes(listings, assignments, share)
    sizes = members.groupBy("c").agg(F.sum(F.col("is_eval").cast("long")).alias("n_eval"), F.sum((~F.col("is_eval")).cast("long")).alias("n_train"))
    links = materialize(links, "links")
    of_eval = links.join(sizes.select(F.col("c").alias("d"), "n_train"), "d").groupBy("c").agg(F.sum("n_train").alias("n"))
    of_train = links.join(sizes.select("c", "n_eval"), "c").groupBy(F.col("d").alias("c")).agg(F.sum("n_eval").alias("n"))
    counts = of_eval.withColumn("is_eval", F.lit(True)).unionByName(of_train.withColumn("is_eval", F.lit(False)))
    rows = members.join(counts, ["c", "is_eval"], "left")
    return rows.select("record_id", F.col("c").alias("class_id"), "split", "Retailer", F.coalesce("n", F.lit(0)).alias("n_links"))


def overlap_report(listings: DataFrame, assignments: DataFrame, share: float = SHARE) -> DataFrame:
    """(split, Retailer, n_records, n_overlapping, n_pairs) per split and Retailer, without listing a pair."""
    rows = overlap_classes(listings, assignments, share)
    return rows.groupBy("split", "Retailer").agg(F.count("*").alias("n_records"), F.sum((F.col("n_links") > 0).cast("long")).alias("n_overlapping"), F.sum("n_links").alias("n_pairs"))
