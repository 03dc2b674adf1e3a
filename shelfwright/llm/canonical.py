"""Problem 2: freely typed values mapped to the entry of a reference list that they mean, the rest reported as unmatched.

Method: a partition-based pigeonhole join, built-in functions only. Values and reference names are brought to a bare key (letters and
digits, accents folded, decorations such as company forms and "shop all" removed, known short forms written out). Of each reference key
k+1 segments are cut; a key within k edits must contain one of them unchanged and hardly displaced, so an equality join on length, number
and text of the segment finds every candidate, which levenshtein() then verifies. What an anti-join leaves over is unmatched.

Scale: only the distinct values are matched, a small part of the rows; rows are joined to their value's entry at the end, where adaptive
execution splits hot values, as the other side has one row a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.text import present
from shelfwright.session import materialize

#: Letters that fold to plain ones, one for one.
LETTERS = {
    "a": "àáâãäåāăą", "c": "çćč", "d": "ďđ", "e": "èéêëēęě", "g": "ğ", "i": "ìíîïīı", "l": "łľĺ", "n": "ñńň", "o": "òóôõöøōő", "r": "řŕ", "s": "śšßş", "t": "ťţ",
    "u": "ùúûüūůű", "y": "ýÿ", "z": "źżž", "'": "’‘`",
}
ACCENTED = "".join(LETTERS.values())
PLAIN = "".join(k * len(v) for k, v in LETTERS.items())
#: Decorations to remove from a lower-cased value, in order, with what takes their place.
DECORATIONS = (
    (r"â(?:€|\x{80})(?:™|\x{99})", "'"),
    (r"[ãåäâ][^a-z0-9\s'’]", ""),
    (r"&#0*39;|&#x27;|&apos;|&quot;", "'"),
    (r"&amp;", "&"),
    (r"<[^<>]*>", " "),
    (r"[®™©]|\((?:r|tm|c|official)\)", " "),
    (r"^\s*(?:brand\s*:|visit the |shop all |shop |by |from )", " "),
    (r"[\s_.-]+", " "),
    (r" tm(?: |$)", " "),
    (r"(?:,? (?:inc|llc|ltd|gmbh|usa|corp|plc|brand|store|official))+\s*$", ""),
)
#: Short forms of words in names.
SHORT_FORMS = {
    "bros": "brothers", "bro": "brothers", "org": "organics", "ess": "essentials", "rem": "remedies", "welln": "wellness", "nutr": "nutrition", "nat": "naturals",
    "bot": "botanics", "apoth": "apothecary", "hlth": "health", "suppl": "supplements", "vit": "vitamins", "trad": "trading", "and": "", "dtrs": "daughters",
}


def words(c: Column) -> Column:
    """The words of a value without decorations: lower case, accents folded, short forms written out."""
    bare = F.lower(c)
    for pattern, to in DECORATIONS:
        bare = F.regexp_replace(bare, pattern, to)
    bare = F.translate(bare, ACCENTED, PLAIN)
    bare = F.regexp_replace(bare, r"^\s*(.+?)( .*)?\s*/\s*\1\2?\s*$", "$1$2")  # a name, and it or its first word again
    full = F.create_map(*[F.lit(x) for pair in SHORT_FORMS.items() for x in pair])
    split = F.transform(F.split(F.trim(bare), " +"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(F.transform(split, lambda w: F.coalesce(F.element_at(full, w), w)), lambda w: w != "")


def initials(c: Column) -> Column:
    """The first letters of a name's words in capitals, A for &."""
    return F.array_join(F.transform(F.split(F.trim(F.translate(F.lower(F.regexp_replace(c, "&", "and")), ACCENTED, PLAIN)), " +"), lambda w: F.upper(F.substring(w, 1, 1))), "")


def edits(length: Column) -> Column:
    """How many edits a key of this length may be away from a reference key."""
    return F.when(length < 5, 0).when(length < 10, 1).otherwise(2)


def reference_keys(reference: DataFrame) -> DataFrame:
    """(key, kind, brand_id): the keys by which each entry is known.

    kind is 'full' (all words), 'sorted' (the words in any order), 'first' (the first word, where the name has more) or 'initials' (of
    three words or more, & being one). A key that belongs to several entries means none of them, save that a current name goes before a former one.
    """
    names = reference.select("brand_id", F.explode(F.array(F.struct(F.lit(0).alias("old"), F.col("brand_name").alias("name")), F.struct(F.lit(1).alias("old"), F.col("former_name").alias("name")))).alias("n"))
    w = names.filter(present(F.col("n.name"))).select("brand_id", "n.old", words(F.col("n.name")).alias("w"), initials(F.col("n.name")).alias("i")).filter(F.size("w") > 0)
    many = F.size("w") > 1
    kinds = F.array(
        F.struct(F.lit("full").alias("kind"), F.array_join("w", "").alias("key")),
        F.struct(F.lit("sorted").alias("kind"), F.when(many, F.array_join(F.array_sort("w"), " ")).alias("key")),
        F.struct(F.lit("first").alias("kind"), F.when(many, F.col("w")[0]).alias("key")),
        F.struct(F.lit("initials").alias("kind"), F.when(F.length("i") > 2, F.col("i")).alias("key")),
    )
    keys = w.select("brand_id", "old", F.explode(kinds).alias("k")).select("brand_id", "old", "k.*").filter("key is not null").distinct()
    first = keys.withColumn("oldest", F.min("old").over(Window.partitionBy("kind", "key"))).filter("old = oldest")
    return first.groupBy("kind", "key").agg(F.min("brand_id").alias("brand_id"), F.count_distinct("brand_id").alias("n")).filter("n = 1").drop("n")


def _segments(length: Column, k: Column) -> Column:
    """(no, start, size) of the k+1 segments of a key of this length, starts from 1; sizes differ by one at most, shorter ones first."""
    n = k + 1
    size, more = F.floor(length / n).cast("int"), (length % n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.struct(i.alias("no"), (i * size + F.greatest(F.lit(0), i - (n - more)) + 1).cast("int").alias("start"), (size + (i >= n - more).cast("int")).cast("int").alias("size")),
    )


def pigeonhole_join(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, ref_key, distance) of all keys of values and ref_keys of reference within edits(length of the ref_key) of each other."""
    r = reference.select("ref_key").distinct().withColumn("l", F.length("ref_key")).withColumn("k", edits(F.col("l")))
    cut = r.select("ref_key", "l", "k", F.explode(_segments(F.col("l"), F.col("k"))).alias("s"))
    cut = cut.select("ref_key", "l", "k", F.col("s.no").alias("no"), F.expr("substring(ref_key, s.start, s.size)").alias("part"))
    v = values.select("key").distinct().withColumn("n", F.length("key"))
    v = v.withColumn("l", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 2), F.col("n") + 2))).withColumn("k", edits(F.col("l"))).filter(F.abs(F.col("n") - F.col("l")) <= F.col("k"))
    v = v.select("key", "n", "l", "k", F.explode(_segments(F.col("l"), F.col("k"))).alias("s"))
    v = v.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("s.start") - F.col("k")), F.col("s.start") + F.col("k"))))
    v = v.filter(F.col("at") + F.col("s.size") - 1 <= F.col("n")).select("key", "l", F.col("s.no").alias("no"), F.expr("substring(key, at, s.size)").alias("part")).distinct()
    # the pieces are many times the keys, which the planner's estimate leaves out, so that it would send all of them to the driver
    found = v.join(cut.hint("merge"), ["l", "no", "part"]).select("key", "ref_key", "k").distinct()
    return found.withColumn("distance", F.levenshtein("key", "ref_key")).filter("distance <= k").select("key", "ref_key", "distance")


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, brand_id, how): each distinct value with its entry; how is 'full', 'sorted', 'first', 'initials', 'edits' or 'unmatched' (brand_id 0).

    Exact keys go before edits, fewer edits before more; a value whose nearest keys belong to several entries is unmatched, as is one
    without letters and digits. An empty reference leaves everything unmatched.
    """
    keyed = values.select("value").distinct().withColumn("w", words(F.col("value")))
    keyed = keyed.select("value", F.array_join("w", "").alias("key"), F.array_join(F.array_sort("w"), " ").alias("sorted"), F.when(F.trim("value").rlike("^[A-Z]{3,6}$"), F.trim("value")).alias("capitals"))
    keyed, refs = materialize(keyed, "keyed"), materialize(reference_keys(reference), "keys")
    # all keys of a value meet the reference in one join; the first kind that hits holds
    ways = (("full", "key"), ("sorted", "sorted"), ("first", "key"), ("initials", "capitals"))
    tries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.col(c).alias("key")) for i, (kind, c) in enumerate(ways)])
    tried = keyed.select("value", F.explode(F.filter(tries, lambda x: x["key"].isNotNull())).alias("t")).select("value", "t.*").join(refs, ["kind", "key"])
    hit = tried.groupBy("value").agg(F.min(F.struct("place", "kind", "brand_id")).alias("m")).select("value", "m.brand_id", F.col("m.kind").alias("how"))
    hit = materialize(hit, "hits")
    rest = materialize(keyed.join(hit, "value", "left_anti"), "rest")
    # edits are allowed in the full name only, or in a first word that is long enough to tell
    names = refs.filter("kind = 'full' or (kind = 'first' and length(key) >= 6)").select(F.col("key").alias("ref_key"), "brand_id")
    near = pigeonhole_join(rest.filter("key <> ''"), names).join(names, "ref_key").groupBy("key", "distance").agg(F.min("brand_id").alias("brand_id"), F.count_distinct("brand_id").alias("n"))
    best = near.withColumn("least", F.min("distance").over(Window.partitionBy("key"))).filter("distance = least and n = 1").select("key", "brand_id")
    edited = rest.join(best, "key", "left").select("value", F.coalesce("brand_id", F.lit(0)).cast("long").alias("brand_id"), F.when(F.col("brand_id").isNull(), "unmatched").otherwise("edits").alias("how"))
    return hit.withColumn("brand_id", F.col("brand_id").cast("long")).unionByName(edited)


def map_fields(listings: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("ProductBrand", "Brand"), row: str = "record_id") -> DataFrame:
    """(record_id, field_name, value, brand_id, how) of every present value that is not letter for letter a brand_name.

    NULL, empty, blank and "null" values are no cases; values of any length are matched whole; repeated values are matched once; a value
    without an entry has brand_id 0; no listings give no rows; further columns are not read.
    """
    cells = listings.select(F.col(row).alias("record_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("c")).select("record_id", "c.*")
    cases = cells.filter(present(F.col("value"))).join(reference.select(F.col("brand_name").alias("value")), "value", "left_anti")
    cases = materialize(cases, "cases")
    return cases.join(map_values(cases, reference), "value").select("record_id", "field_name", "value", "brand_id", "how")
