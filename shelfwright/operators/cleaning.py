"""Row predicates, repairs and profiles of listing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.text import missing, present, strip


def breadcrumb(c: Column) -> Column:
    """A breadcrumb path with its levels trimmed and empty ones left out; NULL for missing values."""
    levels = F.filter(F.transform(F.split(c, ">"), strip), lambda x: x != "")
    return F.when(present(c), F.array_join(levels, " > "))


def repeated_path(levels: Column) -> Column:
    """Whether an array of levels is a shorter array two or more times over."""
    n = F.size(levels)
    whole = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), lambda k: (n % k == 0) & (levels == F.flatten(F.array_repeat(F.slice(levels, F.lit(1), k), (n / k).cast("int")))))
    return (n >= 2) & whole


def numeric_error(c: Column, count: bool = False) -> Column:
    """non_numeric, non_finite, negative or (for counts) fractional_count; NULL for valid and missing values."""
    v = strip(c)
    number = v.try_cast("double")
    plain = v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    wrong = F.when(v.rlike(r"^(?i)[+-]?(inf|infinity|nan)$"), "non_finite").when(~plain, "non_numeric").when(number < 0, "negative")
    if count:
        wrong = wrong.when(number != F.floor(number), "fractional_count")
    return F.when(missing(c), F.lit(None)).otherwise(wrong)


def scientific(c: Column) -> Column:
    """Whether an identifier was turned into scientific notation."""
    return F.coalesce(strip(c).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"), F.lit(False))


def looks_like_url(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^(?i)https?://"), F.lit(False))


def row_flags(listings: DataFrame) -> DataFrame:
    """(record_id, flags): the sorted names of all findings of a row; rows without findings have an empty array."""
    found = [
        F.when(numeric_error(F.col("ProductRating")).isNotNull(), F.concat(F.lit("rating:"), numeric_error(F.col("ProductRating")))),
        F.when(numeric_error(F.col("ProductReviewsCount"), True).isNotNull(), F.concat(F.lit("reviews:"), numeric_error(F.col("ProductReviewsCount"), True))),
        F.when(scientific(F.col("Upc")), "upc:scientific"),
        F.when(looks_like_url(F.col("MDM_InsertDateTime")) | looks_like_url(F.col("MDM_Id")), "mdm:displaced_url"),
        F.when(present(F.col("ProductUrl")) & ~looks_like_url(F.col("ProductUrl")), "url:syntax"),
        F.when(missing(F.col("ProductName")) & missing(F.col("ProductDescription")) & missing(F.col("ProductBrand")), "text:missing"),
        F.when(F.col("Brand").startswith(" ") | F.substring("Brand", 1, 1).rlike("^[a-z]"), "brand:format"),
    ]
    return listings.select("record_id", F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("flags"))


def disposition(flags: DataFrame) -> DataFrame:
    """(record_id, status, reasons): quarantine for displaced or missing content, review for other findings, candidate without any."""
    hard = F.filter("flags", lambda f: f.isin("mdm:displaced_url", "text:missing"))
    status = F.when(F.size(hard) > 0, "quarantine").when(F.size("flags") > 0, "review").otherwise("candidate")
    return flags.select("record_id", status.alias("status"), F.array_join("flags", ";").alias("reasons"))


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) rows of the given columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("x")).select("x.*")


def attribute_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, populated, distinct_values, repeated_rows, largest): counts of present values."""
    counts = unpivot(df, columns).filter(present(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("field").agg(
        F.sum("n").alias("populated"), F.count("*").alias("distinct_values"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_rows"), F.max("n").alias("largest")
    )


def iqr_rare(df: DataFrame, column: str) -> DataFrame:
    """(value, n, lower, upper, rare): label counts with the quartile bounds of the counts (1.5 interquartile ranges)."""
    counts = df.filter(present(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    q = counts.agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))
    bounds = q.select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"), F.lit(1).alias("one"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one").select("value", "n", "lower", "upper", (F.col("n") < F.col("lower")).alias("rare"))  # bounds is one row


def parent_child(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(child, n_parents, parent_rows, child_rows): children that occur under several parents."""
    rows = df.filter(present(F.col(f"`{parent}`")) & present(F.col(f"`{child}`"))).select(strip(F.col(f"`{parent}`")).alias("parent"), strip(F.col(f"`{child}`")).alias("child"))
    pairs = rows.groupBy("parent", "child").agg(F.count("*").alias("n"))
    return pairs.groupBy("child").agg(F.count("*").alias("n_parents"), F.max("n").alias("most_rows"), F.sum("n").alias("child_rows")).filter("n_parents > 1")


def text_profile(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n_rows, missing_share, mean_length, median_length, p95_length) of a text column."""
    n = F.when(present(F.col(column)), F.length(strip(F.col(column))))
    return df.groupBy(strip(F.col(by)).alias("by")).agg(
        F.count("*").alias("n_rows"), F.round(F.avg(missing(F.col(column)).cast("int")), 9).alias("missing_share"), F.round(F.avg(n), 6).alias("mean_length"),
        F.percentile(n, F.lit(0.5)).alias("median_length"), F.percentile(n, F.lit(0.95)).alias("p95_length"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order; ties by all columns named."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _levels(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ">"), strip), lambda x: x != "")


def collapsed_paths(df: DataFrame, column: str) -> DataFrame:
    """(record_id, repaired, changed) of present breadcrumb paths: one that is a shorter path of two different levels or more, several times over, is cut to it."""
    rows = df.filter(present(F.col(column))).select("record_id", _levels(F.col(column)).alias("lv"))
    n = F.size("lv")
    whole = lambda k: (n % k == 0) & (F.size(F.array_distinct(F.slice("lv", F.lit(1), k))) > 1) & (F.col("lv") == F.flatten(F.array_repeat(F.slice("lv", F.lit(1), k), (n / k).cast("int"))))
    sizes = F.when(n >= 4, F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n / 2).cast("int")))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("k", F.get(F.filter(sizes, whole), 0))
    return rows.select("record_id", F.array_join(F.when(F.col("k").isNull(), F.col("lv")).otherwise(F.slice("lv", F.lit(1), F.col("k"))), " > ").alias("repaired"), F.col("k").isNotNull().alias("changed"))


def outside_vocabulary(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(record_id, value) of present values that known(value) lacks."""
    rows = df.filter(present(F.col(column))).select("record_id", strip(F.col(column)).alias("value"))
    return rows.join(known.select("value").distinct(), "value", "left_anti").select("record_id", "value")


def replaced_labels(df: DataFrame, rules: tuple[tuple[str, str, str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """df with labels replaced by rules (column, old, new, name), which look at the values as they were, and the log (record_id, field, before, after, rule)."""
    hits = F.array(*[F.when(F.col(f"`{c}`") == old, F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("before"), F.lit(new).alias("after"), F.lit(name).alias("rule"))) for c, old, new, name in rules])
    log = df.select("record_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("x")).select("record_id", "x.*")
    changed = {}
    for c, old, new, _ in rules:
        changed[c] = (changed[c] if c in changed else F).when(F.col(f"`{c}`") == old, new)
    return df.withColumns({c: w.otherwise(F.col(f"`{c}`")) for c, w in changed.items()}), log


def label_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(label, n_before, n_after): counts of a label in two states, 0 where it is not, `<missing>` for missing ones."""
    count = lambda df, n: df.groupBy(F.when(present(F.col(column)), F.col(column)).otherwise("<missing>").alias("label")).agg(F.count("*").alias(n))
    return count(before, "n_before").join(count(after, "n_after"), "label", "full").fillna(0, ["n_before", "n_after"])


def model_text(columns: tuple[str, ...], limit: int) -> Column:
    """`[Column] value` of each present column: markup removed, single blanks, at most `limit` characters a value."""
    parts = []
    for c in columns:
        flat = F.trim(F.regexp_replace(F.regexp_replace(F.col(c), "<[^<>]*>", " "), r"\s+", " "))
        known = present(F.col(c)) & ~F.lower(strip(F.col(c))).isin("none", "nan")
        parts.append(F.when(known, F.concat(F.lit(f"[{c}] "), F.trim(F.substring(flat, 1, limit)))))
    return F.concat_ws(" ", *parts)


def size_bucket(n: Column) -> Column:
    """The bucket of a group's size: 1, 2, 3-5, 6-10 or 11+."""
    return F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")


def input_errors(df: DataFrame, key: str, needed: dict[str, str]) -> DataFrame:
    """(record_id, error): rows whose key is missing or repeated, and rows that lack a needed column ({name: column})."""
    k = F.when(present(F.col(key)), strip(F.col(key)))
    rows = df.select("record_id", k.alias("k"), *[present(F.col(c)).alias(name) for name, c in needed.items()])
    often = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.lit(True).alias("again"))
    rows = rows.join(often, "k", "left")
    found = F.array(F.when(F.col("k").isNull(), "key_missing").when(F.col("again"), "key_repeated"), *[F.when(~F.col(name), f"{name}_missing") for name in needed])
    return rows.select("record_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))


def missing_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, field, n, n_missing, share) for each of the columns."""
    each = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), missing(F.col(c)).alias("m")) for c in columns])).alias("x")).select(by, "x.*")
    return each.groupBy(by, "field").agg(F.count("*").alias("n"), F.count_if("m").alias("n_missing"), F.round(F.avg(F.col("m").cast("int")), 9).alias("share"))


def overlap_signature(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(record_id, signature): the names of the kinds of findings a row has, joined by +, or none."""
    joined = F.concat_ws("+", *[F.when(found, name) for name, found in kinds.items()])
    return df.select("record_id", F.when(joined == "", "none").otherwise(joined).alias("signature"))
