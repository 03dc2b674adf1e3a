"""Registered queries of the core and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwright.functions import identifiers
from shelfwright.functions.text import key, present, strip
from shelfwright.operators import cleaning, evaluation, graph, ledger, models, resolution
from shelfwright.operators.assignments import current_assignments
from shelfwright.session import table
from shelfwright.sources import rejects
from shelfwright.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_BAD_VALUE = r"""
  NOT (coalesce(regexp_full_match(lower(trim({m}, e' \t\r\n')), '(null)?|[0-9]{{6,12}}'), true))
  OR NOT (coalesce(regexp_full_match(trim({u}, e' \t\r\n'), '(?i:null)?|(?i:https?)://[\p{{L}}\p{{N}}\[][^\s]*'), true))
"""


@query(
    rf"""
WITH parts AS (
  SELECT raw_id, raw_text, regexp_full_match(raw_text, '(?s){_FIELD}(?:,{_FIELD})*') AS well,
         regexp_extract_all(',' || raw_text, '(?s),({_FIELD})', 1) AS f
  FROM raw_rows),
fields AS (
  SELECT raw_id, well, len(f) AS n, f[9] AS url, f[11] AS mdm FROM parts),
plain AS (
  SELECT raw_id, well, n, CASE WHEN starts_with(url, '"') THEN replace(url[2:-2], '""', '"') ELSE url END AS url,
         CASE WHEN starts_with(mdm, '"') THEN replace(mdm[2:-2], '""', '"') ELSE mdm END AS mdm FROM fields),
judged AS (
  SELECT raw_id, CASE WHEN NOT well THEN 'quoting' WHEN n <> 12 THEN 'column_count' WHEN {_BAD_VALUE.format(m="mdm", u="url")} THEN 'invalid_value' END AS reason
  FROM plain)
SELECT 'raw_rows' AS table_name, CAST(raw_id AS VARCHAR) AS row_key, reason FROM judged WHERE reason IS NOT NULL
UNION ALL
SELECT 'training_candidate', record_id, 'invalid_value' FROM training_candidate WHERE {_BAD_VALUE.format(m="MDM_Id", u="ProductUrl")}
"""
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.unloadable(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "training_candidate"))


@query()
def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.load_raw_rows(table(spark, sf_dir, "raw_rows")).filter("reason is null").drop("reason", "detail")


@query()
def p7_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.load_raw_rows(table(spark, sf_dir, "raw_rows")).filter("reason is not null").select("raw_id", "reason", "detail")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training_candidate")


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_assignments(table(spark, sf_dir, "assignments"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.labelled(table(spark, sf_dir, "target_predictions"))


def _present(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(trim({c}, e' \\t\\r\\n')) NOT IN ('', 'null'))"


def _strip(c: str) -> str:
    return f"trim({c}, e' \\t\\r\\n')"


_NOW = f"""
now_rows AS (
  SELECT record_id, last.g AS group_id, last.s AS split FROM (
    SELECT record_id, max(struct_pack(t := assigned_at, s := split, g := group_id)) AS last FROM (
      SELECT lower({_strip("record_id")}) AS record_id, assigned_at,
             CASE WHEN {_present("group_id")} THEN lower({_strip("group_id")}) END AS group_id,
             CASE WHEN lower({_strip("split")}) = 'val' THEN 'validation' WHEN {_present("split")} THEN lower({_strip("split")}) END AS split
      FROM assignments) WHERE record_id NOT IN ('', 'null') GROUP BY record_id))
"""
_NAMED = f"""
named AS (
  SELECT * FROM (
    SELECT record_id, trim(regexp_replace(lower(ProductName), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name,
           trim(regexp_replace(lower(coalesce(Brand, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS brand
    FROM training_candidate WHERE {_present("ProductName")}) WHERE name <> '')
"""
_PRED = """
pred AS (
  SELECT prediction_id, l.* FROM (
    SELECT prediction_id, max(struct_pack(predicted_at := predicted_at, record_id := record_id, target := target, true_label := true_label,
      predicted_label := predicted_label, confidence := confidence, model_version := model_version)) AS l FROM target_predictions GROUP BY 1)
  WHERE l.true_label IS NOT NULL AND l.predicted_label IS NOT NULL)
"""
_CLASSES = """
cells AS (SELECT target, true_label, predicted_label, count(*) AS n FROM pred GROUP BY ALL),
truth AS (SELECT target, true_label AS label, sum(n) AS support, sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS correct FROM cells GROUP BY ALL),
said AS (SELECT target, predicted_label AS label, sum(n) AS emitted FROM cells GROUP BY ALL),
both_sides AS (SELECT target, label, coalesce(support, 0) AS support, coalesce(correct, 0) AS correct, coalesce(emitted, 0) AS emitted FROM truth FULL JOIN said USING (target, label)),
pr AS (SELECT *, CASE WHEN emitted > 0 THEN correct / emitted ELSE 0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall FROM both_sides),
classes AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)
"""
_EDGES = """
pairs AS (
  SELECT least(a, b) AS "left", greatest(a, b) AS "right", reason, score FROM (
    SELECT lower(trim(left_record_id)) AS a, lower(trim(right_record_id)) AS b, reason, score FROM match_edges)
  WHERE regexp_full_match(a, '[0-9a-f]{64}') AND regexp_full_match(b, '[0-9a-f]{64}') AND a <> b),
edges AS (
  SELECT "left", "right", count(*) AS n_rows, coalesce(array_to_string(list_sort(list_distinct(list(lower(trim(reason))) FILTER (reason IS NOT NULL))), ';'), '') AS reasons, max(score) AS best_score
  FROM pairs GROUP BY ALL)
"""
_EVENTS = """
events_once AS (
  SELECT event_id, f.*, n_deliveries FROM (
    SELECT event_id, min(struct_pack(received_at := received_at, target := target, entity_id := entity_id, record_id := record_id, group_id := group_id, action := action, label := label,
      flags := flags, model_version := model_version, ontology_version := ontology_version, source_system := source_system, occurred_at := occurred_at)) AS f, count(*) AS n_deliveries
    FROM review_events WHERE event_id IS NOT NULL GROUP BY 1))
"""
_PROFILED = ["Retailer", "Brand", "ProductBrand", "ProductName", "Sku", "Upc", "ProductModelNumber", "JoiningKey", "MDM_Id"]


@query(
    "WITH cells AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM training_candidate WHERE {_present(c)}" for c in _PROFILED)
    + """), counts AS (SELECT field, value, count(*) AS n FROM cells GROUP BY ALL)
SELECT field, CAST(sum(n) AS BIGINT) AS populated, count(*) AS distinct_values, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated_rows, max(n) AS largest FROM counts GROUP BY 1"""
)
def agg_attribute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.attribute_profile(listings(spark, sf_dir), _PROFILED)


@query(
    rf"""SELECT record_id, breadcrumb, n_levels >= 2 AND repeated AS repeated FROM (
  SELECT record_id, CASE WHEN {_present("ProductCategory")} THEN array_to_string(lv, ' > ') END AS breadcrumb, len(lv) AS n_levels,
         coalesce(len(list_filter(range(1, len(lv) // 2 + 1), lambda k: len(lv) % k = 0 AND len(list_filter(range(1, len(lv) - k + 1), lambda i: lv[i] <> lv[i + k])) = 0)) > 0, false) AS repeated
  FROM (SELECT record_id, ProductCategory, list_filter(list_transform(string_split(coalesce(ProductCategory, ''), '>'), lambda x: {_strip("x")}), lambda x: x <> '') AS lv FROM training_candidate))"""
)
def row_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = cleaning.breadcrumb(F.col("ProductCategory"))
    levels = F.when(F.coalesce(path, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(path, " > "))
    return listings(spark, sf_dir).select("record_id", path.alias("breadcrumb"), cleaning.repeated_path(levels).alias("repeated"))


def _numeric_sql(c: str, count: bool) -> str:
    v = _strip(c)
    more = f" WHEN CAST({v} AS DOUBLE) <> floor(CAST({v} AS DOUBLE)) THEN 'fractional_count'" if count else ""
    return (
        f"CASE WHEN NOT {_present(c)} THEN NULL WHEN regexp_full_match(lower({v}), '[+-]?(inf|infinity|nan)') THEN 'non_finite' "
        f"WHEN NOT regexp_full_match({v}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'non_numeric' WHEN CAST({v} AS DOUBLE) < 0 THEN 'negative'{more} END"
    )


_NUMBERS = (("ProductRating", False), ("ProductReviewsCount", True), ("ReviewsCount", True), ("XRatXRev", False))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT record_id, '{c}' AS field, {_numeric_sql(c, n)} AS error FROM training_candidate" for c, n in _NUMBERS) + ") WHERE error IS NOT NULL")
def row_numeric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), cleaning.numeric_error(F.col(c), n).alias("error")) for c, n in _NUMBERS])).alias("x")
    return listings(spark, sf_dir).select("record_id", each).select("record_id", "x.*").filter("error is not null")


_FLAGS = f"""
flagged AS (
  SELECT record_id, list_sort(list_filter([
    CASE WHEN rating IS NOT NULL THEN 'rating:' || rating END, CASE WHEN reviews IS NOT NULL THEN 'reviews:' || reviews END,
    CASE WHEN regexp_full_match({_strip("Upc")}, '[+-]?[0-9]+(\\.[0-9]+)?[eE][+-]?[0-9]+') THEN 'upc:scientific' END,
    CASE WHEN coalesce(regexp_matches(lower({_strip("MDM_InsertDateTime")}), '^https?://'), false) OR coalesce(regexp_matches(lower({_strip("MDM_Id")}), '^https?://'), false) THEN 'mdm:displaced_url' END,
    CASE WHEN {_present("ProductUrl")} AND NOT regexp_matches(lower({_strip("ProductUrl")}), '^https?://') THEN 'url:syntax' END,
    CASE WHEN NOT {_present("ProductName")} AND NOT {_present("ProductDescription")} AND NOT {_present("ProductBrand")} THEN 'text:missing' END,
    CASE WHEN starts_with(Brand, ' ') OR regexp_matches(Brand, '^[a-z]') THEN 'brand:format' END], lambda x: x IS NOT NULL)) AS flags
  FROM (SELECT *, {_numeric_sql("ProductRating", False)} AS rating, {_numeric_sql("ProductReviewsCount", True)} AS reviews FROM training_candidate)),
settled AS (
  SELECT record_id, flags, CASE WHEN list_contains(flags, 'mdm:displaced_url') OR list_contains(flags, 'text:missing') THEN 'quarantine' WHEN len(flags) > 0 THEN 'review' ELSE 'candidate' END AS status,
         coalesce(array_to_string(flags, ';'), '') AS reasons FROM flagged)
"""


@query(f"WITH {_FLAGS} SELECT record_id, status, reasons FROM settled")
def row_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.disposition(cleaning.row_flags(listings(spark, sf_dir)))


@query(f"WITH {_FLAGS} SELECT flag, status, count(*) AS n FROM (SELECT unnest(flags) AS flag, status FROM settled) GROUP BY ALL")
def agg_flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = cleaning.row_flags(listings(spark, sf_dir))
    rows = cleaning.disposition(flags).filter("reasons <> ''")
    return rows.select("status", F.explode(F.split("reasons", ";")).alias("flag")).groupBy("flag", "status").agg(F.count("*").alias("n"))


@query(
    f"""WITH counts AS (SELECT Brand AS value, count(*) AS n FROM training_candidate WHERE {_present("Brand")} GROUP BY 1),
q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM counts)
SELECT value, n, q1 - 1.5 * (q3 - q1) AS "lower", q3 + 1.5 * (q3 - q1) AS "upper", n < q1 - 1.5 * (q3 - q1) AS rare FROM counts, q"""
)
def agg_iqr_rare_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.iqr_rare(listings(spark, sf_dir), "Brand")


@query(
    f"""WITH r AS (SELECT {_strip("Brand")} AS parent, {_strip("ProductModelNumber")} AS child FROM training_candidate WHERE {_present("Brand")} AND {_present("ProductModelNumber")}),
p AS (SELECT parent, child, count(*) AS n FROM r GROUP BY ALL)
SELECT child, count(*) AS n_parents, max(n) AS most_rows, CAST(sum(n) AS BIGINT) AS child_rows FROM p GROUP BY 1 HAVING count(*) > 1"""
)
def agg_multi_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.parent_child(listings(spark, sf_dir), "Brand", "ProductModelNumber")


@query(
    f"""SELECT {_strip("Retailer")} AS "by", count(*) AS n_rows, round(avg(CASE WHEN {_present("ProductDescription")} THEN 0 ELSE 1 END), 9) AS missing_share,
 round(avg(CASE WHEN {_present("ProductDescription")} THEN length({_strip("ProductDescription")}) END), 6) AS mean_length,
 quantile_cont(CASE WHEN {_present("ProductDescription")} THEN length({_strip("ProductDescription")}) END, 0.5) AS median_length,
 quantile_cont(CASE WHEN {_present("ProductDescription")} THEN length({_strip("ProductDescription")}) END, 0.95) AS p95_length FROM training_candidate GROUP BY 1"""
)
def agg_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.text_profile(listings(spark, sf_dir), "Retailer", "ProductDescription")


@query(f"""SELECT {_strip("JoiningKey")} AS "key", count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM training_candidate WHERE {_present("JoiningKey")} GROUP BY 1 HAVING count(*) > 1""")
def agg_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).filter(present(F.col("JoiningKey"))).select(strip(F.col("JoiningKey")).alias("k"))
    return resolution.exact_key_pairs(rows, "k")


_GTIN = """CASE WHEN regexp_full_match(v, '[0-9]{8}|[0-9]{12,14}') AND NOT regexp_full_match(v, '0+')
  AND list_sum(list_transform(range(1, length(v) + 1), lambda i: CAST(substr(reverse(v), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 THEN lpad(v, 14, '0') END"""


@query(f"SELECT record_id, gtin FROM (SELECT record_id, {_GTIN} AS gtin FROM (SELECT record_id, {_strip('Upc')} AS v FROM training_candidate WHERE regexp_full_match({_strip('Upc')}, '[0-9]+'))) WHERE gtin IS NOT NULL")
def fn_gtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).filter(strip(F.col("Upc")).rlike("^[0-9]+$"))
    return rows.select("record_id", identifiers.gtin(F.col("Upc")).alias("gtin")).filter("gtin is not null")


@query(
    rf"""SELECT record_id, CASE WHEN h <> '' THEN lower(h) || regexp_extract(v, '(?i)^https?://[^/?#\s]+([^#\s]*)', 1) END AS url
FROM (SELECT record_id, {_strip("ProductUrl")} AS v, regexp_extract({_strip("ProductUrl")}, '(?i)^(https?://[^/?#\s]+)', 1) AS h FROM training_candidate)"""
)
def fn_listing_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("record_id", identifiers.listing_url(F.col("ProductUrl")).alias("url"))


@query(
    """SELECT record_id, CAST(('0x' || substr(sha256('roles|' || record_id), 1, 15))::BIGINT % 3 AS INTEGER) AS role,
 round(('0x' || substr(sha256('cohort|' || record_id), 1, 13))::BIGINT / 4503599627370496.0, 12) AS fraction, sha256('rank|' || record_id) AS rank FROM training_candidate"""
)
def fn_hash_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("record_id")
    return listings(spark, sf_dir).select("record_id", identifiers.hash_role("roles", c).alias("role"), F.round(identifiers.hash_fraction("cohort", c), 12).alias("fraction"), identifiers.hash_rank("rank", c).alias("rank"))


@query(
    f"""WITH {_NAMED} SELECT record_id, len(list_distinct(list_transform(range(1, greatest(1, length(name) - 4) + 1), lambda i: substr(name, i, 5)))) AS n_grams,
 len(list_distinct(list_transform(range(1, len(string_split(name, ' ')) - 4 + 1), lambda i: array_to_string(string_split(name, ' ')[i:i+4], ' ')))) AS n_phrases FROM named"""
)
def fn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolution.named(listings(spark, sf_dir))
    return rows.select("record_id", F.size(identifiers.char_ngrams(F.col("name"), 5)).alias("n_grams"), F.size(identifiers.word_ngrams(F.split("name", " "), 5)).alias("n_phrases"))


@query(
    f"""WITH {_PRED}, g AS (SELECT target, count(*) AS n, sum(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS k FROM pred GROUP BY 1)
SELECT target, n, CAST(k AS BIGINT) AS k, round((k / n + 2.705543454095404 / (2 * n) - 1.6448536269514722 * sqrt(k / n * (1 - k / n) / n + 2.705543454095404 / (4 * n * n))) / (1 + 2.705543454095404 / n), 9) AS wilson,
 round(CASE WHEN k > 0 THEN k / n * ln(k / n / 0.9) ELSE 0 END + CASE WHEN k < n THEN (1 - k / n) * ln((1 - k / n) / (1 - 0.9)) ELSE 0 END, 9) AS kl FROM g"""
)
def fn_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    g = rows.groupBy("target").agg(F.count("*").alias("n"), F.sum(evaluation.right(rows)).alias("k"))
    return g.select("target", "n", "k", F.round(identifiers.wilson_lower(F.col("k"), F.col("n")), 9).alias("wilson"), F.round(identifiers.bernoulli_kl(F.col("k") / F.col("n"), F.lit(0.9)), 9).alias("kl"))


@query(
    """SELECT prediction_id, round(pow(confidence, 1 / 1.7) / (pow(confidence, 1 / 1.7) + pow(1 - confidence, 1 / 1.7)), 8) AS p
FROM (SELECT prediction_id, max(confidence) AS confidence FROM target_predictions WHERE confidence IS NOT NULL GROUP BY 1)"""
)
def fn_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "target_predictions").filter("confidence is not null").groupBy("prediction_id").agg(F.max("confidence").alias("c"))
    return rows.select("prediction_id", F.round(F.get(identifiers.tempered(F.array("c", 1 - F.col("c")), 1.7), 0), 8).alias("p"))


@query(f"""WITH {_NAMED} SELECT name AS "key", count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM named GROUP BY 1 HAVING count(*) > 1""")
def jn_exact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.exact_key_pairs(resolution.named(listings(spark, sf_dir)), "name")


@query(f"""WITH {_NAMED}, m AS (SELECT name, min(record_id) AS l FROM named GROUP BY 1) SELECT l AS "left", record_id AS "right" FROM named JOIN m USING (name) WHERE record_id <> l""")
def jn_star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.star_edges(resolution.named(listings(spark, sf_dir)), "name")


@query(
    f"""WITH {_NAMED}, d AS (SELECT DISTINCT name, brand FROM named WHERE brand <> ''), t AS (SELECT name, brand, unnest(list_distinct(string_split(name, ' '))) AS token FROM d),
f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT name, brand, token FROM (SELECT t.*, row_number() OVER (PARTITION BY name, brand ORDER BY df, token) AS k FROM t JOIN f USING (token)) WHERE k <= 2),
p AS (SELECT DISTINCT a.name AS left_name, b.name AS right_name FROM r a JOIN r b ON a.brand = b.brand AND a.token = b.token AND a.name < b.name)
SELECT left_name, right_name, similarity FROM (SELECT *, round(len(list_intersect(list_distinct(string_split(left_name, ' ')), list_distinct(string_split(right_name, ' '))))
  / len(list_distinct(string_split(left_name || ' ' || right_name, ' '))), 9) AS similarity FROM p) WHERE similarity >= 0.6"""
)
def jn_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.blocked_pairs(resolution.named(listings(spark, sf_dir)))


@query(
    f"""WITH {_NAMED}, r AS (SELECT brand, name, row_number() OVER (PARTITION BY brand ORDER BY name) AS k FROM (SELECT DISTINCT brand, name FROM named WHERE brand <> ''))
SELECT a.brand, a.name AS left_name, b.name AS right_name, CAST(b.k - a.k AS INTEGER) AS step FROM r a JOIN r b ON a.brand = b.brand AND b.k - a.k BETWEEN 1 AND 2"""
)
def jn_sorted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.neighbours(resolution.named(listings(spark, sf_dir)), window=2)


@query(
    f"""WITH {_NAMED}, r AS (SELECT brand, name, row_number() OVER (PARTITION BY brand ORDER BY name) AS k FROM (SELECT DISTINCT brand, name FROM named WHERE brand <> ''))
SELECT a.brand, a.name AS left_name, b.name AS right_name, CAST(b.k - a.k AS INTEGER) AS step FROM r a JOIN r b ON a.brand = b.brand AND b.k - a.k BETWEEN 1 AND 12"""
)
def jn_sorted_neighbours_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.neighbours(resolution.named(listings(spark, sf_dir)))


@query(
    f"""WITH {_NAMED}, d AS (SELECT DISTINCT name FROM named), g AS (SELECT name, list_distinct(list_transform(range(1, greatest(1, length(name) - 4) + 1), lambda i: substr(name, i, 5))) AS s FROM d),
e AS (SELECT name, len(s) AS m, unnest(s) AS gram FROM g),
c AS (SELECT a.name AS left_name, b.name AS right_name, count(*) AS common, any_value(a.m) AS lm, any_value(b.m) AS rm FROM e a JOIN e b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2)
SELECT left_name, right_name, similarity FROM (SELECT *, round(common / (lm + rm - common), 9) AS similarity FROM c) WHERE similarity >= 0.85"""
)
def jn_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.set_similarity(resolution.named(listings(spark, sf_dir)))


@query(
    f"""WITH {_NAMED}, d AS (SELECT DISTINCT name FROM named), t AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM d),
f AS (SELECT token, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS w FROM t GROUP BY 1), v AS (SELECT name, token, w FROM t JOIN f USING (token)),
q AS (SELECT name, sqrt(sum(w * w)) AS len FROM v GROUP BY 1),
c AS (SELECT a.name AS left_name, b.name AS right_name, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.token = b.token AND a.name < b.name GROUP BY 1, 2)
SELECT left_name, right_name, similarity FROM (SELECT left_name, right_name, round(dot / (x.len * y.len), 6) AS similarity FROM c JOIN q x ON x.name = left_name JOIN q y ON y.name = right_name) WHERE similarity >= 0.8"""
)
def jn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.cosine_pairs(resolution.named(listings(spark, sf_dir)))


@query(f"""WITH {_NAMED}, {_NOW}, n AS (SELECT name, split, count(*) AS n FROM named JOIN now_rows USING (record_id) WHERE split IS NOT NULL GROUP BY ALL)
SELECT a.split AS split_a, b.split AS split_b, CAST(sum(a.n * b.n) AS BIGINT) AS pairs, count(*) AS keys FROM n a JOIN n b ON a.name = b.name AND a.split < b.split GROUP BY ALL""")
def agg_cross_split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.cross_split_exact(resolution.named(listings(spark, sf_dir)), now(spark, sf_dir), "name")


@query(f"WITH {_EDGES} SELECT * FROM edges")
def gr_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.canonical_edges(table(spark, sf_dir, "match_edges"))


@query(
    f"""WITH {_EDGES}, {_NOW}, j AS (SELECT coalesce(x.split, 'none') AS ls, coalesce(y.split, 'none') AS rs FROM edges LEFT JOIN now_rows x ON x.record_id = "left" LEFT JOIN now_rows y ON y.record_id = "right")
SELECT least(ls, rs) AS left_split, greatest(ls, rs) AS right_split, count(*) AS n_edges FROM j GROUP BY ALL"""
)
def jn_endpoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.endpoint_splits(table(spark, sf_dir, "match_edges"), now(spark, sf_dir))


@query(
    f"""WITH {_EDGES}, {_NOW}, s AS (SELECT "left" AS a, "right" AS b FROM edges UNION ALL SELECT "right", "left" FROM edges)
SELECT a AS record_id, count(DISTINCT b) AS n_train FROM s JOIN now_rows x ON x.record_id = a AND x.split IN ('validation', 'test') JOIN now_rows y ON y.record_id = b AND y.split = 'train' GROUP BY 1"""
)
def jn_train_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.neighbour_counts(table(spark, sf_dir, "match_edges"), now(spark, sf_dir))


@query(f"WITH {_NOW} SELECT record_id, split FROM now_rows WHERE record_id NOT IN (SELECT record_id FROM training_candidate)")
def jn_unknown_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return now(spark, sf_dir).join(listings(spark, sf_dir).select("record_id"), "record_id", "left_anti").select("record_id", "split")


@query(
    f"""WITH {_NOW}, r AS (SELECT n.group_id AS g, {_strip("t.Brand")} AS b FROM now_rows n JOIN training_candidate t USING (record_id) WHERE n.group_id IS NOT NULL AND {_present("t.Brand")}),
two AS (SELECT g, b, count(*) AS n FROM r GROUP BY ALL)
SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY g)) AS together_a, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY b)) AS together_b,
 (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM two) AS together_both"""
)
def agg_partition_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = listings(spark, sf_dir).filter(present(F.col("Brand"))).select("record_id", strip(F.col("Brand")).alias("b"))
    rows = now(spark, sf_dir).filter("group_id is not null").select("record_id", F.col("group_id").alias("g")).join(brands, "record_id")
    return resolution.contingency_pairs(rows, "g", "b")


@query(
    f"""WITH {_NOW}, s AS (SELECT group_id, count(*) AS n FROM now_rows WHERE group_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.99) AS p99, max(n) AS largest FROM s"""
)
def agg_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = now(spark, sf_dir).filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))
    return s.agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_records"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.percentile("n", F.lit(0.99)).alias("p99"), F.max("n").alias("largest"),
    )


@query(
    f"""WITH {_NOW}, r AS (SELECT n.split, {_strip("t.Segment")} AS segment, n.group_id FROM now_rows n JOIN training_candidate t USING (record_id) WHERE n.split IS NOT NULL AND {_present("t.Segment")}),
c AS (SELECT split, segment, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM r GROUP BY ALL)
SELECT split, segment, n, n_groups, round(n / sum(n) OVER (PARTITION BY split), 9) AS split_share, round(n / sum(n) OVER (PARTITION BY segment), 9) AS segment_share FROM c"""
)
def agg_segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = listings(spark, sf_dir).filter(present(F.col("Segment"))).select("record_id", strip(F.col("Segment")).alias("segment"))
    c = now(spark, sf_dir).filter("split is not null").join(seg, "record_id").groupBy("split", "segment").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))
    part = lambda by: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 9)
    return c.select("split", "segment", "n", "n_groups", part("split").alias("split_share"), part("segment").alias("segment_share"))


@query(
    f"""WITH {_NOW}, r AS (SELECT split, t.Retailer AS v FROM now_rows JOIN training_candidate t USING (record_id)), p AS (SELECT v, count(*) / (SELECT count(*) FROM r WHERE split = 'train') AS p FROM r WHERE split = 'train' GROUP BY 1),
q AS (SELECT v, count(*) / (SELECT count(*) FROM r WHERE split = 'test') AS q FROM r WHERE split = 'test' GROUP BY 1),
d AS (SELECT v, round(abs(coalesce(p, 0) - coalesce(q, 0)), 12) AS d FROM p FULL JOIN q USING (v)) SELECT round(sum(d) / 2, 9) AS distance, (SELECT v FROM d ORDER BY d DESC, v LIMIT 1) AS largest FROM d"""
)
def agg_total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = now(spark, sf_dir).join(listings(spark, sf_dir).select("record_id", "Retailer"), "record_id")
    return resolution.total_variation(rows, "split", "Retailer", "train", "test")


@query(f"""SELECT md5(t) AS digest, count(*) AS n, count(DISTINCT retailer) AS n_retailers FROM (
  SELECT lower(trim(Retailer)) AS retailer, trim(regexp_replace(lower(ProductDescription), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM training_candidate) WHERE length(t) >= 200 GROUP BY 1 HAVING count(*) > 1""")
def agg_copied_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.copied_texts(listings(spark, sf_dir), identifiers.name_key(F.col("ProductDescription")))


@query(
    f"""WITH {_PRED} SELECT target, model_version, grouping_id(target, model_version) AS level, count(*) AS n, CAST(sum(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS BIGINT) AS correct
FROM (SELECT target, coalesce(model_version, 'unknown') AS model_version, true_label, predicted_label FROM pred) GROUP BY GROUPING SETS ((target, model_version), (target), (model_version), ())"""
)
def agg_population_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).fillna("unknown", ["model_version"])
    cube = rows.cube("target", "model_version").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(evaluation.right(rows)).alias("correct"))
    return cube.select("target", "model_version", F.col("level").cast("long").alias("level"), "n", "correct")


@query(f"WITH {_PRED}, {_CLASSES} SELECT target, label, CAST(support AS BIGINT) AS support, CAST(emitted AS BIGINT) AS emitted, CAST(correct AS BIGINT) AS correct, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM classes")
def ev_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.class_metrics(predictions(spark, sf_dir), ["target"])
    return m.select("target", "label", "support", "emitted", "correct", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {_PRED}, {_CLASSES} SELECT target, CAST(sum(support) AS BIGINT) AS n_rows, round(sum(correct) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
 round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy FROM classes GROUP BY 1"""
)
def ev_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(predictions(spark, sf_dir), ["target"])


def _bins_sql(at: str) -> str:
    return f"""WITH {_PRED}, g AS (SELECT target, CAST({at} AS INTEGER) AS bin, count(*) AS n, avg(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS a, avg(confidence) AS c FROM pred WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT target, bin, n, round(a, 9) AS accuracy, round(c, 9) AS confidence, round(abs(round(a, 9) - round(c, 9)), 9) AS gap FROM g"""


@query(_bins_sql("greatest(ceil(confidence * 10) - 1, 0)").replace("abs(round(a, 9) - round(c, 9))", "abs(a - c)"))
def ev_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reliability(predictions(spark, sf_dir))


@query(_bins_sql("least(floor(confidence * 10), 9)").replace("abs(round(a, 9) - round(c, 9))", "abs(a - c)"))
def ev_reliability_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reliability(predictions(spark, sf_dir), closed="left")


@query(
    f"""WITH {_PRED}, h AS (SELECT target, CAST(least(floor(confidence * 20), 20) AS INTEGER) AS step, CASE WHEN true_label = predicted_label THEN 0 ELSE 1 END AS e FROM pred WHERE confidence IS NOT NULL),
g AS (SELECT DISTINCT target, s.step FROM h, (SELECT unnest(range(0, 21)) AS step) s)
SELECT g.target, round(g.step / 20, 6) AS threshold, count(h.e) AS accepted, CAST(coalesce(sum(h.e), 0) AS BIGINT) AS errors FROM g LEFT JOIN h ON h.target = g.target AND h.step >= g.step GROUP BY 1, 2"""
)
def ev_selective_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.selective(predictions(spark, sf_dir))


@query()
def ev_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration(predictions(spark, sf_dir))


@query(
    f"""WITH {_PRED}, {_NOW}, g AS (SELECT target, group_id AS g, count(*) AS m, sum(CASE WHEN true_label = predicted_label THEN 0 ELSE 1 END) AS e FROM pred JOIN now_rows USING (record_id) WHERE group_id IS NOT NULL GROUP BY ALL)
SELECT target, count(*) AS n_groups, CAST(sum(m) AS BIGINT) AS n_rows, CAST(sum(m * m) AS BIGINT) AS sum_squares, CAST(sum(e) AS BIGINT) AS errors, round(sum(m) * sum(m) / sum(m * m), 9) AS effective_n FROM g GROUP BY 1"""
)
def ev_design_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(now(spark, sf_dir).filter("group_id is not null").select("record_id", "group_id"), "record_id")
    return evaluation.design_effect(rows, "group_id")


@query(f"""WITH {_PRED}, n AS (SELECT predicted_label AS "key", true_label AS label, count(*) AS n FROM pred WHERE target = 'Segment' GROUP BY ALL)
SELECT "key", label, n, n_key FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY "key") AS BIGINT) AS n_key, row_number() OVER (PARTITION BY "key" ORDER BY n DESC, label) AS k FROM n) WHERE k = 1""")
def agg_majority_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority_by_key(predictions(spark, sf_dir).filter("target = 'Segment'"), "predicted_label", "true_label")


@query(
    f"""WITH r AS (SELECT {_strip("ProductBrand")} AS "key", {_strip("Segment")} AS label FROM training_candidate WHERE {_present("ProductBrand")} AND {_present("Segment")}), n AS (SELECT "key", label, count(*) AS n FROM r GROUP BY ALL)
SELECT "key", label, round((n + l.c / (SELECT count(*) FROM r)) / (k.c + 1), 9) AS p FROM n JOIN (SELECT "key", count(*) AS c FROM r GROUP BY 1) k USING ("key") JOIN (SELECT label, count(*) AS c FROM r GROUP BY 1) l USING (label)"""
)
def agg_smoothed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).filter(present(F.col("ProductBrand")) & present(F.col("Segment"))).select(strip(F.col("ProductBrand")).alias("b"), strip(F.col("Segment")).alias("s"))
    return evaluation.smoothed_lookup(rows, "b", "s")


@query(
    """SELECT prediction_id, reasons <> '' AS review, reasons FROM (SELECT prediction_id, coalesce(array_to_string(list_sort(list_filter([CASE WHEN confidence IS NULL THEN 'confidence_missing' END,
 CASE WHEN confidence < 0.7 THEN 'confidence_low' END, CASE WHEN predicted_label IS NULL THEN 'label_missing' END, CASE WHEN model_version IS NULL THEN 'model_unknown' END,
 CASE WHEN record_id IS NULL THEN 'record_missing' END], lambda x: x IS NOT NULL)), ';'), '') AS reasons FROM target_predictions)"""
)
def dec_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.review_reasons(table(spark, sf_dir, "target_predictions"))


@query(
    f"""WITH allowed AS (SELECT DISTINCT {_strip("Brand")} AS child, {_strip("Mnfr")} AS parent FROM training_candidate WHERE {_present("Brand")} AND {_present("Mnfr")}), {_PRED},
c AS (SELECT record_id, max(predicted_label) AS child FROM pred WHERE target = 'Brand' GROUP BY 1), p AS (SELECT record_id, max(predicted_label) AS parent FROM pred WHERE target = 'Mnfr' GROUP BY 1)
SELECT record_id, c.child, p.parent, CASE WHEN c.child IS NULL OR p.parent IS NULL THEN 'sibling_missing' ELSE 'outside_allowed_pairs' END AS observation FROM c FULL JOIN p USING (record_id)
WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.child = c.child AND a.parent = p.parent)"""
)
def dec_relationship_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = listings(spark, sf_dir).filter(present(F.col("Brand")) & present(F.col("Mnfr"))).select(strip(F.col("Brand")).alias("child"), strip(F.col("Mnfr")).alias("parent")).distinct()
    rows = predictions(spark, sf_dir)
    side = lambda target, name: rows.filter(F.col("target") == target).groupBy("record_id").agg(F.max("predicted_label").alias(name))
    both = side("Brand", "child").join(side("Mnfr", "parent"), "record_id", "full")
    seen = F.when(F.col("child").isNull() | F.col("parent").isNull(), "sibling_missing").otherwise("outside_allowed_pairs")
    return both.join(allowed, ["child", "parent"], "left_anti").select("record_id", "child", "parent", seen.alias("observation"))


@query(f"WITH {_EVENTS} SELECT event_id, target, record_id, action, label, n_deliveries FROM events_once")
def led_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.deliveries(table(spark, sf_dir, "review_events")).select("event_id", "target", "record_id", "action", "label", "n_deliveries")


@query(
    f"""WITH {_EVENTS}, s AS (SELECT target, record_id, coalesce(list_distinct(list(label) FILTER (action = 'correct' AND label IS NOT NULL)), []) AS labels, max(struct_pack(o := occurred_at, e := event_id, a := action)) AS last, count(*) AS n_events
 FROM events_once WHERE record_id IS NOT NULL AND target IS NOT NULL GROUP BY ALL)
SELECT target, record_id, CASE WHEN len(labels) = 1 THEN labels[1] END AS label, CASE WHEN len(labels) > 1 THEN 'conflict' WHEN len(labels) = 1 THEN 'active' ELSE 'audit_only' END AS status, last.a AS last_action, n_events FROM s"""
)
def led_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.snapshot(table(spark, sf_dir, "review_events"))


@query(f"WITH {_EVENTS} SELECT target, group_id, count(DISTINCT label) AS n_labels, count(DISTINCT record_id) AS n_records FROM events_once WHERE action = 'correct' AND label IS NOT NULL AND group_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT label) > 1")
def led_alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.alias_conflicts(table(spark, sf_dir, "review_events"))


@query(
    f"""WITH {_EVENTS}, {_NOW}, r AS (SELECT *, CASE split WHEN 'test' THEN 3 WHEN 'validation' THEN 2 WHEN 'train' THEN 1 ELSE 0 END AS k FROM now_rows),
h AS (SELECT event_id, k FROM events_once e JOIN r ON r.record_id = lower(trim(e.record_id)) UNION ALL SELECT event_id, g.k FROM events_once e JOIN (SELECT group_id, max(k) AS k FROM r GROUP BY 1) g ON g.group_id = lower(trim(e.group_id))),
m AS (SELECT event_id, max(k) AS k FROM h GROUP BY 1)
SELECT event_id, CASE k WHEN 3 THEN 'test' WHEN 2 THEN 'validation' WHEN 1 THEN 'train' ELSE 'unknown' END AS role FROM events_once LEFT JOIN m USING (event_id)"""
)
def led_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.eligibility(table(spark, sf_dir, "review_events"), now(spark, sf_dir))


@query(
    f"""WITH {_EVENTS}, d AS (SELECT *, sha256(concat_ws('|', coalesce(event_id, ''), coalesce(target, ''), coalesce(record_id, ''), coalesce(action, ''), coalesce(label, ''))) AS digest FROM events_once)
SELECT event_id, target, digest, lag(digest) OVER (PARTITION BY target ORDER BY occurred_at NULLS FIRST, event_id) AS previous FROM d"""
)
def led_digest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.event_digests(table(spark, sf_dir, "review_events"))


_CHAINED = ", ".join(
    f"coalesce(length({c}) || ':' || {c}, '-')"
    for c in ["action", "entity_id", "event_id", "flags", "group_id", "label", "model_version", "epoch_us(occurred_at)::varchar", "ontology_version", "epoch_us(received_at)::varchar", "record_id", "source_system", "target"]
)


@query(
    f"""WITH RECURSIVE {_EVENTS}, c AS (SELECT event_id, target, sha256(concat_ws(',', {_CHAINED})) AS content, row_number() OVER (PARTITION BY target ORDER BY received_at NULLS FIRST, event_id) AS seq FROM events_once),
chain AS (SELECT event_id, target, seq, repeat('0', 64) AS previous, sha256('1|' || repeat('0', 64) || '|' || content) AS digest FROM c WHERE seq = 1
  UNION ALL SELECT c.event_id, c.target, c.seq, h.digest, sha256(c.seq || '|' || h.digest || '|' || c.content) FROM chain h JOIN c ON c.target IS NOT DISTINCT FROM h.target AND c.seq = h.seq + 1)
SELECT event_id, target, seq, previous, digest FROM chain"""
)
def led_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.hash_chain(table(spark, sf_dir, "review_events"))


@query("SELECT date_trunc('hour', received_at) AS start, target, action, count(*) AS n FROM review_events WHERE received_at IS NOT NULL GROUP BY ALL")
def st_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.action_counts(table(spark, sf_dir, "review_events"))


@query(
    """SELECT record_id, retailer, k FROM (SELECT record_id, lower(trim(Retailer)) AS retailer, row_number() OVER (PARTITION BY lower(trim(Retailer)) ORDER BY sha256('sample|' || record_id)) AS k
 FROM training_candidate WHERE Retailer IS NOT NULL) WHERE k <= 3"""
)
def srt_sample_per_retailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the three listings of lowest hash rank of each retailer."""
    rows = listings(spark, sf_dir).filter("Retailer is not null").select("record_id", F.lower(F.trim("Retailer")).alias("retailer"), identifiers.hash_rank("sample", F.col("record_id")).alias("h"))
    w = Window.partitionBy("retailer").orderBy("h")
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("record_id", "retailer", "k")


@query(f"WITH {_NOW}, s AS (SELECT group_id, count(*) AS n FROM now_rows WHERE group_id IS NOT NULL GROUP BY 1) SELECT group_id, n FROM s ORDER BY n DESC, group_id LIMIT 25")
def srt_largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 25 largest groups, ties by id."""
    return now(spark, sf_dir).filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(25)


@query(
    f"""WITH {_EDGES}, b AS (SELECT "left" AS record_id, best_score FROM edges UNION ALL SELECT "right", best_score FROM edges)
SELECT record_id, count(*) AS degree, max(best_score) AS best_score FROM b GROUP BY 1"""
)
def gr_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(table(spark, sf_dir, "match_edges"))


@query(
    f"""WITH {_EDGES}, t AS (SELECT x."left" AS a, x."right" AS b, y."right" AS c FROM edges x JOIN edges y ON x."right" = y."left" JOIN edges z ON z."left" = x."left" AND z."right" = y."right"),
v AS (SELECT a AS record_id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) SELECT record_id, count(*) AS n FROM v GROUP BY 1"""
)
def gr_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(table(spark, sf_dir, "match_edges"))


@query(
    f"""WITH {_EDGES}, {_NOW} SELECT CASE WHEN x.group_id IS NULL OR y.group_id IS NULL THEN 'ungrouped' WHEN x.group_id = y.group_id THEN 'within' ELSE 'between' END AS kind, count(*) AS n
FROM edges LEFT JOIN now_rows x ON x.record_id = "left" LEFT JOIN now_rows y ON y.record_id = "right" GROUP BY 1"""
)
def gr_link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_link_types(table(spark, sf_dir, "match_edges"), now(spark, sf_dir))


@query(
    f"""WITH {_NOW}, s AS (SELECT group_id, count(*) AS n FROM now_rows WHERE group_id IS NOT NULL GROUP BY 1), t AS (SELECT CAST(unnest([2, 5, 10, 20]) AS INTEGER) AS threshold)
SELECT threshold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM s JOIN t ON n >= threshold GROUP BY 1"""
)
def gr_size_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_screen(now(spark, sf_dir))


_LABELLED = f"""
lab AS (SELECT n.split, lower({_strip("t.ProductBrand")}) AS k, {_strip("t.Segment")} AS label FROM training_candidate t JOIN now_rows n USING (record_id) WHERE {_present("t.Segment")} AND n.split IS NOT NULL),
rows_ AS (SELECT split, CASE WHEN k NOT IN ('', 'null') THEN k END AS k, label FROM lab),
mem AS (SELECT k, min(label) AS label, count(*) AS n FROM rows_ WHERE split = 'train' AND k IS NOT NULL GROUP BY 1 HAVING min(label) = max(label))
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = listings(spark, sf_dir).filter(present(F.col("Segment"))).select("record_id", key(F.col("ProductBrand")).alias("k"), strip(F.col("Segment")).alias("label"))
    return now(spark, sf_dir).filter("split is not null").select("record_id", "split").join(seg, "record_id")


@query(f"""WITH {_NOW}, {_LABELLED} SELECT k AS "key", label, n FROM mem""")
def jn_key_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return models.key_memory(rows.filter("split = 'train' and k is not null"), "k", "label")


@query(
    f"""WITH {_NOW}, {_LABELLED}, seen AS (SELECT DISTINCT k FROM rows_ WHERE split = 'train' AND k IS NOT NULL)
SELECT CASE WHEN r.k IS NULL THEN 'missing' WHEN s.k IS NOT NULL THEN 'seen' ELSE 'unseen' END AS cohort, count(*) AS n, count(m.label) AS covered, CAST(coalesce(sum(CASE WHEN m.label = r.label THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct
FROM rows_ r LEFT JOIN seen s ON s.k = r.k LEFT JOIN mem m ON m.k = r.k WHERE r.split = 'validation' GROUP BY 1"""
)
def agg_lookup_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    memory = models.key_memory(train.filter("k is not null"), "k", "label")
    marked = models.apply_memory(models.cohorts(train, test, "k"), memory, "k")
    hit = F.coalesce((F.col("remembered") == F.col("label")).cast("long"), F.lit(0))
    return marked.groupBy("cohort").agg(F.count("*").alias("n"), F.count("remembered").alias("covered"), F.sum(hit).alias("correct"))


@query(
    f"""WITH {_NOW}, r AS (SELECT {_strip("t.Segment")} AS label, n.split FROM training_candidate t JOIN now_rows n USING (record_id) WHERE {_present("t.Segment")} AND n.split IN ('train', 'validation'))
SELECT label, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'train') = 0 AS unseen FROM r GROUP BY 1"""
)
def agg_label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).filter("split in ('train', 'validation')")
    of = lambda s: F.sum((F.col("split") == s).cast("long"))
    return rows.groupBy("label").agg(of("train").alias("n_train"), of("validation").alias("n_validation")).withColumn("unseen", F.col("n_train") == 0)


@query(
    f"""WITH {_PRED}, b AS (SELECT target, predicted_label, count(*) AS n, count(DISTINCT record_id) AS n_records, sum(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS k FROM pred GROUP BY ALL)
SELECT target, predicted_label, n, n_records, round(k / n, 9) AS accuracy, CASE WHEN k = n THEN 'error_free' WHEN k / n >= 0.99 THEN 'over_99' ELSE 'below' END AS screen FROM b"""
)
def agg_class_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    b = rows.groupBy("target", "predicted_label").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_records"), F.sum(evaluation.right(rows)).alias("k"))
    screen = F.when(F.col("k") == F.col("n"), "error_free").when(F.col("k") / F.col("n") >= 0.99, "over_99").otherwise("below")
    return b.select("target", "predicted_label", "n", "n_records", F.round(F.col("k") / F.col("n"), 9).alias("accuracy"), screen.alias("screen"))


@query(
    f"""WITH {_PRED}, v AS (SELECT prediction_id, CASE WHEN confidence IS NULL THEN 'confidence_missing' WHEN confidence < 0 OR confidence > 1 THEN 'confidence_range' END AS a,
 CASE WHEN record_id NOT IN (SELECT record_id FROM training_candidate) THEN 'unknown_record' END AS b, CASE WHEN target NOT IN ('Brand', 'Mnfr', 'Segment', 'Sub-Segment', 'TargetAgeGroup', 'Platform', 'Category') THEN 'unknown_target' END AS c FROM pred)
SELECT violation, count(*) AS n FROM (SELECT unnest([a, b, c]) AS violation FROM v) WHERE violation IS NOT NULL GROUP BY 1"""
)
def ev_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = listings(spark, sf_dir).select("record_id").distinct().withColumn("known", F.lit(True))
    rows = predictions(spark, sf_dir).join(known, "record_id", "left")
    wrong = F.array(
        F.when(F.col("confidence").isNull(), "confidence_missing").when(~F.col("confidence").between(0, 1), "confidence_range"), F.when(F.col("known").isNull() & F.col("record_id").isNotNull(), "unknown_record"),
        F.when(~F.col("target").isin("Brand", "Mnfr", "Segment", "Sub-Segment", "TargetAgeGroup", "Platform", "Category"), "unknown_target"),
    )
    return rows.select(F.explode(wrong).alias("violation")).filter("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_PRED}, a AS (SELECT target, record_id, max(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS x FROM pred WHERE model_version = 'tfidf-3' GROUP BY ALL),
b AS (SELECT target, record_id, max(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS y FROM pred WHERE model_version <> 'tfidf-3' GROUP BY ALL)
SELECT target, count(*) AS n, CAST(sum(x) AS BIGINT) AS first_correct, CAST(sum(y) AS BIGINT) AS second_correct, CAST(sum(CASE WHEN x = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM a JOIN b USING (target, record_id) GROUP BY 1"""
)
def ev_paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("model_version is not null")
    side = lambda cond, name: rows.filter(cond).groupBy("target", "record_id").agg(F.max(evaluation.right(rows)).alias(name))
    both = side(F.col("model_version") == "tfidf-3", "x").join(side(F.col("model_version") != "tfidf-3", "y"), ["target", "record_id"])
    lost = ((F.col("x") == 1) & (F.col("y") == 0)).cast("long")
    return both.groupBy("target").agg(F.count("*").alias("n"), F.sum("x").alias("first_correct"), F.sum("y").alias("second_correct"), F.sum(lost).alias("lost"))


@query(
    f"""WITH {_NOW}, r AS (SELECT n.group_id, bool_and(n.split = 'train') AS eligible, count(*) AS n FROM now_rows n WHERE n.group_id IS NOT NULL AND n.split IS NOT NULL GROUP BY 1)
SELECT group_id, n FROM r WHERE eligible AND ('0x' || substr(sha256('reserve|' || group_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.1"""
)
def spl_reserved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of train records only, reserved by a seeded hash fraction of a tenth."""
    g = now(spark, sf_dir).filter("group_id is not null and split is not null").groupBy("group_id").agg(F.bool_and(F.col("split") == "train").alias("eligible"), F.count("*").alias("n"))
    return g.filter(F.col("eligible") & (identifiers.hash_fraction("reserve", F.col("group_id")) < 0.1)).select("group_id", "n")


@query(
    f"""SELECT dataset, source_row, count(*) AS n, count(DISTINCT record_id) AS n_ids FROM training_candidate GROUP BY ALL
HAVING count(*) > 1 OR min(record_id) <> sha256('["' || dataset || '","' || any_value(source_sha256) || '","' || source_row || '"]')"""
)
def ver_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose record_id is not the digest of their provenance, or whose provenance repeats."""
    own = F.sha2(F.to_json(F.array("dataset", "source_sha256", F.col("source_row").cast("string"))), 256)
    g = listings(spark, sf_dir).withColumn("wrong", (F.col("record_id") != own).cast("int")).groupBy("dataset", "source_row").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"), F.max("wrong").alias("wrong"))
    return g.filter("n > 1 or wrong = 1").select("dataset", "source_row", "n", "n_ids")


@query()
def mdl_text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment from names and descriptions: fitted on train, (label, n, correct) on validation."""
    text = listings(spark, sf_dir).filter(present(F.col("Segment"))).select("record_id", F.concat_ws(" ", "ProductName", "ProductDescription").alias("text"), strip(F.col("Segment")).alias("label"))
    rows = now(spark, sf_dir).filter("split is not null").select("record_id", "split").join(text, "record_id")
    out = models.predicted(models.text_classifier(rows.filter("split = 'train'"), "text", "label"), rows.filter("split = 'validation'"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("predicted_label")).cast("long")).alias("correct"))


from shelfwright.plans import audits  # noqa: E402, F401  registers more queries, with the helpers above
