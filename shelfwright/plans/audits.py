"""Registered queries of grouping, graph audits, text keys, profiles and selective decisions, with their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwright.functions import identifiers
from shelfwright.functions.python_text import folded_text, sequence_ratio
from shelfwright.functions.text import present, strip
from shelfwright.operators import cleaning, evaluation, grouping, ledger, resolution
from shelfwright.operators.components import connected_groups
from shelfwright.plans.queries import _EDGES, _EVENTS, _FLAGS, _GTIN, _NAMED, _NOW, _PRED, _present, _strip, listings, now, predictions, query
from shelfwright.session import table

_REACHED = """
both_ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT x AS record_id, x AS seen FROM both_ways UNION SELECT r.record_id, e.y FROM reached r JOIN both_ways e ON e.x = r.seen),
comp AS (SELECT record_id, min(seen) AS root FROM reached GROUP BY 1)
"""
_LINKS = """
ends AS (SELECT lower(trim(left_record_id, e' \\t\\r\\n')) AS a, lower(trim(right_record_id, e' \\t\\r\\n')) AS b FROM match_edges),
links AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ends WHERE regexp_full_match(a, '[0-9a-f]{64}') AND regexp_full_match(b, '[0-9a-f]{64}') AND a <> b)
"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "match_edges")


# --- components and grouping ---


@query(f"WITH RECURSIVE {_LINKS}, {_REACHED} SELECT record_id, root AS group_record_id FROM comp")
def grp_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(edges_of(spark, sf_dir))


def _words(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_KEYS = f"""
keyed AS (
  SELECT record_id, 'gtin' AS reason, {_GTIN.replace("v,", "g,").replace("(v)", "(g)").replace("(v,", "(g,").replace("reverse(v)", "reverse(g)")} AS k FROM (SELECT record_id, {_strip("Upc")} AS g FROM training_candidate WHERE regexp_full_match({_strip("Upc")}, '[0-9]+'))
  UNION ALL SELECT record_id, 'listing_url', CASE WHEN h <> '' THEN lower(h) || regexp_extract(v, '(?i)^https?://[^/?#\\s]+([^#\\s]*)', 1) END
    FROM (SELECT record_id, {_strip("ProductUrl")} AS v, regexp_extract({_strip("ProductUrl")}, '(?i)^(https?://[^/?#\\s]+)', 1) AS h FROM training_candidate)
  UNION ALL SELECT record_id, 'retailer_sku', CASE WHEN {_present("Retailer")} AND {_present("Sku")} THEN lower({_strip("Retailer")}) || chr(0) || lower({_strip("Sku")}) END FROM training_candidate
  UNION ALL SELECT record_id, 'brand_model', CASE WHEN {_words("Brand")} <> '' AND {_words("ProductModelNumber")} <> '' AND {_present("ProductModelNumber")} THEN {_words("Brand")} || chr(0) || {_words("ProductModelNumber")} END FROM training_candidate
  UNION ALL SELECT record_id, 'exact_name', CASE WHEN {_present("ProductName")} AND {_words("ProductName")} <> '' THEN {_words("ProductName")} END FROM training_candidate),
stars AS (SELECT reason, first AS "left", record_id AS "right" FROM (SELECT *, min(record_id) OVER (PARTITION BY reason, k) AS first FROM keyed WHERE k IS NOT NULL) WHERE record_id <> first)
"""


@query(f'WITH {_KEYS} SELECT reason, count(*) AS n_edges, count(DISTINCT "left") AS n_keys FROM stars GROUP BY 1')
def jn_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.key_edges(listings(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n_edges"), F.count_distinct("left").alias("n_keys"))


@query(
    f"""WITH RECURSIVE {_KEYS}, links AS (SELECT DISTINCT "left" AS a, "right" AS b FROM stars), {_REACHED}
SELECT t.record_id, coalesce(root, t.record_id) AS group_id FROM (SELECT DISTINCT record_id FROM training_candidate) t LEFT JOIN comp USING (record_id)"""
)
def grp_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.rule_groups(listings(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_NAMED}, {_NOW}, parts AS (SELECT 'g' || group_id AS g, record_id FROM now_rows WHERE group_id IS NOT NULL UNION ALL SELECT 'n' || name, record_id FROM named),
links AS (SELECT DISTINCT first AS a, record_id AS b FROM (SELECT *, min(record_id) OVER (PARTITION BY g) AS first FROM parts) WHERE record_id <> first), {_REACHED}
SELECT p.record_id, coalesce(root, p.record_id) AS group_id FROM (SELECT DISTINCT record_id FROM parts) p LEFT JOIN comp USING (record_id)"""
)
def grp_must_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved groups united with groups of equal names."""
    saved = now(spark, sf_dir).filter("group_id is not null").select("record_id", "group_id")
    return grouping.must_link(saved, resolution.named(listings(spark, sf_dir)).select("record_id", F.col("name").alias("group_id")))


@query(
    f"""WITH RECURSIVE {_NAMED}, d AS (SELECT DISTINCT name FROM named), t AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM d),
f AS (SELECT token, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS w FROM t GROUP BY 1), v AS (SELECT name, token, w FROM t JOIN f USING (token)),
q AS (SELECT name, sqrt(sum(w * w)) AS len FROM v GROUP BY 1), c AS (SELECT a.name AS a, b.name AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.token = b.token AND a.name < b.name GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM c JOIN q x ON x.name = c.a JOIN q y ON y.name = c.b WHERE round(dot / (x.len * y.len), 6) >= 0.88), {_REACHED}
SELECT n.record_id, coalesce(root, name) AS group_name FROM named n LEFT JOIN comp ON comp.record_id = n.name"""
)
def grp_tfidf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose weighted token vectors have a cosine of 0.88 or more, directly or over others; the group has its smallest name."""
    rows = resolution.named(listings(spark, sf_dir))
    groups = connected_groups(resolution.cosine_pairs(rows, 0.88), "left_name", "right_name", pattern="^.").toDF("name", "root")
    return rows.select("record_id", "name").join(groups, "name", "left").select("record_id", F.coalesce("root", "name").alias("group_name"))


# --- graph audits ---


@query(
    f"""WITH RECURSIVE {_LINKS}, {_REACHED}, s AS (SELECT root, count(*) AS n FROM comp GROUP BY 1), l AS (SELECT root, count(*) AS m FROM links JOIN comp ON record_id = a GROUP BY 1)
SELECT root AS group_id, n AS n_records, m AS n_links, n * (n - 1) // 2 AS implied_pairs, n * (n - 1) // 2 - m AS indirect_pairs FROM s JOIN l USING (root)"""
)
def gr_pair_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pair_amplification(edges_of(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_EDGES}, links AS (SELECT "left" AS a, "right" AS b FROM edges), {_REACHED}, kept AS (SELECT "left" AS a, "right" AS b FROM edges WHERE NOT (reasons = 'blocked_fuzzy')),
kw AS (SELECT a AS x, b AS y FROM kept UNION ALL SELECT b, a FROM kept), kr AS (SELECT x AS record_id, x AS seen FROM kw UNION SELECT r.record_id, e.y FROM kr r JOIN kw e ON e.x = r.seen),
kc AS (SELECT record_id, min(seen) AS root FROM kr GROUP BY 1), a AS (SELECT root, count(*) AS n FROM comp GROUP BY 1), b AS (SELECT root, count(*) AS n FROM kc GROUP BY 1)
SELECT 'before' AS state, count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_records, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS implied_pairs FROM a
UNION ALL SELECT 'after', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM b"""
)
def gr_removal_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components without the edges that only fuzzy blocking gives."""
    weak = resolution.canonical_edges(edges_of(spark, sf_dir)).filter("reasons = 'blocked_fuzzy'").select("left", "right")
    return grouping.removal_effect(edges_of(spark, sf_dir), weak)


@query(
    f"""WITH RECURSIVE {_LINKS}, {_REACHED}, {_NOW}, b AS (SELECT root, group_id FROM comp JOIN now_rows USING (record_id) WHERE group_id IS NOT NULL),
x AS (SELECT root, count(DISTINCT group_id) AS k FROM b GROUP BY 1), y AS (SELECT group_id, count(DISTINCT root) AS k FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS n_components, (SELECT count(*) FROM x WHERE k > 1) AS n_spanning_groups, (SELECT count(*) FROM y) AS n_groups, (SELECT count(*) FROM y WHERE k > 1) AS n_split_groups"""
)
def gr_partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.partition_agreement(edges_of(spark, sf_dir), now(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_LINKS}, {_REACHED}, far AS (SELECT DISTINCT root AS record_id, root, 0 AS n FROM comp
  UNION SELECT e.y, f.root, f.n + 1 FROM far f JOIN both_ways e ON e.x = f.record_id WHERE f.n < 60)
SELECT record_id, root, CAST(min(n) AS INTEGER) AS n_hops FROM far GROUP BY ALL"""
)
def gr_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.hops(edges_of(spark, sf_dir))


# --- functions ---


@query(
    f"""SELECT record_id, sha256('rank' || chr(0) || record_id) AS rank, CAST(('0x' || substr(sha256('roles' || chr(0) || record_id), 1, 16))::UBIGINT % 3 AS INTEGER) AS role,
 round(('0x' || substr(sha256('cohort' || chr(0) || record_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 12) AS fraction FROM training_candidate"""
)
def fn_seeded_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("record_id")
    return listings(spark, sf_dir).select("record_id", identifiers.seeded_rank("rank", c).alias("rank"), identifiers.group_role("roles", c).alias("role"), F.round(identifiers.unit_fraction("cohort", c), 12).alias("fraction"))


@query(
    rf"""SELECT record_id, CASE WHEN v IS NULL OR v IN ('', 'null', 'none', 'nan') THEN '' ELSE v END AS raw, replace({_words("Brand")}, ' ', '') AS block,
 CASE WHEN {_present("Retailer")} AND {_present("Sku")} THEN md5(lower({_strip("Retailer")}) || chr(0) || lower({_strip("Sku")})) END AS seller_sku
FROM (SELECT *, trim(regexp_replace(lower(ProductBrand), '\s+', ' ', 'g')) AS v FROM training_candidate)"""
)
def fn_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sku = identifiers.seller_key(F.col("Retailer"), F.col("Sku"))
    return listings(spark, sf_dir).select("record_id", identifiers.raw_key(F.col("ProductBrand")).alias("raw"), identifiers.block_key(F.col("Brand")).alias("block"), F.md5(sku).alias("seller_sku"))


@query(
    f"""WITH {_NAMED}, p AS (SELECT *, list_distinct(string_split(name, ' ')) AS a, list_distinct(string_split(brand, ' ')) AS b FROM named WHERE brand <> '')
SELECT record_id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 9) AS containment, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) AS dice,
 len(list_distinct(list_transform(range(1, greatest(1, length(name)) + 1), lambda i: substr(' ' || name || ' ', i, 3)))) AS n_grams FROM p"""
)
def fn_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the tokens of a listing's name and brand overlap, and its padded trigrams."""
    rows = resolution.named(listings(spark, sf_dir)).filter("brand <> ''")
    a, b = F.array_distinct(F.split("name", " ")), F.array_distinct(F.split("brand", " "))
    return rows.select("record_id", F.round(identifiers.containment(a, b), 9).alias("containment"), F.round(identifiers.dice(a, b), 9).alias("dice"), F.size(identifiers.padded_ngrams(F.col("name"))).alias("n_grams"))


@query(
    f"""WITH {_PRED}, n AS (SELECT target, predicted_label AS label, count(*) AS n FROM pred GROUP BY ALL), p AS (SELECT target, label, n / sum(n) OVER (PARTITION BY target) AS p FROM n)
SELECT target, label, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p DESC, label) AS k FROM p) WHERE k <= 3"""
)
def fn_top_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the three likeliest labels of each target's map of shares."""
    n = predictions(spark, sf_dir).groupBy("target", "predicted_label").agg(F.count("*").alias("n"))
    m = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("target"))).groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("predicted_label", "p"))).alias("m"))  # one entry a class
    return m.select("target", F.explode(identifiers.top_entries(F.col("m"), 3)).alias("e")).select("target", "e.label", F.round("e.p", 9).alias("p"))


# --- rows ---


@query(
    f"""SELECT record_id, CASE WHEN k IS NULL THEN array_to_string(lv, ' > ') ELSE array_to_string(lv[1:k], ' > ') END AS repaired, k IS NOT NULL AS changed FROM (
  SELECT record_id, lv, list_filter(range(2, len(lv) // 2 + 1), lambda k: len(lv) % k = 0 AND len(list_distinct(lv[1:k])) >= 2 AND len(list_filter(range(1, len(lv) - k + 1), lambda i: lv[i] <> lv[i + k])) = 0)[1] AS k
  FROM (SELECT record_id, list_filter(list_transform(string_split(coalesce(ProductCategory, ''), '>'), lambda x: {_strip("x")}), lambda x: x <> '') AS lv FROM training_candidate WHERE {_present("ProductCategory")}))"""
)
def row_collapsed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.collapsed_paths(listings(spark, sf_dir), "ProductCategory")


@query(
    f"""WITH v AS (SELECT unnest(['All others', 'Halden Group']) AS known)
SELECT record_id, {_strip("Mnfr")} AS value FROM training_candidate WHERE {_present("Mnfr")} AND {_strip("Mnfr")} NOT IN (SELECT known FROM v)"""
)
def row_outside_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("All others",), ("Halden Group",)], "value string")
    return cleaning.outside_vocabulary(listings(spark, sf_dir), "Mnfr", known)


_RULES = (("TargetAgeGroup", "adult", "Adult", "age-case"), ("TargetAgeGroup", "kids", "Kids", "age-case"), ("TargetAgeGroup", "senior", "Senior", "age-case"), ("Exclude", "Exclude", "exclude", "flag-case"))


@query(" UNION ALL ".join(f"""SELECT record_id, '{c}' AS field, "{c}" AS before, '{new}' AS after, '{rule}' AS rule FROM training_candidate WHERE "{c}" = '{old}'""" for c, old, new, rule in _RULES))
def row_label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.replaced_labels(listings(spark, sf_dir), _RULES)[1]


_MODEL_FIELDS = ("ProductName", "ProductBrand", "ProductDescription")


@query(
    "SELECT record_id, concat_ws(' ', "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL AND lower(trim({c}, e' \\t\\r\\n')) NOT IN ('', 'null', 'none', 'nan') THEN '[{c}] ' || trim(substr(trim(regexp_replace(regexp_replace({c}, '<[^<>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 400)) END" for c in _MODEL_FIELDS)
    + ") AS text FROM training_candidate"
)
def row_model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for models; 400 characters a field is the operator's parameter."""
    return listings(spark, sf_dir).select("record_id", cleaning.model_text(_MODEL_FIELDS, 400).alias("text"))


@query(
    f"""WITH {_NOW}, s AS (SELECT group_id, count(*) AS n FROM now_rows WHERE group_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_records FROM s GROUP BY 1"""
)
def row_size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = now(spark, sf_dir).filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"))
    return s.groupBy(cleaning.size_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_records"))


@query(
    f"""SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT {_present("JoiningKey")} THEN 'key_missing' WHEN n > 1 THEN 'key_repeated' END, CASE WHEN NOT {_present("ProductName")} THEN 'name_missing' END,
  CASE WHEN NOT {_present("ProductDescription")} THEN 'description_missing' END]) AS error FROM (SELECT *, count(*) OVER (PARTITION BY {_strip("JoiningKey")}) AS n FROM training_candidate)) WHERE error IS NOT NULL GROUP BY 1"""
)
def row_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = cleaning.input_errors(listings(spark, sf_dir), "JoiningKey", {"name": "ProductName", "description": "ProductDescription"})
    return errors.groupBy("error").agg(F.count("*").alias("n"))


# --- profiles ---


@query(
    f"""WITH {_NOW}, r AS (SELECT coalesce(n.split, 'none') AS split, t.* FROM training_candidate t LEFT JOIN now_rows n USING (record_id))
"""
    + " UNION ALL ".join(f"SELECT split, '{c}' AS field, count(*) AS n, CAST(sum(CASE WHEN {_present(c)} THEN 0 ELSE 1 END) AS BIGINT) AS n_missing, round(avg(CASE WHEN {_present(c)} THEN 0 ELSE 1 END), 9) AS share FROM r GROUP BY 1" for c in ("ProductName", "ProductBrand", "ProductDescription", "ProductContents", "Upc"))
)
def agg_missing_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).join(now(spark, sf_dir).select("record_id", "split"), "record_id", "left").withColumn("split", F.coalesce("split", F.lit("none")))
    return cleaning.missing_by(rows, "split", ["ProductName", "ProductBrand", "ProductDescription", "ProductContents", "Upc"])


@query(
    f"""WITH b AS (SELECT CASE WHEN {_present("TargetAgeGroup")} THEN TargetAgeGroup ELSE '<missing>' END AS x FROM training_candidate),
a AS (SELECT CASE x WHEN 'adult' THEN 'Adult' WHEN 'kids' THEN 'Kids' WHEN 'senior' THEN 'Senior' ELSE x END AS y FROM b)
SELECT label, coalesce(n, 0) AS n_before, coalesce(m, 0) AS n_after FROM (SELECT x AS label, count(*) AS n FROM b GROUP BY 1) FULL JOIN (SELECT y AS label, count(*) AS m FROM a GROUP BY 1) USING (label)"""
)
def agg_label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = listings(spark, sf_dir)
    return cleaning.label_shift(before, cleaning.replaced_labels(before, _RULES)[0], "TargetAgeGroup")


@query(
    f"""WITH {_NOW}, r AS (SELECT {_strip("t.ProductBrand")} AS "key", n.group_id, {_strip("t.Segment")} AS label FROM training_candidate t JOIN now_rows n USING (record_id)
 WHERE n.split = 'train' AND n.group_id IS NOT NULL AND {_present("t.ProductBrand")} AND {_present("t.Segment")})
SELECT "key", count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT label) = 1 AS unambiguous FROM r GROUP BY 1"""
)
def agg_key_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = listings(spark, sf_dir).filter(present(F.col("ProductBrand")) & present(F.col("Segment"))).select("record_id", strip(F.col("ProductBrand")).alias("key"), strip(F.col("Segment")).alias("label"))
    rows = now(spark, sf_dir).filter("split = 'train' and group_id is not null").select("record_id", "group_id").join(text, "record_id")
    return rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"), (F.min("label") == F.max("label")).alias("unambiguous"))


@query(
    f"""WITH {_NOW}, r AS (SELECT n.split, {_strip("t.Segment")} AS label, n.group_id FROM training_candidate t JOIN now_rows n USING (record_id) WHERE n.group_id IS NOT NULL AND n.split IS NOT NULL AND {_present("t.Segment")})
SELECT label, count(*) AS n, count(DISTINCT group_id) AS n_groups, count(DISTINCT group_id) = 1 AS pinned, count(DISTINCT split) AS n_splits FROM r GROUP BY 1"""
)
def agg_class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = listings(spark, sf_dir).filter(present(F.col("Segment"))).select("record_id", strip(F.col("Segment")).alias("label"))
    rows = now(spark, sf_dir).filter("split is not null and group_id is not null").join(text, "record_id")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), (F.count_distinct("group_id") == 1).alias("pinned"), F.count_distinct("split").alias("n_splits"))


@query(
    f"""WITH f AS (SELECT record_id, coalesce(nullif(concat_ws('+', CASE WHEN {_present("ProductUrl")} AND NOT regexp_matches(lower({_strip("ProductUrl")}), '^https?://') THEN 'feature' END,
  CASE WHEN starts_with(Brand, ' ') OR regexp_matches(Brand, '^[a-z]') THEN 'target' END, CASE WHEN coalesce(regexp_matches(lower({_strip("MDM_Id")}), '^https?://'), false) THEN 'structural' END), ''), 'none') AS signature FROM training_candidate)
SELECT signature, count(*) AS n FROM f GROUP BY 1"""
)
def agg_overlap_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How findings of three kinds overlap in rows."""
    kinds = {
        "feature": present(F.col("ProductUrl")) & ~cleaning.looks_like_url(F.col("ProductUrl")), "target": F.col("Brand").startswith(" ") | F.col("Brand").rlike("^[a-z]"), "structural": cleaning.looks_like_url(F.col("MDM_Id")),
    }
    return cleaning.overlap_signature(listings(spark, sf_dir), kinds).groupBy("signature").agg(F.count("*").alias("n"))


# --- evaluation ---


@query(
    f"""WITH {_PRED}, h AS (SELECT target, CAST(floor(round(confidence * 1000)) AS INTEGER) AS at, CASE WHEN true_label = predicted_label THEN 0 ELSE 1 END AS e FROM pred WHERE confidence IS NOT NULL),
g AS (SELECT DISTINCT target, s.step FROM h, (SELECT unnest(range(0, 581)) AS step) s)
SELECT g.target, CAST(420 + g.step AS INTEGER) AS per_mille, count(h.e) AS accepted, CAST(coalesce(sum(h.e), 0) AS BIGINT) AS errors FROM g LEFT JOIN h ON h.target = g.target AND h.at >= 420 + g.step GROUP BY 1, 2"""
)
def ev_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_grid(predictions(spark, sf_dir), 420, 1000)


@query(
    f"""WITH {_PRED}, {_NOW}, g AS (SELECT target, group_id, count(*) AS m, sum(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS k FROM pred JOIN now_rows USING (record_id) WHERE group_id IS NOT NULL GROUP BY ALL),
t AS (SELECT target, sum(m) AS n, sum(k) / sum(m) AS p, sum(m) * sum(m) / sum(m * m) AS e FROM g GROUP BY 1),
w AS (SELECT *, list_reduce(list_prepend({{'low': 0.0::DOUBLE, 'high': p}}, list_transform(range(60), lambda i: {{'low': 0.0::DOUBLE, 'high': p}})), lambda acc, x: CASE WHEN
  e * (CASE WHEN p > 0 THEN p * ln(p / greatest((acc.low + acc.high) / 2, 1e-300)) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * ln((1 - p) / (1 - (acc.low + acc.high) / 2)) ELSE 0 END) > -ln(0.05)
  THEN {{'low': (acc.low + acc.high) / 2, 'high': acc.high}} ELSE {{'low': acc.low, 'high': (acc.low + acc.high) / 2}} END) AS b FROM t)
SELECT target, CAST(n AS BIGINT) AS n_rows, round(e, 6) AS effective_n, round((p + 2.705543454095404 / (2 * e) - 1.6448536269514722 * sqrt(p * (1 - p) / e + 2.705543454095404 / (4 * e * e))) / (1 + 2.705543454095404 / e), 8) AS wilson,
 round(b.high, 8) AS kl FROM w"""
)
def ev_clustered_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(now(spark, sf_dir).filter("group_id is not null").select("record_id", "group_id"), "record_id")
    return evaluation.clustered_bounds(rows, "group_id")


@query(
    f"""WITH {_PRED}, c AS (SELECT target, label, count(*) FILTER (label = true_label) AS support, count(*) FILTER (label = true_label AND confidence >= 0.7) AS accepted_support,
  count(*) FILTER (label = predicted_label AND confidence >= 0.7) AS accepted, count(*) FILTER (label = predicted_label AND true_label = predicted_label AND confidence >= 0.7) AS correct
 FROM (SELECT target, true_label, predicted_label, confidence, unnest(list_distinct([true_label, predicted_label])) AS label FROM pred) GROUP BY ALL)
SELECT target, label, support, accepted, round(CASE WHEN support > 0 THEN accepted_support / support END, 9) AS coverage, round(CASE WHEN accepted > 0 THEN correct / accepted END, 9) AS precision FROM c"""
)
def ev_accepted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accepted_classes(predictions(spark, sf_dir), 0.7)


@query(
    f"""WITH {_PRED}, {_NOW}, r AS (SELECT p.*, [CASE WHEN n.split IS NULL THEN 'unassigned' END, CASE WHEN n.split = 'test' THEN 'test' END, CASE WHEN p.confidence IS NULL THEN 'no_confidence' END, CASE WHEN p.confidence < 0.5 THEN 'low_confidence' END] AS c
 FROM pred p LEFT JOIN now_rows n USING (record_id)) SELECT cohort, count(*) AS n, round(avg(ok), 9) AS accuracy FROM (SELECT unnest(c) AS cohort, CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS ok FROM r) WHERE cohort IS NOT NULL GROUP BY 1"""
)
def ev_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(now(spark, sf_dir).select("record_id", "split"), "record_id", "left")
    return evaluation.cohort_accuracy(rows, {"unassigned": F.col("split").isNull(), "test": F.col("split") == "test", "no_confidence": F.col("confidence").isNull(), "low_confidence": F.col("confidence") < 0.5})


@query(
    f"""WITH {_PRED}, s AS (SELECT target, model_version AS model, count(*) AS n, avg(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS a FROM pred WHERE model_version IN ('tfidf-3', 'minilm-1') GROUP BY ALL)
SELECT target, b.n AS n_before, c.n AS n_after, round(b.a, 9) AS before, round(c.a, 9) AS after, round(c.a - b.a, 9) AS delta FROM (SELECT * FROM s WHERE model = 'tfidf-3') b FULL JOIN (SELECT * FROM s WHERE model = 'minilm-1') c USING (target)"""
)
def ev_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return evaluation.accuracy_deltas(rows.filter("model_version = 'tfidf-3'"), rows.filter("model_version = 'minilm-1'"))


@query(
    f"""WITH {_PRED}, {_NOW}, k AS (SELECT target, true_label AS label, count(*) AS n FROM pred JOIN now_rows USING (record_id) WHERE split = 'train' GROUP BY ALL),
m AS (SELECT target, min(label) AS label FROM (SELECT *, max(n) OVER (PARTITION BY target) AS most FROM k) WHERE n = most GROUP BY 1)
SELECT target, m.label, count(*) AS n, CAST(sum(CASE WHEN p.true_label = m.label THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM pred p JOIN now_rows USING (record_id) JOIN m USING (target) WHERE split <> 'train' GROUP BY ALL"""
)
def agg_majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(now(spark, sf_dir).select("record_id", "split"), "record_id")
    return evaluation.majority_baseline(rows.filter("split = 'train'"), rows.filter("split <> 'train'"))


# --- joins, rankings, ledger and reconciliation ---


@query(
    f"""WITH {_NAMED}, d AS (SELECT DISTINCT name FROM named), t AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM d),
f AS (SELECT token, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS w FROM t GROUP BY 1), v AS (SELECT name, token, w FROM t JOIN f USING (token)), q AS (SELECT name, sqrt(sum(w * w)) AS len FROM v GROUP BY 1),
c AS (SELECT a.name AS a, b.name AS b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.token = b.token AND a.name < b.name GROUP BY 1, 2),
s AS (SELECT c.a, c.b, round(dot / (x.len * y.len), 6) AS sim FROM c JOIN q x ON x.name = c.a JOIN q y ON y.name = c.b), z AS (SELECT a, b, sim FROM s WHERE sim >= 0.8 UNION ALL SELECT b, a, sim FROM s WHERE sim >= 0.8)
SELECT a AS name, b AS neighbour, sim AS similarity, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM z) WHERE k <= 3"""
)
def win_top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: of each name the three most similar ones of at least 0.8, ties by name."""
    return resolution.top_neighbours(resolution.cosine_pairs(resolution.named(listings(spark, sf_dir))), 3)


@query(
    f"""WITH {_EDGES}, {_NOW}, o AS (SELECT CASE WHEN x.split = 'train' THEN "left" ELSE "right" END AS train_id, CASE WHEN x.split = 'train' THEN "right" ELSE "left" END AS other_id, CASE WHEN x.split = 'train' THEN y.split ELSE x.split END AS other_split
 FROM edges JOIN now_rows x ON x.record_id = "left" JOIN now_rows y ON y.record_id = "right" WHERE (x.split = 'train') <> (y.split = 'train')) SELECT DISTINCT * FROM o"""
)
def jn_oriented_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.oriented_crossings(edges_of(spark, sf_dir), now(spark, sf_dir))


@query(
    f"""WITH {_NOW} SELECT (SELECT count(*) FROM now_rows WHERE record_id NOT IN (SELECT record_id FROM training_candidate)) AS only_first,
 (SELECT count(*) FROM training_candidate WHERE record_id NOT IN (SELECT record_id FROM now_rows)) AS only_second, (SELECT count(*) FROM now_rows WHERE record_id IN (SELECT record_id FROM training_candidate)) AS both"""
)
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.coverage(now(spark, sf_dir), listings(spark, sf_dir), "record_id")


@query(
    f"""WITH {_FLAGS} SELECT (SELECT count(*) FROM training_candidate) AS n_rows, (SELECT count(DISTINCT record_id) FROM training_candidate) AS n_ids, CAST(0 AS BIGINT) AS n_in_several, CAST(0 AS BIGINT) AS n_in_none,
 count(DISTINCT status) AS n_parts FROM settled"""
)
def ver_disposition_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing must be in exactly one of the three dispositions."""
    rows = cleaning.disposition(cleaning.row_flags(listings(spark, sf_dir)))
    return resolution.partition_check(listings(spark, sf_dir), rows, "record_id", "status")


@query(f"WITH {_EVENTS} SELECT target, count(*) AS n_events, CAST(0 AS BIGINT) AS n_broken FROM events_once GROUP BY 1")
def led_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain of the events, checked against the events."""
    events = table(spark, sf_dir, "review_events")
    return ledger.verify_chain(events, ledger.hash_chain(events)).groupBy("target").agg(F.count("*").alias("n_events"), F.count_if(~F.col("valid")).alias("n_broken"))


@query(
    f"""WITH {_EVENTS}, x AS (SELECT target, lower(trim(record_id)) AS record_id, count(DISTINCT label) FILTER (action = 'correct') AS labels, max(action = 'reject') AS rejected, max(coalesce(list_contains(string_split(flags, ';'), 'second_look'), false)) AS held, count(*) AS n
 FROM events_once WHERE target IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL)
SELECT target, CASE WHEN labels > 1 THEN 'label_conflict' WHEN labels = 1 AND rejected THEN 'corrected_and_rejected' WHEN held THEN 'held' WHEN labels = 1 THEN 'corrected' WHEN rejected THEN 'rejected' ELSE 'approved' END AS state, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_events FROM x GROUP BY ALL"""
)
def led_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.states(table(spark, sf_dir, "review_events")).groupBy("target", "state").agg(F.count("*").alias("n_records"), F.sum("n_events").alias("n_events"))


@query()
def ev_group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).join(now(spark, sf_dir).filter("group_id is not null").select("record_id", "group_id"), "record_id")
    return evaluation.group_bootstrap(rows, "group_id")


@query()
def ev_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fitted_temperature(predictions(spark, sf_dir))


@query()
def fn_folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("record_id", folded_text("ProductName").alias("text"))


@query()
def fn_sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of neighbouring names of a brand."""
    pairs = resolution.neighbours(resolution.named(listings(spark, sf_dir)), window=1)
    return pairs.select("brand", "left_name", "right_name", F.round(sequence_ratio("left_name", "right_name"), 9).alias("ratio"))
