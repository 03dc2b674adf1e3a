"""Registered queries of the training-data operators and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm import canonical, crosssplit, groups, mixing, mojibake, packing, pieces, products, splits
from shelfwright.session import table

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


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.overlaps(table(spark, sf_dir, "training_candidate"), table(spark, sf_dir, "assignments"))


@query()
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.overlap_classes(table(spark, sf_dir, "training_candidate"), table(spark, sf_dir, "assignments"))


@query()
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, sf_dir, "training_candidate"), table(spark, sf_dir, "assignments"))


def _words_sql(c: str) -> str:
    """The words of canonical.words() as a DuckDB list."""
    bare = f"lower({c})"
    for pattern, to in canonical.DECORATIONS:
        bare = f"regexp_replace({bare}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace(chr(39), chr(39) * 2)}', 'g')"
    quote = lambda s: s.replace("'", "''")
    bare = f"trim(translate({bare}, '{quote(canonical.ACCENTED)}', '{quote(canonical.PLAIN)}'))"
    once = f"(SELECT CASE WHEN len(p) = 2 AND trim(p[2]) <> '' AND (trim(p[1]) = trim(p[2]) OR string_split(trim(p[1]), ' ')[1] = trim(p[2])) THEN trim(p[1]) ELSE v END FROM (SELECT {bare} AS v, string_split({bare}, '/') AS p))"
    full = "CASE regexp_replace(w, '[^a-z0-9]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in canonical.SHORT_FORMS.items()) + " ELSE regexp_replace(w, '[^a-z0-9]', '', 'g') END"
    return f"list_filter(list_transform(regexp_split_to_array({once}, ' +'), lambda w: {full}), lambda w: w <> '')"


_MISSING = "lower(trim({c}, e' \\t\\r\\n')) IN ('', 'null')"


@query(
    f"""
WITH cells AS (SELECT record_id, 'ProductBrand' AS field_name, ProductBrand AS value FROM training_candidate UNION ALL SELECT record_id, 'Brand', Brand FROM training_candidate),
cases AS (SELECT * FROM cells WHERE value IS NOT NULL AND NOT {_MISSING.format(c="value")} AND value NOT IN (SELECT brand_name FROM brand_reference WHERE brand_name IS NOT NULL)),
v AS (SELECT value, {_words_sql("value")} AS w, trim(value) AS t FROM (SELECT DISTINCT value FROM cases)),
keyed AS (SELECT value, coalesce(array_to_string(w, ''), '') AS k, coalesce(array_to_string(list_sort(w), ' '), '') AS s, CASE WHEN regexp_full_match(t, '[A-Z]{{3,6}}') THEN t END AS i FROM v),
names AS (SELECT brand_id, 0 AS old, brand_name AS name FROM brand_reference UNION ALL SELECT brand_id, 1, former_name FROM brand_reference),
n AS (SELECT brand_id, old, {_words_sql("name")} AS w,
        array_to_string(list_transform(regexp_split_to_array(trim(translate(lower(replace(name, '&', 'and')), '{canonical.ACCENTED}', '{canonical.PLAIN.replace("'", "''")}')), ' +'), lambda x: upper(x[1])), '') AS ini
      FROM names WHERE name IS NOT NULL AND NOT {_MISSING.format(c="name")}),
r AS (SELECT DISTINCT brand_id, old, kind, k FROM (
  SELECT brand_id, old, 'full' AS kind, array_to_string(w, '') AS k FROM n WHERE len(w) > 0 UNION ALL SELECT brand_id, old, 'sorted', array_to_string(list_sort(w), ' ') FROM n WHERE len(w) > 1
  UNION ALL SELECT brand_id, old, 'first', w[1] FROM n WHERE len(w) > 1 UNION ALL SELECT brand_id, old, 'initials', ini FROM n WHERE len(w) > 0 AND length(ini) > 2)),
refs AS (SELECT kind, k, min(brand_id) AS brand_id FROM (SELECT *, min(old) OVER (PARTITION BY kind, k) AS oldest FROM r) WHERE old = oldest GROUP BY ALL HAVING count(DISTINCT brand_id) = 1),
hit AS (SELECT value, coalesce(f.brand_id, o.brand_id, w.brand_id, a.brand_id) AS brand_id, q.k FROM keyed q LEFT JOIN refs f ON f.kind = 'full' AND f.k = q.k LEFT JOIN refs o ON o.kind = 'sorted' AND o.k = q.s
  LEFT JOIN refs w ON w.kind = 'first' AND w.k = q.k LEFT JOIN refs a ON a.kind = 'initials' AND a.k = q.i),
near AS (SELECT DISTINCT h.k, x.brand_id, levenshtein(h.k, x.k) AS d FROM hit h JOIN refs x ON h.brand_id IS NULL AND h.k <> '' AND (x.kind = 'full' OR x.kind = 'first' AND length(x.k) >= 6)
  AND abs(length(h.k) - length(x.k)) <= 2 AND levenshtein(h.k, x.k) <= CASE WHEN length(x.k) < 5 THEN 0 WHEN length(x.k) < 10 THEN 1 ELSE 2 END),
best AS (SELECT k, min(brand_id) AS brand_id FROM (SELECT *, min(d) OVER (PARTITION BY k) AS least FROM near) WHERE d = least GROUP BY 1 HAVING count(DISTINCT brand_id) = 1)
SELECT record_id, field_name, CAST(coalesce(h.brand_id, b.brand_id, 0) AS BIGINT) AS brand_id FROM cases JOIN hit h USING (value) LEFT JOIN best b ON b.k = h.k AND h.brand_id IS NULL
"""
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_fields(table(spark, sf_dir, "training_candidate"), table(spark, sf_dir, "brand_reference")).select("record_id", "field_name", "brand_id")


@query()
def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = canonical.map_fields(table(spark, sf_dir, "training_candidate"), table(spark, sf_dir, "brand_reference"))
    return cases.groupBy("field_name", "value", "brand_id", "how").agg(F.count("*").alias("n_rows"))


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_pairs(table(spark, sf_dir, "training_candidate"))


@query()
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.product_groups(table(spark, sf_dir, "training_candidate"))


_CURRENT = r"""
current_rows AS (
  SELECT record_id, max(struct_pack(t := assigned_at, s := split, g := group_id)) AS last FROM (
    SELECT lower(trim(record_id, e' \t\r\n')) AS record_id, assigned_at,
           CASE WHEN lower(trim(group_id, e' \t\r\n')) NOT IN ('', 'null') THEN lower(trim(group_id, e' \t\r\n')) END AS group_id,
           CASE WHEN lower(trim(split, e' \t\r\n')) = 'val' THEN 'validation'
                WHEN lower(trim(split, e' \t\r\n')) NOT IN ('', 'null') THEN lower(trim(split, e' \t\r\n')) END AS split
    FROM assignments)
  WHERE record_id NOT IN ('', 'null') GROUP BY record_id)
"""


@query(f"WITH {_CURRENT} SELECT last.g AS group_id FROM current_rows WHERE last.g IS NOT NULL GROUP BY 1 HAVING count(DISTINCT last.s) > 1")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_groups(table(spark, sf_dir, "assignments"), table(spark, sf_dir, "split_plan"))


@query()
def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.record_splits(table(spark, sf_dir, "assignments"), table(spark, sf_dir, "split_plan"))


@query(f"WITH {_CURRENT} SELECT count(*) AS n_records, count(DISTINCT last.g) AS n_groups, CAST(0 AS BIGINT) AS n_torn_after, (SELECT count(*) FROM split_plan) AS n_splits FROM current_rows")
def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p4_splits: every current record once, and no group in two splits."""
    rows = splits.record_splits(table(spark, sf_dir, "assignments"), table(spark, sf_dir, "split_plan"))
    groups_ = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("k"), F.collect_set("split").alias("s"))
    real = F.col("group_id").isNotNull()
    return groups_.agg(F.sum("n").alias("n_records"), F.count_if(real).alias("n_groups"), F.count_if(real & (F.col("k") > 1)).alias("n_torn_after"), F.size(F.array_distinct(F.flatten(F.collect_list("s")))).cast("long").alias("n_splits"))


@query()
def p4_linked_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that also keep together what match_edges links."""
    return splits.record_splits(table(spark, sf_dir, "assignments"), table(spark, sf_dir, "split_plan"), table(spark, sf_dir, "match_edges"))


@query()
def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "split_plan")
    return splits.reached_shares(splits.record_splits(table(spark, sf_dir, "assignments"), plan), plan)


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_fields(table(spark, sf_dir, "training_candidate")).select("record_id", "field_name")


@query()
def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_fields(table(spark, sf_dir, "training_candidate"))


@query(
    """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
    SELECT lower(trim(left_record_id, e' \\t\\r\\n')) AS a, lower(trim(right_record_id, e' \\t\\r\\n')) AS b FROM match_edges)
  WHERE regexp_full_match(a, '[0-9a-f]{64}') AND regexp_full_match(b, '[0-9a-f]{64}') AND a <> b),
both_ways AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT x AS record_id, x AS seen FROM both_ways UNION SELECT r.record_id, e.y FROM reached r JOIN both_ways e ON e.x = r.seen)
SELECT record_id, min(seen) AS group_record_id FROM reached GROUP BY 1
"""
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.connected_groups(table(spark, sf_dir, "match_edges"))


@query()
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "match_edges")
    return groups.group_links(edges, groups.connected_groups(edges))


_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKENS = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACES}]+'))"


@query()
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = pieces.limit_of(table(spark, sf_dir, "size_limits"), "container")
    return packing.pack(table(spark, sf_dir, "documents"), capacity)


@query(
    rf"""WITH d AS (SELECT doc_id, coalesce({_TOKENS}, 0) AS n FROM documents), c AS (SELECT max_tokens AS cap FROM size_limits WHERE task = 'container')
SELECT CAST(sum(greatest(1, ceil(n / cap))) AS BIGINT) AS n_parts, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_divided_small FROM d, c"""
)
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p8_containers: all tokens once, none overfull, only texts larger than a container divided."""
    capacity, _ = pieces.limit_of(table(spark, sf_dir, "size_limits"), "container")
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity)
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.count_if((F.col("n_parts") > 1) & (F.col("n_tokens") == 0)).alias("d"))
    return bins.agg(F.sum("n").alias("n_parts"), F.sum("t").alias("n_tokens"), F.count_if(F.col("t") > capacity).alias("n_overfull"), F.sum("d").alias("n_divided_small"))


@query()
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = pieces.limit_of(table(spark, sf_dir, "size_limits"), "container")
    return packing.packing_report(packing.pack(table(spark, sf_dir, "documents"), capacity), capacity)


_SOURCE = "CASE WHEN lower(trim(source, e' \\t\\r\\n')) NOT IN ('', 'null') THEN regexp_replace(lower(trim(source, e' \\t\\r\\n')), '[\\s_-]+', '_', 'g') END"
#: The mix in which every source reaches its share: the total is bound by the source that reaches its most first.
_MIX = rf"""
plan AS (SELECT {_SOURCE} AS source, target_share, max_repeats FROM source_mix),
counted AS (SELECT doc_id, source, n_tokens FROM (SELECT doc_id, {_SOURCE} AS source, coalesce({_TOKENS}, 0) AS n_tokens FROM documents) SEMI JOIN plan USING (source) WHERE n_tokens > 0),
have AS (SELECT source, target_share, max_repeats, CAST(coalesce(t, 0) AS BIGINT) AS available_tokens FROM plan LEFT JOIN (SELECT source, sum(n_tokens) AS t FROM counted GROUP BY 1) USING (source)),
free AS (SELECT * FROM have WHERE available_tokens * max_repeats > 0 AND target_share > 0),
give AS (SELECT source, max_repeats, available_tokens AS t, target_share / (SELECT sum(target_share) FROM free) * (SELECT min(available_tokens * max_repeats * (SELECT sum(target_share) FROM free) / target_share) FROM free) AS g FROM free),
cut AS (SELECT source, least(max_repeats, CAST(floor(g / t + 1e-9) AS INTEGER)) AS whole, max_repeats, g, t FROM give),
run AS (SELECT doc_id, c.source, n_tokens, whole, CASE WHEN whole < max_repeats THEN greatest(0, g - whole * t) ELSE 0 END AS fraction,
  sum(n_tokens) OVER (PARTITION BY c.source ORDER BY md5(doc_id || '|mix'), doc_id) AS upto FROM counted c JOIN cut USING (source)),
mixed AS (SELECT doc_id, source, n_tokens, CAST(whole + CASE WHEN upto - n_tokens / 2 <= fraction THEN 1 ELSE 0 END AS INTEGER) AS copies FROM run)
"""


@query(f"WITH {_MIX} SELECT doc_id, source, n_tokens, copies FROM mixed WHERE copies > 0")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))[0]


@query(
    f"""WITH {_MIX}, used AS (SELECT source, count(*) AS n_texts, CAST(sum(n_tokens * copies) AS BIGINT) AS used_tokens, max(copies) AS most_copies FROM mixed WHERE copies > 0 GROUP BY 1)
SELECT source, target_share, max_repeats, available_tokens, coalesce(n_texts, 0) AS n_texts, coalesce(used_tokens, 0) AS used_tokens, coalesce(most_copies, 0) AS most_copies,
 round(coalesce(used_tokens, 0) / (SELECT sum(used_tokens) FROM used), 9) AS share FROM have LEFT JOIN used USING (source)"""
)
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))).withColumn("share", F.round("share", 9))


@query()
def p9_mix_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the planned sources have: small sources are clamped at their repeats, the others make up for them."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"), "corpus")[0]


@query()
def p9_shares_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"), "corpus"))


@query(
    rf"""
SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACES}]+')) > (SELECT max_tokens FROM size_limits WHERE task = 'piece')
"""
)
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "documents"), *pieces.limit_of(table(spark, sf_dir, "size_limits"), "piece"))


@query()
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_texts(table(spark, sf_dir, "documents"), *pieces.limit_of(table(spark, sf_dir, "size_limits"), "piece"))
