"""Grouping, graph audits, chains and cleaning on small fixtures with nulls, ties, repeats and empty tables."""

import random

from pyspark.sql import functions as F

from shelfwright.functions import identifiers
from shelfwright.operators import cleaning, evaluation, grouping, ledger, resolution
from shelfwright.operators.components import connected_groups


def rid(i):
    return f"{i:064x}"


def edges(spark, *pairs):
    return spark.createDataFrame([(rid(a), rid(b), "r", 0.5) for a, b in pairs], "left_record_id string, right_record_id string, reason string, score double")


def test_components_of_any_shape(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {int(x["record_id"], 16): int(x["group_record_id"], 16) for x in connected_groups(edges(spark, *pairs)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x or any(find(y) == x and y != x for y in parent)}
    assert connected_groups(edges(spark, (1, 1)).limit(0)).count() == 0


def test_graph_audits(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (9, 8), (8, 9), (7, 7))
    assert {(int(x["record_id"], 16), x["n_hops"]) for x in grouping.hops(e).collect()} == {(1, 0), (2, 1), (3, 2), (4, 1), (5, 2), (8, 0), (9, 1)}
    sizes = {int(x["group_id"], 16): tuple(x)[1:] for x in grouping.pair_amplification(e).collect()}
    assert sizes == {1: (5, 5, 10, 5), 8: (2, 1, 1, 0)}
    gone = spark.createDataFrame([(rid(4), rid(5))], "left string, right string")
    assert {tuple(x) for x in grouping.removal_effect(e, gone).collect()} == {("before", 2, 7, 11), ("after", 2, 6, 7)}
    saved = spark.createDataFrame([(rid(1), "a"), (rid(2), "b"), (rid(8), "a"), (rid(3), None)], "record_id string, group_id string")
    assert tuple(grouping.partition_agreement(e, saved).first()) == (2, 1, 2, 1)
    assert grouping.hops(e.limit(0)).count() == 0


def test_hops_of_long_chains_take_no_rounds(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(400)] + [(1000 + 7 * i, 1000 + 7 * (i + 1)) for i in range(5)] + [(r.randrange(2000, 2060), r.randrange(2000, 2060)) for _ in range(70)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for root in sorted(near):
        queue = [] if root in want else [(root, 0)]
        for x, n in queue:
            if x not in want:
                want[x] = (root, n)
                queue += [(y, n + 1) for y in near[x]]
    got = lambda df: {int(x["record_id"], 16): (int(x["root"], 16), x["n_hops"]) for x in df.collect()}
    spark.sparkContext.setJobGroup("hops", "hops")
    try:
        assert got(grouping.hops(edges(spark, *pairs))) == want
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("hops")) < 250  # 400 rounds of several jobs each before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    few = [(a, b) for a, b in pairs if a > 390]
    assert got(grouping.hops(edges(spark, *few), most=6)) == got(grouping.hops(edges(spark, *few)))


def test_rule_groups_and_must_link(spark):
    names = "record_id string, Upc string, ProductUrl string, Retailer string, Sku string, Brand string, ProductModelNumber string, ProductName string"
    rows = [
        ("a", "036000291452", None, "S", "1", "B", "M1", "x"), ("b", "36000291452", "https://H.com/p#top", "S", "2", "B", "null", "y"), ("c", "0036000291452", "HTTPS://h.com/p", "T", "1", None, None, "z"),
        ("d", None, "https://h.com/P", "s ", " 1", "b", "m1", "w"), ("e", None, None, None, None, None, None, None), ("f", "000000000000", "", "null", "9", "", "", "null"), ("g", None, None, "T", None, "", "", "Z!"),
    ]
    df = spark.createDataFrame(rows, names).withColumn("key", F.lit("clash")).withColumn("reason", F.lit(1))
    got = {x["record_id"]: x["group_id"] for x in grouping.rule_groups(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "g": "a", "e": "e", "f": "f"}
    assert grouping.rule_groups(df.limit(0)).count() == 0
    x = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q")], "record_id string, group_id string")
    y = spark.createDataFrame([("2", "u"), ("3", "u"), ("4", "v")], "record_id string, group_id string")
    assert {tuple(r) for r in grouping.must_link(x, y).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("4", "4")}


def test_tampered_chain_is_found(spark):
    rows = [(f"e{i}", "T", "approve", i) for i in range(6)] + [("z", None, "reject", 3)]
    ev = spark.createDataFrame(rows, "event_id string, target string, action string, t int").withColumn("received_at", F.timestamp_seconds("t")).drop("t")
    chain = spark.createDataFrame(ledger.hash_chain(ev).collect(), "event_id string, target string, seq long, previous string, digest string")
    assert ledger.verify_chain(ev, chain).filter("not valid").count() == 0
    changed = ev.withColumn("action", F.when(F.col("event_id") == "e2", "reject").otherwise(F.col("action")))
    assert {r["event_id"] for r in ledger.verify_chain(changed, chain).filter("not valid").collect()} == {"e2", "e3", "e4", "e5"}
    assert {r["event_id"] for r in ledger.verify_chain(ev.filter("event_id <> 'e5'"), chain).filter("not valid").collect()} == {"e5"}
    assert ledger.verify_chain(ev, chain.filter("event_id <> 'e0'")).filter("not valid").count() == 1


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("1", "A > B > A > B"), ("2", "A > A"), ("3", "A>B>C"), ("4", None), ("5", " null ")], "record_id string, c string")
    got = {r["record_id"]: (r["repaired"], r["changed"]) for r in cleaning.collapsed_paths(df, "c").collect()}
    assert got == {"1": ("A > B", True), "2": ("A > A", False), "3": ("A > B > C", False)}
    new, log = cleaning.replaced_labels(df, (("c", "A > A", "A", "x"), ("c", "A", "never", "y")))
    assert {r["c"] for r in new.collect()} == {"A > B > A > B", "A", "A>B>C", None, " null "} and [tuple(r) for r in log.collect()] == [("2", "c", "A > A", "A", "x")]
    assert {tuple(r) for r in cleaning.label_shift(df, new, "c").collect()} >= {("A > A", 1, 0), ("A", 0, 1), ("<missing>", 2, 2)}
    errors = cleaning.input_errors(df.withColumn("k", F.lit("same")), "k", {"c": "c"}).collect()
    assert sorted((r["record_id"], r["error"]) for r in errors if r["error"] != "key_repeated") == [("4", "c_missing"), ("5", "c_missing")] and len(errors) == 7


def test_numeric_functions(spark):
    r = spark.range(1).select(
        identifiers.kl_lower(F.lit(0.9), F.lit(100.0), 0.05).alias("kl"), identifiers.kl_lower(F.lit(1.0), F.lit(50.0), 0.05).alias("one"), identifiers.kl_lower(F.lit(0.0), F.lit(5.0), 0.05).alias("zero"),
        identifiers.containment(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("c"), identifiers.dice(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("d"),
    ).first()
    assert 0.80 < r["kl"] < 0.83 and abs(r["one"] - 0.05 ** (1 / 50)) < 1e-9 and r["zero"] == 0.0 and r["c"] == 1.0 and r["d"] == 0.0


def test_thresholds_and_empty_tables(spark):
    schema = "prediction_id long, record_id string, target string, true_label string, predicted_label string, confidence double"
    rows = [(1, "a", "T", "x", "x", 0.9), (2, "b", "T", "x", "y", 0.9), (3, "c", "T", "y", "y", 0.5), (4, "d", "T", "y", "x", None), (5, "e", "T", "z", "z", 1.0)]
    df = spark.createDataFrame(rows, schema)
    got = {r["per_mille"]: (r["accepted"], r["errors"]) for r in evaluation.threshold_grid(df, 420, 1000).collect()}
    assert len(got) == 581 and got[420] == (4, 1) and got[900] == (3, 1) and got[901] == (1, 0) and got[1000] == (1, 0)
    classes = {r["label"]: (r["support"], r["accepted"], r["coverage"], r["precision"]) for r in evaluation.accepted_classes(df, 0.7).collect()}
    assert classes == {"x": (2, 1, 1.0, 1.0), "y": (2, 1, 0.0, 0.0), "z": (1, 1, 1.0, 1.0)}
    none = df.limit(0)
    assert evaluation.threshold_grid(none, 420, 1000).count() == evaluation.accepted_classes(none, 0.7).count() == evaluation.cohort_accuracy(none, {"x": F.lit(True)}).count() == 0
    assert tuple(resolution.coverage(df, none, "record_id").first()) == (5, 0, 0)
