"""Graph audits against brute force; memory, cohorts and joins on empty and repeated rows."""

import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from shelfwright.operators import evaluation, graph, ledger, models, resolution


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return len({find(n) for n in nodes})


def test_cuts_equal_brute_force():
    r = random.Random(3)
    for _ in range(25):
        edges = sorted({tuple(sorted(r.sample("abcdefgh", 2))) for _ in range(r.randrange(3, 12))})
        nodes = sorted({x for e in edges for x in e})
        bridges, cut = graph.cuts_of(pd.DataFrame(edges, columns=["left", "right"]))
        base = components(edges, nodes)
        assert bridges == {e for e in edges if components([x for x in edges if x != e], nodes) > base}
        assert cut == {n for n in nodes if components([e for e in edges if n not in e], [x for x in nodes if x != n]) > base}


def test_set_similarity_equals_brute_force(spark):
    r = random.Random(7)
    names = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6)) for _ in range(120)]
    names += [n[:-1] for n in names[:40]] + names[:10] + ["é", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def grams(s):
        return {s[i : i + 5] for i in range(max(1, len(s) - 4))}

    want = {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.85}
    assert {(x["left_name"], x["right_name"]) for x in resolution.set_similarity(df).collect()} == want
    assert resolution.set_similarity(df.limit(0)).count() == 0


def moved(spark, run):
    """What run() gives, and the bytes that it shuffles and writes to the shared folder."""
    import pathlib
    import time

    from shelfwright import session

    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    known, before = set(session._made.get(spark.sparkContext.applicationId, [])), store()
    out = run()
    time.sleep(1)
    spark.range(1).count()  # the store is brought up to date with the next task
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    tables = [pathlib.Path(p.removeprefix("file://")) for p in session._made[spark.sparkContext.applicationId] if p not in known]
    return out, store() - before + sum(f.stat().st_size for t in tables for f in t.glob("*.parquet"))


def test_set_similarity_writes_no_sets(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 11))) for _ in range(300)]
    names = [" ".join(r.choice(words) for _ in range(10)) for _ in range(3000)]
    names += [n[:-1] for n in names[:50]]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4).cache()
    df.count()
    got, size = moved(spark, lambda: {(x["left_name"], x["right_name"]) for x in resolution.set_similarity(df).collect()})
    assert {(n[:-1], n) for n in names[:50]} <= got
    assert size < 15 * sum(map(len, names))  # bytes: neither the grams of all names are shuffled nor their sets kept
    df.unpersist()


def test_blocked_pairs_equal_brute_force_and_few_leave_their_block(spark, monkeypatch):
    r = random.Random(12)
    words = [f"w{i}" for i in range(14)]
    names = sorted({" ".join(r.sample(words, r.choice([1, 2, 6, 7]))) for _ in range(700)})
    rows = [(n, b) for n in names for b in (["b", "c"] if r.random() < 0.1 else ["b"])] + [("w1 w1", "b"), ("w1 w2 w3", "")]
    df = spark.createDataFrame(rows, "name string, brand string").repartition(4).cache()
    df.count()
    branded = sorted({x for x in rows if x[1]})
    count = {}
    for n, _ in branded:
        for t in set(n.split()):
            count[t] = count.get(t, 0) + 1
    rare = {n: set(sorted(set(n.split()), key=lambda t: (count[t], t))[:2]) for n, _ in branded}
    want = set()
    for (a, x), (b, y) in itertools.combinations(branded, 2):
        s, t = set(a.split()), set(b.split())
        if x == y and a != b and rare[a] & rare[b] and len(s & t) / len(s | t) >= 0.6:
            want.add((min(a, b), max(a, b)))
    got, size = moved(spark, lambda: resolution.blocked_pairs(df).collect())
    assert {(x["left_name"], x["right_name"]) for x in got} == want and len(got) == len(want)
    assert size < 250_000  # 501,412 bytes when all pairs of a block left it with their tokens
    monkeypatch.setattr(resolution, "FREQUENT", 5)  # most tokens are counted one by one
    assert {(x["left_name"], x["right_name"]) for x in resolution.blocked_pairs(df).collect()} == want
    assert resolution.blocked_pairs(df.limit(0)).count() == 0
    df.unpersist()


def test_previous_rows_across_ranges(spark):
    from shelfwright.operators.ordered import with_previous

    r = random.Random(1)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", i, f"v{i}") for i in range(400)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {x["i"]: x["previous"] for x in with_previous(spark.createDataFrame(rows, "k string, i int, v string"), ["k"], ["i"], "v", "previous").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last, want = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        want[i], last[k] = last.get(k), v
    assert got == want


def test_neighbours_reach_twelve_names_over_ranges(spark):
    rows = [(f"n{i:04d}", "big") for i in range(300)] + [(f"m{i}", f"b{i // 5}") for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(tuple(x) for x in resolution.neighbours(spark.createDataFrame(rows, "name string, brand string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = {}
    for n, b in sorted(rows):
        by.setdefault(b, []).append(n)
    assert got == sorted((b, x[i], x[i + s], s) for b, x in by.items() for i in range(len(x)) for s in range(1, 13) if i + s < len(x))


def test_memory_and_cohorts(spark):
    train = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z")], "k string, label string")
    memory = models.key_memory(train.filter("k is not null"), "k", "label")
    assert [tuple(x) for x in memory.collect()] == [("a", "x", 2)]
    test = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = {x["k"]: (x["cohort"], x["remembered"]) for x in models.apply_memory(models.cohorts(train, test, "k"), memory, "k").collect()}
    assert got == {"a": ("seen", "x"), "b": ("seen", None), "c": ("unseen", None), None: ("missing", None)}


def test_hash_chain_tells_every_change(spark):
    rows = [(f"e{i}", "t" if i % 2 else None, f"r{i}", "correct", "x", f"flag{i}", i) for i in range(10)]

    def digests(rows):
        df = spark.createDataFrame(rows, "event_id string, target string, record_id string, action string, label string, flags string, t int")
        got = ledger.hash_chain(df.select("*", F.timestamp_seconds("t").alias("occurred_at"), F.timestamp_seconds("t").alias("received_at")).drop("t")).collect()
        assert all(x["previous"] == "0" * 64 for x in got if x["seq"] == 1) and {x["previous"] for x in got if x["seq"] > 1} <= {x["digest"] for x in got}
        return {x["event_id"]: x["digest"] for x in got}

    was = digests(rows)
    for changed in (rows[:3] + [(*rows[3][:5], "other", 3)] + rows[4:], rows[:3] + rows[4:], rows[:3] + [(*rows[3][:6], 4)] + rows[4:]):
        now = digests(changed)
        assert {e for e in now if now[e] != was[e]} == {"e3", "e5", "e7", "e9"} & set(now)
    assert digests(rows[::-1] + rows[:2]) == was and digests([]) == {}


def test_empty_tables(spark):
    pred = spark.createDataFrame([], "prediction_id long, record_id string, target string, true_label string, predicted_label string, confidence double, model_version string, predicted_at timestamp")
    rows = evaluation.labelled(pred)
    for df in (evaluation.summary(rows, ["target"]), evaluation.reliability(rows), evaluation.calibration(rows), evaluation.selective(rows), evaluation.review_reasons(pred)):
        assert df.count() == 0
    edges = spark.createDataFrame([], "left_record_id string, right_record_id string, reason string, score double")
    assert graph.triangles(edges).count() == 0 and resolution.canonical_edges(edges).count() == 0
    events = spark.createDataFrame([], "event_id string, target string, record_id string, group_id string, action string, label string, occurred_at timestamp, received_at timestamp")
    assert ledger.snapshot(events).count() == 0 and ledger.event_digests(events.withColumn("x", F.lit(1))).count() == 0
