"""Training-data operators against brute force, round trips and edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwright.llm import canonical, crosssplit, groups, mixing, mojibake, packing, pieces, products, splits
from shelfwright.session import bounded, materialize


def rid(i):
    return f"{i:064x}"


# --- 6: groups ---


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_groups_equal_union_find(spark):
    r = random.Random(5)
    edges = [(rid(i), rid(i + 1)) for i in range(0, 40)]  # a chain
    edges += [(rid(100), rid(i)) for i in range(101, 160)]  # a star
    edges += [(rid(r.randrange(200, 300)), rid(r.randrange(200, 300))) for _ in range(60)]
    dirty = [(a.upper() + " ", b) for a, b in edges[:20]] + [(b, a) for a, b in edges[20:]] + edges[:5] + [(rid(900), rid(900)), (None, rid(1)), ("x", rid(2)), (rid(901), "null")]
    df = spark.createDataFrame(dirty, "left_record_id string, right_record_id string").withColumn("id", F.lit(1)).withColumn("x", F.lit("clash"))
    got = {x["record_id"]: x["group_record_id"] for x in groups.connected_groups(df).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert groups.connected_groups(spark.createDataFrame([], "left_record_id string, right_record_id string")).count() == 0


# --- 4: splits ---

PLAN = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]


def test_splits_keep_groups_and_shares(spark):
    rows = [(rid(i), "big" if i < 600 else f"g{i // 3}", "train" if i % 2 else "VAL", i) for i in range(2000)]
    rows += [(rid(0).upper(), None, None, -1), (None, "g", "train", 5), (rid(3000), " null ", "test", 1)]
    a = spark.createDataFrame(rows, "record_id string, group_id string, split string, t int").withColumn("assigned_at", F.timestamp_seconds("t"))
    plan = spark.createDataFrame(PLAN, "split string, target_share double")
    out = splits.record_splits(a, plan, groups_a_partition=300).toPandas()
    assert len(out) == 2001 and out.record_id.is_unique
    assert (out[out.group_id.notna()].groupby("group_id").split.nunique() == 1).all()
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.15) < 0.01
    assert set(r["group_id"] for r in splits.torn_groups(a, plan).collect()) == {g for g in out[out.torn].group_id}
    assert splits.record_splits(a.limit(0), plan).count() == 0


def test_splits_over_a_tree_and_links(spark):
    r = random.Random(3)
    rows = [(rid(i), f"g{i // r.randrange(1, 6)}", "train", i) for i in range(3000)]
    a = spark.createDataFrame(rows, "record_id string, group_id string, split string, t int").withColumn("assigned_at", F.timestamp_seconds("t"))
    plan = spark.createDataFrame(PLAN, "split string, target_share double")
    out = splits.record_splits(a, plan, bins=20, groups_a_partition=40, fan=3).toPandas()
    assert len(out) == 3000 and (out.groupby("group_id").split.nunique() == 1).all()
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["test"] - 0.15) < 0.02
    links = [(rid(i), rid(i + 700)) for i in range(0, 300, 7)] + [(rid(5), rid(9000)), (rid(9000), rid(2500)), ("x", rid(1))]  # 9000 has no assignment
    out = splits.record_splits(a, plan, spark.createDataFrame(links, "left_record_id string, right_record_id string"), bins=20).toPandas()
    of = dict(zip(out.record_id, out.split))
    assert len(out) == 3000 and (out.groupby("group_id").split.nunique() == 1).all()
    assert all(of[x] == of[y] for x, y in links if x in of and y in of) and of[rid(5)] == of[rid(2500)]


def test_differencing_balances():
    r = random.Random(1)
    w = np.array([r.randrange(1, 50) for _ in range(997)], dtype=float)
    at, sums = splits.bins_of(w, 10)
    assert np.allclose(np.bincount(at, weights=w, minlength=10), sums) and sums.max() - sums.min() <= 3


# --- 10: pieces ---

WORDS = "Some plain words, then more; and a sentence. Another one! What?\nA line\n\nA paragraph <br/> <p>tagged</p> x-y don't ½ é".split(" ")


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_and_fit(seed):
    r = random.Random(seed)
    text = ("" if seed == 5 else " ").join(r.choice(WORDS) for _ in range(1500))
    n = len(pieces.TOKEN.findall(text))
    out = pieces.cut(text, 100, 10)
    assert all(p[2] <= 100 for p in out) and sum(p[3] for p in out) == n and out[0][0] == 0 and out[-1][1] == len(text)
    for a, b in itertools.pairwise(out):
        assert len(pieces.TOKEN.findall(text[a[0] : a[1]])) == a[2]
        shared = text[b[0] : a[1]]
        assert len(pieces.TOKEN.findall(shared)) == min(10, b[3])


def test_pieces_prefer_strong_boundaries():
    text = "\n\n".join(" ".join(f"Word{i} goes on here." for i in range(8)) for _ in range(6))
    assert all(text[: p[0]].endswith("\n\n") for p in pieces.cut(text, 50, 0)[1:])


@pytest.mark.parametrize("seed", range(4))
def test_pieces_end_at_boundaries_with_exact_overlap(seed):
    r = random.Random(seed)
    sentences = [" ".join(["word"] * r.randrange(3, 60)) + "." for _ in range(150)]
    text = "".join(s + r.choice([" ", " ", "\n", "\n\n"]) for s in sentences)
    out = pieces.cut(text, 512, 48)
    ends = {0, *(m.end() for m in re.finditer(r"\.\s+", text)), len(text)}
    assert len(out) > 5 and all(p[1] in ends and p[2] <= 512 for p in out)
    assert all(len(pieces.TOKEN.findall(text[b[0] : a[1]])) == 48 for a, b in itertools.pairwise(out))


@pytest.mark.parametrize(("limit", "overlap"), [(10, 9), (100, 60), (512, 48), (7, 0)])
def test_overlap_is_exact_around_small_pieces(limit, overlap):
    text = ("x " * (limit - overlap) + ".\n\nTitle\n\n") * 9 + "End"
    out = pieces.cut(text, limit, overlap)
    assert sum(p[3] for p in out) == len(pieces.TOKEN.findall(text)) and out[-1][1] == len(text)
    for a, b in itertools.pairwise(out):
        assert b[2] == len(pieces.TOKEN.findall(text[b[0] : b[1]])) <= limit and a[1] < b[1]
        assert len(pieces.TOKEN.findall(text[b[0] : a[1]])) == overlap


def test_split_texts_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a " * 512), (4, "a " * 513), (5, "x" * 100_000), (6, "!? " * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    assert sorted(r["doc_id"] for r in pieces.oversized(df, 512, 48).collect()) == [4, 6]
    assert pieces.split_texts(df.limit(0), 512, 48).count() == 0


# --- 8: containers ---


def test_lower_bound_and_fit():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.sort(r.integers(1, 60, size=r.integers(1, 9)))[::-1].copy()
        at = packing.best_fit_decreasing(sizes, 60)
        assert np.bincount(at, weights=sizes).max() <= 60
        best = min(len(set(p)) for p in itertools.product(range(min(4, len(sizes))), repeat=len(sizes)) if np.bincount(p, weights=sizes).max() <= 60) if len(sizes) <= 6 else None
        if best:
            assert packing.lower_bound(sizes, 60) <= best <= at.max() + 1


def test_pack_whole_and_exchange(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([0, 3, 40, 51, 60, 99, 100, 250])) for i in range(800)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1))
    out = packing.pack(df, 100, items_a_partition=100).toPandas()
    assert set(out.doc_id) == {i for i, _ in rows} and out.groupby("container_id").n_tokens.sum().max() <= 100
    assert out.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    assert (out.groupby("doc_id").size() == out.groupby("doc_id").n_parts.first()).all() and set(out[out.n_parts > 1].doc_id) == {i for i, t in rows if t and len(t.split()) > 100}
    assert packing.pack(df.limit(0), 100).count() == 0


def test_exchange_saves_containers(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(i, "w " * r.randrange(22, 48)) for i in range(1500)], "doc_id long, text string")
    out = packing.pack(df, 100, items_a_partition=30).toPandas()
    assert out.container_id.str.match(r"[1-9]\d*-").any()  # only an exchange that saves containers is kept
    assert len(out) == 1500 and out.groupby("container_id").n_tokens.sum().max() <= 100


# --- 9: mixing ---


def test_water_fill():
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert mixing.water_fill({"a": 100, "b": 1000, "c": 1000}, w, {"a": 2, "b": 1, "c": 1}) == pytest.approx({"a": 200, "b": 120, "c": 80})
    assert mixing.water_fill({"a": 100, "b": 1000, "c": 1000}, w, {"a": 2, "b": 1, "c": 1}, 1000) == pytest.approx({"a": 200, "b": 480, "c": 320})
    assert mixing.water_fill({"a": 0, "b": 10, "c": 10}, w, {"a": 2, "b": 1, "c": 1}, 1000) == pytest.approx({"a": 0, "b": 10, "c": 10})


def test_mix_reaches_shares(spark):
    rows = [(i, "w " * (1 + i % 7), "Small source" if i % 10 == 0 else "large-source " if i % 2 else None) for i in range(4000)] + [(9000, None, "large_source"), (9001, "", "large_source")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9))
    plan = spark.createDataFrame([("small_source", 0.5, 3), ("large_source", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, given = mixing.mix(df, plan)
    got = {r["source"]: r for r in mixing.reached(chosen, given).collect()}
    assert abs(got["small_source"]["share"] - 0.5) < 0.01 and got["small_source"]["most_copies"] == 3 and got["large_source"]["most_copies"] == 1
    assert chosen.select("doc_id").distinct().count() == chosen.count() and mixing.mix(df.limit(0), plan)[0].count() == 0


def test_mix_of_the_corpus_clamps_small_sources(spark):
    rows = [(i, "w " * 10, "a" if i % 20 == 0 else "b" if i % 10 == 1 else "c") for i in range(4000)]  # 2,000, 4,000 and 34,000 tokens
    plan = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 1), ("c", 0.4, 3)], "source string, target_share double, max_repeats int")
    chosen, given = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), plan, "corpus")
    got = {r["source"]: r for r in mixing.reached(chosen, given).collect()}
    assert (got["a"]["used_tokens"], got["b"]["used_tokens"]) == (4000, 4000) and abs(got["c"]["used_tokens"] - 32000) <= 10
    assert got["a"]["most_copies"] == 2 and abs(got["a"]["share"] - 0.1) < 0.001


# --- 2: canonical values ---


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_equals_brute_force(spark):
    r = random.Random(9)
    refs = ["".join(r.choice("abcd") for _ in range(r.randrange(3, 16))) for _ in range(60)]

    def typo(s):
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(s) + 1)
            s = s[:i] + r.choice(["", "a", "d"]) + s[i + r.randrange(0, 2) :]
        return s or "a"

    values = sorted({typo(r.choice(refs)) for _ in range(300)})
    allowed = lambda n: 0 if n < 5 else 1 if n < 10 else 2
    want = {(v, x) for v in values for x in refs if levenshtein(v, x) <= allowed(len(x))}
    got = canonical.pigeonhole_join(spark.createDataFrame([(v,) for v in values], "key string"), spark.createDataFrame([(x,) for x in refs], "ref_key string"))
    assert {(x["key"], x["ref_key"]) for x in got.collect()} == want



def test_no_broadcast_of_what_outgrows_its_files(spark):
    words = materialize(spark.createDataFrame([("melatonin",), ("meltonin",), ("zinc",)], "word string"))
    broadcast = lambda df: (df.collect(), "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString())[1]
    near = canonical.pigeonhole_join(words.select(F.col("word").alias("key")), words.select(F.col("word").alias("ref_key")))
    # a key has dozens of pieces, but the planner sees the size of its file only
    assert not broadcast(near) and {tuple(r) for r in near.collect()} >= {("meltonin", "melatonin", 1), ("zinc", "zinc", 0)}
    other = words.withColumn("n", F.length("word"))
    assert broadcast(words.join(bounded(other, words, 3), "word")) and not broadcast(words.join(bounded(other, words, 2), "word"))


def test_values_are_mapped(spark):
    ref = spark.createDataFrame([(1, "Trunaeskum Brothers", None), (2, "Zulimbum Apothecary", "Fubrettus House"), (3, "Flostuptix’s", None), (4, "Segilma Nutrition Co.", None), (5, "Tocava & Daughters", None), (6, "Tocava Farm", None)], "brand_id long, brand_name string, former_name string")
    want = {
        "trunaeskum brothers": 1, "Brothers Trunaeskum": 1, "TrunaeskumBrothers": 1, "Trunaeskum Bros": 1, "Brand: Zulimbum Apothecary, Inc": 2, "FUBRETTUS HOUSE": 2, "Zulimbum": 2, "Zulimbun Apothecary": 2,
        "Flostuptix's / Flostuptix's": 3, "Flostuptixâ€™s": 3, "Visit the Segilma Nutrition Co. Store": 4, "SNC": 4, "Segilma® Nutr. Co": 4, "Tocava": 0, "Tocava and Daughters": 5, "Tocava & Daughters / Tocava": 5,
        "see title": 0, "--": 0, "Mizaelma": 0, "x" * 50_000: 0,
    }
    rows = [(str(i), v, None if i % 2 else "Tocava Farm") for i, v in enumerate(want)] + [("n", None, " NULL ")]
    df = spark.createDataFrame(rows, "record_id string, ProductBrand string, Brand string").withColumn("brand_id", F.lit("clash")).withColumn("value", F.lit(1))
    got = {r["value"]: r["brand_id"] for r in canonical.map_fields(df, ref).collect()}
    assert got == want
    assert canonical.map_fields(df, ref.limit(0)).filter("brand_id <> 0").count() == 0 and canonical.map_fields(df.limit(0), ref).count() == 0


# --- 1: overlaps ---


def test_overlaps_equal_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(12)]
    texts = []
    for i in range(90):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t[: r.randrange(40, 61)]))
    texts += texts[:10]
    split = ["train" if i % 3 else r.choice(["test", "VAL"]) for i in range(len(texts))]
    rows = [(rid(i).upper() if i % 5 == 0 else rid(i), "Name 12mg", "<p>" + t + "</p>", "r") for i, t in enumerate(texts)] + [(rid(500), None, texts[0], "r"), (rid(501), "n", " null ", "r")]
    listings = spark.createDataFrame(rows, "record_id string, ProductName string, ProductDescription string, Retailer string").withColumn("c", F.lit(0)).withColumn("split", F.lit("clash"))
    a = spark.createDataFrame([(rid(i), "g", s) for i, s in enumerate(split)] + [(rid(500), "g", "test"), (rid(501), "g", "test")], "record_id string, group_id string, split string").withColumn("assigned_at", F.current_timestamp())

    def sets(t):
        w = ("name mg " + t).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    s = [sets(t) for t in texts]
    want = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (split[i] == "train") != (split[j] == "train") and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.5:
            want.add((rid(i), rid(j)))
    got = crosssplit.overlaps(listings, a)
    assert got.count() == len(want) and {tuple(x) for x in got.collect()} == want
    classes = crosssplit.overlap_classes(listings, a).toPandas()
    assert classes[classes.split == "train"].n_links.sum() == len(want)
    assert crosssplit.overlaps(listings.limit(0), a).count() == 0


def overlap_rows(spark, *rows):
    """The pairs among (split, name, description) rows, as pairs of row numbers."""
    listings = spark.createDataFrame([(rid(i), n, d, "r") for i, (_, n, d) in enumerate(rows)], "record_id string, ProductName string, ProductDescription string, Retailer string")
    a = spark.createDataFrame([(rid(i), "g", s) for i, (s, _, _) in enumerate(rows)], "record_id string, group_id string, split string").withColumn("assigned_at", F.current_timestamp())
    return {tuple(int(x, 16) for x in r) for r in crosssplit.overlaps(listings, a).collect()}


def test_overlaps_in_all_scripts(spark):
    russian = "Эта добавка содержит витамин С и цинк. Принимайте одну капсулу в день после еды, запивая водой."
    japanese = "本製品はビタミンCと亜鉛を含むサプリメントです。一日一粒を目安に水と一緒にお召し上がりください。"
    rows = [
        ("train", "Витамин С", russian), ("test", "Магний", "Хранить в сухом месте при комнатной температуре, беречь от детей и солнечного света."), ("test", "ビタミン", japanese), ("validation", "Витамин С 500", russian.replace("одну", "1")),
        ("train", "ビタミン", japanese + "!"), ("train", "123", "45 — 67"), ("test", "890", "12 — 34"), ("test", "123", "45 — 67"),
    ]
    assert overlap_rows(spark, *rows) == {(0, 3), (2, 4), (5, 7)}


def test_rarity_counts_frequent_shingles(spark):
    r = random.Random(3)
    texts = ["common words that all of the texts begin with " + " ".join(r.choice("abcdefghijklmnop") * 4 for _ in range(20)) for _ in range(400)]
    rarity = crosssplit._counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    _, common = crosssplit.shingle_sets(["common words that all of the texts begin with"])
    _, other = crosssplit.shingle_sets(texts[:50])
    exact = crosssplit._scale(np.array([400]))[0]
    assert (rarity.rank(common) == exact).all() and np.median(rarity.rank(other)) < exact


# --- 5: encodings ---


def test_chains_round_trip():
    text = "Größe – l’été “Piña” ½ żółw"
    for k, (b, a) in enumerate(mojibake.CHAINS[:7]):
        back = {v: c for c, v in mojibake._TO_BYTE[b].items()}
        garbled = "".join(chr(x) if x < 128 else back[x] for x in text.encode())
        undone = "".join(dict(mojibake.decodings(m)).get(k, m) if not m.isascii() else m for m in mojibake.re.split(r"([^\x00-\x7f]+)", garbled))
        assert undone == text, (b, a)


def test_repair(spark):
    r = random.Random(6)
    nouns = ["Größe", "crème brûlée", "jalapeño", "l’été", "piñón", "façade", "20 °C – ½", "naïve", "für", "à l’ancienne"]
    clean = [f"The {r.choice(nouns)} with {r.choice(nouns)} and {r.choice(nouns)} no {i}" for i in range(3000)]
    rows = [(str(i), t, "ÇÃO É" if i % 7 == 0 else None) for i, t in enumerate(clean)]
    rows += [("g1", clean[1].encode().decode("latin-1"), None), ("g2", clean[2].encode().decode("cp1251", "ignore"), "year�s"), ("g3", clean[3].encode().decode("mac_roman"), ""), ("g4", "plain " * 20_000, None)]
    df = spark.createDataFrame(rows, "record_id string, ProductName string, ProductDescription string").withColumn("value", F.lit(1))
    got = {(x["record_id"], x["field_name"]): x for x in mojibake.repair_fields(df).collect()}
    assert set(got) == {("g1", "ProductName"), ("g2", "ProductName"), ("g2", "ProductDescription"), ("g3", "ProductName")}
    assert got["g1", "ProductName"]["text"] == clean[1] and got["g3", "ProductName"]["text"] == clean[3] and not got["g2", "ProductDescription"]["restored"]
    assert mojibake.repair_fields(df.limit(0)).count() == 0


def test_many_wrong_decodings_are_undone(spark):
    nouns = ["Größe", "crème brûlée", "jalapeño", "façade", "für", "naïve"]
    clean = [f"The {nouns[i % 6]} with {nouns[(i * 5 + 1) % 6]} no {i}" for i in range(1500)]
    text = clean[0]
    for _ in range(5):
        text = text.encode().decode("latin-1")
    rows = [(str(i), c) for i, c in enumerate(clean)] + [("g", text)]
    df = spark.createDataFrame(rows, "record_id string, ProductName string").withColumn("ProductDescription", F.lit(None).cast("string"))
    got = [r for r in mojibake.repair_fields(df).collect() if r["record_id"] == "g"]
    assert got[0]["text"] == clean[0] and len(got[0]["chains"]) == 5


# --- 3: products ---


def test_quantities():
    read = lambda n, d="", c="": products.quantities(products._fold(n), d, products._fold(c))[:3]
    assert read("Acme Hibarar CoQ10 100 MG 45 Gummy Chews Ripe Peach") == (100_000, "gummy", "45 ct")
    assert read("8.8 oz Fine Powder 3,000 mg Megrahax minty Creatine Mono") == (3_000_000, "powder", "250 g")
    assert read("Valeriana Extract 0.45g Capsules x 90") == (450_000, "capsule", "90 ct")
    assert read("Hibarar", "You get 60-Count Softgels with 30 µg Vit B12 per serving.", "null") == (30, "softgel", "60 ct")
    assert read("Hibarar 120 coated tabs", "", "Zinc Picolinate (15 mg), husk powder") == (15_000, "tablet", "120 ct")
    assert read("") == (None, None, None)


def test_terms():
    words, more = products.terms("vitamin-c 500 mg x 60 capsules b-12 omega 3 coq10")
    assert words == ["vitamin", "omega"] and {"vitamin c", "b 12", "omega 3", "coq10"} <= set(more) and not any("mg" in t or "500" in t for t in more)


def test_matching_equals_brute_force():
    r = np.random.default_rng(8)
    for _ in range(60):
        w = r.integers(0, 6, size=(r.integers(1, 5), r.integers(1, 5))).astype(float)
        big = np.zeros((5, 5))
        big[: w.shape[0], : w.shape[1]] = w
        best = max(sum(big[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        pairs, total = products.matching(w)
        assert total == best and len(set(pairs.values())) == len(pairs)


def as_listings(spark, rows):
    return spark.createDataFrame(rows, "record_id string, Retailer string, ProductName string, ProductDescription string, Brand string").withColumn("ProductContents", F.lit(None).cast("string")).withColumn("ProductBrand", F.lit(None).cast("string"))


def test_products_with_mistyped_unknown_or_missing_words(spark):
    df = as_listings(
        spark,
        [
            ("a", "s1", "Acmeson Hibarar Melatonin 5 mg 60 capsules", "", "Acmeson"), ("b", "s2", "Acmeson Hibarar Meltonin 5 mg 60 capsules", "", "Acmeson"), ("c", "s3", "Acmeson Hibarar Melaotnin 5 mg 60 capsules", "", "Acmeson"),
            ("d", "s4", "Acmeson Melatonin 5 mg 60 capsules", "Hibarar by Acmeson. Calm nights.", "Acmeson"),  # the line is in the description
            ("e", "s1", "Kerolant Taurine 500 mg 60 capsules", "", "Kerolant"), ("f", "s2", "Hulimar Taurine 500 mg 60 capsules", "", "Korbat"), ("g", "s3", "Hulimar Taurine 0.5 g 60 capsules", "", "Korbat"),  # no listed ingredient
            ("h", "s1", "Acmeson 5 mg 60 capsules", "", "Acmeson"), ("i", "s2", "Acmeson 5 mg 60 capsules", "", "Acmeson"),  # nothing tells what it is
            ("j", "s1", "Zemugax Zinc 25 mg 30 tablets", "", "Acmeson"), ("k", "s2", "Zemugax Znc 25 mg 30 tablets", "", "Acmeson"),  # the line has one ingredient
        ],
    )
    got = {r["record_id"]: r["product_id"] for r in products.product_groups(df).collect()}
    assert set(got) == set("abcdefghijk") and got["a"] == got["b"] == got["c"] == got["d"] and got["f"] == got["g"] and got["j"] == got["k"]
    assert len(set(got.values())) == 6 and got["h"] != got["i"]


def test_certain_matches_equal_brute_force():
    r = np.random.default_rng(11)
    for _ in range(150):
        w = r.integers(0, 4, size=(r.integers(1, 5), r.integers(1, 5))).astype(float)
        n = max(w.shape)
        big = np.zeros((n, n))
        big[: w.shape[0], : w.shape[1]] = w
        totals = {p: sum(big[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))}
        best = [{(i, p[i]) for i in range(n) if big[i, p[i]] > 0} for p, t in totals.items() if t == max(totals.values())]
        assert set(products.certain_matches(w).items()) == set.intersection(*best)


def items(spark, *rows):
    """The product of each (seller, amount, form, pack, flavour) of one block, in order."""
    df = spark.createDataFrame([(i, "l", "x", *r) for i, r in enumerate(rows)], "i int, line string, ingredient string, seller string, amount double, form string, pack string, flavour string")
    df = df.withColumn("node", products._number("line", "ingredient", "seller", *products.FIELDS))
    return [r["product"] for r in df.join(products.assigned(products.nodes_of(df)), "node").orderBy("i").collect()]


def test_incomplete_readings_meet_without_a_complete_one(spark):
    a, b = items(spark, ("s1", 500.0, "capsule", None, None), ("s2", 500.0, "capsule", None, None))
    assert a == b
    a, b, c, d = items(spark, ("s1", 500.0, "capsule", None, None), ("s2", 500.0, None, "60 ct", None), ("s3", 500.0, None, None, None), ("s4", 250.0, None, None, None))
    assert a == b == c != d  # the union of the first two, which the third one agrees with
    assert len(set(items(spark, ("s1", 500.0, "capsule", None, None), ("s2", 500.0, "tablet", None, None), ("s3", 500.0, None, None, None)))) == 3  # the third fits both alike
    a, b = items(spark, ("s1", 500.0, "capsule", None, None), ("s1", 500.0, None, "60 ct", None))
    assert a != b  # one seller's own
    assert len(set(items(spark, ("s1", None, None, None, "mint"), ("s2", None, None, None, "mint")))) == 2


def test_sellers_constrain_matches(spark):
    full = lambda s, n: (s, 500.0, "capsule", f"{n} ct", None)
    got = items(spark, full("s1", 60), ("s1", 500.0, "capsule", None, None), full("s2", 60), full("s2", 90))
    assert got[0] == got[2] and got[1] == got[3] != got[0]  # s1 lists 60 itself, so its open listing is the other one of s2
    got = items(spark, ("s1", 500.0, "capsule", None, None), full("s2", 60), full("s2", 90), full("s3", 60))
    assert got[1] == got[3] != got[2] and got[0] == got[1]  # only s3 tells
    got = items(spark, ("s1", 500.0, "capsule", None, None), full("s2", 60), full("s3", 90))
    assert len(set(got)) == 3  # matches that contradict each other around the cycle
    got = items(spark, *[(f"s{i}", 500.0, "capsule", "60 ct", None) for i in range(6)], *[(f"s{i}", 500.0, "capsule", "60 ct", f) for i, f in ((1, "mint"), (2, "peach"))])
    assert got[1] == got[7] != got[6] == got[2]  # s1 lists mint itself, so what it lists without flavour is peach; and the other way round
    assert len({got[0], got[3], got[4], got[5], got[6], got[7]}) == 6  # nothing tells which of the two these are
    got = items(spark, ("s1", 500.0, "gummy", "60 ct", None), ("s2", 500.0, "gummy", "60 ct", "mint"), ("s3", 500.0, "gummy", "60 ct", "mint"))
    assert len(set(got)) == 1


def test_vocabulary_is_learned(spark):
    """Ingredients, flavours and lines that no list has, from listings alone."""
    r = random.Random(12)
    ingredients = {"quzzine": ["Quzzine", "Zylo Root", "Zylorum"], "brontex oil": ["Brontex Oil", "Brontexol"]}
    flavours, noise = [["Tarrel", "tarrelly"], ["Womberry flavour"], ["Ginnop"]], ["Great Value", "New", "Vegan", "Fresh Look", "Top"]
    rows, truth = [], {}
    for b in range(8):
        for line in range(3):
            brand, name = f"{'abcdefgh'[b] * 2}irbrand", f"{'pqrstuvw'[b]}o{'xyz'[line]}alime"
            for k in range(4):
                ing, flavour = r.choice(sorted(ingredients)), r.randrange(3)
                amount, count = r.choice([100, 250]), r.choice([30, 60, 90])
                for s in range(5):
                    i = f"{len(rows):05d}"
                    parts = [brand, name, r.choice(ingredients[ing]), r.choice([f"{amount} mg", f"{amount / 1000} g"]), r.choice([f"{count} gummies", f"Gummies x {count}"]), r.choice(flavours[flavour]), r.choice(noise)]
                    r.shuffle(parts)
                    rows.append((i, f"seller {s}", " | ".join(parts), None, brand, f"{ing.title()} ({amount} mg), peel" if r.random() < 0.5 else None))
                    truth[i] = (name, ing, amount, count, flavour)
    df = spark.createDataFrame(rows, "record_id string, Retailer string, ProductName string, ProductDescription string, Brand string, ProductContents string").withColumn("ProductBrand", F.lit(None).cast("string"))
    got = {x["record_id"]: x["product_id"] for x in products.product_groups(df).collect()}
    pairs = lambda of: {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if of[a] == of[b]}
    want, found = pairs(truth), pairs(got)
    assert len(want & found) >= 0.97 * len(want) and len(want & found) >= 0.97 * len(found)


def test_unlisted_words_and_short_lines(spark):
    df = as_listings(spark, [("a", "s1", "Echinacea 400 mg 60 capsules", "", None), ("b", "s2", "Echinacea 0.4 g 60 caps", "", None), ("c", "s1", "Zyn Zinc 25 mg 30 tablets", "", None), ("d", "s2", "Zyn Zinc 25 mg 30 tablets", "", None), ("e", "s3", "Цинк Актив 25 mg 30 tablets", "", None), ("f", "s4", "Цинк Актив 25 mg 30 tabs", "", None)])
    got = {r["record_id"]: r["product_id"] for r in products.product_groups(df).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["e"] == got["f"] and len(set(got.values())) == 3


def test_products(spark):
    rows = [
        ("a", "Acme Hibarar CoQ10 100 mg 45 gummies Peach", "s1"), ("b", "Hibarar | Ubiquinone Q10 | 0.1 g | Chewable Gummies x 45 | Ripe Peach", "s2"), ("c", "ACME HIBARAR Coenzyme Q10 100mg 45 ct Gummy Chews peach flavoured", "s1"),
        ("d", "Hibarar CoQ10 100 mg 90 gummies Peach", "s3"), ("e", "Hibarar Co-Q-10 Gummies 45 ct 100-mg", "s4"), ("f", "Zemugax Zinc 25 mg 30 tablets", "s1"), ("g", None, "s1"), ("h", "Hibarar CoQ10 gummies Peach", "s4"), ("a2", "Acme Hibarar CoQ10 100 mg 45 gummies Peach", None),
    ]
    df = spark.createDataFrame(rows, "record_id string, ProductName string, Retailer string")
    for c in ("ProductDescription", "ProductContents", "ProductBrand"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("Brand", F.lit("Acme")).withColumn("line", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["record_id"]: r["product_id"] for r in products.product_groups(df).collect()}
    assert got["a"] == got["b"] == got["c"] == got["e"] == got["a2"] and got["d"] != got["a"] and got["f"] not in (got["a"], got["d"]) and "g" not in got
    pairs = {tuple(r) for r in products.product_pairs(df).collect()}
    assert ("a", "b") in pairs and all(x < y for x, y in pairs) and ("a", "d") not in pairs
    assert products.product_pairs(df.limit(0)).count() == 0
