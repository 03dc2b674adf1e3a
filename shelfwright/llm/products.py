"""Problem 3: listings of one product, written differently by different sellers, as one group.

Method: seller-constrained assignment over readings whose vocabulary is learned from all listings.

Reading. Amount per serving, form and pack are parsed from units of measure. Which words name a product line, an active ingredient or a
flavour is learned: a line is a word that one brand has nearly to itself; an ingredient is known by the phrase that stands before an amount in
ProductContents, and the words of names that go with one such phrase stand for it; other identifying words (flavours) are those on which
listings of one line, ingredient, amount, form and pack agree far more often than by chance (Fellegi-Sunter m and u, counted without
listing pairs). Rare words within edits of a frequent one, above all of a line of the same brand, are taken for mistyped.

Matching. Equal readings of one seller are a node. Nodes of different sellers in one block (line and ingredient) that differ in no known
field are scored: each field in agreement weighs -log2 of its value's share of the block's nodes. For every pair of sellers and connected component of its scored pairs a
maximum-weight matching is solved; a component of one pair is its own matching, the others are solved by shortest augmenting paths, and
only matches that every matching of that weight contains are kept. Matches are merged where they are consistent around cycles: what a
node lacks is filled in from its matches if they all agree in it, again and again until nothing changes; where they differ, none of
them is followed, and the node stays a product of its own.

Scale: a map over the scan parses; vocabularies are aggregations with map-side combine. Only distinct readings enter blocks; complete
readings meet by equality of all fields, and the few incomplete ones meet their block. No block is gathered into a task: only components of
several pairs leave SQL, each for one pair of sellers within one block. Learned words and open nodes are broadcast
only where the table was counted and is small.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.canonical import ACCENTED, PLAIN, pigeonhole_join
from shelfwright.session import bounded, materialize

#: Dosage forms as units of a count, weight or volume, and the spellings of units.
_FORM = re.compile(r"(?P<gummy>gumm(?:y|ies))|(?P<softgel>\bsoft ?gels?\b)|(?P<capsule>\bcap(?:sule)?s?\b)|(?P<tablet>\btab(?:let)?s?\b)|(?P<lozenge>\blozenges?\b)|(?P<powder>\bpowder\b)|(?P<liquid>\bliquid|\btincture)")
_UNIT_WORDS = frozenset("gummy gummies soft gel gels softgel softgels cap caps capsule capsules tab tabs tablet tablets lozenge lozenges powder liquid tincture mg mcg ug ml kg oz fl gram grams milligram milligrams ct count pcs".split())
_MICROGRAMS = {"mcg": 1, "µg": 1, "μg": 1, "ug": 1, "mg": 1000, "milligrams": 1000, "milligram": 1000, "g": 1_000_000}
_AMOUNT = re.compile(r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)[ -]?(mg|mcg|µg|μg|ug|milligrams?|g)\b(?! ?\)? ?(?:drink |fine )?powder)")
_COUNT = re.compile(r"(?<![\w.,])(\d{2,3})[ -]?(?:ct|count|pcs)\b|\bx ?(\d{2,3})\b|(?<![\w.,-])(\d{2,3}) (?!mg|mcg|milli|[gl]\b|kg|µg|ug|ml|oz|fl)(?=(?:[a-z]+ ){0,2}?(?:gumm|cap|soft ?gel|tab|lozenge|veg|chew|coated|gel))")
_WEIGHT = re.compile(r"(?<![\w.,])(\d+(?:\.\d+)?)[ -]?(kg|grams?|g|oz)\b")
_VOLUME = re.compile(r"(?<![\w.,])(\d+(?:\.\d+)?)[ -]?(ml|l|fl\.? oz)\b")
#: The phrase before the first amount of a list of contents.
_PHRASE = re.compile(r"\s*([^()]{2,80}?)\s*\(\s*\d[\d.,]*[ -]?(?:mg|mcg|µg|μg|ug|g)\b")
_FOLD = str.maketrans(ACCENTED, PLAIN)
_TAG = re.compile(r"<[^<>]*>")
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n|•")

FIELDS = ("amount", "form", "pack", "flavour")
CONCENTRATED = 0.7  # share of a word's listings that one brand must have for it to name a line
PURE, SUPPORT = 0.9, 3  # share and number of the listings of one ingredient among those that have a word
LONE_ROWS = 1_000_000  # single numbers that may be broadcast
LIFT, PAIRS = 2.0, 8  # how much more often than by chance listings must agree on an identifying word, and in how many pairs


def _fold(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    return text if text.isascii() else text.replace("â\x80\x99", "'").replace("â€™", "'").translate(_FOLD)


def read_form(text: str) -> str | None:
    """The dosage form that is named first."""
    m = _FORM.search(text)
    return m.lastgroup if m else None


def read_pack(text: str, form: str | None) -> str | None:
    """Count, weight or volume of a pack: '60 ct', '250 g', '500 ml'; ounces become the nearest ten grams or millilitres."""
    if form == "powder":
        for m in _WEIGHT.finditer(text):
            n, u = float(m[1]), m[2]
            g = n * 1000 if u == "kg" else n * 28.35 if u == "oz" else n
            if g >= 50:
                return f"{round(g / 10) * 10} g"
    elif form == "liquid":
        for m in _VOLUME.finditer(text):
            n, u = float(m[1]), m[2]
            ml = n * 1000 if u == "l" else n * 29.57 if "fl" in u else n
            if ml >= 20:
                return f"{round(ml / 10) * 10} ml"
    elif m := _COUNT.search(text):
        return f"{int(m[1] or m[2] or m[3])} ct"
    return None


def read_amount(text: str, form: str | None) -> int | None:
    """Micrograms per serving; a weight that is the pack of a powder is none."""
    for m in _AMOUNT.finditer(text):
        n, u = float(m[1].replace(",", "")), m[2]
        if u == "g" and form == "powder" and n >= 50:
            continue
        return round(n * _MICROGRAMS[u])
    return None


def facts(text: str) -> str:
    """The sentences of a description that give a number."""
    return " . ".join(s for s in _SENTENCE.split(text) if _DIGIT.search(s)) if _DIGIT.search(text) else ""


def quantities(name: str, description: str | Callable[[], str], contents: str) -> tuple[int | None, str | None, str | None, str]:
    """(amount, form, pack, facts) of a listing with folded name and contents; what the name lacks comes from the contents and from the description's facts, which are '' if not looked at."""
    form = read_form(name)
    amount, pack = read_amount(name, form), read_pack(name, form)
    said = ""
    if amount is None or form is None or pack is None:
        said = facts(_fold(description if isinstance(description, str) else description()))
        form = form or read_form(said)
        amount = amount or read_amount(name, form) or read_amount(contents, form) or read_amount(said, form)
        pack = pack or read_pack(name, form) or read_pack(said, form)
    return amount, form, pack, said


def terms(text: str) -> tuple[list[str], list[str]]:
    """The distinct words of three letters or more that are no units, and the other terms: words with digits, and a short word or number with its neighbour."""
    words, more, before = {}, {}, ""
    for t in _TOKEN.findall(text):
        if t in _UNIT_WORDS or t[0].isdigit() and (len(t) > 2 or not t.isdigit()):
            before = ""
            continue
        if not t.isalpha():
            if not t[0].isdigit():
                more[t] = None
        elif len(t) > 2:
            words[t] = None
        if before and (len(t) < 4 or len(before) < 4):
            more[f"{before} {t}"] = None
        before = t
    return list(words), list(more)


def readings(listings: DataFrame) -> DataFrame:
    """(record_id, seller, amount, form, pack, words, terms, said, brands, phrase): words and terms are those of the name without its brand,
    said those of the description's facts where the name lacks a quantity, phrase names the ingredient in the contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 4, pa.string())
        for batch in batches:
            out = []
            descriptions = batch.column(3)
            for i, (name, contents, b1, b2) in enumerate(zip(*[batch.column(i).to_pylist() for i in (2, 4, 5, 6)], strict=True)):
                n, c = _fold(name or ""), _fold(contents or "")
                amount, form, pack, told = quantities(n, lambda: descriptions[i].as_py() or "", c)  # noqa: B023
                own = set(_TOKEN.findall(_fold(f"{b1 or ''} {b2 or ''}")))
                words, more = terms(n)
                words = [w for w in words if w not in own]
                said = [w for w in terms(told)[0] if w not in own] if told else []
                m = _PHRASE.match(c)
                phrase = " ".join(_TOKEN.findall(m[1])) if m else None
                out.append((amount, form, pack, words, more, said, [w for w in own if len(w) > 2 and w.isalpha()], phrase or None))
            a = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(x), t) for x, t in zip(a, types, strict=True))],
                names=["record_id", "seller", "amount", "form", "pack", "words", "terms", "said", "brands", "phrase"],
            )

    given = F.coalesce("ProductName", "ProductDescription", "ProductContents").isNotNull()
    text = listings.filter(F.col("record_id").isNotNull() & given).select("record_id", F.coalesce(F.lower(F.trim("Retailer")), F.lit("")).alias("seller"), "ProductName", "ProductDescription", "ProductContents", "ProductBrand", "Brand")
    lists = ", ".join(f"{c} array<string>" for c in ("words", "terms", "said", "brands"))
    return text.mapInArrow(run, f"record_id string, seller string, amount long, form string, pack string, {lists}, phrase string")


def _brand_number(brand: Column) -> Column:
    """A word of a brand as a number of 32 bits, which only has to tell a listing's own brand words from others."""
    return F.xxhash64(brand).bitwiseAND(F.lit((1 << 32) - 1))


def vocabulary(read: DataFrame) -> DataFrame:
    """What terms stand for: (term, line, n_line, top, ingredient, n_ingredient, word); mistyped words stand for what they were meant to be.

    line is a word that one brand has nearly to itself, top the number of its brand word; ingredient is the phrase that goes with a term; word, where both are
    missing, is a word of PAIRS listings or more.
    """
    branded = read.select(F.explode("words").alias("term"), "brands").select("term", F.posexplode_outer("brands").alias("at", "brand"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    per_brand = branded.groupBy("term", "brand").agg(F.count("*").alias("nb"), F.count_if(first).alias("n"), F.count_if(first & F.col("brand").isNotNull()).alias("known"))
    known = F.when(F.col("brand").isNotNull(), F.col("nb"))
    # count and brand in one number, so that the greatest is found without strings
    packed = per_brand.groupBy("term").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.max(F.shiftleft(known, 32).bitwiseOR(_brand_number(F.col("brand")))).alias("p"))
    words = packed.select("term", "n", "known", F.shiftright("p", 32).alias("nb"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).alias("top"))
    as_brand = read.select(F.explode("brands").alias("term")).groupBy("term").agg(F.count("*").alias("n_brand"))
    # a word that is a brand more often than not is one here, too
    words = words.join(as_brand.hint("merge"), "term", "left").filter("n_brand is null or n_brand < n")
    is_line = (F.col("known") == 0) | (F.col("nb") >= CONCENTRATED * F.col("known"))
    words = materialize(words.select("term", "n", "top", is_line.alias("is_line"), (F.coalesce("n_brand", F.lit(0)) >= SUPPORT).alias("is_brand")), "words")
    # ingredients
    beside = read.filter("phrase is not null").select("phrase", F.explode(F.concat("words", "terms")).alias("term")).groupBy("term", "phrase").agg(F.count("*").alias("n"))
    pure = beside.groupBy("term").agg(F.max("n").alias("n_ingredient"), F.max_by("phrase", F.struct("n", "phrase")).alias("ingredient"), F.sum("n").alias("all")).filter(f"n_ingredient >= {SUPPORT} and n_ingredient >= {PURE} * all").drop("all")
    pure = materialize(pure.join(bounded(words.filter("is_line or is_brand").select("term"), words), "term", "left_anti"), "pure")
    # mistyped words
    often = words.filter("n > 1").select(F.col("term").alias("ref_key"), F.col("n").alias("n_ref"), F.col("top").alias("top_ref"), F.col("is_line").alias("line_ref"))
    near = pigeonhole_join(words.select(F.col("term").alias("key")), often.select("ref_key")).filter("distance > 0")
    near = near.join(bounded(often, words), "ref_key").join(bounded(words.select(F.col("term").alias("key"), "n", "top"), words), "key")
    near = near.filter("n * 5 <= n_ref or (line_ref and top = top_ref and n * 2 <= n_ref)")
    to = near.groupBy("key").agg(F.max_by("ref_key", F.struct((F.col("line_ref") & (F.col("top") == F.col("top_ref"))).alias("own"), -F.col("distance"), "n_ref", "ref_key")).alias("word"))
    right = words.select("term").join(to.select(F.col("key").alias("term"), "word"), "term", "left").select("term", F.coalesce("word", "term").alias("word"))
    stands = words.select(F.col("term").alias("word"), "n", "is_line", "top").join(bounded(pure.withColumnRenamed("term", "word"), pure), "word", "left")
    meant = right.join(stands, "word").filter(f"is_line or ingredient is not null or n >= {PAIRS}")
    neither = ~F.col("is_line") & F.col("ingredient").isNull()
    meant = meant.select("term", F.when(F.col("is_line"), F.col("word")).alias("line"), F.when(F.col("is_line"), F.col("n")).alias("n_line"), "top", "ingredient", "n_ingredient", F.when(neither, F.col("word")).alias("word"))
    others = pure.filter(~F.col("term").rlike(r"^\p{L}{3,}$"))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    others = others.select("term", nothing("string", "line"), nothing("long", "n_line"), nothing("long", "top"), "ingredient", "n_ingredient", nothing("string", "word"))
    return materialize(meant.unionByName(others), "vocabulary")


def with_lines(read: DataFrame, known: DataFrame, listings: DataFrame) -> DataFrame:
    """(row, record_id, seller, line, ingredient, amount, form, pack, name, marks, said_marks): line and ingredient are NULL where they can't be told.

    The line is the most frequent one that the name has, else (or where that word mostly stands beside another line) the only one of the
    description whose brand is the listing's. The ingredient is that of the name's terms, else the phrase of the contents, else that of the
    description (of its facts first), else the only one of the line. marks has the name's frequent other words and, after an equals sign, terms of
    ingredients, said_marks those of the facts; name is a number for the name's text.
    """
    best = lambda what, n, when: F.max_by(what, F.when(F.col(what).isNotNull() & when, F.struct(n, what)))
    own = F.col("at") < F.col("n_own")
    told = read.select("row", (F.size("words") + F.size("terms")).alias("n_own"), F.posexplode(F.concat("words", "terms", "said")).alias("at", "term")).join(bounded(known, known), "term")
    marks = F.coalesce("word", F.when(F.col("ingredient").isNotNull(), F.concat(F.lit("="), "term")))
    told = told.groupBy("row").agg(
        best("line", "n_line", own).alias("line"), best("ingredient", "n_ingredient", own).alias("ingredient"), best("ingredient", "n_ingredient", ~own).alias("facts_ingredient"),
        F.collect_set(F.when(own, marks)).alias("marks"), F.collect_set(F.when(~own, marks)).alias("said_marks"),
    )
    columns = ["row", "record_id", "seller", "amount", "form", "pack", "brands", "phrase", F.xxhash64("words").alias("name")]
    out = read.select(*columns).join(told, "row", "left").withColumn("ingredient", F.coalesce("ingredient", "phrase", "facts_ingredient")).drop("phrase", "facts_ingredient")
    out = materialize(out, "lines")
    # a word that mostly stands beside a line is none, unless nothing else tells
    sizes = known.filter("line = term").select("line", "n_line")
    weak = out.filter("line is not null").groupBy("line").agg(F.count("*").alias("picked")).join(bounded(sizes, known), "line").filter("picked * 2 <= n_line").select("line", F.lit(True).alias("weak"))
    marked = out.join(bounded(materialize(weak, "weak"), known), "line", "left").select(*out.columns, "weak")
    settled = F.col("line").isNotNull() & F.col("ingredient").isNotNull() & F.col("weak").isNull()
    rest = materialize(marked.filter(~settled).withColumn("h", F.xxhash64("record_id")), "rest")
    texts = listings.filter("ProductDescription is not null").withColumn("h", F.xxhash64("record_id")).join(bounded(rest.select("h"), rest, LONE_ROWS), "h", "left_semi")
    texts = texts.select("record_id", F.split(F.translate(F.lower("ProductDescription"), ACCENTED, PLAIN), r"[^\p{L}]+").alias("term"))
    said = bounded(rest.select("record_id", "brands"), rest).join(texts, "record_id").select("record_id", "brands", F.explode(F.array_distinct("term")).alias("term")).join(bounded(known, known), "term")
    said = said.groupBy("record_id").agg(F.collect_set(F.when(F.array_contains(F.transform("brands", _brand_number), F.col("top")), F.col("line"))).alias("lines"), best("ingredient", "n_ingredient", F.lit(True)).alias("said_ingredient"))
    only = out.filter("line is not null and ingredient is not null").groupBy("line").agg(F.min("ingredient").alias("least"), F.max("ingredient").alias("most")).filter("least = most")
    rest = rest.join(said.select("record_id", F.when(F.size("lines") == 1, F.col("lines")[0]).alias("said_line"), "said_ingredient"), "record_id", "left")
    rest = rest.withColumn("line", F.coalesce(F.when(F.col("weak").isNull(), F.col("line")), "said_line", "line")).withColumn("ingredient", F.coalesce("ingredient", "said_ingredient"))
    rest = rest.join(bounded(only.select("line", F.col("least").alias("only")), known), "line", "left").withColumn("ingredient", F.coalesce("ingredient", "only"))
    return marked.filter(settled).select(out.columns).unionByName(materialize(rest.select(out.columns), "mended"))


def identifying_words(read: DataFrame) -> DataFrame:
    """(mark, flavour, n, explains): words, neither lines nor ingredients, on which listings that agree in all else agree LIFT times as often as by chance.

    Words that one of these nearly always goes with ('ripe' with 'peach'), or that only lengthen it ('minty'), stand for it. A term of an
    ingredient that never comes without one of these explains it ('sambucus' a 'berry'). Copies of a name count once, pairs are counted from the
    groups' counts.
    """
    whole = read.filter("line is not null and amount is not null and form is not null and pack is not null")
    g = F.xxhash64("line", F.coalesce("ingredient", F.lit("")), "amount", "form", "pack")
    names = materialize(whole.select(g.alias("g"), "name", F.xxhash64("form").alias("form"), F.xxhash64(F.coalesce("ingredient", F.lit(""))).alias("ingredient"), F.array_sort(F.coalesce("marks", F.array().cast("array<string>"))).alias("marks")).distinct(), "names")
    sizes = names.groupBy("g").agg(F.count("*").alias("size"))
    term = F.filter("marks", lambda x: ~F.startswith(x, F.lit("=")))
    counts = names.select("g", "form", "ingredient", F.explode(term).alias("mark")).groupBy("g", "form", "ingredient", "mark").agg(F.count("*").alias("k"))
    k, size = F.col("k"), F.col("size")
    cells = counts.join(sizes.hint("merge"), "g").groupBy("form", "ingredient", "mark").agg(F.sum("k").alias("n"), F.sum(k * (k - 1)).alias("pairs"), F.sum(k * (size - 1)).alias("base"))
    cells = materialize(cells, "cells")
    # the chance that a listing of this form, or of this ingredient, has the word
    share = lambda c: cells.groupBy(c, "mark").agg(F.sum("n").alias("nc")).join(names.groupBy(c).agg(F.count("*").alias("of")), c).select(c, "mark", (F.col("nc") / F.col("of")).alias(f"by_{c}"))
    stats = cells.join(share("form"), ["form", "mark"]).join(share("ingredient"), ["ingredient", "mark"])
    stats = stats.groupBy("mark").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum(F.col("base") * F.greatest("by_form", "by_ingredient")).alias("chance"))
    found = materialize(stats.filter(f"pairs >= {PAIRS} and pairs >= {LIFT} * chance").select("mark", "n"), "identifying")
    # what goes with what; a listing has few identifying words and terms of ingredients
    each = names.select("g", "name", F.explode("marks").alias("mark")).join(found.withColumn("hit", F.lit(True)), "mark", "left").filter("hit or startswith(mark, '=')")
    own = each.groupBy("g", "name").agg(F.collect_set("mark").alias("all"), F.collect_set(F.when(F.col("hit"), F.col("mark"))).alias("ws"))
    both = materialize(own.select(F.explode("all").alias("mark"), "ws").select("mark", F.explode_outer("ws").alias("other")).groupBy("mark", "other").agg(F.count("*").alias("c")), "beside")
    other = found.select(F.col("mark").alias("other"), F.col("n").alias("n_other"))
    beside = both.filter("mark <> other").join(found, "mark").join(other, "other").filter("c >= 0.8 * n and n_other > n").select("mark", "other", "n_other")
    stem = found.select("mark", F.explode(F.array(*[F.expr(f"left(mark, length(mark) - {i})") for i in (1, 2)])).alias("other")).filter("length(other) > 3").join(other, "other").select("mark", "other", "n_other")
    up = beside.unionByName(stem).groupBy("mark").agg(F.max_by("other", F.struct("n_other", "other")).alias("up"))
    twice = up.join(up.select(F.col("mark").alias("up"), F.col("up").alias("top")), "up", "left").select("mark", F.coalesce("top", "up").alias("up"))
    named = found.join(twice, "mark", "left").select("mark", F.coalesce("up", "mark").alias("flavour"), "n", F.lit(None).cast("string").alias("explains"))
    terms_ = names.select(F.explode("marks").alias("mark")).filter("startswith(mark, '=')").groupBy("mark").agg(F.count("*").alias("all"))
    explained = both.filter("startswith(mark, '=')").join(terms_, "mark").filter(f"c >= 0.95 * all and c >= {PAIRS}")
    explained = explained.select("mark", F.lit(None).cast("string").alias("flavour"), F.lit(None).cast("long").alias("n"), F.col("other").alias("explains"))
    return materialize(named.unionByName(explained), "flavours")


def with_flavours(read: DataFrame, flavours: DataFrame) -> DataFrame:
    """(record_id, seller, line, ingredient, amount, form, pack, flavour): flavour is the most frequent identifying word of the name that nothing explains, else of the description's facts."""
    own = F.col("at") < F.col("n_own")
    each = read.select("row", F.size("marks").alias("n_own"), F.posexplode(F.concat("marks", "said_marks")).alias("at", "mark")).join(flavours, "mark")
    of = lambda when: F.collect_set(F.when(F.col("flavour").isNotNull() & when, F.struct("n", "flavour")))
    sets = each.groupBy("row").agg(of(own).alias("fs"), of(~own).alias("said"), F.collect_set(F.when(own, F.col("explains"))).alias("ex"))
    top = lambda c: F.array_max(F.filter(c, lambda x: ~F.array_contains("ex", x["flavour"])))["flavour"]
    out = read.join(sets.select("row", F.coalesce(top("fs"), top("said")).alias("flavour")), "row", "left")
    return out.select("record_id", "seller", "line", F.coalesce("ingredient", F.lit("")).alias("ingredient"), F.col("amount").cast("double").alias("amount"), "form", "pack", "flavour")


def nodes_of(read: DataFrame) -> DataFrame:
    """(node, line, ingredient, seller, fields, item, open): the distinct readings of each seller, in numbers; open ones lack a field.

    A reading lacks its flavour only where others with the same other fields have one. item is one number for equal readings of all sellers.
    """
    # texts become numbers that a double holds exactly, as they only have to be equal or not
    code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c).bitwiseAND(F.lit((1 << 52) - 1))).alias(c)
    each = read.select("node", code("line"), code("ingredient"), code("seller"), "amount", code("form"), code("pack"), code("flavour")).distinct()
    number = lambda *columns: F.xxhash64(*[F.coalesce(F.col(c), F.lit(-1)) for c in columns])
    lacks = F.col("amount").isNull() | F.col("form").isNull() | F.col("pack").isNull()
    each = each.withColumn("base", number("line", "ingredient", "amount", "form", "pack"))
    # a base has at most as many nodes as sellers and flavours
    flavoured = F.max("flavour").over(Window.partitionBy("base")).isNotNull()
    out = each.withColumn("open", lacks | (F.col("flavour").isNull() & flavoured)).drop("base")
    return materialize(out.withColumn("item", number("line", "ingredient", *FIELDS)), "nodes")


def _number(*columns: str) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def field_weights(nodes: DataFrame) -> dict[str, float]:
    """-log2 of the chance that two readings agree in a field."""
    each = nodes.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS])).alias("x")).select("x.*").filter("value is not null")
    counts = each.groupBy("field", "value").agg(F.count("*").alias("n"))
    got = counts.groupBy("field").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("u")).collect()  # one row a field
    known = {r["field"]: r["u"] for r in got}
    return {f: max(0.1, float(-np.log2(known.get(f, 1.0)))) for f in FIELDS}


def scored_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, a_seller, b_seller, line, ingredient, weight) of nodes of different sellers in one block that differ in no known field, and
    those of them (and of one seller, weight 0) with an open node a: with b, b's item and whether b is open, and b's fields.

    Complete nodes meet by equality, open ones meet all nodes of their block.
    """
    weights = field_weights(nodes)
    of = lambda df, x: df.select("line", "ingredient", *[F.col(c).alias(x + c) for c in ("node", "seller", "item", "open", *FIELDS)])
    full, lacking = nodes.filter("not open"), nodes.filter("open")
    total = sum(F.when(F.col(f).isNotNull(), F.lit(weights[f])).otherwise(0.0) for f in FIELDS)
    x = full.select("item", "line", "ingredient", F.col("node").alias("a"), F.col("seller").alias("a_seller"), total.alias("weight"))
    equal = x.join(full.select("item", F.col("node").alias("b"), F.col("seller").alias("b_seller")).hint("merge"), "item").filter("a_seller < b_seller")
    agree = F.lit(True)
    for f in FIELDS:
        agree = agree & (F.col(f"a_{f}").isNull() | F.col(f"b_{f}").isNull() | (F.col(f"a_{f}") == F.col(f"b_{f}")))
    shared = sum(F.when(F.col(f"a_{f}") == F.col(f"b_{f}"), F.lit(weights[f])).otherwise(0.0) for f in FIELDS)
    loose = of(lacking, "a_").join(of(nodes, "b_"), ["line", "ingredient"]).filter((F.col("a_node") != F.col("b_node")) & agree)
    loose = materialize(loose.withColumn("weight", F.when(F.col("a_seller") != F.col("b_seller"), shared).otherwise(0.0)), "loose")
    return equal.select("a", "b", "a_seller", "b_seller", "line", "ingredient", "weight"), loose


def matching(weight: np.ndarray) -> tuple[dict[int, int], float]:
    """A maximum-weight matching of rows to columns as {row: column}, and its weight; weights of 0 match nothing."""
    pairs, _, _ = _solve(weight)
    kept = {r: c for r, c in sorted(pairs.items()) if r < weight.shape[0] and c < weight.shape[1] and weight[r, c] > 0}
    return kept, float(sum(weight[r, c] for r, c in kept.items()))


def _solve(weight: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """A perfect matching of greatest weight in the square matrix that zeros fill up, and the matrix and its reduced costs."""
    n = max(weight.shape)
    cost = np.zeros((n, n))
    cost[: weight.shape[0], : weight.shape[1]] = -weight
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        slack, done, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while owner[col]:
            done[col] = True
            row = owner[col]
            free = np.nonzero(~done[1:])[0] + 1
            reduced = cost[row - 1, free - 1] - u[row] - v[free]
            better = reduced < slack[free]
            slack[free[better]], back[free[better]] = reduced[better], col
            nxt = free[np.argmin(slack[free])]
            step = slack[nxt]
            u[owner[done]] += step
            v[done] -= step
            slack[~done] -= step
            col = nxt
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    return {int(owner[j]) - 1: j - 1 for j in range(1, n + 1)}, -cost, cost - u[1:, None] - v[None, 1:]


def certain_matches(weight: np.ndarray) -> dict[int, int]:
    """The matches {row: column} that every maximum-weight matching has.

    Other matchings of the greatest weight differ by cycles of tight cells, so a match is in all of them unless its row lies on such a cycle.
    """
    pairs, _, reduced = _solve(weight)
    n = len(pairs)
    col = np.array([pairs[r] for r in range(n)])
    reach = np.abs(reduced)[:, col] < 1e-9
    np.fill_diagonal(reach, False)
    for _ in range(max(1, n.bit_length())):
        reach = reach | (reach.astype(np.uint8) @ reach.astype(np.uint8) > 0)
    return {r: int(col[r]) for r in range(weight.shape[0]) if col[r] < weight.shape[1] and weight[r, col[r]] > 0 and not reach[r, r]}


def match_sellers(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b, equal): the certain matches among the scored pairs of two sellers in one block, component by component."""
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    rows, ra = np.unique(a, return_inverse=True)
    cols, cb = np.unique(b, return_inverse=True)
    label = np.arange(len(rows) + len(cols))
    while True:  # the least label of each end
        low = np.minimum(label[ra], label[len(rows) + cb])
        new = label.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, len(rows) + cb, low)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[ra]):
        inside = label[ra] == k
        r, ri = np.unique(ra[inside], return_inverse=True)
        c, ci = np.unique(cb[inside], return_inverse=True)
        weight, equal = np.zeros((len(r), len(c))), np.zeros((len(r), len(c)), dtype=bool)
        weight[ri, ci], equal[ri, ci] = pdf["weight"].to_numpy()[inside], pdf["equal"].to_numpy()[inside]
        out += [(rows[r[i]], cols[c[j]], equal[i, j]) for i, j in certain_matches(weight).items()]
    return pd.DataFrame(out, columns=["a", "b", "equal"]).astype({"a": "int64", "b": "int64", "equal": bool})


def matches(equal: DataFrame, loose: DataFrame) -> DataFrame:
    """(a, b, equal): the certain matches of each pair of sellers, a being of the seller that comes first; equal: their readings are."""
    cross = loose.filter("weight > 0")
    turn = F.col("a_seller") > F.col("b_seller")
    swap = lambda x, y, c: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(c)
    ends = [swap("a_node", "b_node", "a"), swap("b_node", "a_node", "b"), swap("a_seller", "b_seller", "sa"), swap("b_seller", "a_seller", "sb")]
    cross = cross.select("line", "ingredient", *ends, "weight").distinct()
    # pairs of equal readings are components of their own unless an open node of one seller may match the other's
    touched = cross.select(F.col("a").alias("node"), F.col("sb").alias("other")).unionByName(cross.select(F.col("b").alias("node"), F.col("sa").alias("other"))).distinct()
    touched = materialize(touched.withColumn("hit", F.lit(True)), "touched")
    first = touched.select(F.col("node").alias("a"), F.col("other").alias("b_seller"), F.col("hit").alias("x"))
    second = touched.select(F.col("node").alias("b"), F.col("other").alias("a_seller"), F.col("hit").alias("y"))
    marked = equal.join(bounded(first, touched), ["a", "b_seller"], "left").join(bounded(second, touched), ["b", "a_seller"], "left")
    lone = marked.filter("x is null and y is null").select("a", "b", F.lit(True).alias("equal"))
    several = marked.filter("x is not null or y is not null").select("line", "ingredient", "a", "b", F.col("a_seller").alias("sa"), F.col("b_seller").alias("sb"), "weight", F.lit(True).alias("equal"))
    several = several.unionByName(cross.withColumn("equal", F.lit(False)).select(several.columns))
    at_a, at_b = F.count("*").over(Window.partitionBy("a", "sb")), F.count("*").over(Window.partitionBy("b", "sa"))
    several = materialize(several.withColumn("single", (at_a == 1) & (at_b == 1)), "several")
    solved = several.filter("not single").groupBy("sa", "sb", "line", "ingredient").applyInPandas(match_sellers, "a long, b long, equal boolean")
    return lone.unionByName(several.filter("single").select("a", "b", "equal")).unionByName(solved)


def agree(a: tuple, b: tuple) -> bool:
    """Whether two readings have no field in which they differ."""
    return all(x is None or y is None or x == y for x, y in zip(a, b, strict=True))


def _unions(owners: dict[tuple, set]) -> set[tuple]:
    """The items of incomplete readings, given with their sellers: the readings that no other one completes; two of them from different
    sellers become their union where each agrees with the other only and both have the same known value of a field."""
    order = lambda k: tuple("" if x is None else str(x) for x in k)
    covers = lambda a, b: all(y is None or x == y for x, y in zip(a, b, strict=True))
    left = {k: set(s) for k, s in owners.items()}
    while True:
        top = sorted((k for k in left if not any(k != o and covers(o, k) for o in left)), key=order)
        near = {k: [o for o in top if o != k and agree(o, k)] for k in top}
        pair = next(((k, near[k][0]) for k in top if len(near[k]) == 1 and len(near[near[k][0]]) == 1 and len(left[k] | left[near[k][0]]) > 1 and any(x is not None and x == y for x, y in zip(k, near[k][0], strict=True))), None)
        if pair is None:
            return set(top)
        whole = tuple(x if x is not None else y for x, y in zip(*pair, strict=True))
        left[whole] = left.get(whole, set()) | left.pop(pair[0]) | left.pop(pair[1])


def unite(pdf: pd.DataFrame) -> pd.DataFrame:
    """(line, ingredient, item, united): the union that each of a block's distinct incomplete readings belongs to, if only one fits; two sellers are enough to tell sellers apart."""
    rows = pdf[list(FIELDS)].astype(object).where(pdf[list(FIELDS)].notna(), None)
    keys = list(rows.itertuples(index=False, name=None))
    unions = _unions({k: {x, y} for k, x, y in zip(keys, pdf["first_seller"], pdf["last_seller"], strict=True)})
    out = []
    for k, line, ingredient, item in zip(keys, pdf["line"], pdf["ingredient"], pdf["item"], strict=True):
        fits = [u for u in unions if agree(k, u)]
        if len(fits) == 1:
            out.append((line, ingredient, item, "|".join("" if x is None else str(x) for x in fits[0])))
    return pd.DataFrame(out, columns=["line", "ingredient", "item", "united"])


def assigned(nodes: DataFrame) -> DataFrame:
    """(node, product): matches merged where they are consistent.

    Matched complete nodes are one product, numbered by its least node. An open node joins the product of the complete nodes it may match if
    that is one product, else of those it is matched with if that is one; else it stays on its own. Open nodes without a complete one are
    united with those they agree with, if there is one way to, and if amount, form or pack is known.
    """
    equal, loose = scored_pairs(nodes)
    matched = materialize(matches(equal, loose), "matches")
    full = nodes.filter("not open").select("node", "item")
    turned = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = turned(matched.filter("not equal"))
    least = turned(matched.filter("equal")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    settled = materialize(full.join(least.hint("merge"), "node", "left").select("node", "item", F.least("node", "least").alias("product")), "settled")
    # cycles close: all complete nodes an open one may match, or is matched with, must be one item
    fits = loose.filter("not b_open").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "b_item")
    chosen = fits.join(both, ["a", "b"], "left_semi")
    one = lambda df, name: df.groupBy("a").agg(F.min("b_item").alias("x"), F.max("b_item").alias("y")).select("a", F.when(F.col("x") == F.col("y"), F.col("x")).alias(name))
    to = one(fits, "only").join(one(chosen, "match"), "a", "left").select(F.col("a").alias("node"), F.coalesce("only", "match").alias("item"))
    lacking = nodes.filter("open").select("node", "line", "ingredient", "seller", *FIELDS, F.col("item").alias("own")).join(to.withColumn("fitted", F.lit(True)), "node", "left")
    lacking = materialize(lacking, "lacking")
    heads = settled.groupBy("item").agg(F.min("product").alias("product"))
    joined = lacking.filter("item is not null").select("node", "item").join(heads, "item").select("node", "product")
    apart = lacking.filter("fitted is null and (amount is not null or form is not null or pack is not null)")
    distinct = apart.groupBy("line", "ingredient", *FIELDS, F.col("own").alias("item")).agg(F.min("seller").alias("first_seller"), F.max("seller").alias("last_seller"))
    united = distinct.groupBy("line", "ingredient").applyInPandas(unite, "line long, ingredient long, item long, united string")
    united = apart.join(united.select(F.col("item").alias("own"), _number("line", "ingredient", "united").alias("product")), "own").select("node", "product")
    open_ = lacking.select("node").join(joined.unionByName(united), "node", "left").select("node", F.coalesce("product", "node").alias("product"))
    return settled.select("node", "product").unionByName(open_)


def _products(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, product) of the listings with a line, and (record_id) of those without."""
    read = materialize(readings(listings).withColumn("row", F.monotonically_increasing_id()), "read")
    lines = with_lines(read, vocabulary(read), listings)
    told = materialize(with_flavours(lines, identifying_words(lines)).withColumn("node", _number("line", "ingredient", "seller", *FIELDS)), "told")
    whole = told.filter("line is not null")
    found = whole.select("record_id", "node").join(assigned(nodes_of(whole)), "node").select("record_id", "product")
    return found, told.filter("line is null").select("record_id")


def product_groups(listings: DataFrame) -> DataFrame:
    """(record_id, product_id): every listing with its product; NULLs are read as empty texts.

    A listing whose line can't be read is a product of its own; one without name, description and contents is none. Listings of one
    product_id are the same product, whoever sells them. Incomplete readings that several products fit alike, or of which neither amount, form nor
    pack is known, are products of their own for each seller and reading. Repeated listings share their product; a missing seller is one seller.
    """
    found, alone = _products(listings)
    name = lambda kind, c: F.sha2(F.concat(F.lit(f"{kind}|"), F.col(c).cast("string")), 256).alias("product_id")
    return found.select("record_id", name("product", "product")).unionByName(alone.select("record_id", name("unread", "record_id")))


def product_pairs(listings: DataFrame) -> DataFrame:
    """(left_record_id, right_record_id): all pairs of listings of one product, smaller id first."""
    groups = materialize(_products(listings)[0], "products")
    # the pairs are the result that is asked for; products are joined by number, hot ones are split by adaptive execution
    a, b = groups.select("product", F.col("record_id").alias("left_record_id")), groups.select("product", F.col("record_id").alias("right_record_id"))
    return a.join(b.hint("merge"), "product").filter("left_record_id < right_record_id").select("left_record_id", "right_record_id")
