"""The strict CSV source, Arrow text functions, bootstrap and temperature."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfwright.functions.python_text import folded_text, sequence_ratio
from shelfwright.operators import evaluation
from shelfwright.sources import delivered


def test_strict_csv(spark, tmp_path):
    delivered.register(spark)
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes('﻿id,name\r\n1,"two\r\nlines, ""q"""\r\n\r\n2\r\n3,x,y\r\n4,\r\n'.encode())
    b.write_text("name,id\nz,9\n")
    rows = spark.read.format("strict_csv").load(str(tmp_path))
    got = [(r["file"], r["source_row"], r["fields"], r["well_formed"]) for r in rows.orderBy("file", "source_row").collect()]
    assert got == [("a.csv", 1, ["1", 'two\r\nlines, "q"'], True), ("a.csv", 2, ["2"], False), ("a.csv", 3, ["3", "x", "y"], False), ("a.csv", 4, ["4", ""], True), ("b.csv", 1, ["z", "9"], True)]
    assert {r[0] for r in rows.filter("file = 'a.csv'").select("source_sha256").collect()} == {hashlib.sha256(a.read_bytes()).hexdigest()}
    assert {(r["id"], r["name"]) for r in delivered.typed(rows, ["id", "name"], strict=False).collect()} == {("1", 'two\r\nlines, "q"'), ("4", ""), ("9", "z")}
    with pytest.raises(Exception, match="wrong number of fields"):
        delivered.typed(rows, ["id"]).collect()
    with pytest.raises(Exception, match="missing"):
        delivered.typed(rows, ["id", "price"], strict=False).collect()


@pytest.mark.parametrize("header", ["a,a", "a,", " ,b"])
def test_strict_csv_header(spark, tmp_path, header):
    delivered.register(spark)
    (tmp_path / "x.csv").write_text(header + "\n1,2\n")
    with pytest.raises(Exception, match="blank or repeated"):
        spark.read.format("strict_csv").load(str(tmp_path / "x.csv")).collect()


def test_arrow_text(spark):
    df = spark.createDataFrame([("Ｓtraße &amp; Co_1",), ("",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(folded_text("t")).collect()] == ["strasse co 1", "", None, ""]
    df = spark.createDataFrame([("abcd", "bcde"), ("bcde", "abcd"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(sequence_ratio("a", "b")).collect()] == [0.75, 0.75, 1.0, None]


def test_bootstrap_and_temperature(spark):
    r = random.Random(8)
    rows = []
    for i in range(6000):
        p = r.uniform(0.5, 0.99)
        z = math.log(p / (1 - p)) / 2  # true odds are those at temperature 2
        rows.append((i, f"r{i}", f"g{i // 3}", "T", "x", "x" if r.random() < 1 / (1 + math.exp(-z)) else "y", p))
    df = spark.createDataFrame(rows, "prediction_id long, record_id string, g string, target string, true_label string, predicted_label string, confidence double")
    t = evaluation.fitted_temperature(df).first()
    assert 1.7 < t["temperature"] < 2.4 and t["n"] == 6000
    b = evaluation.group_bootstrap(df, "g", draws=100).first()
    truth = df.filter("true_label = predicted_label").count() / 6000
    assert b["draws"] == 100 and b["low"] < truth < b["high"] and b["high"] - b["low"] < 0.06 and abs(b["median"] - truth) < 0.01
    assert evaluation.group_bootstrap(df.limit(0), "g").count() == evaluation.fitted_temperature(df.limit(0)).count() == 0
    assert evaluation.fitted_temperature(df.withColumn("confidence", F.lit(None).cast("double"))).count() == 0
