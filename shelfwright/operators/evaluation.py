"""Scores, calibration, selective risk, lookups and decisions over prediction tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions.identifiers import effective_wilson, kl_lower


def labelled(predictions: DataFrame) -> DataFrame:
    """One row a prediction_id (the latest), with both labels present."""
    last = predictions.groupBy("prediction_id").agg(F.max(F.struct("predicted_at", "record_id", "target", "true_label", "predicted_label", "confidence", "model_version")).alias("l"))
    return last.select("prediction_id", "l.*").filter("true_label is not null and predicted_label is not null")


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "true_label", "predicted_label").agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Support, emitted, correct, precision, recall and F1 of every label seen or emitted; 0 where undefined."""
    cells = confusion(rows, by)
    truth = cells.groupBy(*by, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("correct"))
    said = cells.groupBy(*by, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("emitted"))
    both = truth.join(said, [*by, "label"], "full").fillna(0, ["support", "correct", "emitted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("correct"), F.col("emitted")), ratio(F.col("correct"), F.col("support"))
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, accuracy, macro_f1, weighted_f1, balanced_accuracy); macro over labels seen or emitted."""
    m = class_metrics(rows, by)
    seen = F.col("support") > 0
    out = m.groupBy(*by).agg(
        F.sum("support").alias("n_rows"), (F.sum("correct") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
    )
    return out.select(*by, "n_rows", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")])


def right(rows: DataFrame) -> Column:
    return (rows["true_label"] == rows["predicted_label"]).cast("int")


def reliability(rows: DataFrame, bins: int = 10, closed: str = "right") -> DataFrame:
    """(target, bin, n, accuracy, confidence, gap): bins of confidence, right- or left-closed; rows without confidence are left out."""
    c = F.col("confidence")
    at = F.greatest(F.ceil(c * bins) - 1, F.lit(0)) if closed == "right" else F.least(F.floor(c * bins), F.lit(bins - 1))
    g = rows.filter("confidence is not null").withColumn("bin", at.cast("int")).groupBy("target", "bin").agg(F.count("*").alias("n"), F.avg(right(rows)).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return g.select("target", "bin", "n", F.round("accuracy", 9).alias("accuracy"), F.round("confidence", 9).alias("confidence"), F.round(F.abs(F.col("accuracy") - F.col("confidence")), 9).alias("gap"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(target, n, ece, brier, nll): binary calibration of the emitted label."""
    ok = rows.filter("confidence is not null").withColumn("y", right(rows))
    ece = reliability(rows, bins).withColumn("w", F.sum("n").over(Window.partitionBy("target"))).groupBy("target").agg(F.sum(F.col("n") * F.col("gap") / F.col("w")).alias("ece"))
    p = F.least(F.greatest(F.col("confidence"), F.lit(1e-12)), F.lit(1 - 1e-12))
    rest = ok.groupBy("target").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("confidence") - F.col("y"), F.lit(2))).alias("brier"), F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("nll"))
    return rest.join(ece, "target").select("target", "n", F.round("ece", 8).alias("ece"), F.round("brier", 8).alias("brier"), F.round("nll", 8).alias("nll"))


def selective(rows: DataFrame, steps: int = 20) -> DataFrame:
    """(target, threshold, accepted, errors): rows at or above each threshold, from a histogram by step, without joining rows to thresholds."""
    step = F.least(F.floor(F.col("confidence") * steps), F.lit(steps)).cast("int")
    hist = rows.filter("confidence is not null").withColumn("step", step).groupBy("target", "step").agg(F.count("*").alias("n"), F.sum(1 - right(rows)).alias("e"))
    grid = hist.select("target").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy("target").orderBy(F.col("step").desc())  # steps + 1 rows a target
    full = grid.join(hist, ["target", "step"], "left").fillna(0, ["n", "e"])
    return full.select("target", F.round(F.col("step") / steps, 6).alias("threshold"), F.sum("n").over(w).alias("accepted"), F.sum("e").over(w).alias("errors"))


def majority_by_key(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n, n_key): the most frequent label of each key, ties to the smallest label."""
    n = rows.groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = n.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("n_key"))
    return best.select("key", F.col("b.label").alias("label"), (-F.col("b.m")).alias("n"), "n_key")


def smoothed_lookup(rows: DataFrame, key: str, label: str, alpha: float = 1.0) -> DataFrame:
    """(key, label, p): seen pairs with Dirichlet-smoothed probability, the prior being the labels' overall shares."""
    n = rows.groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    of_key = n.groupBy("key").agg(F.sum("n").alias("n_key"))
    of_label = n.groupBy("label").agg(F.sum("n").alias("n_label"))
    total = rows.agg(F.count("*").alias("n_all")).withColumn("one", F.lit(1))
    prior = of_label.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("label", (F.col("n_label") / F.col("n_all")).alias("prior"))  # total is one row
    return n.join(of_key, "key").join(prior, "label").select("key", "label", F.round((F.col("n") + alpha * F.col("prior")) / (F.col("n_key") + alpha), 9).alias("p"))


def design_effect(rows: DataFrame, group: str) -> DataFrame:
    """(target, n_groups, n_rows, sum_squares, errors, effective_n): rows clustered in groups."""
    g = rows.groupBy("target", F.col(group).alias("g")).agg(F.count("*").alias("m"), F.sum(1 - right(rows)).alias("e"))
    out = g.groupBy("target").agg(F.count("*").alias("n_groups"), F.sum("m").alias("n_rows"), F.sum(F.col("m") * F.col("m")).alias("sum_squares"), F.sum("e").alias("errors"))
    return out.withColumn("effective_n", F.round(F.col("n_rows") * F.col("n_rows") / F.col("sum_squares"), 9))


def review_reasons(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(prediction_id, review, reasons): fails closed; a row passes only with no reason against it."""
    found = F.array(
        F.when(F.col("confidence").isNull(), "confidence_missing"), F.when(F.col("confidence") < threshold, "confidence_low"), F.when(F.col("predicted_label").isNull(), "label_missing"),
        F.when(F.col("model_version").isNull(), "model_unknown"), F.when(F.col("record_id").isNull(), "record_missing"),
    )
    reasons = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return rows.select("prediction_id", (F.size(reasons) > 0).alias("review"), F.array_join(reasons, ";").alias("reasons"))


def threshold_grid(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(target, per_mille, accepted, errors): rows at or above each threshold of a grid in thousandths, from a histogram; see selective()."""
    at = F.least(F.greatest(F.round(F.col("confidence") * 1000).cast("int"), F.lit(least - 1)), F.lit(most))
    hist = rows.filter("confidence is not null").withColumn("per_mille", at).groupBy("target", "per_mille").agg(F.count("*").alias("n"), F.sum(1 - right(rows)).alias("e"))
    grid = hist.select("target").distinct().withColumn("per_mille", F.explode(F.sequence(F.lit(least), F.lit(most))))
    w = Window.partitionBy("target").orderBy(F.col("per_mille").desc())  # as many rows a target as the grid has
    full = grid.join(hist, ["target", "per_mille"], "left").fillna(0, ["n", "e"])
    return full.select("target", "per_mille", F.sum("n").over(w).alias("accepted"), F.sum("e").over(w).alias("errors"))


def clustered_bounds(rows: DataFrame, group: str, error: float = 0.05) -> DataFrame:
    """(target, n_rows, effective_n, wilson, kl): lower bounds of the accuracy of rows clustered in groups."""
    g = rows.groupBy("target", F.col(group).alias("g")).agg(F.count("*").alias("m"), F.sum(right(rows)).alias("k"))
    t = g.groupBy("target").agg(F.sum("m").alias("n"), F.sum("k").alias("k"), F.sum(F.col("m") * F.col("m")).alias("s"))
    t = t.withColumn("e", F.col("n") * F.col("n") / F.col("s")).withColumn("p", F.col("k") / F.col("n"))
    return t.select(
        "target", F.col("n").alias("n_rows"), F.round("e", 6).alias("effective_n"), F.round(effective_wilson(F.col("k"), F.col("n"), F.col("e")), 8).alias("wilson"), F.round(kl_lower(F.col("p"), F.col("e"), error), 8).alias("kl")
    )


def accepted_classes(rows: DataFrame, threshold: float) -> DataFrame:
    """(target, label, support, accepted, coverage, precision) of every label seen or emitted among rows at or above a threshold; NULL where undefined."""
    ok = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    each = rows.select("target", "true_label", "predicted_label", ok.alias("ok"), F.explode(F.array_distinct(F.array("true_label", "predicted_label"))).alias("label"))
    true, said = F.col("label") == F.col("true_label"), F.col("label") == F.col("predicted_label")
    c = each.groupBy("target", "label").agg(F.count_if(true).alias("support"), F.count_if(true & F.col("ok")).alias("kept"), F.count_if(said & F.col("ok")).alias("accepted"), F.count_if(true & said & F.col("ok")).alias("correct"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 9)
    return c.select("target", "label", "support", "accepted", ratio("kept", "support").alias("coverage"), ratio("correct", "accepted").alias("precision"))


def cohort_accuracy(rows: DataFrame, cohorts: dict[str, Column]) -> DataFrame:
    """(cohort, n, accuracy): rows count in every cohort whose condition holds; empty cohorts are left out."""
    names = F.array(*[F.when(c, name) for name, c in cohorts.items()])
    each = rows.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("cohort"), (F.col("true_label") == F.col("predicted_label")).cast("int").alias("ok"))
    return each.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 9).alias("accuracy"))


def accuracy_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(target, n_before, n_after, before, after, delta): accuracies of two sets of predictions; NULL for a side that a target lacks."""
    side = lambda df, n, a: df.groupBy("target").agg(F.count("*").alias(n), F.avg((F.col("true_label") == F.col("predicted_label")).cast("int")).alias(a))
    both = side(before, "n_before", "a").join(side(after, "n_after", "b"), "target", "full")
    return both.select("target", "n_before", "n_after", F.round("a", 9).alias("before"), F.round("b", 9).alias("after"), F.round(F.col("b") - F.col("a"), 9).alias("delta"))


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """(target, label, n, correct): what the most frequent label of the training rows (ties to the smallest) gets right in the others."""
    n = train.groupBy("target", "true_label").agg(F.count("*").alias("n"))
    best = n.groupBy("target").agg(F.min(F.struct((-F.col("n")).alias("m"), "true_label")).alias("b")).select("target", F.col("b.true_label").alias("label"))
    return test.join(best, "target").groupBy("target", "label").agg(F.count("*").alias("n"), F.sum((F.col("true_label") == F.col("label")).cast("long")).alias("correct"))


def group_bootstrap(rows: DataFrame, group: str, draws: int = 200, seed: str = "bootstrap", error: float = 0.05) -> DataFrame:
    """(target, draws, low, median, high): percentile interval of the accuracy when whole groups are drawn again.

    Poisson bootstrap: in each draw a group counts 0, 1, 2, ... times, by a hash of seed, draw and group, so that draws need no exchange of rows
    and come out the same on every cluster. Groups of one size and number of right answers are no closer than that: each is drawn for itself.
    """
    g = rows.groupBy("target", F.col(group).alias("g")).agg(F.count("*").alias("m"), F.sum(right(rows)).alias("k"))
    each = g.select("target", "g", "m", "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col("target"), F.col("g")), F.lit(1 << 30)) / float(1 << 30)
    at, term, times = math.exp(-1.0), math.exp(-1.0), F.lit(0)
    for i in range(1, 9):  # more than 8 times has a probability below 1e-6
        times = times + (u >= at).cast("int")
        term /= i
        at += term
    drawn = each.withColumn("w", times).groupBy("target", "draw").agg((F.sum(F.col("w") * F.col("k")) / F.sum(F.col("w") * F.col("m"))).alias("a"))
    of = lambda q, name: F.round(F.percentile("a", F.lit(q)), 9).alias(name)
    return drawn.groupBy("target").agg(F.count("*").alias("draws"), of(error / 2, "low"), of(0.5, "median"), of(1 - error / 2, "high"))


def fitted_temperature(rows: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 40) -> DataFrame:
    """(target, n, temperature, nll): the temperature that makes the emitted labels' confidence likeliest, by golden sections on its logarithm.

    Rows enter as counts of (confidence, right) in thousandths, so a step reads at most 2,002 rows a target whatever the input.
    """
    c = F.least(F.greatest(F.round(F.col("confidence"), 3), F.lit(0.0005)), F.lit(0.9995))
    counts = rows.filter("confidence is not null").groupBy("target", c.alias("c"), right(rows).alias("y")).agg(F.count("*").alias("n"))
    cells = counts.groupBy("target").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "y", F.col("n").alias("w")))).alias("cells"))

    def nll(t: Column) -> Column:
        z = lambda x: F.log(x["c"] / (1 - x["c"])) / F.exp(t)
        loss = lambda x: x["w"] * (F.log1p(F.exp(-F.abs(z(x)))) + F.greatest(F.when(x["y"] == 1, -z(x)).otherwise(z(x)), F.lit(0.0)))
        return F.aggregate("cells", F.lit(0.0), lambda a, x: a + loss(x)) / F.col("n")

    phi = (math.sqrt(5) - 1) / 2

    def step(s: Column, _: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right_ = b - phi * (b - a), a + phi * (b - a)
        first = nll(left) <= nll(right_)
        return F.struct(F.when(first, a).otherwise(left).alias("a"), F.when(first, right_).otherwise(b).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(math.log(low)).alias("a"), F.lit(math.log(high)).alias("b")), step)
    out = cells.withColumn("s", found).withColumn("t", (F.col("s.a") + F.col("s.b")) / 2)
    return out.select("target", "n", F.round(F.exp("t"), 6).alias("temperature"), F.round(nll(F.col("t")), 9).alias("nll"))
