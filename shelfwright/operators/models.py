"""Count and text models: correction memory, cohorts of a lookup, and a linear text classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_memory(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): keys all of whose rows have one label."""
    g = rows.groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"), F.max(label).alias("other"), F.count("*").alias("n"))
    return g.filter("label = other").select("key", "label", "n")


def apply_memory(rows: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """rows with remembered: the label of their key in the memory, or NULL."""
    return rows.join(memory.select(F.col("key").alias(key), F.col("label").alias("remembered")), key, "left")


def cohorts(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """test with cohort: missing (no key), seen or unseen in train."""
    known = train.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("known", F.lit(True))
    return test.join(known, key, "left").withColumn("cohort", F.when(F.col(key).isNull(), "missing").when(F.col("known"), "seen").otherwise("unseen")).drop("known")


def text_classifier(rows: DataFrame, text: str, label: str, features: int = 1 << 16, strength: float = 1.0) -> PipelineModel:
    """Word and word-pair frequencies, hashed, weighted by inverse document frequency, and a multinomial logistic regression on them.

    Fitted on all rows given; the regularisation is that of an inverse strength over the number of rows.
    """
    n = max(1, rows.count())
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="weights", minDocFreq=2),
        LogisticRegression(featuresCol="weights", labelCol="label_index", regParam=1.0 / (strength * n), standardization=False, maxIter=30),
    ]
    return Pipeline(stages=stages).fit(rows)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with predicted_label and confidence."""
    labels = model.stages[0].labels
    names = F.array(*[F.lit(x) for x in labels])
    out = model.transform(rows)
    from pyspark.ml.functions import vector_to_array

    return out.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int"))).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("label_index", "words", "pairs", "terms", "tf", "weights", "rawPrediction", "probability", "prediction")
