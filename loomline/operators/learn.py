"""Vectors of texts and a baseline window classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources.chunks import ChunkTable


def text_vectors(texts: DataFrame, text: str, size: int = 256) -> DataFrame:
    """Adds ``features``: hashed word counts with inverse document frequency, unit length. Any encoder of texts may take its place."""
    words = texts.withColumn("_words", F.split(F.lower(F.col(text)), r"\W+"))
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(words)
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counted).transform(counted)
    return Normalizer(inputCol="_weighted", outputCol="features").transform(weighted).drop("_words", "_counts", "_weighted")


def encoder(encode):
    """A pandas UDF of a function from a list of texts to vectors, called once for each Arrow batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encode(texts.tolist())])

    return run


def add_vectors(texts: DataFrame, table: ChunkTable, encode, text: str = "text") -> int:
    """Encode the texts that ``table`` has no vector of, each once, and publish their vectors by the texts' digests."""
    rows = texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn(table.key, F.sha2("text", 256))
    return table.add(rows, lambda new: new.select(table.key, encode(F.col("text")).alias("vector")))


def with_vectors(texts: DataFrame, table: ChunkTable, size: int, text: str = "text") -> DataFrame:
    """Adds ``vector``: of a text without one, ``size`` zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    known = table.read().withColumnRenamed(table.key, "_digest")
    return texts.withColumn("_digest", F.sha2(F.col(text), 256)).join(known, "_digest", "left").drop("_digest").withColumn("vector", F.coalesce("vector", zeros))


def classify(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Predictions of a weighted logistic regression that is trained on the rows of split "train"; adds pred."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    numbered = index.transform(rows)
    weights = numbered.where(F.col(split) == "train").groupBy("_label").agg((F.lit(1.0) / F.count(F.lit(1))).alias("_weight"))
    train = numbered.where(F.col(split) == "train").join(F.broadcast(weights), "_label")
    model = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", maxIter=20, regParam=0.01).fit(train)
    names = F.array(*map(F.lit, index.labels))
    return model.transform(numbered).withColumn("pred", F.element_at(names, F.col("prediction").cast("int") + 1)).drop("_label", "rawPrediction", "probability", "prediction")
