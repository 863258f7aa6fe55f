"""Class weights, losses, pooling and classification reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import STUB
from .evaluate import cites_evidence


def class_weights(labels: DataFrame, cap: float | None = None) -> DataFrame:
    """(label, n, weight): weights total / (classes * n), scaled to sum to the number of classes, then capped."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))  # one row a class
    classes = F.count(F.lit(1)).over(every)
    raw = F.sum("n").over(every) / (classes * F.col("n"))
    out = counts.withColumn("raw", raw).withColumn("classes", classes)
    weight = F.col("raw") * F.col("classes") / F.sum("raw").over(every)
    return out.select("label", "n", F.round(F.least(weight, F.lit(cap)) if cap else weight, 6).alias("weight"))


def confusion(predictions: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """A row for each label, a column for each predicted class."""
    table = predictions.groupBy("label").pivot("pred", list(classes)).agg(F.count(F.lit(1)))
    return table.select("label", *[F.coalesce(F.col(c), F.lit(0)).alias(f"pred_{c}") for c in classes])


def class_report(predictions: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1); a ratio of nothing is 0."""
    ones = predictions.select(F.col("label").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("t")).union(
        predictions.select("pred", F.lit(0), F.lit(1), F.lit(0))
    )
    sums = ones.groupBy(F.col("c").alias("label")).agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hit"))
    precision = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return sums.select("label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro(report: DataFrame) -> DataFrame:
    return report.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def focal_loss(scored: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Mean over rows of -weight * (1 - p)**gamma * ln p, p being the probability of the label."""
    p = F.greatest(F.col("p"), F.lit(1e-12))
    return scored.agg(F.round(F.avg(-F.col("weight") * F.pow(1 - p, F.lit(gamma)) * F.ln(p)), 6).alias("focal_loss"))


def expanded(records: DataFrame, most: int) -> DataFrame:
    """Each record ``count`` times in order of first_ts, the first ``most`` of a window; adds pos from 0."""
    copies = records.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("count", F.lit(1)))))
    pos = F.row_number().over(W.partitionBy("wid").orderBy("first_ts", "first_idx", "template", "copy")) - 1
    return copies.withColumn("pos", pos.cast("long")).where(F.col("pos") < most)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, value): mean of the arrays ``vec`` of each key."""
    return vectors.select(key, F.posexplode("vec").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def attention_pool(rows: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """Sum of values weighted by the softmax of scores within a key."""
    top = rows.groupBy(key).agg(F.max(score).alias("_top"))
    e = F.exp(F.col(score) - F.col("_top"))
    return rows.join(top, key).groupBy(key).agg((F.sum(e * F.col(value)) / F.sum(e)).alias("pooled"))


def lookup_vectors(rows: DataFrame, vectors: DataFrame, key: str, size: int) -> DataFrame:
    """Adds the vector of each key, zeros where there is none, and ``missing``."""
    joined = rows.join(vectors.select(key, "vec"), key, "left")
    return joined.withColumn("missing", F.col("vec").isNull()).withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), size)))


def positional_encoding(size: int, position="pos"):
    """The sinusoids of a position: sine at even places, cosine at odd ones."""
    p = F.col(position).cast("double")
    places = [(F.sin if i % 2 == 0 else F.cos)(p * F.lit(10000.0 ** (-(i - i % 2) / size))) for i in range(size)]
    return F.array(*places)


def report_metrics(reports: DataFrame, by: list[str]) -> DataFrame:
    """Ratios of checked reports by class. Blank ones and stubs count as reports only; citations, keywords and shares are those of the rest.

    ``citation_rate``: reports that hold an id of their evidence literally or a tuple by rank; ``valid_share`` and
    ``real_share``: of the ids cited those in evidence, and those that exist at all. Nothing cited counts as valid.
    """
    real = (F.trim("text") != "") & ~F.col("text").startswith(STUB)
    n_real = F.count_if(real)
    valid, exist, bogus = (F.sum(F.when(real, F.col(c)).otherwise(0)) for c in ("valid_ids", "existing_ids", "bogus_ids"))
    cited = valid + exist + bogus
    rate = lambda what: F.round(F.count_if(real & what) / F.greatest(n_real, F.lit(1)), 6)
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reports"),
        n_real.alias("n_with_report"),
        rate(cites_evidence(F.col("text"), F.col("evidence"))).alias("citation_rate"),
        F.round(F.when(cited > 0, valid / cited).otherwise(1.0), 6).alias("valid_share"),
        F.round(F.when(cited > 0, (valid + exist) / cited).otherwise(1.0), 6).alias("real_share"),
        rate(F.col("hit")).alias("keyword_rate"),
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
    )


def examples(names: DataFrame, kind: str, column: str, k: int) -> DataFrame:
    """(kind, name, n, rank): the k most frequent names of an array column for each kind, ties by name."""
    counts = names.select(kind, F.explode(column).alias("name")).groupBy(kind, "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(kind).orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def mistakes(predictions: DataFrame, label: str) -> DataFrame:
    """Where the rows of one label went wrong, most frequent first."""
    return predictions.where((F.col("label") == label) & (F.col("pred") != label)).groupBy("pred").agg(F.count(F.lit(1)).alias("n"))


def without_counts(records: DataFrame) -> DataFrame:
    """The ablation of counts: each record stands once."""
    return records.withColumn("count", F.lit(1).cast("long"))


#: Kinds of names that a report mentions.
KINDS = ("settings", "commands", "tools", "variables")


def mention_metrics(checked: DataFrame, by: list[str]) -> DataFrame:
    """For each class: names mentioned and unknown by kind with their rate, and reports with an unknown name.

    ``checked`` has an array for each of ``KINDS`` and its ``unknown_`` part. A rate of nothing is 0.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    unknown = sum((size(f"unknown_{k}") for k in KINDS), F.lit(0))
    sums = [F.sum(size(k)).alias(k) for k in KINDS] + [F.sum(size(f"unknown_{k}")).alias(f"unknown_{k}") for k in KINDS]
    out = checked.groupBy(*by).agg(F.count(F.lit(1)).alias("reports"), *sums, F.count_if(unknown > 0).alias("with_unknown"))
    rates = {f"{k}_unknown_rate": F.round(F.col(f"unknown_{k}") / F.greatest(F.col(k), F.lit(1)), 6) for k in KINDS}
    return out.withColumns(rates | {"unknown_report_rate": F.round(F.col("with_unknown") / F.col("reports"), 6)})


def frequent_names(checked: DataFrame, names: str, k: int) -> DataFrame:
    """(name, n): the k most frequent names of an array column, ties by name."""
    counts = checked.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(k)


def citation_metrics(judged: DataFrame, by: list[str]) -> DataFrame:
    """Citations by id and by rank for each class, and the shares of valid and of bogus ones; a share of nothing is 0."""
    ids = F.sum(F.col("valid_ids") + F.col("existing_ids") + F.col("bogus_ids"))
    ranks = F.sum(F.col("valid_ranks") + F.col("invalid_ranks"))
    share = lambda part, whole: F.round(F.sum(part) / F.greatest(whole, F.lit(1)), 6)
    return judged.groupBy(*by).agg(
        ids.alias("id_cites"), F.sum("valid_ids").alias("valid_ids"), F.sum("existing_ids").alias("existing_ids"), F.sum("bogus_ids").alias("bogus_ids"),
        share("valid_ids", ids).alias("id_valid_rate"), share("bogus_ids", ids).alias("id_bogus_rate"),
        ranks.alias("rank_cites"), F.sum("valid_ranks").alias("valid_ranks"), F.sum("invalid_ranks").alias("invalid_ranks"), share("valid_ranks", ranks).alias("rank_valid_rate"),
    )


def retrieval_hits(evidence: DataFrame, by: str) -> DataFrame:
    """For each label: windows whose first piece of evidence, and whose any piece, is of their class; input has (wid, label, rank, class)."""
    right = F.col("class") == F.col("label")
    windows = evidence.groupBy("wid", by).agg(F.max(F.when(F.col("rank") == 1, right)).alias("top1"), F.max(right).alias("topk"))
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 6)
    return windows.groupBy(by).agg(F.count(F.lit(1)).alias("windows"), F.count_if("top1").alias("top1"), F.count_if("topk").alias("topk"), rate("top1").alias("top1_pct"), rate("topk").alias("topk_pct"))
