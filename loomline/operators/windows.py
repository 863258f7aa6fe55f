"""Count windows, window labels, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLASSES = ("purchase", "signup", "error", "view", "click")
NORMAL = "normal"
#: Partitions a core that numbered lines lie in.
TASKS = 4


def count_windows(df: DataFrame, stream: str, order: list[str], bucket: Column, size: int) -> DataFrame:
    """Number the rows of each stream and cut them into windows of ``size`` rows.

    ``bucket`` must not fall as ``order`` rises (an hour, say). Rows are
    numbered within (stream, bucket), and a running sum over the few bucket
    counts supplies the offsets, so no task sorts a whole stream. The rows stay in
    ``TASKS`` partitions a core, however small: what is done to each line costs more than moving it.
    Adds window_no and log_idx, both from 0.
    """
    df = df.withColumn("_bucket", bucket)
    df = df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, stream, "_bucket")
    counts = df.groupBy(stream, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(stream).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(stream).alias("_stream"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(stream, "_bucket").orderBy(*order)) - 1
    joined = df.join(F.broadcast(offsets), df[stream].eqNullSafe(F.col("_stream")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    return joined.withColumn("_place", place).withColumn("window_no", F.floor(F.col("_place") / size).cast("long")).withColumn("log_idx", F.pmod("_place", F.lit(size)).cast("long")).drop("_bucket", "_stream", "_of", "_before", "_place")


def primary_label(types: Column, known: tuple[str, ...] = CLASSES) -> Column:
    """The first known type of an array, else NORMAL."""
    return F.coalesce(F.get(F.filter(types, lambda t: t.isin(*known)), F.lit(0)), F.lit(NORMAL))


def window_types(lines: DataFrame) -> DataFrame:
    """(wid, types): the types of each window, most frequent first."""
    counts = lines.groupBy("wid", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "event_type")))
    return counts.groupBy("wid").agg(F.transform(ranked, lambda s: s["event_type"]).alias("types"))


def hash_order(key: str, seed: int) -> Column:
    """A pseudo-random order that any engine with md5 repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each label, floor(train * n) rows and floor(val * n) rows in hash order, the rest is test."""
    ranked = _ranked(df, key, label, seed)
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    return ranked.withColumn("split", F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= first + second, "val").otherwise("test")).drop("_rank", "_n")


def _ranked(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds the rank of a row in its label by hash order, and the label's rows ``_n``.

    Rows are ranked within (label, first digits of the hash); a running sum over the
    few counts supplies the offsets, so no task ranks a whole label.
    """
    dealt = df.withColumn("_order", hash_order(key, seed)).withColumn("_deal", F.substring("_order", 1, 3))
    counts = dealt.groupBy(label, "_deal").agg(F.count(F.lit(1)).alias("_rows"))
    by = W.partitionBy(label)
    before = F.sum("_rows").over(by.orderBy("_deal").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(label).alias("_label"), F.col("_deal").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(by).alias("_n"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(label, "_deal").orderBy("_order", key))
    joined = dealt.join(offsets, dealt[label].eqNullSafe(F.col("_label")) & (F.col("_deal") == F.col("_of")))
    return joined.withColumn("_rank", rank).drop("_order", "_deal", "_label", "_of", "_before")


def stratified_sample(df: DataFrame, key: str, label: str, most: int, seed: int = 42) -> DataFrame:
    """About ``most`` rows, each label by its share but one at least."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    quota = counts.crossJoin(total).select(F.col(label).alias("_label"), F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("_n") / F.col("_total"))).alias("_quota"))
    return _ranked(df, key, label, seed).drop("_n").join(quota, df[label].eqNullSafe(F.col("_label"))).where("_rank <= _quota").drop("_rank", "_label", "_quota")


def sample_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of each label in hash order."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(hash_order(key, seed), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
