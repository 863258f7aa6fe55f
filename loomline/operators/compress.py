"""Window compression to counted template groups, coverage and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the mask puts in place of a variable part.
HOLE = "<*>"


def template_mask(text: Column) -> Column:
    """The template of a message: addresses, hexadecimal ids and numbers become holes."""
    text = F.regexp_replace(text, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", HOLE)
    return F.regexp_replace(text, r"0x[0-9a-fA-F]+|\d+", HOLE)


def compress_windows(records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each (wid, template): count, first and last line and time, sorted entity set, threads.

    ``records`` has wid, log_idx, ts_s, raw_line, template, thread and
    entities (array of strings). Groups need not be consecutive. The thread is
    that of the first line, else the least of the others; the rest are extra.
    """
    order = F.struct("ts_s", "log_idx")
    first_thread = F.coalesce(F.min_by("thread", order), F.min("thread"))
    out = records.groupBy("wid", "template").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("raw_line", order).alias("raw_line"), F.max_by("raw_line", order).alias("raw_line_last"),
        F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"), F.min("log_idx").alias("first_idx"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"),
        first_thread.alias("thread"), F.array_sort(F.collect_set("thread")).alias("threads"),
        *[F.min(c).alias(c) for c in extra or []],
    )
    return out.withColumn("extra_threads", F.array_except("threads", F.array("thread"))).drop("threads")


def compress_runs(records: DataFrame) -> DataFrame:
    """Like compress_windows for runs of consecutive lines of one template: gaps and islands."""
    by = W.partitionBy("wid").orderBy("ts_s", "log_idx")
    starts = F.when(F.col("template").eqNullSafe(F.lag("template").over(by)), 0).otherwise(1)
    runs = records.withColumn("_start", starts).withColumn("run", F.sum("_start").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("wid", "run").agg(F.min("template").alias("template"), F.count(F.lit(1)).alias("count"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"))


def percentiles(values: DataFrame, label: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each label the value at floor(share * n) of its sorted values: exact percentiles by index.

    Equal values are counted first, so what is ordered has a row for each distinct value.
    """
    counts = values.groupBy(label, value).agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy(label)
    counts = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    return counts.groupBy(label).agg(*[F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * share), F.col(value))).alias(name) for name, share in shares.items()])


def compression_stats(compressed: DataFrame, labels: DataFrame) -> DataFrame:
    """For each label: windows, lines before and after, share kept, and percentiles of records by window."""
    sizes = compressed.groupBy("wid").agg(F.sum("count").alias("before"), F.count(F.lit(1)).alias("after"))
    sizes = sizes.join(labels, "wid")
    stats = sizes.groupBy("label").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("before").alias("lines"), F.sum("after").alias("records"),
        F.round(F.sum("after") / F.sum("before"), 6).alias("kept"), F.round(F.avg("after"), 6).alias("mean_records"),
    )
    return stats.join(percentiles(sizes, "label", "after", {"p50": 0.5, "p90": 0.9}), "label")


def token_frequency(lines_tokens: DataFrame) -> DataFrame:
    """(token, n): in how many lines each token stands; input has (line, tokens)."""
    return lines_tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def entity_coverage(window_entities: DataFrame) -> DataFrame:
    """(entity_type, entity, coverage): in how many windows each entity stands."""
    return window_entities.select("wid", "entity_type", "entity").distinct().groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("coverage"))


def coverage_filter(window_entities: DataFrame, coverage: DataFrame, least: int) -> DataFrame:
    """Entities that stand in ``least`` covered windows or more."""
    return window_entities.join(coverage.where(F.col("coverage") >= least).select("entity_type", "entity"), ["entity_type", "entity"], "left_semi")


def frequency_levels(line_entities: DataFrame, line_counts: DataFrame) -> DataFrame:
    """For each entity of a window: lines with it, percent of the window's lines, and a level: over 50 high, over 10 medium."""
    counts = line_entities.select("wid", "log_idx", "entity_type", "entity").distinct().groupBy("wid", "entity_type", "entity").agg(F.count(F.lit(1)).alias("lines"))
    percent = F.col("lines") * 100.0 / F.col("total")
    level = F.when(percent > 50, "high").when(percent > 10, "medium").otherwise("low")
    return counts.join(line_counts, "wid").select("wid", "entity_type", "entity", "lines", F.round(percent, 2).alias("percent"), level.alias("level"))
