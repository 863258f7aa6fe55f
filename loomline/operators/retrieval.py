"""Vector retrieval over a knowledge base, texts for prompts, and clusters of equal evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block of queries and of the base; a pair of blocks is one matrix product.
QUERY_BLOCK, BASE_BLOCK = 1024, 4096


def _best(rank: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, ties by id."""
    kth = np.partition(rank, -k, axis=1)[:, -k] if rank.shape[1] > k else np.full(len(rank), -np.inf)
    row, col = np.nonzero(rank >= kth[:, None])
    order = np.lexsort((ids[col], -rank[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(rank)))
    best = np.arange(len(row)) - first[row] < k
    return row[best], col[best]


def _matrix(vectors: pa.ListScalar) -> np.ndarray:
    rows = vectors.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def cosine_topk(queries: DataFrame, base: DataFrame, k: int, on: str | None = None, boost: Column | None = None) -> DataFrame:
    """The k entries of the base most similar to each query.

    ``queries`` has (qid, qvec), ``base`` (id, vec), vectors of unit length and of one size; both
    have ``on`` if a class must agree. ``boost``, of the base's columns, multiplies the rank, not
    the reported similarity. Ties go by id. Vectors that are null are no one's neighbour.

    Both sides are dealt into blocks by hash. A pair of blocks is a matrix product that keeps
    the k best of each query, and the best of all blocks are merged: nothing holds all pairs, and a
    class of any size is as many blocks as it takes.
    """
    n_queries, n_base = (-(-df.count() // size) or 1 for df, size in ((queries, QUERY_BLOCK), (base, BASE_BLOCK)))
    same = [on] if on else []
    left = queries.where("qvec is not null").withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(n_queries))).groupBy(*same, "_q").agg(F.collect_list(F.struct("qid", "qvec")).alias("_left"))
    right = base.where("vec is not null").withColumn("_boost", (boost if boost is not None else F.lit(1.0)).cast("double")).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n_base)))
    right = right.groupBy(*same, "_b").agg(F.collect_list(F.struct("id", "vec", "_boost")).alias("_right"))
    pairs = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1)))).join(right, [*same, "_b"])
    blocks = pairs.select("_left.qid", "_left.qvec", "_right.id", "_right.vec", "_right._boost")
    kinds = dict(queries.dtypes) | dict(base.dtypes)
    schema = f"qid {kinds['qid']}, id {kinds['id']}, sim double, _rank double"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qid, qvec, ids, vec, weight = (batch.column(c)[i] for c in range(5))
                sim = _matrix(qvec) @ _matrix(vec).T
                rank = np.round(sim * weight.values.to_numpy(zero_copy_only=False), 9)
                row, col = _best(rank, np.unique(ids.values.to_numpy(zero_copy_only=False), return_inverse=True)[1], k)
                yield pa.RecordBatch.from_arrays([qid.values.take(pa.array(row)), ids.values.take(pa.array(col)), pa.array(sim[row, col]), pa.array(rank[row, col])], ["qid", "id", "sim", "_rank"])

    merged = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("_rank"), "id"))
    best = blocks.mapInArrow(run, schema).withColumn("rank", merged.cast("long")).where(F.col("rank") <= k)
    return best.select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


def entry_text(df: DataFrame) -> Column:
    """A knowledge entry as one passage; empty lists are left out."""
    def line(label: str, column: str, sep: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label + ": "), F.array_join(column, sep)))

    given = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for label, c in (("Title", "title"), ("Symptom", "symptom"), ("Root cause", "root_cause"))]
    return F.concat_ws("\n", *given, line("Fix", "fix", " | "), line("Anomaly classes", "classes", ", "), line("Subsystems", "subsystems", ", "), line("Tags", "tags", ", "))


def window_context(records: DataFrame, k: int = 5, width: int = 200) -> DataFrame:
    """(wid, log_count_original, log_count, top_templates): the k most frequent templates as lines, ties by first line."""
    rank = F.row_number().over(W.partitionBy("wid").orderBy(F.desc("count"), "first_idx", "template"))
    totals = records.groupBy("wid").agg(F.sum("count").alias("log_count_original"), F.count(F.lit(1)).alias("log_count"))
    line = F.concat(F.lit("  [x"), F.col("count"), F.lit("] "), F.substring("template", 1, width))
    top = records.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("line", line)
    lines = top.groupBy("wid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("top_templates"))
    return totals.join(lines, "wid")


def frequent_entities(line_entities: DataFrame, k: int) -> DataFrame:
    """(wid, entities): the k most frequent entity values of a window as "value(xN)" joined by commas."""
    counts = line_entities.select("wid", "log_idx", "entity").distinct().groupBy("wid", "entity").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("wid").orderBy(F.desc("n"), "entity"))
    named = counts.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("text", F.concat("entity", F.lit("(x"), "n", F.lit(")")))
    return named.groupBy("wid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), ", ").alias("entities"))


def retrieval_query(contexts: DataFrame) -> Column:
    """The query text of a window with label, top_templates and entities."""
    head = F.concat(F.lit("Predicted anomaly: "), F.col("label"))
    tail = F.when(F.col("entities").isNotNull(), F.concat(F.lit("Frequent entities: "), F.col("entities")))
    return F.concat_ws("\n", head, F.lit("Top log templates by count:"), "top_templates", tail)


def fingerprint_clusters(evidence: DataFrame, n: int) -> DataFrame:
    """Windows with the same label and the same set of top n evidence ids.

    ``evidence`` has (wid, label, id, sim, rank). Each cluster's representative
    has the best first similarity, ties by wid; clusters are numbered by size.
    """
    tops = evidence.where(F.col("rank") <= n).groupBy("wid", "label").agg(F.array_join(F.sort_array(F.collect_list("id")), "|").alias("fingerprint"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("score"))
    clusters = tops.groupBy("label", "fingerprint").agg(F.count(F.lit(1)).alias("size"), F.min_by("wid", F.struct((-F.col("score")).alias("s"), "wid")).alias("representative"))
    number = F.row_number().over(W.orderBy(F.desc("size"), "label", "fingerprint"))  # one row a cluster
    named = clusters.withColumn("cluster", number.cast("long"))
    return tops.join(named, ["label", "fingerprint"]).select("wid", "label", "fingerprint", "cluster", "size", (F.col("wid") == F.col("representative")).alias("is_representative"))


def evidence_block(evidence: DataFrame, key: str, width: int = 300, most_fixes: int = 4) -> DataFrame:
    """(key, evidence): pieces of evidence in order of rank as one passage for a prompt.

    ``evidence`` has rank, sim and the fields of an entry. Fixed values: the layout below.
    """
    text = lambda c: F.substring(F.coalesce(c, F.lit("(none)")), 1, width)
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    fixes = F.array_join(F.slice("fix", 1, most_fixes), "\n      ")
    sim = F.format_string("%.3f", F.floor(F.col("sim") * 1000 + 0.5) / 1000)
    piece = F.concat(
        F.lit("## Tuple "), F.col("rank").cast("string"), F.lit(": `"), F.col("id"), F.lit("` (sim="), sim, F.lit(")\n- Source: "), F.coalesce("source", F.lit("None")),
        F.lit("\n- Title: "), F.coalesce("title", F.lit("None")), F.lit("\n- Symptom: "), text("symptom"), F.lit("\n- Root cause: "), text("root_cause"),
        F.lit("\n- Fix:\n      "), F.coalesce(F.nullif(fixes, F.lit("")), F.lit("(no explicit fix)")),
        F.lit("\n- Anomaly classes: "), listed("classes"), F.lit("\n- Subsystems: "), listed("subsystems"), F.lit("\n"),
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", piece.alias("piece"))))
    return evidence.groupBy(key).agg(F.array_join(F.transform(ranked, lambda s: s["piece"]), "\n").alias("evidence"))


def prompt(contexts: DataFrame, actions_only: bool = False) -> Column:
    """The prompt of a window with label, counts, top_templates, entities and evidence: for an explanation, or for actions alone."""
    head = F.concat(F.lit("Predicted anomaly: "), F.col("label"))
    window = F.concat(F.lit("Log lines: "), F.col("log_count_original").cast("string"), F.lit(" in "), F.col("log_count").cast("string"), F.lit(" records"))
    entities = F.concat(F.lit("Frequent entities: "), F.coalesce("entities", F.lit("(none)")))
    task = "List the actions to take, each with the tuple that supports it." if actions_only else "Explain the anomaly, its root cause and the actions to take. Cite tuples as (see ID)."
    facts = [head] if actions_only else [head, window, F.lit("Top log templates by count:"), F.col("top_templates"), entities]
    return F.concat_ws("\n", *facts, F.lit("Evidence:"), F.coalesce("evidence", F.lit("(none)")), F.lit(task))


def cluster_ratio(clusters: DataFrame) -> DataFrame:
    """(label, windows, clusters, ratio) of clustered windows."""
    return clusters.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("cluster").alias("clusters"), F.round(F.count(F.lit(1)) / F.count_distinct("cluster"), 6).alias("ratio"))
