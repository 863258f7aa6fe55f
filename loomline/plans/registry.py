"""Every registered query of the library itself, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import names
from ..operators import compress, evaluate, generate, graph, learn, measure, network, retrieval, templates, train, windows
from ..operators.windows import CLASSES
from ..session import scratch_folder, written
from ..sources import eventlog, knowledge, one_object
from ..sources.chunks import ChunkTable
from ..streaming import windows as streams
from .twins import CONSENSUS, CORPUS_TOKENS, ENTITIES, LABELS, LINES, MASK, RECORDS, THREAD, found, q, scores, thread_group

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Windows of an entity from which on it counts as hot (neighbours are the same for any number), neighbours kept.
MOST_WINDOWS, NEIGHBORS = 40, 4


def query(sql: str | None = None):
    """Register a query under its function's name, with its twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _labels(lines: DataFrame) -> DataFrame:
    return windows.window_types(lines).withColumn("label", windows.primary_label(F.col("types")))


def _entities(lines: DataFrame) -> DataFrame:
    return E.entity_rows(lines, ["wid", "log_idx"])


def _records(lines: DataFrame) -> DataFrame:
    """Lines with thread, template and entities. Message and thread group are columns first, so each is found once and not by every pattern."""
    line = F.col("raw_line")
    staged = lines.select("wid", "log_idx", "ts_s", "raw_line", E.thread(line).alias("thread"), E.message(line).alias("_text"))
    staged = staged.withColumns({"_group": E.normal_thread(F.col("thread")), "_low": F.lower(line), "_low_text": F.lower("_text")})
    named = F.transform(E.clean_entities(line, *map(F.col, ("_text", "_group", "_low", "_low_text"))), lambda e: F.concat_ws(":", e["type"], e["value"]))
    return staged.select("wid", "log_idx", "ts_s", "raw_line", "thread", compress.template_mask(F.col("_text")).alias("template"), named.alias("entities"))


def _compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.compress_windows(_records(eventlog.lines(spark, sf_dir)))


def _window_entity(lines: DataFrame) -> DataFrame:
    return _entities(lines).select("wid", F.concat_ws(":", "entity_type", "entity").alias("entity")).distinct()


_WE = f"WITH {ENTITIES}, we AS (SELECT DISTINCT wid, entity_type || ':' || entity AS entity FROM ents)"


# Windows, labels, splits


@query(f"WITH {LINES} SELECT stream, wid, log_idx, event_id, raw_line FROM lines")
def count_windows(spark, sf_dir):
    return eventlog.lines(spark, sf_dir).select("stream", "wid", "log_idx", "event_id", "raw_line")


@query(f"WITH {LINES}, {LABELS} SELECT wid, array_to_string(types, ',') AS types, label FROM labelled")
def primary_label(spark, sf_dir):
    return _labels(eventlog.lines(spark, sf_dir)).select("wid", F.array_join("types", ",").alias("types"), "label")


_SPLIT = f"""WITH {LINES}, {LABELS}, r AS (SELECT wid, label, count(*) OVER (PARTITION BY label) AS n,
 row_number() OVER (PARTITION BY label ORDER BY md5('42:' || wid), wid) AS i FROM labelled),
split AS (SELECT wid, label, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _split(lines: DataFrame) -> DataFrame:
    return windows.stratified_split(_labels(lines).select("wid", "label"), "wid", "label")


@query(_SPLIT + " SELECT * FROM split")
def stratified_split(spark, sf_dir):
    return _split(eventlog.lines(spark, sf_dir))


@query(_SPLIT + " SELECT label, split, count(*) AS n FROM split GROUP BY ALL")
def split_counts(spark, sf_dir):
    return _split(eventlog.lines(spark, sf_dir)).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


_RANKED = f"WITH {LINES}, {LABELS}, r AS (SELECT wid, label, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || wid), wid) AS i FROM labelled)"


@query(_RANKED + " SELECT wid, label FROM r WHERE i <= greatest(1, floor(20 * n / total))")
def stratified_sample(spark, sf_dir):
    return windows.stratified_sample(_labels(eventlog.lines(spark, sf_dir)).select("wid", "label"), "wid", "label", 20)


@query(_RANKED + " SELECT wid, label FROM r WHERE i <= 2")
def sample_per_class(spark, sf_dir):
    return windows.sample_per_class(_labels(eventlog.lines(spark, sf_dir)).select("wid", "label"), "wid", "label", 2)


# Lines, templates, compression


@query(f"WITH {LINES} SELECT event_id, thread, msg AS message FROM said")
def message_strip(spark, sf_dir):
    return eventlog.lines(spark, sf_dir).select("event_id", E.thread(F.col("raw_line")).alias("thread"), E.message(F.col("raw_line")).alias("message"))


@query(f"WITH {LINES} SELECT {MASK} AS template, count(*) AS size FROM said GROUP BY ALL")
def template_catalog(spark, sf_dir):
    return eventlog.lines(spark, sf_dir).groupBy(compress.template_mask(E.message(F.col("raw_line"))).alias("template")).agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH {ENTITIES}, {RECORDS} SELECT wid, template, count, raw_line, raw_line_last, first_ts, last_ts, array_to_string(entities, '|') AS entities FROM comp")
def window_compress(spark, sf_dir):
    return _compressed(spark, sf_dir).select("wid", "template", "count", "raw_line", "raw_line_last", "first_ts", "last_ts", F.array_join("entities", "|").alias("entities"))


@query(f"""WITH {LINES}, m AS (SELECT wid, log_idx, ts_s, {MASK} AS template FROM said),
 s AS (SELECT *, CASE WHEN template IS NOT DISTINCT FROM lag(template) OVER (PARTITION BY wid ORDER BY ts_s, log_idx) THEN 0 ELSE 1 END AS st FROM m),
 r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY wid ORDER BY ts_s, log_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s)
 SELECT wid, run, min(template) AS template, count(*) AS count, min(ts_s) AS first_ts, max(ts_s) AS last_ts FROM r GROUP BY wid, run""")
def window_compress_runs(spark, sf_dir):
    return compress.compress_runs(_records(eventlog.lines(spark, sf_dir)))


@query(f"""WITH {ENTITIES}, {RECORDS}, {LABELS}, z AS (SELECT wid, sum(count) AS b, count(*) AS a FROM comp GROUP BY wid)
 SELECT label, count(*) AS windows, CAST(sum(b) AS BIGINT) AS lines, CAST(sum(a) AS BIGINT) AS records, round(sum(a) / sum(b), 6) AS kept, round(avg(a), 6) AS mean_records,
 list_sort(list(a))[CAST(floor(count(*) * 0.5::DOUBLE) AS INT) + 1] AS p50, list_sort(list(a))[CAST(floor(count(*) * 0.9::DOUBLE) AS INT) + 1] AS p90 FROM z JOIN labelled USING (wid) GROUP BY label""")
def compress_stats_by_class(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    return compress.compression_stats(compress.compress_windows(_records(lines)), _labels(lines).select("wid", "label"))


# Entities, tokens, coverage


@query(f"""WITH {LINES}, s AS (SELECT event_id, raw_line, thread, {found(E.PEER, 2)} AS pn, {found(E.PEER, 1)} AS pi, {found(E.NODE_ID)} AS own, nullif(regexp_extract(raw_line, {q(E.ENDPOINT_IP)}, 1), '') AS ip FROM said)
 SELECT event_id, array_to_string(list_sort(list_distinct({found(E.REGION)} || {found(E.REGION_TO_IP)})), ',') AS regions,
 array_to_string(list_sort(list_distinct(own || pn)), ',') AS nodes,
 array_to_string(list_sort(list_distinct(list_transform(list_zip(pn, pi), lambda x: x[1] || '=' || x[2]) || CASE WHEN ip IS NULL THEN [] ELSE list_transform(list_filter(own, lambda n: NOT list_contains(pn, n)), lambda n: n || '=' || ip) END)), ',') AS node_ips,
 array_to_string(list_sort(list_distinct({CONSENSUS})), ',') AS groups, thread FROM s""")
def entities_structured(spark, sf_dir):
    parts = E.structured(F.col("raw_line"))
    return eventlog.lines(spark, sf_dir).select("event_id", *[F.array_join(parts[k], ",").alias(k) for k in ("regions", "nodes", "node_ips", "groups")], parts["thread"].alias("thread"))


@query(f"WITH {LINES} SELECT DISTINCT thread, {thread_group('thread')} AS thread_group FROM said")
def thread_normalize(spark, sf_dir):
    thread = E.thread(F.col("raw_line"))
    return eventlog.lines(spark, sf_dir).select(thread.alias("thread"), E.normal_thread(thread).alias("thread_group")).distinct()


@query("WITH " + LINES + ", t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS subsystem FROM said WHERE regexp_matches(msg, {q(p)})" for n, p in E.SUBSYSTEMS) + ") SELECT subsystem, count(*) AS n FROM t GROUP BY ALL")
def subsystem_tags(spark, sf_dir):
    return eventlog.lines(spark, sf_dir).select(F.explode(E.subsystems(E.message(F.col("raw_line")))).alias("subsystem")).groupBy("subsystem").agg(F.count(F.lit(1)).alias("n"))


def _tokens(spark, sf_dir):
    return compress.token_frequency(eventlog.lines(spark, sf_dir).select(E.corpus_tokens(E.message(F.col("raw_line"))).alias("tokens")))


_DF = f"WITH {LINES}, t AS (SELECT unnest({CORPUS_TOKENS}) AS token FROM said), df AS (SELECT token, count(*) AS n, len(regexp_extract_all(token, '[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9]+')) AS complexity FROM t GROUP BY token)"


@query(_DF + " SELECT token, n, complexity FROM df")
def token_df(spark, sf_dir):
    return _tokens(spark, sf_dir).withColumn("complexity", E.token_complexity(F.col("token")))


@query(_DF + " SELECT token, n FROM df WHERE n >= 5 AND complexity >= 2")
def valid_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).where((F.col("n") >= 5) & (E.token_complexity(F.col("token")) >= 2))


@query(_DF + f""", l AS (SELECT event_id, {CORPUS_TOKENS} AS tokens FROM said), v AS (SELECT list(token) AS valid FROM df WHERE n >= 5 AND complexity >= 2),
 x AS (SELECT event_id, unnest(tokens) AS token FROM l) SELECT event_id, string_agg(token, ',' ORDER BY token) AS statistical FROM x WHERE token IN (SELECT token FROM df WHERE n >= 5 AND complexity >= 2) GROUP BY event_id""")
def statistical_entities(spark, sf_dir):
    rows = eventlog.lines(spark, sf_dir).select("event_id", F.explode(E.corpus_tokens(E.message(F.col("raw_line")))).alias("token"))
    valid = valid_tokens(spark, sf_dir).select("token")
    return rows.join(valid, "token", "left_semi").groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list("token")), ",").alias("statistical"))


@query(f"WITH {ENTITIES} SELECT entity_type, entity, count(*) AS n FROM ents GROUP BY ALL")
def entities_clean(spark, sf_dir):
    return _entities(eventlog.lines(spark, sf_dir)).groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("n"))


_COVERED = _SPLIT.replace(LINES, ENTITIES) + ", cov AS (SELECT entity_type, entity, count(DISTINCT wid) AS coverage FROM ents JOIN split USING (wid) WHERE split = 'train' GROUP BY ALL)"


def _train_coverage(lines, entities=None):
    train = _split(lines).where("split = 'train'").select("wid")
    return compress.entity_coverage((entities or _entities(lines)).join(train, "wid", "left_semi"))


@query(_COVERED + " SELECT * FROM cov")
def entity_coverage(spark, sf_dir):
    return _train_coverage(_numbered(spark, sf_dir))


@query(_SPLIT.replace(LINES, ENTITIES.replace("ents AS (", "ents AS MATERIALIZED (")) + """, frequent AS MATERIALIZED (SELECT entity_type, entity FROM (SELECT DISTINCT entity_type, entity, wid FROM ents) WHERE wid IN (SELECT wid FROM split WHERE split = 'train') GROUP BY ALL HAVING count(*) >= 2)
 SELECT wid, log_idx, entity_type, entity FROM ents JOIN frequent USING (entity_type, entity)""")
def coverage_filter(spark, sf_dir):
    lines = _numbered(spark, sf_dir)
    entities = _entities(lines)
    return compress.coverage_filter(entities, _train_coverage(lines, entities), 2).select("wid", "log_idx", "entity_type", "entity")


@query(_COVERED + " SELECT l.wid, count(*) AS lines, count(*) FILTER (WHERE k.wid IS NULL) AS without FROM lines l LEFT JOIN (SELECT DISTINCT wid, log_idx FROM ents SEMI JOIN (SELECT * FROM cov WHERE coverage >= 20) c USING (entity_type, entity)) k ON l.wid = k.wid AND l.log_idx = k.log_idx GROUP BY l.wid")
def zero_entity_records(spark, sf_dir):
    lines = _numbered(spark, sf_dir)
    entities = _entities(lines)
    kept = compress.coverage_filter(entities, _train_coverage(lines, entities), 20).select("wid", "log_idx").distinct().withColumn("has", F.lit(1))
    return lines.join(kept, ["wid", "log_idx"], "left").groupBy("wid").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("has").isNull()).alias("without"))


@query(f"""WITH {ENTITIES}, t AS (SELECT wid, count(*) AS total FROM lines GROUP BY wid), c AS (SELECT wid, entity_type, entity, count(*) AS lines FROM ents GROUP BY ALL)
 SELECT wid, entity_type, entity, c.lines, round(c.lines * 100.0::DOUBLE / total, 2) AS percent, CASE WHEN c.lines * 100.0::DOUBLE / total > 50 THEN 'high' WHEN c.lines * 100.0::DOUBLE / total > 10 THEN 'medium' ELSE 'low' END AS level FROM c JOIN t USING (wid)""")
def entity_frequency_levels(spark, sf_dir):
    lines = _numbered(spark, sf_dir)
    return compress.frequency_levels(_entities(lines), lines.groupBy("wid").agg(F.count(F.lit(1)).alias("total")))


# Graph


_NODES = f"""WITH {ENTITIES}, {LABELS}, nodes AS (SELECT 'Window' AS node_type, 'Window:' || wid AS node_id, wid AS content FROM labelled
 UNION SELECT 'Anomaly', 'Anomaly:' || label, label FROM labelled UNION SELECT 'LogInstance', 'LogInstance:' || wid || '_' || log_idx, left(raw_line, 200) FROM lines
 UNION SELECT entity_type, entity_type || ':' || entity, entity FROM ents),
 edges AS (SELECT 'Window:' || wid AS src, 'LogInstance:' || wid || '_' || log_idx AS dst, 'CONTAINS' AS relation FROM lines
 UNION SELECT 'Window:' || wid, entity_type || ':' || entity, 'CONTAINS' FROM ents UNION SELECT 'LogInstance:' || wid || '_' || log_idx, entity_type || ':' || entity, 'ASSOCIATED_WITH' FROM ents
 UNION SELECT 'Window:' || wid, 'Anomaly:' || label, 'HAS_ANOMALY' FROM labelled)"""


def _numbered(spark, sf_dir):
    """Lines with their windows and entities, numbered and found once for all branches of a plan.

    Entities are found before lines are written: there are several tasks a core there, but small files are read back by one.
    """
    return written(E.with_entities(eventlog.lines(spark, sf_dir), ["wid", "log_idx", "event_type", "raw_line"]))


def _graph(spark, sf_dir):
    """Nodes and edges of lines that are numbered once."""
    lines = _numbered(spark, sf_dir)
    labels, ents = _labels(lines).select("wid", "label"), _entities(lines)
    return graph.nodes(labels, lines, ents), graph.edges(labels, lines, ents)


@query(_NODES + " SELECT * FROM nodes")
def kg_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(_NODES + " SELECT * FROM edges")
def kg_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(_NODES + " SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY ALL")
def kg_stats(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    count = F.count(F.lit(1)).alias("n")
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(count).union(edges.groupBy(F.lit("edge"), "relation").agg(count))


@query(_NODES + " SELECT dst AS src, src AS dst, 'REVERSE_ASSOCIATED_WITH' AS relation FROM edges WHERE relation = 'ASSOCIATED_WITH'")
def reverse_edges(spark, sf_dir):
    return graph.reverse(_graph(spark, sf_dir)[1], "ASSOCIATED_WITH")


@query(f"""WITH {ENTITIES} SELECT DISTINCT r.entity AS region, g.entity AS consensus_group FROM ents r JOIN ents g ON r.entity_type = 'DataRegion' AND g.entity_type = 'ConsensusGroup'
 AND regexp_extract(r.entity, '^DataRegion:([0-9]+)$', 1) = regexp_extract(g.entity, '^DataRegion:([0-9]+)$', 1) AND regexp_extract(r.entity, '^DataRegion:([0-9]+)$', 1) <> ''""")
def belongs_to(spark, sf_dir):
    return graph.belongs_to(_entities(eventlog.lines(spark, sf_dir)))


@query(_WE + " SELECT entity, left(md5(wid), 2) AS block, count(*) AS windows, string_agg(wid, ',' ORDER BY wid) AS wids FROM we GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return graph.postings(_window_entity(eventlog.lines(spark, sf_dir)))


@query(_WE + f" SELECT entity, count(*) AS coverage FROM we GROUP BY entity HAVING count(*) > {MOST_WINDOWS}")
def hot_entities(spark, sf_dir):
    return graph.hot_entities(_window_entity(eventlog.lines(spark, sf_dir)), MOST_WINDOWS)


@query(_WE + f", {scores()} SELECT wid, neighbor, score, rank FROM ranked WHERE rank <= {NEIGHBORS}")
def window_topk_neighbors(spark, sf_dir):
    return graph.top_neighbors(graph.shared_entity_scores(_window_entity(eventlog.lines(spark, sf_dir)), MOST_WINDOWS, NEIGHBORS), NEIGHBORS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_topk_neighbors(spark, sf_dir)


_SAME = _WE.replace("we AS (SELECT DISTINCT wid, ", f"{LABELS}, we AS (SELECT DISTINCT wid, label, ").replace("FROM ents)", "FROM ents JOIN labelled USING (wid))")


@query(_SAME + f", {scores('AND a.label = b.label')} SELECT wid, neighbor, score, rank FROM ranked WHERE rank <= {NEIGHBORS}")
def sameclass_neighbors(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    known = _window_entity(lines).join(_labels(lines).select("wid", "label"), "wid")
    return graph.top_neighbors(graph.shared_entity_scores(known, MOST_WINDOWS, NEIGHBORS, ["label"]), NEIGHBORS)


def _with_split(sql: str) -> str:
    return sql.replace(ENTITIES, _SPLIT.removeprefix("WITH ").replace(LINES, ENTITIES))


@query(_with_split(_WE) + f""", {scores()} SELECT wid, neighbor, score, rank, row_number() OVER (PARTITION BY wid ORDER BY score DESC, neighbor) AS pool_rank FROM
 (SELECT r.* FROM ranked r JOIN split s ON s.wid = r.neighbor WHERE r.rank <= 20 AND s.split <> 'test') QUALIFY pool_rank <= {NEIGHBORS}""")
def pool_neighbors(spark, sf_dir):
    """The index keeps 20 neighbours; of these, those of the pool that is allowed. Cut first, then filtered."""
    lines = eventlog.lines(spark, sf_dir)
    index = graph.top_neighbors(graph.shared_entity_scores(_window_entity(lines), MOST_WINDOWS, 20), 20)
    pool = _split(lines).where("split <> 'test'").select(F.col("wid").alias("neighbor"))
    return graph.top_neighbors(index.withColumnRenamed("rank", "index_rank").join(pool, "neighbor", "left_semi"), NEIGHBORS).select("wid", "neighbor", "score", F.col("index_rank").alias("rank"), F.col("rank").alias("pool_rank"))


_EGO = _WE + f""", {scores()}, tg AS (SELECT wid AS target, neighbor AS wid FROM ranked WHERE rank <= {NEIGHBORS} UNION SELECT wid, wid FROM lines),
 le AS (SELECT wid, log_idx, entity_type || ':' || entity AS entity FROM ents), ego AS (SELECT DISTINCT target, wid, log_idx, entity FROM tg JOIN le USING (wid)),
 num AS (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY wid) - 1 AS window_no, dense_rank() OVER (PARTITION BY target ORDER BY wid, log_idx) - 1 AS line_no, dense_rank() OVER (PARTITION BY target ORDER BY entity) - 1 AS entity_no FROM ego)"""


def _ego(spark, sf_dir):
    """(target, wid) of each window's subgraph, and (wid, log_idx, entities) of the lines, named before they are written."""
    named = F.array_distinct(F.transform("found", lambda e: F.concat_ws(":", e["type"], e["value"])))
    sets = written(E.with_entities(eventlog.lines(spark, sf_dir), ["wid", "log_idx"]).select("wid", "log_idx", named.alias("entities")))
    held = sets.select("wid", F.explode_outer("entities").alias("entity")).where("entity is not null").distinct()
    near = written(graph.top_neighbors(graph.shared_entity_scores(held, MOST_WINDOWS, NEIGHBORS), NEIGHBORS))
    return near.select(F.col("wid").alias("target"), F.col("neighbor").alias("wid")).union(sets.select("wid", "wid").distinct()), sets


@query(_EGO + " SELECT target, wid, log_idx, entity, window_no, line_no, entity_no FROM num")
def ego_subgraph_edges(spark, sf_dir):
    return graph.ego_edges(*_ego(spark, sf_dir))


@query(_EGO + " SELECT target, count(DISTINCT wid) AS windows, count(DISTINCT (wid, log_idx)) AS lines, count(DISTINCT entity) AS entities, count(*) AS edges FROM num GROUP BY target HAVING count(DISTINCT wid) + count(DISTINCT (wid, log_idx)) + count(DISTINCT entity) <= 200000")
def ego_subgraph_sizes(spark, sf_dir):
    sizes = graph.ego_sizes(*_ego(spark, sf_dir))
    return sizes.where(F.col("windows") + F.col("lines") + F.col("entities") <= 200_000)


@query(_EGO + " SELECT target, log_idx, entity, dense_rank() OVER (PARTITION BY target ORDER BY log_idx) - 1 AS line_no, dense_rank() OVER (PARTITION BY target ORDER BY entity) - 1 AS entity_no FROM ego WHERE wid = target")
def single_window_strip(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    own = lines.select("wid", "wid").distinct().toDF("target", "wid")
    return graph.ego_edges(own, _entities(lines).select("wid", "log_idx", F.concat_ws(":", "entity_type", "entity").alias("entity"))).select("target", "log_idx", "entity", "line_no", "entity_no")


@query("SELECT user_id AS node_id, event_type AS key, arg_max(props, event_id) AS value FROM events WHERE props IS NOT NULL GROUP BY ALL")
def node_upsert_merge(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return graph.upsert(events.select(F.col("user_id").alias("node_id"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("at")))


@query("SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def edge_multiset(spark, sf_dir):
    """Edges with multiplicity, the shape of a compressed record, over a large table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(_SPLIT + " SELECT wid, label FROM split WHERE split <> 'train'")
def resume_antijoin(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    return knowledge.remaining(_labels(lines).select("wid", "label"), _split(lines).where("split = 'train'"), "wid")


# Weights, reports, pooling


_PREDICTED = f"WITH {LINES}, {LABELS}, p AS (SELECT wid, label, coalesce(types[2], label) AS pred FROM labelled)"


def _predictions(spark, sf_dir):
    return _labels(eventlog.lines(spark, sf_dir)).select("wid", "label", F.coalesce(F.get("types", F.lit(1)), "label").alias("pred"))


@query(f"WITH {LINES}, {LABELS}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label), r AS (SELECT label, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS raw, (SELECT count(*) FROM c) AS k FROM c) SELECT label, n, round(least(raw * k / (SELECT sum(raw) FROM r), 1.5), 6) AS weight FROM r")
def class_weights(spark, sf_dir):
    return measure.class_weights(_labels(eventlog.lines(spark, sf_dir)), 1.5)


@query(_PREDICTED + " SELECT label, " + ", ".join(f"count(*) FILTER (WHERE pred = '{c}') AS pred_{c}" for c in CLASSES) + " FROM p GROUP BY label")
def confusion_matrix(spark, sf_dir):
    return measure.confusion(_predictions(spark, sf_dir), CLASSES)


_REPORT = _PREDICTED + """, c AS (SELECT label AS c FROM p UNION SELECT pred FROM p), r AS (SELECT c AS label, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE pred = c) AS predicted, (SELECT count(*) FROM p WHERE pred = c AND label = c) AS hit FROM c),
 rep AS (SELECT label, support, round(coalesce(hit / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * hit / nullif(support + predicted, 0), 0), 6) AS f1 FROM r)"""


@query(_REPORT + " SELECT * FROM rep")
def class_report(spark, sf_dir):
    return measure.class_report(_predictions(spark, sf_dir))


@query(_REPORT + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM rep")
def prf_macro(spark, sf_dir):
    return measure.macro(measure.class_report(_predictions(spark, sf_dir)))


@query(_PREDICTED + " SELECT round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement, count(*) AS n FROM p")
def agreement_rate(spark, sf_dir):
    return _predictions(spark, sf_dir).agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES}, {LABELS}, s AS (SELECT wid, avg(CASE WHEN event_type = label THEN 1.0::DOUBLE ELSE 0 END) AS p FROM lines JOIN labelled USING (wid) GROUP BY wid) SELECT round(avg(-pow(1 - greatest(p, 1e-12), 1.0) * ln(greatest(p, 1e-12))), 6) AS focal_loss FROM s")
def focal_loss(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    shares = lines.join(_labels(lines).select("wid", "label"), "wid").groupBy("wid").agg(F.avg((F.col("event_type") == F.col("label")).cast("double")).alias("p"))
    return measure.focal_loss(shares.withColumn("weight", F.lit(1.0)))


@query(f"""WITH {ENTITIES}, {RECORDS}, x AS (SELECT wid, template, count, first_ts, first_idx, unnest(generate_series(1, count)) AS copy FROM comp),
 o AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY first_ts, first_idx, template, copy) - 1 AS pos FROM x) SELECT wid, template, count(*) AS copies, min(pos) AS first_pos, round(avg(pos), 6) AS mean_pos FROM o WHERE pos < 40 GROUP BY wid, template""")
def count_expand_meanpool(spark, sf_dir):
    copies = measure.expanded(_compressed(spark, sf_dir), 40)
    return copies.groupBy("wid", "template").agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("first_pos"), F.round(F.avg("pos"), 6).alias("mean_pos"))


@query("WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM x GROUP BY ALL")
def mean_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("embedding").alias("vec"))
    return measure.mean_vectors(rows, "label").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("WITH t AS (SELECT user_id, max(value) AS m FROM events GROUP BY user_id) SELECT user_id, round(sum(exp((value - m) / 100) * value) / sum(exp((value - m) / 100)), 4) AS pooled FROM events JOIN t USING (user_id) GROUP BY user_id")
def attention_pool(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("score", F.col("value") / 100)
    return measure.attention_pool(rows, "user_id", "score", "value").withColumn("pooled", F.round("pooled", 4))


# Retrieval, texts, clusters


def _vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return queries, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _top(on: str, boost: str, k: int) -> str:
    return f"""SELECT qid, id, round(sim, 6) AS sim, rank FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim * {boost}, 9) DESC, id) AS rank FROM
 (SELECT a.vec_id AS qid, b.vec_id AS id, {_DOT} AS sim FROM embeddings a JOIN embeddings b ON {on} WHERE a.vec_id % 50 = 0)) WHERE rank <= {k}"""


@query(_top("true", "1", 10))
def cosine_topk(spark, sf_dir):
    queries, base = _vectors(spark, sf_dir)
    return retrieval.cosine_topk(queries.drop("label"), base, 10)


@query(_top("a.label = b.label", "(1 / sqrt(1 + id % 3))", 5))
def class_filtered_specificity_topk(spark, sf_dir):
    """Entries of the query's class, ranked by similarity over the root of how many classes an entry has."""
    return retrieval.cosine_topk(*_vectors(spark, sf_dir), 5, on="label", boost=1 / F.sqrt(1 + F.col("id") % 3))


@query("""SELECT doc_id, concat_ws(chr(10), 'Title: ' || source, 'Symptom: ' || text, 'Root cause: ' || lang, CASE WHEN n_chars > 500 THEN 'Fix: shorten | split' END, 'Anomaly classes: ' || lang, CASE WHEN doc_id % 2 = 0 THEN 'Tags: even' END) AS entry FROM documents""")
def entry_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.array().cast("array<string>")
    rows = docs.select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("symptom"), F.col("lang").alias("root_cause"),
        F.when(F.col("n_chars") > 500, F.array(F.lit("shorten"), F.lit("split"))).otherwise(none).alias("fix"), F.array("lang").alias("classes"), none.alias("subsystems"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("even"))).otherwise(none).alias("tags"),
    )
    return rows.select("doc_id", retrieval.entry_text(rows).alias("entry"))


_CONTEXT = f"""WITH {ENTITIES}, {RECORDS}, {LABELS}, k AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY count DESC, first_idx, template) AS r FROM comp),
 ctx AS (SELECT c.wid, CAST(sum(c.count) AS BIGINT) AS log_count_original, count(*) AS log_count, (SELECT string_agg('  [x' || k.count || '] ' || left(k.template, 200), chr(10) ORDER BY r) FROM k WHERE k.wid = c.wid AND r <= 5) AS top_templates FROM comp c GROUP BY c.wid),
 fe AS (SELECT wid, entity, count(DISTINCT log_idx) AS n FROM ents GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY n DESC, entity) AS r FROM fe),
 fq AS (SELECT wid, string_agg(entity || '(x' || n || ')', ', ' ORDER BY r) AS entities FROM fr WHERE r <= 5 GROUP BY wid)"""


#: A context keeps eight frequent entities; the query that is made of it has five.
_WIDE_CONTEXT = _CONTEXT.replace("FROM fr WHERE r <= 5", "FROM fr WHERE r <= 8")


def _contexts(spark, sf_dir, entities):
    lines = _numbered(spark, sf_dir).withColumn("ts_s", F.regexp_extract("raw_line", r"^- (\S+ \S+) ", 1))
    context = retrieval.window_context(compress.compress_windows(_records(lines)))
    return context.join(retrieval.frequent_entities(_entities(lines), entities), "wid", "left").join(_labels(lines).select("wid", "label"), "wid")


@query(_WIDE_CONTEXT + " SELECT wid, log_count_original, log_count, top_templates, entities FROM ctx LEFT JOIN fq USING (wid)")
def window_context(spark, sf_dir):
    return _contexts(spark, sf_dir, 8).drop("label")


@query(_CONTEXT + " SELECT wid, 'Predicted anomaly: ' || label || chr(10) || 'Top log templates by count:' || chr(10) || top_templates || coalesce(chr(10) || 'Frequent entities: ' || entities, '') AS query FROM ctx JOIN labelled USING (wid) LEFT JOIN fq USING (wid)")
def prompt_text(spark, sf_dir):
    context = _contexts(spark, sf_dir, 5)
    return context.select("wid", retrieval.retrieval_query(context).alias("query"))


@query(f"""WITH ev AS ({_top("a.label = b.label", "1", 5)}), l AS (SELECT ev.*, e.label FROM ev JOIN embeddings e ON e.vec_id = qid), t AS (SELECT qid AS wid, label, string_agg(CAST(id % 4 AS VARCHAR), '|' ORDER BY CAST(id % 4 AS VARCHAR)) AS fingerprint, max(CASE WHEN rank = 1 THEN sim END) AS score FROM l WHERE rank <= 2 GROUP BY qid, label),
 c AS (SELECT label, fingerprint, count(*) AS size, arg_min(wid, {{'s': -score, 'w': wid}}) AS rep FROM t GROUP BY label, fingerprint), n AS (SELECT *, row_number() OVER (ORDER BY size DESC, label, fingerprint) AS cluster FROM c)
 SELECT wid, label, fingerprint, cluster, size, wid = rep AS is_representative FROM t JOIN n USING (label, fingerprint)""")
def fingerprint_clusters(spark, sf_dir):
    queries, base = _vectors(spark, sf_dir)
    evidence = retrieval.cosine_topk(queries, base, 5, on="label").join(queries.select("qid", "label"), "qid")
    return retrieval.fingerprint_clusters(evidence.select(F.col("qid").alias("wid"), "label", (F.col("id") % 4).cast("string").alias("id"), "sim", "rank"), 2)


# Reports


_REPORTED = """SELECT event_id, 'Do it (see TS‑' || (k % 12) || ') and (see AB-' || k || '), Tuple ' || (k % 6) || ', tuple ' || (k % 3) || '; SET CONFIGURATION ''heap_' || event_type || '_size''=' || k || ', SHOW ' || upper(event_type) || '. FLUSH `' || event_type || '_pool_size`; DELETE STORAGE GROUP, REMOVE DATANODE, SET SYSTEM TO READONLY; run `start-cli.sh` or (export-' || CASE WHEN k % 2 = 0 THEN 'csv' ELSE 'tsfile' END || '.bat, with JAVA_HOME and IOTDB_CONF' AS text, k, event_type"""
_EVIDENCE = "['TS-' || (k % 5), 'TS-' || (k % 12), 'AB-' || (k % 40)]"
_KNOWN_IDS = [f"TS-{i}" for i in range(12)] + [f"AB-{i}" for i in range(50)]
_REPORTS = f"WITH {LINES}, rep AS ({_REPORTED} FROM lines), n AS (SELECT *, regexp_replace(text, '[‐‑–—]', '-', 'g') AS t, {_EVIDENCE} AS evidence FROM rep), cited AS (SELECT *, list_sort(list_distinct(regexp_extract_all(t, {q(evaluate.CITED_ID)}, 1))) AS ids, list_sort(list_distinct(list_transform(regexp_extract_all(t, {q(evaluate.CITED_RANK)}, 1), lambda x: CAST(x AS BIGINT)))) AS ranks FROM n)"


def _reports(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    text = _REPORTED.removeprefix("SELECT event_id, ").split(" AS text")[0].replace("''", "\\'")
    return lines.select("event_id", F.expr(text).alias("text"), F.expr(_EVIDENCE.replace("[", "array(").replace("]", ")")).alias("evidence"))


@query(_REPORTS + " SELECT event_id, array_to_string(ids, ',') AS cited_ids, array_to_string(list_transform(ranks, lambda x: CAST(x AS VARCHAR)), ',') AS cited_ranks FROM cited")
def citations(spark, sf_dir):
    return evaluate.citations(_reports(spark, sf_dir)).select("event_id", F.array_join("cited_ids", ",").alias("cited_ids"), F.array_join(F.transform("cited_ranks", lambda n: n.cast("string")), ",").alias("cited_ranks"))


_ALL_IDS = "[" + ", ".join(map(q, _KNOWN_IDS)) + "]"


@query(_REPORTS + f""" SELECT event_id, CAST(len(list_filter(ids, lambda x: list_contains(evidence, x))) AS BIGINT) AS valid_ids, CAST(len(list_filter(ids, lambda x: NOT list_contains(evidence, x) AND list_contains({_ALL_IDS}, x))) AS BIGINT) AS existing_ids,
 CAST(len(list_filter(ids, lambda x: NOT list_contains(evidence, x) AND NOT list_contains({_ALL_IDS}, x))) AS BIGINT) AS bogus_ids, CAST(len(list_filter(ranks, lambda x: x >= 1 AND x <= len(list_distinct(evidence)))) AS BIGINT) AS valid_ranks, CAST(len(list_filter(ranks, lambda x: x < 1 OR x > len(list_distinct(evidence)))) AS BIGINT) AS invalid_ranks FROM cited""")
def citation_validity(spark, sf_dir):
    judged = evaluate.citation_validity(evaluate.citations(_reports(spark, sf_dir)), F.array(*map(F.lit, _KNOWN_IDS)))
    return judged.select("event_id", "valid_ids", "existing_ids", "bogus_ids", "valid_ranks", "invalid_ranks")


@query(_REPORTS + f" SELECT event_id, list_bool_or(list_transform(evidence, lambda x: contains(t, x))) OR regexp_matches(t, {q(evaluate.CITED_RANK)}) AS cites, list_bool_or(list_transform(evidence, lambda x: contains(t, x))) AS cites_id FROM n")
def literal_citations(spark, sf_dir):
    """With the ranks, and the ids alone."""
    rows = _reports(spark, sf_dir)
    without = F.regexp_replace("text", evaluate.CITED_RANK, "")
    return rows.select("event_id", evaluate.cites_evidence(F.col("text"), F.col("evidence")).alias("cites"), evaluate.cites_evidence(without, F.col("evidence")).alias("cites_id"))


_COMMANDS = ["SHOW VIEW", "SHOW CLICK STREAM", "FLUSH", "REMOVE DATANODE"]
_TOOLS, _VARIABLES = ["start-cli.sh", "export-csv.bat"], ["JAVA_HOME"]
_SETTINGS = ["heap_view_size", "view_pool_size", "click_pool_size"]


@query(_REPORTS + f""", m AS (SELECT event_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, {q(evaluate.CONFIG_SET)}, 1) || regexp_extract_all(t, {q(evaluate.CONFIG_QUOTED)}, 1), lambda x: lower(x)))) AS s, list_sort(list_distinct(list_transform(regexp_extract_all(t, {q(evaluate.COMMAND)}, 1), lambda x: upper(trim(x))))) AS c,
 list_sort(list_distinct(regexp_extract_all(t, {q(evaluate.TOOL)}, 1))) AS o, list_sort(list_distinct(regexp_extract_all(t, {q(evaluate.VARIABLE)}, 1))) AS v FROM n)
 SELECT event_id, array_to_string(s, ',') AS settings, array_to_string(c, ',') AS commands, array_to_string(list_filter(s, lambda x: NOT list_contains([{', '.join(map(q, _SETTINGS))}], x)), ',') AS unknown_settings,
 array_to_string(list_filter(c, lambda x: NOT ({' OR '.join(f"starts_with(x, {q(k)}) OR starts_with({q(k)}, x)" for k in _COMMANDS)})), ',') AS unknown_commands,
 array_to_string(o, ',') AS tools, array_to_string(v, ',') AS variables, array_to_string(list_filter(o, lambda x: NOT list_contains([{', '.join(map(q, _TOOLS))}], x)), ',') AS unknown_tools,
 array_to_string(list_filter(v, lambda x: NOT list_contains([{', '.join(map(q, _VARIABLES))}], x)), ',') AS unknown_variables FROM m""")
def hallucination_antijoin(spark, sf_dir):
    rows = _reports(spark, sf_dir)
    rows = rows.select("event_id", *[c.alias(k) for k, c in evaluate.mentions(F.col("text")).items()])
    return rows.select("event_id", F.array_join("settings", ",").alias("settings"), F.array_join("commands", ",").alias("commands"), F.array_join(evaluate.unknown_settings(F.col("settings"), _SETTINGS), ",").alias("unknown_settings"), F.array_join(evaluate.unknown_commands(F.col("commands"), _COMMANDS), ",").alias("unknown_commands"), F.array_join("tools", ",").alias("tools"), F.array_join("variables", ",").alias("variables"), F.array_join(evaluate.outside(F.col("tools"), _TOOLS), ",").alias("unknown_tools"), F.array_join(evaluate.outside(F.col("variables"), _VARIABLES), ",").alias("unknown_variables"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'que') OR contains(lower(text), 'the')) AS hits FROM documents GROUP BY lang")
def keyword_hits(spark, sf_dir):
    hit = evaluate.keyword_hit(F.col("text"), F.array(F.lit("QUE"), F.lit("the")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


@query("SELECT n_regionkey AS code, n_nationkey % 3 AS class_pos, n_nationkey AS pos, n_name AS name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, n_nationkey) = 1")
def status_code_dedupe(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return knowledge.first_class(nation.select(F.col("n_regionkey").alias("code"), (F.col("n_nationkey") % 3).alias("class_pos"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")))


# Ids, lookups, sizes


@query(_NODES + """ , o AS (SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY left(md5(node_id), 2), node_id) - 1 AS number FROM (SELECT DISTINCT node_type, node_id FROM nodes)) SELECT * FROM o""")
def kg_global_ids(spark, sf_dir):
    return graph.global_ids(_graph(spark, sf_dir)[0].select("node_type", "node_id").distinct())


@query(_WE + " SELECT wid, count(*) AS edges FROM (SELECT DISTINCT wid, log_idx FROM lines) l JOIN we USING (wid) GROUP BY wid")
def kg_fanned_out_edges(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    ents = _entities(lines).select("wid", F.concat_ws(":", "entity_type", "entity").alias("entity"))
    return graph.fanned_out(ents, lines).groupBy("wid").agg(F.count(F.lit(1)).alias("edges"))


_TOUCH = _EGO + ", own AS (SELECT DISTINCT wid AS target, entity FROM le), touch AS (SELECT DISTINCT target, wid, log_idx FROM tg JOIN le USING (wid) WHERE target = wid OR (target, entity) IN (SELECT (target, entity) FROM own))"


def _touching(spark, sf_dir):
    return graph.touching_lines(*_ego(spark, sf_dir))


@query(_TOUCH + " SELECT target, wid, count(*) AS lines FROM touch GROUP BY ALL")
def ego_touching_lines(spark, sf_dir):
    return _touching(spark, sf_dir).groupBy("target", "wid").agg(F.count(F.lit(1)).alias("lines"))


@query(_TOUCH + " SELECT target, wid, log_idx FROM touch QUALIFY row_number() OVER (PARTITION BY target ORDER BY CASE WHEN target <> wid THEN 1 ELSE 0 END, md5(target || ':' || wid || ':' || log_idx)) <= 60")
def ego_sampled_lines(spark, sf_dir):
    return graph.sampled_lines(_touching(spark, sf_dir), 60)


@query(_WE + f""", {scores()}, e AS (SELECT wid, neighbor FROM ranked WHERE rank <= 2), h2 AS (SELECT DISTINCT a.wid, b.neighbor FROM e a JOIN e b ON a.neighbor = b.wid WHERE a.wid <> b.neighbor)
 SELECT wid, neighbor, 1 AS hop FROM e UNION ALL SELECT wid, neighbor, 2 FROM h2 WHERE (wid, neighbor) NOT IN (SELECT (wid, neighbor) FROM e)""")
def two_hop_neighbors(spark, sf_dir):
    near = written(graph.top_neighbors(graph.shared_entity_scores(_window_entity(eventlog.lines(spark, sf_dir)), MOST_WINDOWS, 2), 2))  # read by every step
    return graph.hops(near, 2)


@query("WITH d AS (SELECT doc_id, coalesce(e.embedding, [0.0 FOR i IN range(64)]::FLOAT[]) AS vec, e.vec_id IS NULL AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) SELECT doc_id, missing, round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm FROM d")
def lookup_vectors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return measure.lookup_vectors(docs, vectors, "doc_id", 64).select("doc_id", "missing", F.round(retrieval.dot(F.col("vec"), F.col("vec")), 4).alias("norm"))


@query(f"WITH {ENTITIES}, {RECORDS}, c AS (SELECT l.wid, l.log_idx, greatest(coalesce(c.count, 1), 1) AS count FROM recs l LEFT JOIN comp c ON c.wid = l.wid AND c.first_idx = l.log_idx) SELECT count, count(*) AS n FROM c GROUP BY count")
def count_histogram(spark, sf_dir):
    """Lines that open a record have its count, all others 1."""
    lines = eventlog.lines(spark, sf_dir)
    counts = compress.compress_windows(_records(lines)).select("wid", F.col("first_idx").alias("log_idx"), "count")
    counted = lines.select("wid", "log_idx").join(counts, ["wid", "log_idx"], "left")
    return counted.groupBy(F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("count")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTITIES} SELECT entity_type, count(DISTINCT entity) AS entities, count(DISTINCT wid) AS windows, count(*) AS line_entities FROM ents GROUP BY ALL")
def corpus_counts(spark, sf_dir):
    return _entities(eventlog.lines(spark, sf_dir)).groupBy("entity_type").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("wid").alias("windows"), F.count(F.lit(1)).alias("line_entities"))


@query(_DF + " SELECT token, n FROM df ORDER BY n DESC, token LIMIT 5000")
def top_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).orderBy(F.desc("n"), "token").limit(5000)


@query(_COVERED + " SELECT * FROM cov ORDER BY coverage DESC, entity_type, entity LIMIT 20000")
def top_coverage(spark, sf_dir):
    return _train_coverage(_numbered(spark, sf_dir)).orderBy(F.desc("coverage"), "entity_type", "entity").limit(20000)


@query(_NODES + """ SELECT node_id, regexp_replace(node_id, '^[^:]*:', '') AS content, left(translate(node_id, ':/', '__'), 80) AS short_id,
 starts_with(node_id, 'GeneralEntity:') AND NOT regexp_matches(content, '[:=]') AS semantic FROM (SELECT DISTINCT node_id, regexp_replace(node_id, '^[^:]*:', '') AS content FROM nodes)""")
def node_names(spark, sf_dir):
    ids = _graph(spark, sf_dir)[0].select("node_id").distinct()
    return ids.select("node_id", names.content(F.col("node_id")).alias("content"), names.short_id(F.col("node_id")).alias("short_id"), names.is_semantic(F.col("node_id")).alias("semantic"))


@query(f"WITH {LINES}, {LABELS} SELECT wid, CASE label WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 6 END AS code FROM labelled")
def label_codes(spark, sf_dir):
    return _labels(eventlog.lines(spark, sf_dir)).select("wid", names.label_code(F.col("label")).alias("code"))


@query(f"WITH {LINES}, p AS (SELECT DISTINCT log_idx AS pos FROM lines) SELECT pos, " + ", ".join(f"round({'sin' if i % 2 == 0 else 'cos'}(pos * {10000.0 ** (-(i - i % 2) / 8)!r}::DOUBLE), 6) AS d{i}" for i in range(8)) + " FROM p")
def positional_encoding(spark, sf_dir):
    rows = eventlog.lines(spark, sf_dir).select(F.col("log_idx").alias("pos")).distinct().withColumn("v", measure.positional_encoding(8))
    return rows.select("pos", *[F.round(F.get("v", F.lit(i)), 6).alias(f"d{i}") for i in range(8)])


@query(_PREDICTED + " SELECT pred, count(*) AS n FROM p WHERE label = 'error' AND pred <> 'error' GROUP BY pred")
def class_mistakes(spark, sf_dir):
    return measure.mistakes(_predictions(spark, sf_dir), "error")


@query(f"""WITH {LINES}, rep AS ({_REPORTED} FROM lines), n AS (SELECT * EXCLUDE (text), CASE k % 10 WHEN 3 THEN '[stub report] prompt of 9 characters' WHEN 4 THEN ' ' ELSE text END AS text, {_EVIDENCE} AS evidence FROM rep),
 t AS (SELECT *, regexp_replace(text, '[‐‑–—]', '-', 'g') AS t FROM n), cited AS (SELECT *, list_distinct(regexp_extract_all(t, {q(evaluate.CITED_ID)}, 1)) AS ids, trim(text) <> '' AND NOT starts_with(text, '[stub report]') AS real FROM t),
 v AS (SELECT *, len(list_filter(ids, lambda x: list_contains(evidence, x))) AS a, len(list_filter(ids, lambda x: NOT list_contains(evidence, x) AND list_contains({_ALL_IDS}, x))) AS b, contains(lower(text), 'pool') AND event_type <> 'error' AS hit,
 list_bool_or(list_transform(evidence, lambda x: contains(t, x))) OR regexp_matches(t, {q(evaluate.CITED_RANK)}) AS cites FROM cited),
 g AS (SELECT event_type, count(*) AS reports, count(*) FILTER (WHERE real) AS n_with_report, count(*) FILTER (WHERE real AND cites) AS n_cites, count(*) FILTER (WHERE real AND hit) AS n_hits, coalesce(sum(len(ids)) FILTER (WHERE real), 0) AS ids, coalesce(sum(a) FILTER (WHERE real), 0) AS a, coalesce(sum(b) FILTER (WHERE real), 0) AS b, avg(length(text)) AS chars FROM v GROUP BY event_type)
 SELECT event_type, reports, n_with_report, round(n_cites / greatest(n_with_report, 1), 6) AS citation_rate, round(CASE WHEN ids > 0 THEN a / ids ELSE 1.0 END, 6) AS valid_share, round(CASE WHEN ids > 0 THEN (a + b) / ids ELSE 1.0 END, 6) AS real_share, round(n_hits / greatest(n_with_report, 1), 6) AS keyword_rate, round(chars, 6) AS mean_chars FROM g""")
def report_metrics(spark, sf_dir):
    """Of reports some of which are stubs or blank."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    reports = _reports(spark, sf_dir).join(kinds, "event_id")
    reports = reports.withColumn("text", F.when(F.col("k") % 10 == 3, "[stub report] prompt of 9 characters").when(F.col("k") % 10 == 4, " ").otherwise(F.col("text")))
    judged = evaluate.citation_validity(evaluate.citations(reports), F.array(*map(F.lit, _KNOWN_IDS)))
    rows = judged.withColumn("hit", evaluate.keyword_hit(F.col("text"), F.array(F.lit("POOL"))) & (F.col("event_type") != "error"))
    return measure.report_metrics(rows, ["event_type"])


@query(_CONTEXT + " SELECT wid, '[stub report] prompt of ' || length(top_templates) || ' characters' AS report FROM ctx")
def stub_reports(spark, sf_dir):
    context = retrieval.window_context(_compressed(spark, sf_dir))
    return context.select("wid", names.stub_report(F.col("top_templates")).alias("report"))


# Merges, counts, ablations, prompts, metrics, sinks


_LOST = ENTITIES.replace(" AS thread FROM lines)", " AS thread FROM (SELECT * REPLACE ('2024-01-01 00:00:00,000 [unknown] INFO  noop - ' || regexp_replace(raw_line, " + q(E.HEADER) + ", '') AS raw_line) FROM lines))")


@query(f"WITH {_LOST} SELECT entity_type, entity, count(*) AS n FROM ents GROUP BY ALL")
def message_entities(spark, sf_dir):
    """Entities of messages without their headers."""
    lines = eventlog.lines(spark, sf_dir)
    return _entities(lines.withColumn("raw_line", E.message_line(E.message(F.col("raw_line"))))).groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTITIES}, x AS (SELECT wid, 'Node' AS entity_type, 'given' AS entity FROM lines WHERE k % 3 = 1 UNION ALL SELECT e.wid, entity_type, entity FROM ents e JOIN lines l ON e.wid = l.wid AND e.log_idx = l.log_idx WHERE k % 3 IS DISTINCT FROM 1) SELECT wid, entity_type, entity, count(*) AS n FROM x GROUP BY ALL")
def given_or_found_entities(spark, sf_dir):
    """A third of the lines have entities already; of the others some have an empty list, some none."""
    struct = "array<struct<type:string,value:string>>"
    node = F.array(F.struct(F.lit("Node").alias("type"), F.lit("given").alias("value"))).cast(struct)
    given = F.when(F.col("k") % 3 == 1, node).when(F.col("k") % 3 == 2, F.array().cast(struct))
    rows = eventlog.lines(spark, sf_dir).select("wid", F.explode(E.given_or_found(given, F.col("raw_line"))).alias("e"))
    return rows.groupBy("wid", F.col("e.type").alias("entity_type"), F.col("e.value").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query(ORACLE_SQL["entity_frequency_levels"].replace("SELECT wid, entity_type, entity, c.lines", "SELECT 'Window:' || wid AS src, entity_type || ':' || entity AS dst, 'CONTAINS' AS relation, c.lines"))
def kg_frequency_edges(spark, sf_dir):
    return graph.frequency_edges(entity_frequency_levels(spark, sf_dir))


_STRUCTURED = f"""s AS (SELECT wid, log_idx, thread, {found(E.REGION)} || {found(E.REGION_TO_IP)} AS regions, {found(E.PEER, 2)} AS pn, {found(E.PEER, 1)} AS pi, {found(E.NODE_ID)} AS own, nullif(regexp_extract(raw_line, {q(E.ENDPOINT_IP)}, 1), '') AS ip, {CONSENSUS} AS groups FROM said),
 pairs AS (SELECT wid, log_idx, unnest(list_transform(list_zip(pn, pi), lambda x: x[1] || '=' || x[2]) || CASE WHEN ip IS NULL THEN [] ELSE list_transform(list_filter(own, lambda n: NOT list_contains(pn, n)), lambda n: n || '=' || ip) END) AS pair FROM s),
 kept AS (SELECT wid, split_part(pair, '=', 1) AS node, arg_max(pair, {{'i': log_idx, 'p': pair}}) AS pair FROM pairs GROUP BY ALL), ips AS (SELECT wid, string_agg(pair, ',' ORDER BY pair) AS node_ips FROM kept GROUP BY wid),
 sets AS (SELECT wid, list_sort(list_distinct(flatten(list(regions)))) AS regions, list_sort(list_distinct(flatten(list(own || pn)))) AS nodes, list_sort(list_distinct(flatten(list(groups)))) AS groups, arg_min(thread, log_idx) FILTER (WHERE thread IS NOT NULL) AS thread FROM s GROUP BY wid)"""


@query(f"WITH {LINES}, {_STRUCTURED} SELECT wid, array_to_string(regions, ',') AS regions, array_to_string(nodes, ',') AS nodes, array_to_string(groups, ',') AS groups, thread, coalesce(node_ips, '') AS node_ips FROM sets LEFT JOIN ips USING (wid)")
def entities_merged(spark, sf_dir):
    rows = E.merged(eventlog.lines(spark, sf_dir), "wid", "log_idx")
    return rows.select("wid", "thread", *[F.array_join(c, ",").alias(c) for c in ("regions", "nodes", "groups", "node_ips")])


@query(f"WITH {LINES}, {_STRUCTURED} SELECT wid, coalesce(string_agg(pair, ',' ORDER BY pair), '') AS node_ips FROM sets LEFT JOIN (SELECT * FROM kept WHERE CAST(node AS INT) % 2 = 0) USING (wid) GROUP BY wid")
def surviving_addresses(spark, sf_dir):
    """Addresses of the nodes of even number, as if a filter had dropped the others."""
    rows = E.merged(eventlog.lines(spark, sf_dir), "wid", "log_idx")
    even = F.filter("nodes", lambda n: n.cast("int") % 2 == 0)
    return rows.select("wid", F.array_join(E.surviving_addresses(F.col("node_ips"), even), ",").alias("node_ips"))


@query(_DF + f""", {_STRUCTURED} SELECT 'data_regions' AS kind, count(DISTINCT r) AS n FROM (SELECT unnest(regions) AS r FROM sets) UNION ALL SELECT 'nodes', count(DISTINCT r) FROM (SELECT unnest(nodes) AS r FROM sets)
 UNION ALL SELECT 'consensus_groups', count(DISTINCT r) FROM (SELECT unnest(groups) AS r FROM sets) UNION ALL SELECT 'node_ip_mappings', count(DISTINCT node) FROM kept UNION ALL SELECT 'statistical_entities', count(*) FROM df WHERE n >= 5 AND complexity >= 2""")
def corpus_unique_counts(spark, sf_dir):
    statistical = valid_tokens(spark, sf_dir).agg(F.count("token").alias("n")).select(F.lit("statistical_entities").alias("kind"), "n")
    return E.unique_counts(eventlog.lines(spark, sf_dir)).unionByName(statistical)


@query(f"WITH {ENTITIES}, {RECORDS}, t AS (SELECT wid, template, coalesce(arg_min(thread, log_idx) FILTER (WHERE log_idx = first), min(thread)) AS thread, list_sort(list_distinct(list(thread))) AS threads FROM (SELECT *, min(log_idx) OVER (PARTITION BY wid, template) AS first FROM recs) GROUP BY ALL) SELECT wid, template, thread, array_to_string(list_filter(threads, lambda x: x IS DISTINCT FROM thread), ',') AS extra_threads FROM t")
def window_compress_threads(spark, sf_dir):
    return _compressed(spark, sf_dir).select("wid", "template", "thread", F.array_join("extra_threads", ",").alias("extra_threads"))


@query(f"WITH {ENTITIES}, {RECORDS}, o AS (SELECT wid, template, row_number() OVER (PARTITION BY wid ORDER BY first_ts, first_idx, template) - 1 AS pos FROM comp) SELECT wid, template, pos FROM o WHERE pos < 40")
def count_ablation(spark, sf_dir):
    return measure.expanded(measure.without_counts(_compressed(spark, sf_dir)), 40).select("wid", "template", "pos")


@query("SELECT label, count(*) AS windows, count(DISTINCT cluster) AS clusters, round(count(*) / count(DISTINCT cluster), 6) AS ratio FROM (" + ORACLE_SQL["fingerprint_clusters"] + ") GROUP BY label")
def cluster_ratio(spark, sf_dir):
    return retrieval.cluster_ratio(fingerprint_clusters(spark, sf_dir))


_FOUND = f"SELECT t.qid, t.rank, t.sim, d.* FROM ({_top('a.label = b.label', '1', 3)}) t JOIN documents d ON d.doc_id = t.id"


@query(f"""SELECT qid, string_agg('## Tuple ' || rank || ': `D-' || doc_id || '` (sim=' || printf('%.3f', floor(sim * 1000 + 0.5) / 1000) || ')' || chr(10) || '- Source: ' || coalesce(source, 'None') || chr(10) || '- Title: ' || coalesce(lang, 'None') || chr(10) || '- Symptom: ' || left(coalesce(text, '(none)'), 300) || chr(10)
 || '- Root cause: (none)' || chr(10) || '- Fix:' || chr(10) || '      ' || CASE WHEN n_chars > 500 THEN 'shorten' || chr(10) || '      split' ELSE '(no explicit fix)' END || chr(10) || '- Anomaly classes: ' || coalesce(lang, '') || chr(10) || '- Subsystems: ' || chr(10), chr(10) ORDER BY rank) AS evidence FROM ({_FOUND}) GROUP BY qid""")
def evidence_blocks(spark, sf_dir):
    """The evidence of every query vector: documents as entries."""
    queries, base = _vectors(spark, sf_dir)
    none = F.array().cast("array<string>")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("title"), F.col("text").alias("symptom"), F.lit(None).cast("string").alias("root_cause"), F.when(F.col("n_chars") > 500, F.array(F.lit("shorten"), F.lit("split"))).otherwise(none).alias("fix"), F.array_compact(F.array("lang")).alias("classes"), none.alias("subsystems"))
    evidence = retrieval.cosine_topk(queries, base, 3, on="label").join(docs, "id").withColumn("id", F.concat(F.lit("D-"), "id"))
    return retrieval.evidence_block(evidence, "qid")


_OF_LABEL = "50 * CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.LABEL_CODES.items()) + f" ELSE {names.NORMAL_CODE} END"


@query(_WIDE_CONTEXT + f", found AS ({ORACLE_SQL['evidence_blocks']})" + """ SELECT wid, 'Predicted anomaly: ' || label || chr(10) || 'Log lines: ' || log_count_original || ' in ' || log_count || ' records' || chr(10) || 'Top log templates by count:' || chr(10) || top_templates || chr(10) || 'Frequent entities: ' || coalesce(entities, '(none)') || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, '(none)') || chr(10)
 || 'Explain the anomaly, its root cause and the actions to take. Cite tuples as (see ID).' AS prompt, 'Predicted anomaly: ' || label || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, '(none)') || chr(10) || 'List the actions to take, each with the tuple that supports it.' AS actions FROM ctx JOIN labelled USING (wid) LEFT JOIN fq USING (wid) LEFT JOIN found ON found.qid = """ + _OF_LABEL)
def prompts(spark, sf_dir):
    """Both prompts of every window, with the evidence that was found for the query vector of its label."""
    found = written(evidence_blocks(spark, sf_dir))
    context = _contexts(spark, sf_dir, 8)
    code = names.label_code(F.col("label")) * 50
    context = context.join(found, code == F.col("qid"), "left")
    return context.select("wid", retrieval.prompt(context).alias("prompt"), retrieval.prompt(context, actions_only=True).alias("actions"))


def _kinds(form: str) -> str:
    return ", ".join(form.format(k) for k in measure.KINDS)


_MENTIONED = "h AS (SELECT event_type, " + ", ".join(f"CASE WHEN {u}{k} = '' THEN 0 ELSE len(string_split({u}{k}, ',')) END AS {u}{k}" for u in ("", "unknown_") for k in measure.KINDS) + " FROM (" + ORACLE_SQL["hallucination_antijoin"] + ") JOIN events USING (event_id))"


@query("WITH " + _MENTIONED + f""", g AS (SELECT event_type, count(*) AS reports, {_kinds("CAST(sum({0}) AS BIGINT) AS {0}")}, {_kinds("CAST(sum(unknown_{0}) AS BIGINT) AS unknown_{0}")}, count(*) FILTER (WHERE {" + ".join(f"unknown_{k}" for k in measure.KINDS)} > 0) AS with_unknown FROM h GROUP BY event_type)
 SELECT *, {_kinds("round(unknown_{0} / greatest({0}, 1), 6) AS {0}_unknown_rate")}, round(with_unknown / reports, 6) AS unknown_report_rate FROM g""")
def mention_metrics(spark, sf_dir):
    names = hallucination_antijoin(spark, sf_dir)
    arrays = {c: F.filter(F.split(c, ","), lambda x: x != "") for k in measure.KINDS for c in (k, f"unknown_{k}")}
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return measure.mention_metrics(names.withColumns(arrays).join(kinds, "event_id"), ["event_type"])


@query("WITH x AS (SELECT unnest(string_split(unknown_settings, ',')) AS name FROM (" + ORACLE_SQL["hallucination_antijoin"] + ")) SELECT name, count(*) AS n FROM x WHERE name <> '' GROUP BY name ORDER BY n DESC, name LIMIT 15")
def frequent_unknown_settings(spark, sf_dir):
    names = hallucination_antijoin(spark, sf_dir)
    return measure.frequent_names(names.select(F.filter(F.split("unknown_settings", ","), lambda x: x != "").alias("names")), "names", 15)


@query(_REPORTS + f""", x AS (SELECT 'ids' AS kind, unnest(list_filter(ids, lambda x: NOT list_contains(evidence, x) AND NOT list_contains({_ALL_IDS}, x))) AS name FROM cited UNION ALL SELECT kind, unnest(string_split(names, ',')) FROM (SELECT * FROM ({ORACLE_SQL["hallucination_antijoin"]}))
 UNPIVOT (names FOR kind IN (unknown_settings AS 'settings', unknown_commands AS 'commands', unknown_tools AS 'tools', unknown_variables AS 'variables'))), c AS (SELECT kind, name, count(*) AS n FROM x WHERE name <> '' GROUP BY ALL)
 SELECT kind, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS rank FROM c) WHERE rank <= 10""")
def unknown_examples(spark, sf_dir):
    """The ten most frequent names of each kind that no list knows, and ids that nothing has."""
    reports = evaluate.citations(_reports(spark, sf_dir))
    ids = F.array_except(F.array_except("cited_ids", "evidence"), F.array(*map(F.lit, _KNOWN_IDS)))
    names = hallucination_antijoin(spark, sf_dir)
    kinds = [reports.select(F.lit("ids").alias("kind"), ids.alias("names"))] + [names.select(F.lit(k).alias("kind"), F.filter(F.split(f"unknown_{k}", ","), lambda x: x != "").alias("names")) for k in measure.KINDS]
    return measure.examples(reduce(DataFrame.unionByName, kinds), "kind", "names", 10)


@query("WITH v AS (SELECT * FROM (" + ORACLE_SQL["citation_validity"] + """) JOIN (SELECT event_id, event_type FROM events) USING (event_id)), g AS (SELECT event_type, CAST(sum(valid_ids + existing_ids + bogus_ids) AS BIGINT) AS id_cites, CAST(sum(valid_ids) AS BIGINT) AS valid_ids, CAST(sum(existing_ids) AS BIGINT) AS existing_ids, CAST(sum(bogus_ids) AS BIGINT) AS bogus_ids,
 CAST(sum(valid_ranks + invalid_ranks) AS BIGINT) AS rank_cites, CAST(sum(valid_ranks) AS BIGINT) AS valid_ranks, CAST(sum(invalid_ranks) AS BIGINT) AS invalid_ranks FROM v GROUP BY event_type)
 SELECT *, round(valid_ids / greatest(id_cites, 1), 6) AS id_valid_rate, round(bogus_ids / greatest(id_cites, 1), 6) AS id_bogus_rate, round(valid_ranks / greatest(rank_cites, 1), 6) AS rank_valid_rate FROM g""")
def citation_metrics(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return measure.citation_metrics(citation_validity(spark, sf_dir).join(kinds, "event_id"), ["event_type"])


@query(f"""WITH ev AS ({_top("true", "1", 5)}), x AS (SELECT qid, a.label, bool_or(rank = 1 AND b.label = a.label) AS top1, bool_or(b.label = a.label) AS topk FROM ev JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = id GROUP BY qid, a.label)
 SELECT label, count(*) AS windows, count(*) FILTER (WHERE top1) AS top1, count(*) FILTER (WHERE topk) AS topk, round(avg(CASE WHEN top1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1_pct, round(avg(CASE WHEN topk THEN 1.0::DOUBLE ELSE 0 END), 6) AS topk_pct FROM x GROUP BY label""")
def retrieval_hits(spark, sf_dir):
    """Whether the nearest vectors of a query are of its class."""
    queries, base = _vectors(spark, sf_dir)
    found_rows = retrieval.cosine_topk(queries.drop("label"), base.drop("label"), 5).join(queries.select("qid", "label"), "qid")
    classes = base.select("id", F.col("label").alias("class"))
    return measure.retrieval_hits(found_rows.join(classes, "id").withColumnRenamed("qid", "wid"), "label")


@query(_SPLIT + " SELECT wid, label, split FROM split")
def chunked_sink(spark, sf_dir):
    """Half of the windows published, a second half staged by a job that dies, then the rest by resuming; test labels replaced; compacted."""
    table = ChunkTable(spark, f"{scratch_folder(spark)}/chunks-{uuid.uuid4().hex}", "wid", 5000)
    rows = written(_split(eventlog.lines(spark, sf_dir)).select("wid", "label", "split"))
    half = F.pmod(F.xxhash64("wid"), F.lit(2)) == 0
    table.add(rows.where(half).withColumn("label", F.when(F.col("split") == "test", "stale").otherwise(F.col("label"))))
    table.stage(rows.where(~half))
    table.add(rows)
    table.replace(rows.where("split = 'test'"))
    table.compact()
    table.vacuum()
    return table.read().select("wid", "label", "split")


@query(f"WITH {LINES}, {LABELS} SELECT wid, label FROM labelled WHERE wid BETWEEN 'f1:count:10' AND 'f1:count:12'")
def chunk_lookup(spark, sf_dir):
    """A small range of windows looked up in a table of chunks: only those that can hold them are read."""
    table = ChunkTable(spark, f"{scratch_folder(spark)}/chunks-{uuid.uuid4().hex}", "wid", 20)
    rows = written(_labels(eventlog.lines(spark, sf_dir)).select("wid", "label"))
    table.add(rows)
    return table.lookup(rows.where("wid between 'f1:count:10' and 'f1:count:12'"))


_VECTOR = "[length(text), length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^ ]', '', 'g'))]"


@query(_CONTEXT + " SELECT wid, '[' || length(top_templates) || '] ' || left(top_templates, 20) AS report FROM ctx")
def generated_reports(spark, sf_dir):
    """Prompts answered by a generator that only says how long they are; equal prompts are asked once."""
    prompts = written(retrieval.window_context(_compressed(spark, sf_dir)).select("wid", F.col("top_templates").alias("prompt")))
    table = ChunkTable(spark, f"{scratch_folder(spark)}/answers-{uuid.uuid4().hex}", "digest")
    generate.answer(prompts, table, lambda prompt: f"[{len(prompt)}] {prompt[:20]}")
    return prompts.withColumn("digest", F.sha2("prompt", 256)).join(table.read(), "digest").select("wid", F.col("answer").alias("report"))


@query(r"SELECT doc_id, md5(trim(regexp_replace('<think>' || source || chr(10) || '</think>' || text || '<think></think> ', '(?s)<think>.*?</think>', '', 'g'))) AS plain FROM documents")
def plain_answers(spark, sf_dir):
    """Answers of a model without what it has marked as thinking."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("<think>"), "source", F.lit("\n</think>"), "text", F.lit("<think></think> "))
    return docs.select("doc_id", F.md5(evaluate.without_thoughts(text)).alias("plain"))


@query("""SELECT 'T-' || doc_id AS id, 'guide' AS doc_type, lang AS title, source AS symptom, NULL AS root_cause, CASE WHEN n_chars > 500 THEN 'shorten|split' ELSE '' END AS fix, lang AS anomaly_classes FROM documents
 UNION ALL SELECT DISTINCT 'CFG-size_' || n_chars, 'config', 'Configuration: size_' || n_chars, 'characters', 'type int; default ' || n_chars, '', 'length' FROM documents WHERE n_chars > 500""")
def knowledge_entries(spark, sf_dir):
    """Tuples and parameters written as knowledge files of bounded size, and read back as entries of one form."""
    folder = f"{scratch_folder(spark)}/knowledge-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fix = F.when(F.col("n_chars") > 500, F.array(F.lit("shorten"), F.lit("split"))).otherwise(F.array().cast("array<string>"))
    entry = F.struct(F.concat(F.lit("T-"), "doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("symptom"), fix.alias("fix"), F.array("lang").alias("anomaly_classes"))
    shard = F.floor(F.col("doc_id") / 2000).alias("shard")
    tuples = docs.groupBy("source", shard).agg(F.collect_list(entry).alias("tuples")).select("source", F.to_json(F.struct(F.lit("guide").alias("doc_type"), "tuples")).alias("value"))
    one = {"maxRecordsPerFile": 1}  # a file holds one object
    tuples.write.partitionBy("source").options(**one).text(f"{folder}/tuples")
    classes = F.when(F.col("n_chars") > 500, F.array(F.lit("length"))).otherwise(F.array().cast("array<string>"))
    setting = F.struct(F.concat(F.lit("size_"), "n_chars").alias("name"), F.lit("characters").alias("description"), F.lit("int").alias("type"), F.col("n_chars").cast("string").alias("default"), classes.alias("anomaly_classes"))
    sizes = docs.select("n_chars").where("n_chars is not null").distinct()
    sizes.groupBy(F.floor(F.col("n_chars") / 2000)).agg(F.collect_list(setting).alias("parameters")).select(F.to_json(F.struct("parameters")).alias("value")).write.options(**one).text(f"{folder}/config")
    rows = knowledge.tuple_entries(spark, [f"{folder}/tuples"]).unionByName(knowledge.parameter_entries(spark, [f"{folder}/config"]))
    return rows.select("id", "doc_type", "title", "symptom", "root_cause", F.array_join("fix", "|").alias("fix"), F.array_join("anomaly_classes", "|").alias("anomaly_classes"))


@query(f"""WITH {LINES}, {LABELS}, t AS (SELECT DISTINCT regexp_replace(raw_line, '^.*? - ', '') AS text, user_id % 5 < 3 AS known FROM lines), u AS (SELECT text, bool_or(known) AS known FROM t GROUP BY text)
 SELECT sha256(text) AS digest, (CASE WHEN known THEN {_VECTOR}[1] ELSE 0 END)::DOUBLE AS v0, (CASE WHEN known THEN {_VECTOR}[2] ELSE 0 END)::DOUBLE AS v1, (CASE WHEN known THEN {_VECTOR}[3] ELSE 0 END)::DOUBLE AS v2 FROM u""")
def vector_cache(spark, sf_dir):
    """Vectors of distinct messages, added in two runs, the second of which encodes what is new only; messages of other users are unknown."""
    table = ChunkTable(spark, f"{scratch_folder(spark)}/vectors-{uuid.uuid4().hex}", "digest")
    lines = written(eventlog.lines(spark, sf_dir).select(F.regexp_replace("raw_line", "^.*? - ", "").alias("text"), F.expr("user_id % 5").alias("u")))
    encode = learn.encoder(lambda texts: [(len(t), sum(c in "0123456789" for c in t), t.count(" ")) for t in texts])
    learn.add_vectors(lines.where("u < 2"), table, encode)
    learn.add_vectors(lines.where("u < 3"), table, encode)
    rows = learn.with_vectors(lines.select("text").distinct(), table, 3)
    return rows.select(F.sha2("text", 256).alias("digest"), *[F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(3)])


@query(f"WITH {LINES} SELECT wid, log_idx, ts_s, raw_line FROM lines")
def window_objects(spark, sf_dir):
    """Windows written as one JSON object a stream, and read back in ranges of 64 KB, larger ones where those would be over 32 a core."""
    path = f"{scratch_folder(spark)}/objects-{uuid.uuid4().hex}"
    line = F.struct("log_idx", F.struct("raw_line", F.col("ts_s").alias("timestamp")).alias("log"))
    logs = F.transform(F.sort_array(F.collect_list(line)), lambda s: s["log"])
    one_object.write_object(eventlog.lines(spark, sf_dir).groupBy("stream", "wid").agg(logs.alias("logs")), path, together="stream", files=eventlog.STREAMS)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for name in names:  # the default ranges of 128 MB would leave a small file whole
            spark.conf.set(name, str(one_object.range_bytes(spark, path, 65536, 32)))
        return knowledge.log_lines(knowledge.windows_json(spark, [path]))
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


@query(f"WITH {LINES} SELECT wid, log_idx, ts_s, raw_line FROM lines")
def window_files(spark, sf_dir):
    """Windows written as JSON lines and read back as lines."""
    path = f"{scratch_folder(spark)}/windows-{uuid.uuid4().hex}"
    line = F.struct("log_idx", F.struct("raw_line", F.col("ts_s").alias("timestamp")).alias("log"))
    logs = F.transform(F.sort_array(F.collect_list(line)), lambda s: s["log"])
    knowledge.write_windows(eventlog.lines(spark, sf_dir).groupBy("wid").agg(logs.alias("logs")), path)
    return knowledge.log_lines(knowledge.windows_lines(spark, [path]))


@query(f"WITH {LINES}, {LABELS} SELECT wid, label FROM labelled")
def parameter_table(spark, sf_dir):
    """Labels written with the parameters that made them, and read under the same."""
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    made = {"lines": str(eventlog.WINDOW_LINES), "streams": str(eventlog.STREAMS)}
    knowledge.write_with_parameters(_labels(eventlog.lines(spark, sf_dir)).select("wid", "label"), path, made)
    return knowledge.read_compatible(spark, path, made)


@query("""WITH w AS (SELECT 'f' || (user_id % 4) AS stream, date_trunc('hour', ts) AS start, count(*) AS lines FROM events GROUP BY ALL)
 SELECT stream, strftime(start, '%Y-%m-%d %H') AS start, lines FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_window_counts(spark, sf_dir):
    rows = _streamed(spark, sf_dir, lambda rows: streams.stream_window_counts(rows), "append")
    return rows.select("stream", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "lines")


# Not for SQL: template trees, learning, streams


#: What the sequential tree finds of each kind of line once it has seen enough of them.
_TEMPLATE = """CASE event_type WHEN 'click' THEN '<*> - opened <*> <*> streamId=7' WHEN 'purchase' THEN '<*> - Flush MemTable <*> <*> <*>'
 WHEN 'view' THEN '<*> - PartitionCache:276 cache miss for <*> <*> t:1' WHEN 'error' THEN '<*> - OutOfMemory in <*> <*> retry=3 <*>'
 ELSE '<*> - <*> <*> port:6667), <*> elected, TConsensusGroupId(type:DataRegion, <*>' END"""


def _messages(spark, sf_dir):
    return eventlog.lines(spark, sf_dir).select("wid", "log_idx", "event_id", "event_type", E.message(F.col("raw_line")).alias("message"))


@query(f"WITH {LINES} SELECT {_TEMPLATE} AS template, count(*) AS lines FROM lines GROUP BY ALL")
def drain_templates(spark, sf_dir):
    return templates.mine_templates(_messages(spark, sf_dir), "message", ["event_id"]).select("template", F.col("size").alias("lines"))


@query(f"WITH {LINES} SELECT wid, log_idx, CASE WHEN event_type = 'error' THEN '<UNKNOWN>' ELSE {_TEMPLATE} END AS template FROM lines")
def template_matches(spark, sf_dir):
    """Lines of all windows matched against the templates of training windows; errors, held back there, stay unknown."""
    lines = written(_messages(spark, sf_dir))
    train = _split(eventlog.lines(spark, sf_dir)).where("split = 'train'").select("wid")
    known = templates.mine_templates(lines.where("event_type <> 'error'").join(train, "wid", "left_semi"), "message", ["event_id"])
    return templates.match_templates(lines, known, "message", ["event_id"]).select("wid", "log_idx", "template")


@query()
def spark_ml_classifier(spark, sf_dir):
    lines = eventlog.lines(spark, sf_dir)
    context = retrieval.window_context(compress.compress_windows(_records(lines))).join(_split(lines), "wid")
    predicted = learn.classify(learn.text_vectors(context.select("wid", "label", "split", "top_templates"), "top_templates"), "label")
    return measure.class_report(predicted.where("split <> 'train'").select("label", "pred"))


_RELATIONS = {"HAS": ("log", "entity"), "OF": ("entity", "log")}


def _encoded(records):
    """Records of windows with vectors of the local encoder, small weights; a record's own vector is of a few figures."""
    vec = F.array(*[F.log1p(c.cast("double")) for c in (F.col("count"), F.length("template"), F.size("entities"), F.length("raw_line"))])
    return network.encode_windows(records.select("wid", F.col("first_idx").alias("pos"), "count", vec.alias("vec")), network.LocalEncoder(4, 32, 4, 2, 64))


@query()
def encoded_windows(spark, sf_dir):
    return _encoded(_compressed(spark, sf_dir)).select("wid", "pos", *[F.round(F.col("encoded")[i], 5).alias(f"e{i}") for i in range(4)])


def _passed(records):
    """Encoded records after two layers of messages between records and entities."""
    record = F.concat_ws(":", "wid", "first_idx").alias("src")
    held = written(records.select(record, F.explode("entities").alias("dst")))
    edges = held.select("src", F.lit("HAS").alias("relation"), "dst").unionByName(held.select(F.col("dst").alias("src"), F.lit("OF").alias("relation"), F.col("src").alias("dst")))
    own = [F.pmod(F.xxhash64("dst", F.lit(i)), F.lit(2001)) / 1000.0 - 1 for i in range(32)]
    nodes = written(_encoded(records).select(F.lit("log").alias("kind"), F.concat_ws(":", "wid", "pos").alias("id"), F.col("encoded").alias("x")).unionByName(held.select("dst").distinct().select(F.lit("entity").alias("kind"), F.col("dst").alias("id"), F.array(*own).alias("x"))))
    edges, ends = network.dealt(nodes, edges, _RELATIONS)
    for seed in range(2):
        nodes = written(network.pass_messages(nodes, edges, network.TypedLayer(_RELATIONS, 32, 4, seed), ends))
    return nodes


@query()
def typed_messages(spark, sf_dir):
    nodes = _passed(written(_compressed(spark, sf_dir)))
    return nodes.select("kind", "id", *[F.round(F.col("x")[i], 5).alias(f"x{i}") for i in range(4)])


@query()
def trained_classifier(spark, sf_dir):
    """Windows as means of their records after messages, classified by a network that is trained on the cluster."""
    lines = eventlog.lines(spark, sf_dir)
    x = F.array(*[F.avg(F.col("x")[i]) for i in range(32)])
    pooled = _passed(written(compress.compress_windows(_records(lines)))).where("kind = 'log'").groupBy(F.regexp_replace("id", ":[0-9]+$", "").alias("id")).agg(x.alias("x"))
    code = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(CLASSES) for v in (c, i)]), F.col("label"))
    rows = written(pooled.join(_split(lines).select(F.col("wid").alias("id"), "label", "split"), "id").where(F.col("label").isin(*CLASSES)).withColumn("y", code.cast("long")))
    trainer = train.Trainer(f"{scratch_folder(spark)}/train-{uuid.uuid4().hex}", len(CLASSES), 32, 128, batches=2)
    weights = trainer.fit(rows.where("split = 'train'").select("id", "x", "y"), rows.where("split = 'val'").select("id", "x", "y"), 5)
    predicted = train.predict(rows.where("split <> 'train'").select("label", "x"), weights)
    names = F.array(*map(F.lit, CLASSES))
    return measure.class_report(predicted.select("label", names[F.col("pred").cast("int")].alias("pred")))


def _streamed(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """Run a streaming plan over the events to its end and return what it wrote."""
    path = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.expr(f"'f' || (user_id % {eventlog.STREAMS})").alias("stream"))
    out = build(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"WITH {LINES} SELECT stream, n // {eventlog.WINDOW_LINES} AS window_no, n % {eventlog.WINDOW_LINES} AS log_idx, event_id FROM numbered")
def stream_count_windows(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda rows: streams.stream_count_windows(rows, eventlog.WINDOW_LINES), "append")


@query("""WITH w AS (SELECT 'f' || (user_id % 4) AS stream, date_trunc('hour', ts) AS start, count(*) AS lines, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
 SELECT stream, strftime(start, '%Y-%m-%d %H') AS start, lines, users FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_time_windows(spark, sf_dir):
    rows = _streamed(spark, sf_dir, lambda rows: streams.stream_time_windows(rows), "append")
    return rows.select("stream", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "lines", "users")
