"""A database log stream told by the ``events`` table, and the SQL that says the same elsewhere.

The expressions below are plain SQL that Spark and other engines read alike;
only the timestamp format and the JSON access differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import count_windows

WINDOW_LINES = 50
FEW_SPLITS = 32
STREAMS = 4

THREAD = """CASE user_id % 6
 WHEN 0 THEN 'pool-' || (user_id % 7) || '-App-Flush-' || (user_id % 5)
 WHEN 1 THEN (user_id % 9) || '-server-thread' || k
 WHEN 2 THEN 'grpc-default-executor-' || k
 WHEN 3 THEN 'grpc-default-worker-ELG-3-' || k
 WHEN 4 THEN (user_id % 3 + 1) || '@group-00010000000' || (user_id % 4) || '-StateMachineUpdater'
 ELSE 'pool-2-Query-' || k || '$20240114_144746_0000' || (k % 10) || '_1' END"""

MESSAGE = """CASE event_type
 WHEN 'purchase' THEN 'Flush MemTable root.sg' || (user_id % 3) || '[' || k || '] size=' || k || ' nodeId=' || (user_id % 5)
 WHEN 'signup' THEN 'Peer{groupId=g' || (k % 3) || ', endpoint=TEndPoint(ip:10.0.0.' || (user_id % 250) || ', port:6667), nodeId=' || (user_id % 5) || '} elected, TConsensusGroupId(type:DataRegion, id:' || (k % 7) || ')'
 WHEN 'error' THEN 'OutOfMemory in client-4F2A9C' || (user_id % 10) || (k % 10) || 'ab DataRegion[' || (k % 4) || ']->10.0.1.' || (k % 9) || ' retry=3 term:' || k
 WHEN 'view' THEN 'PartitionCache:276 cache miss for root.app.d' || k || ' blk_' || (user_id * 1000003) || ' t:1'
 ELSE 'opened 17052436725' || (10 + k % 80) || '-1-0-0.tsfile log_inprogress_' || k || ' streamId=7' END"""

RAW_LINE = f"'- ' || ts_s || ' [' || ({THREAD}) || '] INFO  app.' || event_type || ':' || k || ' - ' || ({MESSAGE})"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, and than ``FEW_SPLITS``, dealt over all cores; larger ones are not shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, wid, log_idx, event_id, ts_s, event_type, user_id, k, raw_line), cut into windows of WINDOW_LINES a stream."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        "event_id", "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("ts_s"),
        F.expr(f"'f' || (user_id % {STREAMS})").alias("stream"),
    )
    cut = count_windows(spread(rows), "stream", ["ts", "event_id"], F.date_trunc("hour", "ts"), WINDOW_LINES)
    wid = F.concat("stream", F.lit(":count:"), F.col("window_no"))
    return cut.select("stream", wid.alias("wid"), "log_idx", "event_id", "ts_s", "event_type", "user_id", "k", F.expr(RAW_LINE).alias("raw_line"))


DUCK_LINES = f"""ev AS (
 SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS ts_s, 'f' || (user_id % {STREAMS}) AS stream FROM events
), numbered AS (
 SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts, event_id) - 1 AS n FROM ev
), lines AS (
 SELECT stream, stream || ':count:' || (n // {WINDOW_LINES}) AS wid, n % {WINDOW_LINES} AS log_idx, event_id, ts_s, event_type, user_id, k,
  {RAW_LINE} AS raw_line FROM numbered
)"""
