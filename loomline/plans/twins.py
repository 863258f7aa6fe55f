"""The shared parts of the DuckDB twins: the log lines, their entities and the window labels."""

from __future__ import annotations

from ..functions import entities as E
from ..sources.eventlog import DUCK_LINES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(pattern: str, group: int = 1, text: str = "raw_line") -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


MESSAGE = f"regexp_replace(raw_line, {q(E.HEADER)}, '')"
THREAD = f"nullif(regexp_extract(raw_line, {q(E.HEADER)}, 1), '')"


def cleaned(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, {q(pattern)}, '', 'g')"
    return text


def thread_group(name: str) -> str:
    s = f"trim({name})"
    cut = cleaned(s, r"^pool-\d+-", r"^\d+@group-[0-9a-fA-F]+-", r"\$\d{8}_\d{6}_\d+_\d+$", r"(?:-\d+)+$", r"^-+|-+$")
    return f"""CASE WHEN regexp_matches({s}, {q(r'^\d+-server-thread\d*$')}) THEN 'server-thread'
 WHEN regexp_matches({s}, {q(r'^grpc-default-executor-\d+$')}) THEN 'grpc-default-executor'
 WHEN regexp_matches({s}, {q(r'^grpc-default-worker(?:-ELG-\d+-\d+)?$')}) THEN 'grpc-default-worker'
 WHEN length({cut}) >= 2 THEN {cut} END"""


KEEPS = f"""CASE WHEN length(v) < 3 OR length(v) >= 40 THEN false
 WHEN regexp_matches(v, {q(E.UUID)}) OR regexp_matches(v, {q(r'^\d+$')}) OR (regexp_matches(v, '^[0-9a-fA-F]+$') AND length(v) >= 12) THEN false
 WHEN regexp_matches(v, {q(r'\.(?:tsfile|wal|log)$')}) THEN false
 WHEN contains(v, '.') AND NOT regexp_matches(v, {q(r'[:=\[]')}) THEN false
 WHEN regexp_extract(v, {q(E.KEY_VALUE)}, 1) IN ({', '.join(map(q, E.PROTOCOL_KEYS))}) THEN false
 WHEN regexp_matches(v, {q(E.CLASS_LINE)}) THEN NOT regexp_matches(v, {q(E.FRAMEWORK)}) AND regexp_matches(v, {q(E.BUSINESS)})
 ELSE true END"""

TOKENS = "list_distinct(" + " || ".join(found(p, 0, "msg") for p in E.TOKENS) + ")"
CORPUS_TOKENS = "list_filter(list_distinct(" + " || ".join(found(p, 0, "msg") for p in E.CORPUS_TOKENS) + f"), lambda v: length(v) >= 3 AND NOT regexp_matches(v, {q(E.TIMESTAMP_ID)}))"
CONSENSUS = f"list_transform(list_zip({found(E.CONSENSUS, 1)}, {found(E.CONSENSUS, 2)}), lambda x: x[1] || ':' || x[2])"


def _part(kind: str, value: str, where: str = "") -> str:
    return f"SELECT wid, log_idx, '{kind}' AS entity_type, {value} AS entity FROM said {where}"


LINES = DUCK_LINES + f", said AS (SELECT *, {MESSAGE} AS msg, {THREAD} AS thread FROM lines)"
_PARTS = [
    _part("DataRegion", f"'Database:' || unnest({found(E.DATABASE)})"),
    _part("DataRegion", f"'DataRegion:' || unnest({found(E.REGION)})"),
    _part("ConsensusGroup", f"'group-' || unnest({found(E.NODE_AT_GROUP, 2)})"),
    _part("ConsensusGroup", f"unnest({CONSENSUS})"),
    _part("Node", f"'node' || unnest({found(E.NODE_AT_GROUP, 1)})"),
    _part("Node", f"unnest({found(E.PEER, 2)})"),
    _part("Node", f"unnest({found(E.NODE_ID)})"),
    _part("GeneralEntity", f"'TsFile:' || unnest({found(E.DATA_FILE)})"),
    _part("GeneralEntity", f"'LogProgress:' || unnest({found(E.LOG_PROGRESS)})"),
    _part("GeneralEntity", f"'ClientId:' || left(unnest({found(E.CLIENT)}), 8)"),
    *[_part("GeneralEntity", f"'Subsystem:{name}'", f"WHERE regexp_matches(msg, {q(p)})") for name, p in E.SUBSYSTEMS],
    f"SELECT wid, log_idx, 'GeneralEntity', 'ThreadGroup:' || g FROM (SELECT wid, log_idx, {thread_group('thread')} AS g FROM said) WHERE g IS NOT NULL",
    f"SELECT wid, log_idx, 'GeneralEntity', v FROM (SELECT wid, log_idx, unnest({TOKENS}) AS v FROM said) WHERE {KEEPS}",
]
ENTITIES = LINES + ", ents AS (" + "\nUNION\n".join(_PARTS) + ")"
LABELS = """typed AS (
 SELECT wid, list(event_type ORDER BY n DESC, event_type) AS types FROM (SELECT wid, event_type, count(*) AS n FROM lines GROUP BY ALL) GROUP BY wid
), labelled AS (SELECT wid, types, coalesce(types[1], 'normal') AS label FROM typed)"""
MASK = "regexp_replace(regexp_replace(msg, " + q(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}") + ", '<*>', 'g'), " + q(r"0x[0-9a-fA-F]+|\d+") + ", '<*>', 'g')"
RECORDS = f"""recs AS (
 SELECT s.wid, s.log_idx, s.ts_s, s.raw_line, s.thread, {MASK} AS template, e.entities FROM said s
 LEFT JOIN (SELECT wid, log_idx, list(entity_type || ':' || entity) AS entities FROM ents GROUP BY ALL) e ON s.wid = e.wid AND s.log_idx = e.log_idx
), comp AS (
 SELECT wid, template, count(*) AS count, arg_min(raw_line, {{'a': ts_s, 'b': log_idx}}) AS raw_line, arg_max(raw_line, {{'a': ts_s, 'b': log_idx}}) AS raw_line_last,
  min(ts_s) AS first_ts, max(ts_s) AS last_ts, min(log_idx) AS first_idx, list_sort(list_distinct(flatten(list(entities)))) AS entities FROM recs GROUP BY wid, template
)"""


def scores(within: str = "") -> str:
    """Neighbour scores over a CTE we(wid, entity, ...)."""
    return f"""scored AS (SELECT a.wid, b.wid AS neighbor, count(*) AS score FROM we a JOIN we b ON a.entity = b.entity {within} AND a.wid <> b.wid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY score DESC, neighbor) AS rank FROM scored)"""
