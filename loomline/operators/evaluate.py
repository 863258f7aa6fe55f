"""Checks of generated reports: citations, mentions against whitelists, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hyphens that count as "-", the citation forms, and what counts as a mention.
HYPHENS = "‐‑–—"
CITED_ID = r"(?i)\(see\s+([A-Z]{2,4}-[\w.\-]+?)\)"
CITED_RANK = r"(?i)\bTuple\s*(\d+)\b"
CONFIG_SET = r"(?i)SET CONFIGURATION\s+['\"`]?([a-z][a-z0-9_]+[a-z0-9])['\"`]?\s*="
CONFIG_QUOTED = (
    r"['`]([a-z][a-z0-9_]{4,}_(?:threshold|size|count|time|rate|interval|max|min|enable|num|sec|ms|bytes?|in_byte|in_b|class|proportion|mb|kb|"
    r"pool_size|thread|gb|cache|hold|tail|memtable|dir|mode|level|protocol|factor|capacity|window|round|deadline|len|length))['`]"
)
COMMAND = (
    r"\b(SHOW [A-Z_]+(?:\s+[A-Z_]+)?|FLUSH|KILL\s+(?:QUERY|ALL QUERIES)|START REPAIR DATA|STOP REPAIR DATA|SET SYSTEM TO (?:READONLY|RUNNING)|"
    r"SET CONFIGURATION|SET SQL_DIALECT|LOAD CONFIGURATION|MIGRATE REGION|REMOVE (?:DATANODE|CONFIGNODE)|EXPLAIN(?:\s+ANALYZE)?|SET TTL|UNSET TTL|"
    r"CREATE (?:DATABASE|TIMESERIES|ALIGNED TIMESERIES)|DELETE (?:TIMESERIES|STORAGE GROUP|DATABASE)|COUNT (?:TIMESERIES|DEVICES))\b"
)
TOOL = (
    r"(?:^|[\s/`'\"(])((?:health_check|print-iotdb-data-dir|print-tsfile(?:-sketch|-resource-files)?|start-cli|start-datanode|start-confignode|"
    r"stop-datanode|stop-confignode|destroy-datanode|export-tsfile|import-tsfile|export-csv|import-csv|export-schema)\.(?:sh|bat))"
)
VARIABLE = r"\b(IOTDB_HEAP_SIZE|IOTDB_JMX_OPTS|CONFIGNODE_JMX_OPTS|MAX_DIRECT_MEMORY_SIZE|MAX_HEAP_SIZE|MEMORY_SIZE|JAVA_HOME|JAVA_OPTS|IOTDB_HOME|IOTDB_CONF)\b"


def plain_hyphens(text: Column) -> Column:
    return F.translate(text, HYPHENS, "-" * len(HYPHENS))


def citations(reports: DataFrame) -> DataFrame:
    """Adds ``cited_ids`` and ``cited_ranks``, the distinct citations of ``text``, sorted."""
    text = plain_hyphens(F.col("text"))
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITED_ID), F.lit(1))))
    ranks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITED_RANK), F.lit(1)), lambda n: n.cast("long"))))
    return reports.withColumn("cited_ids", ids).withColumn("cited_ranks", ranks)


def citation_validity(cited: DataFrame, known: Column) -> DataFrame:
    """Counts of citations that are in ``evidence``, elsewhere in ``known``, or nowhere; and of ranks in and out of range."""
    outside = F.array_except("cited_ids", "evidence")
    k = F.size(F.array_distinct("evidence"))
    return (
        cited.withColumn("valid_ids", F.size(F.array_intersect("cited_ids", "evidence")).cast("long"))
        .withColumn("existing_ids", F.size(F.array_intersect(outside, known)).cast("long"))
        .withColumn("bogus_ids", F.size(F.array_except(outside, known)).cast("long"))
        .withColumn("valid_ranks", F.size(F.filter("cited_ranks", lambda n: (n >= 1) & (n <= k))).cast("long"))
        .withColumn("invalid_ranks", F.size(F.filter("cited_ranks", lambda n: (n < 1) | (n > k))).cast("long"))
    )


def cites_evidence(text: Column, evidence: Column) -> Column:
    """Whether the text holds the id of a piece of evidence literally, or a tuple by rank."""
    text = plain_hyphens(text)
    return F.exists(evidence, lambda x: (x != "") & F.contains(text, x)) | text.rlike(CITED_RANK)


def mentions(text: Column) -> dict[str, Column]:
    """Distinct settings (lower case), commands (upper case), tools and environment variables that a report names."""
    text = plain_hyphens(text)
    settings = F.concat(F.regexp_extract_all(text, F.lit(CONFIG_SET), F.lit(1)), F.regexp_extract_all(text, F.lit(CONFIG_QUOTED), F.lit(1)))
    commands = F.regexp_extract_all(text, F.lit(COMMAND), F.lit(1))
    named = {kind: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))) for kind, pattern in (("tools", TOOL), ("variables", VARIABLE))}
    return named | {"settings": F.array_sort(F.array_distinct(F.transform(settings, F.lower))), "commands": F.array_sort(F.array_distinct(F.transform(commands, lambda c: F.upper(F.trim(c)))))}


def unknown_settings(settings: Column, valid: list[str]) -> Column:
    """Settings outside the dictionary; without a dictionary nothing can be said, so null."""
    return F.array_except(settings, F.array(*[F.lit(v.lower()) for v in valid])) if valid else F.lit(None).cast("array<string>")


def outside(names: Column, known: list[str]) -> Column:
    """Names that are not among the known ones."""
    return F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))


def unknown_commands(commands: Column, known: list[str]) -> Column:
    """Commands of which no known one is a prefix, and which are no prefix of a known one."""
    whitelist = F.array(*map(F.lit, known))
    return F.filter(commands, lambda m: ~F.exists(whitelist, lambda k: m.startswith(k) | k.startswith(m)))


def keyword_hit(text: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the text, letter case aside."""
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def without_thoughts(text: Column) -> Column:
    """The text without the parts that a model has marked as thinking."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
