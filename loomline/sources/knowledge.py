"""Readers of window and knowledge files, normalised to one entry schema, and sinks with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .one_object import windows_object

WINDOW = "label_file string, window_start string, window_end string, anomaly_types array<string>, logs array<struct<raw_line:string,timestamp:string>>"
TUPLE = "id string, title string, symptom string, root_cause string, fix array<string>, config_params array<string>, anomaly_classes array<string>, subsystems array<string>, version string, tags array<string>, issue_url string"
CODE = "code int, name string, meaning string, common_root_cause string, subsystems array<string>, severity string, fix_hint string, tags array<string>"
PARAMETER = "name string, description string, type string, default string, effective string, anomaly_classes array<string>, subsystems array<string>"
ENTRY = ["id", "origin_file", "doc_type", "title", "symptom", "root_cause", "fix", "config_params", "anomaly_classes", "subsystems", "tags"]


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths or patterns that match anything: a corpus is read without the files that it lacks."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            out.append(path)
    return out


def windows_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(wid, *WINDOW) from files that each hold one object of windows by id, of any length."""
    return windows_object(spark, paths, _struct(WINDOW))


def windows_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same from JSON lines with wid. Missing files are passed over; without any there are no rows."""
    paths = present(spark, paths)
    if not paths:
        return spark.createDataFrame([], "wid string, " + WINDOW)
    return spark.read.schema("wid string, " + WINDOW).json(paths)


def log_lines(windows: DataFrame) -> DataFrame:
    """(wid, log_idx, ts_s, raw_line) of the windows, empty lines left out."""
    return windows.select("wid", F.posexplode("logs").alias("log_idx", "log")).select("wid", F.col("log_idx").cast("long"), F.col("log.timestamp").alias("ts_s"), F.col("log.raw_line").alias("raw_line")).where("raw_line <> ''")


def _struct(ddl: str) -> str:
    return ", ".join(":".join(field.strip().split(" ", 1)) for field in _fields(ddl))


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _file() -> F.Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)


def tuple_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of files with a ``tuples`` list."""
    rows = spark.read.text(paths, wholetext=True).withColumn("origin_file", _file())
    parsed = rows.select("origin_file", F.from_json("value", f"struct<doc_type:string, tuples:array<struct<{_struct(TUPLE)}>>>").alias("f"))
    return parsed.select("origin_file", F.col("f.doc_type").alias("doc_type"), F.explode("f.tuples").alias("t")).select("origin_file", "doc_type", "t.*").select(*ENTRY)


def code_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of status-code files: a code counts once, for the class that names it first; diagnostic ones are tagged."""
    rows = spark.read.text(paths, wholetext=True).withColumn("origin_file", _file())
    parsed = rows.select("origin_file", F.from_json("value", f"struct<by_anomaly_class:map<string,array<struct<{_struct(CODE)}>>>, key_anomaly_diagnostic_codes:map<string,array<int>>>").alias("f"))
    classes = parsed.select("origin_file", F.flatten(F.map_values("f.key_anomaly_diagnostic_codes")).alias("key_codes"), F.posexplode(F.map_entries("f.by_anomaly_class")).alias("class_pos", "c"))
    codes = classes.select("origin_file", "key_codes", "class_pos", F.col("c.key").alias("anomaly_class"), F.posexplode("c.value").alias("pos", "s"))
    return first_class(codes.select("origin_file", "key_codes", "class_pos", "anomaly_class", "pos", "s.*")).select(
        F.format_string("SC-%d", "code").alias("id"), "origin_file", F.lit("status_code").alias("doc_type"), F.format_string("%d %s", "code", "name").alias("title"),
        F.col("meaning").alias("symptom"), F.col("common_root_cause").alias("root_cause"), F.when(F.col("fix_hint").isNotNull(), F.array("fix_hint")).otherwise(F.array().cast("array<string>")).alias("fix"),
        F.array().cast("array<string>").alias("config_params"), F.array("anomaly_class").alias("anomaly_classes"), "subsystems",
        F.when(F.array_contains("key_codes", F.col("code")), F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit("smoking_gun"))).otherwise(F.col("tags")).alias("tags"),
    )


def first_class(codes: DataFrame) -> DataFrame:
    """Of each code the row that comes first by class and place."""
    rank = F.row_number().over(W.partitionBy("code").orderBy("class_pos", "pos"))
    return codes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def parameter_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of configuration files; parameters without a class are left out."""
    rows = spark.read.text(paths, wholetext=True).withColumn("origin_file", _file())
    parsed = rows.select("origin_file", F.explode(F.from_json("value", f"struct<parameters:array<struct<{_struct(PARAMETER)}>>>")["parameters"]).alias("p")).select("origin_file", "p.*")
    none = F.array().cast("array<string>")
    return parsed.where(F.size("anomaly_classes") > 0).select(
        F.concat(F.lit("CFG-"), "name").alias("id"), "origin_file", F.lit("config").alias("doc_type"), F.concat(F.lit("Configuration: "), "name").alias("title"), F.col("description").alias("symptom"),
        F.concat_ws("; ", F.concat(F.lit("type "), "type"), F.concat(F.lit("default "), "default"), F.concat(F.lit("effective "), "effective")).alias("root_cause"),
        none.alias("fix"), F.array("name").alias("config_params"), "anomaly_classes", "subsystems", none.alias("tags"),
    )


def remaining(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets not written yet: resume is an anti-join."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence files of a folder tree with the explanation text that stands beside each."""
    stem = F.regexp_replace(F.input_file_name(), r"_(?:evidence\.json|explanation\.md)$", "")
    evidence = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_evidence.json").text(folder, wholetext=True).select(stem.alias("stem"), F.col("value").alias("evidence_json"))
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_explanation.md").text(folder, wholetext=True).select(stem.alias("stem"), F.col("value").alias("text"))
    return evidence.join(texts, "stem", "left")


def write_with_parameters(df: DataFrame, path: str, parameters: dict[str, str]) -> None:
    """Write a table with the parameters that made it, kept as a one-row table beside it."""
    df.write.parquet(f"{path}/rows")
    df.sparkSession.createDataFrame(sorted(parameters.items()), "name string, value string").coalesce(1).write.parquet(f"{path}/parameters")


def read_compatible(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """The rows of such a table, if its parameters are as wanted."""
    have = {r.name: r.value for r in spark.read.parquet(f"{path}/parameters").collect()}
    wrong = {k: (have.get(k), v) for k, v in wanted.items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"made with other parameters (have, wanted): {wrong}")
    return spark.read.parquet(f"{path}/rows")


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows as JSON lines, as :func:`windows_lines` reads them."""
    windows.write.json(path)
