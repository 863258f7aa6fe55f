"""A local session with the settings that tests and the bench use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "loomline") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Local sessions without one get one of their own."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and context._jsc.sc().getCheckpointDir().isDefined():
        given = context._jsc.sc().getCheckpointDir().get()
    if not given and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    given = given or tempfile.mkdtemp(prefix="loomline-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(given)
    return given


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one, deleted when its driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark).rstrip('/')}/loomline-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    if system.mkdirs(path):
        system.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table in this application's folder: found once, by executors that may be lost, whatever reads them."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
