"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "driftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per
    application. A no-op when it was started from an archive (``--py-files``)."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _SHIPPED or not os.path.isdir(os.path.join(root, "driftlens")):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "driftlens")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "driftlens"))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins; a directory already set on the context comes
    next. A local folder is made only on a local master (tests, notebooks): on a
    cluster each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Iterative operators call this once per round: the plan stays short, a lost
    executor costs one round at most, and the reader gets real size statistics,
    so broadcast decisions are made on measured sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGES: dict[tuple[str, str, str], str] = {}


def stage_path(spark: SparkSession, scope: str, name: str, write) -> str:
    """Folder of a derived data set, written once per session and scope by
    ``write(path)``."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        write(path)
        _STAGES[key] = path
    return _STAGES[key]


def stage_table(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """The table between two recompute stages: ``build`` is a function returning
    a DataFrame and only runs when the table is missing."""
    return spark.read.parquet(
        stage_path(spark, scope, name, lambda path: build().write.mode("overwrite").parquet(path))
    )
