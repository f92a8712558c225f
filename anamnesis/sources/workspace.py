"""Shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A temporary folder is set only on a local master where nothing is named, and removed at
    the end: on a cluster every executor must see the same files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="anamnesis-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it ends. Else they stay until the driver collects its garbage,
#: so a job of many steps has those of all steps on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back, which fixes its rows and cuts its lineage; its shuffle files go with the write."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._anamnesis_path = path
    return written


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that reads them is written itself.

    Nothing that was derived from them may be run afterwards.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._anamnesis_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits to all cores, for work that is heavy per row.

    A scan that already has a task per core is left as it is. ``df`` is a scan with
    projections and filters only, whose tasks are known without running anything.
    """
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallel) if df.rdd.getNumPartitions() < parallel else df


def send_code(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each Spark application.

    Spark's file server hands the archive to every executor, so none needs the package installed.
    """
    context = spark.sparkContext
    if getattr(context, "_anamnesis_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copytree(
            top, os.path.join(folder, "code", "anamnesis"), ignore=shutil.ignore_patterns("__pycache__")
        )
        name = os.path.join(context._temp_dir, "anamnesis-code")
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(copy)))
    context._anamnesis_sent = True
