"""Session-wide helpers: table reading, scratch storage, spreading of work."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a folder of this
    machine is used; a session on a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="termloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _folder(spark: SparkSession):
    """This application's part of the shared folder, as Hadoop's path and file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), "termloom", context.applicationId))
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder. What an application leaves there goes when it ends, or by ``clean_scratch``."""
    context = spark.sparkContext
    path, fs = _folder(spark)
    if not getattr(context, "_termloom_scratch", False):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        context._termloom_scratch = True
    return os.path.join(path.toString(), f"{name}-{uuid.uuid4().hex}")


def clean_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application's operators left in the shared folder. Frames made before read them still: call it when their results are written."""
    path, fs = _folder(spark)
    fs.delete(path, True)
    above = path.getParent()
    if fs.exists(above) and not fs.listStatus(above):
        fs.delete(above, False)
    spark.sparkContext._termloom_scratch = False


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Setting by which Spark deletes the shuffle files of a statement when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_passes(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """The union of ``frames``, stored; each is written, and its shuffle files deleted, before the next one is made."""
    path = None
    for df in frames:
        conf = df.sparkSession.conf
        path, before = path or scratch(df.sparkSession, name), conf.get(_FREED, None)
        conf.set(_FREED, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            conf.set(_FREED, before) if before is not None else conf.unset(_FREED)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``in_passes`` stored of the frames, which nothing may read from now on."""
    for df in frames:
        if path := getattr(df, "_termloom_path", None):
            folder, fs = _folder(df.sparkSession)
            fs.delete(folder.suffix(path.removeprefix(folder.toString())), True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows spread over all cores when the input has fewer splits than that.

    For CPU-heavy Python stages over small files. Larger inputs already come in
    enough splits and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a session; for sessions whose workers can't import it themselves."""
    context = spark.sparkContext
    if getattr(context, "_termloom_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="termloom-"), "termloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._termloom_shipped = True
    return spark
