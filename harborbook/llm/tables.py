"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new one of our own only where none is named and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result and go on from the written table: what follows neither computes it again nor, after a lost executor,
    anything before it.  The table stays until ``drop`` or the owner of the folder removes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no later step reads, because what was made of them is written itself."""
    for df in tables:
        spark, path = df.sparkSession, df._written_at
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for clusters where it is not installed."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if getattr(context, "_harborbook_shipped", None) != root:
        target = os.path.join(tempfile.mkdtemp(prefix="package-"), "harborbook")
        context.addPyFile(shutil.make_archive(target, "zip", root, "harborbook"))
        context._harborbook_shipped = root
