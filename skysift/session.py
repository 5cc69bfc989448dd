"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import skysift
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on.

    Tables already hash-partitioned by block must join on (block, cell) keys
    without another exchange, hence the co-partition flag.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, where it isn't installed on them."""
    home = os.path.dirname(os.path.abspath(skysift.__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "skysift"), "zip", os.path.dirname(home), "skysift")
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A session on one machine (``local[...]``) that names none gets a folder of
    its own; a cluster has to name one, since executors don't share ``/tmp``.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not current.isDefined():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/skysift-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and go on from there.

    The rows are computed once, survive the loss of executors, and give the next
    step real file sizes to plan with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def cut_and_count(df: DataFrame, flag: str) -> tuple[DataFrame, int]:
    """``cut_lineage`` that also counts the rows where ``flag`` holds, in the same pass."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count_if(flag).alias("n")))
    return out, seen.get["n"]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
