"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a folder of our own in plain local mode only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or _own_folders.get(sc.applicationId)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of two short columns that every task may hold
TOLD = 1_000_000


def told(df: DataFrame) -> DataFrame:
    """df computed once and, if it has few rows, sent to every task by what joins it, so that the other side is not shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= TOLD else df
