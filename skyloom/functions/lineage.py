"""Sharing an intermediate table between the branches of a plan, and cutting the lineage of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` of one round of an iterative plan."""
    scratch(df.sparkSession)
    return df.checkpoint(eager)


_WORK = ("Join", "Aggregate", "Window", "Generate", "Sort", "RepartitionBy")


def share(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for all the branches that read it: a table written to the shared folder.

    A plan that reads its own input twice, at several levels, would run (and plan) the first level 2^n times.  The
    written table cuts both; it survives the loss of any executor, its readers keep column pruning and pushdown, and
    its true size is known to the joins after it.  A plan that only reads, projects and filters files is left alone:
    reading again is cheaper than a copy.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    if not any(w in plan for w in _WORK):
        return df
    spark = df.sparkSession
    path = f"{scratch(spark)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
