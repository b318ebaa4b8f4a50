"""Folders for intermediate tables that every executor can see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a fresh local one, but only if Spark runs on this machine alone."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if top:
        return top.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    own = getattr(spark.sparkContext, "_tessella_scratch", None)
    if own is None:
        own = spark.sparkContext._tessella_scratch = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return own


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "step", **options: str) -> DataFrame:
    """Write df once and read it back, so that loops don't grow their lineage and survive lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
