"""Session helpers: table access, shared storage and lineage cuts.

Nothing here keeps state between calls; whatever must outlive an executor goes
to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a temporary folder of
    this machine takes its place.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        own = os.path.join(tempfile.gettempdir(), f"litloom-{uuid.uuid4().hex}")
        sc.setCheckpointDir(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return own
    return have.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to shared storage and read back, with its lineage dropped."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in shared storage, read back: for wide frames of which later steps need few columns each."""
    at = shared_path(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def blank_trim(col):
    """Trim every Unicode blank, not only U+0020."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col):
    """Lower case, every run of blanks made one space, none around."""
    return F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))
