"""Folders and tables that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may leave the setting empty; it then gets
    a temporary folder. On a cluster a missing setting is an error, since executors
    could not read what another machine wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` as a table in the shared folder and return its path."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives later plans the true
    size of the table.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(column: str):
    """CRC-32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string"))
