"""SQL over events joined with other Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_]*$")


def register_tables(spark: SparkSession, tables: dict[str, str | list[str] | DataFrame]) -> None:
    """Make tables available to ``spark.sql``: names to Parquet paths or DataFrames."""
    for name, source in tables.items():
        if not _NAME.match(name):
            raise ValueError(f"table names must be simple identifiers: {name!r}")
        if isinstance(source, DataFrame):
            table = source
        else:
            paths = [source] if isinstance(source, str) else list(source)
            if not paths:
                raise ValueError(f"table {name} needs at least one Parquet path")
            table = spark.read.parquet(*paths)
        table.createOrReplaceTempView(name)


def parse_table_specs(text: str) -> dict[str, list[str]]:
    """``name=path[,path];...`` as a mapping; repeated names are an error."""
    tables: dict[str, list[str]] = {}
    for entry in filter(None, (part.strip() for part in text.split(";"))):
        name, found, locations = entry.partition("=")
        name = name.strip()
        paths = [p.strip() for p in locations.split(",") if p.strip()]
        if not found or not paths or not _NAME.match(name):
            raise ValueError(f"expected name=path[,path]: {entry}")
        if name in tables:
            raise ValueError(f"table {name} is given twice")
        tables[name] = paths
    return tables


def query(spark: SparkSession, sql: str, tables: dict[str, str | list[str] | DataFrame]) -> DataFrame:
    """Register tables and run one query over them."""
    register_tables(spark, tables)
    return spark.sql(sql)
