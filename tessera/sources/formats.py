"""Files in other formats, read with a declared schema so that no pass infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options that make a format's text give back what was written.
OPTIONS = {"csv": {"header": "true", "nullValue": "\\N", "emptyValue": "", "escape": '"'}, "json": {"ignoreNullFields": "false"}, "orc": {}, "parquet": {}}


def write_files(df: DataFrame, path: str, fmt: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a table in one of :data:`OPTIONS`' formats, in folders by ``partition_by``."""
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(OPTIONS)}")
    df.write.format(fmt).options(**OPTIONS[fmt]).partitionBy(*partition_by).save(path)


def read_files(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """Read such a table; filters on the folders' columns skip folders."""
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(OPTIONS)}")
    return spark.read.format(fmt).options(**OPTIONS[fmt]).schema(schema).load(path)
