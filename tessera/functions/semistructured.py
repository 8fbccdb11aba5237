"""JSON texts of any shape as VARIANT: nested paths, arrays, and documents that can't be read set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, into: str = "document") -> tuple[DataFrame, DataFrame]:
    """Rows whose text is JSON, with it as VARIANT, and the rows whose text isn't; a null text is neither wrong nor a document and stays null."""
    tried = df.withColumn(into, F.try_parse_json(column))
    bad = F.col(into).isNull() & F.col(column).isNotNull()
    return tried.where(~bad), tried.where(bad).drop(into)


def at(document: str, path: str, kind: str) -> Column:
    """The value at a path such as ``$.user.tags[0]`` as a type; null where there is none or it can't be cast."""
    return F.try_variant_get(document, path, kind)


def elements(df: DataFrame, document: str, path: str, into: str = "element", place: str = "place") -> DataFrame:
    """A row for each element of the array at a path, with its place from 0; rows without one give none."""
    return df.select("*", F.posexplode(F.try_variant_get(document, path, "array<variant>")).alias(place, into))


def kinds(df: DataFrame, document: str, by: list[str]) -> DataFrame:
    """``(by..., kind, n)``: which types the documents have, as Spark names their schemas."""
    return df.groupBy(*by, F.schema_of_variant(document).alias("kind")).agg(F.count("*").alias("n"))
