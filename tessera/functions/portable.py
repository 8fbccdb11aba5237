"""Date and JSON helpers with pinned semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz_trunc(unit: str, at: str) -> Column:
    """``date_trunc`` that keeps a timestamp without time zone."""
    return F.date_trunc(unit, F.col(at)).cast("timestamp_ntz")


def time_bucket(at: str, seconds: int) -> Column:
    """The start of the bucket of ``seconds``, counted from 1970, that a timestamp without time zone falls in."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def day_of_week(at: str) -> Column:
    """0 for Sunday to 6 for Saturday, as a long."""
    return (F.dayofweek(F.col(at)) - 1).cast("long")


def json_long(document: str, key: str) -> Column:
    """A whole number from a JSON document's top level."""
    return F.get_json_object(F.col(document), f"$.{key}").cast("long")
