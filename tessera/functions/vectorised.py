"""Python functions over Arrow batches, for what has no built-in function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def vowel_share(text: Column | str) -> Column:
    """Share of a text's characters that are vowels, as a scalar pandas function."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.count("[aeiouAEIOU]") / s.str.len().where(lambda n: n > 0)

    return run(text)


def geometric_means(rows: DataFrame, by: list[str], values: str, name: str) -> DataFrame:
    """``by`` and the geometric mean of positive values, null if there are none.

    Python adds up logarithms by group within each Arrow batch, Spark the few sums of all batches, so no task holds a group.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = pa.table([*batch.columns[:-1], pc.ln(batch.columns[-1])], names=[*by, "_log"])
            yield from logs.group_by(by, use_threads=False).aggregate([("_log", "sum"), ("_log", "count")]).select([*by, "_log_sum", "_log_count"]).to_batches()

    kinds = StructType([*[rows.schema[c] for c in by], StructField("_log_sum", DoubleType()), StructField("_log_count", LongType())])
    added = rows.select(*by, F.col(values).cast("double")).mapInArrow(sums, kinds).groupBy(*by)
    return added.agg(F.exp(F.sum("_log_sum") / F.nullif(F.sum("_log_count"), F.lit(0))).alias(name))


class _Words:
    def eval(self, rows: pa.RecordBatch):
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(rows.column("text").fill_null("")))
        row, word = pc.list_parent_indices(split), split.flatten()
        starts = split.offsets.to_numpy()[:-1]
        place = np.arange(len(word)) - (starts - starts[:1])[row.to_numpy()]
        found = pa.table({"id": rows.column("id").take(row), "word": word, "place": pa.array(place, pa.int32())})
        yield found.filter(pc.not_equal(found.column("word"), ""))


def words(rows: DataFrame) -> DataFrame:
    """``(id, word, place)`` of the words of ``rows(id, text)``, by a table function over Arrow batches."""
    return F.arrow_udtf(_Words, returnType="id long, word string, place int")(rows.asTable())
