"""Ranking and sessions, by key and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.operators.ordered import KEY_ROWS, PART, SALT, edges, largest_key, ordered_parts, same
from tessera.session import Scratch


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: list[str], at: str, gap_seconds: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row a session: rows of a key less than ``gap_seconds`` apart; a row without a time is a session of its own, before all others.

    If some key has more than ``key_rows`` rows, the rows are dealt to parts in the order of key and time. Sessions are found within each part; what a
    part needs of those before it is how many sessions its first key has there, and whether the last of them goes on.
    """
    rows = df.select(*by, at)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = gap_seconds * 1_000_000

    def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(at)
        away = micros(F.col(at)) - micros(F.lag(at).over(w))
        fresh = F.when(away < gap, 0).otherwise(1)
        return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys, "session").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_events"))

    if largest_key(rows, by) <= key_rows:
        return gathered(numbered(rows, by), by)

    own = numbered(ordered_parts(rows, [*map(F.col, by), F.col(at)], "sessions"), [PART, *by])
    key = F.struct(*by)
    about = edges(
        own,
        F.min(F.struct(key.alias("key"), micros(F.col(at)).alias("at"))).alias("first"),
        F.max(F.struct(key.alias("key"), F.col("session"), micros(F.col(at)).alias("at"))).alias("last"),
    )
    before, shifts = None, []
    for e in about:
        first, last = e["first"], e["last"]
        goes_on = before is not None and same(before["key"], first["key"])
        shift = 0
        if goes_on:
            near = before["at"] is not None and first["at"] is not None and first["at"] - before["at"] < gap
            shift = before["session"] - near
        shifts.append((e[PART], first["key"], shift))
        here = last.asDict()
        before = here | {"session": last["session"] + (shift if same(first["key"], last["key"]) else 0)}
    kinds = {f.name: f for f in df.schema.fields}
    schema = StructType([own.schema[PART], StructField("_key", StructType([kinds[b] for b in by])), StructField("_shift", LongType())])
    shifted = own.join(F.broadcast(df.sparkSession.createDataFrame(shifts, schema)), PART)  # a row a part
    first_key = F.lit(True)
    for b in by:
        first_key &= F.col(b).eqNullSafe(F.col(f"_key.{b}"))
    return gathered(shifted.withColumn("session", F.col("session") + F.when(first_key, F.col("_shift")).otherwise(0)), by)


def whole_ranks(df: DataFrame, by: list[str], ascending: bool | list[bool] = True, tiles: int = 4, parts: int | None = None) -> DataFrame:
    """``df`` with ``row_number``, ``rank``, ``dense_rank``, ``ntile``, ``percent_rank`` and ``cume_dist`` over the whole table, ordered by ``by``.

    Without a partition Spark ranks a table in one task. Here rows are dealt to parts in order and ranked within each; a row a part then says how many
    rows and different keys stand before it, and how a run of equal keys that crosses the parts' edges is to be counted. Nulls come first where the order
    ascends, else last. Rows with equal keys get their row numbers in any order, as in SQL.
    """
    up = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    order = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(by, up, strict=True)]
    w = Window.partitionBy(PART).orderBy(*order)
    local = {"_row": F.row_number().over(w.orderBy(*order, SALT)), "_rank": F.rank().over(w), "_dense": F.dense_rank().over(w), "_upto": F.count("*").over(w)}
    ranked = Scratch(df.sparkSession, "ranks").table(ordered_parts(df, order, "ranks", parts).withColumns(local))
    key = F.struct(*by)
    about = edges(
        ranked,
        F.count("*").alias("n"), F.max("_dense").alias("different"), F.max("_rank").alias("last_rank"), F.min("_upto").alias("first_upto"),
        F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"),
    )
    rows, before, different, rank_of_last = [], 0, 0, 0
    for i, e in enumerate(about):
        goes_on = i > 0 and same(about[i - 1]["last"], e["first"])
        first_rank = rank_of_last if goes_on else before + 1
        rank_of_last = first_rank if e["last_rank"] == 1 else before + e["last_rank"]
        rows.append([e[PART], before, e["n"], first_rank, 0, different - goes_on])
        different += e["different"] - goes_on
        before += e["n"]
    total = upto = before
    for i in reversed(range(len(about))):
        e, row = about[i], rows[i]
        if i + 1 == len(about) or not same(e["last"], about[i + 1]["first"]):
            upto = row[1] + e["n"]
        row[4] = upto  # of the part's last key; its first key's is the same only if there is no other
        upto = upto if e["different"] == 1 else row[1] + e["first_upto"]
    edge = df.sparkSession.createDataFrame(rows, f"{PART} int, _before long, _n long, _first_rank long, _last_upto long, _different long")
    placed = ranked.join(F.broadcast(edge), PART)  # a row a part
    number = F.col("_before") + F.col("_row")
    rank = F.when(F.col("_rank") == 1, F.col("_first_rank")).otherwise(F.col("_before") + F.col("_rank"))
    upto = F.when(F.col("_upto") == F.col("_n"), F.col("_last_upto")).otherwise(F.col("_before") + F.col("_upto"))
    small, longer = divmod(total, tiles)  # the first ``longer`` tiles have one row more
    tile = F.when(number <= longer * (small + 1), F.floor((number - 1) / (small + 1)) + 1).otherwise(longer + F.floor((number - 1 - longer * (small + 1)) / max(1, small)) + 1)
    return placed.select(
        *df.columns, number.alias("row_number"), rank.alias("rank"), (F.col("_different") + F.col("_dense")).alias("dense_rank"), tile.cast("long").alias("ntile"),
        ((rank - 1) / max(1, total - 1)).alias("percent_rank"), (upto / max(1, total)).alias("cume_dist"),
    )
