"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_by_weight(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, most_hot: int = 4096) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row per key and how many ``rows`` have it.

    Keys with more than 1/``most_hot`` of all weight are joined by broadcast; there can't be more
    than ``most_hot`` of them, whatever the data. All others are joined by shuffle, where a key then
    brings at most that share to a task. Both inputs are read twice: pass written tables.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    bound = max(10_000, total // most_hot)
    hot = keyed.where(F.col(weight) > bound)
    if not hot.take(1):
        return rows.join(keyed, on)
    hot = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(keyed.where(F.col(weight) <= bound), on))


def small_side(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df``, to be broadcast in a join if it has at most so many rows; they are counted up to there."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def numbered_in_group(rows: DataFrame, group: list[str], ordinal: str, ties: list[str], number: str, total: str, block: int = 1_000_000) -> DataFrame:
    """Adds each row's place in its group (from 0, by ``ordinal``, then ``ties``) and the group's size.

    A group is cut into blocks of ordinals; the counts of its blocks give each block's first number,
    and only a block is ever sorted by one task. A null in a group's column is a value.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    cut = rows.withColumns({k: F.struct(F.col(c)) for k, c in zip(keys, group)}).withColumn("__block", F.floor(F.col(ordinal) / block))
    counts = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    first = F.coalesce(F.sum("__n").over(whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, F.coalesce("__block", F.lit(-1)).alias("__block"), first.alias("__first"), F.sum("__n").over(whole).alias(total))
    cut = cut.withColumn("__block", F.coalesce("__block", F.lit(-1)))
    place = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(ordinal, *ties))
    return cut.withColumn("__place", place).join(offsets, [*keys, "__block"]).withColumn(number, F.col("__first") + F.col("__place") - 1).drop(*keys, "__block", "__place", "__first")
