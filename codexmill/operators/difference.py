"""Two snapshots of the same files, compared key by key in one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.functions import text as X


def last_per_key(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per key, null being a key: the last in order, with digest and sizes instead of the text."""
    measured = rows.select(
        *by,
        "act_id",
        F.struct(*order).alias("o"),
        F.struct(
            F.coalesce(F.sha2("text", 256), F.lit("NULL")).alias("digest"),
            F.length(F.coalesce("text", F.lit(""))).alias("chars"),
            F.sha2(X.operative(F.col("text")), 256).alias("operative"),
        ).alias("v"),
    )
    return measured.groupBy(*by, "act_id").agg(F.max_by("v", "o").alias("v"))


def compare_snapshots(old: DataFrame, new: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, act_id, change, grew, shrank, same_operative, chars before and after) of every key.

    ``change`` is unchanged, amended, added or removed. Null keys are equal to each other; a null
    text differs from an empty one. A key may hold a third of all rows: it is one row when joined.
    """
    a, b = last_per_key(old, by, order).alias("a"), last_per_key(new, by, order).alias("b")
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "act_id")]
    was, now = F.col("a.v"), F.col("b.v")
    change = F.when(was.isNull(), "added").when(now.isNull(), "removed").when(was["digest"] == now["digest"], "unchanged").otherwise("amended")
    amended: Column = F.col("change") == "amended"
    return (
        a.join(b, keys, "full_outer")
        .select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*by, "act_id")], change.alias("change"), was.alias("was"), now.alias("now"))
        .select(
            *by,
            "act_id",
            "change",
            (amended & (F.col("now.chars") > F.col("was.chars"))).alias("grew"),
            (amended & (F.col("now.chars") < F.col("was.chars"))).alias("shrank"),
            (amended & (F.col("now.operative") == F.col("was.operative"))).alias("same_operative"),
            F.col("was.chars").alias("old_chars"),
            F.col("now.chars").alias("new_chars"),
        )
    )


def difference_totals(changes: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    amended = F.col("change") == "amended"
    return changes.groupBy(*by).agg(
        *[n(F.col("change") == c).alias(c) for c in ("unchanged", "amended", "added", "removed")],
        n(F.col("grew")).alias("grew"),
        n(F.col("shrank")).alias("shrank"),
        n(F.col("same_operative")).alias("same_operative"),
        F.coalesce(F.sum(F.when(amended, F.col("old_chars"))), F.lit(0)).alias("old_chars"),
        F.coalesce(F.sum(F.when(amended, F.col("new_chars"))), F.lit(0)).alias("new_chars"),
    )


def moved_rows(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``new`` whose status says that they moved: was the key there before, and where to."""
    known = old.select(*by, "act_id").distinct().withColumn("known", F.lit(True))
    moved = new.where(F.col("act_status").isin(*X.MOVE_STATUSES))
    keys = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*by, "act_id")]
    return moved.alias("n").join(known.alias("k"), keys, "left").select(
        *[F.col(f"n.{c}").alias(c) for c in (*by, "row_id", "act_id")],
        F.col("n.act_status").alias("status"),
        F.coalesce("k.known", F.lit(False)).alias("self_in_old"),
        X.successor_number(F.col("n.text")).alias("successor"),
    )
