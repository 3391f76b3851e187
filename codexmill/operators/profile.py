"""Column profiles of loads, and which columns moved since the load before.

Declared checks are compiled into one aggregate scan. :func:`compile_slots` collects what the checks
need of each column (its values, or the shapes of its values) as numbered slots; :func:`value_states`
turns each row into one small entry per slot and counts equal entries. Those counts are the mergeable
state: states of different files, days or late rows add up (:func:`merge_states`), so a load that
grows is never scanned again. :func:`summarise` folds a state into metrics, and the checks compare a
load's metrics with control limits drawn from its history.

Scale: rows shrink to 64-bit keys before the only large shuffle, which is on (load, slot, key) and
pre-aggregated, so a load that holds a third of all rows is spread over all tasks. The second level
is pre-aggregated per (load, slot). What follows is a few rows per load and column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codexmill.operators.workspace import written
from codexmill.schema import SNAPSHOT_COLUMNS

VALUE, SHAPE, SHARE = "value", "shape", "share"


@dataclass(frozen=True)
class Fraction:
    """An exact limit, ``above / below``; rates are compared without rounding."""

    above: int
    below: int


@dataclass(frozen=True)
class Check:
    """One declared constraint: which columns, which slot it reads, and its limit."""

    measure: str
    columns: tuple[str, ...]
    slot: str = VALUE
    limit: Fraction = Fraction(0, 1)
    least: int = 0


def standard_checks(columns: tuple[str, ...] = SNAPSHOT_COLUMNS) -> tuple[Check, ...]:
    """The checks of the snapshot contract."""
    return (
        Check("not_unique", ("act_id",)),
        Check("null_rate", columns, limit=Fraction(15, 100)),
        Check("empty_rate", columns, limit=Fraction(15, 100)),
        Check("distinct_count", columns, limit=Fraction(2, 1), least=20),
        Check("value_range", columns, limit=Fraction(1, 1)),
        Check("pattern", ("act_id", "citation", "section_number", "source_url"), SHAPE, Fraction(5, 100)),
        Check("distribution", ("act_status", "document_type"), SHARE, Fraction(20, 100)),
    )


def compile_slots(checks: tuple[Check, ...]) -> list[tuple[str, str]]:
    """The (slot kind, column) pairs that the checks read, each once."""
    return sorted({(c.slot, name) for c in checks for name in c.columns})


def shape_of(value: Column) -> Column:
    """Each run of A-Z, a-z, 0-9 as ``A``, ``a``, ``9``."""
    for run, mark in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "9")):
        value = F.regexp_replace(value, run, mark)
    return value


def _is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _keys(df: DataFrame, kind: str, name: str, unique: bool) -> tuple[Column, Column]:
    """The 64-bit key of a slot's value, null for null, and a second one where 128 bits are needed."""
    value = F.col(name)
    if _is_integer(df, name):
        key = value.cast("long")
    else:
        value = value.cast("string")
        if kind == SHAPE:
            value = F.when(value != "", shape_of(value))
        key = F.when(value.isNotNull(), F.xxhash64(value))
    # Uniqueness is a statement on single values.
    return key, F.when(value.isNotNull(), F.xxhash64(F.lit(name), value)) if unique else F.lit(None).cast("long")


def value_states(df: DataFrame, load: str, checks: tuple[Check, ...]) -> DataFrame:
    """The mergeable state of each load: (load, slot, key, key2, n), n rows having that key.

    A null value is the null key. Rows with a null load belong to no load and don't count. Other
    columns are never read.
    """
    unique = {name for c in checks if c.measure == "not_unique" for name in c.columns}
    slots = compile_slots(checks)
    wide = [F.col(load).alias("load_id")]
    for i, (kind, name) in enumerate(slots):
        key, second = _keys(df, kind, name, kind == VALUE and name in unique)
        wide += [F.lit(i).alias(f"s{i}"), key.alias(f"k{i}"), second.alias(f"z{i}")]
    # Unpivoting expands rows as plain numbers, without building an array or a structure for each.
    parts = ", ".join(f"(s{i}, k{i}, z{i})" for i in range(len(slots)))
    entries = df.sparkSession.sql(
        f"SELECT load_id, slot, key, key2 FROM {{wide}} UNPIVOT INCLUDE NULLS ((slot, key, key2) FOR part IN ({parts}))", wide=df.where(F.col(load).isNotNull()).select(*wide)
    )
    return entries.groupBy("load_id", "slot", "key", "key2").agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of the union of what the given states hold."""
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    return merged.groupBy("load_id", "slot", "key", "key2").agg(F.sum("n").alias("n"))


def summarise(states: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    """Metrics per load and slot; for shapes and shares one row per key, in ``key``.

    Columns: load_id, kind, column_name, key (null for values), rows, nulls, empties, distincts,
    most (rows of the most frequent non-null key), low and high (meaningful for integers).
    """
    slots = compile_slots(checks)
    values = [i for i, (k, _) in enumerate(slots) if k == VALUE]
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column_name")) for k, c in slots])
    there, empty = F.col("key").isNotNull(), F.xxhash64(F.lit(""))
    return (
        states.withColumn("sub", F.when(~F.col("slot").isin(values), F.col("key")))
        .groupBy("load_id", "slot", "sub")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("nulls"),
            F.sum(F.when(F.col("key") == empty, F.col("n")).otherwise(0)).alias("empties"),
            F.sum(F.when(there, 1).otherwise(0)).alias("distincts"),
            F.max(F.when(there, F.col("n"))).alias("most"),
            F.min("key").alias("low"),
            F.max("key").alias("high"),
        )
        .select("load_id", names[F.col("slot")].alias("s"), F.col("sub").alias("key"), "rows", "nulls", "empties", "distincts", "most", "low", "high")
        .select("load_id", "s.*", "key", "rows", "nulls", "empties", "distincts", "most", "low", "high")
    )


def _big(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def _share_moved(part: str, limit: Fraction) -> Column:
    """Whether the share of ``part`` among the rows differs from the previous one by more than the limit."""
    now, before = _big(F.col(f"c.{part}")) * _big(F.col("p.rows")), _big(F.col(f"p.{part}")) * _big(F.col("c.rows"))
    return F.abs(now - before) * limit.below > _big(F.col("c.rows")) * _big(F.col("p.rows")) * limit.above


def _moved(check: Check, integer: Column) -> Column:
    """The condition of a check on a load's metrics ``c`` and the previous load's ``p``."""
    c, p = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"p.{n}"))
    if check.measure == "null_rate":
        return _share_moved("nulls", check.limit)
    if check.measure == "empty_rate":
        return ~integer & _share_moved("empties", check.limit)
    if check.measure == "distinct_count":
        a, b = c("distincts"), p("distincts")
        apart = (F.greatest(a, b) * check.limit.below > F.least(a, b) * check.limit.above) & (F.least(a, b) > 0)
        return apart & (F.greatest(a, b) >= check.least)
    if check.measure == "value_range":
        d = lambda x: x.cast("decimal(38,0)")
        width = d(p("high")) - d(p("low"))
        over = F.greatest(d(c("high")) - d(p("high")), d(p("low")) - d(c("low")))
        return integer & (over * check.limit.below > width * check.limit.above)
    raise ValueError(check.measure)


def moved_columns(summary: DataFrame, loads: DataFrame, checks: tuple[Check, ...], integers: tuple[str, ...]) -> DataFrame:
    """(load_id, column_name, measure) of every check that fails.

    ``loads`` gives each load's ``prev_load_id``; all measures but ``not_unique`` need a previous
    load, and both need rows. ``summary`` is read several times, so pass a written table.
    """
    before = loads.select("load_id", "prev_load_id").where(F.col("load_id").isNotNull() & F.col("prev_load_id").isNotNull()).distinct()
    out = []
    values = summary.where(F.col("kind") == VALUE)
    for c in checks:
        if c.measure == "not_unique":
            out.append(values.where(F.col("column_name").isin(*c.columns) & (F.col("most") > 1)).select("load_id", "column_name", F.lit(c.measure).alias("measure")))
    pairs = (
        values.alias("c")
        .join(before.alias("b"), F.col("b.load_id") == F.col("c.load_id"))
        .join(values.alias("p"), (F.col("p.load_id") == F.col("b.prev_load_id")) & (F.col("p.column_name") == F.col("c.column_name")))
    )
    integer = F.col("c.column_name").isin(*integers)
    failed = [
        F.when(F.col("c.column_name").isin(*c.columns) & _moved(c, integer), F.lit(c.measure))
        for c in checks
        if c.slot == VALUE and c.measure != "not_unique"
    ]
    if failed:
        out.append(
            pairs.select(F.col("c.load_id").alias("load_id"), F.col("c.column_name").alias("column_name"), F.explode(F.array(*failed)).alias("measure")).where(F.col("measure").isNotNull())
        )
    totals = values.groupBy("load_id").agg(F.max("rows").alias("total"))
    for kind in (SHAPE, SHARE):
        mine = [c for c in checks if c.slot == kind]
        if mine:
            out.append(_moved_sets(summary.where(F.col("kind") == kind), before, totals, mine))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _moved_sets(sets: DataFrame, before: DataFrame, totals: DataFrame, checks: list[Check]) -> DataFrame:
    """Pattern and distribution: a load's keys against those of the previous load."""
    kind, limit = checks[0].slot, checks[0].limit
    if kind == SHAPE:  # nulls and empty strings have no shape
        sets = sets.where(F.col("key").isNotNull())
    now = sets.join(before, "load_id").select("load_id", "column_name", "key", F.col("rows").alias("now"), F.lit(0).cast("long").alias("then"))
    then = sets.withColumnRenamed("load_id", "prev_load_id").join(before, "prev_load_id").select("load_id", "column_name", "key", F.lit(0).cast("long").alias("now"), F.col("rows").alias("then"))
    both = now.unionByName(then).groupBy("load_id", "column_name", "key").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    ended = (
        both.join(before, "load_id")
        .join(totals.select("load_id", F.col("total").alias("t_now")), "load_id")
        .join(totals.select(F.col("load_id").alias("prev_load_id"), F.col("total").alias("t_then")), "prev_load_id")
    )
    if kind == SHAPE:
        new = F.sum(F.when(F.col("then") == 0, F.col("now")).otherwise(0))
        cond = _big(new) * limit.below > _big(F.sum("now")) * limit.above
    else:  # twice the distance, times both totals
        apart = F.sum(F.abs(_big(F.col("now")) * _big(F.col("t_then")) - _big(F.col("then")) * _big(F.col("t_now"))))
        scale = F.max(_big(F.col("t_now")) * _big(F.col("t_then")))
        cond = apart.cast("decimal(36,0)") * limit.below > scale.cast("decimal(36,0)") * (2 * limit.above)
    return (
        ended.groupBy("load_id", "column_name")
        .agg(cond.alias("hit"))
        .where("hit")
        .select("load_id", "column_name", F.lit(checks[0].measure).alias("measure"))
    )


def profile_loads(rows: DataFrame, loads: DataFrame, load: str = "load_id", checks: tuple[Check, ...] | None = None) -> DataFrame:
    """Which columns of each load fail which check, from the rows and the table of loads.

    Defined cases: shares are compared exactly, so a difference equal to a limit doesn't exceed it.
    A load without rows, or whose previous load has none, is compared with nothing. A load of
    ``rows`` that ``loads`` doesn't name is checked for uniqueness only. Nulls, empty strings and
    repeated rows count as they are; an empty table gives an empty result.
    """
    checks = checks or standard_checks()
    integers = tuple(n for n in dict.fromkeys(n for c in checks for n in c.columns) if _is_integer(rows, n))
    summary = written(summarise(value_states(rows, load, checks), checks), "profile")
    return moved_columns(summary, loads, checks, integers)


def load_metrics(rows: DataFrame, load: str = "load_id", columns: tuple[str, ...] = SNAPSHOT_COLUMNS) -> DataFrame:
    """Profile of every load and column: rows, nulls, empty strings, distinct values, integer range."""
    checks = (Check("null_rate", columns), Check("not_unique", ("act_id",) if "act_id" in columns else ()))
    integer = F.col("column_name").isin(*[c for c in columns if _is_integer(rows, c)])
    return summarise(value_states(rows, load, checks), checks).select(
        "load_id",
        "column_name",
        F.col("rows").alias("row_count"),
        F.col("nulls").alias("null_count"),
        F.when(integer, F.lit(0)).otherwise(F.col("empties")).cast("long").alias("empty_count"),
        F.col("distincts").cast("long").alias("distinct_count"),
        F.when(integer, F.col("low")).alias("min_value"),
        F.when(integer, F.col("high")).alias("max_value"),
    )


def control_limits(metrics: DataFrame, loads: DataFrame, sigmas: float = 3.0, history: int = 12, floor: float = 0.02) -> DataFrame:
    """Shewhart test: null, empty and distinct rates outside their file's historical limits.

    For each file, column and rate, the centre is the mean over up to ``history`` loads before, in
    order of snapshot, and the limit ``sigmas`` standard deviations, ``floor`` at least. Loads with
    fewer than two earlier ones aren't tested. The window holds one file's loads of one column.
    """
    n = F.col("row_count")
    rates = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_count") / n).alias("value")) for m in ("null", "empty", "distinct")])
    w = Window.partitionBy("source_file", "column_name", "metric").orderBy("snapshot_version", "load_id").rowsBetween(-history, -1)
    return (
        metrics.where(n > 0)
        .join(loads.select("load_id", "source_file", "snapshot_version"), "load_id")
        .select("load_id", "source_file", "snapshot_version", "column_name", F.explode(rates).alias("r"))
        .select("load_id", "source_file", "snapshot_version", "column_name", "r.*")
        .withColumns({"center": F.avg("value").over(w), "spread": F.stddev_samp("value").over(w), "seen": F.count("value").over(w)})
        .where((F.col("seen") >= 2) & (F.abs(F.col("value") - F.col("center")) > F.greatest(F.lit(floor), sigmas * F.coalesce("spread", F.lit(0.0)))))
        .select("load_id", "column_name", "metric", "value", "center")
    )
