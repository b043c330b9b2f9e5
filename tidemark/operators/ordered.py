"""Orders that are larger than a task: ranks, running sums, row windows and as-of joins over range partitions.

Rows are cut into stretches, range partitions by key and order, and written, so that a stretch is the same
whenever it is read. Inside a stretch a window function does the work; what a stretch needs of those before it
is a table of their totals. A key reaches over several stretches only where one of their borders lies inside it, so
that table has fewer rows than there are stretches and is broadcast with that bound. A key
with all rows is thus as many tasks as a table of many keys.

Null keys are a group of their own. Nulls in the order come first. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import shuffle_width, written
from ..validate import ValidationError, whole_number

STRETCH = "stretch"


def stretches(rows: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``rows`` as a written table, range partitioned by key and order; ``stretch`` numbers the partitions in that order."""
    cut = rows.repartitionByRange(parts or shuffle_width(rows.sparkSession), *by, *order).sortWithinPartitions(*by, *order)
    return written(cut.withColumn(STRETCH, F.spark_partition_id()), "stretches")


def _with(table: DataFrame, borders: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``table`` with the border values ``names`` of each key and stretch, null where none comes before."""
    known = borders.select(*(F.col(c).alias(f"_{c}") for c in (*by, STRETCH)), *names)
    same = reduce(lambda x, y: x & y, (table[c].eqNullSafe(known[f"_{c}"]) for c in (*by, STRETCH)))
    return table.join(F.broadcast(known), same, "left").select(*table.columns, *names)  # fewer rows than stretches


def running_sums(table: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], current: bool = True) -> DataFrame:
    """``stretches`` with running sums in the order within each key, with or without the current row; 0 before the first."""
    totals = table.groupBy(*by, STRETCH).agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    before = Window.partitionBy(*by).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    borders = totals.select(*by, STRETCH, *(F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums), F.count(F.lit(1)).over(before).alias("_k")).where("_k > 0")
    own = Window.partitionBy(STRETCH, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    found = _with(table, borders, by, [f"_{n}" for n in sums])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select(*table.columns, *((zero(F.col(f"_{n}")) + zero(F.sum(v).over(own))).alias(n) for n, v in sums.items()))


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``rows`` with their places from 0 in the order within each key; ``order`` should tell all rows of a key apart."""
    return running_sums(stretches(rows, by, order), by, order, {name: F.lit(1)}, current=False).drop(STRETCH)


def doubled_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with twice the rank of ``value`` within each key, ties sharing their mean: a whole number.

    Rows are reduced to a count for each distinct value before they are ordered, so that ties, however many, are one row there;
    ranks go back to the rows by a join of tables, of which adaptive execution splits a very common value.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    table = stretches(counts, by, [value])
    ranked = running_sums(table, by, [value], {"_before": F.col("_n")}, current=False)
    ranks = written(ranked.select(*(F.col(c).alias(f"_{c}") for c in (*by, value)), (2 * F.col("_before") + F.col("_n") + 1).cast("long").alias(name)), "ranks")
    same = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(ranks[f"_{c}"]) for c in (*by, value)))
    return rows.join(ranks, same).select(*rows.columns, name)


def rank_correlations(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by..., n_observed, rho): rank correlation within each key over the rows that have both; null where a side is constant.

    Sums of doubled ranks are whole numbers, in decimals of 38 digits: enough for three thousand million rows a key.
    """
    observed = rows.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = doubled_ranks(doubled_ranks(observed, by, x, "_rx"), by, y, "_ry")
    a, b = (F.col(c).cast("decimal(19,0)") for c in ("_rx", "_ry"))
    names = {"n": F.count(F.lit(1)), "a": F.sum(a), "b": F.sum(b), "aa": F.sum(a * a), "bb": F.sum(b * b), "ab": F.sum(a * b)}
    sums = ranked.groupBy(*by).agg(*(v.alias(f"_{k}") for k, v in names.items()))
    n = F.col("_n").cast("decimal(10,0)")
    apart = lambda p, q: (n * F.col(f"_{p}{q}") - F.col(f"_{p}") * F.col(f"_{q}")).cast("double")
    rho = F.when((apart("a", "a") > 0) & (apart("b", "b") > 0), apart("a", "b") / (F.sqrt(apart("a", "a")) * F.sqrt(apart("b", "b"))))
    return sums.select(*by, F.col("_n").alias("n_observed"), rho.alias("rho"))


def row_windows(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Callable[[WindowSpec], Sequence[Column]], back: int, ahead: int, size: int = 100_000, at: str | None = None) -> DataFrame:
    """``rows`` with window columns whose frames reach at most ``back`` rows back and ``ahead`` rows ahead.

    Each key is cut into blocks of ``size`` rows by place; a block gets the last ``back`` rows of the one before and the
    first ``ahead`` rows of the one after it as its halo, so that its frames are whole. ``columns`` makes the columns
    from the window of a block. Rows that know their places (``positions``) name that column as ``at``.
    """
    whole_number(size, max(back, ahead, 1), "size")
    rows = rows.withColumn("_at", F.col(at)) if at else positions(rows, by, order, "_at")
    within = F.col("_at") % size
    block = F.floor(F.col("_at") / size)
    nearby = F.array_compact(F.array(block, F.when(within >= size - back, block + 1), F.when((within < ahead) & (block > 0), block - 1)))
    placed = rows.withColumn("_home", block).withColumn("_block", F.explode(nearby))
    w = Window.partitionBy(*by, "_block").orderBy("_at")
    made = placed.select(*rows.columns, "_home", "_block", *columns(w)).where("_home = _block")
    return made.drop("_home", "_block", "_at")


def latest(known: DataFrame, wanted: DataFrame, by: Sequence[str], known_at: str, as_of: str, ties: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``wanted`` with ``values`` of the row of ``known`` that was the last one by then: the largest ``known_at`` up to ``as_of``, inclusive.

    Of rows known at the same time the largest by ``ties`` counts. Null values where nothing was known yet, or for a null ``as_of``;
    rows with a null ``known_at`` are never known. Both tables are one, sorted once; the last known row is carried
    through a stretch by a window and over its border by the borders' table.
    """
    if set(values) & set(wanted.columns):
        raise ValidationError("values have names of wanted columns")
    value = F.struct(*(F.col(c) for c in values))
    rank = F.struct(F.col("_time"), *(F.col(c) for c in ties))
    at = lambda c: F.col(c).alias("_time")
    right = known.where(F.col(known_at).isNotNull()).select(*by, at(known_at), *ties, *(c for c in values if c not in (*by, *ties)))
    right = right.select(*by, "_time", F.lit(0).alias("_side"), rank.alias("_rank"), value.alias("_value"), F.lit(None).cast(wanted.select(F.struct("*")).schema[0].dataType).alias("_row"))
    left = wanted.select(*by, at(as_of), F.struct("*").alias("_row"))
    left = left.select(*by, "_time", F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_rank"].dataType).alias("_rank"), F.lit(None).cast(right.schema["_value"].dataType).alias("_value"), "_row")
    order = ["_time", "_side", "_rank"]
    table = stretches(right.unionByName(left), by, order)
    ends = table.groupBy(*by, STRETCH).agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col("_rank"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    borders = ends.select(*by, STRETCH, F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    own = Window.partitionBy(STRETCH, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = _with(table.withColumn("_own", F.last("_value", ignorenulls=True).over(own)), borders, by, ["_carried"]).where("_side = 1")
    carried = F.when(F.col("_time").isNotNull(), F.coalesce("_own", "_carried"))
    return found.select("_row.*", carried.alias("_v")).select(*wanted.columns, *(F.col(f"_v.{c}").alias(c) for c in values))
