"""Panels built from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First day of the calendar panels.
EPOCH = "1995-01-01"
EVENTS_EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date_id, target, target_pos, lag, value): revenue by month and brand; a brand's number gives its horizon."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    number = F.substring_index("p_brand", "#", -1).cast("int")
    date_id = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("long")
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(date_id.alias("date_id"), F.col("p_brand").alias("target"))
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"), F.count("*").alias("n_items"))
        .withColumn("p_brand", F.col("target"))
        .select("date_id", "target", number.alias("target_pos"), (1 + F.pmod(number, F.lit(4))).cast("long").alias("lag"), "value", "n_items")
    )


def trailing_forecast(cells: DataFrame, oldest: int = 12, newest: int = 2) -> DataFrame:
    """``cells`` with ``truth`` and ``prediction``: the target's mean over the months released by then."""
    w = Window.partitionBy("target").orderBy("date_id").rangeBetween(-oldest, -newest)
    return cells.withColumn("prediction", F.avg("value").over(w)).withColumnRenamed("value", "truth").where("prediction is not null")


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (target, lag) dimension."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("target")).distinct()
    return brands.select("target", (1 + F.pmod(F.substring_index("target", "#", -1).cast("int"), F.lit(4))).cast("long").alias("lag"))


def segment_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, series_pos, t, value): order value in millions by market segment and week, zero where there is none."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    week = F.floor(F.datediff("o_orderdate", F.lit(EPOCH)) / 7).cast("int")
    sums = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series_id"), week.alias("t"))
        .agg((F.sum("o_totalprice") / 1e6).alias("value"))
    )
    last = orders.agg(F.max(week)).scalar()
    names = customers.select(F.col("c_mktsegment").alias("series_id")).distinct()
    places = names.select("series_id", (F.row_number().over(Window.orderBy("series_id")) - 1).cast("int").alias("series_pos"))  # a row for each segment
    calendar = places.select("series_id", "series_pos", F.explode(F.sequence(F.lit(0), last)).alias("t"))
    return calendar.join(sums, ["series_id", "t"], "left").select("series_id", "series_pos", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, observed_day, released_day, value): mean event value by kind and user group, released 1 to 5 days later."""
    rows = event_rows(spark, sf_dir)
    return rows.groupBy("instrument", "observed_day", "released_day").agg(F.avg("value").alias("value"))


def event_rows(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """The events behind the labels, a row each, with the columns ``keep`` of the table."""
    events = table(spark, sf_dir, "events").select(*(keep or []), "ts", "user_id", "event_type", "value")
    group = F.pmod("user_id", F.lit(8))
    day = (F.datediff("ts", F.lit(EVENTS_EPOCH)) + 1).cast("long")
    return events.select(
        *(keep or []),
        F.concat_ws("_", "event_type", group.cast("string")).alias("instrument"),
        day.alias("observed_day"),
        (day + 1 + F.pmod(day + group, F.lit(5))).alias("released_day"),
        "value",
    )


def from_wide(wide: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """Long cells of a wide frame; a target's place in ``targets`` is its position; NaN becomes null."""
    long = wide.unpivot([key], targets, "target", "value")
    places = F.create_map(*[x for i, t in enumerate(targets) for x in (F.lit(t), F.lit(i))])
    return long.select(F.col(key).cast("long").alias("date_id"), "target", F.get(F.array(places), F.lit(0))[F.col("target")].alias("target_pos"), F.nanvl(F.col("value"), F.lit(None).cast("double")).alias("value"))
