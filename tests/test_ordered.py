"""Orders cut into stretches against the plain forms of one task a key."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import doubled_rank
from tidemark.operators import features, ordered, rolling
from tidemark.validate import ValidationError


def rows_of(spark, n, keys, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(keys), rng.choice([None, 1.0, 1.0, 1.0, -0.5, rng.random(), 7.25]), rng.randint(0, 30)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, x double, d int").repartition(5)


def same(a, b):
    assert sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.collect())))


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None], [str(i) for i in range(60)]])
def test_ranks_equal_one_window(spark, keys):
    rows = rows_of(spark, 700, keys)
    same(ordered.doubled_ranks(rows, ["key"], "x", "rank"), rows.withColumn("rank", doubled_rank(F.col("x"), ["key"])))
    assert ordered.doubled_ranks(rows.limit(0), ["key"], "x", "rank").isEmpty()


def test_rank_correlation_of_one_huge_date(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("date"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(1)).alias("y")).withColumn("y", F.col("y") + F.col("x") / 1000)
    rows = rows.cache()
    got = ordered.rank_correlations(rows, ["date"], "x", "y").first()
    frame = rows.toPandas().rank()
    assert got.n_observed == 40_000 and got.rho == pytest.approx(np.corrcoef(frame.x, frame.y)[0, 1], abs=1e-12)
    flat = ordered.rank_correlations(rows.withColumn("y", F.lit(2.0)), ["date"], "x", "y").first()
    assert flat.rho is None
    counts = [r["count"] for r in ordered.stretches(rows, ["date"], ["y"], 8).groupBy(ordered.STRETCH).count().collect()]
    assert len(counts) >= 6 and max(counts) < 3 * np.median(counts[:-1]) + 14_000  # a third of the rows tie: one stretch has them
    distinct = rows.groupBy("date", "y").count()  # which is why ranks are made of distinct values
    counts = [r["count"] for r in ordered.stretches(distinct, ["date"], ["y"], 8).groupBy(ordered.STRETCH).count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * np.median(counts)


@pytest.mark.parametrize("keys", [["one"], ["a", None], [str(i) for i in range(40)]])
def test_places_and_running_sums(spark, keys):
    rows = rows_of(spark, 500, keys)
    w = Window.partitionBy("key").orderBy("d", "id")
    same(ordered.positions(rows, ["key"], ["d", "id"], "p"), rows.withColumn("p", F.row_number().over(w) - 1))
    table = ordered.stretches(rows, ["key"], ["d", "id"], 7)
    got = ordered.running_sums(table, ["key"], ["d", "id"], {"total": F.col("d"), "n": F.lit(1)})
    want = rows.withColumn("total", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    same(got.drop(ordered.STRETCH), want)


@pytest.mark.parametrize("size", [20, 21, 64, 10_000])
def test_blocks_with_halos_equal_whole_series(spark, size):
    rng = random.Random(size)
    lengths = {"a": 300, "b": 20, "c": 26, "d": 1, None: 70}
    rows = [(s, i, t, rng.random()) for i, (s, n) in enumerate(lengths.items()) for t in range(n)]
    obs = spark.createDataFrame(rows, "series_id string, series_pos int, t int, value double").repartition(6).cache()
    rounded = lambda df: df.select(*(F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    same(rounded(features.long_label_rows(obs, 5, 3, size)), rounded(features.label_rows(obs, 5, 3)))
    placed = ordered.positions(obs, ["series_id"], ["t"], "at")
    same(rounded(features.long_label_rows(placed, 5, 3, size, at="at")), rounded(features.label_rows(obs, 5, 3)))


def test_blocks_are_no_smaller_than_halos(spark):
    with pytest.raises(ValidationError):
        ordered.row_windows(rows_of(spark, 3, ["a"]), ["key"], ["id"], lambda w: [], 20, 4, 19)


def test_a_long_series_is_many_tasks(spark):
    obs = spark.range(200_000).select(F.lit("all").alias("series_id"), F.lit(0).alias("series_pos"), F.col("id").alias("t"), F.rand(3).alias("value"))
    made = features.long_label_rows(obs, 5, 3, 5_000)
    per_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 199_976 and max(per_task) < 0.6 * sum(per_task)


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None]])
def test_latest_known_value(spark, keys):
    rng = random.Random(len(keys))
    known = [(rng.choice(keys), rng.choice([None, *range(40)]), i, rng.choice([None, float(i)])) for i in range(300)]
    wanted = [(i, rng.choice([*keys, "unknown"]), rng.choice([None, *range(-3, 45)])) for i in range(400)]
    a = spark.createDataFrame(known, "key string, day int, version int, value double").repartition(4)
    b = spark.createDataFrame(wanted, "id int, key string, as_of int").repartition(3)
    got = {r.id: (r.version, r.value) for r in ordered.latest(a, b, ["key"], "day", "as_of", ["version"], ["version", "value"]).collect()}
    for i, key, as_of in wanted:
        rows = [(d, v, x) for k, d, v, x in known if k == key and d is not None and as_of is not None and d <= as_of]
        best = max(rows, key=lambda r: r[:2], default=(None, None, None))
        assert got[i] == best[1:]
    assert len(got) == 400
    nothing = ordered.latest(a.limit(0), b, ["key"], "day", "as_of", ["version"], ["value"])
    assert nothing.where("value is not null").isEmpty() and nothing.count() == 400
    with pytest.raises(ValidationError):
        ordered.latest(a, b.withColumn("value", F.lit(1)), ["key"], "day", "as_of", ["version"], ["value"])


@pytest.mark.parametrize("config", [rolling.RollingConfig(), rolling.RollingConfig(window=40, horizon=10, delay=7, start=33, end=150), rolling.RollingConfig(window=8, horizon=5, delay=3, start=25, end=60), rolling.RollingConfig(window=5, horizon=5, delay=3, start=25, end=60)])
def test_window_sums_equal_the_rows_of_each_origin(spark, config):
    rng = random.Random(1)
    obs = [(s, i, t, rng.random()) for i, s in enumerate("abc") for t in range(160) if not (s != "a" and 60 <= t < 90)]  # b and c have no days in between
    obs = spark.createDataFrame(obs, "series_id string, series_pos int, t int, value double")
    rows = rolling.labels_of(obs, config)
    for by in ([], ["series_id"]):
        got = rolling.window_sums(rows, by, config, {"s": F.col("y"), "ss": F.col("y") * F.col("f2")})
        plain = rolling.training_rows(obs, config).groupBy(*by, "origin").agg(F.count("*").alias("rows"), F.count_distinct("t").alias("days"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("f2")).alias("ss"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("released_day").alias("release"))
        rounded = lambda df: df.select(*(F.round(c, 10).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes))  # noqa: B023, E731
        same(rounded(got), rounded(plain.select(got.columns)))
