import pytest
from pyspark.sql import functions as F

from tidemark.operators import availability as A
from tidemark.schemas import LABEL
from tidemark.sources.synthetic import authored_labels
from tidemark.validate import ValidationError, duplicate_keys, finite_number, label_violations


def test_snapshot_of_the_four_labels(spark):
    labels = A.checked_labels(authored_labels(spark))
    counts = A.counts(labels, 5).first()
    assert (counts.available, counts.unreleased, counts.mean_value) == (2, 2, 0.05)
    assert [(r.instrument, r.observed_day) for r in A.available(labels, 5).collect()] == [("metal_alpha", 1), ("metal_beta", 1)]
    assert A.available(labels, 2).isEmpty()


def test_reading_fails_rather_than_giving_null(spark):
    labels = authored_labels(spark)
    assert A.read_label(labels, "metal_beta", 1, 5) == -0.10
    with pytest.raises(A.UnreleasedLabelError, match="released on day 5"):
        A.read_label(labels, "metal_beta", 1, 4)
    with pytest.raises(KeyError):
        A.read_label(labels, "metal_beta", 2, 9)
    with pytest.raises(Exception, match="not released"):
        A.guarded(labels, "metal_beta", 1, 4).collect()


@pytest.mark.parametrize("as_of", [0, -1, 1.5, True])
def test_snapshot_days_are_whole_and_positive(spark, as_of):
    with pytest.raises(ValidationError):
        A.available(authored_labels(spark), as_of)


@pytest.mark.parametrize("row", [(" ", 1, 3, 0.2), ("x", 1, 1, 0.2), ("x", 1, 0, 0.2), ("x", -1, 3, 0.2), ("x", 1, 3, float("nan")), ("x", 1, 3, float("inf"))])
def test_invalid_labels(spark, row):
    assert label_violations(spark.createDataFrame([row], LABEL)).count() == 1


@pytest.mark.parametrize("value", [True, "1", float("nan"), None])
def test_finite_number(value):
    with pytest.raises(ValidationError):
        finite_number(value, "x")


def test_second_vintage_is_a_duplicate(spark):
    labels = authored_labels(spark)
    again = labels.limit(1).withColumn("released_day", F.lit(10).cast("long"))
    both = labels.unionByName(again)
    assert duplicate_keys(both, ["instrument", "observed_day"]).count() == 1
    with pytest.raises(ValidationError):
        A.checked_labels(both)


def test_the_future_and_the_order_of_rows_change_nothing(spark):
    labels = authored_labels(spark)
    changed = labels.withColumn("value", F.when(F.col("released_day") > 5, 99.0).otherwise(F.col("value")))
    shuffled = changed.orderBy(F.desc("value")).repartition(3)
    assert A.available(labels, 5).collect() == A.available(shuffled, 5).collect()


def test_snapshots_equal_single_ones(spark):
    labels = authored_labels(spark)
    for r in A.snapshots(labels, 1, 8).collect():
        one = A.counts(labels, r.as_of).first()
        assert (r.available, r.unreleased) == (one.available, one.unreleased)
        assert r.mean_value == pytest.approx(one.mean_value) if one.mean_value is not None else r.mean_value is None


def test_demonstration(spark):
    shown = A.demonstration(authored_labels(spark), 5, "metal_alpha", 2)
    assert (shown["available"], shown["unreleased"], shown["mean_value"]) == (2, 2, 0.05)
    assert shown["keys"] == [["metal_alpha", 1], ["metal_beta", 1]] and "day 6" in shown["rejected"]


def test_guarded_targets_fail_early_and_on_strangers(spark):
    targets = spark.createDataFrame([("A", 40, 1.5), ("A", 41, 2.0)], "series_id string, t int, y double")
    wanted = lambda *rows: spark.createDataFrame(list(rows), "series_id string, origin int, as_of int")
    assert A.guarded_targets(targets, wanted(("A", 40, 48)), 5, 3).first().target == 1.5
    for row, why in ((("A", 40, 47), "released on day 48"), (("B", 40, 99), "no such series"), (("A", 42, 99), "no such series")):
        with pytest.raises(Exception, match=why):
            A.guarded_targets(targets, wanted(row), 5, 3).collect()


def test_key_places_follow_the_snapshot(spark):
    rows = [(f"i{k % 7}", k, 3 + k % 5, 1.0) for k in range(1, 60)]
    labels = spark.createDataFrame(rows, "instrument string, observed_day long, released_day long, value double").repartition(5)
    got = [(r.instrument, r.observed_day) for r in A.available_keys(labels, 6).orderBy("place").collect()]
    assert got == [(i, o) for i, o, *_ in sorted((r for r in rows if r[2] <= 6), key=lambda r: (r[2], r[0], r[1]))]
    assert [r.place for r in A.available_keys(labels, 6).orderBy("place").collect()] == list(range(len(got)))
