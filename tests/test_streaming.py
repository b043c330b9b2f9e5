from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import availability
from tidemark.plans import registry
from tidemark.schemas import LABEL
from tidemark.sources.synthetic import authored_labels
from tidemark.streaming import labels as S


def test_replayed_stream_equals_the_batch(spark, tmp_path):
    authored_labels(spark).repartition(3, "observed_day").write.parquet(str(tmp_path / "in"))
    S.replay_to_table(S.label_stream(spark, str(tmp_path / "in"), LABEL), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, authored_labels(spark).collect()))


def test_release_counts(spark, tmp_path):
    authored_labels(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.running_release_counts(S.label_stream(spark, str(tmp_path / "in"), LABEL), "2024-01-01")
    query = stream.writeStream.outputMode("update").format("memory").queryName("release_counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.released_day, r.n) for r in spark.table("release_counts").collect()} == {(3, 1), (5, 1), (6, 1), (7, 1)}


def test_sliding_windows(spark, tmp_path):
    authored_labels(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    windows = S.windowed_counts(S.label_stream(spark, str(tmp_path / "in"), LABEL), "2024-01-01", "4 days", "1 day")
    query = windows.writeStream.outputMode("update").format("memory").queryName("sliding").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {((r.window.start - datetime(2024, 1, 1)).days, r.n, round(r.mean_value, 9)) for r in spark.table("sliding").collect()}
    labels = [(r.released_day, r.value) for r in authored_labels(spark).collect()]
    want = set()
    for first in range(-5, 12):
        inside = [v for d, v in labels if first <= d < first + 4]
        if inside:
            want.add((first, len(inside), round(sum(inside) / len(inside), 9)))
    assert got == want


def arrivals(spark, path, rows):
    spark.createDataFrame(rows, "instrument string, observed_day long, released_day long, value double, arrived_day long").coalesce(1).write.mode("append").parquet(path)


def out(spark, tmp_path):
    return sorted((r.instrument, r.observed_day, r.released_day, r.value, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_labels_come_out_at_their_release_and_once(spark, tmp_path):
    """A stop between arrival and release: nothing comes out early, twice or never."""
    into, run = str(tmp_path / "in"), lambda: S.write_stream(S.releases(S.label_stream(spark, into, spark.read.parquet(into).schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    arrivals(spark, into, [("a", 1, 5, 0.1, 1), ("a", 2, 4, 0.2, 2), ("b", 2, 9, 0.3, 2), ("a", 1, 7, 9.9, 2)])
    run()
    assert out(spark, tmp_path) == [("a", 1, 7, 9.9, "repeated")]  # the second label of a day whose first is held
    arrivals(spark, into, [("b", 3, 4, 0.4, 4), ("c", 4, 6, 0.5, 4)])
    run()
    assert out(spark, tmp_path) == [("a", 1, 7, 9.9, "repeated"), ("a", 2, 4, 0.2, "released"), ("b", 3, 4, 0.4, "late")]
    arrivals(spark, into, [("", None, None, None, 100)])
    run()
    run()
    assert out(spark, tmp_path) == [("a", 1, 5, 0.1, "released"), ("a", 1, 7, 9.9, "repeated"), ("a", 2, 4, 0.2, "released"), ("b", 2, 9, 0.3, "released"), ("b", 3, 4, 0.4, "late"), ("c", 4, 6, 0.5, "released")]


def test_released_stream_gives_the_snapshots(spark, tmp_path):
    labels = registry.panels.event_labels(spark, "/root/testdata/sf0.001").withColumn("arrived_day", F.col("observed_day")).cache()
    into = str(tmp_path / "in")
    for low, high in ((0, 12), (12, 100)):
        labels.where((F.col("arrived_day") > low) & (F.col("arrived_day") <= high)).coalesce(1).write.mode("append").parquet(into)
        if high == 100:
            arrivals(spark, into, [("", None, None, None, 1000)])
        S.write_stream(S.releases(S.label_stream(spark, into, labels.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    come = spark.read.parquet(str(tmp_path / "out"))
    assert come.where("status <> 'released'").isEmpty()
    rounded = lambda df: [(r.as_of, r.available, r.unreleased, r.mean_value and round(r.mean_value, 9)) for r in df.orderBy("as_of").collect()]
    assert rounded(availability.snapshots(come.drop("status"), 1, 36)) == rounded(availability.snapshots(labels, 1, 36))
