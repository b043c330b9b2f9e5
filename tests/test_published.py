"""Folders that appear at once, digest trees, and documents whose lines have places."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import provenance
from tidemark.sources.published import publish_files


def files_of(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary").repartition(3)


def test_a_folder_appears_whole(spark, tmp_path):
    publish_files(files_of(spark, [("a.txt", b"1"), ("sub/b.txt", b"22"), ("c", None), ("sub/deep/d", b"")]), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.txt": b"1", "sub/b.txt": b"22", "c": b"", "sub/deep/d": b""}
    with pytest.raises(Exception, match="out"):
        publish_files(files_of(spark, [("z", b"")]), str(tmp_path / "out"))
    publish_files(files_of(spark, [("z", b"x")]), f"file://{tmp_path}/by-uri")
    assert (tmp_path / "by-uri" / "z").read_bytes() == b"x"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["by-uri", "out"]


@pytest.mark.parametrize("bad", [[("a", b"1"), ("a", b"2")], [("../a", b"1")], [("/a", b"1")], [(None, b"1")], [("", b"1")], [("a/./b", b"")]])
def test_what_fails_leaves_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception):
        publish_files(files_of(spark, [("fine", b"0"), *bad]), str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception):
        publish_files(rows, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def two_tables(spark):
    """A table of 50,000 rows and one that differs in ten, by change, loss and addition; one row is there twice on both sides."""
    a = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 0.5 + 0.25).alias("v"), F.concat(F.lit("s"), "id").alias("s"))
    b = a.where("k not in (10, 20, 30)").withColumn("v", F.when(F.col("k").isin(100, 200, 300, 400), F.col("v") + 1e-6).when(F.col("k") == 500, F.col("v") + 1e-13).otherwise(F.col("v")))
    return a, b.unionAll(spark.createDataFrame([(-1, 0.5, "n"), (-2, None, "n")], "k long, v double, s string"))


def test_only_differing_buckets_are_joined(spark):
    a, b = two_tables(spark)
    keys, values = ["k"], ["v"]
    trees = tuple(provenance.written(provenance.digest_tree(t, keys, values, 4096, 16), "tree") for t in (a, b))
    assert {t.where("level = 0").first().n for t in trees} == {50_000, 49_999}
    nodes = provenance.differing_leaves(*trees, 16)
    assert 1 <= nodes.count() <= 10
    got = provenance.tree_differences(a, b, keys, values, leaves=4096, trees=trees)
    want = provenance.differences(a, b, keys, values)
    rows = lambda df: sorted((r.k, r.reason, r.field or "") for r in df.collect())
    assert rows(got) == rows(want) == sorted([(k, "missing", "") for k in (10, 20, 30)] + [(k, "differs", "v") for k in (100, 200, 300, 400)] + [(k, "unexpected", "") for k in (-1, -2)])
    near = a.join(F.broadcast(nodes), provenance._leaf(keys, 4096) == F.col("node"), "left_semi").count()
    assert near < 400  # of 50,000


def test_equal_tables_and_none(spark):
    a, _ = two_tables(spark)
    shuffled = a.orderBy(F.xxhash64("k")).repartition(7)
    assert provenance.tree_differences(a, shuffled, ["k"], ["v", "s"], leaves=256).isEmpty()
    none = a.where("k < 0")
    assert provenance.tree_differences(none, none, ["k"], ["v"], leaves=16).isEmpty()
    assert provenance.tree_differences(none, a.limit(3), ["k"], ["v"], leaves=16).count() == 3


def test_a_repeated_row_shows_in_the_digest(spark):
    a, _ = two_tables(spark)
    twice = a.unionAll(a.where("k = 7"))
    tree = lambda t: {(r.level, r.node): r for r in provenance.digest_tree(t, ["k"], ["v"], 16, 4).collect()}
    x, y = tree(a), tree(twice)
    assert [k for k in x if x[k] != y[k]] and x[0, 0].n + 1 == y[0, 0].n
    for level, node in x:
        children = [x[level + 1, c] for c in range(4 * node, 4 * node + 4) if (level + 1, c) in x]
        if children:
            assert x[level, node].n == sum(c.n for c in children) and x[level, node].s0 == sum(c.s0 for c in children)


def test_places_of_lines(spark, tmp_path):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), F.col("id").alias("b"))
    provenance.placed_lines(rows, ["a", "b"]).write.parquet(str(tmp_path / "doc"))
    lines = {r.place: r.line for r in spark.read.parquet(str(tmp_path / "doc")).collect()}
    want = sorted((r.a, r.b) for r in rows.collect())
    assert [lines[i] for i in range(1000)] == [f'{{"a":{a},"b":{b}}}' for a, b in want]
    assert spark.read.parquet(str(tmp_path / "doc")).where("place = 500").first().line == lines[500]
