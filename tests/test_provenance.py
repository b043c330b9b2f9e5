import html
import json
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import scalars
from tidemark.operators import evidence, provenance, review, rolling, scan
from tidemark.sources import files
from tidemark.sources.journal import Journal, spark_progress
from tidemark.validate import ValidationError, require_equal_rows


def test_seal_and_tampering(spark, tmp_path):
    at = str(tmp_path)
    assert provenance.sealed(spark, at, "frozen-input") is None
    files.atomic_json(tmp_path / "result.json", {"value": 1})
    with pytest.raises(ValidationError, match="isn't there"):
        provenance.seal(spark, at, "frozen-input", ["other.json"])
    provenance.seal(spark, at, "frozen-input", ["result.json"])
    (tmp_path / "later.txt").write_text("not sealed, so not looked at")
    assert [(r.path, r.length) for r in provenance.sealed(spark, at, "frozen-input").collect()] == [("result.json", (tmp_path / "result.json").stat().st_size)]
    with pytest.raises(ValidationError, match="another lineage"):
        provenance.sealed(spark, at, "other")
    (tmp_path / "result.json").write_text("{}")
    with pytest.raises(ValidationError, match="as it was sealed"):
        provenance.sealed(spark, at, "frozen-input")
    (tmp_path / "result.json").unlink()
    with pytest.raises(ValidationError, match="as it was sealed"):
        provenance.sealed(spark, at, "frozen-input")


@pytest.mark.parametrize("name", ["../x", "/etc/passwd", "a/../../b", None])
def test_seal_of_names_outside(spark, tmp_path, name):
    (tmp_path / provenance.SEAL).mkdir()
    (tmp_path / provenance.SEAL / "part.json").write_text(json.dumps({"path": name, "sha256": "0", "lineage": "l"}))
    (tmp_path / provenance.SEAL / "_SUCCESS").touch()
    with pytest.raises(ValidationError, match="leaves the folder"):
        provenance.sealed(spark, str(tmp_path), "l")


def test_json_refuses_nan(tmp_path):
    with pytest.raises(ValueError):
        files.atomic_json(tmp_path / "x.json", float("nan"))


def test_publish_never_overwrites(tmp_path):
    files.publish(lambda d: (d / "a").write_text("1"), tmp_path / "out")
    with pytest.raises(FileExistsError):
        files.publish(lambda d: None, tmp_path / "out")
    with pytest.raises(RuntimeError):
        files.publish(lambda d: (_ for _ in ()).throw(RuntimeError()), tmp_path / "other")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


@pytest.mark.parametrize("name", ["/etc/passwd", "../x", "a/../b", "", "missing", "a//b"])
def test_unsafe_paths(tmp_path, name):
    with pytest.raises(ValidationError):
        files.safe_local_path(tmp_path, name)


def test_inventory_and_digests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.js").write_text("x")
    (tmp_path / "sub/b.css").write_text("y")
    assert files.inventory(tmp_path, files.ASSET_SUFFIXES) == ["a.js", "sub/b.css"]
    found = provenance.file_digests(files.binary_files(spark, str(tmp_path)))
    assert found.count() == 2 and provenance.manifest_differences(found, found).isEmpty()
    changed = found.withColumn("sha256", F.when(F.col("path").endswith("a.js"), "0").otherwise(F.col("sha256")))
    assert [r.reason for r in provenance.manifest_differences(found, changed).collect()] == ["changed"]
    assert files.asset_violations(files.binary_files(spark, str(tmp_path))).isEmpty()
    (tmp_path / "link").symlink_to(tmp_path / "a.js")
    with pytest.raises(ValidationError, match="symlink"):
        files.inventory(tmp_path)


def test_file_size_limit(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="too large"):
        files.binary_files(spark, str(tmp_path), most_bytes=99).collect()


def test_tolerance(spark):
    a = spark.createDataFrame([("x", 1.0, 0.5), ("y", 2.0, None)], "k string, whole double, part double")
    same = a.withColumn("part", F.col("part") + 1e-12)
    assert provenance.differences(a, same, ["k"], ["whole", "part"]).isEmpty()
    moved = a.withColumn("whole", F.col("whole") + 1e-12)
    assert {(r.k, r.field) for r in provenance.differences(a, moved, ["k"], ["whole", "part"]).collect()} == {("x", "whole"), ("y", "whole")}
    assert provenance.differences(a, a.limit(1), ["k"], ["whole"]).first().reason == "missing"
    require_equal_rows(a, a.repartition(2), "rows")
    with pytest.raises(ValidationError):
        require_equal_rows(a, a.limit(1), "rows")


@pytest.mark.parametrize("expected, actual", [(float("nan"), 1.0), (float("nan"), float("nan")), (float("inf"), 2.5), (float("inf"), float("inf")), (0.5, float("inf")), (0.5, float("nan")), (None, 0.5), (0.5, None)])
def test_tolerance_takes_finite_numbers_only(spark, expected, actual):
    e, a = (spark.createDataFrame([("k", v)], "k string, v double") for v in (expected, actual))
    assert provenance.differences(e, a, ["k"], ["v"]).count() == 1


def test_replay_accepts_the_export_and_rejects_changes(spark):
    config = rolling.RollingConfig(start=80, end=90)
    exported = provenance.export(spark, 2026, "steady", 120, config)
    assert provenance.replay(spark, exported) == {"forecast_rows": 66, "fits": 11}

    def changed(part, column, by):
        rows = [list(r) for r in exported[part]]
        rows[3][column] += by
        return exported | {part: [tuple(r) for r in rows]}

    provenance.replay(spark, changed("forecasts", 3, 1e-12))
    for bad in (changed("forecasts", 3, 1e-6), changed("observations", 3, 1e-6), changed("forecasts", 6, 1), exported | {"seed": 1}, exported | {"forecasts": exported["forecasts"][1:]}):
        with pytest.raises(ValidationError):
            provenance.replay(spark, bad)


def test_fingerprint_ignores_key_order():
    assert provenance.fingerprint({"a": 1, "b": 2}) == provenance.fingerprint({"b": 2, "a": 1})


def test_evidence(spark):
    rows = spark.createDataFrame([(0.4, 0.1, 0.3, -0.1, 0.5), (0.4, 0.1, 0.2, 0.1, float("nan"))], "candidate double, control double, delta double, low double, high double")
    got = [(r.check, r.passed) for r in evidence.comparison_checks(rows).collect()]
    assert [p for _, p in got[:4]] == [True] * 4 and not dict(got[4:])["finite"] and not dict(got[4:])["delta_adds_up"]
    with pytest.raises(ValidationError):
        evidence.require_pass(evidence.comparison_checks(rows))
    assert evidence.all_pass(evidence.comparison_checks(rows.limit(1))).first().all_passed


def test_ledger_and_notebook(spark, tmp_path):
    files.atomic_json(tmp_path / "ledger.json", {"status": "complete", "families": [{"family": "a", "outcome": "rejected", "capability": "x"}, {"family": "b", "outcome": "rejected", "capability": "y"}]})
    assert evidence.outcome_histogram(files.ledger(spark, str(tmp_path / "ledger.json"))).first().n == 2
    cell = {"id": "one", "cell_type": "code", "execution_count": 1, "source": ["print(1)"], "outputs": [{"output_type": "stream", "text": ["1"]}]}
    (tmp_path / "n.json").write_text(json.dumps({"nbformat": 4, "cells": [cell, cell | {"id": "two", "outputs": []}]}))
    bad = files.notebook_violations(files.notebook_cells(spark, str(tmp_path / "n.json")), expected=2).collect()
    assert [(r.id, r.reason) for r in bad] == [("two", "no saved output")]


@pytest.mark.parametrize("text, flag", [("AKIA" + "A" * 16, "credential"), ("see S3://bucket", "locator"), ("fetch (x)", "network"), ('api_key = "12345678"', "assignment")])
def test_patterns(spark, text, flag):
    rows = spark.createDataFrame([(1, text), (2, "plain prose"), (3, None)], "id int, text string")
    found = scan.pattern_flags(rows, "id", "text").collect()
    assert [r.id for r in found] == [1] and found[0][flag]


def test_references(spark):
    markup = '<a href="/x#top"></a><img src="https://host/y"><style>a{background:url(z.png)}</style>'
    rows = spark.createDataFrame([(1, markup)], "id int, html string")
    got = {(r.kind, r.host, r.path, r.fragment, r.local) for r in scan.reference_parts(scan.references(rows, "id", "html")).collect()}
    assert got == {("attribute", "", "/x", "top", True), ("attribute", "host", "/y", "", False), ("style", "", "z.png", "", True)}
    svg = spark.createDataFrame([(1, "<svg><script>x</script></svg>"), (2, '<svg><use href="//h/x"/></svg>'), (3, '<svg><use href="#a"/></svg>')], "id int, svg string")
    assert {(r.id, r.reason) for r in scan.svg_violations(svg, "id", "svg").collect()} == {(1, "script"), (2, "remote reference")}


def test_attributes(spark):
    markup = """<A HREF="/x?a=1&amp;b=2" data-k='q"r' disabled><img/src=y.png ><br/><p class = big id></p>text < b > <>"""
    rows = spark.createDataFrame([(1, markup), (2, None), (3, "")], "id int, html string")
    got = {(r.id, r.tag, r.attribute, r.value) for r in scan.attributes(rows, "id", "html").collect()}
    assert got == {(1, "a", "href", "/x?a=1&b=2"), (1, "a", "data-k", 'q"r'), (1, "a", "disabled", None), (1, "img", "src", "y.png"), (1, "p", "class", "big"), (1, "p", "id", None)}
    long = spark.createDataFrame([(1, "<a " + "x" * 200_000), (2, "<a b='" + "<a b='" * 30_000)], "id int, html string")
    assert scan.attributes(long, "id", "html").count() < 10


def test_quoting(spark):
    texts = ["a b/ü~*é+-_.!", "100%", "%zz", "", None, "<&>\"'", "%41+%42"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", scalars.url_quote(F.col("t")).alias("q"), scalars.url_unquote(scalars.url_quote(F.col("t"))).alias("b"), scalars.url_unquote(F.col("t")).alias("u"), scalars.html_escape(F.col("t")).alias("e"), scalars.html_unescape(scalars.html_escape(F.col("t"))).alias("h")
    )
    for r in rows.collect():
        assert r.b == r.t and r.h == r.t
        if r.t is not None:
            assert r.q == urllib.parse.quote(r.t, safe="/") and r.e == html.escape(r.t)
    assert {r.t: r.u for r in rows.collect()}["%41+%42"] == "A+B" and {r.t: r.u for r in rows.collect()}["%zz"] == "%zz"
    filled = spark.range(1).select(scalars.with_placeholders(F.array(F.lit("--out={folder}"), F.lit("x")), {"folder": F.lit("/o")}).alias("a")).first().a
    assert filled == ["--out=/o", "x"]


def test_review(spark):
    commands = spark.createDataFrame([(0, "check-data", "python", "a.py", ["x"]), (1, "demo", "node", "b.mjs", None)], review.COMMAND)
    cards = spark.createDataFrame([("Data science", "a.py", "t.py", "e.md")], review.CARD)
    paths = spark.createDataFrame([("a.py",), ("b.mjs",), ("t.py",), ("e.md",)], "path string")
    checked = lambda c, k, p: {(r.part, r.name, r.reason) for r in review.project_violations(c, k, p, ["python", "node"], ["Data science"]).collect()}
    assert checked(commands, cards, paths) == set()
    assert checked(commands.limit(0), cards, paths) == {("command", None, "empty")}
    broken = spark.createDataFrame([(0, "A", "python", "a.py", []), (1, "demo", "perl", "b.mjs", []), (2, "demo", "node", "../x", [None])], review.COMMAND)
    assert checked(broken, spark.createDataFrame([("?", "a.py", "t.py", None)], review.CARD), paths) >= {("command", "A", "unsafe id"), ("command", "demo", "unsupported runtime"), ("command", "demo", "invalid argument"), ("command", "demo", "repeated"), ("command", "../x", "no such file"), ("card", "?", "unknown audience")}
    good = [(0, "check-data", "a.py", ["x"], "check-data.log", "passed", 0), (1, "demo", "b.mjs", [], "demo.log", "passed", 0)]
    covered = lambda rows: {(r.place, r.reason) for r in review.coverage_violations(commands, spark.createDataFrame(rows, review.CHECK)).collect()}
    assert covered(good) == set()
    assert covered(good[:1]) == {(1, "not run")} and covered([*good, (2, "more", "c", [], "more.log", "passed", 0)]) == {(2, "not configured")}
    assert covered([good[0], (1, "demo", "b.mjs", ["y"], "demo.log", "passed", 0)]) == {(1, "another call")}
    assert covered([good[0], (1, "demo", "b.mjs", [], "demo.log", "passed", 1)]) == {(1, "not passed")}
    manifest = spark.createDataFrame([("receipt.json", "1"), ("check-data.log", "2"), ("demo.log", "3")], "path string, sha256 string")
    checks = spark.createDataFrame(good, review.CHECK)
    assert review.bundle_violations(manifest, manifest, checks).isEmpty()
    other = manifest.where("path <> 'demo.log'")
    assert {(r.path, r.reason) for r in review.bundle_violations(other, manifest, checks).collect()} == {("demo.log", "unexpected"), ("demo.log", "not in the manifest")}
    assert review.source_paths(commands, cards, paths).count() == 4


def test_written_notebook_is_checked(spark, tmp_path):
    schema = "place int, id string, cell_type string, execution_count int, source string, output_text string"
    cells = spark.createDataFrame([(1, "b", "code", 1, "print(1)\nprint(2)", "1\n2\n"), (0, "a", "markdown", None, "# Title", None)], schema)
    files.write_notebook(cells, tmp_path / "n.ipynb")
    got = files.notebook_cells(spark, str(tmp_path / "n.ipynb")).orderBy("place").collect()
    assert [(r.id, r.source, r.output_text) for r in got] == [("a", "# Title", ""), ("b", "print(1)\nprint(2)", "1\n2\n")]
    for broken in ((0, "a", "code", None, "x", "1"), (0, "a", "code", 1, "x", None)):
        with pytest.raises(ValidationError):
            files.write_notebook(spark.createDataFrame([broken], schema), tmp_path / "m.ipynb")


def test_recorded_figures(spark):
    rows = spark.createDataFrame([("final", False, 247), ("draft", True, 3), (None, None, None)], "status string, leaked boolean, dates int").coalesce(1)
    found = evidence.recorded_checks(rows, {"status": "final"}, ["leaked"], {"dates": 247}, ["status"]).collect()
    assert {(r.status, r.passed) for r in found} == {("final", True), ("draft", False), (None, False)} and len(found) == 9


def test_required_assets(spark, tmp_path):
    (tmp_path / "index.html").write_text("x")
    found = files.binary_files(spark, str(tmp_path))
    assert files.asset_violations(found, ("index.html",)).isEmpty()
    assert [(r.path, r.reason) for r in files.asset_violations(found, ("index.html", "app.js")).collect()] == [("app.js", "required")]


def test_journal(spark, tmp_path):
    at = tmp_path / "journal"
    with Journal(at, beat=0.05, progress=spark_progress(spark)) as journal:
        journal.note("begin run", rows=3)
        with pytest.raises(ValueError):
            journal.note("bad", value=float("nan"))
        assert journal.run("fit", lambda: time.sleep(0.4) or 7) == 7
        with pytest.raises(RuntimeError):
            journal.run("score", lambda: (_ for _ in ()).throw(RuntimeError()))
    rows = files.json_lines(spark, str(at), StructType.fromDDL("kind string, step string, elapsed_s double, step_s double, error string, time_utc timestamp, tasks long")).orderBy("elapsed_s").collect()
    kinds = [(r.kind, r.step) for r in rows]
    assert kinds[0] == ("begin run", None) and ("alive", "fit") in kinds and ("end", "fit") in kinds and kinds[-1] == ("error", "score")
    assert all(r.time_utc for r in rows) and rows[-1].error == "RuntimeError" and next(r for r in rows if r.kind == "end").step_s >= 0.4
    assert {r.tasks is not None for r in rows if r.kind == "alive"} == {True}
