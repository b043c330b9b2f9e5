import json

import pytest

from tidemark import replay
from tidemark.operators.rolling import RollingConfig
from tidemark.validate import ValidationError


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    return replay.create(spark, tmp_path_factory.mktemp("b") / "bundle", days=120, config=RollingConfig(start=80, end=84))


def test_bundle_checks_and_is_not_overwritten(spark, bundle):
    before = {p.name: p.read_bytes() for p in bundle.iterdir()}
    assert replay.check(spark, bundle) == {"fits": 5, "forecast_rows": 30}
    assert {p.name: p.read_bytes() for p in bundle.iterdir()} == before
    with pytest.raises(FileExistsError):
        replay.create(spark, bundle)


@pytest.mark.parametrize("fault", ["extra", "changed", "missing", "symlink", "sources", "value"])
def test_tampering(spark, bundle, tmp_path, fault):
    import hashlib
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(bundle, copy)
    if fault == "extra":
        (copy / "more.txt").write_text("x")
    elif fault == "changed":
        (copy / "receipt.json").write_text((copy / "receipt.json").read_text() + " ")
    elif fault == "missing":
        (copy / "export.json").unlink()
    elif fault == "symlink":
        (copy / "export.json").unlink()
        (copy / "export.json").symlink_to(bundle / "export.json")
    else:
        name = "receipt.json" if fault == "sources" else "export.json"
        document = json.loads((copy / name).read_text())
        if fault == "sources":
            document["sources"]["validate.py"] = "0" * 64
        else:
            document["forecasts"][0][3] += 1e-6
        (copy / name).write_text(json.dumps(document))
        manifest = json.loads((copy / "manifest.json").read_text())
        manifest["files"][name] = hashlib.sha256((copy / name).read_bytes()).hexdigest()
        (copy / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(ValidationError):
        replay.check(spark, copy)


def test_receipt_shape(bundle):
    receipt = json.loads((bundle / "receipt.json").read_text())
    for change in ({"schema": "x"}, {"more": 1}, {"created_utc": "2026-01-01T00:00:00"}, {"python": "three"}, {"sources": {"a": "b"}}, {"verified": {"fits": True, "forecast_rows": 1}}):
        with pytest.raises(ValidationError):
            replay.checked_receipt(receipt | change)


def test_bundle_of_a_given_export(spark, bundle, tmp_path):
    made = replay.create(spark, tmp_path / "again", given=bundle / "export.json")
    assert (made / "export.json").read_bytes() == (bundle / "export.json").read_bytes() and replay.check(spark, made) == {"fits": 5, "forecast_rows": 30}
    export = json.loads((bundle / "export.json").read_text())
    export["forecasts"][0][3] += 1e-6
    (tmp_path / "changed.json").write_text(json.dumps(export))
    with pytest.raises(ValidationError):
        replay.create(spark, tmp_path / "bad", given=tmp_path / "changed.json")
    (tmp_path / "short.json").write_text("{}")
    with pytest.raises(ValidationError, match="fields"):
        replay.create(spark, tmp_path / "bad", given=tmp_path / "short.json")
    assert not (tmp_path / "bad").exists()
    with pytest.raises(SystemExit):
        replay.main(["--check", "x", "--input", "y"])
