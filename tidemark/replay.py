"""Bundles of a result that can be checked by recomputing it.

``python -m tidemark.replay --output FOLDER`` makes one, of a new result or of the export that ``--input
FILE`` names; ``--check FOLDER`` verifies one without writing: the files are those of the manifest, the receipt is well formed, the code that computed the
result is the code at hand, and the replay of the export equals the export.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import platform
import re
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import SparkSession

from .operators import provenance
from .operators.rolling import RollingConfig
from .sources.files import MOST_BYTES, atomic_json, inventory, publish, safe_local_path
from .validate import ValidationError

SCHEMA = "tidemark-bundle-v1"
FILES = ["export.json", "receipt.json"]
EXPORT_KEYS = {"seed", "scenario", "days", "config", "observations", "forecasts"}
RECEIPT_KEYS = {"schema", "created_utc", "python", "spark", "sources", "verified"}


def source_digests() -> dict[str, str]:
    """SHA-256 of the modules that compute a replay."""
    base = Path(__file__).parent
    names = ["functions/scalars.py", "operators/features.py", "operators/provenance.py", "operators/rolling.py", "sources/synthetic.py", "validate.py"]
    return {n: hashlib.sha256((base / n).read_bytes()).hexdigest() for n in names}


def _plain(exported: dict[str, Any]) -> dict[str, Any]:
    return json.loads(json.dumps(exported, allow_nan=False))


def read_json(path: Path) -> Any:
    """A JSON document of a bounded regular file."""
    if path.is_symlink() or not path.is_file() or path.stat().st_size > MOST_BYTES:
        raise ValidationError(f"not a regular file of at most {MOST_BYTES} bytes: {path.name}")
    return json.loads(path.read_text())


def checked_receipt(receipt: Any) -> dict[str, Any]:
    """A receipt with exactly its keys, a UTC time that survives a round trip, versions, digests and counts."""
    if not isinstance(receipt, dict) or set(receipt) != RECEIPT_KEYS or receipt["schema"] != SCHEMA:
        raise ValidationError("the receipt's fields aren't those expected")
    when = datetime.fromisoformat(receipt["created_utc"])
    if when.isoformat() != receipt["created_utc"] or when.utcoffset() != timezone.utc.utcoffset(None):
        raise ValidationError("the receipt's time isn't in UTC")
    if not all(re.fullmatch(r"\d+\.\d+\.\d+\S*", str(receipt[k])) for k in ("python", "spark")):
        raise ValidationError("the receipt's versions are malformed")
    if not all(re.fullmatch(r"[0-9a-f]{64}", v) for v in receipt["sources"].values()):
        raise ValidationError("the receipt's digests are malformed")
    counts = receipt["verified"]
    if set(counts) != {"fits", "forecast_rows"} or not all(type(v) is int and v >= 0 for v in counts.values()):
        raise ValidationError("the receipt's counts are malformed")
    return receipt


def _from_json(document: dict[str, Any]) -> dict[str, Any]:
    return document | {k: [tuple(r) for r in document[k]] for k in ("observations", "forecasts")}


def create(spark: SparkSession, output: str | Path, seed: int = 2026, scenario: str = "steady", days: int = 240, config: RollingConfig | None = None, given: str | Path | None = None) -> Path:
    """Computes a result, or takes the ``given`` export, replays it and publishes; an existing folder is never written over."""
    if Path(output).exists():
        raise FileExistsError(output)
    exported = read_json(Path(given)) if given else _plain(provenance.export(spark, seed, scenario, days, config or RollingConfig()))
    if not isinstance(exported, dict) or set(exported) != EXPORT_KEYS:
        raise ValidationError("the export's fields aren't those expected")
    verified = provenance.replay(spark, _from_json(exported))

    def stage(folder: Path) -> None:
        atomic_json(folder / "export.json", exported)
        atomic_json(folder / "receipt.json", {"schema": SCHEMA, "created_utc": datetime.now(timezone.utc).isoformat(), "python": platform.python_version(), "spark": pyspark.__version__, "sources": source_digests(), "verified": verified})
        atomic_json(folder / "manifest.json", {"schema": SCHEMA, "files": {n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in FILES}})

    return publish(stage, output)


def check(spark: SparkSession, folder: str | Path) -> dict[str, int]:
    """What was verified; any difference fails."""
    base = Path(folder)
    manifest = read_json(safe_local_path(base, "manifest.json"))
    if manifest.get("schema") != SCHEMA or set(inventory(base)) != {*manifest["files"], "manifest.json"} or set(manifest["files"]) != set(FILES):
        raise ValidationError("the files aren't those of the manifest")
    for name, digest in manifest["files"].items():
        if hashlib.sha256(safe_local_path(base, name).read_bytes()).hexdigest() != digest:
            raise ValidationError(f"{name} isn't what the manifest says")
    receipt = checked_receipt(read_json(base / "receipt.json"))
    if receipt["sources"] != source_digests():
        raise ValidationError("the result was computed by other code")
    verified = provenance.replay(spark, _from_json(read_json(base / "export.json")))
    if verified != receipt["verified"]:
        raise ValidationError("the replay's counts aren't the receipt's")
    return verified


def main(argv: list[str] | None = None) -> int:
    from .session import local_session

    parser = argparse.ArgumentParser(prog="tidemark.replay", description=__doc__)
    which = parser.add_mutually_exclusive_group(required=True)
    which.add_argument("--output", help="new folder for a bundle")
    which.add_argument("--check", help="folder of a bundle to verify")
    parser.add_argument("--input", help="an export to replay and publish")
    options = parser.parse_args(argv)
    if options.input and not options.output:
        parser.error("--input goes with --output")
    spark = local_session()
    try:
        if options.output:
            create(spark, options.output, given=options.input)
            print(json.dumps({"created": options.output}, sort_keys=True))
        else:
            print(json.dumps(check(spark, options.check), sort_keys=True))
    except (ValidationError, OSError, json.JSONDecodeError) as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
