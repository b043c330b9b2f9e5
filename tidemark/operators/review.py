"""Reviews of a published result as tables: the project's declarations, what its checks covered, and its files.

A project declares commands (place, id, runtime, entry, args) and cards (audience and the files that it
links). A receipt holds a row for each command that ran. Every function gives the rows that break a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..validate import duplicate_keys
from .provenance import manifest_differences

COMMAND = "place int, id string, runtime string, entry string, args array<string>"
CHECK = "place int, id string, entry string, args array<string>, log string, status string, returncode int"
CARD = "audience string, implementation string, tests string, evidence string"


def _args() -> Column:
    return F.coalesce("args", F.array().cast("array<string>"))


def _linked(cards: DataFrame) -> DataFrame:
    return cards.select(F.explode(F.array("implementation", "tests", "evidence")).alias("path"))


def project_violations(commands: DataFrame, cards: DataFrame, files: DataFrame, runtimes: list[str], audiences: list[str]) -> DataFrame:
    """(part, name, reason): commands and cards that are malformed, stand twice or link files (path) that aren't there; an empty part."""
    fits = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(fits(F.col("id").rlike("^[a-z][a-z0-9-]*$")), "unsafe id").when(fits(F.col("runtime").isin(runtimes)), "unsupported runtime").when(F.exists(_args(), lambda a: a.isNull()), "invalid argument")
    rows = lambda df, part, name, reason: df.select(F.lit(part).alias("part"), F.col(name).alias("name"), reason.alias("reason")).where("reason is not null")
    empty = lambda df, part: rows(df.agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("name")).where("n = 0"), part, "name", F.lit("empty"))
    links = commands.select(F.lit("command").alias("part"), F.col("entry").alias("path")).unionAll(_linked(cards).select(F.lit("card"), "path")).distinct()
    missing = links.join(files.select("path"), "path", "left_anti").select("part", F.col("path").alias("name"), F.lit("no such file").alias("reason"))
    return (
        rows(commands, "command", "id", reason)
        .unionByName(rows(duplicate_keys(commands, ["id"]), "command", "id", F.lit("repeated")))
        .unionByName(rows(cards, "card", "audience", F.when(fits(F.col("audience").isin(audiences)), "unknown audience")))
        .unionByName(missing)
        .unionByName(empty(commands, "command"))
        .unionByName(empty(cards, "card"))
    )


def coverage_violations(commands: DataFrame, checks: DataFrame) -> DataFrame:
    """(place, id, reason): commands and checks matched place by place; each must be there, be the same call with its own log, and have passed."""
    c = commands.select("place", F.struct("id", "entry", _args().alias("args"), F.concat("id", F.lit(".log")).alias("log")).alias("c"))
    k = checks.select("place", F.struct("id", "entry", _args().alias("args"), "log").alias("k"), ((F.col("status") == "passed") & (F.col("returncode") == 0)).alias("passed"))
    reason = F.when(F.col("k").isNull(), "not run").when(F.col("c").isNull(), "not configured").when(~F.col("c").eqNullSafe(F.col("k")), "another call").when(~F.coalesce("passed", F.lit(False)), "not passed")
    return c.join(k, "place", "full_outer").select("place", F.coalesce("c.id", "k.id").alias("id"), reason.alias("reason")).where("reason is not null")


def bundle_violations(manifest: DataFrame, files: DataFrame, checks: DataFrame, required: tuple[str, ...] = ("receipt.json",)) -> DataFrame:
    """(path, reason): files (path, sha256) unlike the manifest's, and logs and required names that the manifest lacks."""
    names = manifest.sparkSession.createDataFrame([(n,) for n in required], "path string").unionAll(checks.select("log")).where("path is not null").distinct()
    absent = names.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("not in the manifest").alias("reason"))
    return manifest_differences(manifest, files).unionByName(absent)


def source_paths(commands: DataFrame, cards: DataFrame, listed: DataFrame) -> DataFrame:
    """(path): the union of all files that a project links or lists."""
    return commands.select(F.col("entry").alias("path")).unionAll(_linked(cards)).unionAll(listed.select("path")).where("path is not null").distinct()
