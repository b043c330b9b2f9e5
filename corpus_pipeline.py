"""From raw documents to packed sequences.

The stages, each of which works on all rows that the one before it kept: quality rules (rejected
documents go), line dedup (boilerplate lines go), SimHash near-dedup (one document stays of each group whose
five-word shingles have a similarity of 0.8 or more), secret scans (secrets are replaced by a mark) and packing.
All but the last return the columns of ``documents``, with ``n_chars`` that of the text at hand.

Defined results: a document is a row; rows with null or repeated ids but different texts are different
documents. Of a group of near copies the one with the smallest id stays (null ids last), then the one with the smallest
text hash, and of rows that agree in both any one. Null and empty texts fail the quality rules; empty tables give
empty tables; columns other than those of ``documents`` are dropped. A stage's result is to be written before
the next stage is called, as the next removes the tables that the operators behind it left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, packing, quality, secrets, simhash
from tidemark.llm.common import collecting, remove, shared_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


#: What the operators of the last stage left in the shared folder.
_left: list[str] = []


def _alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins by removing what the one before it left: its rows are a table by then, so the disk holds one stage's."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(_left.pop(), spark)
        with collecting() as paths:
            out = stage(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run


@_alone
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


@_alone
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(lines.dedup(docs.select(*COLUMNS)))


@_alone
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row's place in its group: known ids first, then the id, then the text's hash. None of the three is null.
    place = lambda text_hash: (F.col("doc_id").isNull().alias("u"), F.coalesce("doc_id", F.lit(0)).alias("d"), text_hash.alias("t"))
    stay = simhash.similar(docs).groupBy("root").agg(F.min(F.struct(*place(F.col("t")))).alias("p")).select("p.*")
    rows = docs.select(*COLUMNS, *place(F.xxhash64("text")))
    return rows.join(stay, ["u", "d", "t"], "left_semi").dropDuplicates(["u", "d", "t"]).select(*COLUMNS)


@_alone
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redact(docs.select(*COLUMNS)))


@_alone
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("simhash", near_dedup), ("secrets", secret_scan), ("packing", pack)]

#: SQL has neither the hashes of the quality and near-dedup stages nor zstandard; brute-force tests stand in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again, and removed when the next is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path=path)
        if before:
            remove(before, spark)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
