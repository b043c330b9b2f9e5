"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, elkan, fingerprint, lines, packing, ppm, prefixes, quality, secrets, simhash, urls, warc
from .common import written

#: The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The conversation that the chat query adds: control strings inside its texts.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_and_edit(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.read_back(chat.format_chats(turns.unionByName(added)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cleaned text with its digest and what was removed."""
    cleaned = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines_removed", "n_chars_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules, ["page_id"])


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return ppm.score(_table(spark, sf_dir, "documents"), held)


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = elkan.compress(_table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    return elkan.with_group_error(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(elkan.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefixes.numbered(_table(spark, sf_dir, "conversations")), "turns")
    return prefixes.trie(prefixes.paths(prefixes.with_shared_heads(turns)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_bpe, op3_fingerprint, op4_packing, op5_chat, op6_quality, op7_simhash, op8_lines, op9_secrets, op10_urls, op11_ppm, op12_elkan, op13_prefixes)}
