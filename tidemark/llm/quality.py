"""Quality rules: a hashed n-gram log-likelihood ratio over two multinomials, and the base counts.

The n-grams are whole words and pairs of neighbouring words, hashed to ``BUCKETS`` counters. The raw
corpus is every document. The trusted target is every good, non-toxic label: they are split in halves by
the hash of their ids. One half is counted, whole; its multinomial is smoothed with ``PRIOR`` draws from the
corpus, so that an n-gram the target says nothing of has a ratio near zero. A document's score is the
mean over its n-grams of log(target share / corpus share). The other half, which the target has not
seen, sets the threshold, whole: the score below which ``LOST`` of its documents lie. Every document
below it is rejected.

All of it is DataFrame expressions. Texts are read once, into a table of counts and buckets; the
corpus is counted and documents are scored from that. The array of ratios and a bit map of the good labels' ids,
both of fixed size, are scalar subqueries. Rows that the map lets pass are joined with the ids themselves, so
of all documents about the labelled ones alone are shuffled: with their buckets, two bytes each, where they are counted,
and with their scores where they set the threshold. The threshold is read from running counts of distinct scores over range
partitions. Nothing but the two arrays is gathered in a task, however many labels there are.

Defined results: null and empty texts have no words, score zero and fail the base; without good labels in
the first half all scores are zero, without any in the second nothing is rejected for its score; labels of ids
without documents are ignored; repeated rows are judged each; an empty table gives an empty table;
other columns pass through only as asked for, also if their names clash with working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..operators import ordered
from .common import written

BUCKETS = 1 << 16
#: Bits of the map of good labels' ids, 1 MB; as they fill, more rows reach the join that decides.
SCREEN = 1 << 23
PRIOR = 4096.0
#: The share of the held labels' documents that the threshold gives up.
LOST = 0.002
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    for white in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeated(hashes: Column) -> Column:
    """The number of words that three-word windows found twice or more cover."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The sorted array is the one element of another, so that it is made once for all of its uses.
    twice = F.transform(
        F.array(ranked),
        lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(F.flatten(twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """A written table of ``keep`` as structure ``k``, the base counts and ``grams``, the buckets of all words and then of all pairs."""
    rows = docs.select(F.struct(*keep).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", _words(F.col("t"))).withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    pairs = F.zip_with(F.slice("h", 1, F.greatest(F.col("n") - 1, F.lit(0))), F.slice("h", 2, F.greatest(F.col("n"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("p", pairs)
    windows = F.zip_with(F.slice("p", 1, F.greatest(F.col("n") - 2, F.lit(0))), F.slice("h", 3, F.greatest(F.col("n") - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("v", windows)
    lines = F.transform(F.array(F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    table = rows.select(
        "k",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.get(lines, 0).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("v")) < F.size("v"), _repeated(F.col("v"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform(F.concat("h", "p"), lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).alias("grams"),
    )
    return written(table, "grams")


def good_ids(labels: DataFrame, kind: DataType) -> DataFrame:
    """Ids of the good labels, each once, in the documents' type."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").try_cast(kind).alias("good_id"))
    return good.where("good_id is not null").distinct()


def _half(key: Column) -> Column:
    """0 for ids whose labels are counted, 1 for those that set the threshold."""
    return F.xxhash64(key).bitwiseAND(F.lit(1))


def _bit(key: Column) -> tuple[Column, Column]:
    """The word of the map and the bit in it that an id has."""
    at = F.pmod(F.xxhash64(key), F.lit(SCREEN))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def id_map(good: DataFrame) -> DataFrame:
    """One row: the map as an array of SCREEN / 64 longs."""
    word, bit = _bit(F.col("good_id"))
    marks = good.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    every = good.sparkSession.range(SCREEN >> 6).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marks.unionAll(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("map"))


def _screened(table: DataFrame, key: str, bits: Column, half: int) -> DataFrame:
    """Rows of ``table`` whose ids are in the half and may be in the map."""
    own = F.col(f"k.`{key}`")
    word, bit = _bit(own)
    return table.where((_half(own) == half) & (F.getbit(F.get(bits, word), bit) == 1))


def ratio_table(table: DataFrame, good: DataFrame, key: str, bits: Column) -> DataFrame:
    """One row: the log ratio of each bucket, an array of BUCKETS doubles."""
    zero = F.lit(0).cast("long")
    raw = table.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw")).withColumn("target", zero)
    # Buckets move as two bytes each; an id is in ``good`` once, so that an inner join gives its rows once.
    moved = _screened(table, key, bits, 0).select(F.col(f"k.`{key}`").alias("id"), F.transform("grams", lambda b: (b - BUCKETS // 2).cast("short")).alias("grams"))
    counted = moved.join(good.where(_half(F.col("good_id")) == 0), F.col("id") == F.col("good_id"))
    target = counted.select(F.explode("grams").alias("moved")).groupBy((F.col("moved").cast("int") + BUCKETS // 2).alias("bucket")).agg(F.count("*").alias("target"))
    every = table.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), zero.alias("raw"), zero.alias("target"))
    whole = raw.unionByName(target.withColumn("raw", zero)).unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = whole.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    corpus = lambda r: (r["raw"] + 1) / (F.col("n_raw") + BUCKETS)
    ratio = lambda r: F.log((r["target"] + PRIOR * corpus(r)) / (F.col("n_target") + PRIOR) / corpus(r))
    return rows.select(F.when(F.col("n_target") > 0, F.transform("t", ratio)).otherwise(F.transform("t", lambda r: F.lit(0.0))).alias("ratios"))


def quantile(scores: DataFrame, share: float) -> float:
    """The score that ``share`` of the column ``s`` lie below, exact and between two scores in proportion; minus infinity of none."""
    table = ordered.stretches(scores.groupBy("s").agg(F.count("*").alias("n")), [], ["s"])
    total = table.agg(F.sum("n")).first()[0]
    if not total:
        return float("-inf")
    place = share * (total - 1)
    low = int(place)
    ends = ordered.running_sums(table, [], ["s"], {"upto": F.col("n")})
    below, above = ends.agg(*(F.min(F.when(F.col("upto") > k, F.col("s"))) for k in (low, min(low + 1, total - 1)))).first()
    return below + (place - low) * (above - below)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default the key) with the base counts, ``score``, ``base_failed`` and ``kept``."""
    keep = keep or [key]
    table = measured(docs, keep if key in keep else [*keep, key], text)
    good = good_ids(labels, docs.schema[key].dataType)
    bits = written(id_map(good), "map").scalar()
    ratios = written(ratio_table(table, good, key, bits), "ratios")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(F.col("ratios"), b))
    mean = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    seen = _screened(table, key, bits, 1).where(~failed).withColumn("ratios", ratios.scalar()).select(F.col(f"k.`{key}`").alias("id"), mean.alias("s"))
    held = seen.join(good.where(_half(F.col("good_id")) == 1), F.col("id") == F.col("good_id"))
    least = quantile(held.select("s"), LOST)
    scored = table.withColumn("ratios", ratios.scalar()).select("k", *COUNTS, mean.alias("score"))
    # The verdict in the same projection as the score: a filter on it then brings one more evaluation, not many.
    return scored.select(*(F.col(f"k.`{c}`") for c in keep), *COUNTS, "score", failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(least))).alias("kept"))
