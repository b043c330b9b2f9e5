"""Line dedup by distinct-site spread.

Each line of a document is trimmed and hashed to 128 bits. Per line hash a HyperLogLog sketch of the
sites on which it stands is built in every partition and merged by aggregation. Lines whose estimate
is near ``min_sites`` get exact distinct counts; clear ones are decided by the estimate, whose error
at the small counts in question is far below the margin. Lines on at least ``min_sites`` sites are
boilerplate and removed from every document, whatever their share of it. Only documents of which no
word would be left stay whole: these are copies of one another, which near-duplicate search reduces to one.

Only hashes, sites and positions are shuffled for the counts; texts move once, to be joined with the
positions to remove. A line that a third of all documents share is pre-aggregated before each
shuffle, and is a skewed key of a join, which adaptive execution splits.

Defined results: null and empty texts stay as they are; lines of fewer than ``min_words`` words are
never boilerplate; a null site counts as one site; repeated lines of a document are removed alike;
equal rows get equal results; an empty table gives an empty table; other columns pass through, also
if their names clash with working columns, but ``n_lines_removed`` and ``n_chars_removed`` are those
of this run: input columns of these two names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES = 5
MIN_WORDS = 4
#: log2 of the sketch's counters: about 3 % standard error; sets of a few members are kept as such.
LOG2_COUNTERS = 10
#: Estimates within this share of the threshold are counted exactly (over 8 standard errors).
MARGIN = 0.3


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _lines(docs: DataFrame, key: str, text: str, site: str, min_words: int) -> DataFrame:
    """A row for each line of enough words: the document's identity, position, length, hash and site."""
    # Rows of one id but different texts stay apart; equal rows have equal results.
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.col(text).alias("text"))
    split = rows.select("d", "t", "site", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    enough = split.where(F.col("line").rlike(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (max(min_words, 1) - 1)))
    trimmed = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    return enough.select("d", "t", "pos", F.length(trimmed).alias("n"), "site", _key(trimmed).alias("h")).select("d", "t", "pos", "n", "site", "h.h1", "h.h2")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on at least ``min_sites`` sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG2_COUNTERS).alias("sketch"), F.count("*").alias("n_lines"))
    guessed = spread.where(F.col("n_lines") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("guess"))
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    near = guessed.where((F.col("guess") >= low) & (F.col("guess") < high)).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    pairs = lines.select("h1", "h2", "site").distinct()
    exact = pairs.join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return guessed.where(F.col("guess") >= high).select("h1", "h2").unionAll(exact.select("h1", "h2"))


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the sorted positions ``gone``, in time linear in both: the stretches of lines between them."""

    def stretches(lines: Column) -> Column:
        first = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, first(i) + 1, F.greatest(end(i) - first(i), F.lit(0)))))

    # The lines are the one element of an array, so that they are split once and not for each stretch.
    return F.array_join(F.flatten(F.transform(F.array(_split(text)), stretches)), "\n")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the long columns ``n_lines_removed`` and ``n_chars_removed``."""
    lines = written(_lines(docs, key, text, site, min_words), "lines")  # hashes and places, read three times
    # As a table, so that both sides of the join are plain exchanges and a very common line's rows can be split.
    common = written(boilerplate(lines, min_sites).select(F.col("h1").alias("c1"), F.col("h2").alias("c2")), "boilerplate")
    hit = lines.select("d", "t", "pos", "n", "h1", "h2").join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left_semi")
    # Equal rows give their positions more than once: a set.
    found = hit.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("gone"))
    found = found.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone.pos").alias("places"), F.aggregate("gone.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("chars"))
    joined = docs.alias("o").join(found.alias("f"), F.col(f"o.{key}").eqNullSafe(F.col("f.__d")) & (F.xxhash64(F.col(f"o.{text}")) == F.col("f.__t")), "left")
    cleaned = F.when(F.col("f.chars") > 0, _without(F.col(f"o.{text}"), F.col("f.places")))
    # In an array again: the cleaned text is made once, looked at and used.
    done = F.transform(F.array(cleaned), lambda c: F.when(c.rlike(r"[^\x20\x09-\x0D]"), c))
    outs = [F.coalesce(F.col("__cleaned"), F.col(f"o.{text}")).alias(text) if c == text else F.col(f"o.`{c}`") for c in docs.columns if c not in ("n_lines_removed", "n_chars_removed")]
    removes = F.col("__cleaned").isNotNull()
    return joined.withColumn("__cleaned", F.get(done, 0)).select(*outs, F.when(removes, F.size("f.places")).otherwise(0).cast("long").alias("n_lines_removed"), F.when(removes, F.col("f.chars")).otherwise(0).cast("long").alias("n_chars_removed"))
