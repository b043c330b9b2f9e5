"""Paired circular block bootstrap of correlation ratios.

The starts of blocks are numpy's own stream, made where they are used: a generator jumps ahead, so each task draws its
stretch of the one sequence. Starts are expanded to positions, joined with the daily values and aggregated. One set of
positions serves all variants. Blocks wrap within their fold and never cross into another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import LEAST_DEVIATION, ratio
from ..session import shuffle_width
from ..validate import ValidationError, require, whole_number


def _checked(folds: Sequence[int], blocks: Iterable[int], repetitions: int) -> None:
    whole_number(repetitions, 1, "repetitions")
    for block in blocks:
        whole_number(block, 1, "block")
    if not folds or min(folds) < 2:
        raise ValidationError("folds need at least two dates each")


#: Draws that a task makes at once, and so many that are looked through for rejected numbers on the driver.
STRETCH = 1 << 16


def raw_numbers(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit numbers ``start`` to ``start`` + ``count`` of the generator's stream; each of its 64-bit outputs gives two, the low half first."""
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    return bits.random_raw((start + count + 1) // 2 - start // 2).astype("<u8").view("<u4")[start % 2 :][:count]


def bounded(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``n`` and whether each is used: the high half of raw x n, refused where the low half is among the 2**32 % n that would favour some."""
    product = raw.astype(np.uint64) * np.uint64(n)
    return (product >> np.uint64(32)).astype(np.int64), (product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)


def _refused(spark: SparkSession, seed: int, start: int, count: int, n: int) -> list[int]:
    """Places of the numbers from ``start`` on that are refused: about ``count`` x ``n`` / 2**32 of them."""

    def places(a: int) -> np.ndarray:
        return start + a + np.flatnonzero(~bounded(raw_numbers(seed, start + a, min(STRETCH, count - a)), n)[1])

    if count <= STRETCH:
        return places(0).tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                yield pd.DataFrame({"place": places(int(i) * STRETCH)})

    return sorted(r.place for r in spark.range(-(-count // STRETCH)).mapInPandas(run, "place long").collect())


def bounded_draws(spark: SparkSession, seed: int, start: int, count: int, n: int) -> tuple[DataFrame, int]:
    """(draw, start): ``count`` numbers below ``n`` as numpy's ``integers`` draws them from place ``start`` of the stream on, and the place after them."""
    refused, end, more = [], start, count
    while more:
        found = _refused(spark, seed, end, more, n)
        refused, end, more = refused + found, end + more, len(found)
    # Before draw j the numbers are refused whose place, less those refused before it, is at most j.
    passed = np.array(refused, np.int64) - start - np.arange(len(refused))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                draw = np.arange(int(i) * STRETCH, min(count, (int(i) + 1) * STRETCH))
                place = start + draw + np.searchsorted(passed, draw, "right")
                raw = raw_numbers(seed, int(place[0]), int(place[-1] - place[0]) + 1)
                yield pd.DataFrame({"draw": draw, "start": bounded(raw[place - place[0]], n)[0]})

    stretches = -(-count // STRETCH)
    return spark.range(0, stretches, 1, max(1, min(stretches, shuffle_width(spark)))).mapInPandas(run, "draw long, start long"), end


def fold_starts(spark: SparkSession, folds: Sequence[int], blocks: Sequence[int], repetitions: int, seed: int) -> DataFrame:
    """Block starts for each fold: a matrix (repetitions, blocks of the fold) a fold, the generator seeded anew for each block size.

    Equal to numpy's ``default_rng(seed).integers`` called fold by fold, for any number of repetitions.
    """
    _checked(folds, blocks, repetitions)
    parts = []
    for block in blocks:
        at = offset = 0
        for fold, length in enumerate(folds):
            n = -(-length // block)
            drawn, at = bounded_draws(spark, seed, at, repetitions * n, length)
            fixed = [F.lit(v).cast("int").alias(c) for c, v in (("block", block), ("fold", fold), ("length", length), ("fold_offset", offset))]
            parts.append(drawn.select(fixed[0], F.floor(F.col("draw") / n).cast("int").alias("rep"), *fixed[1:], (F.col("draw") % n).cast("int").alias("blk"), "start"))
            offset += length
    return reduce(DataFrame.unionAll, parts)


def single_starts(spark: SparkSession, n: int, block: int, repetitions: int, seed: int) -> DataFrame:
    """Block starts over one population, drawn one repetition after another, which is one fold's matrix."""
    return fold_starts(spark, [n], [block], repetitions, seed)


def positions(starts: DataFrame) -> DataFrame:
    """(block, rep, slot, pos): the position that each slot of a resample takes; a fold's blocks are cut to its length."""
    step = F.explode(F.sequence(F.lit(0), F.col("block") - 1))
    rows = starts.withColumn("step", step)
    flat = F.col("blk") * F.col("block") + F.col("step")
    return rows.where(flat < F.col("length")).select(
        "block",
        "rep",
        (F.col("fold_offset") + flat).cast("long").alias("slot"),
        (F.col("fold_offset") + F.pmod(F.col("start") + F.col("step"), F.col("length").cast("long"))).cast("long").alias("pos"),
    )


def positioned(daily: DataFrame, order: str = "date_id", by: Sequence[str] = ("variant",)) -> DataFrame:
    """(variant, pos, rho): positions from 0 in the order of dates."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return daily.select(*by, place.cast("long").alias("pos"), "rho")


def draws(daily: DataFrame, positions: DataFrame) -> DataFrame:
    """(block, rep, variant, deviation, draw): the ratio of each variant's resample."""
    return positions.join(daily, "pos").groupBy("block", "rep", "variant").agg(F.stddev_pop("rho").alias("deviation"), ratio(F.col("rho")).alias("draw"))


def require_spread(draws: DataFrame) -> None:
    require(draws.where(F.col("deviation") <= LEAST_DEVIATION), "a resample has no deviation")


def observed(daily: DataFrame) -> DataFrame:
    """(variant, observed)."""
    return daily.groupBy("variant").agg(ratio(F.col("rho")).alias("observed"))


def _quantiles(value: Column, at: Sequence[float]) -> Column:
    return F.percentile(value, F.array(*map(F.lit, at)))


def compare(daily: DataFrame, starts: DataFrame, comparisons: Sequence[tuple[str, str]], check: bool = True) -> DataFrame:
    """For each block size and comparison: the difference, its conditional 95 % interval, and the simultaneous one.

    The conditional interval is the 2.5 and 97.5 percentile of the drawn differences; the
    simultaneous one is the difference plus and minus the 95th percentile, over repetitions, of the
    largest error among all comparisons.
    """
    if not comparisons:
        raise ValidationError("no comparisons")
    drawn = draws(daily, positions(starts))
    if check:
        require_spread(drawn)
    by_name = lambda value: F.map_from_entries(F.collect_list(F.struct("variant", value)))
    seen = observed(daily).agg(by_name("observed").alias("seen"))
    # All variants of a repetition in one row: the draws are made once, and a row knows its largest error.
    rows = drawn.groupBy("block", "rep").agg(by_name("draw").alias("drawn")).join(F.broadcast(seen))  # one row
    pair = lambda of: F.array(*(of[a] - of[b] for a, b in comparisons))
    measured = rows.select("block", pair(F.col("drawn")).alias("d"), pair(F.col("seen")).alias("delta"))
    errors = F.zip_with("d", "delta", lambda d, o: F.abs(d - o))
    names = F.array(*(F.struct(F.lit(a).alias("variant"), F.lit(b).alias("reference")) for a, b in comparisons))
    each = measured.select("block", F.array_max(errors).alias("e"), F.explode(F.arrays_zip(names.alias("names"), F.col("d").alias("d"), F.col("delta").alias("delta"))).alias("p"))
    bounds = each.groupBy("block", "p.names.variant", "p.names.reference").agg(
        F.first("p.delta").alias("delta"), _quantiles(F.col("p.d"), (0.025, 0.975)).alias("q"), F.percentile("e", F.lit(0.95)).alias("critical")
    )
    return bounds.select(
        "variant",
        "reference",
        F.col("block").alias("block_dates"),
        "delta",
        F.get("q", F.lit(0)).alias("conditional_low"),
        F.get("q", F.lit(1)).alias("conditional_high"),
        (F.col("delta") - F.col("critical")).alias("simultaneous_low"),
        (F.col("delta") + F.col("critical")).alias("simultaneous_high"),
    )


def paired_interval(daily: DataFrame, starts: DataFrame, candidate: str, reference: str) -> DataFrame:
    """One row: the 2.5 and 97.5 percentile of the drawn differences of two variants."""
    drawn = draws(daily, positions(starts))
    both = drawn.groupBy("rep").agg(F.max(F.when(F.col("variant") == candidate, F.col("draw"))).alias("a"), F.max(F.when(F.col("variant") == reference, F.col("draw"))).alias("b"))
    return both.agg(_quantiles(F.col("a") - F.col("b"), (0.025, 0.975)).alias("q")).select(F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
