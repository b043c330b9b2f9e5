"""A seeded panel of six series: an autoregression driven by cycles, noise and, optionally, a level shift.

The random numbers come from one linear congruential stream over all series in turn. Jumping ahead in
the stream is itself an affine step, so each series finds its own first state and is generated on its
own, by a fold over its days. Each day's value needs the day before, so a series is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..validate import ValidationError, whole_number

#: Multiplier, increment and modulus of the stream, and the panel's constants.
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32
SERIES = 6
NAMES = ["Alloy A", "Energy B", "Grain C", "Metal D", "Fuel E", "Crop F"]
PERSISTENCE = 0.78
NOISE = {"steady": 0.22, "shift": 0.22, "noisy": 0.7}
SHIFT_FROM, SHIFT_EVEN, SHIFT_ODD = 150, 0.22, -0.18
DRAWS_A_DAY = 3


def jump(steps: int) -> tuple[int, int]:
    """Multiplier and increment of ``steps`` steps at once, by repeated squaring."""
    a, c, power_a, power_c = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = a * power_a % MODULUS, (c * power_a + power_c) % MODULUS
        power_a, power_c = power_a * power_a % MODULUS, (power_c * power_a + power_c) % MODULUS
        steps >>= 1
    return a, c


def observations(spark: SparkSession, seed: int = 2026, scenario: str = "steady", days: int = 240) -> DataFrame:
    """(series_id, series_pos, t, value)."""
    whole_number(seed, 0, "seed")
    whole_number(days, 100, "days")
    if scenario not in NOISE or days > 1000:
        raise ValidationError("unknown scenario, or too many days")
    starts = []
    for j in range(SERIES):
        a, c = jump(j * (1 + DRAWS_A_DAY * days))
        starts.append((j, (a * (seed % MODULUS) + c) % MODULUS))
    base = spark.createDataFrame(starts, "series_pos int, seeded long")
    # The multiplier has 21 bits and a state 32, so the product fits in 53.
    step = lambda s: F.pmod(s * MULTIPLIER + INCREMENT, F.lit(MODULUS))
    unit = lambda s: s / F.lit(float(MODULUS))
    j = F.col("series_pos")

    def day(acc, t):
        s1 = step(acc["s"])
        s2 = step(s1)
        s3 = step(s2)
        noise = (unit(s1) + unit(s2) + unit(s3) - 1.5) * NOISE[scenario]
        cycle = 0.15 * F.sin(t / 8 + j * 0.47) + 0.08 * F.cos(t / 19 - j * 0.33)
        value = PERSISTENCE * acc["previous"] + cycle + noise
        if scenario == "shift":
            value = value + F.when(t >= SHIFT_FROM, F.when(j % 2 == 0, SHIFT_EVEN).otherwise(SHIFT_ODD)).otherwise(0.0)
        return F.struct(s3.alias("s"), value.alias("previous"), F.concat(acc["values"], F.array(value)).alias("values"))

    first = step(F.col("seeded"))
    start = F.struct(first.alias("s"), ((unit(first) - 0.5) * 0.5).alias("previous"), F.array().cast("array<double>").alias("values"))
    folded = base.select("series_pos", F.aggregate(F.sequence(F.lit(0), F.lit(days - 1)), start, day)["values"].alias("values"))
    return folded.select(F.char(F.lit(65) + j).alias("series_id"), "series_pos", F.posexplode("values").alias("t", "value"))


def panel(spark: SparkSession, seed: int = 2026, scenario: str = "steady", days: int = 240) -> DataFrame:
    """One row: the panel as a nested document, with its scope, seed and scenario."""
    obs = observations(spark, seed, scenario, days)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda r: r["value"])
    series = obs.groupBy("series_id", "series_pos").agg(ordered.alias("values"))
    named = F.transform(
        F.array_sort(F.collect_list(F.struct("series_pos", "series_id", "values"))),
        lambda s: F.struct(
            s["series_id"].alias("id"),
            F.get(F.array(*map(F.lit, NAMES)), s["series_pos"]).alias("name"),
            s["values"].alias("values"),
        ),
    )
    return series.agg(named.alias("series")).select(
        F.lit("tidemark-panel-v1").alias("schema"),
        F.lit("SYNTHETIC_ONLY").alias("scope"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(scenario).alias("scenario"),
        F.lit(days).alias("days"),
        "series",
        F.lit("Six fictional signal series in arbitrary units.").alias("description"),
    )


def exploded(panel: DataFrame) -> DataFrame:
    """The observations of a panel document."""
    series = panel.select(F.posexplode("series").alias("series_pos", "s"))
    return series.select(F.col("s.id").alias("series_id"), "series_pos", F.posexplode("s.values").alias("t", "value"))


def authored_labels(spark: SparkSession) -> DataFrame:
    """Four literal labels, two of them out by day 5."""
    from ..schemas import LABEL

    rows = [("metal_alpha", 1, 3, 0.20), ("metal_beta", 1, 5, -0.10), ("metal_alpha", 2, 6, 0.05), ("metal_beta", 3, 7, 0.30)]
    return spark.createDataFrame(rows, LABEL)
