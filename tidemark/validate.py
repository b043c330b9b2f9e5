"""Validation as data: every check is a DataFrame of violations, and ``require`` is the action that fails on any.

Assertions inside a lazy plan can be pruned with the columns that hold them, so nothing here relies
on them: a check runs when it is required, before the query it guards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import finite


class ValidationError(ValueError):
    """Rows break a rule."""


def require(violations: DataFrame, what: str) -> None:
    """Fails with the first violation, if there is any."""
    first = violations.take(1)
    if first:
        raise ValidationError(f"{what}: {first[0].asDict()}")


def require_equal_rows(a: DataFrame, b: DataFrame, what: str) -> None:
    """Set equality with multiplicity, from two differences."""
    require(a.exceptAll(b).unionAll(b.exceptAll(a)), what)


def whole_number(value: object, low: int, what: str) -> int:
    """An int that isn't a bool, at least ``low``."""
    if isinstance(value, bool) or not isinstance(value, int) or value < low:
        raise ValidationError(f"{what} must be a whole number of at least {low}")
    return value


def finite_number(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValidationError(f"{what} must be a finite number")
    return float(value)


def label_violations(labels: DataFrame) -> DataFrame:
    """Labels with the first rule that each breaks."""
    reason = (
        F.when(F.coalesce(F.length(F.trim("instrument")), F.lit(0)) == 0, "blank instrument")
        .when(F.coalesce(F.col("observed_day") < 1, F.lit(True)), "observed day before 1")
        .when(F.coalesce(F.col("released_day") <= F.col("observed_day"), F.lit(True)), "released before it could be known")
        .when(~F.coalesce(finite(F.col("value")), F.lit(False)), "value not finite")
    )
    return labels.withColumn("reason", reason).where("reason is not null")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row: a second vintage of a label is an error, not a revision."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def alignment_violations(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Cells (date, target, position) that only one side has."""
    keys = ["date_id", "target", "target_pos"]
    both = truth.select(*keys, F.lit(1).alias("t")).join(prediction.select(*keys, F.lit(1).alias("p")), keys, "full_outer")
    return both.where("t is null or p is null").select(*keys, F.when(F.col("t").isNull(), "truth").otherwise("prediction").alias("missing_from"))


def cell_violations(cells: DataFrame) -> DataFrame:
    """Predictions must be finite in every cell; truths may be missing but not infinite."""
    bad_truth = F.coalesce(F.abs(F.col("truth")) == F.lit(float("inf")), F.lit(False))
    return cells.where(~F.coalesce(finite(F.col("prediction")), F.lit(False)) | bad_truth)


def panel_violations(panel: DataFrame, series: int = 6) -> DataFrame:
    """Panel documents that lack the synthetic scope, the number of series, unique ids, equal lengths or finite values."""
    lengths_fit = F.forall("series", lambda s: F.size(s["values"]) == F.col("days"))
    all_finite = F.forall("series", lambda s: F.forall(s["values"], lambda v: F.coalesce(finite(v), F.lit(False))))
    ids = F.transform("series", lambda s: s["id"])
    fits = (F.col("scope") == "SYNTHETIC_ONLY") & (F.size("series") == series) & (F.size(F.array_distinct(ids)) == F.size(ids)) & lengths_fit & all_finite
    return panel.where(~F.coalesce(fits, F.lit(False)))


def forecast_violations(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """Forecast rows with an empty series, a missing origin, a number that isn't finite, or a repeated key."""
    bad = F.coalesce(F.length("series_id"), F.lit(0)) == 0
    bad = bad | F.col("origin").isNull()
    for c in numbers:
        bad = bad | ~F.coalesce(finite(F.col(c)), F.lit(False))
    broken = rows.where(bad).select("series_id", "origin", F.lit("malformed").alias("reason"))
    repeated = duplicate_keys(rows, ["series_id", "origin"]).select("series_id", "origin", F.lit("repeated").alias("reason"))
    return broken.unionByName(repeated)


def outside(rows: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """Rows whose value isn't among the allowed ones."""
    return rows.join(allowed.select(F.col(allowed_column).alias("__allowed")), F.col(column) == F.col("__allowed"), "left_anti")


def missing_from(required: DataFrame, required_column: str, rows: DataFrame, column: str) -> DataFrame:
    """Required values that no row has."""
    return required.join(rows.select(F.col(column).alias("__there")), F.col(required_column) == F.col("__there"), "left_anti")
