"""Checks of recorded figures, as rows (check, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, is_close
from ..validate import require


def checks(rows: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(keys..., check, passed) for each named condition; null counts as failed."""
    keys = keys or []
    named = rows.select(*keys, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()))
    return named.unpivot(keys, list(conditions), "check", "passed")


def comparison_checks(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of (candidate, control, delta, low, high): finite, difference within 1e-12, ordered bounds around it, straddling zero."""
    numbers = [F.col(c) for c in ("candidate", "control", "delta", "low", "high")]
    all_finite = finite(numbers[0])
    for n in numbers[1:]:
        all_finite = all_finite & finite(n)
    return checks(
        rows,
        {
            "finite": all_finite,
            "delta_adds_up": is_close(F.col("candidate") - F.col("control"), F.col("delta")),
            "bounds_ordered": F.col("low") <= F.col("high"),
            "straddles_zero": (F.col("low") < 0) & (F.col("high") > 0),
        },
        keys,
    )


def recorded_checks(rows: DataFrame, literals: dict[str, object], flags: list[str], populations: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """(keys..., check, passed) of recorded figures: fields that must have a value, flags that must be false, and counts that must be as given."""
    conditions = {f"{c} is {v!r}": F.col(c) == F.lit(v) for c, v in literals.items()}
    conditions |= {f"{c} is false": ~F.col(c) for c in flags}
    conditions |= {f"{c} counts {n}": F.col(c) == n for c, n in populations.items()}
    return checks(rows, conditions, keys)


def outcome_histogram(ledger: DataFrame, outcome: str = "outcome") -> DataFrame:
    return ledger.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def all_pass(checks: DataFrame) -> DataFrame:
    """One row: whether every check passed, and how many there are."""
    return checks.agg(F.every("passed").alias("all_passed"), F.count("*").alias("n_checks"))


def require_pass(checks: DataFrame) -> None:
    require(checks.where(~F.col("passed")), "a check failed")
