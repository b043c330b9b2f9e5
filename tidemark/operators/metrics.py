"""Cross-sectional rank correlation by date, its mean-to-deviation ratio, and summaries of both.

Cells are rows (date_id, target, truth, prediction). One exchange on the date serves both rank
windows and the aggregation by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import doubled_rank, ratio, sentinel_to_null, whole_correlation
from ..validate import alignment_violations, cell_violations, require


def cells(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Truth and prediction side by side, over cells that both have."""
    keys = ["date_id", "target", "target_pos"]
    return truth.select(*keys, F.col("value").alias("truth")).join(prediction.select(*keys, F.col("value").alias("prediction")), keys)


def checked_cells(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """The same after checking identity and finiteness."""
    require(alignment_violations(truth, prediction), "truth and prediction differ in their cells")
    both = cells(truth, prediction)
    require(cell_violations(both), "a prediction isn't finite, or a truth is infinite")
    return both


def ranked(cells: DataFrame, within: list[str]) -> DataFrame:
    """Doubled average ranks of both sides among the observed cells: missing values go first, ranks come second."""
    observed = cells.withColumn("truth", sentinel_to_null(F.col("truth"))).where("truth is not null and prediction is not null")
    return observed.withColumn("truth_rank", doubled_rank(F.col("truth"), within)).withColumn("prediction_rank", doubled_rank(F.col("prediction"), within))


def daily_rank_correlation(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., date_id, n_observed, rho); rho is null on a date with a constant side."""
    keys = [*(by or []), "date_id"]
    return ranked(cells, keys).groupBy(*keys).agg(
        F.count("*").alias("n_observed"),
        whole_correlation(F.col("truth_rank"), F.col("prediction_rank")).alias("rho"),
    )


def require_scorable(cells: DataFrame, by: list[str] | None = None, least: int = 2) -> None:
    """Fails on dates with too few observed targets or a constant side."""
    keys = [*(by or []), "date_id"]
    observed = F.count(sentinel_to_null(F.col("truth")))
    require(cells.groupBy(*keys).agg(observed.alias("n")).where(F.col("n") < least), "a date has too few observed targets")
    require(daily_rank_correlation(cells, by).where("rho is null"), "a date has a constant truth or prediction")


def correlation_ratio(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., dates, score): mean over population deviation, not annualised; null below two dates or without deviation."""
    return daily.groupBy(*(by or [])).agg(F.count("rho").alias("dates"), F.when(F.count("rho") >= 2, ratio(F.col("rho"))).alias("score"))


def evaluate(cells: DataFrame) -> DataFrame:
    """One row: the score and its parts, the share of positive dates, errors, dates and daily values in order.

    As documented for the metric, the sentinel counts as missing in ranks but as a number in errors.
    """
    daily = daily_rank_correlation(cells)
    ordered = F.array_sort(F.collect_list(F.struct("date_id", "rho")))
    summary = daily.agg(
        ratio(F.col("rho")).alias("score"),
        F.avg("rho").alias("mean_correlation"),
        F.stddev_pop("rho").alias("correlation_deviation"),
        F.avg((F.col("rho") > 0).cast("double")).alias("positive_fraction"),
        F.count("*").alias("dates"),
        F.transform(ordered, lambda r: r["date_id"]).alias("date_ids"),
        F.transform(ordered, lambda r: r["rho"]).alias("daily_correlations"),
    )
    error = F.col("prediction") - F.col("truth")
    errors = cells.where("truth is not null and not isnan(truth)").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return summary.join(F.broadcast(errors))  # one row each


def horizon_metrics(cells: DataFrame, horizons: DataFrame, least: int = 2) -> DataFrame:
    """By lag, in numeric order: score and mean over the dates with enough observed targets, and how many have not.

    ``horizons`` is the (target, lag) dimension.
    """
    with_lag = cells.join(horizons.select("target", "lag"), "target")
    # A sentinel is observed for eligibility, though missing for the ranks.
    counted = with_lag.groupBy("lag", "date_id").agg(F.count(F.when(~F.isnan("truth"), F.col("truth"))).alias("n"))
    daily = daily_rank_correlation(with_lag, ["lag"]).join(counted.where(F.col("n") >= least).select("lag", "date_id"), ["lag", "date_id"])
    scored = daily.groupBy("lag").agg(F.when(F.count("rho") >= 2, ratio(F.col("rho"))).alias("score"), F.avg("rho").alias("mean_correlation"))
    dates = counted.groupBy("lag").agg(F.count_if(F.col("n") >= least).alias("eligible_dates"), F.count_if(F.col("n") < least).alias("excluded_dates"))
    return dates.join(scored, "lag", "left").select("lag", "score", "mean_correlation", "eligible_dates", "excluded_dates").orderBy("lag")  # a row for each horizon


def evaluated(truth: DataFrame, prediction: DataFrame, horizons: DataFrame) -> DataFrame:
    """``evaluate`` of checked cells, with the horizons' metrics in order as an array.

    Fails on cells that differ, predictions that aren't finite, dates with too few targets and constant
    sides, before anything is computed.
    """
    both = checked_cells(truth, prediction)
    require_scorable(both)
    rows = F.array_sort(F.collect_list(F.struct("lag", "score", "mean_correlation", "eligible_dates", "excluded_dates")))
    return evaluate(both).join(F.broadcast(horizon_metrics(both, horizons).agg(rows.alias("horizons"))))  # one row each
