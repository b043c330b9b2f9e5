"""Error slices of forecasts: pooled, by series and by chronological half, in one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation
from ..validate import forecast_violations, require


def midpoint(rows: DataFrame) -> DataFrame:
    """One row: the last origin of the earlier half of the distinct origins; an odd one belongs to it."""
    return rows.select("origin").distinct().agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY origin)").cast("long").alias("midpoint"))


def slices(rows: DataFrame) -> DataFrame:
    """(model, kind, slice, rmse, mae, correlation, bias, n, first_origin, last_origin) of rows (model, series_id, origin, actual, prediction).

    A half without rows is there with count 0 and null metrics.
    """
    middle = midpoint(rows).scalar()
    marked = rows.withColumn("period", F.when(F.col("origin") <= middle, "earlier").otherwise("later"))
    error = F.col("prediction") - F.col("actual")
    sets = marked.groupingSets([["model"], ["model", "series_id"], ["model", "period"]], "model", "series_id", "period").agg(
        F.grouping("series_id").alias("gs"),
        F.grouping("period").alias("gp"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        correlation(F.col("prediction"), F.col("actual")).alias("correlation"),
        F.avg(error).alias("bias"),
        F.count("*").alias("n"),
        F.min("origin").alias("first_origin"),
        F.max("origin").alias("last_origin"),
    )
    kind = F.when(F.col("gs") == 0, "series").when(F.col("gp") == 0, "period").otherwise("pooled")
    found = sets.select("model", kind.alias("kind"), F.coalesce("series_id", "period", F.lit("all")).alias("slice"), "rmse", "mae", "correlation", "bias", "n", "first_origin", "last_origin")
    halves = rows.select("model").distinct().select("model", F.lit("period").alias("kind"), F.explode(F.array(F.lit("earlier"), F.lit("later"))).alias("slice"))
    whole = found.join(halves, ["model", "kind", "slice"], "full_outer")
    return whole.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def checked_slices(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """``slices`` of wide forecast rows, after checking them."""
    from .rolling import by_model

    require(forecasts.limit(1).agg(F.count("*").alias("n")).where("n = 0"), "no forecasts")
    require(forecast_violations(forecasts, ["actual", *models]), "invalid forecast rows")
    return slices(by_model(forecasts.select("series_id", "origin", "actual", *models), models))


def reconciliation(slices: DataFrame) -> DataFrame:
    """(model, kind, rmse_gap, bias_gap): pooled errors against the count-weighted ones of the slices."""
    parts = slices.where("kind <> 'pooled' and n > 0").groupBy("model", "kind").agg(
        F.sqrt(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")) / F.sum("n")).alias("rmse_parts"),
        (F.sum(F.col("n") * F.col("bias")) / F.sum("n")).alias("bias_parts"),
    )
    pooled = slices.where("kind = 'pooled'").select("model", "rmse", "bias")
    return parts.join(pooled, "model").select("model", "kind", F.abs(F.col("rmse_parts") - F.col("rmse")).alias("rmse_gap"), F.abs(F.col("bias_parts") - F.col("bias")).alias("bias_gap"))
