"""Rolling fits at every origin, in one plan.

An origin trains on the labels of a window of days that ends at its release cutoff. All windows have one length, so days
are cut into blocks of that length: a window is the end of one block and the beginning of the next, and its sums are
those of a suffix and a prefix. Both run over a row for each day and key, made by one aggregation of the label rows, so the
work is days plus origins whatever the window, and nothing is subtracted. ``training_rows`` is the plain form, a row
for each label and origin. Only the small linear solves (one 10 x 10 system an origin) leave the JVM, in one
batched call for each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation
from ..session import written
from ..validate import ValidationError, finite_number, require, whole_number
from .features import FEATURES, WARM_UP, label_rows

#: A fit on fewer rows fails.
LEAST_ROWS = 18
#: A pivot below this makes a system singular.
LEAST_PIVOT = 1e-12
MODELS = ["ridge", "mean", "zero"]


@dataclass(frozen=True)
class RollingConfig:
    """Horizon, release delay, training window, ridge penalty, and first and last origin."""

    horizon: int = 5
    delay: int = 3
    window: int = 80
    alpha: float = 5.0
    start: int = 80
    end: int = 219

    def checked(self, days: int) -> RollingConfig:
        whole_number(self.delay, 0, "delay")
        if self.horizon not in (1, 5, 10, 20) or self.delay > 20 or self.window not in (40, 80, 120) or not 0.01 <= finite_number(self.alpha, "alpha") <= 100:
            raise ValidationError("unsupported horizon, delay, window or penalty")
        whole_number(self.start, WARM_UP, "start")
        whole_number(self.end, self.start, "end")
        if self.end >= days or self.end + self.horizon > days:
            raise ValidationError("origins need complete targets")
        return self


def training_rows(obs: DataFrame, config: RollingConfig) -> DataFrame:
    """Label rows by the ``origin`` that trains on them: label days from origin - window to origin - horizon - delay."""
    rows = label_rows(obs, config.horizon, config.delay)
    first = F.greatest(F.lit(config.start), F.col("released_day"))
    last = F.least(F.lit(config.end), F.col("t") + config.window)
    return rows.where(first <= last).withColumn("origin", F.explode(F.sequence(first, last)))


#: The features that aren't indicators of a series.
DENSE = FEATURES[:5]
_PAIRS = [(i, j) for i in range(len(DENSE)) for j in range(i + 1)]


def window_sums(rows: DataFrame, by: list[str], config: RollingConfig, sums: dict[str, Column]) -> DataFrame:
    """(by..., origin, rows, days, first_t, last_t, release, sums...) of the label rows that each origin may train on.

    ``sums`` are columns of the label rows to be added up. Origins without such rows have none here.
    """
    cutoff, first, last = config.horizon + config.delay, config.start - config.window, config.end - config.horizon - config.delay
    length = config.window - cutoff + 1
    adding, least, most = ["rows", "days", *sums], ["first_t"], ["last_t", "release"]
    own = rows.where(F.col("t").between(first, last) & F.lit(length >= 1)).select(*by, "t", F.lit(1).cast("long").alias("rows"), F.col("released_day").alias("release"), *(v.alias(n) for n, v in sums.items()))
    # Days without a row count as zero, so that windows are whole blocks of days.
    days = F.explode(F.sequence(F.lit(first), F.lit(max(first, last)))).alias("t")
    calendar = (own.select(*by).distinct().select(*by, days) if by else rows.sparkSession.range(1).select(days)).where(F.lit(length >= 1 and last >= first))
    empty = [(F.lit(None) if c == "release" else F.lit(0)).cast(t).alias(c) for c, t in own.dtypes if c not in (*by, "t")]
    daily = own.unionByName(calendar.select(*by, "t", *empty)).groupBy(*by, "t").agg(F.sum("rows").alias("rows"), F.max("release").alias("release"), *(F.sum(n).alias(n) for n in sums))
    there = F.col("rows") > 0
    daily = daily.withColumns({"days": there.cast("long"), "first_t": F.when(there, F.col("t")), "last_t": F.when(there, F.col("t"))})
    at = F.col("t") - first
    block = Window.partitionBy(*by, F.floor(at / max(length, 1))).orderBy("t")
    sides = {"end": (block.rowsBetween(0, Window.unboundedFollowing), F.col("t") + config.window, F.lit(True)), "start": (block.rowsBetween(Window.unboundedPreceding, 0), F.col("t") + cutoff, F.pmod(at, F.lit(max(length, 1))) != length - 1)}
    of = lambda w: [*(F.sum(c).over(w).alias(c) for c in adding), *(F.min(c).over(w).alias(c) for c in least), *(F.max(c).over(w).alias(c) for c in most)]
    both = daily.select(*by, *(F.struct(origin.cast("int").alias("origin"), used.alias("used"), *of(w)).alias(side) for side, (w, origin, used) in sides.items()))
    halves = both.select(*by, F.explode(F.array(*sides)).alias("s")).select(*by, "s.*")
    found = halves.where(F.col("used") & F.col("origin").between(config.start, config.end)).groupBy(*by, "origin")
    return found.agg(*(F.sum(c).alias(c) for c in adding), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most)).where("rows > 0")


#: A variance below this share of the second moment it is the rest of counts as zero.
NO_SPREAD = 1e-12


def _shift(rows: DataFrame) -> Column:
    """The first value of the earliest row: sums of differences from it keep their digits, and no later row changes it."""
    return F.coalesce(rows.agg(F.min_by("f0", F.struct("t", "series_id"))).scalar(), F.lit(0.0))


def moments(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """By origin: the receipt of its training rows, and the moments of the dense features for each indicator's rows.

    The indicators' own moments follow from the counts and means of these parts, so that thirty
    sums do instead of a hundred; there are six parts at most, whatever the number of series.
    """
    shift = _shift(rows)
    names = [*DENSE, "y"]
    apart = {c: F.col(c) - shift if c in (*DENSE[:3], "y") else F.col(c) for c in names}
    pairs = [*((DENSE[i], DENSE[j]) for i, j in _PAIRS), *((f, "y") for f in DENSE)]
    sums = {f"s_{c}": apart[c] for c in names} | {f"s_{a}_{b}": apart[a] * apart[b] for a, b in pairs}
    part = F.when(F.col("series_pos").between(1, 5), F.col("series_pos")).otherwise(0)
    found = window_sums(rows.withColumn("part", part), ["part"], config, sums)
    mean = {c: F.col(f"s_{c}") / F.col("rows") for c in names}

    def covariance(a: str, b: str) -> Column:
        second = F.col(f"s_{a}_{b}") / F.col("rows")
        value = second - mean[a] * mean[b]
        return F.when(value <= NO_SPREAD * second, 0.0).otherwise(value) if a == b else value

    means = F.array(*(mean[c] + shift if c in (*DENSE[:3], "y") else mean[c] for c in names))
    parts = found.select("origin", "rows", "part", means.alias("means"), F.array(*(covariance(a, b) for a, b in pairs)).alias("covariances"))
    by_origin = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("part", F.col("rows").alias("n"), "means", "covariances"))).alias("parts"))
    receipt = receipts(rows, config)
    return receipt.join(by_origin, "origin").select("origin", F.col("n_rows").alias("rows"), "first_origin", "last_origin", "max_release", "eligible_origins", "parts")


def receipts(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """By origin: how many rows and label days it trained on, their first, last and latest release."""
    return window_sums(rows, [], config, {}).select("origin", F.col("rows").alias("n_rows"), F.col("first_t").alias("first_origin"), F.col("last_t").alias("last_origin"), F.col("release").alias("max_release"), F.col("days").alias("eligible_origins"))


def _whole(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of all features and y, and their covariances, from the parts' own."""
    d, k = len(DENSE), len(FEATURES)
    n = np.array([p["n"] for p in parts], float)
    share = n / n.sum()
    means = np.zeros((len(parts), k + 1))
    within = np.zeros((k + 1, k + 1))
    for i, p in enumerate(parts):
        means[i, [*range(d), k]] = p["means"]
        if p["part"]:
            means[i, d + p["part"] - 1] = 1.0
        own = np.zeros((k + 1, k + 1))
        for (a, b), c in zip(_PAIRS, p["covariances"], strict=False):
            own[a, b] = own[b, a] = c
        own[k, :d] = own[:d, k] = p["covariances"][len(_PAIRS) :]
        within += share[i] * own
    centre = share @ means
    apart = means - centre
    return centre, within + (share[:, None] * apart).T @ apart, n.sum()


def _systems(parts: pd.Series, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of origins: means of features and y, scales, and the two sides of the normal equations of standardised features."""
    k = len(FEATURES)
    found = [_whole(p) for p in parts]
    centre, covariance, n = (np.stack([x[i] for x in found]) for i in range(3))
    scale = np.sqrt(np.diagonal(covariance, axis1=1, axis2=2)[:, :k])
    scale = np.where(scale == 0, 1.0, scale)
    gram = covariance[:, :k, :k] * n[:, None, None] / (scale[:, :, None] * scale[:, None, :])
    gram[:, range(k), range(k)] += alpha
    return centre, scale, gram, n[:, None] * covariance[:, :k, k] / scale


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a batch of symmetric systems; one with a pivot below ``LEAST_PIVOT`` fails."""
    try:
        factor = np.linalg.cholesky(gram)
    except np.linalg.LinAlgError:
        raise ValidationError("a system of a fit is singular") from None
    if len(gram) and (np.diagonal(factor, axis1=1, axis2=2) ** 2).min() < LEAST_PIVOT:
        raise ValidationError("a system of a fit is singular")
    return np.linalg.solve(gram, right[:, :, None])[:, :, 0]


def _solver(alpha: float):
    k = len(FEATURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            centre, scale, gram, right = _systems(f["parts"], alpha)
            yield f.drop(columns="parts").assign(intercept=centre[:, k], feature_mean=list(centre[:, :k]), feature_scale=list(scale), coefficients=list(solve(gram, right)))

    return run


def normal_equations(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """(origin, i, j, value): the lower triangle of each fit's standardised Gram matrix with the penalty, and with j = -1 its right side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = np.tril_indices(len(FEATURES))
        for f in frames:
            if not len(f):
                continue
            _, _, gram, right = _systems(f["parts"], config.alpha)
            values = np.concatenate([gram[:, i, j], right], 1)
            rows, cols = np.concatenate([i, np.arange(len(FEATURES))]), np.concatenate([j, np.full(len(FEATURES), -1)])
            yield pd.DataFrame({"origin": np.repeat(f["origin"].to_numpy(), len(rows)), "i": np.tile(rows, len(f)), "j": np.tile(cols, len(f)), "value": values.ravel()})

    return moments(rows, config).select("origin", "parts").mapInPandas(run, "origin int, i int, j int, value double")


FIT = "origin int, rows long, first_origin int, last_origin int, max_release int, eligible_origins long, intercept double, feature_mean array<double>, feature_scale array<double>, coefficients array<double>"


def labels_of(obs: DataFrame, config: RollingConfig) -> DataFrame:
    """The label rows of ``obs`` as a written table, as moments, means and forecasts all read them."""
    return written(label_rows(obs, config.horizon, config.delay), "label-rows")


def fits(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """The fit receipt of every origin, from label rows. The penalty is on standardised coefficients; the intercept is free."""
    return moments(rows, config).mapInPandas(_solver(config.alpha), FIT)


def require_enough_rows(rows: DataFrame, config: RollingConfig) -> None:
    """Fails unless every origin has the label rows that a fit needs."""
    origins = rows.sparkSession.range(config.start, config.end + 1).select(F.col("id").cast("int").alias("origin"))
    n = receipts(rows, config).select("origin", "n_rows")
    require(origins.join(n, "origin", "left").where(F.coalesce("n_rows", F.lit(0)) < LEAST_ROWS), "too few released labels to fit")


def baseline_means(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """(origin, series_id, mean): a series' own mean over its training rows."""
    return window_sums(rows, ["series_id"], config, {"s": F.col("y")}).select("origin", "series_id", (F.col("s") / F.col("rows")).alias("mean"))


def forecasts(obs: DataFrame, config: RollingConfig) -> DataFrame:
    """(series_id, origin, actual, ridge, mean, zero, target_end, released_day) at every origin."""
    return forecasts_of(labels_of(obs, config), config)


def forecasts_of(rows: DataFrame, config: RollingConfig) -> DataFrame:
    """The same from label rows."""
    fit = fits(rows, config).select("origin", "intercept", "feature_mean", "feature_scale", "coefficients")
    # An origin's features and its realised target are one row of the same windows as the labels.
    at = rows.where(F.col("t").between(config.start, config.end)).select("series_id", F.col("t").alias("origin"), F.array(*FEATURES).alias("x"), F.col("y").alias("actual"))
    terms = F.transform("x", lambda v, i: F.get("coefficients", i) * (v - F.get("feature_mean", i)) / F.get("feature_scale", i))
    ridge = F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return (
        at.join(fit, "origin")
        .join(baseline_means(rows, config), ["origin", "series_id"], "left")
        .select(
            "series_id",
            "origin",
            "actual",
            ridge.alias("ridge"),
            F.coalesce("mean", F.lit(0.0)).alias("mean"),
            F.lit(0.0).alias("zero"),
            (F.col("origin") + config.horizon - 1).alias("target_end"),
            (F.col("origin") + config.horizon + config.delay).alias("released_day"),
        )
    )


def single_feature_ridge(rows: DataFrame, feature: str, config: RollingConfig) -> DataFrame:
    """(origin, n_rows, beta, intercept): ridge on one standardised feature, in closed form."""
    shift = _shift(rows)
    x, y = F.col(feature) - shift, F.col("y") - shift
    found = window_sums(rows, [], config, {"x": x, "y": y, "xx": x * x, "xy": x * y})
    n = F.col("rows").cast("double")
    mean_x, mean_y = F.col("x") / n, F.col("y") / n
    spread = F.col("xx") / n - mean_x * mean_x
    variance = F.when(spread <= NO_SPREAD * F.col("xx") / n, 0.0).otherwise(spread)
    scale = F.coalesce(F.nullif(F.sqrt(variance), F.lit(0.0)), F.lit(1.0))
    beta = n * (F.col("xy") / n - mean_x * mean_y) / scale / (n * variance / (scale * scale) + config.alpha)
    return found.select("origin", F.col("rows").alias("n_rows"), beta.alias("beta"), (mean_y + shift).alias("intercept"))


def evaluated(obs: DataFrame, config: RollingConfig, days: int) -> DataFrame:
    """``forecasts`` after checking the configuration and that every origin can be fitted."""
    config.checked(days)
    rows = labels_of(obs, config)
    require_enough_rows(rows, config)
    return forecasts_of(rows, config)


def scores(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae, correlation, bias and count of ``prediction`` against ``actual`` in each group."""
    error = F.col("prediction") - F.col("actual")
    return forecasts.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        correlation(F.col("prediction"), F.col("actual")).alias("correlation"),
        F.avg(error).alias("bias"),
        F.count("*").alias("n"),
    )


def by_model(forecasts: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A row for each model's prediction."""
    models = models or MODELS
    keys = [c for c in forecasts.columns if c not in MODELS]
    return forecasts.unpivot(keys, models, "model", "prediction")
