"""DuckDB SQL of the evaluation engine's queries, written from the definitions rather than from the plans."""

from __future__ import annotations

import numpy as np

BRAND = """
brand AS (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate))::BIGINT AS date_id, p_brand AS target, split_part(p_brand, '#', 2)::INT AS target_pos,
  sum(l_extendedprice * (1 - l_discount)) AS value, count(*) AS n_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
"""


def _forecast(name: str, oldest: int, source: str = "brand", truth: str = "value") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT date_id, target, target_pos, n_items, {truth} AS truth, avg(value) OVER (PARTITION BY target ORDER BY date_id RANGE BETWEEN {oldest} PRECEDING AND 2 PRECEDING) AS prediction FROM {source}) WHERE prediction IS NOT NULL)"""


def _daily(name: str, cells: str, extra: str = "") -> str:
    """Daily correlations: doubled ranks among observed cells, then Pearson of these whole numbers from exact sums."""
    by = extra + "date_id"
    return f"""{name}_r AS (SELECT {by}, 2 * rank() OVER (PARTITION BY {by} ORDER BY truth) + count(*) OVER (PARTITION BY {by}, truth) - 1 AS a,
    2 * rank() OVER (PARTITION BY {by} ORDER BY prediction) + count(*) OVER (PARTITION BY {by}, prediction) - 1 AS b FROM {cells} WHERE truth <> -999999),
  {name}_s AS (SELECT {by}, count(*)::BIGINT AS n_observed, (count(*) * sum(a * a) - sum(a) * sum(a))::DOUBLE AS aa, (count(*) * sum(b * b) - sum(b) * sum(b))::DOUBLE AS bb, (count(*) * sum(a * b) - sum(a) * sum(b))::DOUBLE AS ab FROM {name}_r GROUP BY ALL),
  {name} AS (SELECT {by}, n_observed, CASE WHEN aa > 0 AND bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) END AS rho FROM {name}_s)"""


CELLS = f"{BRAND}, {_forecast('cells', 12)}"
SENTINEL = f"{BRAND}, {_forecast('cells', 12, truth='CASE WHEN n_items < 20 THEN -999999.0 ELSE value END')}"
WEEKS = """
sums AS (SELECT c_mktsegment AS series_id, floor(datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 7.0)::INT AS t, sum(o_totalprice) / 1e6 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
places AS (SELECT series_id, (row_number() OVER (ORDER BY series_id) - 1)::INT AS series_pos FROM (SELECT DISTINCT c_mktsegment AS series_id FROM customer)),
obs AS (SELECT series_id, series_pos, t::INT AS t, coalesce(value, 0.0) AS value
  FROM (SELECT series_id, series_pos, unnest(range(0, (SELECT max(floor(datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 7.0)::INT) FROM orders) + 1)) AS t FROM places) LEFT JOIN sums USING (series_id, t))"""
#: Origins from 80 on that have a whole target; horizon 5, delay 3, window 80.
ROLLING = """
feats AS (SELECT * FROM (SELECT series_id, series_pos, t, lag(value) OVER w AS f0, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f1,
  avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS f2, sin(t / 8.0) AS f3, cos(t / 8.0) AS f4,
  (series_pos = 1)::INT::DOUBLE AS f5, (series_pos = 2)::INT::DOUBLE AS f6, (series_pos = 3)::INT::DOUBLE AS f7, (series_pos = 4)::INT::DOUBLE AS f8, (series_pos = 5)::INT::DOUBLE AS f9 FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 20),
targets AS (SELECT * FROM (SELECT series_id, series_pos, t, avg(value) OVER w AS y, count(*) OVER w AS n FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5),
labels_ AS (SELECT feats.*, y, feats.t + 8 AS released_day FROM feats JOIN targets USING (series_id, t)),
origins AS (SELECT unnest(range(80, (SELECT least(max(t) - 3, 1000000) FROM obs)))::INT AS origin),
training AS (SELECT origin, l.* FROM origins JOIN labels_ l ON l.t BETWEEN greatest(20, origin - 80) AND origin - 8)
"""
SEGMENT = f"{WEEKS}, {ROLLING}"


def _ridge(alpha: float = 5.0, k: int = 10) -> str:
    """Ridge by the normal equations of standardised features, solved by a Cholesky factor whose columns are a CTE each."""
    at = range(k)
    cov = lambda i, j: f"n * g_{i}_{j} / (s{i} * s{j}){f' + {alpha}' if i == j else ''} AS a_{i}_{j}"
    ctes = [
        f"moments AS MATERIALIZED (SELECT origin, count(*) AS n, avg(y) AS intercept, {', '.join(f'avg(f{i}) AS m{i}, coalesce(nullif(stddev_pop(f{i}), 0), 1) AS s{i}, covar_pop(f{i}, y) AS c{i}' for i in at)}, {', '.join(f'covar_pop(f{i}, f{j}) AS g_{i}_{j}' for i in at for j in range(i + 1))} FROM training GROUP BY origin)",
        f"normal AS MATERIALIZED (SELECT origin, intercept, {', '.join(f'm{i}, s{i}, n * c{i} / s{i} AS r{i}' for i in at)}, {', '.join(cov(i, j) for i in at for j in range(i + 1))} FROM moments)",
    ]
    last = "normal"
    less = lambda terms: "".join(f" - {t}" for t in terms)
    for j in at:
        ctes.append(f"pivot{j} AS MATERIALIZED (SELECT *, sqrt(a_{j}_{j}{less(f'l_{j}_{h} * l_{j}_{h}' for h in range(j))}) AS l_{j}_{j} FROM {last})")
        below = [f"(a_{i}_{j}{less(f'l_{i}_{h} * l_{j}_{h}' for h in range(j))}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, k)]
        ctes.append(f"column{j} AS MATERIALIZED (SELECT {', '.join(['*', *below])} FROM pivot{j})")
        last = f"column{j}"
    for j in at:
        ctes.append(f"down{j} AS MATERIALIZED (SELECT *, (r{j}{less(f'l_{j}_{h} * z{h}' for h in range(j))}) / l_{j}_{j} AS z{j} FROM {last})")
        last = f"down{j}"
    for j in reversed(at):
        ctes.append(f"up{j} AS MATERIALIZED (SELECT *, (z{j}{less(f'l_{h}_{j} * b{h}' for h in range(j + 1, k))}) / l_{j}_{j} AS b{j} FROM {last})")
        last = f"up{j}"
    ridge = " + ".join(["intercept", *(f"b{i} * (f{i} - m{i}) / s{i}" for i in at)])
    ctes.append("means AS (SELECT origin, series_id, avg(y) AS mean FROM training GROUP BY ALL)")
    ctes.append(f"forecasts AS MATERIALIZED (SELECT l.series_id, l.t AS origin, l.y AS actual, {ridge} AS ridge, coalesce(mean, 0.0) AS mean, 0.0::DOUBLE AS zero, l.t + 4 AS target_end, l.t + 8 AS released_day FROM labels_ l JOIN {last} u ON u.origin = l.t LEFT JOIN means ON means.origin = l.t AND means.series_id = l.series_id)")
    ctes.append("models AS (SELECT origin, series_id, actual, unnest(['ridge', 'mean', 'zero']) AS model, unnest([ridge, mean, zero]) AS prediction FROM forecasts)")
    return ", ".join(ctes)


RIDGE = _ridge()
LEDGER = f"""{SEGMENT}, ledger AS (SELECT series_id, t AS origin, t + 4 AS target_end, t + 8 AS released_day, t + 8 <= 120 AS eligible, CASE WHEN t + 8 <= 120 THEN y END AS label,
  CASE WHEN t + 8 <= 120 THEN 'Available for training' ELSE 'Not released' END AS status FROM targets WHERE t BETWEEN 40 AND 119)"""
EVENTS = """
event_rows AS (SELECT event_type || '_' || (user_id % 8)::VARCHAR AS instrument, (datediff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS observed_day, user_id % 8 AS g, value FROM events),
labels_ AS (SELECT instrument, observed_day, (observed_day + 1 + (observed_day + g) % 5)::BIGINT AS released_day, avg(value) AS value FROM event_rows GROUP BY ALL)
"""
ERRORS = """sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse, avg(abs(prediction - actual)) AS mae,
  CASE WHEN var_pop(prediction) > 0 AND var_pop(actual) > 0 THEN covar_pop(prediction, actual) / (stddev_pop(prediction) * stddev_pop(actual)) END AS correlation,
  avg(prediction - actual) AS bias, count(*)::BIGINT AS n"""
SLICES = f"""{SEGMENT}, {RIDGE}, half AS (SELECT quantile_disc(origin, 0.5) AS midpoint FROM (SELECT DISTINCT origin FROM models)),
marked AS (SELECT *, CASE WHEN origin <= (SELECT midpoint FROM half) THEN 'earlier' ELSE 'later' END AS period FROM models),
slices AS (SELECT model, CASE WHEN grouping(series_id) = 0 THEN 'series' WHEN grouping(period) = 0 THEN 'period' ELSE 'pooled' END AS kind, coalesce(series_id, period, 'all') AS slice,
  {ERRORS}, min(origin) AS first_origin, max(origin) AS last_origin FROM marked GROUP BY GROUPING SETS ((model), (model, series_id), (model, period)))"""
VARIANTS = f"""{BRAND}, {_forecast('c_year', 12)}, {_forecast('c_half', 6)}, {_forecast('c_recent', 3)}, {_daily('d_year', 'c_year')}, {_daily('d_half', 'c_half')}, {_daily('d_recent', 'c_recent')},
daily AS (SELECT variant, (row_number() OVER (PARTITION BY variant ORDER BY date_id) - 1)::BIGINT AS pos, rho FROM (SELECT 'year' AS variant, * FROM d_year UNION ALL SELECT 'half', * FROM d_half UNION ALL SELECT 'recent', * FROM d_recent) WHERE date_id > 2)"""


def _positions(folds: list[int], blocks: list[int], repetitions: int = 500, seed: int = 42, single: bool = False) -> str:
    """Slots and positions of resamples whose starts are drawn here, as the definition has them: anew from the seed for each block size, fold by fold; a single population repetition by repetition."""
    rows = []
    for block in blocks:
        rng = np.random.default_rng(seed)
        for fold, n in enumerate(folds):
            if single:
                drawn = [rng.integers(0, n, size=-(-n // block)) for _ in range(repetitions)]
            else:
                drawn = rng.integers(0, n, size=(repetitions, -(-n // block)))
            rows.append(f"({block}, {fold}, {[[int(x) for x in line] for line in drawn]})")
    return f"""drawn(block, fold, reps) AS (VALUES {', '.join(rows)}), lengths(fold, length) AS (VALUES {', '.join(f'({f}, {n})' for f, n in enumerate(folds))}),
    folds AS (SELECT fold, length, (sum(length) OVER (ORDER BY fold) - length)::INT AS fold_offset FROM lengths),
    lines AS (SELECT block, fold, unnest(range(len(reps)))::INT AS rep, unnest(reps) AS line FROM drawn),
    starts AS (SELECT block, rep, fold, length, fold_offset, unnest(range(len(line)))::INT AS blk, unnest(line) AS start FROM lines JOIN folds USING (fold)),
    positions AS (SELECT block, rep, (fold_offset + blk * block + step)::BIGINT AS slot, (fold_offset + (start + step) % length)::BIGINT AS pos FROM starts, range(0, 100) s(step) WHERE step < block AND blk * block + step < length)"""


FOLDED = _positions([41, 40], [4, 10])
DRAWS = """draws AS (SELECT block, rep, variant, stddev_pop(rho) AS deviation, CASE WHEN stddev_pop(rho) > 0 THEN avg(rho) / stddev_pop(rho) END AS draw FROM positions JOIN daily USING (pos) GROUP BY ALL)"""
COMPARED = f"""{VARIANTS}, {FOLDED}, {DRAWS}, seen AS (SELECT variant, avg(rho) / stddev_pop(rho) AS observed FROM daily GROUP BY ALL),
pairs AS (SELECT * FROM (VALUES ('year', 'half'), ('year', 'recent')) v(variant, reference)),
diffs AS (SELECT p.variant, p.reference, a.block, a.rep, sa.observed AS candidate, sb.observed AS control, sa.observed - sb.observed AS delta, a.draw - b.draw AS d FROM pairs p JOIN draws a ON a.variant = p.variant JOIN draws b ON b.variant = p.reference AND b.block = a.block AND b.rep = a.rep
  JOIN seen sa ON sa.variant = p.variant JOIN seen sb ON sb.variant = p.reference),
crit AS (SELECT block, quantile_cont(e, 0.95) AS critical FROM (SELECT block, rep, max(abs(d - delta)) AS e FROM diffs GROUP BY ALL) GROUP BY ALL),
compared AS (SELECT variant, reference, block AS block_dates, any_value(candidate) AS candidate, any_value(control) AS control, delta, quantile_cont(d, 0.025) AS conditional_low, quantile_cont(d, 0.975) AS conditional_high, delta - any_value(critical) AS simultaneous_low, delta + any_value(critical) AS simultaneous_high FROM diffs JOIN crit USING (block) GROUP BY variant, reference, block, delta)"""
REFS = r"""refs AS (
  SELECT page_id, 'attribute' AS kind, unnest(regexp_extract_all(html, '(?i)\s(?:href|src)\s*=\s*["'']([^"'']*)["'']', 1)) AS reference FROM pages
  UNION ALL SELECT page_id, 'style', unnest(regexp_extract_all(html, '(?i)url\(\s*["'']?([^\s)"'']+)["'']?\s*\)', 1)) FROM pages
  UNION ALL SELECT page_id, 'import', unnest(regexp_extract_all(html, '\b(?:import|export)\s+(?:[^;\n]*?\s+from\s+)?["'']([^"'']+)["'']', 1)) FROM pages),
parts AS (SELECT *, regexp_extract(reference, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(reference, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host,
  regexp_extract(regexp_replace(reference, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?', ''), '^[^?#]*') AS path, regexp_extract(reference, '#(.*)$', 1) AS fragment FROM refs)"""


COMMANDS = "commands AS (SELECT n_nationkey::INT AS place, lower(replace(n_name, ' ', '-')) AS id, 'run/' || n_regionkey || '.py' AS entry FROM nation)"


def _synthetic(scenario: str) -> str:
    """The generated panel of 240 days: one stream of numbers over six series in turn."""
    noise, shift = {"steady": (0.22, "0"), "shift": (0.22, "CASE WHEN t >= 150 THEN CASE WHEN j % 2 = 0 THEN 0.22 ELSE -0.18 END ELSE 0 END"), "noisy": (0.7, "0")}[scenario]
    return f"""WITH RECURSIVE lcg(i, s) AS (SELECT 0::BIGINT, 2026::BIGINT UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM lcg WHERE i < 4326),
            u AS (SELECT i - 1 AS i, s / 4294967296.0::DOUBLE AS u FROM lcg WHERE i > 0),
            first AS (SELECT (i // 721)::INT AS j, (u - 0.5) * 0.5 AS v FROM u WHERE i % 721 = 0),
            noise AS (SELECT (i // 721)::INT AS j, ((i % 721 - 1) // 3)::INT AS t, (sum(u) - 1.5) * {noise} AS e FROM u WHERE i % 721 > 0 GROUP BY ALL),
            drive AS (SELECT j, t, 0.15 * sin(t / 8.0::DOUBLE + j * 0.47::DOUBLE) + 0.08 * cos(t / 19.0::DOUBLE - j * 0.33::DOUBLE) + e + {shift} AS x FROM noise),
            walk(j, t, v) AS (SELECT j, -1, v::DOUBLE FROM first UNION ALL SELECT walk.j, drive.t, (0.78 * walk.v + drive.x)::DOUBLE FROM walk JOIN drive ON drive.j = walk.j AND drive.t = walk.t + 1),
            obs AS MATERIALIZED (SELECT chr(65 + j) AS series_id, j AS series_pos, t, v AS value FROM walk WHERE t >= 0)"""


def _r(columns: dict[str, int] | list[str], digits: int = 6) -> str:
    names = columns if isinstance(columns, dict) else dict.fromkeys(columns, digits)
    return ", ".join(f"round({c} + 0.0, {d}) AS {c}" for c, d in names.items())


def oracle_sql() -> dict[str, str]:
    daily = _daily("daily", "cells")
    lagged = f"{CELLS}, late AS (SELECT *, (1 + target_pos % 4)::BIGINT AS lag FROM cells WHERE date_id + target_pos > 8), {_daily('by_lag', 'late', 'lag, ')}"
    features = ["f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8", "f9"]
    picked = ["f0", "f2", "f4", "f6"]
    sql = {
        "daily_rank_corr": f"WITH {CELLS}, {daily} SELECT date_id, n_observed, round(rho, 6) AS rho FROM daily",
        "label_valid_rows": f"WITH {EVENTS} SELECT instrument, observed_day, released_day, round(value, 6) AS value FROM labels_ WHERE trim(instrument) <> '' AND observed_day >= 1 AND released_day > observed_day AND isfinite(value)",
        "label_violation_rows": f"""WITH {EVENTS}, dirty AS (SELECT CASE WHEN observed_day % 7 = 1 THEN ' ' ELSE instrument END AS instrument, CASE WHEN observed_day % 7 = 2 THEN 0 ELSE observed_day END AS observed_day,
            CASE WHEN observed_day % 7 = 3 THEN observed_day ELSE released_day END AS released_day, CASE WHEN observed_day % 7 = 4 THEN NULL ELSE value END AS value FROM labels_)
            SELECT instrument, observed_day, released_day, round(value, 6) AS value, CASE WHEN trim(instrument) = '' THEN 'blank instrument' WHEN observed_day < 1 THEN 'observed day before 1' WHEN released_day <= observed_day THEN 'released before it could be known' ELSE 'value not finite' END AS reason
            FROM dirty WHERE trim(instrument) = '' OR observed_day < 1 OR released_day <= observed_day OR value IS NULL""",
        "label_duplicate_keys": f"WITH {EVENTS} SELECT instrument, observed_day, count(*)::BIGINT AS copies FROM event_rows GROUP BY ALL HAVING count(*) > 1",
        "snapshot_available": f"WITH {EVENTS} SELECT instrument, observed_day, released_day, round(value, 6) AS value FROM labels_ WHERE released_day <= 15",
        "snapshot_counts_mean": f"WITH {EVENTS} SELECT count(*) FILTER (released_day <= 15) AS available, count(*) FILTER (released_day > 15) AS unreleased, round(round(avg(value) FILTER (released_day <= 15), 8), 6) AS mean_value FROM labels_",
        "snapshots_all_days": f"WITH {EVENTS}, days AS (SELECT unnest(range(1, 37))::BIGINT AS as_of) SELECT as_of, count(*) FILTER (released_day <= as_of) AS available, count(*) FILTER (released_day > as_of) AS unreleased, round(avg(value) FILTER (released_day <= as_of), 6) AS mean_value FROM days, labels_ GROUP BY as_of",
        "guarded_read": f"WITH {EVENTS} SELECT instrument, observed_day, round(value, 6) AS value FROM labels_ WHERE instrument = 'click_1' AND observed_day = 3",
        "eligibility_ledger": f"WITH {LEDGER} SELECT series_id, origin, target_end, released_day, eligible, round(label, 10) AS label, status FROM ledger",
        "boundary_topk": f"WITH {LEDGER}, p AS (SELECT *, row_number() OVER (PARTITION BY series_id, eligible ORDER BY CASE WHEN eligible THEN -origin ELSE origin END) AS place FROM ledger) SELECT series_id, origin, eligible, round(label, 10) AS label, place FROM p WHERE place <= 3",
        "eligible_ratio": f"WITH {LEDGER} SELECT series_id, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_withheld, round(count(*) FILTER (eligible) / count(*)::DOUBLE, 6) AS share, max(origin) FILTER (eligible) + 1 AS next_withheld FROM ledger GROUP BY series_id",
        "sentinel_nullif": f"WITH {SENTINEL} SELECT date_id, count(*) AS n_cells, count(nullif(truth, -999999)) AS n_observed FROM cells GROUP BY date_id",
        "sentinel_rank_corr": f"WITH {SENTINEL}, {daily} SELECT date_id, n_observed, round(rho, 6) AS rho FROM daily",
        "sentinel_errors": f"WITH {SENTINEL} SELECT round(avg(abs(prediction - truth)), 2) AS mae, round(sqrt(avg((prediction - truth) * (prediction - truth))), 2) AS rmse FROM cells",
        "alignment_check": f"WITH {BRAND} SELECT date_id, target, target_pos, 'prediction' AS missing_from FROM brand WHERE date_id + target_pos = 30",
        "average_rank": f"WITH {BRAND} SELECT date_id, target, n_items, rank() OVER (PARTITION BY date_id ORDER BY n_items) + (count(*) OVER (PARTITION BY date_id, n_items) - 1) / 2 AS avg_rank FROM brand",
        "corr_ratio_score": f"WITH {CELLS}, {daily} SELECT count(rho) AS dates, round(avg(rho) / stddev_pop(rho), 6) AS score FROM daily",
        "evaluate_summary": f"""WITH {CELLS}, {daily}, e AS (SELECT avg(abs(prediction - truth)) AS mae, sqrt(avg((prediction - truth) * (prediction - truth))) AS rmse FROM cells)
            SELECT round(avg(rho) / stddev_pop(rho), 6) AS score, round(avg(rho), 6) AS mean_correlation, round(stddev_pop(rho), 6) AS correlation_deviation, round(avg((rho > 0)::INT), 6) AS positive_fraction, count(*) AS dates,
            min(date_id) AS first_date, max(date_id) AS last_date, round(arg_min(rho, date_id), 6) AS first_rho, (SELECT round(mae, 2) FROM e) AS mae, (SELECT round(rmse, 2) FROM e) AS rmse FROM daily""",
        "checked_evaluation": f"""WITH {CELLS}, {daily}, lagged AS (SELECT *, (1 + target_pos % 4)::BIGINT AS lag FROM cells), {_daily('by_lag', 'lagged', 'lag, ')}, n AS (SELECT lag, date_id, count(*) AS n FROM lagged GROUP BY ALL),
            h AS (SELECT n.lag, avg(rho) FILTER (n.n >= 2) / stddev_pop(rho) FILTER (n.n >= 2) AS lag_score, avg(rho) FILTER (n.n >= 2) AS lag_mean, count(*) FILTER (n.n >= 2) AS eligible_dates FROM n LEFT JOIN by_lag USING (lag, date_id) GROUP BY n.lag)
            SELECT round(score, 6) AS score, round(positive_fraction, 6) AS positive_fraction, dates, (row_number() OVER (ORDER BY lag) - 1)::INT AS place, lag, round(lag_score, 6) AS lag_score, round(lag_mean, 6) AS lag_mean, eligible_dates
            FROM h, (SELECT avg(rho) / stddev_pop(rho) AS score, avg((rho > 0)::INT) AS positive_fraction, count(*) AS dates FROM daily)""",
        "horizon_metrics": f"""WITH {lagged}, n AS (SELECT lag, date_id, count(*) AS n FROM late GROUP BY ALL), s AS (SELECT lag, avg(rho) / stddev_pop(rho) AS score, avg(rho) AS m FROM by_lag JOIN n USING (lag, date_id) WHERE n.n >= 2 GROUP BY lag)
            SELECT lag, round(any_value(score), 6) AS score, round(any_value(m), 6) AS mean_correlation, count(*) FILTER (n.n >= 2) AS eligible_dates, count(*) FILTER (n.n < 2) AS excluded_dates FROM n LEFT JOIN s USING (lag) GROUP BY lag""",
        "trailing_features": f"WITH {SEGMENT} SELECT series_id, series_pos, t, {_r(features, 10)} FROM feats",
        "forward_target": f"WITH {SEGMENT} SELECT series_id, series_pos, t, round(y, 10) AS y, t + 8 AS released_day FROM targets",
        "training_rows_range_join": f"WITH {SEGMENT} SELECT origin, series_id, count(*) AS n_rows, sum(t)::BIGINT AS sum_t, round(avg(y), 6) AS mean_y FROM training GROUP BY ALL",
        "fit_feature_stats": f"WITH {SEGMENT}, {RIDGE}, s AS (SELECT origin, intercept, unnest(range(10))::INT AS feature, unnest([{', '.join(f'm{i}' for i in range(10))}]) AS mean, unnest([{', '.join(f's{i}' for i in range(10))}]) AS scale, unnest([{', '.join(f'b{i}' for i in range(10))}]) AS coefficient FROM up0) SELECT origin, feature, {_r(['intercept', 'mean', 'scale', 'coefficient'])} FROM s",
        "fit_gram_moments": f"WITH {SEGMENT}, {RIDGE}, s AS (SELECT origin, unnest([{', '.join(f'{{i: {i}, j: {j}, v: {v}}}' for i, j, v in [*((i, j, f'a_{i}_{j}') for i in range(10) for j in range(i + 1)), *((i, -1, f'r{i}') for i in range(10))])}]) AS c FROM normal) SELECT origin, c.i::INT AS i, c.j::INT AS j, round(c.v + 0.0, 6) AS value FROM s",
        "fit_receipts": f"WITH {SEGMENT} SELECT origin, count(*) AS n_rows, min(t) AS first_origin, max(t) AS last_origin, max(released_day) AS max_release, count(DISTINCT t) AS eligible_origins, max(released_day) <= origin AS released_in_time FROM training GROUP BY origin",
        "baseline_mean_forecast": f"WITH {SEGMENT} SELECT origin, series_id, round(avg(y), 6) AS mean_forecast FROM training GROUP BY ALL",
        "ridge_single_feature": f"WITH {SEGMENT}, s AS (SELECT origin, count(*) AS n, coalesce(nullif(stddev_pop(f2), 0), 1) AS sd, covar_pop(f2, y) AS c, var_pop(f2) AS v, avg(y) AS m FROM training GROUP BY origin) SELECT origin, n AS n_rows, round(n * c / sd / (n * v / (sd * sd) + 5), 6) AS beta, round(m, 6) AS intercept FROM s",
        "ridge_forecast": f"WITH {SEGMENT}, {RIDGE} SELECT series_id, origin, {_r({'actual': 10, 'ridge': 6, 'mean': 6, 'zero': 6})}, target_end, released_day FROM forecasts",
        "model_scores": f"WITH {SEGMENT}, {RIDGE}, s AS (SELECT model, {ERRORS} FROM models GROUP BY model) SELECT model, {_r(['rmse', 'mae', 'correlation', 'bias'])}, n FROM s",
        "error_slices": f"WITH {SLICES} SELECT model, kind, slice, {_r(['rmse', 'mae', 'correlation', 'bias'])}, n, first_origin, last_origin FROM slices",
        "slice_reconciliation": f"""WITH {SLICES}, p AS (SELECT model, kind, sqrt(sum(n * rmse * rmse) / sum(n)) AS rmse_parts, sum(n * bias) / sum(n) AS bias_parts FROM slices WHERE kind <> 'pooled' GROUP BY ALL)
            SELECT p.model, p.kind, round(abs(rmse_parts - rmse) + 0.0, 6) AS rmse_gap, round(abs(bias_parts - bias) + 0.0, 6) AS bias_gap FROM p JOIN slices s ON s.model = p.model AND s.kind = 'pooled'""",
        "bootstrap_indices": f"WITH {FOLDED} SELECT block, rep, slot, pos FROM positions",
        "bootstrap_draws": f"WITH {VARIANTS}, {FOLDED}, {DRAWS} SELECT block, rep, variant, {_r(['deviation', 'draw'])} FROM draws",
        "paired_interval": f"WITH {VARIANTS}, {_positions([81], [20], single=True)}, {DRAWS}, p AS (SELECT rep, max(draw) FILTER (variant = 'year') - max(draw) FILTER (variant = 'recent') AS d FROM draws GROUP BY rep) SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM p",
        "compare_variants": f"WITH {COMPARED} SELECT variant, reference, block_dates, {_r(['delta', 'conditional_low', 'conditional_high', 'simultaneous_low', 'simultaneous_high'])} FROM compared",
        "evidence_checks": f"""WITH {COMPARED} SELECT reference, block_dates, "check", passed FROM (SELECT reference, block_dates, isfinite(delta) AND isfinite(conditional_low) AND isfinite(conditional_high) AS finite, abs(candidate - control - delta) <= 1e-12 AS delta_adds_up, conditional_low <= conditional_high AS bounds_ordered, conditional_low < 0 AND conditional_high > 0 AS straddles_zero FROM compared)
            UNPIVOT (passed FOR "check" IN (finite, delta_adds_up, bounds_ordered, straddles_zero))""",
        "synthetic_panel": f"{_synthetic('shift')} SELECT series_id, series_pos, t, round(value, 9) AS value FROM obs",
        "synthetic_forecast": f"{_synthetic('steady')}, {ROLLING}, {RIDGE} SELECT series_id, origin, {_r(['actual', 'ridge', 'mean', 'zero'])}, target_end, released_day FROM forecasts WHERE origin <= 219",
        "synthetic_scores": f"{_synthetic('steady')}, {ROLLING}, {RIDGE}, s AS (SELECT model, {ERRORS} FROM models WHERE origin <= 219 GROUP BY model) SELECT model, {_r(['rmse', 'mae', 'correlation', 'bias'])}, n FROM s",
        "outcome_histogram": "SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1",
        "membership_check": "SELECT o_orderpriority AS name, count(*) AS n, 'not allowed' AS reason FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1 UNION ALL SELECT name, 0, 'required' FROM (VALUES ('1-URGENT'), ('9-NEVER')) v(name) WHERE name NOT IN (SELECT o_orderpriority FROM orders)",
        "replay_diff": f"WITH {CELLS}, {daily} SELECT date_id, CASE WHEN date_id > 80 THEN 'missing' ELSE 'differs' END AS reason, CASE WHEN date_id <= 80 THEN 'rho' END AS field FROM daily WHERE date_id > 80 OR date_id % 10 = 0",
        "digest_tree_diff": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey = 7 THEN 'differs' ELSE 'missing' END AS reason, CASE WHEN l_orderkey = 7 THEN 'l_quantity' END AS field FROM lineitem WHERE l_orderkey IN (7, 33)
            UNION ALL SELECT -l_orderkey, l_linenumber, l_partkey, l_suppkey, 'unexpected', NULL FROM lineitem WHERE l_orderkey = 1""",
        "released_by_stream": f"WITH {EVENTS} SELECT CASE WHEN observed_day % 9 = 0 THEN 'late' ELSE 'released' END AS status, released_day, count(*) AS n, round(sum(value), 6) AS total FROM labels_ GROUP BY ALL",
        "row_fingerprint": "SELECT p_partkey, sha256(concat_ws('|', p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR)) AS sha256 FROM part",
        "text_pattern_scan": r"""WITH f AS (SELECT doc_id, regexp_matches(text, '(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') AS credential,
            regexp_matches(text, '(?i)s3://|arn:aws(?:-[a-z]+)?:|/(?:home|workspace|mnt)/') AS locator, regexp_matches(text, '\b(?:fetch|XMLHttpRequest|WebSocket|EventSource|importScripts)\s*\(|\bsendBeacon\s*\(|\bimport\s*\(') AS network,
            regexp_matches(text, '(?i)(?:password|secret|token|key)\s*[:=]\s*["''][^"'']{8,}["'']') AS assignment FROM documents) SELECT * FROM f WHERE credential OR locator OR network OR assignment""",
        "html_asset_refs": f"WITH {REFS} SELECT page_id, kind, reference, scheme, host, path, url_decode(path) AS decoded_path, fragment, scheme = '' AND host = '' AS local, count(*) AS n FROM parts GROUP BY ALL",
        # Not the engine's way: comments and the texts of scripts and styles are cut out, then pieces between the opening brackets are read.
        "html_attributes": r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
            s AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)(<script[^>]*>).*?</script', '\1</script', 'g'), '(?is)(<style[^>]*>).*?</style', '\1</style', 'g') AS h FROM c),
            p AS (SELECT page_id, unnest(string_split(h, '<')[2:]) AS piece FROM s),
            t AS (SELECT page_id, lower(regexp_extract(piece, '^([A-Za-z][^\s/>]*)', 1)) AS tag, regexp_extract(piece, '^[A-Za-z][^\s/>]*([^>]*)>', 1) AS held FROM p WHERE regexp_matches(piece, '^[A-Za-z]')),
            a AS (SELECT page_id, tag, unnest(regexp_extract_all(held, '[^\s/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"'']+))?')) AS pair FROM t),
            v AS (SELECT page_id, tag, lower(trim(split_part(pair, '=', 1))) AS attribute, CASE WHEN contains(pair, '=') THEN trim(substr(pair, instr(pair, '=') + 1)) END AS raw FROM a)
            SELECT page_id, tag, attribute, CASE WHEN left(raw, 1) IN ('"', chr(39)) THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS value, count(*) AS n FROM v GROUP BY ALL""",
        "quoted_urls": """SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted, url AS back, replace(replace(replace(replace(replace('<a title=' || chr(39) || url || chr(39) || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages WHERE url IS NOT NULL""",
        "review_coverage": f"""WITH {COMMANDS}, k AS (SELECT CASE WHEN place = 4 THEN 99 ELSE place END AS place, id, place % 7 = 6 AS other, place % 11 = 5 AS failed FROM commands WHERE place <> 3)
            SELECT place, coalesce(c.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'not run' WHEN c.id IS NULL THEN 'not configured' WHEN other THEN 'another call' WHEN failed THEN 'not passed' END AS reason FROM commands c FULL JOIN k USING (place) WHERE k.id IS NULL OR c.id IS NULL OR other OR failed""",
        "review_project": f"""WITH {COMMANDS}, p AS (SELECT place, CASE WHEN place % 9 = 2 THEN upper(id) WHEN place = 8 THEN 'kenya' ELSE id END AS id, CASE WHEN place % 10 = 7 THEN 'perl' ELSE 'python' END AS runtime, entry FROM commands),
            linked AS (SELECT DISTINCT 'command' AS part, entry AS name FROM p UNION SELECT DISTINCT 'card', unnest(['run/0.py', 'run/1.py', 'run/' || r_regionkey || '.py']) FROM region)
            SELECT 'command' AS part, id AS name, CASE WHEN NOT regexp_full_match(id, '[a-z][a-z0-9-]*') THEN 'unsafe id' ELSE 'unsupported runtime' END AS reason FROM p WHERE NOT regexp_full_match(id, '[a-z][a-z0-9-]*') OR runtime = 'perl'
            UNION ALL SELECT 'command', id, 'repeated' FROM p GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT 'card', r_name, 'unknown audience' FROM region WHERE r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA')
            UNION ALL SELECT part, name, 'no such file' FROM linked WHERE name NOT IN ('run/0.py', 'run/1.py', 'run/2.py')""",
        "label_stream_replay": f"WITH {EVENTS} SELECT released_day, count(*) AS n, round(sum(value), 6) AS total FROM labels_ GROUP BY released_day",
        "available_keys": f"WITH {EVENTS} SELECT (row_number() OVER (ORDER BY released_day, instrument, observed_day) - 1)::BIGINT AS place, instrument, observed_day FROM labels_ WHERE released_day <= 15",
        "guarded_targets": f"WITH {SEGMENT} SELECT series_id, t AS origin, t + 8 AS as_of, round(y, 10) AS target FROM targets WHERE t % 3 = 0",
        "export_lines": f"""{_synthetic('steady')}, {ROLLING}, {RIDGE}
            SELECT '0-head' AS part, '' AS series_id, 0 AS place, 'SYNTHETIC_ONLY' AS scope, 5.0::DOUBLE AS horizon, 3.0::DOUBLE AS delay, 'ridge' AS model, 120.0::DOUBLE AS forecast_origin, NULL::DOUBLE AS value, NULL::DOUBLE AS actual, NULL::DOUBLE AS ridge, NULL::DOUBLE AS mean, NULL::DOUBLE AS target_end, NULL::DOUBLE AS released_day
            UNION ALL SELECT '1-observation', series_id, t, NULL, NULL, NULL, NULL, NULL, round(value, 6), NULL, NULL, NULL, NULL, NULL FROM obs
            UNION ALL SELECT '2-forecast', series_id, origin, NULL, NULL, NULL, NULL, NULL, NULL, round(actual, 6), round(ridge, 6), round(mean, 6), target_end::DOUBLE, released_day::DOUBLE FROM forecasts WHERE origin <= 219""",
        "forecast_export": f"WITH {SEGMENT}, {RIDGE} SELECT row_number() OVER (ORDER BY origin, series_id) - 1 AS place, series_id, origin, {_r({'actual': 10, 'ridge': 6, 'mean': 6, 'zero': 6})}, target_end, released_day FROM forecasts",
        "prefix_compare": f"""WITH a AS MATERIALIZED (WITH {SEGMENT}, {RIDGE} SELECT * FROM forecasts), b AS MATERIALIZED (WITH {SEGMENT.replace('coalesce(value, 0.0) AS value', 'coalesce(value, 0.0) + CASE WHEN t >= 200 THEN 5.0 ELSE 0.0 END AS value')}, {RIDGE} SELECT * FROM forecasts)
            SELECT CASE WHEN origin <= 200 THEN 'before' ELSE 'after' END AS period, count(*) AS compared, {', '.join(f'count(*) FILTER (abs(a.{c} - b.{c}) > 1e-10 * (1 + abs(a.{c}))) AS {c}_differs' for c in ('actual', 'ridge', 'mean'))} FROM a JOIN b USING (series_id, origin) GROUP BY ALL""",
        "published_months": "WITH m AS (SELECT strftime(o_orderdate, '%Y/%m') || '.txt' AS path, count(*) || ' ' || sum(o_custkey) AS content FROM orders GROUP BY 1) SELECT path, strlen(content) AS length, sha256(content) AS sha256 FROM m",
        "order_elements": """WITH o AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
            SELECT key, CASE WHEN key % 50 = 3 THEN 0 ELSE 3 + 2 * n END AS n_elements, CASE WHEN key % 50 <> 3 THEN 3 END AS depth, (key % 50 = 3)::BIGINT AS n_errors, CASE WHEN key % 50 = 3 THEN 0 ELSE n END AS n_inside FROM o""",
        "release_check_count": f"WITH {SEGMENT}, r AS (SELECT origin, max(released_day) AS m FROM training GROUP BY origin) SELECT count(*) FILTER (m <= origin) AS in_time, count(*) AS fits FROM r",
        "origin_lookup": f"WITH {SEGMENT} SELECT origin, count(*) AS n_rows, min(t) AS first_origin, max(t) AS last_origin, max(released_day) AS max_release, count(DISTINCT t) AS eligible_origins FROM training WHERE origin = (SELECT max(origin) FROM origins) GROUP BY origin",
        "series_extent": f"WITH {SEGMENT} SELECT series_id, min(t) AS first_t, max(t) AS last_t, round(min(value), 10) AS low, round(max(value), 10) AS high FROM obs GROUP BY series_id",
        "fold_offsets": f"WITH {FOLDED}, s AS (SELECT DISTINCT block, rep, fold, length, fold_offset, blk FROM starts) SELECT block, fold, length, fold_offset, count(*) AS n_blocks FROM s GROUP BY ALL",
        "manifest_diff": """WITH e AS (SELECT p_partkey::VARCHAR AS path, sha256(coalesce(p_name, '')) AS e FROM part), a AS (SELECT p_partkey::VARCHAR AS path, sha256(CASE WHEN p_partkey = 5 THEN 'other' ELSE coalesce(p_name, '') END) AS a FROM part WHERE p_partkey <> 7 UNION ALL SELECT '-1', sha256('new'))
            SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' ELSE 'changed' END AS reason FROM e FULL JOIN a USING (path) WHERE e IS DISTINCT FROM a""",
        "long_date_ranks": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS quantity_rank, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS price_rank FROM lineitem",
        "long_date_corr": """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
            SELECT l_returnflag, count(*) AS n_observed, round(corr(a, b), 9) AS rho FROM r GROUP BY l_returnflag""",
        "long_series_labels": f"""WITH obs AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS t, l_quantity AS value FROM lineitem),
            w AS (SELECT t, lag(value) OVER (ORDER BY t) AS f0, avg(value) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f1, avg(value) OVER (ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS f2, sin(t / 8.0::DOUBLE) AS f3, cos(t / 8.0::DOUBLE) AS f4,
              avg(value) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS y, count(*) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM obs)
            SELECT 'all' AS series_id, 0 AS series_pos, t, {_r(['f0', 'f1', 'f2', 'f3', 'f4', 'y'], 10)}, t + 8 AS released_day FROM w WHERE t >= 20 AND n = 5""",
        "latest_labels": f"""WITH {EVENTS}, e AS (SELECT event_id, event_type || '_' || (user_id % 8)::VARCHAR AS instrument, (datediff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS as_of FROM events),
            m AS (SELECT event_id, max({{r: released_day, o: observed_day, v: l.value}}) AS b FROM e JOIN labels_ l ON l.instrument = e.instrument AND released_day <= as_of GROUP BY event_id)
            SELECT event_id, instrument, as_of, b.o AS observed_day, b.r AS released_day, round(b.v, 6) AS value FROM e LEFT JOIN m USING (event_id)""",
        "markup_totals": "SELECT count(*) AS n_files, sum(strlen(html))::BIGINT AS total_bytes, count(DISTINCT page_id) AS n_distinct FROM pages",
    }
    return sql
