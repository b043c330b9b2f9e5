import math

import pytest

from tidemark.functions.scalars import SENTINEL
from tidemark.operators import metrics
from tidemark.schemas import CELL
from tidemark.sources.panels import from_wide
from tidemark.validate import ValidationError

TRUTH = {0: [1, 2, 2, 4], 1: [4, 1, None, 3], 2: [2, 4, 1, 3]}
PREDICTION = {0: [2, 1, 1, 4], 1: [4, 3, 2, 1], 2: [1, 3, 4, 2]}


def frame(spark, matrix):
    rows = [(d, f"c{i}", i, None if v is None else float(v)) for d, line in matrix.items() for i, v in enumerate(line)]
    return spark.createDataFrame(rows, CELL)


def ranks(values):
    return [1 + sum(w < v for w in values) + (sum(w == v for w in values) - 1) / 2 for v in values]


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True))
    return cov / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def test_daily_correlation_masks_first_and_ranks_second(spark):
    got = {r.date_id: r.rho for r in metrics.daily_rank_correlation(metrics.checked_cells(frame(spark, TRUTH), frame(spark, PREDICTION))).collect()}
    for d in TRUTH:
        seen = [(t, p) for t, p in zip(TRUTH[d], PREDICTION[d], strict=True) if t is not None]
        assert got[d] == pytest.approx(pearson(ranks([t for t, _ in seen]), ranks([p for _, p in seen])), abs=1e-12)
    score = metrics.correlation_ratio(metrics.daily_rank_correlation(metrics.cells(frame(spark, TRUTH), frame(spark, PREDICTION)))).first()
    mean = sum(got.values()) / 3
    assert score.score == pytest.approx(mean / math.sqrt(sum((v - mean) ** 2 for v in got.values()) / 3))


def test_sentinel_is_missing_for_ranks_and_a_number_for_errors(spark):
    truth = {d: [SENTINEL if v is None else v for v in line] for d, line in TRUTH.items()}
    with_null, with_sentinel = metrics.cells(frame(spark, TRUTH), frame(spark, PREDICTION)), metrics.cells(frame(spark, truth), frame(spark, PREDICTION))
    rho = lambda c: sorted(map(tuple, metrics.daily_rank_correlation(c).collect()))
    assert rho(with_null) == rho(with_sentinel)
    assert metrics.evaluate(with_null).first().mae < 10 < metrics.evaluate(with_sentinel).first().mae


@pytest.mark.parametrize("fault", ["row", "column", "infinite", "few", "constant"])
def test_faults_fail(spark, fault):
    truth, prediction = {0: [1, 2, 3], 1: [3, 1, 2]}, {0: [1, 2, 3], 1: [3, 1, 2]}
    t, p = frame(spark, truth), frame(spark, prediction)
    if fault == "row":
        p = frame(spark, {0: [1, 2, 3], 5: [3, 1, 2]})
    elif fault == "column":
        p = p.withColumn("target_pos", (2 - p.target_pos).cast("int"))
    elif fault == "infinite":
        p = frame(spark, {0: [1, 2, math.inf], 1: [3, 1, 2]})
    elif fault == "few":
        t = frame(spark, {0: [1, None, None], 1: [3, 1, 2]})
    else:
        p = frame(spark, {0: [1, 1, 1], 1: [3, 1, 2]})
    with pytest.raises(ValidationError):
        metrics.require_scorable(metrics.checked_cells(t, p))


def test_prediction_must_be_finite_where_truth_is_missing(spark):
    t, p = frame(spark, {0: [1, 2, None]}), frame(spark, {0: [1, 2, math.nan]})
    with pytest.raises(ValidationError):
        metrics.checked_cells(t, p)


def test_horizons_filter_and_count_thin_dates(spark):
    t = frame(spark, {0: [1, 2, 3, 4], 1: [2, None, 4, 3], 2: [2, 1, 3, 4], 3: [1, 2, 4, 3]})
    p = frame(spark, {d: [1, 2, 3, 4] for d in range(4)})
    pairs = spark.createDataFrame([("c0", 1), ("c1", 1), ("c2", 10), ("c3", 10)], "target string, lag int")
    got = {r.lag: r for r in metrics.horizon_metrics(metrics.cells(t, p), pairs).collect()}
    assert (got[1].eligible_dates, got[1].excluded_dates) == (3, 1)
    assert (got[10].eligible_dates, got[10].excluded_dates) == (4, 0)


def test_wide_form(spark):
    wide = spark.createDataFrame([(0, 1.0, math.nan), (1, 3.0, 4.0)], "day int, b double, a double")
    got = {(r.date_id, r.target, r.target_pos): r.value for r in from_wide(wide, "day", ["b", "a"]).collect()}
    assert got == {(0, "b", 0): 1.0, (0, "a", 1): None, (1, "b", 0): 3.0, (1, "a", 1): 4.0}


def test_zero_covariance_is_zero(spark):
    """Ranks without any covariance, in many orders and partitions: rho is 0 exactly, so the share of positive dates is no chance."""
    rows = [(0, f"c{i}", i, float(t), float(p)) for i, (t, p) in enumerate(zip([2, 3, 1, 4, 5], [1, 4, 2, 5, 3], strict=True))]
    rows = [(d, *r[1:]) for d in range(40) for r in rows]
    flat = [(d, f"c{i}", i, float(t), float(p)) for d in range(40, 80) for i, (t, p) in enumerate(zip([1, 2, 3, 4], [2, 4, 1, 3], strict=True))]
    frame = spark.createDataFrame(rows + flat, "date_id int, target string, target_pos int, truth double, prediction double")
    for k in (1, 3, 7):
        daily = {r.date_id: r.rho for r in metrics.daily_rank_correlation(frame.repartition(k)).collect()}
        assert all(daily[d] == 0.0 for d in range(40, 80)) and all(daily[d] > 0 for d in range(40))
        assert metrics.evaluate(frame.repartition(k)).first().positive_fraction == 0.5


def test_checked_evaluation(spark):
    t = frame(spark, {d: [1 + d, 2, 3.5, 4] for d in range(4)})
    p = frame(spark, {d: [1, 3, 2 + d, 4] for d in range(4)})
    pairs = spark.createDataFrame([("c0", 10), ("c1", 10), ("c2", 1), ("c3", 1)], "target string, lag int")
    r = metrics.evaluated(t, p, pairs).first()
    assert [h.lag for h in r.horizons] == [1, 10] and r.dates == 4 and r.score == metrics.evaluate(metrics.cells(t, p)).first().score
    with pytest.raises(ValidationError):
        metrics.evaluated(t, frame(spark, {d: [1, 3, 2, 4] for d in range(3)}), pairs)
    with pytest.raises(ValidationError):
        metrics.evaluated(t, frame(spark, {d: [1, 1, 1, 1] for d in range(4)}), pairs)
