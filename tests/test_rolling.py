import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import availability, diagnostics, features, rolling
from tidemark.sources import synthetic
from tidemark.validate import ValidationError, panel_violations

CONFIG = rolling.RollingConfig()


@pytest.fixture(scope="module")
def obs(spark):
    return synthetic.observations(spark).cache()


@pytest.fixture(scope="module")
def forecasts(obs):
    return rolling.evaluated(obs, CONFIG, 240).cache()


def numpy_panel(seed=2026, days=240, shift=False):
    state, out = seed, np.zeros((6, days))
    for j in range(6):
        def draw():
            nonlocal state
            state = (1664525 * state + 1013904223) % 2**32
            return state / 2**32
        previous = (draw() - 0.5) * 0.5
        for t in range(days):
            previous = 0.78 * previous + 0.15 * np.sin(t / 8 + j * 0.47) + 0.08 * np.cos(t / 19 - j * 0.33) + (draw() + draw() + draw() - 1.5) * 0.22 + ((0.22 if j % 2 == 0 else -0.18) if shift and t >= 150 else 0)
            out[j, t] = previous
    return out


def numpy_ridge(values, t, c=CONFIG):
    def feature(j, s):
        return [values[j, s - 1], values[j, s - 5 : s].mean(), values[j, s - 20 : s].mean(), np.sin(s / 8), np.cos(s / 8), *(float(j == k) for k in range(1, 6))]

    rows = [(j, s) for s in range(max(20, t - c.window), t - c.horizon - c.delay + 1) for j in range(6)]
    x, y = np.array([feature(*r) for r in rows]), np.array([values[j, s : s + c.horizon].mean() for j, s in rows])
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z + c.alpha * np.eye(10), z.T @ (y - y.mean()))
    return [y.mean() + ((np.array(feature(j, t)) - mu) / sd) @ beta for j in range(6)], len(rows)


def test_generator(spark, obs):
    got = np.array([r.value for r in obs.orderBy("series_pos", "t").collect()]).reshape(6, 240)
    assert np.abs(got - numpy_panel()).max() < 1e-12
    shifted = np.array([r.value for r in synthetic.observations(spark, scenario="shift").orderBy("series_pos", "t").collect()]).reshape(6, 240)
    assert (shifted[:, :150] == got[:, :150]).all() and (shifted[:, 150:] != got[:, 150:]).all()
    assert synthetic.jump(721) == (589364301, 1538545199)


@pytest.mark.parametrize("bad", [{"days": 99}, {"days": 1001}, {"seed": -1}, {"scenario": "x"}, {"seed": True}])
def test_generator_settings(spark, bad):
    with pytest.raises(ValidationError):
        synthetic.observations(spark, **bad)


def test_panel_document(spark):
    doc = synthetic.panel(spark)
    assert panel_violations(doc).isEmpty()
    assert synthetic.exploded(doc).count() == 1440
    assert panel_violations(doc.withColumn("series", F.slice("series", 1, 5))).count() == 1
    broken = doc.withColumn("series", F.transform("series", lambda s: s.withField("values", F.transform(s["values"], lambda v, i: F.when(i == 3, float("nan")).otherwise(v)))))
    assert panel_violations(broken).count() == 1


def test_receipt_at_120(obs):
    r = rolling.fits(rolling.labels_of(obs, CONFIG), CONFIG).where("origin = 120").first()
    assert (r.first_origin, r.last_origin, r.max_release, r.rows, r.eligible_origins) == (40, 112, 120, 438, 73)


def test_ridge_equals_numpy(obs, forecasts):
    values = numpy_panel()
    for t in (80, 120, 219):
        want, _ = numpy_ridge(values, t)
        got = [r.ridge for r in forecasts.where(F.col("origin") == t).orderBy("series_id").collect()]
        assert np.abs(np.array(got) - want).max() < 1e-9


def test_default_workload(forecasts):
    assert forecasts.count() == 840 and forecasts.select("origin").distinct().count() == 140
    got = {r.model: r for r in rolling.scores(rolling.by_model(forecasts), ["model"]).collect()}
    assert got["ridge"].rmse == pytest.approx(0.19777290516645735, abs=1e-9)
    assert got["mean"].correlation == pytest.approx(-0.5015734179528952, abs=1e-9)
    assert got["zero"].correlation is None and got["zero"].mae == pytest.approx(0.4332538711511252, abs=1e-9)


def test_later_values_change_no_earlier_fit(obs, forecasts):
    changed = obs.withColumn("value", F.when(F.col("t") >= 150, F.col("value") + 5).otherwise(F.col("value")))
    a = {(r.series_id, r.origin): r.ridge for r in forecasts.where("origin <= 150").collect()}
    b = {(r.series_id, r.origin): r.ridge for r in rolling.forecasts(changed, CONFIG).where("origin <= 150").collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_constant_panel(obs):
    flat = obs.withColumn("value", F.lit(2.0))
    assert rolling.forecasts(flat, CONFIG).where("abs(ridge - 2) > 1e-12").isEmpty()


@pytest.mark.parametrize("bad", [{"horizon": 2}, {"delay": -1}, {"start": 90, "end": 80}, {"window": 50}, {"alpha": 0.001}, {"end": 239}])
def test_bad_configurations(bad):
    with pytest.raises(ValidationError):
        rolling.RollingConfig(**bad).checked(240)


def test_too_few_labels_fail_the_whole_run(obs):
    with pytest.raises(ValidationError, match="too few"):
        rolling.evaluated(obs, rolling.RollingConfig(window=40, horizon=20, delay=20), 240)


def test_release_guard_and_ledger(obs):
    labels = features.label_rows(obs, 5, 3).select(F.col("series_id").alias("instrument"), F.col("t").alias("observed_day"), "released_day", F.col("y").alias("value"))
    with pytest.raises(availability.UnreleasedLabelError):
        availability.read_label(labels, "A", 40, 47)
    availability.read_label(labels, "A", 40, 48)
    ledger = availability.ledger(features.with_targets(obs, 5).where("series_id = 'A'"), 120, 5, 3, 80)
    share = availability.eligible_share(ledger).first()
    assert (share.n_eligible, share.n_withheld, share.next_withheld) == (73, 7, 113)
    assert ledger.where("not eligible and label is not null").isEmpty()
    assert sorted(r.origin for r in availability.boundary(ledger).collect()) == [110, 111, 112, 113, 114, 115]


def test_score_of_two_rows(spark):
    rows = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 1.0)], "model string, actual double, prediction double")
    r = rolling.scores(rows, ["model"]).first()
    assert (r.rmse, r.mae, r.correlation) == (pytest.approx(2.5**0.5), 1.5, pytest.approx(-1.0))


def hand_rows(spark):
    rows = [("A", 1, 0.0, 0.0, 1.0, 0.0), ("B", 1, 0.0, 2.0, 1.0, 0.0), ("A", 2, 0.0, 4.0, 1.0, 0.0), ("B", 2, 0.0, 0.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, "series_id string, origin int, actual double, ridge double, mean double, zero double")


def test_slices_by_hand(spark):
    got = {(r.model, r.kind, r.slice): r for r in diagnostics.checked_slices(hand_rows(spark), rolling.MODELS).collect()}
    assert got["ridge", "series", "A"].rmse == pytest.approx(8**0.5) and got["ridge", "series", "A"].bias == 2
    assert got["ridge", "period", "earlier"].rmse == pytest.approx(2**0.5)
    assert got["ridge", "period", "later"].rmse == pytest.approx(8**0.5)
    one = {(r.kind, r.slice): r for r in diagnostics.checked_slices(hand_rows(spark).limit(1), ["ridge"]).collect()}
    assert one["period", "later"].n == 0 and one["period", "later"].rmse is None


def test_invalid_forecast_rows(spark):
    rows = hand_rows(spark)
    for bad in (rows.limit(0), rows.unionAll(rows.limit(1)), rows.withColumn("ridge", F.lit(float("nan"))), rows.withColumn("series_id", F.lit(""))):
        with pytest.raises(ValidationError):
            diagnostics.checked_slices(bad, rolling.MODELS)


def test_slices_reconcile(forecasts):
    gaps = diagnostics.reconciliation(diagnostics.slices(rolling.by_model(forecasts.drop("target_end", "released_day"))))
    assert gaps.where("rmse_gap > 1e-12 or bias_gap > 1e-12").isEmpty() and gaps.count() == 6


def test_singular_systems_fail():
    import numpy as np

    good = np.eye(3)[None] * 2
    assert rolling.solve(good, np.ones((1, 3))).tolist() == [[0.5, 0.5, 0.5]]
    for bad in (np.ones((1, 3, 3)), np.diag([1.0, 1.0, 1e-13])[None]):
        with pytest.raises(ValidationError):
            rolling.solve(bad, np.ones((1, 3)))
