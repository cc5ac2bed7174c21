import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerisk.operators import calibrate as cal
from pagerisk.operators import cascade as ca
from pagerisk.operators import fusion as fu
from pagerisk.operators import metrics as m


@pytest.fixture(scope="module")
def heads(spark):
    rng = np.random.default_rng(11)
    n = 800
    y = (rng.random(n) < 0.35).astype(int)
    a = np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1).round(3)
    b = np.clip(0.2 * y + 0.8 * rng.random(n), 0, 1).round(2)
    c = rng.random(n).round(3)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(n)], "id INT, label INT, a DOUBLE, b DOUBLE, c DOUBLE")
    return y, np.column_stack([a, b, c]), df


def newton(x, y, residual, steps=200, ridge=1e-6):
    xb = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(xb.shape[1])
    for _ in range(steps):
        p = np.clip(1 / (1 + np.exp(-xb @ w)), 1e-8, 1 - 1e-8)
        h = xb.T @ (xb * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, xb.T @ residual(p, y))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def test_logistic_losses_equal_numpy(heads):
    y, x, df = heads
    want = {
        "logistic": newton(x, y, lambda p, t: p - t),
        "weighted": newton(x, y, lambda p, t: (p - t) * (2.0 * t + 0.5 * (1 - t))),
    }
    got = fu.fit_losses(df, ["a", "b", "c"], tuple(want), weights=(0.5, 2.0))
    for loss in want:
        assert got[loss] == pytest.approx(list(want[loss]), rel=1e-5, abs=1e-5)


def test_slow_losses_follow_numpy_step_by_step(heads):
    y, x, df = heads
    want = {
        "focal": newton(x, y, lambda p, t: (p - t) * ((1 - p) ** 2 * t + p**2 * (1 - t)), 8),
        "squared": newton(x, y, lambda p, t: (p - t) * p * (1 - p) * 2, 8),
    }
    got = fu.fit_losses(df, ["a", "b", "c"], tuple(want), max_iter=8)
    for loss in want:
        assert got[loss] == pytest.approx(list(want[loss]), rel=1e-6, abs=1e-6)


def test_wide_sums_equal_narrow_sums(heads, monkeypatch):
    _, _, df = heads
    monkeypatch.setattr(fu, "MAX_SQL_SUMS", 1000)
    narrow = fu.fit_losses(df, ["a", "b", "c"], max_iter=4)
    monkeypatch.setattr(fu, "MAX_SQL_SUMS", 0)
    wide = fu.fit_losses(df, ["a", "b", "c"], max_iter=4)
    for loss in fu.LOSSES:
        assert wide[loss] == pytest.approx(narrow[loss], rel=1e-9, abs=1e-9)


def long(df):
    return df.select("id", "label", F.inline(F.array(*[F.struct(F.lit(h).alias("model"), F.col(h).alias("prob")) for h in "abc"])))


def test_temperature_never_raises_the_loss(heads):
    _, _, df = heads
    rows = long(df)
    fits = cal.fit_temperature(rows)
    assert set(fits) == set("abc")
    before = {r.model: r.log_loss for r in m.point_metrics(rows, ["model"]).collect()}
    after = {r.model: r.log_loss for r in m.point_metrics(cal.apply_temperature(rows, fits), ["model"]).collect()}
    assert all(after[k] <= before[k] + 1e-9 for k in before)


def pav(x, y, n):
    blocks = []
    for i in np.argsort(x):
        blocks.append([y[i] * n[i], n[i], 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([[s / w] * k for s, w, k in blocks])


def test_isotonic_equals_pool_adjacent_violators(heads):
    y, x, df = heads
    rows = long(df).filter("model = 'b'")
    fits = cal.fit_isotonic(rows)
    xs = np.unique(x[:, 1])
    rate = np.array([y[x[:, 1] == v].mean() for v in xs])
    size = np.array([(x[:, 1] == v).sum() for v in xs])
    want = dict(zip(xs, pav(xs, rate, size)))
    for r in cal.apply_isotonic(rows.withColumn("raw", F.col("prob")), fits).collect():
        assert r.prob == pytest.approx(want[r.raw])


@pytest.mark.parametrize("rows", [400, 10_000])
def test_isotonic_on_continuous_scores_in_many_ranges(spark, rows):
    """No two scores are equal, so blocks are long and cross the ranges; one key owns most rows, one falls all the way."""
    rng = np.random.default_rng(8)
    x = rng.random(3000)
    y = (rng.random(3000) < x * x).astype(int)
    down = [("down", float(v), int(v < 0.5)) for v in np.linspace(0.01, 0.99, 400)]
    data = [("hot", float(a), int(b)) for a, b in zip(x, y)] + down + [("one", 0.3, 1)]
    df = spark.createDataFrame(data, "model STRING, prob DOUBLE, label INT").repartition(6)
    blocks = cal.fit_isotonic(df, pool_rows=rows)
    order = np.argsort(x)
    want = dict(zip(x[order], pav(x, y, np.ones(3000))))
    got = cal.apply_isotonic(df.withColumn("raw", F.col("prob")), blocks)
    for r in got.filter("model = 'hot'").collect():
        assert r.prob == pytest.approx(want[r.raw])
    assert {round(r.prob, 9) for r in got.filter("model = 'down'").collect()} == {0.5} and got.filter("model = 'one' AND prob = 1").count() == 1
    outside = spark.createDataFrame([("hot", -1.0), ("hot", 2.0), ("down", 0.0), ("none", 0.4)], "model STRING, prob DOUBLE")
    values = [r.prob for r in cal.apply_isotonic(outside.withColumn("raw", F.col("prob")), blocks).orderBy("model", "raw").collect()]
    assert values == pytest.approx([0.5, want[x.min()], want[x.max()], 0.4])


def test_calibrator_choice_is_the_least_brier(heads):
    _, _, df = heads
    table, platt, iso = cal.choose_calibrators(long(df))
    rows = table.collect()
    for r in rows:
        assert r.chosen == min((x for x in rows if x.model == r.model), key=lambda x: (x.brier, -x.pr_auc)).calibrator
    chosen = {r.model: r.chosen for r in rows}
    out = m.point_metrics(cal.calibrate(long(df), chosen, platt, iso), ["model"]).collect()
    for r in out:
        assert r.brier == pytest.approx(min(x.brier for x in rows if x.model == r.model))


def test_out_of_fold_scores_every_row_once(heads):
    _, _, df = heads
    scored, coef = fu.out_of_fold(df, ["a", "b"], 4)
    rows = scored.collect()
    assert len(rows) == 800 and all(0 < r.prob < 1 for r in rows) and {r.fold for r in rows} == {0, 1, 2, 3}
    assert len(coef) == 3


def test_held_out_fits_equal_fits_on_the_other_rows(heads):
    _, _, df = heads
    rows = df.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3)).cast("string"))
    fits = fu.fit_by(rows, "fold", ["a", "b"], held_out=True)["logistic"]
    assert set(fits) == {"0", "1", "2"}
    for fold, coef in fits.items():
        assert coef == pytest.approx(fu.fit_logistic(rows.filter(F.col("fold") != fold), ["a", "b"]), abs=1e-4)


@pytest.mark.parametrize("top", [1, 4])
def test_search_by_bounds_finds_the_best_of_the_full_search(heads, top, monkeypatch):
    _, _, df = heads
    monkeypatch.setattr(fu, "GRID_CELLS", 64)
    grid = fu.simplex(2, 21)
    extra = {"l2": 0.02, "prefer": ["a"], "bonus": 0.01}
    full = [r.candidate for r in fu.best_weights(fu.weight_search(df, ["a", "b"], grid, **extra), top).collect()]
    some = fu.weight_search(df, ["a", "b"], grid, top=top, **extra)
    assert [r.candidate for r in fu.best_weights(some, top).collect()] == full and some.count() < 21
    bounds = {r.place: r for r in fu.grid_bounds(fu.grid_counts(df, ["a", "b"], grid, 64)).collect()}
    for r in fu.weight_search(df, ["a", "b"], grid).collect():
        assert bounds[r.candidate].low - 1e-9 <= r.pr_auc <= bounds[r.candidate].high + 1e-9


def test_simplex_and_caps(heads):
    assert len(fu.simplex(3, 5)) == 15 and all(abs(sum(w) - 1) < 1e-9 for w in fu.simplex(4, 4))
    _, _, df = heads
    found = fu.weight_search(df, ["a", "b", "c"], fu.simplex(3, 3), caps={"a": 0.5})
    assert found.count() == sum(w[0] <= 0.5 for w in fu.simplex(3, 3))
    with pytest.raises(ValueError):
        fu.weight_search(df, ["a"], [(1.0,)], caps={"a": 0.1})


def test_fusions_and_refiner(heads):
    _, _, df = heads
    model = fu.logistic_fusion(df, ["a", "b", "c"])
    auc = lambda d: m.ranking_metrics(d.withColumns({"model": F.lit("m"), "split": F.lit("s")})).first().roc_auc
    assert auc(fu.fused_by(model, df, ["a", "b", "c"])) > auc(df.withColumn("prob", F.col("c")))
    assert fu.logistic_fusion(df.filter("label = 0"), ["a"]) is None
    assert sum(fu.positive_shares(model, ["a", "b", "c"]).values()) == pytest.approx(1.0)
    wide = fu.average(df, ["a", "b", "c"]).withColumnRenamed("prob", "fused")
    assert fu.refine_band(wide, ["a", "b", "c"], "fused", 0.5, 0.2).count() > 0
    assert fu.refine_band(wide, ["a", "b", "c"], "fused", 0.5, 0.0).count() == 0


def test_cascade_thresholds(spark):
    rows = [(1, .95), (1, .9), (1, .8), (0, .6), (1, .5), (0, .2), (0, .1), (0, .05)]
    df = spark.createDataFrame(rows, "label INT, prob DOUBLE")
    lo, hi = ca.cascade_thresholds(df, precision=0.99, benign_precision=0.99, mode="max_coverage")
    assert (lo, hi) == (pytest.approx(0.2), 0.8) and lo < hi
    crossing = spark.createDataFrame([(1, .2), (1, .3), (0, .7), (0, .8)], "label INT, prob DOUBLE")
    lo, hi = ca.cascade_thresholds(crossing, precision=0.4, benign_precision=0.4, mode="max_coverage")
    assert 0 <= lo < hi <= 1 and hi - lo == pytest.approx(2e-6)
    assert ca.cascade_thresholds(df.filter("label = 0")) == (0.0, 1.0)


def test_band_search_equals_brute_force(heads):
    y, x, df = heads
    stages = {"a": [0.1, 0.4, 0.8], "b": [0.2, 0.6]}
    got = {(r.t1, r.t2): r for r in ca.band_search(df, stages, "c", 0.5, 1.0, [10.0, 50.0]).collect()}
    for t1 in stages["a"]:
        for t2 in stages["b"]:
            s1 = x[:, 0] >= t1
            s2 = s1 & (x[:, 1] >= t2)
            hit = s2 & (x[:, 2] >= 0.5)
            r = got[(t1, t2)]
            assert r.recall == pytest.approx((hit & (y == 1)).sum() / y.sum())
            assert (r.pass1, r.pass2) == pytest.approx((s1.mean(), s2.mean()))
            assert r.expected_cost == pytest.approx(1 + 10 * s1.mean() + 50 * s2.mean())
