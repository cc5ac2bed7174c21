import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerisk.operators import metrics as m


def frame(spark, labels, probs, key="m"):
    return spark.createDataFrame([(key, "s", int(y), float(p)) for y, p in zip(labels, probs)], "model STRING, split STRING, label INT, prob DOUBLE")


def one(df):
    return df.first().asDict()


def brute(y, p):
    """Straight definitions over distinct scores, walking down."""
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = y.sum(), (1 - y).sum()
    pairs = (p[y == 1][:, None] - p[y == 0][None, :])
    roc = ((pairs > 0).sum() + 0.5 * (pairs == 0).sum()) / (pos * neg)
    area, last_prec, last_rec, ap = 0.0, 1.0, 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        rec, prec = (y[hit] == 1).sum() / pos, (y[hit] == 1).mean()
        area += (rec - last_rec) * last_prec
        ap += (rec - last_rec) * prec
        last_prec, last_rec = prec, rec
    return roc, area, ap


@pytest.mark.parametrize("labels,probs,roc,pr", [
    ([0, 0, 1, 1], [.1, .2, .8, .9], 1.0, 1.0),
    ([0, 1, 0, 1], [.1, .9, .2, .8], 1.0, 1.0),
    ([1, 0, 1], [.5, .5, .4], 0.25, 0.75),
])
def test_hand_vectors(spark, labels, probs, roc, pr):
    r = one(m.ranking_metrics(frame(spark, labels, probs)))
    assert r["roc_auc"] == pytest.approx(roc) and r["pr_auc"] == pytest.approx(pr)


def test_against_brute_force_with_ties_and_extremes(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(300), rng.integers(0, 6, 300) / 5.0, rng.random(200) * 1e-9, 1 - rng.random(100) * 1e-9])
    y = (rng.random(p.size) < 0.2 + 0.5 * p).astype(int)
    curve = m.score_curve(frame(spark, y, p))
    r = one(curve.groupBy("model").agg(m.roc_auc_expr().alias("roc"), m.pr_auc_step_expr().alias("pr"), m.average_precision_expr().alias("ap")))
    assert (r["roc"], r["pr"], r["ap"]) == pytest.approx(brute(y, p))


def test_partition_count_does_not_matter(spark):
    rng = np.random.default_rng(5)
    p, y = rng.random(500), rng.integers(0, 2, 500)
    seen = set()
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        r = one(m.ranking_metrics(frame(spark, y, p).repartition(n)))
        seen.add(tuple(round(v, 12) if isinstance(v, float) else v for v in r.values()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_monotone_transform_keeps_rank_metrics(spark):
    rng = np.random.default_rng(9)
    p, y = rng.random(200), rng.integers(0, 2, 200)
    a, b = (one(m.ranking_metrics(frame(spark, y, v))) for v in (p, p**3))
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


def test_one_class_and_empty_are_null(spark):
    r = one(m.ranking_metrics(frame(spark, [0, 0], [.2, .3])))
    assert r["roc_auc"] is None and r["pr_auc"] is None and r["fpr_at_tpr95"] is None
    assert m.ranking_metrics(frame(spark, [], [])).count() == 0


def test_brier_ece_and_open_last_bin(spark):
    assert one(m.point_metrics(frame(spark, [0, 1, 1, 0], [.1, .9, .8, .2])))["brier"] == pytest.approx(0.025)
    assert one(m.ece(frame(spark, [0, 1], [0, 1]), bins=2))["ece"] == 0.0
    assert one(m.ece(frame(spark, [0, 0], [1.0, 1.0])))["ece"] == 0.0  # exactly 1 lies in no bin


def test_operating_point_and_precision_threshold(spark):
    curve = m.score_curve(frame(spark, [0, 0, 1, 1], [.1, .2, .8, .9]))
    assert one(m.operating_point(curve, target_recall=1.0))["threshold"] <= 0.8
    assert one(m.precision_threshold(curve, target=0.99))["threshold"] == 0.9
    assert one(m.precision_threshold(curve, target=0.99, mode="max_coverage"))["threshold"] == 0.8
    never = m.score_curve(frame(spark, [0, 0, 1], [.9, .8, .1]))
    assert one(m.precision_threshold(never, target=0.99))["threshold"] == 1.0


def test_score_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.random(2000), 10.0 ** -rng.random(500) * 1e-3, [0.0, 1.0, 5e-324, 1 - 2**-53]]))
    df = spark.createDataFrame([(float(v),) for v in values], "p DOUBLE").select("p", m.score_bucket("p").alias("b"))
    rows = sorted((r.p, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert df.filter(F.col("b").isNull()).count() == 0
