"""Ranking and calibration metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import metrics as m
from pagerisk.plans.inputs import CURVE_CTE, PREDS_CTE, r6
from pagerisk.plans.registry import query

KEYS = ["model", "split"]
WITH_CURVE = "WITH " + CURVE_CTE
WITH_PREDS = "WITH " + PREDS_CTE
TEN_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in m.linspace(0.0, 1.0, 11)) + "]"


@query("e1_roc_auc", WITH_CURVE + """
SELECT model, split, round(sum(pos * ((tot_n - tot_pos - cum_n + cum_pos) + (n - pos) / 2e0)) / (max(tot_pos)::DOUBLE * max(tot_n - tot_pos)), 6) AS roc_auc
FROM c GROUP BY model, split""")
def _(t):
    return m.score_curve(t.preds()).groupBy(*KEYS).agg(r6(m.roc_auc_expr(), "roc_auc"))


PR_STEP = """lagged AS (SELECT *, lag(recall, 1, 0e0) OVER w AS r0, lag(precision, 1, 1e0) OVER w AS p0
  FROM rates WINDOW w AS (PARTITION BY model, split ORDER BY score DESC))"""


@query("e2_pr_auc_step", WITH_CURVE + ", " + PR_STEP + """
SELECT model, split, round(greatest(0e0, least(1e0, sum((recall - r0) * p0))), 6) AS pr_auc FROM lagged GROUP BY model, split""")
def _(t):
    return m.score_curve(t.preds()).groupBy(*KEYS).agg(r6(m.pr_auc_step_expr(), "pr_auc"))


@query("e3_average_precision", WITH_CURVE + ", " + PR_STEP + """
SELECT model, split, round(sum((recall - r0) * precision), 6) AS average_precision FROM lagged GROUP BY model, split""")
def _(t):
    return m.score_curve(t.preds()).groupBy(*KEYS).agg(r6(m.average_precision_expr(), "average_precision"))


@query("e4_fpr_at_tpr", WITH_CURVE + """
SELECT model, split, round(arg_max(fpr, score) FILTER (WHERE recall >= 95e-2), 6) AS fpr95, round(max(score) FILTER (WHERE recall >= 95e-2), 6) AS thr95,
 round(arg_max(fpr, score) FILTER (WHERE recall >= 9e-1), 6) AS fpr90, round(max(score) FILTER (WHERE recall >= 9e-1), 6) AS thr90
FROM rates GROUP BY model, split""")
def _(t):
    return m.score_curve(t.preds()).groupBy(*KEYS).agg(
        r6(m.fpr_at_tpr_expr(0.95), "fpr95"), r6(m.threshold_at_tpr_expr(0.95), "thr95"),
        r6(m.fpr_at_tpr_expr(0.9), "fpr90"), r6(m.threshold_at_tpr_expr(0.9), "thr90"),
    )


@query("e5_brier", WITH_PREDS + """
SELECT model, split, round(avg((prob - label) * (prob - label)), 6) AS brier FROM preds GROUP BY model, split""")
def _(t):
    return m.point_metrics(t.preds()).select(*KEYS, r6("brier", "brier"))


@query("e6_ece", WITH_PREDS + f""", b AS (SELECT model, split, label, prob, len(list_filter({TEN_EDGES}, lambda e: e <= prob)) - 1 AS bin FROM preds),
s AS (SELECT model, split, bin, count(*) AS n, avg(label) AS acc, avg(prob) AS conf FROM b GROUP BY model, split, bin)
SELECT model, split, round(sum(CASE WHEN bin BETWEEN 0 AND 9 THEN abs(acc - conf) * n ELSE 0e0 END) / sum(n), 6) AS ece FROM s GROUP BY model, split""")
def _(t):
    return m.ece(t.preds()).select(*KEYS, r6("ece", "ece"))


@query("e7_log_loss", WITH_PREDS + """, s AS (SELECT *, greatest(1e-12, least(1e0 - 1e-12, prob)) AS p FROM preds)
SELECT model, split, round(avg(-label * ln(p) - (1 - label) * ln(1e0 - p)), 6) AS log_loss FROM s GROUP BY model, split""")
def _(t):
    return m.point_metrics(t.preds()).select(*KEYS, r6("log_loss", "log_loss"))


@query("e8_operating_point", WITH_CURVE + """, k AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY precision DESC, score DESC) AS rn FROM rates WHERE recall >= 95e-2)
SELECT model, split, round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM k WHERE rn = 1""")
def _(t):
    return m.operating_point(m.score_curve(t.preds())).select(
        *KEYS, r6("threshold", "threshold"), r6("precision", "precision"), r6("recall", "recall"), r6("fpr", "fpr"))


@query("e9_recall_grid", WITH_CURVE + """, tg AS (SELECT unnest([90e-2, 92e-2, 94e-2, 95e-2, 96e-2, 97e-2, 98e-2]) AS target)
SELECT model, split, target, round(max(score), 6) AS threshold, round(arg_max(precision, score), 6) AS precision, round(arg_max(fpr, score), 6) AS fpr
FROM rates JOIN tg ON recall >= target GROUP BY model, split, target""")
def _(t):
    return m.recall_grid(m.score_curve(t.preds())).select(
        *KEYS, "target", r6("threshold", "threshold"), r6("precision", "precision"), r6("fpr", "fpr"))


@query("e10_precision_threshold", WITH_CURVE + """
SELECT model, split, round(coalesce(max(score) FILTER (WHERE precision >= 9e-1), 1e0), 6) AS first_thr,
 round(coalesce(min(score) FILTER (WHERE precision >= 9e-1), 1e0), 6) AS coverage_thr FROM rates GROUP BY model, split""")
def _(t):
    curve = m.score_curve(t.preds())
    first = m.precision_threshold(curve, target=0.9).withColumnRenamed("threshold", "first_thr")
    wide = m.precision_threshold(curve, target=0.9, mode="max_coverage").withColumnRenamed("threshold", "coverage_thr")
    return first.join(wide, KEYS).select(*KEYS, r6("first_thr", "first_thr"), r6("coverage_thr", "coverage_thr"))


COUNTS_AT_HALF = """k AS (SELECT model, split, count(*) FILTER (WHERE prob >= 5e-1 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 5e-1 AND label = 0) AS fp,
 count(*) FILTER (WHERE prob < 5e-1 AND label = 1) AS fn, count(*) FILTER (WHERE prob < 5e-1 AND label = 0) AS tn FROM preds GROUP BY model, split),
kr AS (SELECT *, tp::DOUBLE / greatest(1, tp + fp) AS p, tp::DOUBLE / greatest(1, tp + fn) AS r FROM k)"""


@query("e11_threshold_metrics", WITH_CURVE + ", " + COUNTS_AT_HALF + ", " + PR_STEP + """,
a AS (SELECT model, split, sum((recall - r0) * precision) AS ap, sum(pos * ((tot_n - tot_pos - cum_n + cum_pos) + (n - pos) / 2e0)) / (max(tot_pos)::DOUBLE * max(tot_n - tot_pos)) AS roc FROM lagged GROUP BY model, split),
l AS (SELECT model, split, avg(-label * ln(greatest(1e-12, least(1e0 - 1e-12, prob))) - (1 - label) * ln(1e0 - greatest(1e-12, least(1e0 - 1e-12, prob)))) AS ll FROM preds GROUP BY model, split)
SELECT kr.model, kr.split, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p + r > 0 THEN p * r * 2 / (p + r) ELSE 0 END, 6) AS f1, round(ll, 6) AS log_loss, round(roc, 6) AS roc_auc, round(ap, 6) AS average_precision
FROM kr JOIN a ON kr.model = a.model AND kr.split = a.split JOIN l ON kr.model = l.model AND kr.split = l.split""")
def _(t):
    preds = t.preds()
    ranks = m.score_curve(preds).groupBy(*KEYS).agg(
        r6(m.roc_auc_expr(), "roc_auc"), r6(m.average_precision_expr(), "average_precision"))
    loss = m.point_metrics(preds).select(*KEYS, r6("log_loss", "log_loss"))
    at = m.threshold_metrics(preds, 0.5).select(
        *KEYS, "tp", "fp", "fn", "tn", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1")])
    return at.join(ranks, KEYS).join(loss, KEYS)


@query("e12_confusion_matrix", WITH_PREDS + """, k AS (SELECT model, split, label, CASE WHEN prob >= 5e-1 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM preds GROUP BY ALL)
SELECT model, split, label, predicted, n, round(n / sum(n) OVER (PARTITION BY model, split, label), 6) AS share FROM k""")
def _(t):
    return m.confusion_shares(t.preds(), 0.5).select(*KEYS, "label", "predicted", "n", r6("share", "share"))


@query("e13_applied_operating_point", WITH_CURVE + """, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY precision DESC, score DESC) AS rn FROM rates WHERE recall >= 95e-2 AND split = 'val'),
j AS (SELECT p.model, score, count(*) FILTER (WHERE prob >= score AND label = 1) AS tp, count(*) FILTER (WHERE prob >= score AND label = 0) AS fp,
 count(*) FILTER (WHERE prob < score AND label = 1) AS fn, count(*) FILTER (WHERE prob < score AND label = 0) AS tn
 FROM preds p JOIN k ON p.model = k.model AND rn = 1 WHERE p.split = 'test' GROUP BY p.model, score)
SELECT model, round(score, 6) AS threshold, tp, fp, fn, tn, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS recall, round(fp::DOUBLE / greatest(1, fp + tn), 6) AS fpr FROM j""")
def _(t):
    preds = t.preds()
    op = m.operating_point(m.score_curve(preds.filter("split = 'val'"), ["model"]), ["model"]).select("model", "threshold")
    test = preds.filter("split = 'test'").join(op, "model")
    return m.threshold_metrics(test, F.col("threshold"), ["model", "threshold"]).select(
        "model", r6("threshold", "threshold"), "tp", "fp", "fn", "tn", *[r6(c, c) for c in ("precision", "recall", "fpr")])


METRIC_TABLE = PR_STEP + """,
mt AS (SELECT model, split, max(tot_n)::BIGINT AS n, max(tot_pos)::BIGINT AS pos, max(tot_pos)::DOUBLE / max(tot_n) AS prevalence,
 sum(pos * ((tot_n - tot_pos - cum_n + cum_pos) + (n - pos) / 2e0)) / (max(tot_pos)::DOUBLE * max(tot_n - tot_pos)) AS roc_auc,
 greatest(0e0, least(1e0, sum((recall - r0) * p0))) AS pr_auc,
 arg_max(fpr, score) FILTER (WHERE recall >= 9e-1) AS fpr_at_tpr90, max(score) FILTER (WHERE recall >= 9e-1) AS thr_at_tpr90,
 arg_max(fpr, score) FILTER (WHERE recall >= 95e-2) AS fpr_at_tpr95, max(score) FILTER (WHERE recall >= 95e-2) AS thr_at_tpr95
 FROM lagged GROUP BY model, split)"""
RATE_COLUMNS = ["prevalence", "roc_auc", "pr_auc", "fpr_at_tpr90", "thr_at_tpr90", "fpr_at_tpr95", "thr_at_tpr95"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in RATE_COLUMNS)
AVERAGED = ", ".join(f"round(avg({c}), 6) AS {c}" for c in RATE_COLUMNS)


@query("e14_metric_table", WITH_CURVE + ", " + METRIC_TABLE + f"""
SELECT model, split, n, pos, {ROUNDED} FROM mt
UNION ALL SELECT '_macro_avg', split, sum(n)::BIGINT, sum(pos)::BIGINT, {AVERAGED} FROM mt GROUP BY split""")
def _(t):
    table = m.with_macro(m.ranking_metrics(t.preds()), RATE_COLUMNS)
    return table.select(*KEYS, "n", "pos", *[r6(c, c) for c in RATE_COLUMNS])


@query("e15_macro_average", WITH_CURVE + ", " + METRIC_TABLE + f"""
SELECT split, count(*) AS models, {AVERAGED} FROM mt WHERE model IN ('url', 'dom', 'js') GROUP BY split""")
def _(t):
    core = m.ranking_metrics(t.preds().filter(F.col("model").isin("url", "dom", "js")))
    return core.groupBy("split").agg(F.count(F.lit(1)).alias("models"), *[r6(F.avg(c), c) for c in RATE_COLUMNS])


@query("e16_pr_curve", WITH_CURVE + """
SELECT model, split, round(score, 6) AS score, round(recall, 6) AS recall, round(precision, 6) AS precision FROM rates""")
def _(t):
    return m.with_rates(m.score_curve(t.preds())).select(*KEYS, r6("score", "score"), r6("recall", "recall"), r6("precision", "precision"))


@query("e17_roc_curve", WITH_CURVE + """
SELECT model, split, round(score, 6) AS score, round(fpr, 6) AS fpr, round(recall, 6) AS tpr FROM rates""")
def _(t):
    return m.with_rates(m.score_curve(t.preds())).select(*KEYS, r6("score", "score"), r6("fpr", "fpr"), r6("recall", "tpr"))


@query("e18_reliability", WITH_PREDS + f"""
SELECT model, split, least(9, len(list_filter({TEN_EDGES}, lambda e: e <= prob)) - 1)::INTEGER AS bin, count(*) AS n, round(avg(label), 6) AS frac_pos, round(avg(prob), 6) AS mean_pred
FROM preds GROUP BY ALL""")
def _(t):
    return m.reliability(t.preds()).select(*KEYS, "bin", "n", r6("frac_pos", "frac_pos"), r6("mean_pred", "mean_pred"))


EDGES_201 = "[" + ", ".join(f"{e!r}::DOUBLE" for e in m.linspace(0.0, 1.0, 201)) + "]"


@query("e19_accuracy_curve", WITH_PREDS + f""", g AS (SELECT model, split, prob, label, count(*) AS n FROM preds GROUP BY ALL), e AS (SELECT unnest({EDGES_201}) AS threshold)
SELECT model, split, round(threshold, 6) AS threshold, round(sum(CASE WHEN (prob >= threshold) = (label = 1) THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS accuracy
FROM g, e GROUP BY model, split, threshold""")
def _(t):
    return m.accuracy_curve(t.preds()).select(*KEYS, r6("threshold", "threshold"), r6("accuracy", "accuracy"))


@query("f1_average_rank", WITH_PREDS + """, w AS (SELECT model, split, prob, label, rank() OVER (PARTITION BY model, split ORDER BY prob) AS rk, count(*) OVER (PARTITION BY model, split, prob) AS cnt FROM preds)
SELECT DISTINCT model, split, round(prob, 6) AS score, round(rk + (cnt - 1) / 2e0, 6) AS avg_rank, cnt AS n FROM w""")
def _(t):
    return m.rank_sum_auc(t.preds()).select(*KEYS, r6("score", "score"), r6("avg_rank", "avg_rank"), "n")


@query("f2_running_counts", WITH_CURVE + """
SELECT model, split, round(score, 6) AS score, cum_pos::BIGINT AS tp, (cum_n - cum_pos)::BIGINT AS fp, round(recall, 6) AS recall, round(precision, 6) AS precision FROM rates""")
def _(t):
    return m.with_rates(m.score_curve(t.preds())).select(
        *KEYS, r6("score", "score"), F.col("cum_pos").alias("tp"), m.negatives_above().alias("fp"), r6("recall", "recall"), r6("precision", "precision"))


@query("f4_lagged_rates", WITH_CURVE + ", " + PR_STEP + """
SELECT model, split, round(score, 6) AS score, round(r0, 6) AS prev_recall, round(p0, 6) AS prev_precision FROM lagged""")
def _(t):
    earlier_n, earlier_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    return m.score_curve(t.preds()).select(
        *KEYS, r6("score", "score"), r6(earlier_pos / F.col("tot_pos"), "prev_recall"),
        r6(F.when(earlier_n == 0, F.lit(1.0)).otherwise(earlier_pos / F.when(earlier_n > 0, earlier_n)), "prev_precision"))
