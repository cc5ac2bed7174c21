"""Calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import calibrate as cal
from pagerisk.operators import fusion as fu
from pagerisk.plans.inputs import PREDS_CTE, WIDE_CTE, r6
from pagerisk.plans.registry import query


def val(t):
    return t.preds().filter("split = 'val'")


LOGIT_VAL = """z AS (SELECT model, label, ln(q / (1e0 - q)) AS z FROM (SELECT model, label, greatest({eps}, least(1e0 - {eps}, prob)) AS q FROM preds WHERE split = 'val'))"""
PLATT_SQL = "WITH RECURSIVE " + PREDS_CTE + ", " + LOGIT_VAL.format(eps="1e-6") + """,
it AS (SELECT 0 AS i, model, 0e0 AS a, 0e0 AS b FROM (SELECT DISTINCT model FROM z) UNION ALL
 SELECT i + 1, model, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
  SELECT i, model, a, b, sum(z * (p - label)) AS g1, sum(p - label) AS g2, sum(z * z * p * (1 - p)) + 1e-6 AS h11, sum(z * p * (1 - p)) AS h12, sum(p * (1 - p)) + 1e-6 AS h22
  FROM (SELECT it.i, it.model, it.a, it.b, z.z, z.label, 1e0 / (1e0 + exp(-(it.a * z.z + it.b))) AS p FROM it JOIN z ON it.model = z.model WHERE it.i < 25) GROUP BY i, model, a, b))"""


def as_rows(t, fits, columns):
    """A handful of fitted constants per model, as rows beside the model names found in the data."""
    names = val(t).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    for i, c in enumerate(columns):
        names = names.withColumn(c, cal.per_model({k: v[i] for k, v in fits.items()}, F.col("model"), 0.0))
    return names


@query("j1_platt_scaling", PLATT_SQL + " SELECT model, (SELECT count(*) FROM z WHERE z.model = it.model) AS n, round(a, 4) AS slope, round(b, 4) AS intercept FROM it WHERE i = 25")
def _(t):
    return as_rows(t, cal.fit_platt(val(t)), ["slope", "intercept"]).withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


@query("j1_platt_apply", PLATT_SQL + """, w AS (SELECT model AS m, a, b FROM it WHERE i = 25), k AS (SELECT id, model, greatest(1e-6, least(1e0 - 1e-6, prob)) AS q FROM preds WHERE split = 'test')
SELECT id, model, round(1e0 / (1e0 + exp(-(a * ln(q / (1e0 - q)) + b))), 4) AS prob FROM k JOIN w ON model = m""")
def _(t):
    preds = t.preds()
    fits = cal.fit_platt(preds.filter("split = 'val'"))
    return cal.apply_platt(preds.filter("split = 'test'"), fits).select("id", "model", F.round("prob", 4).alias("prob"))


# Largest over earlier starts of the smallest over later ends of the block mean.
ISOTONIC_SQL = "WITH " + PREDS_CTE + """, s AS (SELECT model, prob AS x, count(*) AS n, sum(label)::BIGINT AS p, row_number() OVER (PARTITION BY model ORDER BY prob) AS k FROM preds WHERE split = 'val' GROUP BY model, prob),
cu AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM s WINDOW w AS (PARTITION BY model ORDER BY k)),
ab AS (SELECT a.model, a.k AS a, b.k AS b, (b.cp - a.cp + a.p)::DOUBLE / (b.cn - a.cn + a.n) AS avg FROM cu a JOIN cu b ON a.model = b.model AND a.k <= b.k),
mn AS (SELECT model, a, b AS i, min(avg) OVER (PARTITION BY model, a ORDER BY b DESC) AS v FROM ab), iso AS (SELECT model, i, max(v) AS v FROM mn GROUP BY model, i)"""


@query("j2_isotonic_calibration", ISOTONIC_SQL + " SELECT s.model, round(x, 6) AS score, round(v, 6) AS calibrated FROM s JOIN iso ON s.model = iso.model AND s.k = iso.i")
def _(t):
    rows = val(t)
    fits = cal.fit_isotonic(rows)
    points = rows.select("model", "prob").distinct().withColumn("score", F.col("prob"))
    return cal.apply_isotonic(points, fits).select("model", r6("score", "score"), r6("prob", "calibrated"))


TEMPERATURE_SQL = "WITH RECURSIVE " + PREDS_CTE + ", " + LOGIT_VAL.format(eps="1e-12") + """,
it AS (SELECT 0 AS i, model, 5e-2 AS lo, 2e1 AS hi FROM (SELECT DISTINCT model FROM z) UNION ALL
 SELECT i + 1, model, CASE WHEN s > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > 0 THEN hi ELSE (lo + hi) / 2 END FROM (
  SELECT it.i, it.model, lo, hi, sum((1e0 / (1e0 + exp(-z / ((lo + hi) / 2))) - label) * z) AS s FROM it JOIN z ON it.model = z.model WHERE it.i < 45 GROUP BY it.i, it.model, lo, hi))"""


@query("j3_temperature_scaling", TEMPERATURE_SQL + " SELECT model, (SELECT count(*) FROM z WHERE z.model = it.model) AS n, round((lo + hi) / 2, 4) AS temperature FROM it WHERE i = 45")
def _(t):
    fits = cal.fit_temperature(val(t))
    return as_rows(t, {k: (v,) for k, v in fits.items()}, ["temperature"]).withColumn("temperature", F.round("temperature", 4))


@query("j4_temperature_apply", TEMPERATURE_SQL + """, w AS (SELECT model AS m, (lo + hi) / 2 AS tt FROM it WHERE i = 45), k AS (SELECT id, model, greatest(1e-12, least(1e0 - 1e-12, prob)) AS q FROM preds WHERE split = 'test')
SELECT id, model, round(1e0 / (1e0 + exp(-ln(q / (1e0 - q)) / tt)), 4) AS prob FROM k JOIN w ON model = m""")
def _(t):
    preds = t.preds()
    fits = cal.fit_temperature(preds.filter("split = 'val'"))
    return cal.apply_temperature(preds.filter("split = 'test'"), fits).select("id", "model", F.round("prob", 4).alias("prob"))


# All three calibrators on the validation rows, and their metrics from counts per distinct score.
CHOICE_SQL = PLATT_SQL + ISOTONIC_SQL.replace("WITH " + PREDS_CTE, "", 1) + """, w AS (SELECT model, a, b FROM it WHERE i = 25),
base AS (SELECT p.model, p.label, p.prob, s.k, greatest(1e-6, least(1e0 - 1e-6, p.prob)) AS q FROM preds p JOIN s ON s.model = p.model AND s.x = p.prob WHERE p.split = 'val'),
tries AS (SELECT model, label, 'raw' AS calibrator, prob FROM base UNION ALL SELECT base.model, label, 'platt', 1e0 / (1e0 + exp(-(a * ln(q / (1e0 - q)) + b))) FROM base JOIN w ON w.model = base.model
  UNION ALL SELECT base.model, label, 'isotonic', iso.v FROM base JOIN iso ON iso.model = base.model AND iso.i = base.k),
tg AS (SELECT model, calibrator, prob AS score, count(*) AS n, sum(label)::BIGINT AS pos FROM tries GROUP BY ALL),
tc AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(n) OVER (PARTITION BY model, calibrator) AS tn, sum(pos) OVER (PARTITION BY model, calibrator) AS tp FROM tg WINDOW o AS (PARTITION BY model, calibrator ORDER BY score DESC)),
tl AS (SELECT *, lag(cp::DOUBLE / cn, 1, 1e0) OVER (PARTITION BY model, calibrator ORDER BY score DESC) AS p0 FROM tc),
ranks AS (SELECT model, calibrator, sum(pos * p0) / max(tp) AS pr_auc, sum(pos * ((tn - tp - cn + cp) + (n - pos) / 2e0)) / (max(tp)::DOUBLE * max(tn - tp)) AS roc_auc FROM tl GROUP BY ALL),
errors AS (SELECT model, calibrator, avg((prob - label) * (prob - label)) AS brier FROM tries GROUP BY ALL),
bins AS (SELECT model, calibrator, floor(prob * 10) AS bin, count(*) AS n, avg(prob) AS conf, avg(label) AS rate FROM tries WHERE prob < 1 GROUP BY ALL),
eces AS (SELECT b.model, b.calibrator, sum(b.n * abs(conf - rate)) / any_value(a.n) AS ece FROM bins b JOIN (SELECT model, calibrator, count(*) AS n FROM tries GROUP BY ALL) a USING (model, calibrator) GROUP BY b.model, b.calibrator),
choice AS (SELECT *, first_value(calibrator) OVER (PARTITION BY model ORDER BY round(brier, 9), -round(pr_auc, 9)) AS chosen FROM ranks JOIN errors USING (model, calibrator) JOIN eces USING (model, calibrator))"""


@query("j5_calibrator_choice", CHOICE_SQL + " SELECT model, calibrator, round(brier, 4) AS brier, round(ece, 3) AS ece, round(roc_auc, 2) AS roc_auc, round(pr_auc, 2) AS pr_auc, chosen FROM choice")
def _(t):
    table, _, _ = cal.choose_calibrators(val(t))
    return table.select("model", "calibrator", F.round("brier", 4).alias("brier"), F.round("ece", 3).alias("ece"), *[F.round(c, 2).alias(c) for c in ("roc_auc", "pr_auc")], "chosen")


@query("j5_calibrated_predictions", CHOICE_SQL + """, kind AS (SELECT DISTINCT model, chosen FROM choice), rows AS (SELECT id, p.model, split, label, prob, chosen, greatest(1e-6, least(1e0 - 1e-6, prob)) AS q FROM preds p JOIN kind ON kind.model = p.model WHERE split <> 'train'),
steps AS (SELECT s.model, s.x, iso.v FROM s JOIN iso ON iso.model = s.model AND iso.i = s.k), lowest AS (SELECT model, min_by(v, x) AS v0 FROM steps GROUP BY model),
placed AS (SELECT rows.*, steps.v, v0 FROM rows ASOF LEFT JOIN steps ON rows.model = steps.model AND rows.prob >= steps.x JOIN lowest ON lowest.model = rows.model)
SELECT id, placed.model, split, label, round(CASE chosen WHEN 'platt' THEN 1e0 / (1e0 + exp(-(a * ln(q / (1e0 - q)) + b))) WHEN 'isotonic' THEN coalesce(v, v0) ELSE prob END, 5) AS prob FROM placed JOIN w ON w.model = placed.model""")
def _(t):
    preds = t.preds()
    table, platt, iso = cal.choose_calibrators(preds.filter("split = 'val'"))
    chosen = {r.model: r.chosen for r in table.select("model", "chosen").distinct().collect()}
    return cal.calibrate(preds.filter("split <> 'train'"), chosen, platt, iso).select("id", "model", "split", "label", F.round("prob", 5).alias("prob"))


def loss_sql(loss):
    residual = {
        "logistic": "p - label", "focal": "(p - label) * (pow(1 - p, 2) * label + pow(p, 2) * (1 - label))",
        "squared": "(p - label) * p * (1 - p) * 2", "weighted": "(p - label) * (2e0 * label + 75e-2 * (1 - label))"}[loss]
    return f""" SELECT i + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
  SELECT i, a, b, sum(x * r) AS g1, sum(r) AS g2, sum(x * x * p * (1 - p)) + 1e-6 AS h11, sum(x * p * (1 - p)) AS h12, sum(p * (1 - p)) + 1e-6 AS h22 FROM (
   SELECT i, a, b, x, p, {residual} AS r FROM (SELECT i, a, b, x, label, greatest(1e-8, least(1e0 - 1e-8, 1e0 / (1e0 + exp(-(a * x + b))))) AS p FROM it_{loss}, v WHERE i < 200)) GROUP BY i, a, b)"""


FITS_SQL = "WITH RECURSIVE " + WIDE_CTE + ", v AS (SELECT dom AS x, label FROM wide WHERE split = 'val' AND dom IS NOT NULL)" + "".join(
    f", it_{s} AS (SELECT 0 AS i, 0e0 AS a, 0e0 AS b UNION ALL {loss_sql(s)})" for s in fu.LOSSES)


@query("j8_logistic_losses", FITS_SQL + " UNION ALL ".join(f" SELECT '{s}' AS loss, (SELECT count(*) FROM v) AS n, round(a, 3) AS slope, round(b, 3) AS intercept FROM it_{s} WHERE i = 200" for s in fu.LOSSES))
def _(t):
    rows = t.wide().filter("split = 'val' AND dom IS NOT NULL").select("label", "dom")
    fits = fu.fit_losses(rows, ["dom"], weights=(0.75, 2.0))
    out = rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*[F.lit(s) for s in fu.LOSSES])).alias("loss"))
    for i, c in enumerate(("slope", "intercept")):
        out = out.withColumn(c, F.round(cal.per_model({s: w[i] for s, w in fits.items()}, F.col("loss"), 0.0), 3))
    return out


def common(t, split):
    return t.wide().filter(F.col("split") == split).dropna(subset=["text", "js", "dom"])


@query("j9_loss_experiments")
def _(t):
    table, _ = fu.compare_losses(common(t, "val"), ["url", "text", "js", "dom"])
    return table.select("loss", *[F.round(c, 4).alias(c) for c in ("roc_auc", "pr_auc", "brier", "log_loss")])


@query("j10_best_loss_fusion")
def _(t):
    heads = ["url", "text", "js", "dom"]
    table, fits = fu.compare_losses(common(t, "val"), heads)
    best = fu.best_loss(table)
    return common(t, "test").select("id", "label", F.round(fu.linear_score(heads, fits[best]), 4).alias("prob"), F.lit(best).alias("loss"))
