"""Fusion queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagerisk.operators import fusion as fu
from pagerisk.plans.calibration import common
from pagerisk.plans.inputs import HEADS, WIDE_CTE, r6
from pagerisk.plans.registry import query

W = "WITH " + WIDE_CTE
COMMON = "text IS NOT NULL AND js IS NOT NULL AND dom IS NOT NULL"


def all_common(t):
    return t.wide().dropna(subset=["text", "js", "dom"])


@query("j6_average_fusion", W + f" SELECT id, split, label, round((url + text + js + dom) / 4e0, 6) AS prob FROM wide WHERE {COMMON}")
def _(t):
    return fu.average(all_common(t), HEADS).select("id", "split", "label", r6("prob", "prob"))


@query("j7_logistic_fusion")
def _(t):
    model = fu.logistic_fusion(common(t, "val"), HEADS)
    return fu.fused_by(model, common(t, "test"), HEADS).select("id", "label", F.round("prob", 4).alias("prob"))


@query("j11_out_of_fold_fusion")
def _(t):
    scored, _ = fu.out_of_fold(common(t, "val").select("id", "label", *HEADS), HEADS, 5)
    return scored.select("id", "label", "fold", F.round("prob", 4).alias("prob"))


@query("j12_stacking_features", W + f""" SELECT id, label, round(least(url, text, js, dom), 6) AS prob_min, round(greatest(url, text, js, dom), 6) AS prob_max, round((url + text + js + dom) / 4e0, 6) AS prob_mean,
 round(sqrt(((url - m) * (url - m) + (text - m) * (text - m) + (js - m) * (js - m) + (dom - m) * (dom - m)) / 4e0), 6) AS prob_std, round(abs(url - text), 6) AS absdiff_url_text, round(abs(js - dom), 6) AS absdiff_js_dom
FROM (SELECT *, (url + text + js + dom) / 4e0 AS m FROM wide WHERE {COMMON})""")
def _(t):
    out, _ = fu.stacking_features(all_common(t), HEADS)
    return out.select("id", "label", *[r6(c, c) for c in ("prob_min", "prob_max", "prob_mean", "prob_std", "absdiff_url_text", "absdiff_js_dom")])


@query("j13_meta_out_of_fold")
def _(t):
    wide, names = fu.stacking_features(common(t, "val"), HEADS)
    scored, _ = fu.out_of_fold(wide.select("id", "label", *names), names, 3, ridge=1e-3)
    return scored.select("id", "label", "fold", F.round("prob", 3).alias("prob"))


@query("j14_meta_logistic")
def _(t):
    names = [*HEADS, "fused"]
    fused = F.col("url") * 0.6 + F.col("dom") * 0.4
    coef = fu.fit_logistic(common(t, "val").withColumn("fused", fused * fused), names, ridge=1e-3)
    return common(t, "test").withColumn("fused", fused * fused).select("id", "label", F.round(fu.linear_score(names, coef), 4).alias("prob"))


GRID = fu.simplex(3, 5)
CAND_SQL = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(GRID))
SEARCH_SQL = W + f""", cand(candidate, wu, wt, wd) AS (VALUES {CAND_SQL}), sc AS (SELECT candidate, label, greatest(0e0, least(1e0, wu * url + wt * text + wd * dom)) AS score FROM wide, cand WHERE split = 'val' AND text IS NOT NULL AND dom IS NOT NULL),
g AS (SELECT candidate, score, count(*) AS n, sum(label)::BIGINT AS pos FROM sc GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY candidate) AS tn, sum(pos) OVER (PARTITION BY candidate) AS tp FROM g WINDOW w AS (PARTITION BY candidate ORDER BY score DESC)),
l AS (SELECT *, lag(cp::DOUBLE / cn, 1, 1e0) OVER (PARTITION BY candidate ORDER BY score DESC) AS p0 FROM c),
m AS (SELECT candidate, sum(pos * p0) / max(tp) AS pr, sum(pos * ((tn - tp - cn + cp) + (n - pos) / 2e0)) / (max(tp)::DOUBLE * max(tn - tp)) AS roc FROM l GROUP BY candidate),
o AS (SELECT m.candidate, pr, roc, pr - 1e-2 * (wu * wu + wt * wt + wd * wd) + 5e-2 * wd AS obj FROM m JOIN cand USING (candidate) WHERE wu <= 75e-2 + 1e-9)"""


def search(t, top=None):
    rows = t.wide().filter("split = 'val'").dropna(subset=["text", "dom"])
    return fu.weight_search(rows, ["url", "text", "dom"], GRID, l2=0.01, prefer=["dom"], bonus=0.05, caps={"url": 0.75}, top=top)


@query("j17_weight_search", SEARCH_SQL + " SELECT candidate, round(pr, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(obj, 6) AS objective FROM o")
def _(t):
    return search(t).select("candidate", r6("pr_auc", "pr_auc"), r6("roc_auc", "roc_auc"), r6("objective", "objective"))


@query("g7_top_candidates", SEARCH_SQL + " SELECT candidate, round(obj, 6) AS objective FROM o ORDER BY obj DESC, roc DESC, candidate LIMIT 5")
def _(t):
    return fu.best_weights(search(t, 5), 5).select("candidate", r6("objective", "objective"))


@query("j15_simplex_grid", W + f", cand(candidate, wu, wt, wd) AS (VALUES {CAND_SQL}), sc AS (SELECT candidate, label, greatest(0e0, least(1e0, wu * url + wt * text + wd * dom)) AS score FROM wide, cand WHERE split = 'val' AND text IS NOT NULL AND dom IS NOT NULL) SELECT candidate, round(avg(score), 6) AS mean_prob, round(avg((score - label) * (score - label)), 6) AS brier FROM sc GROUP BY candidate")
def _(t):
    rows = t.wide().filter("split = 'val'").dropna(subset=["text", "dom"])
    return fu.candidate_scores(rows, ["url", "text", "dom"], GRID).select("candidate", r6("mean_prob", "mean_prob"), r6("brier", "brier"))


# The weights are drawn by md5 in both engines.
DRAWS = 40
RANDOM_SQL = SEARCH_SQL.replace(f"cand(candidate, wu, wt, wd) AS (VALUES {CAND_SQL})", f"""draw AS (SELECT i, h, -ln((('0x' || substr(md5('42|' || i || '|' || h), 1, 15))::BIGINT + 5e-1) / 1152921504606846976e0) AS e FROM range({DRAWS}) a(i), range(3) b(h)),
cand AS (SELECT i::INTEGER AS candidate, max(e) FILTER (h = 0) / sum(e) AS wu, max(e) FILTER (h = 1) / sum(e) AS wt, max(e) FILTER (h = 2) / sum(e) AS wd FROM draw GROUP BY i)""")


@query("j16_dirichlet_search", RANDOM_SQL + " SELECT candidate, round(wu, 6) AS w_url, round(wt, 6) AS w_text, round(wd, 6) AS w_dom, round(pr, 4) AS pr_auc, round(roc, 4) AS roc_auc FROM m JOIN cand USING (candidate) ORDER BY pr DESC, candidate LIMIT 10")
def _(t):
    rows = t.wide().filter("split = 'val'").dropna(subset=["text", "dom"])
    best = fu.best_weights(fu.weight_search(rows, ["url", "text", "dom"], fu.hashed_weights(3, DRAWS), top=10), 10)
    part = F.split("weights", ",")
    return best.select("candidate", *[F.round(part[i].cast("double"), 6).alias(f"w_{h}") for i, h in enumerate(("url", "text", "dom"))], F.round("pr_auc", 4).alias("pr_auc"), F.round("roc_auc", 4).alias("roc_auc"))


@query("j18_logistic_stacker")
def _(t):
    rows = common(t, "val")
    model = fu.logistic_fusion(rows, HEADS)
    shares = fu.positive_shares(model, HEADS)
    entries = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(round(w, 4)).alias("weight")) for h, w in shares.items()])
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(entries))


@query("j19_apply_saved_model", W + f" SELECT id, round(1e0 / (1e0 + exp(-(-2e0 + 3e0 * url + 5e-1 * text + 25e-1 * dom))), 6) AS linear, round(greatest(0e0, least(1e0, 6e-1 * url + 1e-1 * text + 3e-1 * dom)), 6) AS weighted FROM wide WHERE {COMMON}")
def _(t):
    heads = ["url", "text", "dom"]
    return all_common(t).select("id", r6(fu.linear_score(heads, [3.0, 0.5, 2.5, -2.0]), "linear"), r6(fu.weighted_score(heads, [0.6, 0.1, 0.3]), "weighted"))


@query("j21_confusion_refiner")
def _(t):
    wide = fu.average(common(t, "val"), HEADS).withColumnRenamed("prob", "fused")
    out = fu.refine_band(wide, HEADS, "fused", 0.5, 0.15)
    return out.select("id", "label", F.round("prob", 3).alias("prob"))


@query("j23_url_baseline")
def _(t):
    rows = t("pages").selectExpr("page_id AS id", "regexp_replace(url, '^https?', '') AS url", "CASE WHEN url LIKE 'https:%' THEN 1 ELSE 0 END AS label")
    model = fu.url_baseline("url", size=1 << 14).fit(rows)
    return fu.score_table(model, rows, "url_ngrams", "train").select("id", "label", "model", "split", F.round("prob", 2).alias("prob"))


@query("j24_text_baseline")
def _(t):
    rows = t("documents").join(t("labels"), "doc_id").selectExpr("doc_id AS id", "text", "quality AS label")
    model = fu.text_baseline("text", size=1 << 14).fit(rows)
    return fu.score_table(model, rows, "text_words", "train").select("id", "label", "model", "split", F.round("prob", 2).alias("prob"))


@query("j25_feature_baseline")
def _(t):
    rows = t("lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "l_quantity / 50 AS q", "l_discount * 10 AS d", "l_tax * 12.5 AS x")
    model = fu.feature_baseline(["q", "d", "x"], hidden=4).fit(rows)
    return fu.score_table(model, rows, "features", "train").select("id", "label", "model", "split", F.round("prob", 2).alias("prob"))


def _linear_model():
    def predict(inputs: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(inputs @ np.array([0.05, 2.0, -3.0]) - 1.0)))

    return predict


@query("j26_batch_scoring", "SELECT l_orderkey, l_linenumber, round(1e0 / (1e0 + exp(-(5e-2 * l_quantity + 2e0 * l_discount - 3e0 * l_tax - 1e0))), 5) AS prob FROM lineitem")
def _(t):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    score = fu.batch_scorer(_linear_model, 3)
    x = F.array("l_quantity", "l_discount", "l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(score(x), 5).alias("prob"))
