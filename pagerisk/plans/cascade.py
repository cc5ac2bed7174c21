"""Cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import cascade as ca
from pagerisk.operators import metrics as m
from pagerisk.operators.quantiles import quantile_grid
from pagerisk.plans.inputs import CURVE_CTE, PREDS_CTE, WIDE_CTE, r6
from pagerisk.plans.registry import query

W = "WITH " + WIDE_CTE
FULL = "text IS NOT NULL AND js IS NOT NULL AND dom IS NOT NULL"
FUSED = "(url + dom) / 2e0"


def rows(t):
    """Aligned heads: url first, text and js as cheap heads, dom heavy, their mean as the fused score."""
    w = t.wide().dropna(subset=["text", "js", "dom"])
    return w.withColumns({"cheap": ca.cheap_mean(["text", "js"]), "fused": (F.col("url") + F.col("dom")) / 2.0})


K1_SQL = W + f""", v AS (SELECT label, url AS s FROM wide WHERE split = 'val' AND {FULL}), b AS (SELECT 'hi' AS side, s AS p, label AS y FROM v UNION ALL SELECT 'lo', 1e0 - s, 1 - label FROM v),
g AS (SELECT side, p, count(*) AS n, sum(y) AS pos FROM b GROUP BY ALL), c AS (SELECT side, p, sum(pos) OVER w / sum(n) OVER w AS prec FROM g WINDOW w AS (PARTITION BY side ORDER BY p DESC)),
t AS (SELECT coalesce(min(p) FILTER (WHERE side = 'hi' AND prec >= 9e-1), 1e0) AS hi0, 1e0 - coalesce(min(p) FILTER (WHERE side = 'lo' AND prec >= 97e-2), 1e0) AS lo0 FROM c),
th AS (SELECT CASE WHEN lo0 >= hi0 THEN least(1e0, (lo0 + hi0) / 2 + 1e-6) ELSE hi0 END AS hi, CASE WHEN lo0 >= hi0 THEN greatest(0e0, (lo0 + hi0) / 2 - 1e-6) ELSE lo0 END AS lo FROM t)"""


@query("k1_two_tier_cascade", K1_SQL + f" SELECT id, split, label, round(CASE WHEN url >= hi OR url <= lo THEN url ELSE {FUSED} END, 6) AS prob, url >= hi AS accepted_bad, url <= lo AS accepted_benign FROM wide, th WHERE {FULL}")
def _(t):
    r = rows(t)
    lo, hi = ca.cascade_thresholds(r.filter("split = 'val'").select("label", "url"), "url", 0.9, 0.97, mode="max_coverage")
    out = ca.apply_cascade(r, "url", "fused", lo, hi)
    return out.select("id", "split", "label", r6("prob", "prob"), (F.col("url") >= hi).alias("accepted_bad"), (F.col("url") <= lo).alias("accepted_benign"))


K3_EDGES = f"""sp AS (SELECT min(url) AS lo, max(url) AS hi FROM wide WHERE {FULL}), ed AS (SELECT i, CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END AS thr FROM sp, (SELECT unnest(range(0, 20)) AS i))"""
K3_SQL = W + ", " + K3_EDGES + f""", d AS (SELECT label, url, {FUSED} AS f FROM wide WHERE {FULL}), q AS (SELECT i, thr, f, label FROM d JOIN ed ON url >= thr), g AS (SELECT i, thr, f, count(*) AS n, sum(label) AS p FROM q GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER (PARTITION BY i) AS tn, sum(p) OVER (PARTITION BY i) AS tp FROM g WINDOW w AS (PARTITION BY i ORDER BY f DESC)), tot AS (SELECT count(*) AS n, sum(label) AS p FROM d),
k3 AS (SELECT thr, max(tn)::DOUBLE / max(tot.n) AS pass_rate, max(tp)::DOUBLE / max(tot.p) AS retained_recall, coalesce(arg_max(cp::DOUBLE / cn, f) FILTER (WHERE cp::DOUBLE / greatest(1, tp) >= 95e-2), 0e0) AS precision_at_target FROM c, tot GROUP BY i, thr)"""


@query("k3_single_band_sweep", K3_SQL + " SELECT round(thr, 6) AS threshold, round(pass_rate, 6) AS pass_rate, round(retained_recall, 6) AS retained_recall, round(precision_at_target, 6) AS precision_at_target FROM k3")
def _(t):
    out = ca.single_band(rows(t), "url", "fused", 20)
    return out.select(*[r6(c, c) for c in out.columns])


@query("g5_best_single_band", K3_SQL + " SELECT round(thr, 6) AS threshold, round(pass_rate, 6) AS pass_rate FROM k3 WHERE retained_recall >= 95e-2 ORDER BY pass_rate, thr DESC LIMIT 1")
def _(t):
    return ca.best_single_band(ca.single_band(rows(t), "url", "fused", 20)).select(r6("threshold", "threshold"), r6("pass_rate", "pass_rate"))


def grid_sql(n):
    return "[" + ", ".join(repr(i / (n - 1)) for i in range(n)) + "]"


@query("e31_quantile_grid", "WITH " + PREDS_CTE + f", q AS (SELECT model, split, list_sort(list_distinct(list_transform(quantile_cont(prob, {grid_sql(25)}), lambda v: round(v, 6)))) AS g FROM preds GROUP BY model, split) SELECT model, split, unnest(g) AS q FROM q")
def _(t):
    return quantile_grid(t.preds(), ["model", "split"], "prob", 25).select("model", "split", F.explode("grid").alias("q"))


def band_sql(n, three):
    q = lambda c: f"(SELECT list_sort(list_distinct(list_transform(quantile_cont({c}, {grid_sql(n)}), lambda v: round(v, 6)))) FROM d)"
    cost = "1e0 + pass1 * 13e0 + pass2 * 60e0 + pass3 * 2e0" if three else "1e0 + pass1 * 13e0 + pass2 * 62e0"
    g3 = f", g3 AS (SELECT unnest({q('dom')}) AS t3)" if three else ""
    t3, s3 = (", t3", " AND dom >= t3") if three else ("", "")
    return W + f""", d AS (SELECT label, url, (text + js) / 2e0 AS cheap, dom, {FUSED} AS f FROM wide WHERE split = 'val' AND {FULL}), g1 AS (SELECT unnest({q('url')}) AS t1), g2 AS (SELECT unnest({q('cheap')}) AS t2){g3},
s AS (SELECT t1, t2{t3}, count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE url >= t1)::DOUBLE / count(*) AS pass1, count(*) FILTER (WHERE url >= t1 AND cheap >= t2)::DOUBLE / count(*) AS pass2{", count(*) FILTER (WHERE url >= t1 AND cheap >= t2 AND dom >= t3)::DOUBLE / count(*) AS pass3" if three else ""},
 count(*) FILTER (WHERE url >= t1 AND cheap >= t2{s3} AND f >= 5e-1 AND label = 1) AS tp, count(*) FILTER (WHERE url >= t1 AND cheap >= t2{s3} AND f >= 5e-1 AND label = 0) AS fp FROM d, g1, g2{", g3" if three else ""} GROUP BY ALL),
r AS (SELECT *, tp::DOUBLE / greatest(1, pos) AS recall, tp::DOUBLE / greatest(1, tp + fp) AS precision, fp::DOUBLE / greatest(1, n - pos) AS fpr, {cost} AS expected_cost FROM s WHERE pass{3 if three else 2} > 0)"""


TWO, THREE = band_sql(10, False), band_sql(6, True)
COLS2 = ["t1", "t2", "recall", "precision", "fpr", "pass1", "pass2", "expected_cost"]
COLS3 = ["t1", "t2", "t3", "recall", "precision", "fpr", "pass1", "pass2", "pass3", "expected_cost"]


def rounded(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def two(t, n=10):
    return ca.two_band(rows(t).filter("split = 'val'"), "url", "cheap", "fused", 0.5, ca.HEAD_COSTS, 13.0, n)


def three(t, n=6):
    return ca.three_band(rows(t).filter("split = 'val'"), "url", "cheap", "dom", "fused", 0.5, ca.HEAD_COSTS, 13.0, n)


@query("k4_two_band_search", TWO + f" SELECT {rounded(COLS2)} FROM r")
def _(t):
    return two(t).select(*[r6(c, c) for c in COLS2])


@query("k5_three_band_search", THREE + f" SELECT {rounded(COLS3)} FROM r")
def _(t):
    return three(t).select(*[r6(c, c) for c in COLS3])


@query("k6_cost_sensitivity", TWO + ", b AS (SELECT * FROM r WHERE recall >= 6e-1 ORDER BY expected_cost, t1, t2 LIMIT 1) SELECT scale, round(expected_cost * scale, 6) AS expected_cost, round(recall, 6) AS recall FROM b, (SELECT unnest([5e-1, 75e-2, 1e0, 125e-2, 15e-1]) AS scale)")
def _(t):
    return ca.cost_sensitivity(two(t), target=0.6).select("scale", r6("expected_cost", "expected_cost"), r6("recall", "recall"))


@query("k7_cheap_mean", W + f" SELECT id, round((text + js + url) / 3e0, 6) AS cheap FROM wide WHERE {FULL}")
def _(t):
    return rows(t).select("id", r6(ca.cheap_mean(["text", "js", "url"]), "cheap"))


@query("g4_ranked_results", TWO + f" SELECT {rounded(['t1', 't2', 'recall', 'expected_cost'])} FROM r ORDER BY r.recall DESC, r.expected_cost, r.t1, r.t2 LIMIT 40")
def _(t):
    return ca.ranked_results(two(t), 40).select(*[r6(c, c) for c in ("t1", "t2", "recall", "expected_cost")])


@query("g5_cheapest_cut", TWO + " SELECT round(t1, 6) AS t1, round(t2, 6) AS t2, round(r.expected_cost, 6) AS expected_cost FROM r WHERE recall >= 6e-1 ORDER BY r.expected_cost, r.t1, r.t2 LIMIT 1")
def _(t):
    return ca.cheapest(two(t), 0.6).select(r6("t1", "t1"), r6("t2", "t2"), r6("expected_cost", "expected_cost"))


@query("f8_recall_frontier", THREE + ", k AS (SELECT *, round(recall, 3) AS recall_bucket, row_number() OVER (PARTITION BY round(recall, 3) ORDER BY recall DESC, expected_cost, t1, t2, t3) AS rn FROM r) SELECT recall_bucket, round(expected_cost, 6) AS expected_cost FROM k WHERE rn = 1 ORDER BY recall_bucket DESC LIMIT 50")
def _(t):
    return ca.frontier(three(t)).select("recall_bucket", r6("expected_cost", "expected_cost"))


@query("g6_best_by_two_keys", "WITH " + CURVE_CTE + """, b AS (SELECT split, model, avg((prob - label) * (prob - label)) AS brier FROM preds GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY brier) AS rn FROM b) SELECT split, model, round(brier, 6) AS brier FROM r WHERE rn = 1""")
def _(t):
    table = m.point_metrics(t.preds())
    return table.groupBy("split").agg(F.min_by(F.struct("model", "brier"), F.struct("brier", "model")).alias("b")).select("split", "b.model", r6("b.brier", "brier"))


@query("d18_threshold_lookup", "WITH " + PREDS_CTE + " SELECT id, model, CASE model WHEN 'url' THEN 7e-1 WHEN 'dom' THEN 4e-1 ELSE 5e-1 END AS thr, prob >= CASE model WHEN 'url' THEN 7e-1 WHEN 'dom' THEN 4e-1 ELSE 5e-1 END AS flagged FROM preds")
def _(t):
    known = t.preds().filter(F.col("model").isin("url", "dom")).groupBy("model").agg(F.max(F.when(F.col("model") == "url", 0.7).otherwise(0.4)).alias("threshold"))
    from pagerisk.operators.joins import settled

    return ca.with_threshold(t.preds(), settled(known, "thresholds")).select("id", "model", "thr", (F.col("prob") >= F.col("thr")).alias("flagged"))


@query("d19_threshold_grid", "WITH " + PREDS_CTE + ", e AS (SELECT unnest(range(0, 11)) AS i) SELECT model, i::INTEGER AS cell, count(*) AS n, sum(label)::BIGINT AS pos FROM preds JOIN e ON prob >= i / 1e1 GROUP BY ALL")
def _(t):
    edges = [i / 10.0 for i in range(11)]
    cells = t.preds().groupBy("model", m.bin_index(F.col("prob"), edges).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    spread = cells.select("model", F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("cell"), "n", "pos")
    return spread.groupBy("model", "cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
