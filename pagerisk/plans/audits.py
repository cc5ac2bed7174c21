"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import audits as au
from pagerisk.operators import metrics as m
from pagerisk.plans.inputs import CURVE_CTE, DUP_CTE, GOLD_CTE, HEADS, PREDS_CTE, WIDE_CTE, r6
from pagerisk.plans.predictions import CANON, canon
from pagerisk.plans.ranking import METRIC_TABLE
from pagerisk.plans.registry import query
from pagerisk.session import work_dir

WITH_GOLD, WITH_WIDE, WITH_PREDS, WITH_DUP = ("WITH " + c for c in (GOLD_CTE, WIDE_CTE, PREDS_CTE, DUP_CTE))
WITH_METRICS = "WITH " + CURVE_CTE + ", " + METRIC_TABLE


@query("e20_class_counts", WITH_GOLD + " SELECT split, count(*) AS n, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg, round(avg(label), 6) AS pos_ratio FROM gold GROUP BY split")
def _(t):
    return au.class_counts(t.gold()).withColumn("pos_ratio", F.round("pos_ratio", 6))


@query("e20_verify_splits", WITH_GOLD + """, n AS (SELECT unnest(['train', 'val', 'test', 'extra']) AS split), k AS (SELECT n.split, count(id) AS n, coalesce(sum(label), 0)::BIGINT AS pos FROM n LEFT JOIN gold g ON g.split = n.split GROUP BY n.split)
SELECT split, n, pos, n - pos AS neg, CASE WHEN n = 0 THEN 'empty' WHEN (pos = 0 OR pos = n) AND split IN ('val', 'test') THEN 'one_class' WHEN pos < 300 AND split IN ('val', 'test') THEN 'too_few_positives' WHEN pos = 0 OR pos = n THEN 'warn_one_class' ELSE 'ok' END AS verdict FROM k""")
def _(t):
    return au.verify_splits(t.gold(), ("train", "val", "test", "extra"), min_pos=300)


@query("e21_coverage_audit", WITH_PREDS + ", " + CANON + """, k AS (SELECT model, count(DISTINCT id) AS ids, sum(label)::BIGINT AS pos FROM preds GROUP BY model UNION ALL SELECT '_union', count(DISTINCT id), NULL FROM preds
 UNION ALL SELECT '_canonical', count(*), sum(label)::BIGINT FROM canon) SELECT model, ids, pos, round(pos::DOUBLE / ids, 6) AS prevalence FROM k""")
def _(t):
    return au.coverage(canon(t), t.preds()).select("model", "ids", "pos", r6("prevalence", "prevalence"))


@query("e23_extended_coverage", WITH_PREDS + ", " + CANON + """, m AS (SELECT DISTINCT model FROM preds), cm AS (SELECT model, id, label FROM canon, m),
k AS (SELECT coalesce(c.model, p.model) AS model, c.id IS NOT NULL AS ic, p.id IS NOT NULL AS ip, c.label AS cl, p.label AS pl FROM cm c FULL JOIN preds p ON p.id = c.id AND p.model = c.model),
s AS (SELECT model, count(*) FILTER (WHERE ic) AS canonical, count(*) FILTER (WHERE ic AND ip) AS covered, count(*) FILTER (WHERE ic AND NOT ip) AS missing_count, count(*) FILTER (WHERE ip AND NOT ic) AS extra_count,
 count(*) FILTER (WHERE ic AND ip AND pl = 1) AS pos, avg(cl) FILTER (WHERE ic) AS cp FROM k GROUP BY model)
SELECT model, canonical, covered, missing_count, extra_count, round(covered::DOUBLE / canonical, 6) AS coverage, round(pos::DOUBLE / canonical, 6) AS prevalence, round(cp, 6) AS canonical_prevalence,
 round((pos::DOUBLE / canonical - cp) / cp, 6) AS drift, covered::DOUBLE / canonical >= 97e-2 AS near_complete FROM s""")
def _(t):
    out = au.extended_coverage(canon(t), t.preds(), HEADS)
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "prevalence", "canonical_prevalence", "drift")})


@query("e23_missing_samples", WITH_PREDS + ", " + CANON + """, m AS (SELECT DISTINCT model FROM preds), k AS (SELECT model, 'missing' AS side, id FROM canon, m WHERE (model, id) NOT IN (SELECT (model, id) FROM preds)
 UNION ALL SELECT model, 'extra', id FROM preds WHERE id NOT IN (SELECT id FROM canon)), r AS (SELECT *, row_number() OVER (PARTITION BY model, side ORDER BY id) AS rn FROM k)
SELECT model, side, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sample FROM r WHERE rn <= 5 GROUP BY model, side""")
def _(t):
    return au.sample_lists(au.missing_and_extra(canon(t), t.preds(), HEADS), ["model", "side"], "id", 5, "sample")


@query("e23_duplicate_histogram", WITH_DUP + ", k AS (SELECT model, id, count(*) AS duplicate_count FROM dup_preds GROUP BY model, id) SELECT model, duplicate_count, count(*) AS ids FROM k GROUP BY ALL")
def _(t):
    return au.duplicate_histogram(t.dup_preds())


@query("e23_intersection_prevalence", WITH_WIDE + """, k AS (SELECT c.label FROM wide w JOIN (SELECT event_id AS id, 1 - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events WHERE event_type <> 'view') c ON c.id = w.id WHERE text IS NOT NULL AND dom IS NOT NULL)
SELECT count(*) AS ids, round(avg(label), 6) AS prevalence FROM k""")
def _(t):
    return au.intersection_prevalence(canon(t), t.preds(), ["text", "dom"]).select("ids", r6("prevalence", "prevalence"))


@query("e24_union_inflation", WITH_PREDS + """, u AS (SELECT split, count(DISTINCT id) AS union_ids FROM preds GROUP BY split), k AS (SELECT split, count(DISTINCT id) AS canonical FROM preds WHERE model = 'js' GROUP BY split)
SELECT split, union_ids, canonical, round(union_ids::DOUBLE / canonical, 6) AS inflation, union_ids::DOUBLE / canonical > 105e-2 AS inflated FROM u JOIN k USING (split)""")
def _(t):
    preds = t.preds()
    return au.union_inflation(preds.filter("model = 'js'"), preds).withColumn("inflation", F.round("inflation", 6))


@query("e25_modality_combinations", WITH_WIDE + """ SELECT concat_ws('+', CASE WHEN url IS NOT NULL THEN 'url' END, CASE WHEN text IS NOT NULL THEN 'text' END, CASE WHEN js IS NOT NULL THEN 'js' END, CASE WHEN dom IS NOT NULL THEN 'dom' END) AS combo, count(*) AS ids
FROM wide WHERE coalesce(url, text, js, dom) IS NOT NULL GROUP BY 1""")
def _(t):
    return au.combinations(t.preds(), HEADS)


@query("e26_missing_causes", WITH_WIDE + """, k AS (SELECT CASE WHEN url IS NULL THEN '_' ELSE 'url' END || '+' || CASE WHEN text IS NULL THEN '_' ELSE 'text' END AS cause, js, dom FROM wide)
SELECT 'js' AS model, cause, count(*) AS ids FROM k WHERE js IS NULL GROUP BY cause UNION ALL SELECT 'dom', cause, count(*) FROM k WHERE dom IS NULL GROUP BY cause""")
def _(t):
    return au.missing_causes(t.gold(), t.preds(), ["url", "text"], ["js", "dom"])


@query("e27_head_gap_breakdown", WITH_WIDE + """, k AS (SELECT w.*, CASE WHEN event_type <> 'view' THEN props END AS raw_a, CASE WHEN event_type = 'click' THEN props END AS raw_b FROM wide w JOIN events ON event_id = id)
SELECT count(*) AS canonical, count(js) AS covered, count(*) FILTER (WHERE js IS NULL) AS missing, count(*) FILTER (WHERE js IS NULL AND dom IS NOT NULL) AS missing_with_other,
 count(*) FILTER (WHERE js IS NULL AND dom IS NOT NULL AND raw_a IS NULL AND raw_b IS NULL) AS other_but_no_field, count(*) FILTER (WHERE js IS NULL AND dom IS NULL AND raw_a IS NULL AND raw_b IS NULL) AS no_other_no_field,
 count(*) FILTER (WHERE js IS NULL AND (raw_a IS NOT NULL OR raw_b IS NOT NULL)) AS field_but_no_pred, count(*) FILTER (WHERE js IS NULL AND raw_a IS NOT NULL) AS missing_with_raw_a, count(*) FILTER (WHERE js IS NULL AND raw_b IS NOT NULL) AS missing_with_raw_b FROM k""")
def _(t):
    rows = t("events").selectExpr("event_id AS id", "CASE WHEN event_type <> 'view' THEN props END AS raw_a", "CASE WHEN event_type = 'click' THEN props END AS raw_b")
    return au.head_gap_breakdown(rows, t.preds(), "js", "dom", ["raw_a", "raw_b"])


@query("e28_gap_classes", """WITH k AS (SELECT CASE WHEN d.doc_id IS NULL THEN 'no_record' WHEN t.text IS NULL THEN 'no_js_field' WHEN length(t.text) = 0 THEN 'empty_js' WHEN length(t.text) < 200 THEN 'short_js' ELSE 'has_js' END AS gap, e.event_type AS split
 FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN source = 'src1' THEN '' ELSE text END AS text FROM documents) t ON t.doc_id = e.event_id),
c AS (SELECT split, gap, count(*) AS ids FROM k GROUP BY split, gap), b AS (SELECT * FROM c UNION ALL SELECT 'combined', gap, sum(ids)::BIGINT FROM c GROUP BY gap)
SELECT split, gap, ids, round(ids * 1e2 / sum(ids) OVER (PARTITION BY split), 6) AS pct FROM b""")
def _(t):
    missing = t("events").selectExpr("event_id AS id", "event_type AS split")
    pages = t("documents").selectExpr("doc_id AS id", "CASE WHEN lang = 'de' THEN NULL WHEN source = 'src1' THEN '' ELSE text END AS js_code")
    return au.gap_summary(missing, pages, "js_code").withColumn("pct", F.round("pct", 6))


@query("e29_augmentation_novelty", """WITH base AS (SELECT DISTINCT doc_id, text FROM documents), aug AS (SELECT DISTINCT doc_id, CASE WHEN source = 'src1' THEN text || ' x' ELSE text END AS text FROM documents),
k AS (SELECT count(*) AS n, count(b.doc_id) AS same FROM aug a LEFT JOIN base b ON a.doc_id = b.doc_id AND a.text = b.text)
SELECT n AS aug_distinct, same AS identical_lines, (SELECT count(DISTINCT doc_id) FROM documents) AS aug_ids, (SELECT count(DISTINCT doc_id) FROM documents) AS id_overlap, round(same::DOUBLE / n, 6) AS identical_ratio, round(1 - same::DOUBLE / n, 6) AS novelty_ratio,
 CASE WHEN same::DOUBLE / n > 98e-2 THEN 'drop_as_redundant' WHEN same::DOUBLE / n > 9e-1 THEN 'regenerate_more_diverse' ELSE 'keep' END AS recommendation FROM k""")
def _(t):
    base = t("documents").select(F.col("doc_id").alias("id"), "text", "source")
    aug = base.withColumn("text", F.when(F.col("source") == "src1", F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return au.novelty(base.drop("source"), aug.drop("source")).withColumns({c: F.round(c, 6) for c in ("identical_ratio", "novelty_ratio")})


@query("e30_head_anomalies", WITH_PREDS + """ SELECT model, split, round(avg(prob), 6) AS mean, round(var_pop(prob), 6) AS variance, round(min(prob), 6) AS min, round(max(prob), 6) AS max, avg(prob) > 48e-2 OR var_pop(prob) < 1e-3 AS flagged FROM preds GROUP BY model, split""")
def _(t):
    return au.head_anomalies(t.preds(), high_mean=0.48).withColumns({c: F.round(c, 6) for c in ("mean", "variance", "min", "max")})


@query("e35_retrain_plan", WITH_WIDE + """, k AS (SELECT count(*) AS total, sum(label)::BIGINT AS positives, count(*) FILTER (WHERE label = 0 AND url >= 4e-1) AS hard_negatives FROM wide)
SELECT total, positives, hard_negatives, total - positives AS negatives, round(positives::DOUBLE / total, 6) AS positive_ratio, round(5e-1 / (positives::DOUBLE / total), 6) AS weight_pos, round(5e-1 / (1 - positives::DOUBLE / total), 6) AS weight_neg,
 round((total - positives)::DOUBLE / positives, 6) AS pos_weight, floor((total - positives) * 3e-1)::BIGINT AS hard_allowed, hard_negatives > floor((total - positives) * 3e-1) AS downsample FROM k""")
def _(t):
    rows = t.wide().withColumn("hard", (F.col("label") == 0) & (F.col("url") >= 0.4))
    return au.retrain_plan(rows, "hard").withColumns({c: F.round(c, 6) for c in ("positive_ratio", "weight_pos", "weight_neg", "pos_weight")})


@query("e36_feature_moments", """SELECT 'l_quantity' AS "column", round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(var_samp(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(var_samp(l_tax), 6) FROM lineitem""")
def _(t):
    return au.feature_moments(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("column", r6("mean", "mean"), r6("variance", "variance"))


def metric_table(t):
    return m.ranking_metrics(t.preds())


@query("e37_kpi_row", WITH_METRICS + """ SELECT split AS run, round(max(pr_auc) FILTER (WHERE model = 'url'), 6) AS url_pr, round(max(fpr_at_tpr95) FILTER (WHERE model = 'dom'), 6) AS dom_fpr95, round(max(roc_auc) FILTER (WHERE model = 'js'), 6) AS js_roc FROM mt GROUP BY split""")
def _(t):
    tidy = metric_table(t).unpivot(["model", "split"], ["pr_auc", "roc_auc", "fpr_at_tpr95"], "metric", "value").selectExpr("split AS run", "model AS source", "metric", "value")
    out = au.kpi_row(tidy, {"url_pr": ("url", "pr_auc"), "dom_fpr95": ("dom", "fpr_at_tpr95"), "js_roc": ("js", "roc_auc")})
    return out.withColumns({c: F.round(c, 6) for c in ("url_pr", "dom_fpr95", "js_roc")})


@query("e38_gate", WITH_PREDS + """, k AS (SELECT model, split, count(*) FILTER (WHERE prob >= 5e-1 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 5e-1 AND label = 0) AS fp, count(*) FILTER (WHERE label = 0) AS neg FROM preds WHERE split <> 'train' GROUP BY ALL),
r AS (SELECT model, split, tp::DOUBLE / greatest(1, tp + fp) AS p, fp::DOUBLE / greatest(1, neg) AS f FROM k), j AS (SELECT c.model, (b.p - c.p) / b.p AS d, (c.f - b.f) / b.f AS i FROM r c JOIN r b ON c.model = b.model AND c.split = 'test' AND b.split = 'val')
SELECT model, round(d, 6) AS precision_drop, round(i, 6) AS fpr_rise, d <= 2e-2 AND i <= 2e-2 AS passed FROM j""")
def _(t):
    at = m.threshold_metrics(t.preds(), 0.5).select("model", "split", "precision", "fpr")
    out = au.gate(at.filter("split = 'test'").drop("split"), at.filter("split = 'val'").drop("split"), ["model"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision_drop", "fpr_rise")})


@query("e39_split_manifest", WITH_GOLD + " SELECT split, count(*) AS n, sum(label)::BIGINT AS pos, bit_xor(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15))::BIGINT) AS ids_hash, sum(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15))::BIGINT)::VARCHAR AS ids_sum FROM gold GROUP BY split")
def _(t):
    return au.manifest(t.gold())


@query("e40_dataset_drift", WITH_PREDS + """, u AS (SELECT DISTINCT id FROM preds WHERE model = 'dom'), f AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events WHERE event_type <> 'view')
SELECT count(f.id) AS full_total, sum(coalesce(f.label, 0))::BIGINT AS full_pos, count(u.id) AS used_ids, round(count(u.id)::DOUBLE / count(f.id), 6) AS coverage_ratio, count(*) FILTER (WHERE u.id IS NULL) AS missing_count, count(*) FILTER (WHERE f.id IS NULL) AS extra_count FROM f FULL JOIN u ON f.id = u.id""")
def _(t):
    full = t("events").filter("event_type <> 'view'").selectExpr("event_id AS id", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label")
    return au.dataset_drift(full, t.preds().filter("model = 'dom'")).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("e42_cascade_coverage", WITH_WIDE + """, k AS (SELECT split, label, (url >= 8e-1 OR url <= 15e-2)::INT AS resolved FROM wide)
SELECT split, round(avg(resolved), 6) AS resolved_overall, round(1 - avg(resolved), 6) AS escalated_overall, round(sum(resolved * label)::DOUBLE / greatest(1, sum(label)), 6) AS resolved_bad, round(sum(resolved * (1 - label))::DOUBLE / greatest(1, sum(1 - label)), 6) AS resolved_benign,
 round(1 - sum(resolved * label)::DOUBLE / greatest(1, sum(label)), 6) AS escalated_bad, round(1 - sum(resolved * (1 - label))::DOUBLE / greatest(1, sum(1 - label)), 6) AS escalated_benign FROM k GROUP BY split""")
def _(t):
    from pagerisk.operators.cascade import resolution

    out = resolution(t.wide().withColumn("prob", F.col("url")), 0.15, 0.8, ["split"])
    return out.select("split", *[r6(c, c) for c in ("resolved_overall", "escalated_overall", "resolved_bad", "resolved_benign", "escalated_bad", "escalated_benign")])


@query("e43_variant_comparison", WITH_METRICS + """, k AS (SELECT a.model, a.split, a.pr_auc, a.pr_auc - b.pr_auc AS pr_delta, a.fpr_at_tpr95 - a.fpr_at_tpr90 AS fpr_delta FROM mt a JOIN mt b ON a.split = b.split AND b.model = 'url')
SELECT model, split, round(pr_auc, 6) AS pr_auc, round(pr_delta, 6) AS pr_delta, round(fpr_delta, 6) AS fpr_delta, fpr_delta = min(fpr_delta) OVER (PARTITION BY split) AS smallest_gap FROM k""")
def _(t):
    out = au.compare_variants(metric_table(t), base="url")
    return out.select("model", "split", r6("pr_auc", "pr_auc"), r6("pr_delta", "pr_delta"), r6("fpr_delta", "fpr_delta"), "smallest_gap")


@query("e43_recommendations", WITH_METRICS + """, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY fpr_at_tpr90, pr_auc DESC) AS r90, row_number() OVER (PARTITION BY split ORDER BY fpr_at_tpr95, pr_auc DESC) AS r95 FROM mt)
SELECT split, 'TPR90' AS target, model AS variant, round(thr_at_tpr90, 6) AS thr, round(fpr_at_tpr90, 6) AS fpr FROM k WHERE r90 = 1 UNION ALL SELECT split, 'TPR95', model, round(thr_at_tpr95, 6), round(fpr_at_tpr95, 6) FROM k WHERE r95 = 1""")
def _(t):
    table = metric_table(t)
    both = au.recommend(table, "90").unionByName(au.recommend(table, "95"))
    return both.select("split", "target", "variant", r6("thr", "thr"), r6("fpr", "fpr"))


@query("e44_calibration_diff", WITH_METRICS + """, p AS (SELECT model, split, avg((prob - label) * (prob - label)) AS brier FROM preds WHERE model IN ('url', 'dom') GROUP BY ALL)
SELECT a.split, round(a.brier - b.brier, 6) AS d_brier, round(ma.pr_auc - mb.pr_auc, 6) AS d_pr_auc FROM p a JOIN p b ON a.split = b.split AND a.model = 'dom' AND b.model = 'url' JOIN mt ma ON ma.model = 'dom' AND ma.split = a.split JOIN mt mb ON mb.model = 'url' AND mb.split = a.split""")
def _(t):
    preds = t.preds().filter(F.col("model").isin("url", "dom"))
    table = m.ranking_metrics(preds).join(m.point_metrics(preds).drop("n"), ["model", "split"])
    return au.paired_delta(table, "url", "dom", ["brier", "pr_auc"]).select("split", r6("d_brier", "d_brier"), r6("d_pr_auc", "d_pr_auc"))


@query("e45_operating_thresholds", "WITH " + CURVE_CTE + """, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY precision DESC, score DESC) AS rn FROM rates WHERE recall >= 95e-2 AND split = 'val')
SELECT CASE WHEN model IN ('url', 'dom') THEN 'head' ELSE 'variant' END AS kind, model, round(score, 6) AS threshold FROM k WHERE rn = 1""")
def _(t):
    def thresholds(models, kind):
        rows = t.preds().filter(F.col("model").isin(*models) & (F.col("split") == "val"))
        return m.operating_point(m.score_curve(rows, ["model"]), ["model"]).select(F.lit(kind).alias("kind"), "model", r6("threshold", "threshold"))

    return thresholds(["url", "dom"], "head").unionByName(thresholds(["text", "js"], "variant"))


@query("e46_stacking_comparison", WITH_METRICS + " SELECT model, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM mt WHERE split = 'test' AND model IN ('url', 'dom')")
def _(t):
    return m.ranking_metrics(t.preds().filter("split = 'test' AND model IN ('url', 'dom')")).select("model", r6("pr_auc", "pr_auc"), r6("roc_auc", "roc_auc"))


@query("e50_refiner_uplift", WITH_WIDE + """, k AS (SELECT label, url, CASE WHEN abs(url - 5e-1) <= 15e-2 AND dom IS NOT NULL THEN dom ELSE url END AS nw FROM wide),
s AS (SELECT count(*) FILTER (WHERE url >= 5e-1 AND label = 1) AS base_tp, count(*) FILTER (WHERE url >= 5e-1 AND label = 0) AS base_fp, count(*) FILTER (WHERE nw >= 5e-1 AND label = 1) AS new_tp, count(*) FILTER (WHERE nw >= 5e-1 AND label = 0) AS new_fp FROM k)
SELECT *, round(base_tp::DOUBLE / greatest(1, base_tp + base_fp), 6) AS base_precision, round(new_tp::DOUBLE / greatest(1, new_tp + new_fp), 6) AS refined_precision, round(new_tp::DOUBLE / greatest(1, new_tp + new_fp) - base_tp::DOUBLE / greatest(1, base_tp + base_fp), 6) AS uplift FROM s""")
def _(t):
    preds = t.preds()
    rows = preds.filter("model = 'url'")
    band = rows.filter(F.abs(F.col("prob") - 0.5) <= 0.15).select("id")
    refined = preds.filter("model = 'dom'").join(band, "id", "left_semi")
    return au.uplift(rows, refined, 0.5).withColumns({c: F.round(c, 6) for c in ("base_precision", "refined_precision", "uplift")})


@query("e51_robustness_delta", WITH_METRICS + """ SELECT split, round(max(pr_auc) FILTER (WHERE model = 'dom') - max(pr_auc) FILTER (WHERE model = 'js'), 6) AS d_pr_auc, round(max(roc_auc) FILTER (WHERE model = 'dom') - max(roc_auc) FILTER (WHERE model = 'js'), 6) AS d_roc_auc FROM mt GROUP BY split""")
def _(t):
    table = m.ranking_metrics(t.preds().filter(F.col("model").isin("js", "dom")))
    return au.paired_delta(table, "js", "dom", ["pr_auc", "roc_auc"]).select("split", r6("d_pr_auc", "d_pr_auc"), r6("d_roc_auc", "d_roc_auc"))


@query("e52_modality_counts", WITH_PREDS + " SELECT model AS modality, split, count(*) AS total, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM preds GROUP BY model, split")
def _(t):
    flags = t.wide().select("split", "label", *[F.col(h).isNotNull().alias(h) for h in HEADS])
    return au.modality_counts(flags, HEADS)


@query("f11_last_rows", "SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 200")
def _(t):
    return au.last_n(t("events").select("event_id", "ts", "value"), "ts", 200)


@query("g10_ambiguous_examples", WITH_PREDS + """, k AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY abs(prob - 5e-1), id) AS rank FROM preds)
SELECT model, label, id, round(prob, 6) AS prob, rank::INTEGER AS rank FROM k WHERE rank <= 12""")
def _(t):
    return au.ambiguous(t.preds(), 12, ["model", "label"]).select("model", "label", "id", r6("prob", "prob"), "rank")


@query("b9_enrichment_needed", """SELECT count(*) AS "rows", count(*) FILTER (WHERE event_type <> 'view' OR value > 50) AS enriched, count(*) FILTER (WHERE event_type <> 'view' OR value > 50) < count(*) AS needed FROM events""")
def _(t):
    rows = t("events").selectExpr("CASE WHEN event_type <> 'view' THEN event_id END AS host_hyphens", "CASE WHEN value > 50 THEN 'x' END AS text_title")
    return au.needs_enrichment(rows, ["host_hyphens", "text_title"])


@query("a19_report_tables", WITH_METRICS + " SELECT model, split, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM mt")
def _(t):
    from pagerisk.sources.reports import read_csv_table, write_report

    path = work_dir(t.spark, "report")
    write_report(metric_table(t).select("model", "split", r6("pr_auc", "pr_auc"), r6("roc_auc", "roc_auc")), path)
    return read_csv_table(t.spark, path, "model STRING, split STRING, pr_auc DOUBLE, roc_auc DOUBLE")


@query("a20_artifact_merge", WITH_METRICS + " SELECT CASE WHEN model IN ('url', 'text') THEN 'a' ELSE 'b' END AS run, model, split, round(pr_auc, 6) AS pr_auc, CASE WHEN model IN ('js', 'dom') THEN round(roc_auc, 6) END AS roc_auc FROM mt")
def _(t):
    from pagerisk.sources.reports import merge_artifacts

    base = work_dir(t.spark, "artifacts")
    table = metric_table(t)
    for run, models, cols in (("a", ["url", "text"], ["pr_auc"]), ("b", ["js", "dom"], ["pr_auc", "roc_auc"])):
        table.filter(F.col("model").isin(*models)).select("model", "split", *[r6(c, c) for c in cols]).write.json(f"{base}/{run}")
    return merge_artifacts(t.spark, base, ["a", "b", "absent"], "model STRING, split STRING, pr_auc DOUBLE, roc_auc DOUBLE")
