"""Prediction scans, validation, alignment and orientation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagerisk.functions import mathx
from pagerisk.operators import align as al
from pagerisk.operators import metrics as m
from pagerisk.operators import predictions as pr
from pagerisk.plans.inputs import CURVE_CTE, DUP_CTE, HEADS, PREDS_CTE, WIDE_CTE, r6
from pagerisk.plans.registry import query
from pagerisk.session import work_dir
from pagerisk.sources import jsonl
from pagerisk.sources import predictions as src

HEAD_COLUMNS = ", ".join(f"round({h}, 6) AS {h}" for h in HEADS)


def round_heads():
    return [r6(h, h) for h in HEADS]


WITH_PREDS, WITH_WIDE, WITH_DUP = "WITH " + PREDS_CTE, "WITH " + WIDE_CTE, "WITH " + DUP_CTE


# --- scans -----------------------------------------------------------------

RAW_FIELDS = """CASE WHEN user_id % 2 = 0 THEN CAST(id AS STRING) END AS id, CASE WHEN user_id % 2 = 1 THEN CAST(id AS STRING) END AS page_id,
 label, js AS prob, CASE WHEN js IS NULL THEN text END AS p, CASE WHEN js IS NULL AND text IS NULL THEN dom END AS phish_prob"""


@query("a13_prediction_scan", WITH_WIDE + """, s AS (SELECT id, label, coalesce(js, text, dom) AS prob FROM wide), k AS (SELECT *, greatest(1e-12, least(1e0 - 1e-12, prob)) AS q FROM s WHERE prob IS NOT NULL)
SELECT CAST(id AS VARCHAR) AS id, label, round(prob, 6) AS prob, round(ln(q / (1e0 - q)), 5) AS logit FROM k""")
def _(t):
    path = work_dir(t.spark, "raw-preds")
    raw = t.wide().selectExpr(*[f.strip() for f in RAW_FIELDS.replace("\n", " ").split(", ")])
    jsonl.write_jsonl(raw, path)
    rows = src.read_predictions(t.spark, path)
    return rows.select("id", "label", r6("prob", "prob"), F.round("logit", 5).alias("logit"))


VARIANTS = ("named_struct('variant', 'full', 'model', 'url', 'prob', url)", "named_struct('variant', 'full', 'model', 'text', 'prob', url)",
            "named_struct('variant', 'base', 'model', 'text', 'prob', text)", "named_struct('variant', 'full', 'model', 'dom', 'prob', url)",
            "named_struct('variant', 'base', 'model', 'dom', 'prob', dom)", "named_struct('variant', 'base', 'model', 'js', 'prob', js)")
VARIANT_CTE = WIDE_CTE + """, v AS (SELECT id, label, split, 'full' AS variant, 'url' AS model, url AS prob FROM wide UNION ALL SELECT id, label, split, 'full', 'text', url FROM wide
 UNION ALL SELECT id, label, split, 'base', 'text', text FROM wide WHERE text IS NOT NULL UNION ALL SELECT id, label, split, 'full', 'dom', url FROM wide
 UNION ALL SELECT id, label, split, 'base', 'dom', dom FROM wide WHERE dom IS NOT NULL UNION ALL SELECT id, label, split, 'base', 'js', js FROM wide WHERE js IS NOT NULL)"""


def variants(t):
    return t.wide().selectExpr("id", "label", "split", f"inline(array({', '.join(VARIANTS)}))").filter("prob IS NOT NULL")


@query("a14_file_precedence", "WITH " + VARIANT_CTE + """, p AS (SELECT *, dense_rank() OVER (PARTITION BY model, split ORDER BY CASE variant WHEN 'base' THEN 1 ELSE 2 END) AS rb,
 dense_rank() OVER (PARTITION BY model, split ORDER BY CASE variant WHEN 'full' THEN 1 ELSE 2 END) AS rf FROM v),
u AS (SELECT 'strict' AS mode, model, split, variant, prob FROM p WHERE rb = 1 UNION ALL SELECT 'extended', model, split, variant, prob FROM p WHERE rf = 1
 UNION ALL SELECT 'strict_full', model, split, variant, prob FROM p WHERE variant = 'full' AND rb > 1)
SELECT mode, model, split, variant, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM u GROUP BY ALL""")
def _(t):
    v = variants(t)
    parts = [src.select_files(v, "strict").withColumn("mode", F.lit("strict")),
             src.select_files(v, "extended").withColumn("mode", F.lit("extended")),
             src.unchosen_full(v, "strict").withColumn("mode", F.lit("strict_full"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("mode", "model", "split", "variant").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("prob"), "mean_prob"))


# Two files of each variant; the second holds the rows of odd ids, or all of them for the js head.
FILES_CTE = VARIANT_CTE + """, fl AS (SELECT *, 'a' AS file FROM v WHERE id % 3 > 0 UNION ALL SELECT *, 'b' FROM v WHERE id % 2 = 1 OR model = 'js'),
sz AS (SELECT model, split, variant, file, count(*) AS n FROM fl GROUP BY ALL), lg AS (SELECT model, split, variant, arg_max(file, n * 2 + (file = 'b')::INT) AS file FROM sz GROUP BY ALL), kept AS (SELECT fl.* FROM fl JOIN lg USING (model, split, variant, file))"""


@query("a14_largest_file_and_full_output", "WITH " + FILES_CTE + """, u AS (SELECT 'mixed' AS mode, * FROM kept k WHERE variant = 'base' OR NOT EXISTS (SELECT 1 FROM kept o WHERE o.model = k.model AND o.split = k.split AND o.variant = 'base') UNION ALL
 SELECT 'mixed_full', * FROM kept WHERE variant = 'full' UNION ALL SELECT 'strict_full', * FROM kept k WHERE variant = 'full' AND EXISTS (SELECT 1 FROM kept o WHERE o.model = k.model AND o.split = k.split AND o.variant = 'base'))
SELECT mode, model, split, variant, file, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM u GROUP BY ALL""")
def _(t):
    files = F.array_compact(F.array(F.when(F.col("id") % 3 > 0, F.lit("a")), F.when((F.col("id") % 2 == 1) | (F.col("model") == "js"), F.lit("b"))))
    rows = variants(t).withColumn("file", F.explode(files))
    out = src.select_files(rows, "mixed").withColumn("mode", F.lit("mixed"))
    for mode in ("mixed", "strict"):
        out = out.unionByName(src.unchosen_full(rows, mode).withColumn("mode", F.lit(f"{mode}_full")))
    return out.groupBy("mode", "model", "split", "variant", "file").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("prob"), "mean_prob"))


def stored(t):
    path = work_dir(t.spark, "preds")
    preds = t.preds()
    meta = preds.groupBy("model", "split").agg(F.count(F.lit(1)).alias("num_samples"))
    src.write_predictions(preds, meta, path)
    return path


@query("a15_prediction_sink", WITH_PREDS + """
SELECT model, split, count(*) AS num_samples, round(sum(prob), 4) AS mass FROM preds GROUP BY model, split""")
def _(t):
    path = stored(t)
    rows = t.spark.read.parquet(f"{path}/rows").groupBy("model", "split").agg(F.round(F.sum("prob"), 4).alias("mass"))
    return t.spark.read.parquet(f"{path}/metadata").join(rows, ["model", "split"])


@query("a16_head_scan", WITH_PREDS + " SELECT id, label, round(prob, 6) AS prob, model, split FROM preds WHERE model = 'js' AND split = 'val'")
def _(t):
    return src.read_head(t.spark, stored(t), "js", "val").select("id", "label", r6("prob", "prob"), "model", "split")


@query("a17_unified_export", WITH_WIDE + """, k AS (SELECT id, label, url, text, js, dom, coalesce(url, 0e0) * 5e-1 + coalesce(dom, 0e0) * 5e-1 AS f FROM wide)
SELECT id, label, round(f, 6) AS fused_prob, concat_ws(',', CASE WHEN dom IS NOT NULL THEN 'dom=' || CAST(round(dom * 1e6)::BIGINT AS VARCHAR) END, CASE WHEN js IS NOT NULL THEN 'js=' || CAST(round(js * 1e6)::BIGINT AS VARCHAR) END,
 CASE WHEN text IS NOT NULL THEN 'text=' || CAST(round(text * 1e6)::BIGINT AS VARCHAR) END, CASE WHEN url IS NOT NULL THEN 'url=' || CAST(round(url * 1e6)::BIGINT AS VARCHAR) END) AS heads FROM k""")
def _(t):
    wide = al.by_head(t.preds(), HEADS, extra=[F.max("label").alias("label")]).withColumn(
        "prob", F.coalesce("url", F.lit(0.0)) * 0.5 + F.coalesce("dom", F.lit(0.0)) * 0.5)
    out = al.heads_map(wide, HEADS)
    parts = F.transform(F.array_sort(F.map_entries("heads")), lambda e: F.concat(e.key, F.lit("="), F.round(e.value * 1e6).cast("long").cast("string")))
    return out.select("id", "label", r6("fused_prob", "fused_prob"), F.array_join(parts, ",").alias("heads"))


@query("a18_column_pruned_output", "SELECT page_id, url FROM pages")
def _(t):
    return t("pages").drop("html")


# --- validation and row rules ----------------------------------------------

LINE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("prob", T.DoubleType())])


def lines(t):
    """Prediction lines with gaps: some objects lack prob, some lines are no JSON, some values exceed 1."""
    return t.wide().selectExpr(
        "split", "CASE WHEN dom IS NULL AND js IS NULL THEN '{bad' ELSE to_json(named_struct('id', CAST(user_id AS STRING), 'label', label, 'prob', text * 12e-1)) END AS value")


@query("b12_validation", WITH_WIDE + """, k AS (SELECT split, dom IS NULL AND js IS NULL AS bad, user_id, label, text * 12e-1 AS p FROM wide)
SELECT split, count(*) FILTER (WHERE bad) AS bad_json, 0::BIGINT AS missing_id, 0::BIGINT AS missing_label, count(*) FILTER (WHERE NOT bad AND p IS NULL) AS missing_prob,
 count(*) FILTER (WHERE NOT bad) AS predictions, count(DISTINCT user_id) FILTER (WHERE NOT bad) AS unique_ids, count(*) FILTER (WHERE NOT bad) <> count(DISTINCT user_id) FILTER (WHERE NOT bad) AS has_duplicates,
 count(*) FILTER (WHERE NOT bad AND label = 1) AS label_1, count(*) FILTER (WHERE NOT bad AND label = 0) AS label_0, round(min(p) FILTER (WHERE NOT bad), 6) AS min_prob, round(max(p) FILTER (WHERE NOT bad), 6) AS max_prob,
 (min(p) FILTER (WHERE NOT bad) < 0 OR max(p) FILTER (WHERE NOT bad) > 1) AS out_of_range, count(*) FILTER (WHERE bad OR p IS NULL) = 0 AS valid FROM k GROUP BY split""")
def _(t):
    wide = T.StructType([*LINE_SCHEMA.fields, T.StructField(jsonl.CORRUPT, T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": jsonl.CORRUPT}
    rows = lines(t).select("split", F.from_json("value", wide, opts).alias("r")).select("split", "r.*")
    report = pr.validation_report(rows, ["split"])
    return report.withColumns({"min_prob": F.round("min_prob", 6), "max_prob": F.round("max_prob", 6)})


@query("b13_gated_load", WITH_PREDS + " SELECT model, count(*) AS n FROM preds GROUP BY model")
def _(t):
    checked = pr.require_valid(t.preds().withColumn(jsonl.CORRUPT, F.lit(None).cast("string")))
    return checked.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("b14_model_names", """SELECT p_brand, CASE WHEN p_type ILIKE '%steel%' OR contains(lower(p_type), 'e') THEN 'dom' ELSE lower(p_type) END AS model, count(*) AS n FROM part GROUP BY ALL""")
def _(t):
    raw = F.when(F.contains(F.lower("p_type"), F.lit("e")), F.concat(F.lit("markup_"), F.lower("p_type"))).otherwise(F.lower("p_type"))
    return t("part").groupBy("p_brand", pr.model_name(raw).alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("b15_finite_or_half", "SELECT event_id, round(CASE WHEN event_type = 'error' OR event_type = 'view' THEN 5e-1 ELSE value / 1e2 END, 6) AS prob FROM events")
def _(t):
    noisy = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.col("value") / 100.0)
    return t("events").select("event_id", r6(mathx.finite_or_half(noisy), "prob"))


@query("b16_clamp", "SELECT event_id, round(least(1e0, greatest(0e0, value / 5e1 - 1e-1)), 6) AS prob FROM events")
def _(t):
    return t("events").select("event_id", r6(mathx.unit(F.col("value") / 50.0 - 0.1), "prob"))


@query("b17_confusion_band", WITH_PREDS + " SELECT id, model, round(prob, 6) AS prob FROM preds WHERE abs(prob - 5e-1) <= 101e-3")
def _(t):
    return t.preds().filter(F.abs(F.col("prob") - 0.5) <= 0.101).select("id", "model", r6("prob", "prob"))


@query("b18_false_positives", WITH_PREDS + " SELECT id, model, round(prob, 6) AS prob FROM preds WHERE label = 0 AND prob >= 5e-1")
def _(t):
    return t.preds().filter("label = 0 AND prob >= 0.5").select("id", "model", r6("prob", "prob"))


@query("b19_degenerate_splits", WITH_WIDE + """ SELECT user_id, split, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg FROM wide GROUP BY user_id, split
HAVING least(sum(label), count(*) - sum(label)) < 5""")
def _(t):
    c = t.gold().groupBy("user_id", "split").agg(F.sum("label").alias("pos"), (F.count(F.lit(1)) - F.sum("label")).alias("neg"))
    return c.filter(F.least("pos", "neg") < 5)


# --- alignment -------------------------------------------------------------

@query("d1_inner_alignment", WITH_WIDE + " SELECT id, label, round(url, 6) AS url, round(text, 6) AS text, round(coalesce(js, 0e0), 6) AS js, round(dom, 6) AS dom FROM wide WHERE text IS NOT NULL AND dom IS NOT NULL AND url IS NOT NULL")
def _(t):
    return al.inner_align(t.gold(), t.preds(), HEADS, ["url", "text", "dom"]).select("id", "label", *round_heads())


COVERAGE = """cov AS (SELECT id, label, split, coalesce(url, 5e-1) AS url, coalesce(text, 5e-1) AS text, coalesce(js, 5e-1) AS js, coalesce(dom, 5e-1) AS dom FROM wide
 WHERE (url IS NOT NULL)::INT + (text IS NOT NULL)::INT + (js IS NOT NULL)::INT + (dom IS NOT NULL)::INT >= 3)"""


@query("d2_coverage_alignment", WITH_WIDE + ", " + COVERAGE + f" SELECT id, label, {HEAD_COLUMNS} FROM cov")
def _(t):
    return al.coverage_align(t.gold(), t.preds(), HEADS, min_heads=3).select("id", "label", *round_heads())


@query("d3_alignment_by_name", WITH_WIDE + ", " + COVERAGE + """ SELECT 'coverage_max' AS strategy, count(*) AS n FROM cov
UNION ALL SELECT 'inner_join', count(*) FROM wide WHERE url IS NOT NULL AND text IS NOT NULL AND js IS NOT NULL AND dom IS NOT NULL""")
def _(t):
    gold, preds = t.gold(), t.preds()
    parts = [al.align(s, gold, preds, HEADS, min_heads=3).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("strategy"), "n") for s in al.STRATEGIES]
    return parts[0].unionByName(parts[1])


SOFT = """means AS (SELECT split AS s, avg(url) AS mu, avg(text) AS mt, avg(js) AS mj, avg(dom) AS md FROM wide GROUP BY split),
soft AS (SELECT id, split, label, (coalesce(url, mu) + coalesce(text, mt) + coalesce(js, mj) + coalesce(dom, md)) / 4e0 AS prob FROM wide JOIN means ON split = s)"""


@query("d4_soft_imputation", WITH_WIDE + ", " + SOFT + " SELECT id, split, label, round(prob, 6) AS prob FROM soft")
def _(t):
    return al.soft_impute(t.preds(), HEADS).select("id", "split", "label", r6("prob", "prob"))


@query("d5_common_ids", WITH_WIDE + f" SELECT id, label, {HEAD_COLUMNS} FROM wide WHERE text IS NOT NULL AND js IS NOT NULL AND dom IS NOT NULL")
def _(t):
    return al.common_ids(t.preds(), HEADS).select("id", "label", *round_heads())


@query("d6_calibrated_else_raw", WITH_PREDS + """ SELECT id, model, split, round(CASE WHEN model IN ('text', 'dom') THEN 9e-1 * prob + 5e-2 ELSE prob END, 6) AS prob,
 CASE WHEN model IN ('text', 'dom') THEN 'calibrated' ELSE 'raw' END AS variant FROM preds""")
def _(t):
    raw = t.preds().withColumn("variant", F.lit("raw"))
    cal = raw.filter(F.col("model").isin("text", "dom")).withColumn("prob", F.col("prob") * 0.9 + 0.05).withColumn("variant", F.lit("calibrated"))
    return src.choose_variant(raw.unionByName(cal), ("calibrated", "raw")).select("id", "model", "split", r6("prob", "prob"), "variant")


@query("d7_restrict_to_common", WITH_WIDE + " SELECT id, round(url, 6) AS prob FROM wide WHERE text IS NOT NULL AND js IS NOT NULL AND dom IS NOT NULL")
def _(t):
    preds = t.preds()
    return al.restrict_to_common(preds.filter("model = 'url'"), preds, ["text", "js", "dom"]).select("id", r6("prob", "prob"))


CANON = "canon AS (SELECT event_id AS id, 1 - " + "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END" + " AS label FROM events WHERE event_type <> 'view')"


def canon(t):
    """Canonical ids: every event but views, so coverage shows both missing and extra ids; labels inverted to show who wins."""
    return t("events").filter("event_type <> 'view'").selectExpr("event_id AS id", "1 - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label")


@query("d11_strict_projection", WITH_PREDS + ", " + CANON + " SELECT p.id, p.model, c.label, round(p.prob, 6) AS prob FROM preds p JOIN canon c ON p.id = c.id")
def _(t):
    return al.strict_projection(canon(t), t.preds()).select("id", "model", "label", r6("prob", "prob"))


@query("d12_missing_derived", WITH_WIDE + " SELECT id FROM wide WHERE url IS NOT NULL AND text IS NOT NULL AND js IS NULL")
def _(t):
    return al.missing_derived(t.preds(), ["url", "text"], "js")


@query("d13_explain_id", WITH_WIDE + f""" SELECT id, {HEAD_COLUMNS}, CASE WHEN url IS NOT NULL AND text IS NOT NULL AND js IS NULL THEN 'fusion_alignment_excluded_or_bug' ELSE 'unknown' END AS cause_guess FROM wide WHERE id = 7""")
def _(t):
    return al.explain_id(t.preds(), 7, HEADS, ["url", "text"], "js").select("id", *round_heads(), "cause_guess")


@query("d14_append_missing", WITH_PREDS + """ SELECT id, label, round(prob, 6) AS prob, model FROM preds WHERE model = 'js'
UNION ALL SELECT id, label, round(prob, 6), model FROM preds WHERE model = 'url' AND id NOT IN (SELECT id FROM preds WHERE model = 'js')""")
def _(t):
    preds = t.preds().select("id", "label", r6("prob", "prob"), "model")
    return al.append_missing(preds.filter("model = 'js'"), preds.filter("model = 'url'"))


@query("d15_needs_scoring", WITH_WIDE + " SELECT id, label FROM wide WHERE js IS NULL AND user_id > 20")
def _(t):
    return al.needs_scoring(t.gold(), t.preds(), "js", F.col("user_id") > 20).select("id", "label")


@query("g1_sorted_ids", WITH_WIDE + " SELECT id, label FROM wide WHERE js IS NOT NULL AND dom IS NOT NULL ORDER BY id")
def _(t):
    return al.common_ids(t.preds(), ["js", "dom"]).select("id", "label").orderBy("id")


@query("h2_union_of_ids", WITH_PREDS + " SELECT id FROM preds WHERE model = 'text' UNION SELECT id FROM preds WHERE model = 'js' UNION SELECT id FROM preds WHERE model = 'dom'")
def _(t):
    return t.preds().filter(F.col("model").isin("text", "js", "dom")).select("id").distinct()


@query("h3_intersection_of_ids", WITH_PREDS + " SELECT id FROM preds WHERE model = 'text' INTERSECT SELECT id FROM preds WHERE model = 'js' INTERSECT SELECT id FROM preds WHERE model = 'dom'")
def _(t):
    return al.covered_by_all(t.preds(), ["text", "js", "dom"])


@query("h4_except_of_ids", WITH_PREDS + ", " + CANON + """, p AS (SELECT DISTINCT id FROM preds WHERE model = 'js')
SELECT 'missing' AS side, id FROM canon WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT 'extra', id FROM p WHERE id NOT IN (SELECT id FROM canon)""")
def _(t):
    have, want = t.preds().filter("model = 'js'").select("id").distinct(), canon(t).select("id")
    missing = want.join(have, "id", "left_anti").select(F.lit("missing").alias("side"), "id")
    return missing.unionByName(have.join(want, "id", "left_anti").select(F.lit("extra").alias("side"), "id"))


# --- duplicates and orientation --------------------------------------------

@query("e22_duplicate_aggregation", WITH_DUP + """, q AS (SELECT *, greatest(1e-12, least(1e0 - 1e-12, prob)) AS s FROM dup_preds)
SELECT model, id, round(avg(prob), 6) AS prob, round(avg(ln(s / (1e0 - s))), 5) AS logit, arg_min(label, pos) AS label, count(*) AS duplicate_count FROM q GROUP BY model, id""")
def _(t):
    return pr.aggregate_duplicates(t.dup_preds(), ["pos"]).select(
        "model", "id", r6("prob", "prob"), F.round("logit", 5).alias("logit"), "label", "duplicate_count")


@query("f5_keep_first", WITH_DUP + """, k AS (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY pos) AS f,
 row_number() OVER (PARTITION BY model, id ORDER BY pos DESC) AS l FROM dup_preds)
SELECT 'first' AS kept, model, id, label, round(prob, 6) AS prob FROM k WHERE f = 1 UNION ALL SELECT 'last', model, id, label, round(prob, 6) FROM k WHERE l = 1""")
def _(t):
    kept = pr.keep_ends(t.dup_preds(), ["model", "id"], ["pos"])
    return kept.select("kept", "model", "id", "label", r6("prob", "prob"))


@query("f5_dedup_stats", WITH_DUP + """, k AS (SELECT model, id, count(*) AS n FROM dup_preds GROUP BY model, id)
SELECT sum(n)::BIGINT AS rows_before, count(*) AS rows_after, sum(n - 1)::BIGINT AS removed, count(*) FILTER (WHERE n > 1) AS duplicated_ids FROM k""")
def _(t):
    return pr.dedup_stats(t.dup_preds(), ["model", "id"])


@query("j20_auto_flip", "WITH " + CURVE_CTE + """, a AS (SELECT model AS m, split AS s, sum(pos * ((tot_n - tot_pos - cum_n + cum_pos) + (n - pos) / 2e0)) / (max(tot_pos)::DOUBLE * max(tot_n - tot_pos)) AS roc FROM c GROUP BY model, split)
SELECT id, model, split, roc < 5e-1 AS flipped, round(CASE WHEN roc < 5e-1 THEN 1e0 - prob ELSE prob END, 6) AS prob FROM preds JOIN a ON model = m AND split = s""")
def _(t):
    return pr.auto_flip(t.preds()).select("id", "model", "split", "flipped", r6("prob", "prob"))


# --- flagship --------------------------------------------------------------

def flagship(t):
    """Coverage alignment, mean fusion, then the metric table of every head and the fusion."""
    wide = al.coverage_align(t.gold().select("id", "label", "split"), t.preds(), HEADS, min_heads=3, cheap=["split"])
    entries = [F.struct(F.lit(h).alias("model"), F.col(h).alias("prob")) for h in HEADS]
    fused = F.struct(F.lit("fused").alias("model"), mathx.unit(mathx.mean_of(*[F.col(h) for h in HEADS])).alias("prob"))
    long = wide.select("id", "label", "split", F.inline(F.array(*entries, fused)))
    rates = ["prevalence", "roc_auc", "pr_auc", "fpr_at_tpr90", "thr_at_tpr90", "fpr_at_tpr95", "thr_at_tpr95"]
    return m.ranking_metrics(long).select("model", "split", "n", "pos", *[r6(c, c) for c in rates])


@query("flagship_fused_metrics", WITH_WIDE + ", " + COVERAGE + """, long AS (SELECT split, label, 'url' AS model, url AS prob FROM cov UNION ALL SELECT split, label, 'text', text FROM cov UNION ALL SELECT split, label, 'js', js FROM cov
 UNION ALL SELECT split, label, 'dom', dom FROM cov UNION ALL SELECT split, label, 'fused', (url + text + js + dom) / 4e0 FROM cov),
g AS (SELECT model, split, prob AS score, count(*) AS n, sum(label)::BIGINT AS pos FROM long GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER (PARTITION BY model, split) AS tot_n, sum(pos) OVER (PARTITION BY model, split) AS tot_pos FROM g WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
q AS (SELECT *, cum_pos::DOUBLE / cum_n AS precision, cum_pos::DOUBLE / tot_pos AS recall, (cum_n - cum_pos)::DOUBLE / (tot_n - tot_pos) AS fpr FROM c),
l AS (SELECT *, lag(recall, 1, 0e0) OVER w AS r0, lag(precision, 1, 1e0) OVER w AS p0 FROM q WINDOW w AS (PARTITION BY model, split ORDER BY score DESC))
SELECT model, split, max(tot_n)::BIGINT AS n, max(tot_pos)::BIGINT AS pos, round(max(tot_pos)::DOUBLE / max(tot_n), 6) AS prevalence,
 round(sum(pos * ((tot_n - tot_pos - cum_n + cum_pos) + (n - pos) / 2e0)) / (max(tot_pos)::DOUBLE * max(tot_n - tot_pos)), 6) AS roc_auc,
 round(greatest(0e0, least(1e0, sum((recall - r0) * p0))), 6) AS pr_auc, round(arg_max(fpr, score) FILTER (WHERE recall >= 9e-1), 6) AS fpr_at_tpr90, round(max(score) FILTER (WHERE recall >= 9e-1), 6) AS thr_at_tpr90,
 round(arg_max(fpr, score) FILTER (WHERE recall >= 95e-2), 6) AS fpr_at_tpr95, round(max(score) FILTER (WHERE recall >= 95e-2), 6) AS thr_at_tpr95 FROM l GROUP BY model, split""")
def _(t):
    return flagship(t)
