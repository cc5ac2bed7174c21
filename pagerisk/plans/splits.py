"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import splits as sp
from pagerisk.plans.inputs import GOLD_CTE
from pagerisk.plans.registry import query
from pagerisk.session import work_dir

G = "WITH " + GOLD_CTE


def cut():
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")



CUT_SQL = "TIMESTAMP '2024-01-25 00:00:00'"
RANKED = f"""pg AS (SELECT DISTINCT user_id FROM gold WHERE ts <= {CUT_SQL}), rk AS (SELECT user_id AS g, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r, count(*) OVER () AS c FROM pg),
sp AS (SELECT id, user_id, label, ts, CASE WHEN ts > {CUT_SQL} THEN 'test' WHEN r <= round_even(1e-1 * c, 0) THEN 'val' ELSE 'train' END AS split FROM gold LEFT JOIN rk ON g = user_id)"""


def gold(t):
    return t.gold().drop("split")


@query("i1_time_group_split", G + ", " + RANKED + " SELECT id, user_id, split FROM sp")
def _(t):
    return sp.time_group_split(gold(t), "user_id", "ts", cut()).select("id", "user_id", "split")


@query("i1_strict_groups", G + ", " + RANKED + """, m AS (SELECT id, CASE WHEN split = 'test' THEN user_id + 40 ELSE user_id END AS user_id, split FROM sp) SELECT id, user_id, split FROM m WHERE split <> 'test' OR user_id NOT IN (SELECT user_id FROM pg)""")
def _(t):
    moved = gold(t).withColumn("user_id", F.when(F.col("ts") > cut(), F.col("user_id") + 40).otherwise(F.col("user_id")))
    return sp.time_group_split(moved, "user_id", "ts", cut(), strict_groups=True).select("id", "user_id", "split")


@query("i1_group_overlap", G + ", " + RANKED + """, k AS (SELECT user_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM sp GROUP BY user_id)
SELECT count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE c AND (a OR b)) AS test_early FROM k""")
def _(t):
    return sp.group_overlap(sp.time_group_split(gold(t), "user_id", "ts", cut()), "user_id")


AFTER = """tt AS (SELECT ts AS t, count(*) AS n, sum(label) AS p FROM gold GROUP BY ts), af AS (SELECT t, coalesce(sum(n) OVER w, 0)::BIGINT AS n_after, coalesce(sum(p) OVER w, 0)::BIGINT AS pos_after, row_number() OVER (ORDER BY t) - 1 AS idx FROM tt WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
WALK = AFTER + f""", jj AS (SELECT count(*) AS j FROM tt WHERE t <= {CUT_SQL}), wk AS (SELECT *, CASE WHEN idx < j THEN (j - 1 - idx) * 2 ELSE (idx - j) * 2 + 1 END AS turn FROM af, jj)"""


@query("f3_counts_after", G + ", " + AFTER + " SELECT t, n_after, pos_after, idx FROM af")
def _(t):
    return sp.counts_after(t.gold(), "ts")


@query("e32_percentile_cutoff", "SELECT round(quantile_cont(epoch_us(ts)::DOUBLE, 8e-1), 0) AS cutoff_us FROM events")
def _(t):
    return sp.percentile_cutoff(t("events"), "ts", 80.0).select(F.round("cutoff_us", 0).alias("cutoff_us"))


@query("i2_cutoff_both_classes", G + ", " + WALK + f" SELECT coalesce((SELECT t FROM wk WHERE pos_after >= 900 AND n_after > pos_after ORDER BY turn LIMIT 1), {CUT_SQL}) AS cutoff")
def _(t):
    return sp.cutoff_with_both_classes(t.gold(), "ts", cut(), min_pos=900)


@query("i3_cutoff_for_ratio", G + ", " + WALK + f""", e0 AS (SELECT abs(avg(label) - 23e-2) AS e FROM gold WHERE ts > {CUT_SQL}), er AS (SELECT wk.*, abs(pos_after::DOUBLE / n_after - 23e-2) AS err FROM wk WHERE n_after >= 100 AND pos_after >= 10)
SELECT coalesce((SELECT t FROM er, e0 WHERE err < e ORDER BY err > 2e-3, CASE WHEN err > 2e-3 THEN err ELSE 0 END, turn LIMIT 1), {CUT_SQL}) AS cutoff""")
def _(t):
    return sp.cutoff_for_ratio(t.gold(), "ts", cut(), 0.23, 0.002, min_pos=10, min_total=100)


LABEL_AWARE = f"""gs AS (SELECT user_id, count(*) AS n, sum(label) AS p FROM gold WHERE ts <= {CUT_SQL} GROUP BY user_id), od AS (SELECT *, CASE WHEN p > 0 AND p < n THEN 0 WHEN p > 0 THEN 1 ELSE 2 END AS kind, md5('42|' || user_id) AS d FROM gs),
ru AS (SELECT user_id AS g, coalesce(sum(n) OVER (ORDER BY kind, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS tot FROM od)"""


@query("i5_label_aware_split", G + ", " + LABEL_AWARE + f" SELECT id, CASE WHEN ts > {CUT_SQL} THEN 'test' WHEN b < greatest(1, round_even(15e-2 * tot, 0)) THEN 'val' ELSE 'train' END AS split FROM gold LEFT JOIN ru ON g = user_id")
def _(t):
    return sp.label_aware_split(gold(t), "user_id", "ts", cut(), 0.15).select("id", "split")


RATIO = f"""gs AS (SELECT user_id, count(*) AS n, sum(label)::BIGINT AS p FROM gold WHERE ts <= {CUT_SQL} GROUP BY user_id),
od AS (SELECT *, p::DOUBLE / n >= 25e-2 AS rich, md5('42|' || user_id) AS d FROM gs),
pools AS (SELECT want, high, low, CASE WHEN high IS NULL THEN 0e0 WHEN low IS NULL THEN want ELSE want * (25e-2 - low) / (high - low) END AS quota FROM (
  SELECT greatest(1, round_even(15e-2 * sum(n), 0)) AS want, sum(p) FILTER (WHERE rich)::DOUBLE / sum(n) FILTER (WHERE rich) AS high,
    sum(p) FILTER (WHERE NOT rich)::DOUBLE / sum(n) FILTER (WHERE NOT rich) AS low FROM od)),
ru AS (SELECT od.*, pools.want, pools.quota, coalesce(sum(n) OVER w, 0) AS bn, coalesce(sum(p) OVER w, 0) AS bp FROM od, pools
  WINDOW w AS (PARTITION BY rich ORDER BY d, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fi AS (SELECT *, rich AND (bn < quota OR bp < 5) AS first FROM ru),
got AS (SELECT coalesce(sum(n) FILTER (WHERE first), 0)::BIGINT AS gn, coalesce(sum(p) FILTER (WHERE first), 0)::BIGINT AS gp FROM fi),
ends AS (SELECT bn + n AS e, abs((gp + bp + p)::DOUBLE / (gn + bn + n) - 25e-2) + abs(gn + bn + n - want)::DOUBLE / want AS miss,
  CASE WHEN gn > 0 THEN abs(gp::DOUBLE / gn - 25e-2) + abs(gn - want)::DOUBLE / want END AS none FROM fi, got WHERE NOT rich),
cut AS (SELECT CASE WHEN min(none) <= min(miss) THEN 0 ELSE coalesce(arg_min(e, ROW(miss, e)), 0) END AS e FROM ends),
ch AS (SELECT user_id AS g, first OR (NOT rich AND bn + n <= cut.e) AS in_val FROM fi, cut)"""


@query("i5_ratio_target_split", G + ", " + RATIO + f" SELECT id, CASE WHEN ts > {CUT_SQL} THEN 'test' WHEN in_val THEN 'val' ELSE 'train' END AS split FROM gold LEFT JOIN ch ON g = user_id")
def _(t):
    return sp.label_aware_split(gold(t), "user_id", "ts", cut(), 0.15, target=0.25, min_pos=5).select("id", "split")


@query("i6_balance_check", G + f""", c AS (SELECT count(*) FILTER (WHERE ts <= {CUT_SQL}) AS pre, count(*) FILTER (WHERE ts > {CUT_SQL}) AS post, count(*) FILTER (WHERE ts <= {CUT_SQL} AND label = 1) AS pre_pos, count(*) FILTER (WHERE ts > {CUT_SQL} AND label = 1) AS post_pos FROM gold)
SELECT *, NOT (pre_pos < floor(5e-1 * pre * 9e-1) + floor(5e-1 * pre * 1e-1) * 5e-1 OR post_pos < floor(5e-1 * post) * 5e-1) AS balance_possible FROM c""")
def _(t):
    return sp.balance_check(gold(t), "ts", cut(), 0.1)


STRAT = """rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY label) AS c FROM gold)"""


@query("i6_stratified_split", G + ", " + STRAT + ", q AS (SELECT *, round_even(1e-1 * c, 0) AS v, round_even(2e-1 * c, 0) AS te FROM rk) SELECT id, label, CASE WHEN r <= te THEN 'test' WHEN r <= te + v THEN 'val' ELSE 'train' END AS split FROM q")
def _(t):
    return sp.stratified_split(gold(t).select("id", "label"), 0.2, 0.1)


@query("i7_one_class_guard", G + f""", b AS (SELECT id, CASE WHEN ts > {CUT_SQL} THEN 0 ELSE label END AS label, ts FROM gold), f AS (SELECT greatest(5e-2, least(8e-1, count(*) FILTER (WHERE ts > {CUT_SQL})::DOUBLE / count(*))) AS tf FROM b),
rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY label) AS c FROM b),
q AS (SELECT *, least(c, greatest(CASE label WHEN 1 THEN 100 ELSE 0 END, round_even(1e-1 * c, 0))) AS v FROM rk), z AS (SELECT q.*, least(c - v, greatest(CASE label WHEN 1 THEN 100 ELSE 0 END, round_even(tf * c, 0))) AS te FROM q, f)
SELECT id, CASE WHEN r <= te THEN 'test' WHEN r <= te + v THEN 'val' ELSE 'train' END AS split FROM z""")
def _(t):
    late = F.col("ts") > cut()
    rows = gold(t).withColumn("label", F.when(late, 0).otherwise(F.col("label")))
    splits = sp.time_group_split(rows, "user_id", "ts", cut())
    return sp.guarded_split(splits.drop("user_id", "ts"), 0.1, 100, 50).select("id", "split")


@query("i8_return_smallest_group", G + ", " + RANKED + """, z AS (SELECT id, user_id, split, CASE WHEN split = 'train' THEN 0 ELSE label END AS label FROM sp), v AS (SELECT user_id, sum(label) AS p FROM z WHERE split = 'val' GROUP BY user_id HAVING sum(label) > 0 ORDER BY p, user_id LIMIT 1)
SELECT id, CASE WHEN split = 'val' AND user_id IN (SELECT user_id FROM v) THEN 'train' ELSE split END AS split FROM z""")
def _(t):
    splits = sp.time_group_split(gold(t), "user_id", "ts", cut())
    bare = splits.withColumn("label", F.when(F.col("split") == "train", 0).otherwise(F.col("label")))
    return sp.return_smallest_group(bare, "user_id").select("id", "split")


@query("i9_extend_splits", f"SELECT event_id AS id, CASE WHEN ts > {CUT_SQL} THEN 'test' WHEN event_type = 'click' THEN 'val' ELSE 'train' END AS split FROM events")
def _(t):
    known = t("events").filter(F.col("ts") <= cut()).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "val").otherwise("train").alias("split"))
    once = sp.extend_splits(known, t("events").select(F.col("event_id").alias("id")))
    return sp.extend_splits(once, t("events").select(F.col("event_id").alias("id")))


@query("i10_balanced_subset", G + ", " + STRAT + " SELECT id, label FROM rk WHERE r <= 150")
def _(t):
    return sp.balanced_subset(t.gold().select("id", "label"), 150)


@query("f7_balanced_folds", G + ", " + STRAT + " SELECT id, label, ((r - 1) % 5)::INTEGER AS fold FROM rk")
def _(t):
    return sp.folds(t.gold().select("id", "label"), 5)


@query("d21_slices", "SELECT event_id AS id, round(value, 6) AS value FROM events WHERE event_id % 10 BETWEEN 7 AND 8")
def _(t):
    path = work_dir(t.spark, "slices")
    sp.write_slices(t("events").select(F.col("event_id").alias("id"), "value"), t.gold(), path)
    return sp.read_slice(t.spark, path, "val").select("id", F.round("value", 6).alias("value"))
