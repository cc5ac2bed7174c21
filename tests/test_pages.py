"""The page table: plans over the column graph, fill-only enrichment, hot-key lookups."""

import pytest
from pyspark.sql import functions as F

from pagerisk.functions.features import CHEAP_FEATURES
from pagerisk.operators import mining as mi
from pagerisk.operators import pages as pg
from pagerisk.operators.joins import hot_keys, salted_join
from pagerisk.sources import predictions as src

HTML = "<html><head><title>My Shop</title></head><body><form method=get><input type=password></form><script>eval(1); atob(2)</script></body></html>"


def test_schema_covers_the_vector():
    assert set(CHEAP_FEATURES) <= set(pg.PAGE_SCHEMA) and len(pg.PAGE_SCHEMA) == 110


def test_plan_takes_only_what_is_asked(spark):
    todo = pg.plan(["id", "url", "html"], ["tld", "num_pw"])
    assert todo.parts == {"input_types"} and todo.absent == ()
    assert [s.outputs[0] for s in todo.order] == ["url_final", "tld"]
    assert pg.plan(["id", "url", "html"], ["url_len"]).parsed == ()
    assert pg.plan(["id"], ["url_len", "num_pw", "rdap_age_days"]).absent == ("url_len", "num_pw", "rdap_age_days")
    assert pg.plan(["id", "dns_created_days_ago"], ["rdap_age_days"]).absent == ()


def test_enrich_fills_and_keeps(spark):
    rows = [("a", "https://login.shop.co.uk/x", HTML, 7, None), ("b", "http://1.2.3.4/", None, None, "Own"), ("c", None, HTML, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id STRING, url STRING, html STRING, num_pw INT, registrar STRING").withColumn("other", F.lit(5))
    facts = spark.createDataFrame([("shop.co.uk", "Privacy Inc", 3)], "d STRING, registrar STRING, ns_count INT")
    dims = [pg.Dimension(facts, "d", F.col("etld1"), ("etld1",))]
    full, absent = pg.enrich(df, dims, ["tld", "etld1", "num_pw", "num_email", "js_eval_ct", "registrar", "rdap_has_privacy", "rdap_ns_count", "ttl_min"])
    got = {r.id: r for r in full.collect()}
    assert absent == ("ttl_min",) and "js_text" not in full.columns and full.count() == 4
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.tld, a.etld1, a.num_pw, a.num_email, a.js_eval_ct) == ("co.uk", "shop.co.uk", 7, 0, 1)
    assert (a.registrar, a.rdap_has_privacy, a.rdap_ns_count) == ("Privacy Inc", True, 3)
    assert (b.etld1, b.num_pw, b.registrar, b.rdap_has_privacy) == ("1.2.3.4", None, "Own", False)
    assert (c.tld, c.num_pw, c.js_eval_ct, c.registrar, c.other) == (None, 1, 1, None, 5)
    assert got[None].num_pw is None
    vector, missing = pg.feature_vector(df, dims)
    assert vector.columns == ["id", *CHEAP_FEATURES] and "ttl_min" in missing and {r.id: r.num_pw for r in vector.collect()}["b"] == 0.0
    assert pg.enrich(df.limit(0), dims)[0].count() == 0


def test_conform_types_and_absent_columns(spark):
    df = spark.createDataFrame([("1", "x", "12")], "id STRING, url_len STRING, extra STRING").withColumn("num_pw", F.lit("3"))
    out = pg.conform(df)
    assert out.columns[: len(pg.PAGE_SCHEMA)] == list(pg.PAGE_SCHEMA) and out.columns[-1] == "extra"
    r = out.first()
    assert (r.url_len, r.num_pw, r.html, r.extra) == (None, 3, None, "12")


def test_only_hot_keys_are_salted(spark):
    facts = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    dim = facts.select("k").distinct().withColumn("v", F.length("k"))
    hot = hot_keys(facts, ["k"], 16)
    assert hot == [facts.filter("k = 'hot'").select(F.xxhash64("k")).first()[0]]
    joined = salted_join(facts, dim, ["k"], "id")
    assert joined.count() == 6000 and joined.filter("v IS NULL OR v <> length(k)").count() == 0
    repeated = dim.count() + 15
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "explode(CASE WHEN" in plan and repeated == dim.withColumn("s", F.explode(F.when(F.xxhash64("k").isin(hot), F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0))))).count()
    assert hot_keys(facts.filter("k <> 'hot'"), ["k"], 16) == [] and hot_keys(facts.limit(0), ["k"], 16) == []
    nulls = facts.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    assert salted_join(nulls, dim, ["k"], "id").count() == 6000


def test_largest_file_and_full_output(spark):
    rows = [("m", "val", "base", "a", 0.1)] * 2 + [("m", "val", "base", "b", 0.2)] * 3 + [("m", "val", "full", "a", 0.3), ("n", "val", "full", "a", 0.4), ("n", "val", "full", "b", 0.5)]
    df = spark.createDataFrame(rows, "model STRING, split STRING, variant STRING, file STRING, prob DOUBLE")
    shown = lambda d: sorted((r.model, r.file, r.prob) for r in d.collect())
    assert shown(src.select_files(df, "mixed")) == [("m", "b", 0.2)] * 3 + [("n", "b", 0.5)]
    assert shown(src.select_files(df, "extended")) == [("m", "a", 0.3), ("n", "b", 0.5)]
    assert shown(src.unchosen_full(df, "strict")) == [("m", "a", 0.3)] and shown(src.unchosen_full(df, "mixed")) == [("m", "a", 0.3), ("n", "b", 0.5)]
    assert src.unchosen_full(df, "extended").count() == 0
    with pytest.raises(ValueError):
        src.unchosen_full(df, "odd")


def test_term_vectors_have_unit_length_and_cluster(spark):
    rows = [(i, ["red", "car"] if i % 2 else ["blue", "sea", "sea"]) for i in range(20)] + [(50, []), (51, ["rare"]), (52, None)]
    df = spark.createDataFrame(rows, "id INT, toks ARRAY<STRING>")
    weights = mi.tfidf(df, "toks", 4)
    lengths = weights.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(lengths) == 20 and all(r.s == pytest.approx(1.0) for r in lengths)
    clusters = {r.id: r.cluster for r in mi.cluster(mi.term_vectors(df, "toks", 4)[0], 8).collect()}
    assert len(clusters) == 20 and not {clusters[i] for i in range(0, 20, 2)} & {clusters[i] for i in range(1, 20, 2)}
    assert mi.tfidf(df.filter("id = 50"), "toks").count() == 0 == mi.cluster(mi.term_vectors(df.limit(0), "toks", 4)[0]).count()
