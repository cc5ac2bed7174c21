import pytest
from pyspark.sql import functions as F

from pagerisk.operators import align as al
from pagerisk.operators import audits as au
from pagerisk.operators import predictions as pr
from pagerisk.session import work_dir
from pagerisk.sources import predictions as src
from pagerisk.sources.jsonl import CORRUPT


@pytest.fixture(scope="module")
def three_heads(spark):
    gold = spark.createDataFrame([("a", 1, "u1"), ("b", 0, "u2"), ("c", 1, "u3")], "id STRING, label INT, url STRING")
    rows = [("a", 1, .9, "h1"), ("b", 0, .1, "h1"), ("c", 1, .8, "h1"), ("a", 1, .7, "h2"), ("b", 0, .3, "h2"), ("c", 1, .6, "h2"), ("a", 1, .5, "h3"), ("b", 0, .2, "h3")]
    preds = spark.createDataFrame([(*r, "val") for r in rows], "id STRING, label INT, prob DOUBLE, model STRING, split STRING")
    return gold, preds


def test_inner_and_coverage_alignment(three_heads):
    gold, preds = three_heads
    heads = ["h1", "h2", "h3"]
    assert al.align("inner_join", gold, preds, heads).count() == 2
    cov = {r.id: r for r in al.align("coverage_max", gold, preds, heads, min_heads=2).collect()}
    assert len(cov) == 3 and cov["c"].h3 == 0.5
    loose = {r.id: r for r in al.inner_align(gold, preds, heads, required=["h1"]).collect()}
    assert loose["c"].h3 == 0.0 and len(loose) == 3
    with pytest.raises(ValueError):
        al.align("nope", gold, preds, heads)


def test_auto_flip_turns_inverted_heads_and_twice_is_identity(spark):
    df = spark.createDataFrame([(i, y, p, "m", "s") for i, (y, p) in enumerate([(0, .8), (0, .9), (1, .2), (1, .1)])], "id INT, label INT, prob DOUBLE, model STRING, split STRING")
    once = pr.auto_flip(df).orderBy("id")
    assert [round(r.prob, 6) for r in once.collect()] == [.2, .1, .8, .9]
    again = pr.auto_flip(once.drop("flipped")).orderBy("id")
    assert [round(r.prob, 6) for r in again.collect()] == [.2, .1, .8, .9]


def test_validation_errors(spark):
    rows = spark.createDataFrame([(None, None, None, None), (None, None, None, "not json"), ("x", 1, 1.5, None), ("x", 0, 0.5, None)], f"id STRING, label INT, prob DOUBLE, {CORRUPT} STRING")
    r = pr.validation_report(rows).first()
    assert (r.bad_json, r.missing_id, r.missing_label, r.missing_prob) == (1, 1, 1, 1)
    assert not r.valid and r.has_duplicates and r.out_of_range
    with pytest.raises(ValueError):
        pr.require_valid(rows)
    assert pr.require_valid(rows.filter("id IS NOT NULL")).count() == 2


def test_missing_head_is_an_error(spark, three_heads):
    path = work_dir(spark, "t")
    src.write_predictions(three_heads[1], three_heads[1].groupBy("model").count(), path)
    assert src.read_head(spark, path, "h3", "val").count() == 2
    with pytest.raises(FileNotFoundError):
        src.read_head(spark, path, "h3", "test")
    with pytest.raises(ValueError):
        src.select_files(three_heads[1], "odd")


def test_model_names(spark):
    df = spark.createDataFrame([("markup_large",), ("url",), ("fusion",), ("other",)], "m STRING")
    assert [r[0] for r in df.select(pr.model_name(F.col("m"))).collect()] == ["dom", "url", "fusion", "other"]
    assert spark.range(1).select(pr.model_of_folder(F.lit("js_codet5p"))).first()[0] == "js_code"


def test_gate(spark):
    schema = "model STRING, precision DOUBLE, fpr DOUBLE"
    base = spark.createDataFrame([("a", .9, .05), ("b", .9, .05)], schema)
    cur = spark.createDataFrame([("a", .89, .05), ("b", .7, .05), ("new", .1, .9)], schema)
    v = {r.model: r.passed for r in au.gate(cur, base, ["model"]).collect()}
    assert v == {"a": True, "b": False, "new": True}
    with pytest.raises(ValueError):
        au.require_gate(au.gate(cur, base, ["model"]))


def test_split_checks(spark):
    df = spark.createDataFrame([("train", 0)] * 3 + [("val", 1), ("val", 0)] * 6, "split STRING, label INT")
    v = {r.split: r.verdict for r in au.verify_splits(df).collect()}
    assert v == {"train": "warn_one_class", "val": "ok", "test": "empty"}
    with pytest.raises(ValueError):
        au.require_splits(df)
    with pytest.raises(ValueError):
        au.require_no_inflation(df.withColumn("id", F.lit(1)).limit(1), df.limit(1).select("split", F.explode(F.array(F.lit(1), F.lit(2))).alias("id")))


def test_first_and_last_row_in_one_pass(spark):
    rows = [("m", i % 3, i * 7 % 10, None if i % 4 == 0 else i, float(i)) for i in range(10)] + [("n", 0, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "model STRING, id INT, pos INT, label INT, prob DOUBLE")
    got = {(r.kept, r.model, r.id): (r.pos, r.label, r.prob) for r in pr.keep_ends(df, ["model", "id"], ["pos"]).collect()}
    want = {("n", 0): [(None, None, None)] * 2}
    for k in range(3):
        mine = sorted(r[2:] for r in rows if r[:2] == ("m", k))
        want["m", k] = [mine[0], mine[-1]]
    assert got == {(e, *k): v[i] for k, v in want.items() for i, e in enumerate(("first", "last"))}
    plan = pr.keep_ends(df, ["model", "id"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
