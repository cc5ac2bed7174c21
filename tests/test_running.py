import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagerisk.operators.predictions import keep_one
from pagerisk.operators.quantiles import quantiles
from pagerisk.operators.running import hash_ranked, int_bucket, lagged, ranked, running_totals
from pagerisk.operators.joins import salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    keys = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 50, n).astype(str))
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(n) * 37, "v": rng.integers(0, 9, n), "h": rng.integers(0, 3, n).astype(str)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("down", [False, True])
def test_running_totals(skewed, down):
    pdf, df = skewed
    got = running_totals(df, ["k"], ["t"], int_bucket("t", 1000), ["v"], down).toPandas().sort_values("t")
    want = pdf.sort_values("t", ascending=not down)
    want["b"] = want.groupby("k").v.cumsum() - want.v
    want = want.sort_values("t")
    assert (got.before_v.values == want.b.values).all()
    assert (got.total_v.values == want.groupby("k").v.transform("sum").values).all()


def test_ranked_and_lagged(skewed):
    pdf, df = skewed
    want = pdf.sort_values("t")
    got = ranked(df, ["k"], ["t"], int_bucket("t", 1000)).toPandas().sort_values("t")
    assert (got["rank"].values == (want.groupby("k").cumcount() + 1).values).all()
    lag = lagged(df, ["k"], ["t"], int_bucket("t", 1000), ["h"]).toPandas().sort_values("t")
    prev = want.groupby("k").h.shift()
    assert [a for a in lag.prev_h] == [None if pd.isna(b) else b for b in prev]


def test_hash_rank_is_a_permutation_and_repeatable(skewed):
    _, df = skewed
    a = {r.t: r["rank"] for r in hash_ranked(df, "t", 7).collect()}
    b = {r.t: r["rank"] for r in hash_ranked(df.repartition(13), "t", 7).collect()}
    assert a == b and sorted(a.values()) == list(range(1, len(a) + 1))


def test_keep_one_and_salted_join(skewed, spark):
    pdf, df = skewed
    first = keep_one(df, ["k"], ["t"]).toPandas().set_index("k").t
    assert first.to_dict() == pdf.groupby("k").t.min().to_dict()
    dim = df.groupBy("k").agg(F.max("v").alias("m")).filter("k <> '3'")
    a = salted_join(df, dim, ["k"], "t").select("t", "m").toPandas().sort_values("t")
    b = df.join(dim, "k", "left").select("t", "m").toPandas().sort_values("t")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], list(np.random.default_rng(2).normal(size=501) * 1e4), [0.5] * 40 + [0.1, 0.9, -3.0]])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.prob: r.quantile for r in quantiles(df, [], "v", probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))
