import bz2
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerisk.operators import seeds as sd
from pagerisk.operators import splits as sp
from pagerisk.operators.running import even_bucket, ranked
from pagerisk.session import work_dir
from pagerisk.sources import feeds as fd


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 2000
    group = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 80, n))  # one group owns a third
    label = (rng.random(n) < np.where(group % 3 == 0, 0.5, 0.1)).astype(int)
    data = [(i, int(group[i]), int(label[i]), int(rng.integers(0, 1000))) for i in range(n)]
    df = spark.createDataFrame(data, "id INT, g INT, label INT, s INT").select("id", "g", "label", F.timestamp_seconds("s").alias("ts"))
    return df


def cut():
    return F.timestamp_seconds(F.lit(800))


@pytest.mark.parametrize("target", [None, 0.3])
def test_train_and_val_share_no_group(rows, target):
    out = sp.label_aware_split(rows, "g", "ts", cut(), 0.2, target=target)
    assert out.count() == rows.count() and sp.group_overlap(out, "g").first().train_val == 0
    assert out.filter((F.col("split") == "test") != (F.col("ts") > cut())).count() == 0
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val", "test"}


def test_time_group_split_is_stable_over_partitions(rows):
    a = sp.time_group_split(rows, "g", "ts", cut()).select("id", "split")
    b = sp.time_group_split(rows.repartition(11), "g", "ts", cut()).select("id", "split")
    assert a.exceptAll(b).count() == 0 and sp.group_overlap(a.join(rows, "id"), "g").first().train_val == 0
    strict = sp.time_group_split(rows, "g", "ts", cut(), strict_groups=True)
    assert sp.group_overlap(strict, "g").first().test_early == 0


def test_subsets_folds_and_extension(rows):
    sub = sp.balanced_subset(rows, 100)
    assert sorted(r["count"] for r in sub.groupBy("label").count().collect()) == [100, 100]
    with pytest.raises(ValueError):
        sp.balanced_subset(rows, 10**6)
    sizes = [r["count"] for r in sp.folds(rows, 4).groupBy("label", "fold").count().groupBy("label").agg(F.max("count").alias("a"), F.min("count").alias("count")).collect()]
    assert len(sizes) == 2
    base = rows.filter("id < 500").select("id", F.lit("train").alias("split"))
    once = sp.extend_splits(base, rows)
    assert once.count() == 2000 and sp.extend_splits(once, rows).count() == 2000


def test_empty_input(spark, rows):
    none = rows.limit(0)
    assert sp.time_group_split(none, "g", "ts", cut()).count() == 0
    assert sp.stratified_split(none, 0.2, 0.1).count() == 0


def test_allocation_is_proportional(spark):
    def quotas(counts, bad, size, ratio):
        table = spark.createDataFrame(list(counts.items()), "source STRING, n BIGINT")
        return {r.source: r.quota for r in sd.allocation(table, bad, "r", size, ratio).collect()}

    assert quotas({"a": 10, "b": 100, "r": 500}, ["a", "b"], 200, 0.5) == {"a": 9, "b": 91, "r": 100}
    assert quotas({"a": 10, "b": 5, "r": 3}, ["a", "b"], 100, 0.9) == {"a": 10, "b": 5, "r": 3}
    got = quotas({"a": 7, "b": 0, "c": 50, "d": 3, "r": 9}, ["d", "c", "a", "b"], 40, 0.75)
    assert got["a"] + got["b"] + got["c"] + got["d"] == 30 and got["b"] == 0 and got["c"] in (24, 25) and got["r"] == 9
    assert sd.incremental_need(90, 100, 0.5) == (5, 5) and sd.incremental_need(200, 100, 0.5) == (0, 0)


def test_feeds_of_all_kinds_go_through_the_seed_steps(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "rank,url\n" + "".join(f"{i},http://zip{i}/\n" for i in range(30)))
    (tmp_path / "t.txt").write_text("".join(f"http://text{i}/\n" for i in range(20)) + "http://zip3/\n")
    (tmp_path / "c.csv").write_text("url,label\n" + "".join(f"http://csv{i}/,0\n" for i in range(40)))
    parts = [fd.tagged(fd.read_urls(spark, str(tmp_path / f)), name, label, rank) for rank, (name, f, label) in enumerate((("zip", "z.zip", 1), ("text", "t.txt", 1), ("csv", "c.csv", 0)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert sd.first_seen(rows).count() == 90
    limited = sd.limit_per_source(rows, {"zip": 2, "text": 1}).collect()
    assert sorted(r.url for r in limited if r.source != "csv") == ["http://text0/", "http://zip0/", "http://zip1/"] and len(limited) == 43
    taken = sd.allocate(rows, ["zip", "text"], "csv", 20, 0.5).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in taken} == {"zip": 6, "text": 4, "csv": 10}
    shared = sd.fair_share(rows, None, 3, 85, refill=1).collect()
    assert len(shared) == 85 and max(r.turn for r in shared) > 6


def test_sparse_positions_fill_few_buckets(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("pos"), F.lit("s").alias("source"))
    bucket = even_bucket(rows, "pos", rows=100)
    sizes = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200
    order = [r.pos for r in ranked(rows, ["source"], ["pos"], bucket).orderBy("rank").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("groups,target", [(30_000, 0.3), (40, 0.5), (1, 0.2)])
def test_ratio_split_has_one_algorithm(spark, groups, target):
    # Sizes and positives make nearly every group a shape of its own.
    df = spark.range(groups).selectExpr("id AS g", "CAST(1 + id % 211 AS BIGINT) AS n", "CAST((id * 7919) % (2 + id % 211) AS BIGINT) AS pos")
    rows = df.selectExpr("g", "explode(sequence(1, CAST(n AS INT))) AS k", "pos").selectExpr("g", "CAST(k <= pos AS INT) AS label") if groups < 100 else None
    if rows is None:
        stats, sp_stats = df, sp.group_stats
        sp.group_stats = lambda *_: stats
    try:
        got = sp.val_groups_for_ratio(rows if rows is not None else df, "g", 0.1, target, min_pos=3)
        both = df.join(got, "g").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("in_val"), F.col("n"))).alias("n"), F.sum(F.when(F.col("in_val"), F.col("pos"))).alias("pos")).first()
    finally:
        if rows is None:
            sp.group_stats = sp_stats
    assert got.count() == groups and both.n > 0
    if groups > 1:
        assert abs(both.pos / both.n - target) < (0.01 if groups > 100 else 0.2) and abs(both.n / both["all"] - 0.1) < (0.01 if groups > 100 else 0.15)


def test_feed_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "list.zip", "w") as z:
        z.writestr("z.txt", "ignored.com\n")
        z.writestr("a.csv", "rank,Domain\n1,one.com\n2,two.com\n")
    assert [r.url for r in fd.read_urls(spark, str(tmp_path / "list.zip")).orderBy("pos").collect()] == ["one.com", "two.com"]
    (tmp_path / "f.txt").write_text("url\nhttp://a\n\nhttp://b\n")
    assert [r.url for r in fd.read_urls(spark, str(tmp_path / "f.txt")).orderBy("pos").collect()] == ["http://a", "http://b"]
    (tmp_path / "g.csv").write_bytes(b'id,URL\n1,"http://x/a,b"\n2, http://y \n')
    assert [r.url for r in fd.read_urls(spark, str(tmp_path / "g.csv")).orderBy("pos").collect()] == ["http://x/a,b", "http://y"]
    (tmp_path / "h.csv.bz2").write_bytes(bz2.compress(b"url,label\nhttp://q,1\n"))
    assert [r.url for r in fd.read_urls(spark, str(tmp_path / "h.csv.bz2")).collect()] == ["http://q"]
    (tmp_path / "b.txt").write_text("# c\n0.0.0.0 bad.com\n||Worse.org^\nnodot\ntwo words.com\n")
    assert {r.url for r in fd.blocklist(fd.read_lines(spark, str(tmp_path / "b.txt"))).collect()} == {"http://bad.com/", "http://worse.org/"}


class Fake:
    """A session that answers the two questions asked of it."""

    def __init__(self, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, master, f"app-{master}"

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" else default


def test_work_dir_follows_the_session():
    assert work_dir(Fake("hdfs://shared/tmp/", "spark://m:7077"), "x").startswith("hdfs://shared/tmp/x-")
    with pytest.raises(ValueError):
        work_dir(Fake(None, "spark://m:7077"), "x")
    a, b = work_dir(Fake(None, "local[2]"), "x"), work_dir(Fake(None, "local[2]"), "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
