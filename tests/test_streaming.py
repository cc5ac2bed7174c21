from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagerisk.functions import urls as u
from pagerisk.operators import logs as lg
from pagerisk.operators.running import time_bucket
from pagerisk.streaming import jobs

URLS = T.StructType([T.StructField("url", T.StringType()), T.StructField("pos", T.IntegerType())])
LOG = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("etld1", T.StringType()), T.StructField("outcome", T.StringType())])


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_over_several_files_and_runs(spark, tmp_path):
    src, master, log, ck = (str(tmp_path / n) for n in ("in", "master", "log", "ck"))
    key = u.dedup_key("raw", F.col("url"), F.col("url"))

    def go():
        jobs.ingest(jobs.read_files(spark, src, URLS, 1), master, log, ck, key, ["pos"])
        return sorted(r.url for r in spark.read.parquet(master).collect())

    put(spark, src, [("http://A", 1), ("http://a ", 2), ("http://b", 3), ("", 4)], URLS)
    put(spark, src, [("HTTP://B", 5), ("http://c", 6)], URLS)
    first = go()
    assert len(first) == 3 and go() == first
    put(spark, src, [("http://c", 7), ("http://d", 8)], URLS)
    assert len(go()) == 4
    totals = spark.read.parquet(log).agg(F.sum("scanned"), F.sum("added"), F.sum("blank")).first()
    assert tuple(totals) == (8, 4, 1)


def test_ingest_replays_a_batch_and_knows_the_rows_before(spark, tmp_path):
    """A batch whose commit was lost runs again with the same result; earlier rows come as a stream of their own."""
    src, old, master, log, ck = (str(tmp_path / n) for n in ("in", "old", "master", "log", "ck"))
    put(spark, old, [("http://a", 0), ("http://z", 0)], URLS)
    put(spark, src, [("http://a", 1), ("http://b", 3), ("http://b", 2)] + [("http://hot", 9)] * 500 + [(None, 5)], URLS)

    def go():
        jobs.ingest(jobs.read_files(spark, src, URLS, 1), master, log, ck, F.col("url"), ["pos"], jobs.read_files(spark, old, URLS))
        return sorted(tuple(r) for r in spark.read.parquet(master).select("url", "pos").collect())

    assert go() == [("http://b", 2), ("http://hot", 9)]
    put(spark, src, [("http://b", 1), ("http://c", 7)], URLS)
    want = [("http://b", 2), ("http://c", 7), ("http://hot", 9)]
    assert go() == want
    for commit in sorted((tmp_path / "ck" / "commits").iterdir()):
        if commit.name.strip(".").split(".")[0] == "1":
            commit.unlink()
    assert go() == want
    assert tuple(spark.read.parquet(log).agg(F.sum("scanned"), F.sum("added"), F.sum("blank")).first()) == (506, 3, 1)


def test_history_is_compacted_and_domains_are_forgotten(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("log", "out", "ck"))
    for part in range(7):
        put(spark, src, [(at(part * 10 + i), f"d{i % 2}", "timeout") for i in range(4)], LOG)
    jobs.upsert(jobs.breaker_counts(jobs.read_files(spark, src, LOG, 1), "etld1", "outcome", 10), out, ck, ["etld1"], every=3)
    assert {tuple(r) for r in jobs.newest(spark, out, ["etld1"]).collect()} == {("d0", 14, True), ("d1", 14, True)}
    kept = [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert sum(k.startswith("base=") for k in kept) == 1 and len(kept) <= 5
    late, lo, lc = (str(tmp_path / n) for n in ("late", "lo", "lc"))
    put(spark, late, [(at(s), "d", "timeout") for s in (0, 10, 20)], LOG)
    put(spark, late, [(at(s), "d", "timeout") for s in (500, 505)], LOG)
    counts = jobs.breaker_counts(jobs.read_files(spark, late, LOG), "etld1", "outcome", 3, "ts", "1 minute")
    jobs.upsert(counts, lo, lc, ["etld1", "since"])
    assert sorted((r.timeouts, r.blocked) for r in jobs.newest(spark, lo, ["etld1", "since"]).collect()) == [(2, False), (3, True)]


def at(s):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_breaker_and_progress_equal_their_batch_forms(spark, tmp_path):
    src = str(tmp_path / "log")
    for part in range(3):
        put(spark, src, [(at(part * 100 + i * 3), f"d{i % 3}", "timeout" if i % 2 else "ok") for i in range(30)], LOG)
    batch = spark.read.parquet(src)
    jobs.upsert(jobs.breaker_counts(jobs.read_files(spark, src, LOG, 1), "etld1", "outcome", 10), str(tmp_path / "b"), str(tmp_path / "bc"), ["etld1"])
    got = {(r.etld1, r.timeouts, r.blocked) for r in jobs.newest(spark, str(tmp_path / "b"), ["etld1"]).collect()}
    want = {(r.etld1, r.n, r.n >= 10) for r in batch.filter("outcome = 'timeout'").groupBy("etld1").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
    jobs.upsert(jobs.progress_counts(jobs.read_files(spark, src, LOG, 1), "ts", "outcome"), str(tmp_path / "p"), str(tmp_path / "pc"), ["window_start", "outcome"])
    a = jobs.newest(spark, str(tmp_path / "p"), ["window_start", "outcome"])
    assert sorted(map(tuple, a.select("window_start", "outcome", "n").collect())) == sorted(map(tuple, lg.progress(batch, "ts", "outcome").collect()))
    blocked = lg.breaker(batch, "etld1", "outcome", ["ts", "outcome"], time_bucket("ts"), 10)
    assert blocked.filter("blocked").count() > 0 and blocked.count() == 90


def test_split_extension_and_unique_urls(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "s")
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    put(spark, src, [(1,), (2,), (2,)], schema)
    split = spark.createDataFrame([(1, "train")], "id INT, split STRING")
    split.write.parquet(f"{out}/batch=-1")
    go = lambda: jobs.extend_test_split(jobs.read_files(spark, src, schema, 1), out, str(tmp_path / "c"), known=jobs.read_files(spark, f"{out}/batch=-1", split.schema))
    for _ in range(2):
        go()
    put(spark, src, [(3,), (2,)], schema)
    go()
    assert sorted((r.id, r.split) for r in spark.read.parquet(out).collect()) == [(1, "train"), (2, "test"), (3, "test")]
    feed = str(tmp_path / "feed")
    put(spark, feed, [(at(i), f"u{i % 4}", "ok") for i in range(20)], LOG)
    jobs.unique_urls(jobs.read_files(spark, feed, LOG), str(tmp_path / "u"), str(tmp_path / "uc"), "ts", "etld1")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4
