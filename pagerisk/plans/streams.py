"""Streaming queries (L1-L6): the given tables as file streams, results read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagerisk.functions import urls as u
from pagerisk.plans.registry import query
from pagerisk.session import work_dir
from pagerisk.streaming import jobs


def stream(t, name):
    """A given table as a file stream; the pattern matches its one file."""
    return jobs.read_files(t.spark, f"{t.sf_dir}/{name[:-1]}[{name[-1]}].parquet", t(name).schema)


def outcomes(df):
    return df.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS etld1", "CASE event_type WHEN 'error' THEN 'timeout' ELSE 'ok' END AS outcome")


@query("l1_streaming_ingest", "SELECT lower(regexp_extract(url, '^([^?#]*)', 1)) AS k, count(*) AS n FROM (SELECT DISTINCT lower(regexp_extract(url, '^([^?#]*)', 1)) AS url FROM pages WHERE url NOT LIKE '%/fr/%') GROUP BY 1")
def _(t):
    base = work_dir(t.spark, "ingest")
    short = F.lower(F.regexp_extract("url", "^([^?#]*)", 1))
    old = t("pages").filter("url LIKE '%/fr/%'").select("page_id", "url")
    old.write.parquet(f"{base}/master/batch=-1")
    for attempt in range(2):
        known = jobs.read_files(t.spark, f"{base}/master/batch=-1", old.schema)
        jobs.ingest(stream(t, "pages").select("page_id", "url"), f"{base}/master", f"{base}/log", f"{base}/checkpoint", short, ["page_id"], known)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("batch", T.LongType())])
    rows = t.spark.read.schema(schema).parquet(f"{base}/master").filter("batch >= 0")
    return rows.groupBy(short.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("l2_streaming_unique_urls", "SELECT user_id AS url, count(DISTINCT user_id) AS n FROM events GROUP BY user_id")
def _(t):
    base = work_dir(t.spark, "unique")
    rows = stream(t, "events").selectExpr("user_id AS url", "CAST(ts AS TIMESTAMP) AS ts")
    jobs.unique_urls(rows, f"{base}/out", f"{base}/checkpoint", "ts", delay="60 days")
    return t.spark.read.parquet(f"{base}/out").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("l3_streaming_breaker", "SELECT user_id AS etld1, count(*) AS timeouts, count(*) >= 14 AS blocked FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(t):
    base = work_dir(t.spark, "breaker")
    jobs.upsert(jobs.breaker_counts(outcomes(stream(t, "events")), "etld1", "outcome", 14), f"{base}/out", f"{base}/checkpoint", ["etld1"])
    return jobs.newest(t.spark, f"{base}/out", ["etld1"])


@query("l4_streaming_progress", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CASE event_type WHEN 'error' THEN 'timeout' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    base = work_dir(t.spark, "progress")
    jobs.upsert(jobs.progress_counts(outcomes(stream(t, "events")), "ts", "outcome", "1 hour"), f"{base}/out", f"{base}/checkpoint", ["window_start", "outcome"])
    return jobs.newest(t.spark, f"{base}/out", ["window_start", "outcome"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "outcome", "n")


@query("l5_streaming_split_extension", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'train' WHEN event_type = 'click' THEN 'val' ELSE 'test' END AS split FROM events")
def _(t):
    base = work_dir(t.spark, "extend")
    known = t("events").filter("event_type IN ('view', 'click')").selectExpr("event_id AS id", "CASE WHEN event_type = 'view' THEN 'train' ELSE 'val' END AS split")
    known.write.parquet(f"{base}/splits/batch=-1")
    jobs.extend_test_split(stream(t, "events").selectExpr("event_id AS id"), f"{base}/splits", f"{base}/checkpoint", known=jobs.read_files(t.spark, f"{base}/splits/batch=-1", known.schema))
    return t.spark.read.parquet(f"{base}/splits").select("id", "split")


@query("l6_streaming_kpis", "SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 200")
def _(t):
    base = work_dir(t.spark, "kpi")
    jobs.append_kpis(stream(t, "events").select("event_id", "ts", "value"), f"{base}/out", f"{base}/checkpoint")
    return jobs.recent_kpis(t.spark, f"{base}/out")
