"""Log queries (E47-E49, F9, D16, D22, L3 and L4 in batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.operators import logs as lg
from pagerisk.operators.running import time_bucket
from pagerisk.plans.inputs import r6
from pagerisk.plans.registry import query

REQ = "SELECT user_id AS page_id, event_id, ts, event_type AS kind, 'h' || event_id % 17 AS host, 'h' || user_id % 17 AS own FROM events"


def req(t):
    return t("events").selectExpr("user_id AS page_id", "event_id", "ts", "event_type AS kind", "concat('h', event_id % 17) AS host", "concat('h', user_id % 17) AS own")


@query("e47_request_graph", f"""WITH r AS ({REQ}) SELECT page_id, count(*) FILTER (WHERE kind = 'click') AS clicks, count(*) FILTER (WHERE kind IN ('view', 'error')) AS views, count(DISTINCT host) AS req_unique_etld1, round(count(*) FILTER (WHERE host <> own)::DOUBLE / count(*), 4) AS req_thirdparty_ratio FROM r GROUP BY page_id""")
def _(t):
    return lg.request_graph(req(t), "page_id", "kind", "host", "own", {"clicks": ("click",), "views": ("view", "error")})


LAG = f"""WITH r AS ({REQ}), l AS (SELECT *, lag(host) OVER w AS ph, lag(ts) OVER w AS pt FROM r WINDOW w AS (PARTITION BY page_id ORDER BY ts, event_id))"""


@query("f9_host_transitions", LAG + " SELECT page_id, event_id, ph AS prev_host, coalesce(ph <> host, false) AS host_changed FROM l")
def _(t):
    return lg.with_host_change(req(t), "page_id", ["ts", "event_id"], time_bucket("ts"), "host").select("page_id", "event_id", "prev_host", "host_changed")


@query("e48_redirect_sketch", LAG + " SELECT page_id, count(*) - 1 AS redir_hops, max(datediff('microsecond', pt, ts) // 1000) AS redirect_max_ms, count(*) FILTER (WHERE ph <> host) AS redir_cross_host FROM l GROUP BY page_id")
def _(t):
    return lg.redirect_sketch(req(t), "page_id", "ts", "host", time_bucket("ts"), ["ts", "event_id"])


@query("e49_dns_rollup", "SELECT l_suppkey AS domain, min(CASE WHEN l_returnflag IN ('A', 'N') THEN l_partkey END) AS ttl_min, round(avg(CASE WHEN l_returnflag IN ('A', 'N') THEN l_partkey END), 6) AS ttl_mean, bool_or(l_returnflag = 'R') AS mx_present FROM lineitem GROUP BY l_suppkey")
def _(t):
    rec = t("lineitem").selectExpr("l_suppkey AS domain", "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'AAAA' ELSE 'MX' END AS rr", "l_partkey AS ttl")
    return lg.dns_rollup(rec, "domain", "rr", "ttl").withColumn("ttl_mean", F.round("ttl_mean", 6))


@query("d16_dimension_enrichment", """SELECT l_orderkey, l_linenumber, l_suppkey AS k, CASE WHEN l_linestatus = 'O' THEN 'own' WHEN l_returnflag = 'R' THEN s_name END AS registrar, CASE WHEN l_returnflag = 'R' THEN s_nationkey END AS ns_count FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def _(t):
    pages = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS k", "l_returnflag", "CASE WHEN l_linestatus = 'O' THEN 'own' END AS registrar")
    dim = t("supplier").selectExpr("s_suppkey AS k", "s_name AS registrar", "s_nationkey AS ns_count")
    return lg.enrich(pages, dim, "k", "l_orderkey", F.col("l_returnflag") == "R").drop("l_returnflag")


@query("d22_profile_delta", """WITH a AS (SELECT user_id, arg_max(value, ts) AS v, arg_max(props, ts) AS p FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, arg_max(value, ts) AS v, arg_max(props, ts) AS p FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, round(abs(a.v - b.v), 6) AS cloak_delta_domlen, a.p <> b.p AS cloak_profile_mismatch FROM a FULL JOIN b ON a.user_id = b.user_id""")
def _(t):
    out = lg.profile_delta(t("events"), "user_id", "event_type", ("view", "click"), "value", "props", "ts")
    return out.withColumn("cloak_delta_domlen", F.round("cloak_delta_domlen", 6))


CRAWL = "SELECT event_id, ts, user_id AS etld1, CASE event_type WHEN 'error' THEN 'timeout' ELSE 'ok' END AS outcome FROM events"


def crawl(t):
    return t("events").selectExpr("event_id", "ts", "user_id AS etld1", "CASE event_type WHEN 'error' THEN 'timeout' ELSE 'ok' END AS outcome")


@query("l3_breaker_batch", f"WITH c AS ({CRAWL}) SELECT event_id, etld1, outcome, coalesce(sum(CASE WHEN outcome = 'timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY etld1 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS blocked FROM c")
def _(t):
    return lg.breaker(crawl(t), "etld1", "outcome", ["ts", "event_id"], time_bucket("ts"), 5).select("event_id", "etld1", "outcome", "blocked")


@query("l4_progress_batch", f"WITH c AS ({CRAWL}) SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, outcome, count(*) AS n FROM c GROUP BY ALL")
def _(t):
    return lg.progress(crawl(t), "ts", "outcome", "10 minutes")
