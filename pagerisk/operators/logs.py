"""Request, redirect and DNS logs; dimension enrichment; crawl profiles (E47-E49, F9, D16, D22, L3, L4 batch forms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.operators.joins import salted_join
from pagerisk.operators.predictions import keep_one
from pagerisk.operators.running import lagged, running_totals

# Resource types counted per page.
BUCKETS = {"req_counts_script": ("script",), "req_counts_css": ("stylesheet",), "req_counts_xhr": ("xhr", "fetch"), "req_counts_img": ("image",)}


def request_graph(log: DataFrame, key: str, kind: str, domain: str, own_domain: str, buckets: dict[str, tuple[str, ...]] = BUCKETS) -> DataFrame:
    """Requests by type, distinct contacted domains and the third-party share per page.

    Rows are reduced per (page, domain, type) first, so a page with many
    requests stays cheap.
    """
    cells = log.groupBy(key, domain, own_domain, kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.coalesce(F.col(domain), F.lit("")) != ""
    other = F.sum(F.when(known & (F.col(domain) != F.col(own_domain)), F.col("n")).otherwise(F.lit(0)))
    total = F.sum(F.when(known, F.col("n")).otherwise(F.lit(0)))
    return cells.groupBy(key).agg(
        *[F.sum(F.when(F.col(kind).isin(*types), F.col("n")).otherwise(F.lit(0))).alias(name) for name, types in buckets.items()],
        F.count_distinct(F.when(known, F.col(domain))).alias("req_unique_etld1"),
        F.round(other / F.greatest(F.lit(1), total), 4).alias("req_thirdparty_ratio"),
    )


def with_host_change(log: DataFrame, key: str, order: Sequence[str], bucket: Column, host: str) -> DataFrame:
    """did the host change since the previous document of the page?"""
    out = lagged(log, [key], order, bucket, [host, *[o for o in order if o != host]])
    prev = F.col(f"prev_{host}")
    changed = prev.isNotNull() & (prev != "") & (F.col(host) != "") & (prev != F.col(host))
    return out.withColumn("host_changed", F.coalesce(changed, F.lit(False)))


def redirect_sketch(log: DataFrame, key: str, ts: str, host: str, bucket: Column, order: Sequence[str]) -> DataFrame:
    """Hops, longest gap in milliseconds and cross-host transitions per page."""
    steps = with_host_change(log, key, order, bucket, host)
    gap = F.timestamp_diff("MILLISECOND", F.col(f"prev_{ts}"), F.col(ts))
    return steps.groupBy(key).agg(
        (F.count(F.lit(1)) - 1).alias("redir_hops"), F.max(gap).alias("redirect_max_ms"),
        F.count_if("host_changed").alias("redir_cross_host"))


def dns_rollup(records: DataFrame, key: str, rrtype: str, ttl: str) -> DataFrame:
    """Least and mean TTL over address records, mail records present."""
    address = F.when(F.col(rrtype).isin("A", "AAAA"), F.col(ttl))
    return records.groupBy(key).agg(F.min(address).alias("ttl_min"), F.avg(address).alias("ttl_mean"), F.bool_or(F.col(rrtype) == "MX").alias("mx_present"))


def enrich(pages: DataFrame, dim: DataFrame, key: str, row_key: str, when: Column | None = None) -> DataFrame:
    """Non-null dimension values fill missing page columns; popular keys are salted.

    ``dim`` holds one row per key; ``when`` limits it to some rows (https only).
    """
    columns = [c for c in dim.columns if c != key]
    renamed = dim.select(key, *[F.col(c).alias(f"_dim_{c}") for c in columns])
    j = salted_join(pages, renamed, [key], row_key)
    use = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    have = set(pages.columns)
    fill = {c: F.coalesce(F.col(c), F.when(use, F.col(f"_dim_{c}"))) if c in have else F.when(use, F.col(f"_dim_{c}")) for c in columns}
    return j.withColumns(fill).drop(*[f"_dim_{c}" for c in columns])


def profile_delta(crawls: DataFrame, key: str, profile: str, names: tuple[str, str], length: str, kind: str, latest: str) -> DataFrame:
    """The two latest crawls of a page by profile compared; one aggregate, no self join."""
    pick = lambda c, p: F.max_by(F.when(F.col(profile) == p, F.col(c)), F.when(F.col(profile) == p, F.col(latest)))
    a, b = names
    return crawls.filter(F.col(profile).isin(a, b)).groupBy(key).agg(
        F.abs(pick(length, a) - pick(length, b)).alias("cloak_delta_domlen"), (pick(kind, a) != pick(kind, b)).alias("cloak_profile_mismatch"))


def breaker(log: DataFrame, key: str, outcome: str, order: Sequence[str], bucket: Column, limit: int) -> DataFrame:
    """L3, batch form: rows of a domain after its first ``limit`` timeouts are blocked."""
    flagged = log.withColumn("_t", (F.col(outcome) == "timeout").cast("long"))
    run = running_totals(flagged, [key], order, bucket, ["_t"])
    return run.withColumn("blocked", F.col("before__t") >= limit).drop("_t", "before__t", "total__t")


def progress(log: DataFrame, ts: str, outcome: str, width: str = "10 seconds") -> DataFrame:
    """L4, batch form: outcomes per time window."""
    return log.groupBy(F.window(F.col(ts), width).alias("w"), outcome).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), outcome, "n")


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key."""
    return keep_one(log, keys, order, last=True)
