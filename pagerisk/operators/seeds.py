"""Building the labelled seed: first-seen dedup, allocation, fair share, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerisk.functions import urls as u
from pagerisk.operators.joins import settled
from pagerisk.operators.predictions import keep_one
from pagerisk.operators.running import even_bucket, hash_ranked, place_bucket, ranked


def first_seen(rows: DataFrame, key: str = "url", order: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """one row per URL, the first in source order."""
    return keep_one(rows, [key], order)


def limit_per_source(rows: DataFrame, limits: dict[str, int] | DataFrame, pos: str = "pos") -> DataFrame:
    """The first n rows of each source by position; sources without a limit stay whole.

    ``limits`` by source name, or as a table (source, quota).
    """
    r = ranked(rows, ["source"], [pos], place_bucket(rows, pos)).drop("rank_of")
    if isinstance(limits, dict):
        limits = rows.sparkSession.createDataFrame(list(limits.items()), "source STRING, quota BIGINT")
    return r.join(limits.select("source", "quota"), "source", "left").filter("quota IS NULL OR rank <= quota").select(*r.columns)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Every row with its place in a seeded order."""
    return hash_ranked(rows, key, seed, name="place").drop("place_of")


def allocation(counts: DataFrame, bad: Sequence[str], benign: str, size: int, ratio: float) -> DataFrame:
    """Rows to take from each source, (source, quota), for a target size and share of bad rows.

    ``counts`` has one row per source (source, n). Any number of bad sources
    share the bad rows in proportion: the quota of each is the rounded running
    share up to it less that before it, so quotas add up and none exceeds its
    source. A want beyond all bad rows takes them all; the rest is benign.
    """
    want = round(size * min(max(ratio, 0.0), 1.0))
    place = F.array_position(F.array(*map(F.lit, bad)), F.col("source"))
    whole = Window.partitionBy(F.lit(0))  # one row per bad source
    until = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    shared = counts.withColumn("_place", place).filter("_place > 0").withColumns({"_all": F.sum("n").over(whole), "_until": F.sum("n").over(until)})
    upto = lambda n: F.bround(F.least(F.lit(want), F.col("_all")) * (n / F.greatest(F.col("_all"), F.lit(1)))).cast("long")
    quotas = shared.select("source", (upto(F.col("_until")) - upto(F.col("_until") - F.col("n"))).alias("quota"))
    rest = counts.filter(F.col("source") == benign).select("source", F.least(F.lit(max(size - want, 0)).cast("long"), F.col("n")).alias("quota"))
    return quotas.unionByName(rest)


def source_counts(rows: DataFrame) -> DataFrame:
    """Rows per source and label."""
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


def allocate(rows: DataFrame, bad: Sequence[str], benign: str, size: int, ratio: float) -> DataFrame:
    """The first rows of each source up to its allocation."""
    counts = rows.filter(F.col("source").isin(*bad, benign)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return limit_per_source(rows, allocation(counts, bad, benign, size, ratio))


def fair_share(rows: DataFrame, existing: DataFrame | None, sources: int, limit: int, refill: int = 500) -> DataFrame:
    """Up to ``limit`` unseen URLs, an equal first chunk per source, then refills in turns.

    ``rows``: url, source, source_rank, pos. The turn follows from the rank in
    the source, a URL goes to the earliest (turn, source, rank), and the
    global rank in that order is cut at the limit, the only bound there is.
    """
    fresh = rows if existing is None else rows.join(existing.select("url").distinct(), "url", "left_anti")
    chunk = max(1, limit // sources)
    r = ranked(fresh, ["source"], ["pos"], place_bucket(rows, "pos"))
    turn = F.when(F.col("rank") <= chunk, 0).otherwise(1 + F.floor((F.col("rank") - chunk - 1) / F.lit(refill)))
    timed = r.withColumn("turn", turn.cast("long")).drop("rank_of")
    order = (F.col("turn") * sources + F.col("source_rank")) * F.lit(1 << 40) + F.col("rank")
    unique = settled(keep_one(timed.withColumn("_order", order), ["url"], ["_order"]), "fair-share")
    out = ranked(unique, [], ["_order"], even_bucket(unique, "_order"), "place")
    return out.filter(F.col("place") <= limit).drop("_order", "place_of", "rank")


def incremental_need(existing: int, target: int, ratio: float) -> tuple[int, int]:
    """Bad and benign rows still missing."""
    need = max(0, target - existing)
    bad = int(need * ratio)
    return bad, need - bad


def unseen_sites(sites: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """Per ranked domain the first of https / http not seen yet, the n best ranked of them."""
    pair = F.array(*[F.struct(F.lit(i).alias("try"), u.canonical(F.concat(F.lit(f"{s}://"), "domain", F.lit("/"))).alias("url")) for i, s in enumerate(("https", "http"))])
    tries = sites.select("domain", "rank", F.inline(pair)).join(existing.select("url").distinct(), "url", "left_anti")
    first = tries.groupBy("domain").agg(F.min_by("url", "try").alias("url"), F.min("rank").alias("rank"))
    first = settled(first, "unseen-sites")
    r = ranked(first, [], ["rank", "domain"], even_bucket(first, "rank"), "place")
    return r.filter(F.col("place") <= n).select("domain", "url", "rank")


def gather_mixed(rows: DataFrame, sites: DataFrame, existing: DataFrame, sources: int, target: int, ratio: float, overshoot: int = 0) -> DataFrame:
    """Bad URLs by fair share, benign ones from the ranked sites, shortfall topped up to the overshoot limit."""
    bad, benign = incremental_need(existing.count(), target, ratio)
    got = fair_share(rows, existing, sources, bad + overshoot)
    capped = got.filter(F.col("place") <= bad + overshoot).select("url", F.lit(1).alias("label"), "source")
    good = unseen_sites(sites, existing, benign).select("url", F.lit(0).alias("label"), F.lit("ranked").alias("source"))
    return capped.unionByName(good)


def below_minimum(rows: DataFrame, minimum: int) -> bool:
    """Should the incremental step run? A count, which Parquet answers from its footers."""
    return rows.count() < minimum


def new_rows(batch: DataFrame, master: DataFrame, key: Column, master_key: Column, order: Sequence[str]) -> DataFrame:
    """Rows whose key the master lacks, one per key."""
    keyed = batch.withColumn("_key", key).filter("_key IS NOT NULL AND _key <> ''")
    seen = master.select(master_key.alias("_key")).distinct()
    return keep_one(keyed.join(seen, "_key", "left_anti"), ["_key"], order).drop("_key")


def resume(seed: DataFrame, done: DataFrame) -> DataFrame:
    """Seeds whose URL is not crawled yet."""
    return seed.join(done.select("url").distinct(), "url", "left_anti")


def add_hard_negatives(train: DataFrame, seeds: DataFrame, pool: DataFrame, order: Sequence[str] = ("file_rank",)) -> DataFrame:
    """Train plus the pool rows of the seeds, first file wins, label forced to 0, provenance added."""
    wanted = seeds.join(train.select("id").distinct(), "id", "left_anti")
    source = keep_one(pool.join(wanted.select("id").distinct(), "id", "left_semi"), ["id"], order)
    added = source.drop("label").join(wanted, "id").withColumns({
        "label": F.lit(0), "hard_negative": F.lit(True), "hard_negative_cluster": F.col("cluster"),
        "hard_negative_reason": F.coalesce("reason", F.lit("benign_cluster_pattern")), "hard_negative_source_split": F.col("split")})
    return train.unionByName(added.drop("cluster", "reason", *order), allowMissingColumns=True)


def missing_seeds(train: DataFrame, seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """Seeds neither in train nor in the pool."""
    return seeds.join(train.select("id").distinct(), "id", "left_anti").join(pool.select("id").distinct(), "id", "left_anti")
