"""Cascades: accept early where a cheap head is sure, search thresholds under a cost model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.functions.mathx import mean_of
from pagerisk.operators import metrics as m
from pagerisk.operators.joins import settled
from pagerisk.operators.predictions import keep_one
from pagerisk.operators.quantiles import quantile_grid

# Relative inference cost of each head.
HEAD_COSTS = {"url_head": 1.0, "text_head": 5.0, "js_charcnn": 8.0, "js_charcnn_aug": 8.0, "js_codet5p": 60.0, "fusion": 2.0}
MIDPOINT_GAP = 1e-6


def cascade_thresholds(val: DataFrame, score: str = "prob", precision: float = 0.99, benign_precision: float = 0.995, mode: str = "first") -> tuple[float, float]:
    """K1: accept-as-bad and accept-as-benign cuts on validation rows; crossing cuts meet in the middle."""
    both = val.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    if not both.pos or not both.neg:
        return 0.0, 1.0
    side = F.array(
        F.struct(F.lit("hi").alias("side"), F.col(score).alias("prob"), F.col("label").alias("label")),
        F.struct(F.lit("lo").alias("side"), (F.lit(1.0) - F.col(score)).alias("prob"), (1 - F.col("label")).alias("label")),
    )
    curve = m.score_curve(val.select(F.inline(side)), ["side"])
    target = F.when(F.col("side") == "hi", F.lit(precision)).otherwise(F.lit(benign_precision))
    ok = F.when(m.precision_at() >= target, F.col("score"))
    pick = F.max(ok) if mode == "first" else F.min(ok)
    cut = {r.side: r.t for r in curve.groupBy("side").agg(F.coalesce(pick, F.lit(1.0)).alias("t")).collect()}
    hi, lo = cut.get("hi", 1.0), 1.0 - cut.get("lo", 1.0)
    if lo >= hi:
        mid = 0.5 * (lo + hi)
        lo, hi = max(0.0, mid - MIDPOINT_GAP), min(1.0, mid + MIDPOINT_GAP)
    return lo, hi


def resolved(score: Column, lo: float, hi: float) -> Column:
    return (score >= hi) | (score <= lo)


def apply_cascade(rows: DataFrame, first: str, fused: str, lo: float, hi: float) -> DataFrame:
    """K1: the first-stage score where accepted, the fused one elsewhere."""
    return rows.withColumn("prob", F.when(resolved(F.col(first), lo, hi), F.col(first)).otherwise(F.col(fused)))


def resolution(rows: DataFrame, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    """Shares accepted as bad, as benign, resolved and escalated, overall and per class."""
    done = resolved(F.col("prob"), lo, hi)
    pos = F.col("label") == 1
    c = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("prob") >= hi).cast("double")).alias("accepted_bad"),
        F.avg((F.col("prob") <= lo).cast("double")).alias("accepted_benign"), F.avg(done.cast("double")).alias("resolved_overall"),
        (F.count_if(done & pos) / F.greatest(F.lit(1), F.count_if(pos))).alias("resolved_bad"),
        (F.count_if(done & ~pos) / F.greatest(F.lit(1), F.count_if(~pos))).alias("resolved_benign"))
    return c.withColumns({f"escalated_{k}": 1 - F.col(f"resolved_{k}") for k in ("overall", "bad", "benign")})


def cheap_mean(heads: Sequence[str]) -> Column:
    """K7: mean of the cheap heads."""
    return mean_of(*[F.col(h) for h in heads])


def with_threshold(rows: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Each row's model threshold, 0.5 when none is known."""
    return rows.join(thresholds.select("model", F.col("threshold").alias("thr")), "model", "left").fillna(default, ["thr"])


def single_band(rows: DataFrame, first: str, fused: str, points: int = 50, target: float = 0.95) -> DataFrame:
    """K3: over an even grid of first-stage cuts: pass rate, retained recall, precision of the rest at the recall target.

    Rows are counted per (cell, fused score); only those counts are repeated
    for the cuts they pass.
    """
    span = rows.agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if span.lo is None:
        raise ValueError("no rows to sweep")
    step = (span.hi - span.lo) / (points - 1)
    edges = [span.lo + i * step for i in range(points - 1)] + [span.hi]
    cells = rows.groupBy(m.bin_index(F.col(first), edges).alias("cell"), F.col(fused).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    passed = cells.select(F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("cut"), "score", "n", "pos")
    per = passed.groupBy("cut", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    run = m.running_totals(per, ["cut"], ["score"], m.score_bucket("score"), ["n", "pos"], descending=True)
    cum_n, cum_pos = F.col("before_n") + F.col("n"), F.col("before_pos") + F.col("pos")
    reach = F.when(cum_pos / F.greatest(F.lit(1), F.col("total_pos")) >= target, F.col("score"))
    out = run.groupBy("cut").agg(
        F.first("total_n").alias("passed"), F.first("total_pos").alias("passed_pos"),
        F.coalesce(F.max_by(cum_pos / cum_n, reach), F.lit(0.0)).alias("precision_at_target"))
    thr = F.get(F.array(*[F.lit(e) for e in edges]), F.col("cut"))
    return out.select(thr.alias("threshold"), (F.col("passed") / F.lit(span.n)).alias("pass_rate"),
                      (F.col("passed_pos") / F.lit(max(1, span.pos))).alias("retained_recall"), "precision_at_target")


def best_single_band(table: DataFrame, target: float = 0.95) -> DataFrame:
    """The smallest pass rate that keeps enough recall."""
    return table.filter(F.col("retained_recall") >= target).orderBy("pass_rate", F.desc("threshold")).limit(1)


def read_grids(df: DataFrame, columns: Sequence[str], n: int) -> dict[str, list[float]]:
    """The quantile grids of several columns from one pass, at most n numbers each."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("v")) for c in columns])))
    grids = {r.stage: list(r.grid) for r in quantile_grid(long, ["stage"], "v", n).collect()}
    return {c: grids.get(c, [0.0]) for c in columns}


def suffix_counts(cells: DataFrame, axes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts of all cells at or beyond each grid point, one axis at a time.

    The cell table has at most the product of the grid sizes in rows, whatever
    the data size.
    """
    for axis in axes:
        spread = cells.filter(F.col(axis) >= 0).select(
            *[c for c in cells.columns if c != axis], F.explode(F.sequence(F.lit(0), F.col(axis))).alias(axis))
        cells = spread.groupBy(*axes).agg(*[F.sum(v).alias(v) for v in values])
    return cells


def band_search(
    rows: DataFrame, stages: dict[str, list[float]], final: str, threshold: float,
    base: float, passing: Sequence[float],
) -> DataFrame:
    """K4, K5: every combination of stage cuts with its recall, precision, FPR, pass rates and expected cost.

    ``passing[i]`` is the cost paid by rows that pass the first i+1 stages.
    """
    names = list(stages)
    hit, is_pos = F.col(final) >= threshold, F.col("label") == 1
    axes = [f"_i{k}" for k in range(len(names))]
    cells = rows.groupBy(*[m.bin_index(F.col(s), stages[s]).alias(a) for s, a in zip(names, axes)]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_pos).alias("pos"), F.count_if(hit & is_pos).alias("tp"), F.count_if(hit & ~is_pos).alias("fp"))
    cells = settled(cells, "cascade-cells")
    totals = cells.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    n, pos = totals.n or 0, totals.pos or 0
    grid = suffix_counts(cells, axes, ["n", "tp", "fp"])
    # Pass counts of the first stages: the same cells summed over the later axes.
    out = grid
    for depth in range(1, len(names)):
        head = axes[:depth]
        part = suffix_counts(cells.groupBy(*head).agg(F.sum("n").alias("n")), head, ["n"]).withColumnRenamed("n", f"_n{depth}")
        out = out.join(part, head)
    rates = [F.col(f"_n{d}") / F.lit(n) for d in range(1, len(names))] + [F.col("n") / F.lit(n)]
    cost = F.lit(float(base))
    for r, c in zip(rates, passing):
        cost = cost + r * F.lit(float(c))
    cut = [F.get(F.array(*[F.lit(float(v)) for v in stages[s]]), F.col(a)).alias(f"t{k + 1}") for k, (s, a) in enumerate(zip(names, axes))]
    return out.select(
        *cut,
        (F.col("tp") / F.lit(max(1, pos))).alias("recall"), (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("fp") / F.lit(max(1, n - pos))).alias("fpr"), *[r.alias(f"pass{k + 1}") for k, r in enumerate(rates)], cost.alias("expected_cost"))


def two_band(rows: DataFrame, url: str, cheap: str, fused: str, threshold: float, costs: dict[str, float], cheap_cost: float, grid: int = 25) -> DataFrame:
    """K4: url cut, then cheap-mean cut, then the fused decision."""
    stages = read_grids(rows, [url, cheap], grid)
    return band_search(rows, stages, fused, threshold, costs["url_head"], [cheap_cost, costs["js_codet5p"] + costs["fusion"]])


def three_band(rows: DataFrame, url: str, cheap: str, heavy: str, fused: str, threshold: float, costs: dict[str, float], cheap_cost: float, grid: int = 15) -> DataFrame:
    """K5: one more cut on the heavy head."""
    stages = read_grids(rows, [url, cheap, heavy], grid)
    return band_search(rows, stages, fused, threshold, costs["url_head"], [cheap_cost, costs["js_codet5p"], costs["fusion"]])


def cheapest(table: DataFrame, target: float = 0.95) -> DataFrame:
    """Least expected cost among cuts that keep the recall target."""
    cuts = [c for c in table.columns if c.startswith("t")]
    return table.filter(F.col("recall") >= target).orderBy("expected_cost", *cuts).limit(1)


def ranked_results(table: DataFrame, n: int = 500) -> DataFrame:
    """Best recall first, then least cost."""
    return table.orderBy(F.desc("recall"), "expected_cost", *[c for c in table.columns if c.startswith("t")]).limit(n)


def frontier(table: DataFrame, n: int = 50) -> DataFrame:
    """F8: the cheapest result per rounded recall, best recall first."""
    cuts = [c for c in table.columns if c.startswith("t")]
    keyed = table.withColumn("recall_bucket", F.round("recall", 3))
    first = keep_one(keyed.withColumn("_worse", -F.col("recall")), ["recall_bucket"], ["_worse", "expected_cost", *cuts]).drop("_worse")
    return first.orderBy(F.desc("recall_bucket")).limit(n)


def cost_sensitivity(table: DataFrame, scales: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5), target: float = 0.95) -> DataFrame:
    """K6: the cheapest result under scaled costs; cost is linear, so the table is reused."""
    best = cheapest(table, target)
    scaled = best.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return scaled.withColumn("expected_cost", F.col("expected_cost") * F.col("scale"))
