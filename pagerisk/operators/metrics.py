"""Ranking and calibration metrics as DataFrame operators.

Everything ranked starts from one frame, the score curve: one row per distinct
(keys, score) with counts at and above that score. It is built from partial
counts, so a model that owns a third of all rows, or a score shared by a third
of them, is reduced before any shuffle.

Undefined values (one class only, no rows) are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.operators.running import running_totals, score_bucket

BY_MODEL = ("model", "split")


def score_counts(preds: DataFrame, keys: Sequence[str], score: str = "prob", label: str = "label") -> DataFrame:
    """Counts per distinct score: ``n`` rows, ``pos`` positives."""
    return preds.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )


def score_curve(
    preds: DataFrame, keys: Sequence[str] = BY_MODEL, score: str = "prob", label: str = "label"
) -> DataFrame:
    """F2: cumulative counts by descending score, ties kept together.

    Columns: keys, score, n, pos, cum_n, cum_pos (rows with score >= this one),
    tot_n, tot_pos.
    """
    counts = score_counts(preds, keys, score, label)
    run = running_totals(counts, keys, ["score"], score_bucket("score"), ["n", "pos"], descending=True)
    return run.select(
        *keys,
        "score",
        "n",
        "pos",
        (F.col("before_n") + F.col("n")).alias("cum_n"),
        (F.col("before_pos") + F.col("pos")).alias("cum_pos"),
        F.col("total_n").alias("tot_n"),
        F.col("total_pos").alias("tot_pos"),
    )


def total_negatives() -> Column:
    return F.col("tot_n") - F.col("tot_pos")


def negatives_above() -> Column:
    return F.col("cum_n") - F.col("cum_pos")


def two_classes() -> Column:
    return (F.col("tot_pos") > 0) & (F.col("tot_n") > F.col("tot_pos"))


def precision_at() -> Column:
    return F.col("cum_pos") / F.col("cum_n")


def recall_at() -> Column:
    return F.col("cum_pos") / F.when(F.col("tot_pos") > 0, F.col("tot_pos"))


def fpr_at() -> Column:
    return negatives_above() / F.when(total_negatives() > 0, total_negatives())


def with_rates(curve: DataFrame) -> DataFrame:
    """Precision, recall (= TPR) and FPR at each distinct score."""
    return curve.select("*", precision_at().alias("precision"), recall_at().alias("recall"), fpr_at().alias("fpr"))


def roc_auc_expr() -> Column:
    """Mann-Whitney area with half credit for ties."""
    below = total_negatives() - negatives_above()
    ties = F.col("n") - F.col("pos")
    won = F.sum(F.col("pos").cast("double") * (below + ties / F.lit(2.0)))
    pairs = F.first("tot_pos").cast("double") * F.first(total_negatives())
    return F.when(F.first(two_classes()), won / pairs)


def pr_auc_step_expr() -> Column:
    """Left-step area, each recall gain weighted by the precision just before it (1 at the start)."""
    earlier_n = F.col("cum_n") - F.col("n")
    earlier_pos = F.col("cum_pos") - F.col("pos")
    before = F.when(earlier_n == 0, F.lit(1.0)).otherwise(earlier_pos / F.when(earlier_n > 0, earlier_n))
    area = F.sum(F.col("pos") * before) / F.first("tot_pos")
    return F.when(F.first("tot_pos") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), area)))


def average_precision_expr() -> Column:
    """Each recall gain weighted by the precision at the cut itself."""
    return F.when(F.first("tot_pos") > 0, F.sum(F.col("pos") * precision_at()) / F.first("tot_pos"))


def _first_cut(target: float, value: Column) -> Column:
    reached = F.when(two_classes() & (recall_at() >= F.lit(target)), F.col("score"))
    return F.max_by(value, reached)


def fpr_at_tpr_expr(target: float) -> Column:
    """FPR at the highest score whose TPR reaches ``target``."""
    return F.when(F.first(two_classes()), _first_cut(target, fpr_at()))


def threshold_at_tpr_expr(target: float) -> Column:
    return F.when(F.first(two_classes()), _first_cut(target, F.col("score")))


def rank_sum_auc(preds: DataFrame, keys: Sequence[str] = BY_MODEL) -> DataFrame:
    """F1: average rank of every distinct score (ascending, ties share a rank)."""
    curve = score_curve(preds, keys)
    below = F.col("tot_n") - F.col("cum_n")
    return curve.select(*keys, "score", "n", "pos", (below + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


def ranking_metrics(preds: DataFrame, keys: Sequence[str] = BY_MODEL, tprs: Sequence[float] = (0.90, 0.95)) -> DataFrame:
    """Size, prevalence and ranking metrics per key in one pass over the curve."""
    aggs = [
        F.first("tot_n").alias("n"),
        F.first("tot_pos").alias("pos"),
        (F.first("tot_pos") / F.first("tot_n")).alias("prevalence"),
        roc_auc_expr().alias("roc_auc"),
        pr_auc_step_expr().alias("pr_auc"),
    ]
    for t in tprs:
        tag = f"{round(t * 100)}"
        aggs += [fpr_at_tpr_expr(t).alias(f"fpr_at_tpr{tag}"), threshold_at_tpr_expr(t).alias(f"thr_at_tpr{tag}")]
    return score_curve(preds, keys).groupBy(*keys).agg(*aggs)


def with_macro(metrics: DataFrame, columns: Sequence[str], label: str = "_macro_avg") -> DataFrame:
    """Append one unweighted-mean row per split; NULL metrics do not count."""
    macro = metrics.groupBy("split").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), *[F.avg(c).alias(c) for c in columns]
    )
    return metrics.unionByName(macro.withColumn("model", F.lit(label)))


def point_metrics(preds: DataFrame, keys: Sequence[str] = BY_MODEL, eps: float = 1e-12) -> DataFrame:
    """Brier score and log loss."""
    p, y = F.col("prob"), F.col("label")
    safe = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    loss = -y * F.log(safe) - (F.lit(1) - y) * F.log(F.lit(1.0) - safe)
    gap = p - y
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("brier"), F.avg(loss).alias("log_loss")
    )


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced edges, computed as lo + i * step, ending exactly on hi."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` are <= value, minus one."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) - 1


def ece(preds: DataFrame, keys: Sequence[str] = BY_MODEL, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width half-open bins.

    The last bin is open at 1, so a probability of exactly 1 lies in no bin; it
    still counts in the denominator.
    """
    edges = linspace(0.0, 1.0, bins + 1)
    binned = preds.select(*keys, "label", "prob", bin_index(F.col("prob"), edges).alias("bin"))
    cells = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum("prob").alias("mass"),
    )
    gap = F.abs(F.col("pos") / F.col("n") - F.col("mass") / F.col("n")) * F.col("n")
    inside = (F.col("bin") >= 0) & (F.col("bin") < bins)
    return cells.groupBy(*keys).agg((F.sum(F.when(inside, gap).otherwise(F.lit(0.0))) / F.sum("n")).alias("ece"))


def reliability(preds: DataFrame, keys: Sequence[str] = BY_MODEL, bins: int = 10) -> DataFrame:
    """Share of positives and mean prediction per bin, last bin closed at 1."""
    edges = linspace(0.0, 1.0, bins + 1)
    b = F.least(F.lit(bins - 1), bin_index(F.col("prob"), edges))
    return (
        preds.select(*keys, "label", "prob", b.alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("frac_pos"), F.avg("prob").alias("mean_pred"))
    )


def operating_point(curve: DataFrame, keys: Sequence[str] = BY_MODEL, target_recall: float = 0.95) -> DataFrame:
    """The cut of best precision among those reaching the recall target (highest score on ties)."""
    rated = with_rates(curve)
    hit = F.when(F.col("recall") >= target_recall, F.struct("precision", "score"))
    best = F.max_by(F.struct("score", "precision", "recall", "fpr"), hit)
    return (
        rated.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.col("b.score").alias("threshold"), "b.precision", "b.recall", "b.fpr")
    )


# Recall targets of the grid report.
RECALL_GRID = (0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98)


def recall_grid(curve: DataFrame, keys: Sequence[str] = BY_MODEL, targets: Sequence[float] = RECALL_GRID) -> DataFrame:
    """For each recall target the first cut reaching it, by conditional aggregates in one pass."""
    rated = with_rates(curve)
    point = F.struct("score", "precision", "fpr")
    picks = [
        F.struct(
            F.lit(t).alias("target"),
            F.max_by(point, F.when(F.col("recall") >= t, F.col("score"))).alias("at"),
        )
        for t in targets
    ]
    return (
        rated.groupBy(*keys)
        .agg(F.array(*picks).alias("grid"))
        .select(*keys, F.explode("grid").alias("g"))
        .select(*keys, "g.target", F.col("g.at.score").alias("threshold"), "g.at.precision", "g.at.fpr")
    )


def precision_threshold(
    curve: DataFrame,
    keys: Sequence[str] = BY_MODEL,
    target: float = 0.99,
    mode: str = "first",
) -> DataFrame:
    """A score cut reaching a precision target.

    ``first`` stops at the highest qualifying score; ``max_coverage`` takes the
    lowest one. When no cut qualifies the threshold is 1.
    """
    ok = F.when(precision_at() >= target, F.col("score"))
    pick = F.max(ok) if mode == "first" else F.min(ok)
    return curve.groupBy(*keys).agg(F.coalesce(pick, F.lit(1.0)).alias("threshold"))


def threshold_metrics(preds: DataFrame, threshold: Column | float, keys: Sequence[str] = BY_MODEL) -> DataFrame:
    """Confusion counts and the rates derived from them at one threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, pos = F.col("prob") >= thr, F.col("label") == 1
    c = preds.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
    )
    one = F.lit(1)
    precision = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall > 0, precision * recall * 2 / (precision + recall)).otherwise(F.lit(0.0))
    return c.select(
        "*",
        ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        (F.col("fp") / F.greatest(one, F.col("fp") + F.col("tn"))).alias("fpr"),
        f1.alias("f1"),
    )


def confusion_shares(preds: DataFrame, threshold: float, keys: Sequence[str] = BY_MODEL) -> DataFrame:
    """Confusion matrix in long form with each cell's share of its true class."""
    cells = preds.groupBy(*keys, "label", (F.col("prob") >= threshold).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_class = cells.groupBy(*keys, "label").agg(F.sum("n").alias("class_n"))
    return cells.join(per_class, [*keys, "label"]).withColumn("share", F.col("n") / F.col("class_n")).drop("class_n")


def accuracy_curve(preds: DataFrame, keys: Sequence[str] = BY_MODEL, points: int = 201) -> DataFrame:
    """Accuracy at evenly spaced thresholds.

    Rows are counted once per threshold cell; the sweep runs over the cells
    (at most ``points`` + 1 per key), not over rows times thresholds.
    """
    edges = linspace(0.0, 1.0, points)
    cell = bin_index(F.col("prob"), edges)
    counts = score_counts(preds, keys).withColumn("prob", F.col("score"))
    cells = counts.groupBy(*keys, cell.alias("cell")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    per_key = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("cell", "n", "pos")).alias("cells"),
        F.sum("n").alias("tot_n"),
        F.sum("pos").alias("tot_pos"),
    )
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("threshold")) for i, e in enumerate(edges)])
    swept = per_key.select(*keys, "tot_n", "tot_pos", "cells", F.explode(grid).alias("g"))
    zero = F.lit(0).cast("long")
    above = F.filter("cells", lambda c: c.cell >= F.col("g.i"))
    tp = F.aggregate(above, zero, lambda acc, c: acc + c.pos)
    hits = F.aggregate(above, zero, lambda acc, c: acc + c.n)
    correct = tp + (F.col("tot_n") - F.col("tot_pos")) - (hits - tp)
    return swept.select(*keys, "g.threshold", (correct / F.col("tot_n")).alias("accuracy"))
