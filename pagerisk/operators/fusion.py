"""Fusing head probabilities: means, logistic fits, folds, stacking features, weight search."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagerisk.functions.mathx import clamp, mean_of, sigmoid, unit
from pagerisk.operators import metrics as m
from pagerisk.operators.joins import settled
from pagerisk.operators.splits import folds

LOSSES = ("logistic", "focal", "squared", "weighted")


def average(wide: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Clipped mean of the head columns."""
    return wide.withColumn("prob", unit(mean_of(*[F.col(h) for h in heads])))


def _residual(p: str, loss: str, gamma: float, weights: tuple[float, float]) -> str:
    """Gradient factor of a loss, as SQL text over the score ``p`` and the label ``y``."""
    gap = f"({p} - y)"
    if loss == "focal":
        return f"{gap} * (pow(1 - {p}, {gamma!r}D) * y + pow({p}, {gamma!r}D) * (1 - y))"
    if loss == "squared":
        return f"{gap} * {p} * (1 - {p}) * 2"
    if loss == "weighted":
        return f"{gap} * ({weights[1]!r}D * y + {weights[0]!r}D * (1 - y))"
    return gap


def constants(values) -> str:
    """Numbers as an SQL array."""
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def fit_by(
    df: DataFrame, key: str, features: Sequence[str], label: str = "label", losses: Sequence[str] = ("logistic",), gamma: float = 2.0,
    weights: tuple[float, float] = (1.0, 1.0), max_iter: int = 200, tol: float = 1e-6, ridge: float = 1e-6, floor: float = 1e-8,
    held_out: bool = False,
) -> dict[str, dict[str, list[float]]]:
    """Newton fits of a logistic model, for every key value and loss in the same passes.

    With ``held_out`` a key's fit uses all rows but those of the key, which adds
    each batch to the sums of the other keys; no row is copied for that.

    Each pass sums the loss gradients and logistic Hessians ((k+1)^2 numbers
    per key and loss); the driver solves the small systems. Returns
    ``{loss: {key: coefficients, intercept last}}``.

    Coefficients enter the plan as array constants, so every pass reuses the
    code compiled for the first one; SQL text keeps building the plan cheap.
    """
    keys = sorted((r[0] for r in df.select(key).distinct().collect()), key=str)
    if not keys:
        return {s: {} for s in losses}
    place = F.array_position(F.array(*[F.lit(q) for q in keys]), F.col(key)).cast("int") - 1
    rows = settled(df.select(place.alias("_k"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]), "newton")
    k = len(features) + 1
    x = [f"`{f}`" for f in features] + ["1D"]
    w = {s: np.zeros((len(keys), k)) for s in losses}
    active = list(losses)
    for _ in range(max_iter):
        if not active:
            break
        if held_out or len(active) * k * (k + 3) // 2 > MAX_SQL_SUMS:
            totals = _wide_sums(rows, features, {s: w[s] for s in active}, gamma, weights, floor, held_out)
        else:
            totals = _narrow_sums(rows, x, {s: w[s] for s in active}, gamma, weights, floor)
        moved = dict.fromkeys(active, 0.0)
        for (s, i), (g, h) in totals.items():
            step = np.linalg.solve(h + ridge * np.eye(k), g)
            w[s][i] -= step
            moved[s] = max(moved[s], float(np.max(np.abs(step))))
        active = [s for s in active if moved[s] >= tol]
    return {s: {q: [float(v) for v in w[s][i]] for i, q in enumerate(keys)} for s in losses}


MAX_SQL_SUMS = 15  # beyond this many sums a pass takes them on Arrow batches, not as one SQL expression each


def _narrow_sums(rows: DataFrame, x: Sequence[str], w: dict, gamma: float, weights: tuple[float, float], floor: float) -> dict:
    """Gradient and Hessian per (loss, key) as plain SQL aggregates."""
    k = len(x)
    scores, sums = [], []
    for s in w:
        z = " + ".join(f"get({constants(w[s][:, i])}, _k) * {x[i]}" for i in range(k))
        p = f"(tanh(({z}) / 2D) + 1D) / 2D"
        scores.append(f"greatest({floor!r}D, least({1 - floor!r}D, {p})) AS p_{s}")
        r = _residual(f"p_{s}", s, gamma, weights)
        sums += [f"sum({x[i]} * ({r})) AS {s}_g{i}" for i in range(k)]
        sums += [f"sum({x[i]} * {x[j]} * p_{s} * (1 - p_{s})) AS {s}_h{i}_{j}" for i in range(k) for j in range(i, k)]
    out = {}
    for row in rows.selectExpr("*", *scores).groupBy("_k").agg(*[F.expr(e) for e in sums]).collect():
        for s in w:
            g = np.array([row[f"{s}_g{i}"] for i in range(k)])
            out[s, row["_k"]] = g, np.array([[row[f"{s}_h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return out


def _wide_sums(rows: DataFrame, features: Sequence[str], w: dict, gamma: float, weights: tuple[float, float], floor: float, held_out: bool = False) -> dict:
    """The same sums for many features: NumPy per batch, one row per sum and partition, added up by Spark."""
    names, k = list(features), len(features) + 1

    def residual(p, y, loss):
        if loss == "focal":
            return (p - y) * ((1 - p) ** gamma * y + p**gamma * (1 - y))
        if loss == "squared":
            return (p - y) * p * (1 - p) * 2
        if loss == "weighted":
            return (p - y) * (weights[1] * y + weights[0] * (1 - y))
        return p - y

    def partial(batches):
        acc = {}
        for b in batches:
            place, y = b["_k"].to_numpy(), b["y"].to_numpy()
            full = np.column_stack([b[names].to_numpy(dtype=float), np.ones(len(b))])
            for s, coef in w.items():
                for i in range(len(coef)) if held_out else np.unique(place):
                    at = place != i if held_out else place == i
                    xs, ys = full[at], y[at]
                    p = np.clip(0.5 * (1 + np.tanh(0.5 * (xs @ coef[i]))), floor, 1 - floor)
                    both = np.concatenate([xs.T @ residual(p, ys, s), (xs.T @ (xs * (p * (1 - p))[:, None])).ravel()])
                    acc[s, int(i)] = acc.get((s, int(i)), 0.0) + both
        for (s, i), v in acc.items():
            yield pd.DataFrame({"loss": s, "_k": i, "pos": np.arange(v.size), "value": v})

    parts = rows.mapInPandas(partial, "loss STRING, _k INT, pos INT, value DOUBLE")
    found: dict = {}
    for r in parts.groupBy("loss", "_k", "pos").agg(F.sum("value").alias("value")).collect():
        found.setdefault((r.loss, r["_k"]), np.zeros(k + k * k))[r.pos] = r.value
    return {q: (v[:k], v[k:].reshape(k, k)) for q, v in found.items()}


def fit_losses(df: DataFrame, features: Sequence[str], losses: Sequence[str] = LOSSES, **options) -> dict[str, list[float]]:
    """One fit per loss over all rows, in the same passes."""
    fits = fit_by(df.withColumn("_all", F.lit("all")), "_all", features, losses=losses, **options)
    return {s: fits[s].get("all", [0.0] * (len(features) + 1)) for s in losses}


def fit_logistic(df: DataFrame, features: Sequence[str], loss: str = "logistic", **options) -> list[float]:
    """One fit over all rows."""
    return fit_losses(df, features, (loss,), **options)[loss]


def linear_score(features: Sequence[str], coef: Sequence[float]) -> Column:
    """Probability of a stored linear model."""
    z = F.lit(float(coef[-1]))
    for f, c in zip(features, coef):
        z = z + F.lit(float(c)) * F.col(f)
    return sigmoid(z)


def weighted_score(heads: Sequence[str], weights: Sequence[float]) -> Column:
    """Clipped weighted sum of the heads."""
    total = F.lit(0.0)
    for h, w in zip(heads, weights):
        total = total + F.lit(float(w)) * F.col(h)
    return clamp(total, 0.0, 1.0)


def compare_losses(val: DataFrame, features: Sequence[str], losses: Sequence[str] = LOSSES) -> tuple[DataFrame, dict[str, list[float]]]:
    """Fit each loss on the rows and rank them by PR, then Brier."""
    share = val.agg(F.avg("label")).first()[0] or 0.5
    weights = (0.5 / max(1e-9, 1 - share), 0.5 / max(1e-9, share))
    fits = fit_losses(val, features, losses, weights=weights)
    entries = F.array(*[F.struct(F.lit(s).alias("loss"), linear_score(features, c).alias("prob")) for s, c in fits.items()])
    scored = val.select("label", F.inline(entries))
    ranks = m.score_curve(scored, ["loss"]).groupBy("loss").agg(m.roc_auc_expr().alias("roc_auc"), m.pr_auc_step_expr().alias("pr_auc"))
    return ranks.join(m.point_metrics(scored, ["loss"]).select("loss", "brier", "log_loss"), "loss"), fits


def best_loss(table: DataFrame) -> str:
    """The loss to adopt."""
    return table.agg(F.min_by("loss", F.struct(-F.col("pr_auc"), F.col("brier")))).first()[0]


def out_of_fold(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, **options) -> tuple[DataFrame, list[float]]:
    """Held-out scores of k logistic fits, and the fit on all rows.

    All folds' fits run in the same passes over one table. A one-class training part scores its base rate.
    """
    placed = settled(folds(df, k, seed), "folds")
    named = placed.select("label", *features, F.col("fold").cast("string").alias("held_out"))
    fits = fit_by(named, "held_out", features, held_out=True, **options).get("logistic", {})
    if len(fits) < 2:
        fits = {}  # nothing to learn from but the fold itself
    score = F.lit(None).cast("double")
    for f, coef in fits.items():
        score = F.when(F.col("fold") == int(f), linear_score(features, coef)).otherwise(score)
    return placed.withColumn("prob", score), fit_logistic(placed, features, **options)


def stacking_features(wide: DataFrame, heads: Sequence[str], fused: str | None = None) -> tuple[DataFrame, list[str]]:
    """Head values, min, max, mean, population deviation and all pairwise gaps."""
    cols = [F.col(h) for h in heads]
    mean = mean_of(*cols)
    square = mean_of(*[(c - mean) * (c - mean) for c in cols])
    new = {"prob_min": F.least(*cols), "prob_max": F.greatest(*cols), "prob_mean": mean, "prob_std": F.sqrt(square)}
    for a, b in itertools.combinations(heads, 2):
        new[f"absdiff_{a}_{b}"] = F.abs(F.col(a) - F.col(b))
    names = [*heads, *([fused] if fused else []), *new]
    return wide.withColumns(new), names


def simplex(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors on a grid of ``steps`` points per head that sum to 1."""
    if n == 1:
        return [(1.0,)]
    parts = steps - 1
    grid = (c for c in itertools.product(range(parts + 1), repeat=n - 1) if sum(c) <= parts)
    return [tuple(v / parts for v in (*c, parts - sum(c))) for c in grid]


def dirichlet(n: int, samples: int, alpha: float = 1.0, seed: int = 42) -> list[tuple[float, ...]]:
    """Random weight vectors."""
    return [tuple(map(float, r)) for r in np.random.default_rng(seed).dirichlet([alpha] * n, samples)]


def hashed_weights(n: int, samples: int, seed: int | str = 42) -> list[tuple[float, ...]]:
    """Weight vectors uniform on the simplex, from md5 of ``seed|sample|head``, so any engine can draw the same."""
    def share(i: int, h: int) -> float:
        digest = int(hashlib.md5(f"{seed}|{i}|{h}".encode()).hexdigest()[:15], 16)
        return -math.log((digest + 0.5) / 2.0**60)

    drawn = [[share(i, h) for h in range(n)] for i in range(samples)]
    return [tuple(v / sum(row) for v in row) for row in drawn]


#: Cells of the score axis in the first pass of a weight search, and by how much later passes refine it.
GRID_CELLS, FINER = 1024, 16


def grid_counts(wide: DataFrame, heads: Sequence[str], weights: Sequence[Sequence[float]], cells: int) -> DataFrame:
    """(candidate, cell, n, pos), counted in the tasks: what is shuffled grows with tasks x candidates x cells, not with rows."""
    w, names = np.array(weights, dtype=float).T, list(heads)

    def count(batches):
        n = np.zeros((w.shape[1], cells), np.int64)
        pos = np.zeros_like(n)
        for b in batches:
            x, y = b[names].to_numpy(dtype=float), b["label"].to_numpy()
            at = np.minimum((np.clip(x @ w, 0.0, 1.0) * cells).astype(np.int64), cells - 1)
            for c in range(w.shape[1]):
                n[c] += np.bincount(at[:, c], minlength=cells)
                pos[c] += np.bincount(at[y == 1, c], minlength=cells)
        c, k = np.nonzero(n)
        if len(c):
            yield pd.DataFrame({"place": c.astype(np.int32), "cell": k.astype(np.int32), "n": n[c, k], "pos": pos[c, k]})

    counted = wide.select("label", *[F.col(h).cast("double").alias(h) for h in heads]).mapInPandas(count, "place INT, cell INT, n BIGINT, pos BIGINT")
    return counted.groupBy("place", "cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def grid_bounds(counts: DataFrame) -> DataFrame:
    """(place, low, high): what the PR of each candidate can be, given its counts per cell.

    Inside a cell the order is unknown: at worst all negatives come first, at best
    all positives. The window runs over the cells of one candidate.
    """
    w = Window.partitionBy("place").orderBy(F.desc("cell"))
    c = counts.withColumn("_n", F.sum("n").over(w) - F.col("n")).withColumn("_p", F.sum("pos").over(w) - F.col("pos")).withColumn("_all", F.sum("pos").over(Window.partitionBy("place")))
    worst = F.when(F.col("_n") + F.col("n") - F.col("pos") > 0, F.col("_p") / (F.col("_n") + F.col("n") - F.col("pos"))).otherwise(1.0)
    best = F.greatest(F.when(F.col("_n") > 0, F.col("_p") / F.col("_n")).otherwise(1.0), F.when(F.col("_n") + F.col("pos") > 0, (F.col("_p") + F.col("pos")) / (F.col("_n") + F.col("pos"))))
    return c.groupBy("place").agg((F.sum(F.col("pos") * worst) / F.max("_all")).alias("low"), (F.sum(F.col("pos") * best) / F.max("_all")).alias("high"))


def contenders(wide: DataFrame, heads: Sequence[str], kept: Sequence[tuple[int, tuple]], extra: dict[int, float], top: int, passes: int = 3) -> list[tuple[int, tuple]]:
    """Candidates that can be among the ``top`` by PR plus their own extra, by bounds from ever finer cells."""
    cells = GRID_CELLS
    for _ in range(passes):
        if len(kept) <= top:
            break
        bounds = {r.place: r for r in grid_bounds(grid_counts(wide, heads, [w for _, w in kept], cells)).collect()}
        if any(bounds[p].low is None for p in bounds) or not bounds:
            break  # one class only: no order to speak of
        low = [bounds[p].low + extra[i] for p, (i, _) in enumerate(kept)]
        high = [bounds[p].high + extra[i] for p, (i, _) in enumerate(kept)]
        least = sorted(low, reverse=True)[top - 1] - 1e-9
        still = [c for c, h in zip(kept, high) if h >= least]
        done = len(still) == len(kept)
        kept, cells = still, cells * FINER
        if done:
            break
    return list(kept)


def weight_search(
    wide: DataFrame, heads: Sequence[str], candidates: Sequence[Sequence[float]], l2: float = 0.0,
    prefer: Sequence[str] = (), bonus: float = 0.0, caps: dict[str, float] | None = None, chunk: int = 64, top: int | None = None,
) -> DataFrame:
    """PR and ROC of every candidate weighting, with caps, penalty and preference in the objective.

    With ``top`` only candidates that can be among the best ``top`` come back: bounds
    from counts per cell of the score axis leave out the others, and only those left
    are counted by their exact scores. Without it every candidate is.
    """
    at = {h: i for i, h in enumerate(heads)}
    kept = [(i, tuple(w)) for i, w in enumerate(candidates) if all(w[at[h]] <= c + 1e-9 for h, c in (caps or {}).items() if h in at)]
    if not kept:
        raise ValueError("no candidate respects the caps")
    extra = {i: float(bonus * sum(w[at[h]] for h in prefer if h in at) - l2 * sum(v * v for v in w)) for i, w in kept}
    if top is not None:
        kept = contenders(wide, heads, kept, extra, top)
    scores = None
    for start in range(0, len(kept), chunk):
        entries = F.array(*[F.struct(F.lit(i).alias("candidate"), weighted_score(heads, w).alias("prob")) for i, w in kept[start : start + chunk]])
        part = wide.select("label", F.inline(entries))
        scores = part if scores is None else scores.unionByName(part)
    ranks = m.score_curve(scores, ["candidate"]).groupBy("candidate").agg(m.pr_auc_step_expr().alias("pr_auc"), m.roc_auc_expr().alias("roc_auc"))
    adjust, text = F.lit(0.0), F.lit(None).cast("string")
    for i, w in kept:
        here = F.col("candidate") == i
        adjust = F.when(here, F.lit(extra[i])).otherwise(adjust) if extra[i] else adjust
        text = F.when(here, F.lit(",".join(f"{v:.6f}" for v in w))).otherwise(text)
    return ranks.select("candidate", text.alias("weights"), "pr_auc", "roc_auc", (F.col("pr_auc") + adjust).alias("objective"))


def candidate_scores(wide: DataFrame, heads: Sequence[str], candidates: Sequence[Sequence[float]]) -> DataFrame:
    """Mean score and Brier score of every candidate weighting, in one aggregate with a few sums per candidate."""
    gap = lambda c: weighted_score(heads, c) - F.col("label")
    sums = [F.struct(F.lit(i).alias("candidate"), F.avg(weighted_score(heads, c)).alias("mean_prob"), F.avg(gap(c) * gap(c)).alias("brier")) for i, c in enumerate(candidates)]
    return wide.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def best_weights(scores: DataFrame, n: int = 1) -> DataFrame:
    return scores.orderBy(F.desc("objective"), F.desc("roc_auc"), "candidate").limit(n)


# --- models on feature columns ---------------------------------------------

def balanced_weight(df: DataFrame, label: str = "label") -> Column:
    """Row weight giving both classes the same total."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).first()
    n, pos = c.n or 0, c.pos or 0
    if not 0 < pos < n:
        return F.lit(1.0)
    return F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))


def positive(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def logistic_fusion(train: DataFrame, heads: Sequence[str], seed: int = 42):
    """Standardised, class-balanced logistic regression; NULL model when one class only."""
    weighted = train.withColumn("_w", balanced_weight(train))
    classes = train.select("label").distinct().count()
    if classes < 2:
        return None
    stages = [
        VectorAssembler(inputCols=list(heads), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=200, regParam=1e-6),
    ]
    return Pipeline(stages=stages).fit(weighted)


def fused_by(model, wide: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Scores of a fitted fusion; the mean when there was nothing to fit."""
    if model is None:
        return average(wide, heads)
    out = model.transform(wide.withColumn("_w", F.lit(1.0)))
    return out.withColumn("prob", positive()).drop("_raw", "_x", "_w", "rawPrediction", "probability", "prediction")


def positive_shares(model, heads: Sequence[str]) -> dict[str, float]:
    """Coefficients below zero cut off, the rest normalised to weights."""
    coef = np.maximum(model.stages[-1].coefficients.toArray(), 0.0)
    total = coef.sum() or 1.0
    return {h: float(c / total) for h, c in zip(heads, coef)}


def refine_band(wide: DataFrame, heads: Sequence[str], fused: str, threshold: float, margin: float, holdout: float = 0.30, seed: int = 42, least: int = 20) -> DataFrame:
    """Boosted trees inside the band around the threshold, scored on the held-out part of each class.

    Returns refined rows (id, label, prob); none when the band has fewer than ``least`` rows or one class.
    """
    from pagerisk.operators.running import hash_ranked

    band = settled(hash_ranked(wide.filter(F.abs(F.col(fused) - threshold) <= margin), "id", seed, ["label"]), "band")
    c = band.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if c.n < least or not 0 < (c.pos or 0) < c.n:
        return band.select("id", "label", F.lit(0.0).alias("prob")).limit(0)
    held = F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("rank_of") * holdout))
    x = VectorAssembler(inputCols=list(heads), outputCol="_x").transform(band)
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=2, maxIter=20, seed=seed).fit(x.filter(~held))
    return model.transform(x.filter(held)).select("id", "label", positive().alias("prob"))


def url_baseline(text: str, n: int = 3, size: int = 1 << 18) -> Pipeline:
    """Hashed character n-grams of a URL into a logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_chars", pattern=".", gaps=False, toLowercase=True),
        NGram(inputCol="_chars", outputCol="_grams", n=n),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size),
        LogisticRegression(featuresCol="_tf", labelCol="label", maxIter=30, regParam=1e-3),
    ])


def text_baseline(text: str, size: int = 1 << 18) -> Pipeline:
    """Hashed words with inverse document frequency into a logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="label", maxIter=30, regParam=1e-3),
    ])


def feature_baseline(columns: Sequence[str], hidden: int = 16, seed: int = 42) -> Pipeline:
    """Scaled feature columns into a small perceptron."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_x"),
        MultilayerPerceptronClassifier(featuresCol="_x", labelCol="label", layers=[len(columns), hidden, 2], maxIter=60, seed=seed),
    ])


def score_table(model, rows: DataFrame, name: str, split: str | None = None) -> DataFrame:
    """A fitted head over a table, as prediction rows."""
    out = model.transform(rows).select("id", "label", positive().alias("prob"), F.lit(name).alias("model"), *(["split"] if "split" in rows.columns else []))
    return out if split is None else out.withColumn("split", F.lit(split))


def batch_scorer(make_predict, width: int, batch_size: int = 1024):
    """An external model over feature arrays of a given width, through Spark's batch prediction function."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
