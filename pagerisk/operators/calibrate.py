"""Calibration of head probabilities: Platt, isotonic, temperature, choice per head.

Fits run on Spark: each iteration is one aggregate of a few sums per model over
a narrow table written once; only those sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagerisk.functions.mathx import clamp, logit, sigmoid, temper
from pagerisk.operators import metrics as m
from pagerisk.operators.fusion import constants, fit_by
from pagerisk.operators.joins import settled

PLATT_EPS = 1e-6


def per_model(values: dict[str, float], key: Column, default: float) -> Column:
    """A small per-model constant as an expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def fit_platt(val: DataFrame, key: str = "model", max_iter: int = 100, tol: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Slope and intercept of a logistic curve on the logit, per model, all models in the same passes."""
    rows = val.select(key, "label", logit(F.col("prob"), PLATT_EPS).alias("z"))
    fits = fit_by(rows, key, ["z"], max_iter=max_iter, tol=tol, floor=0.0)["logistic"]
    return {k: (w[0], w[1]) for k, w in fits.items()}


def apply_platt(df: DataFrame, fits: dict[str, tuple[float, float]], key: str = "model") -> DataFrame:
    slope = per_model({k: w[0] for k, w in fits.items()}, F.col(key), 1.0)
    offset = per_model({k: w[1] for k, w in fits.items()}, F.col(key), 0.0)
    return df.withColumn("prob", sigmoid(slope * logit(F.col("prob"), PLATT_EPS) + offset))


def fit_temperature(val: DataFrame, key: str = "model", lo: float = 0.05, hi: float = 20.0, points: int = 33, passes: int = 9) -> dict[str, float]:
    """Temperature of least log loss per model.

    Every pass evaluates a grid of temperatures for all models in one
    aggregate and keeps the cells around the best point.
    """
    keys = sorted((r[0] for r in val.select(key).distinct().collect()), key=str)
    place = F.array_position(F.array(*[F.lit(q) for q in keys]), F.col(key)).cast("int") - 1
    rows = settled(val.select(place.alias("_k"), "label", logit(F.col("prob")).alias("z")), "temperature")
    spans = [(lo, hi)] * len(keys)
    for _ in range(passes):
        grids = [np.linspace(a, b, points) for a, b in spans]
        # Array constants keep the compiled code the same in every pass; the loss is
        # max(x, 0) - x * y + log(1 + exp(-|x|)), which cannot overflow.
        x = [f"(z / get({constants(g[i] for g in grids)}, _k))" for i in range(points)]
        losses = [F.expr(f"avg(greatest({e}, 0D) - {e} * label + log1p(exp(-abs({e}))))").alias(f"l{i}") for i, e in enumerate(x)]
        for r in rows.groupBy("_k").agg(*losses).collect():
            best = int(np.argmin([r[f"l{i}"] for i in range(points)]))
            g = grids[r["_k"]]
            spans[r["_k"]] = (g[max(0, best - 1)], g[min(points - 1, best + 1)])
    return {q: float((a + b) / 2) for q, (a, b) in zip(keys, spans)}


def apply_temperature(df: DataFrame, fits: dict[str, float], key: str = "model") -> DataFrame:
    return df.withColumn("prob", temper(F.col("prob"), per_model(fits, F.col(key), 1.0)))


#: Blocks that one task pools; above it the ranges of a pass are cut elsewhere in the next.
POOL_ROWS = 200_000
#: Cells of the score axis by which rows meet their blocks.
STEP_CELLS = 1 << 14


def _pool(key: str):
    """Adjacent violators pooled within each task's range, for blocks that come sorted by key and score."""

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done, held = None, [], []
        for batch in batches:
            for q, low, n, pos in zip(batch[key], batch["low"], batch["n"].tolist(), batch["pos"].tolist(), strict=True):
                if q != at:
                    done += [(at, *b) for b in held]
                    at, held = q, []
                held.append((low, n, pos))
                # Shares compared as products of whole numbers: the result does not depend on the order of merging.
                while len(held) > 1 and held[-2][2] * held[-1][1] >= held[-1][2] * held[-2][1]:
                    _, n2, pos2 = held.pop()
                    low1, n1, pos1 = held.pop()
                    held.append((low1, n1 + n2, pos1 + pos2))
            if len(done) > 50_000:
                yield pd.DataFrame(done, columns=[key, "low", "n", "pos"])
                done = []
        done += [(at, *b) for b in held]
        if done:
            yield pd.DataFrame(done, columns=[key, "low", "n", "pos"])

    return pool


def _edges(key: str):
    """The first and the last block of each key in each task, and whether any neighbours in the task violate the order."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for batch in batches:
            for row in batch[[key, "low", "n", "pos"]].itertuples(index=False, name=None):
                first, last, bad = found.get(row[0], (row, None, False))
                found[row[0]] = first, row, bad or (last is not None and last[3] * row[2] >= row[3] * last[2])
        rows = [(*r, bad) for first, last, bad in found.values() for r in ((first, last) if first != last else (first,))]
        if rows:
            yield pd.DataFrame(rows, columns=[key, "low", "n", "pos", "bad"])

    return ends


def fit_isotonic(val: DataFrame, key: str = "model", pool_rows: int | None = None) -> DataFrame:
    """Monotone step functions per key, as a table (key, low, n, pos, value) of blocks from ``low`` upwards.

    Distinct scores with their counts are pooled range by range of (key, score), the
    pooled blocks again in fewer ranges cut at other places, until no neighbours
    violate the order. Pooling is associative, so the blocks are those of one pass
    over everything; none of them comes to the driver.
    """
    pool_rows = pool_rows or POOL_ROWS
    blocks = m.score_counts(val, [key]).select(key, F.col("score").alias("low"), F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    schema = blocks.schema
    blocks, turn = settled(blocks, "isotonic-points"), 0
    while True:
        parts = max(1, -(-blocks.count() // pool_rows))
        cuts = parts + turn % 2 if parts > 1 else 1  # other cuts in every other pass
        ordered = blocks.repartitionByRange(cuts, key, "low") if cuts > 1 else blocks.coalesce(1)
        blocks = settled(ordered.sortWithinPartitions(key, "low").mapInPandas(_pool(key), schema), "isotonic-blocks")
        if cuts == 1 or not _violated(blocks, key, cuts):
            return blocks.withColumn("value", F.col("pos") / F.col("n"))
        turn += 1


def _violated(blocks: DataFrame, key: str, cuts: int) -> bool:
    """Does a block lie at or below the one before it? Ranges look inside; two rows of each are compared with their neighbours'."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", bad BOOLEAN"
    ends = settled(blocks.repartitionByRange(cuts, key, "low").sortWithinPartitions(key, "low").mapInPandas(_edges(key), schema), "isotonic-ends")
    if not ends.filter("bad").isEmpty():
        return True
    before = Window.partitionBy(key).orderBy("low")
    pairs = ends.withColumn("_p", F.lag("pos").over(before)).withColumn("_n", F.lag("n").over(before))
    wide = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    return not pairs.filter(wide("_p", "n") >= wide("pos", "_n")).isEmpty()


def step_cells(blocks: DataFrame, key: str = "model", cells: int = STEP_CELLS) -> DataFrame:
    """(key, cell, steps): for every cell of the unit interval the blocks that reach into it, in order.

    Scores outside [0, 1] belong to the outer cells. The first block also holds for
    all scores below it.
    """
    cell = lambda c: F.floor(clamp(c, 0.0, 1.0) * (cells - 1)).cast("int")
    own = blocks.select(key, "low", "value", cell(F.col("low")).alias("cell"))
    inside = own.groupBy(key, "cell").agg(F.array_sort(F.collect_list(F.struct("low", "value"))).alias("own"))
    # One row per cell in use: a running last over at most ``cells`` rows a key, then the gaps between them.
    order = Window.partitionBy(key).orderBy("cell")
    carried = inside.withColumn("carry", F.lag(F.element_at("own", -1)).over(order)).withColumn("next", F.lead("cell").over(order))
    first = F.when(F.col("carry").isNull(), F.struct(F.lit(float("-inf")).alias("low"), F.col("own")[0]["value"].alias("value"))).otherwise(F.col("carry"))
    full = carried.select(key, "cell", F.concat(F.array(first), "own").alias("steps"))
    upto = F.coalesce(F.col("next"), F.lit(cells)) - 1
    gaps = carried.filter(upto > F.col("cell")).select(key, F.explode(F.sequence(F.col("cell") + 1, upto)).alias("cell"), F.array(F.element_at("own", -1)).alias("steps"))
    floor = F.min("cell").over(Window.partitionBy(key))
    below = carried.withColumn("_floor", floor).filter((F.col("cell") == F.col("_floor")) & (F.col("cell") > 0)).select(
        key, F.explode(F.sequence(F.lit(0), F.col("cell") - 1)).alias("cell"), F.array(F.struct(F.lit(float("-inf")).alias("low"), F.col("own")[0]["value"].alias("value"))).alias("steps"))
    return full.unionByName(gaps).unionByName(below)


def with_step(df: DataFrame, blocks: DataFrame, name: str, key: str = "model", score: str = "prob", cells: int = STEP_CELLS) -> DataFrame:
    """Add the value of the last block at or below each score, by a join on (key, cell of the score).

    The cells are a settled table, so Spark knows whether to broadcast them or to
    shuffle and split a cell that holds most rows. Keys without blocks get NULL.
    """
    table = settled(step_cells(blocks, key, cells), "isotonic-cells")
    placed = df.withColumn("_cell", F.floor(clamp(F.col(score), 0.0, 1.0) * (cells - 1)).cast("int"))
    joined = placed.join(table.withColumnRenamed("cell", "_cell"), [key, "_cell"], "left")
    step = F.element_at(F.filter("steps", lambda b: b.low <= F.col(score)), -1)
    return joined.withColumn(name, F.when(F.size("steps") > 0, step["value"])).drop("_cell", "steps")


def apply_isotonic(df: DataFrame, blocks: DataFrame, key: str = "model") -> DataFrame:
    """Every score through its key's steps; keys without a fit keep it."""
    return with_step(df, blocks, "_step", key).withColumn("prob", F.coalesce("_step", "prob")).drop("_step").select(*df.columns)


def quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brier, ECE, ROC and PR per key."""
    ranks = m.score_curve(df, keys).groupBy(*keys).agg(m.roc_auc_expr().alias("roc_auc"), m.pr_auc_step_expr().alias("pr_auc"))
    return ranks.join(m.point_metrics(df, keys).select(*keys, "brier"), list(keys)).join(m.ece(df, keys), list(keys))


def choose_calibrators(val: DataFrame, key: str = "model") -> tuple[DataFrame, dict, DataFrame]:
    """Raw, Platt or isotonic per model, by least Brier score, then best PR, on validation rows."""
    platt, iso = fit_platt(val, key), fit_isotonic(val, key)
    tries = {"raw": val, "platt": apply_platt(val, platt, key), "isotonic": apply_isotonic(val, iso, key)}
    rows = None
    for name, df in tries.items():
        part = df.select(key, "label", "prob").withColumn("calibrator", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    table = settled(quality(rows, [key, "calibrator"]), "calibrator-quality")
    best = table.groupBy(key).agg(F.min_by("calibrator", F.struct("brier", -F.col("pr_auc"))).alias("chosen"))
    return table.join(best, key), platt, iso


def calibrate(df: DataFrame, chosen: dict[str, str], platt: dict, iso: DataFrame, key: str = "model") -> DataFrame:
    """Every row through its model's calibrator."""
    slope = per_model({k: w[0] for k, w in platt.items()}, F.col(key), 1.0)
    offset = per_model({k: w[1] for k, w in platt.items()}, F.col(key), 0.0)
    platted = sigmoid(slope * logit(F.col("prob"), PLATT_EPS) + offset)
    is_platt = F.col(key).isin([k for k, v in chosen.items() if v == "platt"])
    is_iso = F.col(key).isin([k for k, v in chosen.items() if v == "isotonic"])
    out = with_step(df, iso, "_step", key)
    return out.withColumn("prob", F.when(is_platt, platted).when(is_iso, clamp(F.col("_step"), 0.0, 1.0)).otherwise(F.col("prob"))).drop("_step").select(*df.columns)
