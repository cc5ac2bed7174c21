"""Coverage, drift, anomaly and gating audits over prediction tables and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerisk.operators.align import by_head, present



def class_counts(df: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Size, positives, negatives and positive ratio."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
    return c.select("*", (F.col("n") - F.col("pos")).alias("neg"), (F.col("pos") / F.col("n")).alias("pos_ratio"))


def verify_splits(df: DataFrame, splits: Sequence[str] = ("train", "val", "test"), min_pos: int = 5) -> DataFrame:
    """Verdict per expected split: empty, one class (an error in val/test), too few positives."""
    seen = class_counts(df).filter(F.col("split").isin(*splits))
    wanted = F.array(*[F.lit(s) for s in splits])
    # A left join against the expected names keeps empty splits visible.
    names = df.sparkSession.range(1).select(F.explode(wanted).alias("split"))
    rows = names.join(seen, "split", "left").fillna(0, ["n", "pos", "neg"])
    held_out = F.col("split").isin("val", "test")
    one_class = (F.col("pos") == 0) | (F.col("neg") == 0)
    verdict = (
        F.when(F.col("n") == 0, "empty")
        .when(one_class & held_out, "one_class")
        .when(held_out & (F.col("pos") < min_pos), "too_few_positives")
        .when(one_class, "warn_one_class")
        .otherwise("ok")
    )
    return rows.select("split", "n", "pos", "neg", verdict.alias("verdict"))


def require_splits(df: DataFrame, min_pos: int = 5) -> None:
    """Raise when any split fails."""
    bad = verify_splits(df, min_pos=min_pos).filter(~F.col("verdict").isin("ok", "warn_one_class")).collect()
    if bad:
        raise ValueError("; ".join(f"{r.split}: {r.verdict}" for r in bad))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows per key. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def sample_lists(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Comma-joined list of the n smallest values per key."""
    top = first_n(df.select(*keys, value), keys, [value], n)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ",").alias(name))


def coverage(canon: DataFrame, preds: DataFrame) -> DataFrame:
    """Ids, positives and prevalence per model, and the union of ids over models."""
    per_id = preds.groupBy("model", "id").agg(F.max("label").alias("label"))
    per_model = per_id.groupBy("model").agg(F.count(F.lit(1)).alias("ids"), F.sum("label").alias("pos"))
    union = preds.agg(F.count_distinct("id").alias("ids"), F.lit(None).cast("bigint").alias("pos")).withColumn("model", F.lit("_union"))
    size = canon.agg(F.count(F.lit(1)).alias("ids"), F.sum("label").cast("long").alias("pos")).withColumn("model", F.lit("_canonical"))
    rows = per_model.unionByName(union).unionByName(size)
    return rows.withColumn("prevalence", F.col("pos") / F.col("ids"))


def _membership(canon: DataFrame, preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per id seen anywhere: in_canon, canonical label and a presence flag per model."""
    have = preds.groupBy("id").agg(
        *[F.max(F.col("model") == m).alias(f"has_{m}") for m in models],
        *[F.max(F.when(F.col("model") == m, F.col("label"))).alias(f"label_{m}") for m in models],
    )
    base = canon.select("id", F.col("label").alias("canon_label"), F.lit(True).alias("in_canon"))
    return base.join(have, "id", "full").fillna(False, ["in_canon", *[f"has_{m}" for m in models]])


def extended_coverage(canon: DataFrame, preds: DataFrame, models: Sequence[str], near: float = 0.97) -> DataFrame:
    """Per model coverage, missing and extra counts, prevalence over the canonical size, relative drift.

    One full join on id; every number is a conditional aggregate over it.
    """
    ids = _membership(canon, preds, models)
    entry = [
        F.struct(F.lit(m).alias("model"), F.col(f"has_{m}").alias("has"), F.col(f"label_{m}").alias("label")) for m in models
    ]
    long = ids.select("in_canon", "canon_label", F.inline(F.array(*entry)))
    c = long.groupBy("model").agg(
        F.count_if("in_canon").alias("canonical"),
        F.count_if(F.col("in_canon") & F.col("has")).alias("covered"),
        F.count_if(F.col("in_canon") & ~F.col("has")).alias("missing_count"),
        F.count_if(~F.col("in_canon") & F.col("has")).alias("extra_count"),
        F.count_if(F.col("in_canon") & F.col("has") & (F.col("label") == 1)).alias("_pos"),
        F.avg(F.when(F.col("in_canon"), F.col("canon_label"))).alias("canonical_prevalence"),
    )
    prevalence = F.col("_pos") / F.col("canonical")
    base = F.col("canonical_prevalence")
    return c.select(
        "*",
        (F.col("covered") / F.col("canonical")).alias("coverage"),
        prevalence.alias("prevalence"),
        F.when(base > 0, (prevalence - base) / base).alias("drift"),
        (F.col("covered") / F.col("canonical") >= near).alias("near_complete"),
    ).drop("_pos")


def missing_and_extra(canon: DataFrame, preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every missing or extra id per model in long form."""
    ids = _membership(canon, preds, models)
    entry = [F.struct(F.lit(m).alias("model"), F.col(f"has_{m}").alias("has")) for m in models]
    long = ids.select("id", "in_canon", F.inline(F.array(*entry))).filter(F.col("in_canon") != F.col("has"))
    return long.select("model", F.when(F.col("in_canon"), "missing").otherwise("extra").alias("side"), "id")


def intersection_prevalence(canon: DataFrame, preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Prevalence over canonical ids all the given models cover."""
    wide = by_head(preds, models).filter(present(models) == len(models)).select("id")
    return canon.join(wide, "id", "left_semi").agg(F.count(F.lit(1)).alias("ids"), F.avg("label").alias("prevalence"))


def duplicate_histogram(preds: DataFrame) -> DataFrame:
    """How many ids per model occur once, twice, ..."""
    per_id = preds.groupBy("model", "id").agg(F.count(F.lit(1)).alias("duplicate_count"))
    return per_id.groupBy("model", "duplicate_count").agg(F.count(F.lit(1)).alias("ids"))


def union_inflation(canon: DataFrame, preds: DataFrame, limit: float = 1.05) -> DataFrame:
    """Distinct predicted ids over canonical size, per split."""
    union = preds.groupBy("split").agg(F.count_distinct("id").alias("union_ids"))
    size = canon.groupBy("split").agg(F.count_distinct("id").alias("canonical"))
    ratio = F.col("union_ids") / F.col("canonical")
    return union.join(size, "split").select("*", ratio.alias("inflation"), (ratio > limit).alias("inflated"))


def require_no_inflation(canon: DataFrame, preds: DataFrame, limit: float = 1.05) -> None:
    bad = union_inflation(canon, preds, limit).filter("inflated").collect()
    if bad:
        raise ValueError("union inflation: " + ", ".join(f"{r.split} {r.inflation:.3f}" for r in bad))


def combinations(preds: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Ids per combination of present heads, joined by ``+`` in head order."""
    wide = by_head(preds, heads)
    combo = F.concat_ws("+", *[F.when(F.col(h).isNotNull(), F.lit(h)) for h in heads])
    return wide.groupBy(combo.alias("combo")).agg(F.count(F.lit(1)).alias("ids"))


def missing_causes(canon: DataFrame, preds: DataFrame, base: Sequence[str], derived: Sequence[str]) -> DataFrame:
    """For canonical ids lacking a derived model, which base heads they have."""
    heads = [*base, *derived]
    wide = canon.select("id").join(by_head(preds, heads), "id", "left")
    cause = F.concat_ws("+", *[F.when(F.col(h).isNotNull(), F.lit(h)).otherwise(F.lit("_")) for h in base])
    entry = [F.struct(F.lit(d).alias("model"), F.col(d).isNull().alias("gone")) for d in derived]
    long = wide.select(cause.alias("cause"), F.inline(F.array(*entry))).filter("gone")
    return long.groupBy("model", "cause").agg(F.count(F.lit(1)).alias("ids"))


def head_gap_breakdown(canon: DataFrame, preds: DataFrame, head: str, other: str, raw: Sequence[str]) -> DataFrame:
    """Canonical rows a head has not scored, by presence of another head and of raw fields."""
    scored = by_head(preds, [head, other])
    j = canon.select("id", *raw).join(scored, "id", "left")
    gap = F.col(head).isNull()
    any_raw = F.greatest(*[F.col(c).isNotNull().cast("int") for c in raw], F.lit(0)) == 1
    has_other = F.col(other).isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("canonical"),
        F.count_if(~gap).alias("covered"),
        F.count_if(gap).alias("missing"),
        F.count_if(gap & has_other).alias("missing_with_other"),
        F.count_if(gap & has_other & ~any_raw).alias("other_but_no_field"),
        F.count_if(gap & ~has_other & ~any_raw).alias("no_other_no_field"),
        F.count_if(gap & any_raw).alias("field_but_no_pred"),
        *[F.count_if(gap & F.col(c).isNotNull()).alias(f"missing_with_{c}") for c in raw],
    )


def gap_class(found: Column, text: Column, short: int = 200) -> Column:
    """Why an id has no script prediction."""
    return (
        F.when(~found, "no_record")
        .when(text.isNull(), "no_js_field")
        .when(F.length(text) == 0, "empty_js")
        .when(F.length(text) < short, "short_js")
        .otherwise("has_js")
    )


def gap_summary(missing: DataFrame, pages: DataFrame, text: str, key: str = "id", short: int = 200) -> DataFrame:
    """Counts and percentages per split and class, with a combined row from a rollup."""
    found = pages.select(key, F.col(text).alias("_text"), F.lit(True).alias("_found"))
    j = missing.join(found, key, "left")
    kind = gap_class(F.coalesce("_found", F.lit(False)), F.col("_text"), short)
    cells = j.select("split", kind.alias("gap")).groupBy("split", "gap").agg(F.count(F.lit(1)).alias("ids"))
    both = cells.unionByName(cells.groupBy("gap").agg(F.sum("ids").alias("ids")).withColumn("split", F.lit("combined")))
    total = F.sum("ids").over(Window.partitionBy("split"))
    return both.withColumn("pct", F.col("ids") * 100.0 / total)


def novelty(base: DataFrame, augmented: DataFrame, key: str = "id") -> DataFrame:
    """Identical rows shared by two versions of a table, id overlap, recommendation."""
    def digests(df):
        return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).distinct()

    def ids(df):
        return df.select(key).distinct()

    b, a = digests(base), digests(augmented)
    both = a.join(b.withColumn("in_base", F.lit(1)), "h", "left")
    counts = both.agg(F.count(F.lit(1)).alias("aug_distinct"), F.sum(F.coalesce("in_base", F.lit(0))).alias("identical_lines"))
    over = ids(augmented).join(ids(base).withColumn("in_base", F.lit(1)), key, "left").agg(
        F.count(F.lit(1)).alias("aug_ids"), F.sum(F.coalesce("in_base", F.lit(0))).alias("id_overlap"))
    ratio = F.col("identical_lines") / F.greatest(F.lit(1), F.col("aug_distinct"))
    advice = F.when(ratio > 0.98, "drop_as_redundant").when(ratio > 0.9, "regenerate_more_diverse").otherwise("keep")
    one = counts.withColumn("_k", F.lit(1)).join(over.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.select("*", ratio.alias("identical_ratio"), (1 - ratio).alias("novelty_ratio"), advice.alias("recommendation"))


def head_anomalies(preds: DataFrame, keys: Sequence[str] = ("model", "split"), high_mean: float = 0.95, low_var: float = 1e-3) -> DataFrame:
    """Heads whose scores are nearly all high or nearly constant."""
    c = preds.groupBy(*keys).agg(
        F.avg("prob").alias("mean"), F.var_pop("prob").alias("variance"), F.min("prob").alias("min"), F.max("prob").alias("max"))
    return c.withColumn("flagged", (F.col("mean") > high_mean) | (F.col("variance") < low_var))


def retrain_plan(rows: DataFrame, hard: str, max_fraction: float = 0.30) -> DataFrame:
    """Class weights and the cap on hard negatives."""
    pos = F.sum(F.col("label").cast("long"))
    c = rows.agg(F.count(F.lit(1)).alias("total"), pos.alias("positives"), F.count_if(F.col(hard)).alias("hard_negatives"))
    neg = F.col("total") - F.col("positives")
    ratio = F.col("positives") / F.col("total")
    both = (ratio > 0) & (ratio < 1)
    allowed = F.floor(neg * max_fraction)
    return c.select(
        "*", neg.alias("negatives"), ratio.alias("positive_ratio"),
        F.when(both, F.lit(0.5) / ratio).otherwise(F.lit(1.0)).alias("weight_pos"),
        F.when(both, F.lit(0.5) / (1 - ratio)).otherwise(F.lit(1.0)).alias("weight_neg"),
        F.when(F.col("positives") > 0, neg / F.col("positives")).alias("pos_weight"),
        allowed.alias("hard_allowed"), (F.col("hard_negatives") > allowed).alias("downsample"),
    )


def feature_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample variance per column, one pass, one row per column."""
    agg = df.agg(*[F.struct(F.avg(c).alias("mean"), F.var_samp(c).alias("variance")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.variance").alias("variance")) for c in columns])
    return agg.select(F.inline(rows))


def kpi_row(metrics: DataFrame, wanted: dict[str, tuple[str, str]], run: str = "run") -> DataFrame:
    """One KPI row per run out of a tidy (run, source, metric, value) table."""
    picks = [
        F.max(F.when((F.col("source") == s) & (F.col("metric") == k), F.col("value"))).alias(name)
        for name, (s, k) in wanted.items()
    ]
    return metrics.groupBy(run).agg(*picks)


def gate(current: DataFrame, baseline: DataFrame, keys: Sequence[str], max_drop: float = 0.02, max_rise: float = 0.02) -> DataFrame:
    """Relative precision drop and FPR rise against a baseline; no baseline passes."""
    base = baseline.select(*keys, F.col("precision").alias("base_precision"), F.col("fpr").alias("base_fpr"))
    j = current.join(base, list(keys), "left")
    bp, bf = F.coalesce("base_precision", "precision"), F.coalesce("base_fpr", "fpr")
    drop = F.when(bp > 0, (bp - F.col("precision")) / bp).otherwise(F.lit(0.0))
    rise = F.when(bf > 0, (F.col("fpr") - bf) / bf).otherwise(F.lit(0.0))
    return j.select(*keys, drop.alias("precision_drop"), rise.alias("fpr_rise"), ((drop <= max_drop) & (rise <= max_rise)).alias("passed"))


def require_gate(verdicts: DataFrame) -> None:
    bad = verdicts.filter(~F.col("passed")).collect()
    if bad:
        raise ValueError(f"gate failed: {[r.asDict() for r in bad]}")


def fingerprint60(value: Column) -> Column:
    """A 60-bit hash that fits BIGINT and exists in other engines too."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("bigint")


def manifest(df: DataFrame, keys: Sequence[str] = ("split",), key: str = "id") -> DataFrame:
    """Counts and order-free fingerprints of the ids of each split; the sum also tells repeated ids."""
    h = fingerprint60(F.col(key))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"), F.bit_xor(h).alias("ids_hash"),
        F.sum(h.cast("decimal(28,0)")).cast("string").alias("ids_sum"))


def dataset_drift(full: DataFrame, used: DataFrame) -> DataFrame:
    """Full table against the union of splits."""
    f = full.groupBy("id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("copies"))
    u = used.select("id").distinct().withColumn("used", F.lit(True))
    j = f.join(u, "id", "full")
    inside, taken = F.col("copies").isNotNull(), F.col("used").isNotNull()
    total = F.sum(F.coalesce("copies", F.lit(0)))
    return j.agg(
        total.alias("full_total"), F.sum(F.coalesce(F.col("label") * F.col("copies"), F.lit(0))).alias("full_pos"),
        F.count_if(taken).alias("used_ids"), (F.count_if(taken) / total).alias("coverage_ratio"),
        F.count_if(inside & ~taken).alias("missing_count"), F.count_if(taken & ~inside).alias("extra_count"))


def compare_variants(metrics: DataFrame, base: str = "fused") -> DataFrame:
    """PR gain over the base variant, FPR95 - FPR90 and whether it is the smallest of its split."""
    ref = metrics.filter(F.col("model") == base).select("split", F.col("pr_auc").alias("_base"))
    j = metrics.join(ref, "split", "left")
    gap = F.col("fpr_at_tpr95") - F.col("fpr_at_tpr90")
    rows = j.select("*", (F.col("pr_auc") - F.col("_base")).alias("pr_delta"), gap.alias("fpr_delta")).drop("_base")
    return rows.withColumn("smallest_gap", F.col("fpr_delta") == F.min("fpr_delta").over(Window.partitionBy("split")))


def recommend(metrics: DataFrame, tag: str) -> DataFrame:
    """Per split the variant of lowest FPR at a TPR target, then best PR."""
    fpr, thr = f"fpr_at_tpr{tag}", f"thr_at_tpr{tag}"
    pick = F.min_by(F.struct(F.col("model").alias("variant"), F.col(thr).alias("thr"), F.col(fpr).alias("fpr")), F.struct(F.col(fpr), -F.col("pr_auc")))
    return metrics.filter(F.col(fpr).isNotNull()).groupBy("split").agg(pick.alias("b")).select("split", F.lit(f"TPR{tag}").alias("target"), "b.*")


def paired_delta(metrics: DataFrame, base: str, other: str, columns: Sequence[str]) -> DataFrame:
    """Metric of one model minus that of another, per split."""
    picks = [
        (F.max(F.when(F.col("model") == other, F.col(c))) - F.max(F.when(F.col("model") == base, F.col(c)))).alias(f"d_{c}")
        for c in columns
    ]
    return metrics.groupBy("split").agg(*picks)


def uplift(rows: DataFrame, refined: DataFrame, threshold: float) -> DataFrame:
    """Precision before and after band probabilities are replaced."""
    new = refined.select("id", F.col("prob").alias("_new"))
    j = rows.join(new, "id", "left")
    before, after = F.col("prob") >= threshold, F.coalesce("_new", "prob") >= threshold
    pos = F.col("label") == 1
    c = j.agg(*[F.count_if(cond).alias(n) for n, cond in {
        "base_tp": before & pos, "base_fp": before & ~pos, "new_tp": after & pos, "new_fp": after & ~pos}.items()])
    base = F.col("base_tp") / F.greatest(F.lit(1), F.col("base_tp") + F.col("base_fp"))
    new_p = F.col("new_tp") / F.greatest(F.lit(1), F.col("new_tp") + F.col("new_fp"))
    return c.select("*", base.alias("base_precision"), new_p.alias("refined_precision"), (new_p - base).alias("uplift"))


def modality_counts(rows: DataFrame, flags: Sequence[str], keys: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, positives and negatives per modality present."""
    entry = [F.struct(F.lit(f).alias("modality"), F.col(f).alias("has")) for f in flags]
    long = rows.select(*keys, "label", F.inline(F.array(*entry))).filter("has")
    return long.groupBy("modality", *keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def ambiguous(preds: DataFrame, n: int, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Per class the n rows closest to 0.5."""
    return first_n(preds, keys, [F.abs(F.col("prob") - 0.5), "id"], n).withColumnRenamed("_rn", "rank")


def last_n(df: DataFrame, order: str, n: int = 200) -> DataFrame:
    """the newest n rows, as a distributed top-n."""
    return df.orderBy(F.desc(order)).limit(n)


def needs_enrichment(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Whole-table test whether enrichment must run: any row without a marker, or no rows with one."""
    some = F.coalesce(*[F.col(m).cast("string") for m in markers]).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(some).alias("enriched")).withColumn(
        "needed", (F.col("rows") > 0) & (F.col("enriched") < F.col("rows")))
