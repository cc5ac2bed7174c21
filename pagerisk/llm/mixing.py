"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis), in DataFrame operations only.

Every document gets the key -ln(u) / weight with u from a hash of its id. The
documents of a source in ascending key order are a weighted sample without
replacement at every length, so the prefix whose sizes fill the budget is one.
Whole epochs come first; only what is left of the target is selected by keys, past
documents too long for what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagerisk.llm.common import settle

#: A word: a run of characters other than space and the ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """Target words of every source: source, source_size, target.

    ``sizes`` has one row per source (source, source_size). Sources in code
    point order, NULL last, weigh ``weights`` in turn and share ``share`` of all
    words; no target exceeds ``most`` times its source, and the excess goes to
    the others by weight until none is above. The fixed point is a water level:
    sources sorted by cap per weight are capped as long as the level left for
    the rest lies above them.
    """
    everything = W.orderBy(F.asc_nulls_last("source"))
    by_level = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(everything))
        .withColumn("weight", F.element_at(of, (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(whole))
    )
    levels = (
        ranked.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
                          / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))))
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("water", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct("ratio", "rank"))).over(whole))
    )
    return levels.select(
        "source", "source_size",
        F.coalesce(F.when(F.col("free"), F.col("water") * F.col("weight")).otherwise(F.col("cap")), F.lit(0.0)).alias("target"),
    )


#: Ranges of the key's logarithm, and the logarithms they span; what lies outside joins the outer ranges.
RANGES, LOG_LOW, LOG_HIGH = 1 << 14, -40.0, 6.0


def fill(base: DataFrame, rests: DataFrame) -> DataFrame:
    """Which rows the fractional epoch takes: (source, start, stop, gap) for stretches of the key order.

    Rows are gone through in key order, and each that still fits is taken. Between
    two rows that do not fit that is a prefix sum, so a pass sums the rows that fit
    by range of the key, finds the range in which the first does not, and looks
    into that range alone. What is left below the target after it is smaller than
    that row, so it shrinks from pass to pass until all that fits is taken. A row
    is taken if its place lies between start and stop of a stretch (NULL: open
    ends) and its size is at most the stretch's gap.
    """
    same = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("source", *more)]
    state = settle(rests.select("source", F.col("rest").alias("gap"), F.lit(None).cast(base.schema["place"].dataType).alias("start")), "mix-state")
    stretches = None
    while True:
        fits = base.alias("b").join(state.alias("s"), same("b", "s")).filter("b.size <= s.gap AND (s.start IS NULL OR b.place > s.start)").select("b.*", "s.gap")
        parts = fits.groupBy("source", "part").agg(F.sum("size").alias("part_size"), F.max("gap").alias("gap"))
        upto = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
        parts = parts.withColumn("end", F.sum("part_size").over(upto)).filter("end > gap AND end - part_size <= gap")
        crossed = settle(parts.select("source", "part", (F.col("end") - F.col("part_size")).alias("before")), "mix-crossed")
        inside = W.partitionBy("source", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        near = fits.alias("f").join(crossed.alias("c"), same("f", "c", "part")).select("f.*", "c.before").withColumn("filled", F.col("before") + F.sum("size").over(inside))
        ends = near.groupBy("source").agg(
            F.min(F.when(F.col("filled") > F.col("gap"), F.col("place"))).alias("stop"),
            (F.max("gap") - F.coalesce(F.max(F.when(F.col("filled") <= F.col("gap"), F.col("filled"))), F.max("before"))).alias("left"),
        )
        ends = settle(ends, "mix-ends")
        done = state.alias("s").join(ends.alias("e"), same("s", "e"), "left").select("s.source", "s.start", "e.stop", "s.gap")
        stretches = settle(done if stretches is None else stretches.union(done), "mix-stretches")
        state = settle(ends.select("source", F.col("left").alias("gap"), F.col("stop").alias("start")), "mix-state")
        if state.isEmpty():
            return stretches


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0,
        quality: DataFrame | None = None, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many times each document enters the mix.

    Returns doc_id, source, size, source_size, target, copies and taken
    (size x copies), and the columns named in ``carry``. ``quality`` (doc_id,
    weight > 0) favours documents in the fractional epoch; missing, NULL or not
    positive weights count as 1. The epoch goes through the documents in key order
    and takes each that still fits, so a long document that does not fit keeps no
    shorter one out. NULL text has size 0, NULL sources form one source, NULL ids
    share one key; rows that repeat, also in their id, are judged one by one, those
    of equal key by id and size. Without ``carry`` no column but doc_id, text and
    source is looked at.

    A source may own most rows: its order is cut into ranges of the key, summed
    per range first, so that no task sees a whole source.
    """
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    if quality is not None:
        known = quality.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        base = base.join(known, "doc_id", "left")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    at = (F.log("key") - F.lit(LOG_LOW)) / F.lit(LOG_HIGH - LOG_LOW) * F.lit(float(RANGES))
    base = (
        base.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))
        .withColumn("key", -F.log(uniform) / F.col("weight"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.floor(at), F.lit(RANGES - 1))).cast("int"))
        # The number tells repeated rows apart; it is written with the row and stays.
        .withColumn("place", F.struct("key", "doc_id", "size", F.monotonically_increasing_id().alias("row")))
        .drop("weight", "key")
    )
    base = settle(base, "mix-keys")

    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, share, weights, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = settle(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    stretches = fill(base.drop("carried"), targets)
    taken = stretches.groupBy("source").agg(F.collect_list(F.struct("start", "stop", "gap")).alias("stretches"))
    facts = targets.alias("t").join(taken.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.stretches")
    placed = base.alias("p").join(settle(facts, "mix-facts").alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    place = F.col("p.place")
    chosen = F.exists("stretches", lambda s: (s.start.isNull() | (place > s.start)) & (s.stop.isNull() | (place < s.stop)) & (F.col("p.size") <= s.gap))
    chosen = chosen & (F.col("rest") > 0)  # an empty text fits into nothing, but a full source takes no more of it
    copies = (F.col("epochs") + chosen.cast("bigint")).cast("bigint")
    return placed.select(
        "p.doc_id", "p.source", "p.size", "t.source_size", "t.target", copies.alias("copies"), (F.col("p.size") * copies).alias("taken"), *([f"p.carried.{c}" for c in carry]),
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Document weights from quality labels: 2 for good, 1/2 for poor documents."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


#: SQL twin of ``mix`` over ``documents`` and ``labels``, up to its final projection.
MIX_CTE = r"""sized AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 5e-1) / 4503599627370496e0) / coalesce(q.weight, 1e0) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 2e0 WHEN 0 THEN 5e-1 END) AS weight FROM labels GROUP BY doc_id) q USING (doc_id)),
ranked AS (SELECT source, source_size, rank, [3e0, 1e0, 2e0][(rank - 1) % 3 + 1] AS weight FROM (
    SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source))),
levels AS (SELECT *, (15e-1 * sum(source_size) OVER () - coalesce(sum(2e0 * source_size) OVER w, 0e0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0)) AS level
  FROM ranked WINDOW w AS (ORDER BY 2e0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN level <= 2e0 * source_size / weight THEN weight * (
      SELECT arg_min(level, rank_level) FROM (SELECT level, row_number() OVER (ORDER BY 2e0 * source_size / weight, rank) AS rank_level, 2e0 * source_size / weight AS ratio FROM levels) WHERE level <= ratio)
    ELSE 2e0 * source_size END AS target FROM levels),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (SELECT s.*, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest, row_number() OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size) AS rn
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
it AS (SELECT source, 0 AS i, target - epochs * source_size AS gap, 0::BIGINT AS pos FROM rests UNION ALL
  SELECT source, i + 1, gap - coalesce(max(filled) FILTER (filled <= gap), 0), min(rn) FILTER (filled > gap) FROM (
    SELECT it.*, p.rn, sum(p.size) OVER (PARTITION BY it.source ORDER BY p.rn ROWS UNBOUNDED PRECEDING) AS filled FROM it JOIN placed p ON p.source IS NOT DISTINCT FROM it.source AND p.rn > it.pos AND p.size <= it.gap)
  GROUP BY source, i, gap, pos HAVING min(rn) FILTER (filled > gap) IS NOT NULL),
stretches AS (SELECT source, gap, pos, lead(pos) OVER (PARTITION BY source ORDER BY i) AS stop FROM it),
mixed AS (SELECT p.*, p.epochs + CASE WHEN p.rest > 0 AND EXISTS (SELECT 1 FROM stretches s WHERE s.source IS NOT DISTINCT FROM p.source AND p.rn > s.pos AND (s.stop IS NULL OR p.rn < s.stop) AND p.size <= s.gap) THEN 1 ELSE 0 END AS copies FROM placed p)"""
