"""Document quality by co-training of a text view and a metadata view.

Two classifiers see different sides of a document: the words of its text, and
its metadata (source, language, size and layout). Both start from the same
labels. In each round either view labels the documents of an unlabelled pool that
it is surest of, and these become training rows of the other view. At the end
each view is calibrated on labelled documents that neither has seen, and the
calibrated views are combined into one score for all documents.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import settle

#: Labelled documents and unlabelled documents that are learned from at most; hashed features of either view.
LABELLED, POOL, WORDS, FACTS = 12_000, 12_000, 1 << 13, 1 << 9
ROUNDS, SHARE = 3, 0.05


def _bits(value: Column) -> Column:
    return F.floor(F.log2(value + 1)).cast("string")


def views(docs: DataFrame) -> DataFrame:
    """doc_id with the two feature vectors ``words`` and ``facts``; whole texts, JVM operations only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.length(text)
    without = lambda letters: size - F.length(F.translate(text, letters, ""))
    share = lambda n: F.floor(20 * n / F.greatest(size, F.lit(1))).cast("string")
    fact = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("none")))
    lines = without("\n")
    tokens = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'#$%&*@<>]+"), lambda w: w != "").alias("tokens"),
        F.array(
            fact("source", F.col("source")), fact("lang", F.col("lang")), fact("size", _bits(size)), fact("lines", _bits(lines)),
            fact("line", _bits(size / (lines + 1))), fact("digits", share(without("0123456789"))), fact("marks", share(without("#$%&*@<>{}[]|\\^~=_+"))),
        ).alias("fact_tokens"),
    )
    counted = HashingTF(numFeatures=WORDS, inputCol="tokens", outputCol="counts").transform(tokens)
    facts = HashingTF(numFeatures=FACTS, inputCol="fact_tokens", outputCol="facts", binary=True).transform(counted)
    return Normalizer(inputCol="counts", outputCol="words").transform(facts).select("doc_id", "words", "facts")


def _fit(rows: DataFrame, features: str, label: str, penalty: float = 1e-3) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=30, regParam=penalty, standardization=False).fit(rows.filter(F.col(label).isNotNull()))


def _margin(rows: DataFrame, model: LogisticRegressionModel, features: str, name: str) -> DataFrame:
    """The model's log odds as column ``name``."""
    scored = model.setFeaturesCol(features).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return scored.withColumn(name, vector_to_array("_raw")[1]).drop("_raw")


def _pair(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["text_odds", "meta_odds"], outputCol="odds").transform(rows)


def _platt(rows: DataFrame, column: str) -> tuple[float, float]:
    """Slope and offset that calibrate log odds on labelled rows."""
    model = LogisticRegression(featuresCol="one", labelCol="y", maxIter=50, regParam=1e-4, standardization=False).fit(VectorAssembler(inputCols=[column], outputCol="one").transform(rows))
    return float(model.coefficients[0]), float(model.intercept)


def _sample(docs: DataFrame, labels: DataFrame, label: str, labelled: int, pool: int) -> DataFrame:
    """(doc_id, y, fold): the first labelled and unlabelled ids in order of a hash, as many as asked at most; fold 4 is kept for calibration."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().join(known, "doc_id", "left")
    ids = ids.withColumn("order", F.xxhash64("doc_id"))
    first = lambda rows, n: rows.orderBy("order", "doc_id").limit(n)
    chosen = first(ids.filter("y IS NOT NULL"), labelled).union(first(ids.filter("y IS NULL"), pool))
    return settle(chosen.select("doc_id", "y", F.pmod("order", F.lit(5)).alias("fold")), "quality-sample")


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Score all documents: doc_id, text_score, meta_score, score, keep.

    ``labels`` has doc_id and 0/1 labels (of several for one document the largest
    counts, others and NULL are ignored). Fits use ``labelled`` labelled and
    ``pool`` unlabelled documents at most, a bound on the sample and not on what
    is scored. Without labels of both classes every score is the share of
    positives, or 1/2. NULL text is empty; rows without doc_id and repeated rows
    are scored like others; columns other than doc_id, text, source and lang are
    ignored.
    """
    sample = _sample(docs, labels, label, labelled, pool)
    totals = sample.filter("fold <> 4").agg(F.avg("y").alias("share"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    held = sample.filter("fold = 4 AND y IS NOT NULL").agg(F.countDistinct("y").alias("kinds")).first()["kinds"]
    if totals["share"] is None or totals["low"] == totals["high"] or held < 2:
        even = F.lit(0.5 if totals["share"] is None else float(totals["share"]))
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), even.alias("text_score"), even.alias("meta_score"), even.alias("score"), (even >= 0.5).alias("keep"))

    # The sample has at most labelled + pool rows of three numbers: a proven bound for sending it to every task.
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "lang")
    rows = views(own.join(F.broadcast(sample), "doc_id", "left_semi")).dropDuplicates(["doc_id"]).join(F.broadcast(sample), "doc_id")
    start = F.when(F.col("fold") != 4, F.col("y"))
    rows = settle(rows.withColumn("text_y", start).withColumn("meta_y", start), "quality-views")
    for _ in range(rounds):
        text, meta = _fit(rows, "words", "text_y"), _fit(rows, "facts", "meta_y")
        scored = _margin(_margin(rows, text, "words", "text_odds"), meta, "facts", "meta_odds")
        free = scored.filter("y IS NULL AND (text_y IS NULL OR meta_y IS NULL)")
        # As many of either class as its share of the labels; the surest first.
        ends = [share * (1 - totals["share"]), 1 - share * totals["share"]]
        marks = free.agg(*[F.percentile(c, ends).alias(c) for c in ("text_odds", "meta_odds")]).first()
        if marks["text_odds"] is None:
            break

        def sure(column: str, marks=marks) -> Column:
            low, high = marks[column]
            told = F.when(F.col(column) >= max(high, 0.0), 1.0).when(F.col(column) <= min(low, 0.0), 0.0)
            return F.when(F.col("y").isNull(), told)

        rows = settle(scored.select(
            "doc_id", "words", "facts", "y", "fold",
            F.coalesce("text_y", sure("meta_odds")).alias("text_y"), F.coalesce("meta_y", sure("text_odds")).alias("meta_y"),
        ), "quality-round")
    text, meta = _fit(rows, "words", "text_y"), _fit(rows, "facts", "meta_y")
    unseen = _margin(_margin(rows.filter("fold = 4 AND y IS NOT NULL"), text, "words", "text_odds"), meta, "facts", "meta_odds")
    unseen = settle(unseen.select("y", "text_odds", "meta_odds"), "quality-calibration")
    fits = {c: _platt(unseen, c) for c in ("text_odds", "meta_odds")}
    calibrated = lambda frame: frame.withColumns({c: F.col(c) * a + b for c, (a, b) in fits.items()})
    both = LogisticRegression(featuresCol="odds", labelCol="y", maxIter=50, regParam=1e-4, standardization=False).fit(_pair(calibrated(unseen)))
    weights, offset = [float(w) for w in both.coefficients], float(both.intercept)

    every = calibrated(_margin(_margin(views(docs), text, "words", "text_odds"), meta, "facts", "meta_odds"))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    score = chance(F.col("text_odds") * weights[0] + F.col("meta_odds") * weights[1] + offset)
    return every.select(
        "doc_id", chance(F.col("text_odds")).alias("text_score"), chance(F.col("meta_odds")).alias("meta_score"), score.alias("score"), (score >= 0.5).alias("keep"),
    )
