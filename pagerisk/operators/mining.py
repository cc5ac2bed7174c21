"""False-positive mining: document text, TF-IDF, clusters, hard-negative seeds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerisk.operators.audits import first_n, sample_lists
from pagerisk.operators.joins import settled
from pagerisk.operators.running import hash_ranked


def document_urls(rows: DataFrame, pages: DataFrame, url_head: DataFrame) -> DataFrame:
    """The url of each row from the page table, else from the url head, else its id."""
    a = pages.select("id", F.col("url").alias("_page_url"))
    b = url_head.select("id", F.col("url").alias("_head_url"))
    j = rows.join(a, "id", "left").join(b, "id", "left")
    return j.withColumn("url", F.coalesce("_page_url", "_head_url", F.col("id").cast("string"))).drop("_page_url", "_head_url")


def vocabulary(terms: DataFrame, size: int) -> DataFrame:
    """The ``size`` terms in most documents, ties by term, with their document frequency and index."""
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    top = df.orderBy(F.desc("df"), "term").limit(size)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "term")  # at most ``size`` rows
    return top.withColumn("idx", F.row_number().over(w) - 1)


def term_vectors(docs: DataFrame, tokens: str, size: int = 500, key: str = "id") -> tuple[DataFrame, list[str]]:
    """(key, features): sparse TF-IDF vectors of unit length over the ``size`` commonest terms, and those terms by index.

    One pass counts document frequencies and, as the term NULL, the documents.
    Only the vocabulary comes to the driver; every row is then weighted where it
    is. Documents without a term of the vocabulary are left out.
    """
    filled = docs.filter(F.size(tokens) > 0)
    terms = filled.select(F.explode(F.array_append(F.array_distinct(tokens), F.lit(None).cast("string"))).alias("term"))
    counts = settled(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    top = counts.filter("term IS NOT NULL").orderBy(F.desc("df"), "term").limit(size).collect()
    known = [r.term for r in top]
    if not known:
        return docs.select(key, array_to_vector(F.array(F.lit(0.0))).alias("features")).limit(0), known
    total = counts.filter("term IS NULL").first().df
    idf = Vectors.dense([math.log((1.0 + total) / (1.0 + r.df)) + 1.0 for r in top])
    counter = CountVectorizerModel.from_vocabulary(known, inputCol=tokens, outputCol="_n")
    counter.setMinTF(1.0)
    own = filled.filter(F.exists(tokens, lambda t: t.isin(known))).select(key, tokens)
    scaled = ElementwiseProduct(scalingVec=idf, inputCol="_n", outputCol="_scaled").transform(counter.transform(own))
    return Normalizer(p=2.0, inputCol="_scaled", outputCol="features").transform(scaled).select(key, "features"), known


def tfidf(docs: DataFrame, tokens: str, size: int = 500, key: str = "id") -> DataFrame:
    """(key, term, idx, weight) with smoothed idf and unit length per document; one row per key."""
    vectors, known = term_vectors(docs, tokens, size, key)
    rows = vectors.select(key, F.posexplode(vector_to_array("features")).alias("idx", "weight")).filter("weight > 0")
    return rows.withColumn("term", F.get(F.array(*[F.lit(t) for t in known]), F.col("idx"))).select(key, "term", "idx", "weight")


def cluster(vectors: DataFrame, k: int = 8, iterations: int = 25, seed: int = 42, key: str = "id") -> DataFrame:
    """K-means over sparse weight vectors (key, features); (key, cluster)."""
    held = settled(vectors.select(key, "features"), "cluster-vectors")
    n = held.limit(k).count()
    if not n:
        return held.select(key, F.lit(0).alias("cluster"))
    model = KMeans(k=max(2, min(k, n)), maxIter=iterations, seed=seed, initMode="random").fit(held)
    return model.transform(held).select(key, F.col("prediction").alias("cluster"))


def cluster_summary(weights: DataFrame, clusters: DataFrame, terms: int = 15, ids: int = 10, key: str = "id") -> DataFrame:
    """Size, strongest terms by mean weight and sample ids of each cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    mean = weights.join(clusters, key).groupBy("cluster", "term").agg(F.sum("weight").alias("s")).join(sizes, "cluster")
    ranked = first_n(mean.select("cluster", "term", (F.col("s") / F.col("size")).alias("mean")).filter("mean > 0"), ["cluster"], [F.desc("mean"), "term"], terms)
    top = ranked.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda r: r.term), " ").alias("top_terms"))
    return sizes.join(top, "cluster", "left").join(sample_lists(clusters, ["cluster"], key, ids, "sample_ids"), "cluster")


def seed_rows(clusters: DataFrame, chosen: Sequence, per_cluster: int = 30, key: str = "id") -> DataFrame:
    """The first ids of the chosen clusters as benign seeds."""
    picked = first_n(clusters.filter(F.col("cluster").isin(*chosen)), ["cluster"], [key], per_cluster)
    return picked.select(key, "cluster", F.lit(0).alias("label"), F.lit("benign_cluster_pattern").alias("reason"))


def hold_out(band: DataFrame, share: float = 0.30, seed: int = 42, key: str = "id") -> DataFrame:
    """The first share of each class in hash order is held out (one row at least)."""
    r = hash_ranked(band, key, seed, ["label"])
    return r.withColumn("held_out", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("rank_of") * share))).drop("rank", "rank_of")


def contrast_sample(preds: DataFrame, n: int, below: float = 0.01, seed: int = 42, key: str = "id") -> DataFrame:
    """I16: n benign rows of very low score in hash order, one per id."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    low = preds.filter((F.col("label") == 0) & (F.col("prob") < below))
    return low.withColumn("_d", digest).orderBy("_d", key).limit(n).drop("_d")


def purity_by_cluster(tokens: DataFrame, clusters: DataFrame, purity: Column, key: str = "id") -> DataFrame:
    """C38 per cluster: mean share of suspicious terms."""
    return tokens.join(clusters, key).groupBy("cluster").agg(F.avg(purity).alias("purity"))
