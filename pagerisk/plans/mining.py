"""Mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.functions import urls as u
from pagerisk.operators import mining as mi
from pagerisk.plans.inputs import PREDS_CTE, WIDE_CTE, r6
from pagerisk.plans.registry import query


@query("d17_document_lookup", "WITH " + PREDS_CTE + " SELECT p.id, coalesce(g.url, CASE WHEN d.doc_id IS NOT NULL THEN 'doc://' || d.doc_id END, CAST(p.id AS VARCHAR)) AS url FROM preds p LEFT JOIN pages g ON g.page_id = p.id LEFT JOIN documents d ON d.doc_id = p.id WHERE p.model = 'url' AND p.label = 0 AND p.prob >= 3e-1")
def _(t):
    fps = t.preds().filter("model = 'url' AND label = 0 AND prob >= 0.3").select("id")
    pages = t("pages").select(F.col("page_id").alias("id"), "url")
    head = t("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc://"), "doc_id").alias("url"))
    return mi.document_urls(fps, pages, head)


TERMS = """tk AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS toks FROM documents), ex AS (SELECT id, len(toks) AS len, unnest(toks) AS term FROM tk), ct AS (SELECT id, term, count(*) AS n, max(len) AS len FROM ex GROUP BY id, term),
vo AS (SELECT term, count(*) AS df FROM ct GROUP BY term ORDER BY df DESC, term LIMIT 200)"""


def docs(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{3,})"), F.lit(1)).alias("toks"))


@query("g3_vocabulary", "WITH " + TERMS + " SELECT term, df FROM vo")
def _(t):
    terms = docs(t).select("id", F.explode(F.array_distinct("toks")).alias("term"))
    return mi.vocabulary(terms, 200).select("term", "df")


@query("e33_tfidf", "WITH " + TERMS + """, nd AS (SELECT count(*) AS total FROM tk WHERE len(toks) > 0), w AS (SELECT ct.id, ct.term, n::DOUBLE / len * (ln((1e0 + total) / (1e0 + df)) + 1e0) AS raw FROM ct JOIN vo ON ct.term = vo.term, nd)
SELECT id, term, round(raw / (sqrt(sum(raw * raw) OVER (PARTITION BY id)) + 1e-12), 6) AS weight FROM w""")
def _(t):
    return mi.tfidf(docs(t), "toks", 200).select("id", "term", r6("weight", "weight"))


def url_docs(t):
    return t("pages").select(F.col("page_id").alias("id"), u.all_tokens(F.col("url")).alias("toks"))


@query("j22_url_clusters")
def _(t):
    return mi.cluster(mi.term_vectors(url_docs(t), "toks", 300)[0], 8)


@query("e34_cluster_summary")
def _(t):
    from pagerisk.operators.joins import settled

    weights = settled(mi.tfidf(url_docs(t), "toks", 300), "weights")
    clusters = settled(mi.cluster(mi.term_vectors(url_docs(t), "toks", 300)[0], 8), "clusters")
    return mi.cluster_summary(weights, clusters, 5, 5)


@query("i14_hard_negative_seeds", "WITH k AS (SELECT doc_id AS id, lang AS cluster, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE lang IN ('en', 'de')) SELECT id, cluster, 0 AS label, 'benign_cluster_pattern' AS reason FROM k WHERE rn <= 30")
def _(t):
    return mi.seed_rows(t("documents").selectExpr("doc_id AS id", "lang AS cluster"), ["en", "de"], 30)


@query("i15_band_hold_out", "WITH " + WIDE_CTE + ", k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS r, count(*) OVER (PARTITION BY label) AS c FROM wide WHERE abs(url - 5e-1) <= 15e-2) SELECT id, label, r <= greatest(1, floor(c * 3e-1)) AS held_out FROM k")
def _(t):
    return mi.hold_out(t.wide().filter("abs(url - 0.5) <= 0.15").select("id", "label"))


@query("i16_contrast_sample", "WITH " + WIDE_CTE + " SELECT id, round(url, 6) AS prob FROM wide WHERE label = 0 AND url < 2e-2 ORDER BY md5('42|' || id), id LIMIT 100")
def _(t):
    rows = t.wide().select("id", "label", F.col("url").alias("prob"))
    return mi.contrast_sample(rows, 100, 0.02).select("id", r6("prob", "prob"))
