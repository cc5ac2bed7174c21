"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagerisk.llm.collocations import collocation_sql, collocations
from pagerisk.llm.fingerprints import edited_fingerprints
from pagerisk.llm.jaccard import similar_groups
from pagerisk.llm.language import identify_languages
from pagerisk.llm.lexical import ranked_search, ranked_search_sql
from pagerisk.llm.minhash import near_duplicates
from pagerisk.llm.mixing import MIX_CTE, label_weights, mix
from pagerisk.llm.neighbours import nearest
from pagerisk.llm.packing import pack_documents
from pagerisk.llm.quality import score_quality
from pagerisk.llm.substrings import remove_repeats
from pagerisk.llm.tokens import token_counts
from pagerisk.llm.warc import archive_pages

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=1024)


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


@query("op3_hilbert_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op4_repeated_strings")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


MIX_SQL = f"WITH RECURSIVE {MIX_CTE}\nSELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality=label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def jaccard_sql(words: int, percent: int, source: str = "documents") -> str:
    return rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM {source}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + {words - 1}], ' ') FOR i IN range(1, greatest(len(w) - {words - 2}, 2))]) END AS s FROM worded),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= {percent} * (n + m - i)),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN groups USING (doc_id)"""


@query("op10_jaccard_join", jaccard_sql(4, 85))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op11_ranked_search", ranked_search_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_collocations", collocation_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_minhash", f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_sql(2, 80)})")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
