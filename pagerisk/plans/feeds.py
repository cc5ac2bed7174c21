"""Feed and seed queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagerisk.functions import urls as u
from pagerisk.operators import seeds as sd
from pagerisk.plans.registry import query
from pagerisk.session import work_dir
from pagerisk.sources import feeds as fd
from pagerisk.sources import jsonl

# Three overlapping feeds out of the page urls: plain http pages, .com pages, and all pages as ranked sites.
FEED_ROWS = """inline(array(named_struct('source', 'alpha', 'source_rank', 0, 'label', 1, 'keep', url LIKE 'http:%'), named_struct('source', 'beta', 'source_rank', 1, 'label', 1, 'keep', url LIKE '%.example.com/%'), named_struct('source', 'ranked', 'source_rank', 2, 'label', 0, 'keep', true)))"""
FEEDS_CTE = """feeds AS (SELECT page_id AS pos, url, 'alpha' AS source, 0 AS source_rank, 1 AS label FROM pages WHERE url LIKE 'http:%' UNION ALL SELECT page_id, url, 'beta', 1, 1 FROM pages WHERE url LIKE '%.example.com/%' UNION ALL SELECT page_id, url, 'ranked', 2, 0 FROM pages)"""
SEEN = "url LIKE '%/fr/%'"


def feeds(t):
    return t("pages").selectExpr("page_id AS pos", "url", FEED_ROWS).filter("keep").drop("keep")


def seen(t):
    return t("pages").filter(SEEN).select("url")


# --- JSON lines ------------------------------------------------------------

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("lang", T.StringType())])


@query("a1_strict_jsonl_scan", "SELECT page_id, url, CASE WHEN url LIKE '%/en/%' THEN 'en' END AS lang FROM pages")
def _(t):
    path = work_dir(t.spark, "strict")
    jsonl.write_jsonl(t("pages").selectExpr("page_id", "url", "CASE WHEN url LIKE '%/en/%' THEN 'en' END AS lang"), path)
    return jsonl.read_strict(t.spark, path, PAGE)


def damaged(t):
    path = work_dir(t.spark, "damaged")
    good = F.to_json(F.struct("page_id", "url"))
    line = F.when(F.col("url").like("%/de/%"), F.concat(F.lit("{"), F.col("url"))).when(F.col("url").like("%/es/%"), F.lit("  ")).otherwise(good)
    t("pages").select(line.alias("value")).write.text(path)
    return path


@query("a2_tolerant_jsonl_scan", "SELECT page_id, url, NULL::VARCHAR AS lang FROM pages WHERE url NOT LIKE '%/de/%' AND url NOT LIKE '%/es/%'")
def _(t):
    return jsonl.read_tolerant(t.spark, damaged(t), PAGE)


@query("a2_malformed_count", "SELECT count(*) FILTER (WHERE url NOT LIKE '%/es/%') AS lines, count(*) FILTER (WHERE url LIKE '%/de/%') AS malformed FROM pages")
def _(t):
    return jsonl.count_malformed(t.spark, damaged(t), PAGE)


@query("a3_jsonl_sink", """SELECT '{"c_custkey":' || c_custkey || CASE WHEN c_acctbal > 0 THEN ',"seg":"' || c_mktsegment || '"' ELSE '' END || '}' AS value, count(*) AS n FROM customer, (SELECT unnest([1, 2]) AS i) GROUP BY 1""")
def _(t):
    path = work_dir(t.spark, "jsonl")
    rows = t("customer").selectExpr("c_custkey", "CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS seg")
    jsonl.write_jsonl(rows, path)
    jsonl.write_jsonl(rows, path)
    return t.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# --- feed files ------------------------------------------------------------

@query("a4_any_feed_scan", """SELECT 'csv' AS kind, trim(url) AS url FROM pages UNION ALL SELECT 'domain', regexp_extract(url, '://([^/]*)', 1) FROM pages UNION ALL SELECT 'lines', url FROM pages""")
def _(t):
    base, p = work_dir(t.spark, "feeds"), t("pages")
    p.selectExpr("page_id AS rank", "concat(' ', url, ' ') AS URL").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/csv")
    p.selectExpr("page_id AS rank", "regexp_extract(url, '://([^/]*)', 1) AS domain").write.option("header", True).csv(f"{base}/domain")
    p.selectExpr("explode(array('url', url, '')) AS value").write.text(f"{base}/lines")
    parts = [fd.read_urls(t.spark, f"{base}/{k}").select(F.lit(k).alias("kind"), "url") for k in ("csv", "domain", "lines")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a5_bz2_feed", "SELECT page_id, url FROM pages")
def _(t):
    path = work_dir(t.spark, "bz2")
    t("pages").select("page_id", "url").write.option("compression", "bzip2").option("header", True).csv(path)
    return t.spark.read.schema("page_id BIGINT, url STRING").option("header", True).csv(path)


@query("a6_domain_blocklist", "SELECT 'http://' || regexp_extract(url, '://([^/]*)', 1) || '/' AS url, 1 AS label, count(*) AS n FROM pages WHERE url NOT LIKE '%/de/%' AND url NOT LIKE '%/es/%' GROUP BY 1")
def _(t):
    path = work_dir(t.spark, "blocklist")
    host = "regexp_extract(url, '://([^/]*)', 1)"
    t("pages").selectExpr(f"CASE WHEN url LIKE '%/de/%' THEN concat('# ', {host}) WHEN url LIKE '%/es/%' THEN concat('bad one ', {host}) WHEN url LIKE 'https:%' THEN concat('||', upper({host}), '^') ELSE concat('0.0.0.0 ', {host}) END AS value").write.text(path)
    return fd.blocklist(fd.read_lines(t.spark, path)).groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))


CANON_SQL = """rtrim(regexp_replace(url, '#.*$', ''), '/')"""


@query("a7_csv_by_name", f"SELECT {CANON_SQL} AS url, 1 AS label FROM pages WHERE url NOT LIKE '%/de/%'")
def _(t):
    path = work_dir(t.spark, "named")
    t("pages").selectExpr("CASE WHEN url LIKE '%/de/%' THEN concat('#', page_id) ELSE CAST(page_id AS STRING) END AS phish_id", "url").write.option("header", True).option("comment", "~").csv(path)
    return fd.csv_named(t.spark, path)


@query("a8_yearly_csv", f"SELECT {CANON_SQL} AS url, CASE WHEN url LIKE 'https:%' THEN 2024 ELSE 2022 END AS year, CASE WHEN url LIKE 'https:%' THEN -2024 ELSE -2022 END AS file_rank FROM pages")
def _(t):
    base = work_dir(t.spark, "yearly")
    for year, cond in ((2024, "url LIKE 'https:%'"), (2022, "url NOT LIKE 'https:%'")):
        t("pages").filter(cond).selectExpr("'2024-01-01' AS d", "url", "'x' AS note").write.csv(f"{base}/{year}")
    return fd.yearly(t.spark, f"{base}/*").select("url", "year", "file_rank")


@query("a9_csv_with_predicate", f"SELECT {CANON_SQL} AS url FROM pages WHERE url LIKE '%/fr/%'")
def _(t):
    path = work_dir(t.spark, "threat")
    t("pages").selectExpr("page_id", "url", "'online' AS status", "CASE WHEN url LIKE '%/fr/%' THEN 'Phishing_kit' ELSE 'malware' END AS threat").write.csv(path)
    return fd.csv_positional(t.spark, path, 1, 3, "phish").select("url")


@query("a10_line_feeds", f"""WITH l AS (SELECT 0 AS file_rank, page_id, {CANON_SQL} AS url FROM pages WHERE url LIKE 'http:%' UNION ALL SELECT 1, page_id, {CANON_SQL} FROM pages), f AS (SELECT url, min((file_rank, page_id)) AS k FROM l WHERE url NOT IN (SELECT {CANON_SQL} FROM pages WHERE {SEEN}) GROUP BY url)
SELECT url FROM f ORDER BY k LIMIT 60""")
def _(t):
    base, p = work_dir(t.spark, "lines"), t("pages")
    p.filter("url LIKE 'http:%'").orderBy("page_id").select("url").write.text(f"{base}/a")
    p.orderBy("page_id").select("url").write.text(f"{base}/b")
    known = seen(t).select(u.canonical(F.col("url")).alias("url"))
    parts = [fd.read_lines(t.spark, f"{base}/{k}").select(u.canonical(F.col("value")).alias("url"), F.lit(i).alias("source_rank"), "pos") for i, k in enumerate("ab")]
    fresh = sd.first_seen(parts[0].unionByName(parts[1]).join(known, "url", "left_anti"))
    return fresh.orderBy("source_rank", "pos").limit(60).select("url")


SITES = "c_custkey AS rank, lower(replace(c_name, '#', '-')) || '.org' AS domain"


def sites(t):
    return t("customer").selectExpr("c_custkey AS rank", "concat(lower(replace(c_name, '#', '-')), '.org') AS domain")


@query("a11_ranked_sites", f"SELECT 'https://' || domain || '/' AS url, 0 AS label, rank FROM (SELECT {SITES} FROM customer) ORDER BY rank, domain LIMIT 500")
def _(t):
    return fd.ranked_sites(sites(t), 500)


@query("a11_unseen_sites", f"""WITH s AS (SELECT {SITES}, c_acctbal FROM customer), k AS (SELECT domain, rank, CASE WHEN c_acctbal > 5000 THEN 'http://' ELSE 'https://' END || domain || '/' AS url FROM s WHERE c_acctbal > 0)
SELECT domain, url, rank FROM k ORDER BY rank LIMIT 700""")
def _(t):
    s = t("customer").selectExpr("c_custkey AS rank", "concat(lower(replace(c_name, '#', '-')), '.org') AS domain", "c_acctbal")
    https, http = s.filter("c_acctbal > 5000 OR c_acctbal <= 0").selectExpr("concat('https://', domain, '/') AS url"), s.filter("c_acctbal <= 0").selectExpr("concat('http://', domain, '/') AS url")
    return sd.unseen_sites(sites(t), https.unionByName(http), 700)


@query("a12_seed_csv", "WITH " + FEEDS_CTE + " SELECT url, label, source FROM feeds")
def _(t):
    path = work_dir(t.spark, "seed")
    fd.write_seed(feeds(t), path)
    return fd.read_seed(t.spark, path)


# --- seed building ---------------------------------------------------------

@query("h1_union_of_feeds", "WITH " + FEEDS_CTE + " SELECT url, label, source, source_rank, pos FROM feeds WHERE source <> 'ranked'")
def _(t):
    p = t("pages").selectExpr("page_id AS pos", "regexp_replace(url, '^http://', '') AS url")
    a = fd.tagged(p.filter("url NOT LIKE 'https:%'"), "alpha", 1, 0)
    b = fd.tagged(p.filter("url LIKE '%.example.com/%'"), "beta", 1, 1)
    return a.unionByName(b)


@query("f6_first_seen", "WITH " + FEEDS_CTE + ", k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, pos) AS rn FROM feeds) SELECT url, label, source, source_rank, pos FROM k WHERE rn = 1")
def _(t):
    return sd.first_seen(feeds(t))


@query("g2_limit_per_source", "WITH " + FEEDS_CTE + ", k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM feeds) SELECT url, label, source, source_rank, pos, rank FROM k WHERE CASE source WHEN 'alpha' THEN rank <= 40 WHEN 'ranked' THEN rank <= 90 ELSE true END")
def _(t):
    return sd.limit_per_source(feeds(t), {"alpha": 40, "ranked": 90})


@query("g8_seeded_shuffle", "SELECT event_id, row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS place FROM events")
def _(t):
    return sd.shuffled(t("events").select("event_id"), "event_id", 7)


ALLOC = """av AS (SELECT count(*) FILTER (WHERE source = 'alpha') AS a, count(*) FILTER (WHERE source = 'beta') AS b, count(*) FILTER (WHERE source = 'ranked') AS r FROM feeds),
t1 AS (SELECT *, 120 AS want, least(round_even(120 * (a::DOUBLE / greatest(a + b, 1)), 0)::BIGINT, a) AS ta FROM av), t2 AS (SELECT *, least(want - ta, b) AS tb FROM t1), t3 AS (SELECT *, want - ta - tb AS slack FROM t2),
t4 AS (SELECT *, least(slack, a - ta) AS ma FROM t3), al AS (SELECT ta + ma AS na, tb + least(slack - ma, b - tb) AS nb, least(200 - want, r) AS nr FROM t4)"""


@query("i11_target_allocation", "WITH " + FEEDS_CTE + ", " + ALLOC + """, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM feeds)
SELECT url, source, label FROM k, al WHERE rank <= CASE source WHEN 'alpha' THEN na WHEN 'beta' THEN nb ELSE nr END""")
def _(t):
    return sd.allocate(feeds(t), ["alpha", "beta"], "ranked", 200, 0.6).select("url", "source", "label")


FAIR = FEEDS_CTE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM feeds WHERE NOT ({SEEN})), t AS (SELECT *, CASE WHEN rank <= 30 THEN 0 ELSE 1 + (rank - 31) // 20 END AS turn FROM r),
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn, source_rank, rank) AS rn FROM t), g AS (SELECT *, row_number() OVER (ORDER BY turn, source_rank, rank) AS place FROM u WHERE rn = 1)"""


@query("i12_fair_share", "WITH " + FAIR + " SELECT url, source, label, source_rank, pos, turn, place FROM g WHERE place <= 90")
def _(t):
    return sd.fair_share(feeds(t), seen(t), 3, 90, refill=20)


@query("i13_incremental_mix", "WITH " + FEEDS_CTE + f""", e AS (SELECT count(*) AS n FROM pages WHERE {SEEN}), nd AS (SELECT floor((400 - n) * 25e-2)::BIGINT AS bad, 400 - n - floor((400 - n) * 25e-2)::BIGINT AS good FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rank FROM feeds WHERE NOT ({SEEN}) AND source <> 'ranked'), t AS (SELECT r.*, bad, CASE WHEN rank <= greatest(1, bad // 2) THEN 0 ELSE 1 + (rank - greatest(1, bad // 2) - 1) // 500 END AS turn FROM r, nd),
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn, source_rank, rank) AS rn FROM t), g AS (SELECT *, row_number() OVER (ORDER BY turn, source_rank, rank) AS place FROM u WHERE rn = 1),
s AS (SELECT {SITES} FROM customer), o AS (SELECT 1 AS label, source, url FROM g WHERE place <= bad UNION ALL SELECT 0, 'ranked', 'https://' || domain || '/' FROM s, nd WHERE rank < (SELECT min(c_custkey) FROM customer) + good)
SELECT url, label, source FROM o""")
def _(t):
    return sd.gather_mixed(feeds(t).filter("source <> 'ranked'"), sites(t), seen(t), 2, 400, 0.25)


@query("i17_minimum_count", "SELECT count(*) < 200 AS below_200, count(*) < 1000000000 AS below_huge FROM pages")
def _(t):
    p = t("pages").select("page_id")
    return t.spark.range(1).select(F.lit(sd.below_minimum(p, 200)).alias("below_200"), F.lit(sd.below_minimum(p, 1_000_000_000)).alias("below_huge"))


@query("e41_source_counts", "WITH " + FEEDS_CTE + " SELECT source, label, count(*) AS n FROM feeds GROUP BY ALL")
def _(t):
    return sd.source_counts(feeds(t))


@query("d8_new_rows", "WITH " + FEEDS_CTE + f", k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY source_rank, pos) AS rn FROM feeds WHERE lower(trim(url)) NOT IN (SELECT lower(url) FROM pages WHERE {SEEN})) SELECT url, label, source, source_rank, pos FROM k WHERE rn = 1")
def _(t):
    shouted = feeds(t).withColumn("url", F.when(F.col("source") == "beta", F.upper("url")).otherwise(F.col("url")))
    key = u.dedup_key("final", F.col("url"), F.lit(None).cast("string"))
    out = sd.new_rows(shouted, seen(t), key, key, ["source_rank", "pos"])
    return out.withColumn("url", F.when(F.col("source") == "beta", F.lower("url")).otherwise(F.col("url")))


@query("d9_resume_skip", f"SELECT page_id, url FROM pages WHERE NOT ({SEEN})")
def _(t):
    return sd.resume(t("pages").select("page_id", "url"), seen(t)).select("page_id", "url")


HARD_SQL = """WITH tr AS (SELECT doc_id AS id, text, 1 AS label FROM documents WHERE lang = 'en'), sd AS (SELECT doc_id AS id, quality AS cluster FROM labels WHERE toxic = 0),
pool AS (SELECT doc_id AS id, text, 0 AS file_rank, 'val' AS split FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, text || '!', 1, 'test' FROM documents WHERE lang <> 'de'),
pk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_rank) AS rn FROM pool)"""


def hard_inputs(t):
    d = t("documents")
    train = d.filter("lang = 'en'").selectExpr("doc_id AS id", "text", "1 AS label")
    seeds = t("labels").filter("toxic = 0").selectExpr("doc_id AS id", "quality AS cluster", "CAST(NULL AS STRING) AS reason")
    pool = d.filter("source = 'src1'").selectExpr("doc_id AS id", "text", "1 AS label", "0 AS file_rank", "'val' AS split").unionByName(
        d.filter("lang <> 'de'").selectExpr("doc_id AS id", "concat(text, '!') AS text", "1 AS label", "1 AS file_rank", "'test' AS split"))
    return train, seeds, pool


@query("d10_hard_negatives", HARD_SQL + """ SELECT id, md5(text) AS text_md5, label, NULL::BOOLEAN AS hard_negative, NULL::INTEGER AS hard_negative_cluster, NULL::VARCHAR AS hard_negative_reason, NULL::VARCHAR AS hard_negative_source_split FROM tr
UNION ALL SELECT p.id, md5(p.text), 0, true, s.cluster, 'benign_cluster_pattern', p.split FROM pk p JOIN sd s ON p.id = s.id WHERE rn = 1 AND p.id NOT IN (SELECT id FROM tr)""")
def _(t):
    out = sd.add_hard_negatives(*hard_inputs(t))
    return out.select("id", F.md5("text").alias("text_md5"), "label", "hard_negative", "hard_negative_cluster", "hard_negative_reason", "hard_negative_source_split")


@query("d10_missing_seeds", HARD_SQL + " SELECT id FROM sd WHERE id NOT IN (SELECT id FROM tr) AND id NOT IN (SELECT id FROM pool)")
def _(t):
    return sd.missing_seeds(*hard_inputs(t)).select("id")


@query("h5_union_of_training_sets", """SELECT doc_id, md5(text) AS text_md5, NULL::VARCHAR AS variant FROM documents UNION ALL SELECT doc_id, md5(lower(text)), 'lower' FROM documents WHERE lang = 'en'""")
def _(t):
    base = t("documents").select("doc_id", F.md5("text").alias("text_md5"))
    aug = t("documents").filter("lang = 'en'").select("doc_id", F.md5(F.lower("text")).alias("text_md5"), F.lit("lower").alias("variant"))
    return base.unionByName(aug, allowMissingColumns=True)
