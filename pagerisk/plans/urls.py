"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.functions import suffixes as sx
from pagerisk.functions import text as tx
from pagerisk.functions import urls as u
from pagerisk.operators.joins import fill_only
from pagerisk.plans.inputs import r6
from pagerisk.plans.registry import query

# Every page url in eight forms: as is, shouting with user info, bare, with doubled
# slashes, on an address and port, punycode, non-ASCII host, and a wildcard suffix.
FORMS = (
    "url",
    "concat('  ', replace(url, '://', '://User:pw@'), ' ')",
    "regexp_replace(url, '^[a-z]+://', '')",
    "concat(replace(replace(url, 'http', 'HTTP'), '/en/', '//EN///'), '/')",
    "regexp_replace(url, '://[^/]*', '://192.168.10.7:8080')",
    "regexp_replace(url, '://[^/]*', '://xn--bcher-kva.login-shop.co.uk')",
    "regexp_replace(url, '://[^/]*', '://bücher.example-bank.com.au')",
    "regexp_replace(url, '://[^/]*', '://a.www.shop.ck')",
)
U_CTE = f"WITH u AS (SELECT page_id, unnest([{', '.join(FORMS)}]) AS url FROM pages)"
URI_SQL = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"
PARTS_CTE = U_CTE + f""", p AS (SELECT page_id, url, regexp_extract(url, {URI_SQL}, 1) AS sch, regexp_extract(url, {URI_SQL}, 2) AS auth, regexp_extract(url, {URI_SQL}, 3) AS pth, regexp_extract(url, {URI_SQL}, 4) AS qry FROM u),
h AS (SELECT *, regexp_replace(regexp_replace(lower(auth), '^.*@', ''), ':[0-9]*$', '') AS host FROM p)"""
# Hosts under rules of several kinds: two labels, wildcards, exceptions, internationalised names, suffixes themselves.
HOSTS = ("a.b.com.co", "shop.co.at", "x.gov.it", "gov.it", "a.www.ck", "x.y.kawasaki.jp", "a.city.kawasaki.jp", "city.kawasaki.jp", "b.a.xn--55qx5d.cn", "b.a.公司.cn", "a.b.unruled")
HOST_FORMS = (*FORMS, *(f"regexp_replace(url, '://[^/]*', '://{h}')" for h in HOSTS))


def raw_rules() -> str:
    """The list's rules of public registries as they stand in the file, blank-separated, and in the ASCII form of their names."""
    lines = "\n".join(sx.list_of_spark()).split("===BEGIN PRIVATE DOMAINS===")[0].splitlines()
    rules = [line.split()[0] for line in lines if line.strip() and not line.startswith("//")]
    return " ".join(rules + [r.encode("idna").decode() for r in rules if not r.isascii()])


# The published algorithm on the raw rules, for distinct hosts: every suffix of a host is looked up as a rule.
DOMAIN_CTE = PARTS_CTE.replace(", ".join(FORMS), ", ".join(HOST_FORMS)) + f""", rules AS (SELECT unnest(string_split('{raw_rules()}', ' ')) AS rule),
l AS (SELECT DISTINCT host, string_split(host, '.') AS lab FROM h), ta AS (SELECT host, len(lab) AS n, k, array_to_string(lab[-k:], '.') AS tail FROM (SELECT *, unnest(range(1, len(lab) + 1)) AS k FROM l)),
m AS (SELECT host, k AS sl, 0 AS exc FROM ta JOIN rules ON rule = tail UNION ALL SELECT host, k - 1, 1 FROM ta JOIN rules ON rule = '!' || tail UNION ALL SELECT host, k + 1, 0 FROM ta JOIN rules ON rule = '*.' || tail WHERE k < n),
b AS (SELECT host, arg_max(sl, exc * 100 + sl) AS sl FROM m GROUP BY host),
k AS (SELECT h.*, string_split(h.host, '.') AS lab, regexp_matches(h.host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AS ip, coalesce(b.sl, 1) AS sl FROM h LEFT JOIN b ON b.host = h.host),
d AS (SELECT *, CASE WHEN ip OR NOT contains(host, '.') THEN '' ELSE array_to_string(lab[-sl:], '.') END AS suffix,
 CASE WHEN ip OR NOT contains(host, '.') THEN host ELSE array_to_string(lab[-(sl + 1):], '.') END AS etld1 FROM k)"""


def forms(t, of=FORMS):
    return t("pages").selectExpr("page_id", f"explode(array({', '.join(of)})) AS url")


@query("b1_canonical_url", U_CTE + f""", t AS (SELECT page_id, url, trim(url) AS s FROM u), p AS (SELECT page_id, url, regexp_extract(s, {URI_SQL}, 1) AS sch, regexp_extract(s, {URI_SQL}, 2) AS auth, regexp_extract(s, {URI_SQL}, 3) AS pth, regexp_extract(s, {URI_SQL}, 4) AS qry FROM t),
q AS (SELECT *, regexp_replace('/' || pth, '/{{2,}}', '/', 'g') AS pp FROM p)
SELECT page_id, url, CASE WHEN sch = '' THEN 'http' ELSE lower(sch) END || '://' || lower(auth) || CASE WHEN pp <> '/' AND ends_with(pp, '/') THEN pp[:-2] ELSE pp END || CASE WHEN qry <> '' THEN '?' || qry ELSE '' END AS canonical FROM q""")
def _(t):
    return forms(t).select("page_id", "url", u.canonical(F.col("url")).alias("canonical"))


@query("b2_scheme_prefix", U_CTE + " SELECT page_id, CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'http://' || trim(url) END AS url FROM u")
def _(t):
    return forms(t).select("page_id", u.with_scheme(F.col("url")).alias("url"))


@query("b3_effective_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '#f' WHEN page_id % 3 = 1 THEN upper(url) ELSE url END AS url FROM pages")
def _(t):
    rows = t("pages").selectExpr("page_id", "url", "CASE WHEN page_id % 3 = 0 THEN concat(url, '#f') WHEN page_id % 3 = 1 THEN '' END AS url_final", "CASE WHEN page_id % 3 = 1 THEN upper(url) END AS url_raw")
    return rows.select("page_id", u.first_filled(F.col("url_final"), F.col("url_raw"), F.col("url")).alias("url"))


@query("b4_dedup_keys", U_CTE + """ SELECT page_id, lower(trim(url)) AS raw, lower(trim(CASE WHEN page_id % 2 = 0 THEN url || '/F' ELSE url END)) AS final,
 sha1('{"page_id":' || page_id || ',"url":"' || url || '"}') AS sha_full FROM u""")
def _(t):
    url, final = F.col("url"), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/F")))
    return forms(t).select("page_id", u.dedup_key("raw", url, final).alias("raw"), u.dedup_key("final", url, final).alias("final"),
                           u.dedup_key("sha_full", url, final, F.struct("page_id", "url")).alias("sha_full"))


@query("b5_stable_id", U_CTE + " SELECT page_id, sha1(trim(url)) AS id FROM u")
def _(t):
    return forms(t).select("page_id", u.stable_id(F.lit(None).cast("string"), F.lit(""), F.col("url")).alias("id"))


@query("b6_label_coercion", """SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'click' THEN value > 50 WHEN 'view' THEN value > 30 WHEN 'signup' THEN true ELSE false END AS positive FROM events""")
def _(t):
    rows = t("events").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN ' Phishing ' END AS y", "CASE WHEN event_type = 'click' THEN CAST(value > 50 AS INT) END AS label",
        "CASE WHEN event_type = 'view' THEN value > 30 END AS is_phish", "CASE WHEN event_type = 'signup' THEN 'Phish-feed' ELSE 'other' END AS tag")
    return rows.select("event_id", u.is_positive([F.col("y"), F.col("label"), F.col("is_phish")], F.col("tag")).alias("positive"))


@query("b8_modality_presence", """SELECT d.doc_id, true AS has_url, l.doc_id IS NOT NULL AND toxic = 1 AS has_js, coalesce(quality, 0) = 1 AS has_dom, d.source <> 'src1' OR d.lang = 'en' AS has_text, d.lang <> 'fr' AS has_html, length(trim(d.text)) > 0 AND d.lang = 'de' AS has_script
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    from pagerisk.operators.html import modality_flags

    rows = t("documents").join(t("labels"), "doc_id", "left").selectExpr(
        "doc_id", "CASE WHEN lang = 'xx' THEN array(1) END AS url_charseq", "concat('http://h/', doc_id) AS url", "CASE WHEN toxic = 1 THEN array(5, 6) ELSE array() END AS js_charseq", "CAST(NULL AS STRING) AS js_raw",
        "CASE WHEN quality = 1 THEN array(1, 2) END AS dom_nodes", "CASE WHEN source <> 'src1' THEN text ELSE '' END AS text_visible", "CASE WHEN lang = 'en' THEN 'title' END AS text_title",
        "CASE WHEN lang <> 'fr' THEN text ELSE '' END AS html", "CASE WHEN lang = 'de' THEN array(trim(text)) ELSE array('') END AS script_texts")
    flags = modality_flags(F.col("url_charseq"), [F.col("url")], F.col("js_charseq"), [F.col("js_raw")], F.col("dom_nodes"), F.col("text_title"), F.col("text_visible"), F.col("html"), F.col("script_texts"), js_counts_scripts=False)
    return rows.select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query("b10_seed_filters", DOMAIN_CTE + """, n AS (SELECT page_id, url, CASE WHEN ip THEN host ELSE string_split(etld1, '.')[1] END AS name FROM d)
SELECT page_id, url FROM n WHERE NOT (ends_with(name, '-bank') OR ends_with(name, '-shop') OR (regexp_matches(name, '^[0-9]+$') AND length(name) >= 3))""")
def _(t):
    return forms(t, HOST_FORMS).filter(~u.skip_seed(F.col("url"), 3, (), ("-bank", "-shop")))


@query("b11_fill_only", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'computed' END AS prio, length(o_orderstatus) AS added FROM orders")
def _(t):
    rows = t("orders").selectExpr("o_orderkey", "o_orderstatus", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS prio")
    return fill_only(rows, {"prio": F.lit("computed"), "added": F.length("o_orderstatus")}).select("o_orderkey", "prio", F.col("added").cast("long"))


@query("c1_url_lexicals", DOMAIN_CTE + """ SELECT page_id, url, nullif(suffix, '') AS tld, regexp_matches(host, '[^\\x00-\\x7F]') AS is_idn, starts_with(host, 'xn--') OR contains(host, '.xn--') AS is_punycode, starts_with(host, 'xn--') OR contains(host, '.xn--') AS has_punycode,
 length(url) AS url_len, length(host) - length(replace(host, '.', '')) AS num_dots, length(url) - length(replace(url, '%', '')) AS num_pct, contains(url, '@') AS has_at, ip AS host_is_ip, length(host) - length(replace(host, '-', '')) AS host_hyphens FROM d""")
def _(t):
    return forms(t, HOST_FORMS).select("page_id", "url", *[(c.cast("long") if n.startswith(("url_len", "num_", "host_hy")) else c).alias(n) for n, c in u.lexicals(F.col("url")).items()])


@query("c2_url_shape", PARTS_CTE + """, s AS (SELECT page_id, url, host, trim(url) AS z FROM h), ch AS (SELECT page_id, url, unnest(string_split(z, '')) AS c FROM s), cn AS (SELECT page_id, url, c, count(*) AS n FROM ch WHERE c <> '' GROUP BY ALL),
e AS (SELECT page_id, url, -sum(n / tot * log2(n / tot)) AS ent FROM (SELECT *, sum(n) OVER (PARTITION BY page_id, url) AS tot FROM cn) GROUP BY page_id, url)
SELECT s.page_id, s.url, length(z) AS len, round(len(regexp_extract_all(z, '\\p{Nd}'))::DOUBLE / length(z), 6) AS digit_ratio, round((length(z) - len(regexp_extract_all(z, '\\p{Nd}')) - len(regexp_extract_all(z, '\\p{L}')))::DOUBLE / length(z), 6) AS symbol_ratio,
 round(ent, 6) AS entropy, greatest(0, length(host) - length(replace(host, '.', '')) - 1) AS sub_depth FROM s JOIN e ON s.page_id = e.page_id AND s.url = e.url""")
def _(t):
    f = u.shape(F.col("url"))
    return forms(t).select("page_id", "url", f["len"].cast("long").alias("len"), *[r6(f[c], c) for c in ("digit_ratio", "symbol_ratio", "entropy")], f["sub_depth"].cast("long").alias("sub_depth"))


@query("c2_url_ngram_shares", """WITH g AS (SELECT page_id, lower(url)[i:i+2] AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) - 1)) AS i FROM pages)), c AS (SELECT page_id, gram, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, gram) AS rn FROM c), f AS (SELECT * FROM k WHERE rn <= 20) SELECT page_id, gram, n, round(n / sum(n) OVER (PARTITION BY page_id), 6) AS share FROM f""")
def _(t):
    return tx.top_ngrams(t("pages"), "page_id", "url", 3, 20).withColumn("share", F.round("share", 6))


@query("c3_char_ngrams", "SELECT page_id, i - 1 AS pos, url[i:i+3] AS gram FROM (SELECT page_id, url, unnest(range(1, length(url) - 2)) AS i FROM pages)")
def _(t):
    return t("pages").select("page_id", F.posexplode(tx.ngrams(F.col("url"), 4)).alias("pos", "gram")).withColumn("pos", F.col("pos").cast("long"))


@query("c4_entropy", """WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM ch WHERE c <> '' GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n)
SELECT d.doc_id, round(coalesce(e, 0e0), 6) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, -sum(p * log2(p)) AS e FROM p GROUP BY doc_id) k ON d.doc_id = k.doc_id""")
def _(t):
    return t("documents").select("doc_id", r6(tx.entropy(F.col("text")), "entropy"))


@query("c5_sorted_features", "SELECT c_custkey, 'bal=' || CAST(c_acctbal > 0 AS VARCHAR) || ',nation=' || c_nationkey || ',seg=' || c_mktsegment AS pairs FROM customer")
def _(t):
    m = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("bal"), (F.col("c_acctbal") > 0).cast("string"))
    return t("customer").select("c_custkey", F.array_join(F.transform(tx.sorted_pairs(m), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("pairs"))


@query("c6_registered_domain", DOMAIN_CTE + " SELECT page_id, host, suffix, etld1 FROM d")
def _(t):
    host = u.host(F.col("url"))
    return forms(t, HOST_FORMS).select("page_id", host.alias("host"), sx.public_suffix(host).alias("suffix"), sx.registered_domain(host).alias("etld1"))


@query("c6_registered_domain_by_table", DOMAIN_CTE + " SELECT page_id, host, etld1 FROM d WHERE host <> ''")
def _(t):
    rows = forms(t, HOST_FORMS).select("page_id", u.host(F.col("url")).alias("host")).filter("host <> ''")
    return sx.with_registered_domain(rows, "host", sx.rules_table(t.spark)).select("page_id", "host", "etld1")


def sql_literal(s):
    """An SQL string for both engines' sake: control characters by chr()."""
    parts = []
    for ch in s:
        parts.append(f"chr({ord(ch)})" if ch in "\n\r\t'\\" else ch)
    out, run = [], ""
    for p in parts:
        if len(p) > 1:
            out += ([f"'{run}'"] if run else []) + [p]
            run = ""
        else:
            run += p
    return " || ".join(out + ([f"'{run}'"] if run else []))


@query("c26_char_sequences", f"""WITH a AS (SELECT {sql_literal(tx.URL_ALPHABET)} AS ua, {sql_literal(tx.JS_ALPHABET)} AS ja), u AS (SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN strpos(ua, c) > 0 THEN strpos(ua, c) + 1 ELSE 1 END), ',') AS url_seq FROM pages, a),
d AS (SELECT page_id, array_to_string(list_transform(string_split(html, ''), lambda c: CASE WHEN strpos(ja, c) > 0 THEN strpos(ja, c) + 1 ELSE 1 END), ',') AS s, array_to_string(list_transform(string_split(html[:2048], ''), lambda c: CASE WHEN strpos(ja, c) > 0 THEN strpos(ja, c) + 1 ELSE 1 END), ',') AS w FROM pages, a)
SELECT u.page_id, url_seq, md5(s) AS whole_md5, md5(w) AS width_md5 FROM u JOIN d ON u.page_id = d.page_id""")
def _(t):
    joined = lambda seq: F.array_join(F.transform(seq, lambda i: i.cast("string")), ",")
    return t("pages").select("page_id", joined(tx.encode(F.col("url"), tx.URL_ALPHABET)).alias("url_seq"),
                             F.md5(joined(tx.encode(F.col("html"), tx.JS_ALPHABET))).alias("whole_md5"),
                             F.md5(joined(tx.encode(F.col("html"), tx.JS_ALPHABET, tx.JS_SEQ_CHARS))).alias("width_md5"))


@query("c27_decode_sequence", f"WITH a AS (SELECT {sql_literal(tx.JS_ALPHABET)} AS ja) SELECT page_id, md5(array_to_string(list_filter(string_split(html, ''), lambda c: strpos(ja, c) > 0), '')) AS decoded_md5 FROM pages, a")
def _(t):
    return t("pages").select("page_id", F.md5(tx.decode(tx.encode(F.col("html"), tx.JS_ALPHABET), tx.JS_ALPHABET)).alias("decoded_md5"))


@query("c28_text_encoders", f"""WITH a AS (SELECT {sql_literal(tx.TEXT_ALPHABET)} AS ta), d AS (SELECT doc_id, lang || chr(10) || text AS s, lang || '[SEP]' || text AS z FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN strpos(ta, c) > 0 THEN strpos(ta, c) + 1 ELSE 1 END), ',')) AS alphabet_md5, md5(array_to_string(list_transform(string_split(z, ''), lambda c: ord(c) % 256), ',')) AS ord_md5 FROM d, a""")
def _(t):
    joined = lambda seq: F.array_join(F.transform(seq, lambda i: i.cast("string")), ",")
    return t("documents").select("doc_id", F.md5(joined(tx.encode(F.concat_ws("\n", "lang", "text"), tx.TEXT_ALPHABET))).alias("alphabet_md5"),
                                 F.md5(joined(tx.code_points(F.concat_ws("[SEP]", "lang", "text")))).alias("ord_md5"))


@query("c32_stable_hash", "SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS hash64 FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.hash60(F.col("text")).alias("hash64"))


TOKENS_CTE = U_CTE + """, r AS (SELECT page_id, url, regexp_replace(lower(url), '^[^/]*://', '') AS rest FROM u), s AS (SELECT *, regexp_extract(rest, '^([^/]*)', 1) AS dom, regexp_replace(rest, '^[^/]*/?', '') AS pth FROM r),
b AS (SELECT *, regexp_replace(dom, '[^a-z0-9]', '', 'g') AS bare FROM s), tok AS (
 SELECT page_id, url, unnest(regexp_split_to_array(dom, '[.\\-]')) AS tok FROM b UNION SELECT page_id, url, unnest(regexp_split_to_array(pth, '[/?&=_.\\-]')) FROM b UNION SELECT page_id, url, unnest(regexp_extract_all(lower(url), '[a-z0-9]{3,}')) FROM b
 UNION SELECT page_id, url, bare[i:i+2] FROM (SELECT *, unnest(range(1, length(bare) - 1)) AS i FROM b) UNION SELECT page_id, url, bare[i:i+3] FROM (SELECT *, unnest(range(1, length(bare) - 2)) AS i FROM b) UNION SELECT page_id, url, bare[i:i+4] FROM (SELECT *, unnest(range(1, length(bare) - 3)) AS i FROM b)),
kept AS (SELECT * FROM tok WHERE tok <> '')"""


@query("c37_url_tokens", TOKENS_CTE + " SELECT page_id, url, string_agg(tok, ' ' ORDER BY tok) AS tokens FROM kept GROUP BY page_id, url")
def _(t):
    return forms(t).select("page_id", "url", F.array_join(F.array_sort(u.all_tokens(F.col("url"))), " ").alias("tokens"))


@query("c38_suspicious_purity", TOKENS_CTE + " SELECT page_id, url, round(avg(CASE WHEN regexp_matches(tok, 'login|verify|secure|bank|update|payment|account|wallet') THEN 1e0 ELSE 0e0 END), 6) AS purity FROM kept GROUP BY page_id, url")
def _(t):
    return forms(t).select("page_id", "url", r6(u.purity(u.all_tokens(F.col("url"))), "purity"))
