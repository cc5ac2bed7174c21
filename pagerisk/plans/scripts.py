"""Script-text and header queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.functions import mathx
from pagerisk.functions import scripts as sc
from pagerisk.functions import urls as u
from pagerisk.plans.inputs import WIDE_CTE, r6
from pagerisk.plans.registry import query

# Script text out of every document: its prose plus calls that depend on language and source.
JS = """concat('/* block', chr(10), ' */ var s = "', source, 'v"; // tail', chr(10), CASE lang WHEN 'en' THEN 'eval (x); new  Function(y); atob(z); setTimeout("f()", 1);'
 WHEN 'fr' THEN 'String.fromCharCode(1); FROMCHARCODE; window.location.replace(q); location . assign(1)' WHEN 'de' THEN 'document.addEventListener( ''keydown'', k); addEventListener("paste", p); ctx.getContext(''2d''); x.getUserMedia(); font; enumerateFonts'
 ELSE 'QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODkrLw1234567890abcdef== AudioContext RTCPeerConnection' END, '   ', text)"""
D_CTE = f"WITH d AS (SELECT doc_id, lang, source, {JS} AS js FROM documents)"


def docs(t):
    return t("documents").selectExpr("doc_id", "lang", "source", f"{JS.replace('chr(10)', 'char(10)')} AS js".replace("''keydown''", "\\'keydown\\'").replace("''2d''", "\\'2d\\'"))


def n(p):
    return f"len(regexp_extract_all(js, '{p}'))"


EVAL, NEWF, ATOB, FCC = r"\beval\s*\(", r"new\s+Function\s*\(", r"\batob\s*\(", r"\bfromCharCode\b"
ENTROPY = """ch AS (SELECT doc_id, unnest(string_split(js, '')) AS c FROM d), cn AS (SELECT doc_id, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL),
en AS (SELECT doc_id, -sum(k / tot * log2(k / tot)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS tot FROM cn) GROUP BY doc_id)"""


@query("c7_security_headers", """SELECT c_custkey, c_mktsegment AS hdr_csp, NULL::VARCHAR AS hdr_hsts, c_name AS hdr_xfo, NULL::VARCHAR AS hdr_refpol, NULL::VARCHAR AS hdr_permspol, CASE WHEN c_acctbal > 0 THEN 'nosniff' END AS hdr_xcto FROM customer""")
def _(t):
    rows = t("customer").selectExpr("c_custkey", """map_from_arrays(array(CASE WHEN c_nationkey > 12 THEN 'Content-Security-Policy' ELSE 'CONTENT-security-policy' END, 'X-Frame-Options', 'x-frame-options', CASE WHEN c_acctbal > 0 THEN 'X-Content-Type-Options' ELSE 'X-Other' END),
        array(c_mktsegment, c_name, 'later', 'nosniff')) AS headers""")
    return rows.select("c_custkey", *[c.alias(k) for k, c in sc.security_headers(F.col("headers")).items()])


@query("c10_js_heuristics", D_CTE + ", " + ENTROPY + f""" SELECT d.doc_id, round(e, 4) AS js_entropy, {n(EVAL)} + {n(NEWF)} AS js_eval_ct, {n(ATOB)} + {n(FCC)} AS js_atob_ct, {n('[A-Za-z0-9+/]{80,}={0,2}')} AS js_b64_blob_ct,
 len(regexp_extract_all(js, 'addEventListener\\s*\\(\\s*[''"](?:key(?:down|up)|paste)[''"]')) AS js_keylog_listeners FROM d JOIN en ON d.doc_id = en.doc_id""")
def _(t):
    return docs(t).select("doc_id", *[(c if k == "js_entropy" else c.cast("long")).alias(k) for k, c in sc.heuristics(F.col("js")).items()])


@query("c11_literal_entropy", r"""WITH d AS (SELECT doc_id, '"' || source || 'v"' AS q FROM documents), ch AS (SELECT doc_id, unnest(string_split(q[2:-2], '')) AS c FROM d), cn AS (SELECT doc_id, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL)
SELECT doc_id, round(-sum(k / tot * log2(k / tot)), 4) AS literal_entropy FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS tot FROM cn) GROUP BY doc_id""")
def _(t):
    rows = t("documents").selectExpr("doc_id", """concat('var a = "', source, 'v"; let n = ', n_chars, ';') AS js""")
    return rows.select("doc_id", sc.literal_entropy(F.col("js")).alias("literal_entropy"))


@query("c12_js_micro_counters", D_CTE + ", " + ENTROPY + f""" SELECT d.doc_id, least(255, {n(EVAL + '|' + NEWF)}) AS js_eval_like, least(255, {n('(?i)fromCharCode')}) AS js_fromcharcode, least(255, {n(ATOB)}) AS js_atob,
 least(255, floor({n('[0-9a-fA-F]')}::DOUBLE / length(js) * 255e0))::BIGINT AS js_hex_ratio, least(255, floor(e / 8e0 * 255e0))::BIGINT AS js_hi_entropy_ratio FROM d JOIN en ON d.doc_id = en.doc_id""")
def _(t):
    return docs(t).select("doc_id", *[c.cast("long").alias(k) for k, c in sc.micro_counters(F.col("js")).items()])


@query("c13_windowed_counters", D_CTE + f""", w AS (SELECT doc_id, i, js[i:i+1023] AS s FROM (SELECT doc_id, js, unnest(range(1, length(js) + 1, 512)) AS i FROM d)), ch AS (SELECT doc_id, i, unnest(string_split(s, '')) AS c FROM w), cn AS (SELECT doc_id, i, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL),
en AS (SELECT doc_id, i, -sum(k / tot * log2(k / tot)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id, i) AS tot FROM cn) GROUP BY doc_id, i), h AS (SELECT doc_id, count(*) FILTER (WHERE e > 43e-1)::DOUBLE / count(*) AS hot FROM en GROUP BY doc_id)
SELECT d.doc_id, least(255, {n(r'\b(?:eval|Function)\b\s*\(')} + len(regexp_extract_all(js, 'setTimeout\\s*\\(\\s*[''"]'))) AS js_eval_like, least(255, {n(r'String\.fromCharCode')}) AS js_fromcharcode, least(255, {n(r'\batob\b')}) AS js_atob,
 least(255, floor({n(r'\\x[0-9A-Fa-f]{2}')}::DOUBLE / length(js) * 255e0))::BIGINT AS js_hex_ratio, least(255, floor(hot * 255e0))::BIGINT AS js_hi_entropy_ratio FROM d JOIN h ON d.doc_id = h.doc_id""")
def _(t):
    return docs(t).select("doc_id", *[c.cast("long").alias(k) for k, c in sc.windowed_counters(F.col("js"), high=4.3).items()])


@query("f10_string_windows", D_CTE + " SELECT doc_id, i // 512 AS pos, md5(js[i:i+1023]) AS window_md5 FROM (SELECT doc_id, js, unnest(range(1, length(js) + 1, 512)) AS i FROM d)")
def _(t):
    return docs(t).select("doc_id", F.posexplode(sc.windows(F.col("js"))).alias("pos", "w")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("w").alias("window_md5"))


@query("c14_fingerprint_flags", D_CTE + """, k AS (SELECT doc_id, lower(source || chr(10) || js) AS s FROM d) SELECT doc_id, contains(s, 'getcontext(''2d''') OR contains(s, 'canvas.todataurl') OR contains(s, 'measuretext') AS fp_canvas, contains(s, 'webglrenderingcontext') OR contains(s, 'getcontext(''webgl''') AS fp_webgl,
 contains(s, 'audiocontext') AS fp_audio, contains(s, 'measuretext') OR (contains(s, 'font') AND contains(s, 'enumerat')) AS fp_font_enum, contains(s, 'rtcpeerconnection') OR contains(s, 'getusermedia') OR contains(s, 'enumeratedevices') AS fp_webrtc FROM k""")
def _(t):
    return docs(t).select("doc_id", *[c.alias(k) for k, c in sc.fingerprint_flags(F.col("source"), F.col("js")).items()])


TITLE_CTE = """t AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS raw FROM pages),
tt AS (SELECT page_id, url, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS title FROM t)"""


@query("c15_title_host_jaccard", "WITH " + TITLE_CTE + """, k AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(regexp_extract(url, '://([^/:]*)', 1)) || '.the.of.and.le', '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM tt)
SELECT page_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round_even(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * 255e0, 0) END::BIGINT AS jaccard_q8 FROM k""")
def _(t):
    host = F.concat(u.host(F.col("url")), F.lit(".the.of.and.le"))
    return t("pages").select("page_id", sc.jaccard_q8(sc.title(F.col("html")), host).cast("long").alias("jaccard_q8"))


@query("c18_location_flag", D_CTE + r" SELECT doc_id, regexp_matches(js, '(?i)location\s*\.(replace|assign)\s*\(') AS any_call, regexp_matches(js, 'location\s*\.replace\s*\(') AS replace_only FROM d")
def _(t):
    return docs(t).select("doc_id", sc.location_flag(F.col("js")).alias("any_call"), sc.location_flag(F.col("js"), True).alias("replace_only"))


@query("c19_key_listener_rollup", """SELECT l.doc_id, CASE WHEN lang = 'de' THEN 2 ELSE 0 END AS key_listeners_total, lang = 'de' AND toxic = 1 AS key_listener_pw FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def _(t):
    rows = docs(t).join(t("labels"), "doc_id")
    return rows.select("doc_id", *[c.alias(k) for k, c in sc.key_listener_rollup(sc.heuristics(F.col("js"))["js_keylog_listeners"], F.col("toxic")).items()])


@query("c20_title", "WITH " + TITLE_CTE + " SELECT page_id, title, title[:256] AS capped FROM tt")
def _(t):
    return t("pages").select("page_id", sc.title(F.col("html")).alias("title"), sc.title(F.col("html"), 256).alias("capped"))


PARTS_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("c29_joined_scripts", f"""WITH k AS (SELECT doc_id, array_to_string({PARTS_SQL}[:10], chr(10) || chr(10) || '<sep>' || chr(10) || chr(10)) AS j, array_to_string({PARTS_SQL}, chr(10) || chr(10) || '<sep>' || chr(10) || chr(10)) AS whole FROM documents) SELECT doc_id, md5(whole) AS whole_md5, md5(j[:4000]) AS width_md5 FROM k""")
def _(t):
    lines = F.split("text", "\n")
    return t("documents").select("doc_id", F.md5(sc.joined_scripts(lines)).alias("whole_md5"), F.md5(sc.joined_scripts(lines, 10, 4000)).alias("width_md5"))


@query("c29_budgeted_scripts", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT * FROM p WHERE s <> ''),
r AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f), k AS (SELECT doc_id, md5(string_agg(s[:(8192 - used)], chr(10) ORDER BY i)) AS m FROM r WHERE used < 8192 GROUP BY doc_id)
SELECT d.doc_id, coalesce(m, md5('')) AS budget_md5 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""")
def _(t):
    return t("documents").select("doc_id", F.md5(sc.budgeted_scripts(F.split("text", "\n"), 8192)).alias("budget_md5"))


@query("c30_minify", D_CTE + r" SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(js, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '\s+', ' ', 'g'))) AS minified_md5 FROM d")
def _(t):
    return docs(t).select("doc_id", F.md5(sc.minify(F.col("js"))).alias("minified_md5"))


@query("c31_hex_escape", D_CTE + """, r AS (SELECT doc_id, js, ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT % 1000003 AS h FROM d), c AS (SELECT doc_id, h, unnest(string_split(js, '')) AS c, unnest(range(0, length(js))) AS i FROM r),
x AS (SELECT *, (((h + i * 7919) % 1000003) * ((h + i * 7919) % 1000003) % 1000003 * 48271 + i) % 1000003 AS draw FROM c)
SELECT doc_id, md5(string_agg(CASE WHEN draw < 50000 AND regexp_matches(c, '^[\\p{L}\\p{N}]$') THEN '\\x' || lpad(lower(to_hex(ord(c) % 256)), 2, '0') ELSE c END, '' ORDER BY i)) AS escaped_md5 FROM x GROUP BY doc_id""")
def _(t):
    return docs(t).select("doc_id", F.md5(sc.hex_escape(F.col("js"), F.col("doc_id"))).alias("escaped_md5"))


# The pattern as an SQL string.
LITERAL_SQL = sc.LITERAL.replace("'", "''")


@query("c31_split_literals", D_CTE + f""", k AS (SELECT doc_id, string_split_regex(js, '{LITERAL_SQL}') AS gaps, regexp_extract_all(js, '{LITERAL_SQL}') AS lits FROM d),
e AS (SELECT doc_id, unnest(gaps) AS gap, unnest(range(0, len(gaps))) AS i, unnest(list_concat(lits, [''])) AS lit FROM k),
x AS (SELECT *, length(lit) - 2 AS n, ('0x' || substr(md5('42|' || doc_id || '|' || i), 1, 15))::BIGINT AS draw FROM e), c AS (SELECT *, (draw // 1000003) % greatest(n - 1, 1) + 1 AS cut FROM x)
SELECT doc_id, md5(string_agg(gap || CASE WHEN n < 4 OR draw % 1000003 >= 500001 THEN lit ELSE lit[:cut + 1] || lit[1] || '+' || lit[1] || lit[cut + 2:] END, '' ORDER BY i)) AS split_md5 FROM c GROUP BY doc_id""")
def _(t):
    return docs(t).select("doc_id", F.md5(sc.split_literals(F.col("js"), F.col("doc_id"), 0.5, 42)).alias("split_md5"))


@query("c33_compact_registration", """SELECT s_suppkey, floor(s_acctbal)::BIGINT AS tls_not_before_days, s_nationkey::BIGINT AS tls_san_count, s_suppkey * 10 AS rdap_age_days, (s_nationkey + 1)::BIGINT AS rdap_ns_count,
 ('0x' || substr(md5(s_name || CASE WHEN s_nationkey < 8 THEN ' WhoisGuard' ELSE ' Inc' END), 1, 15))::BIGINT AS rdap_registrar_hash64, s_nationkey < 8 AS rdap_has_privacy FROM supplier""")
def _(t):
    rows = t("supplier").selectExpr("s_suppkey", "concat(s_name, CASE WHEN s_nationkey < 8 THEN ' WhoisGuard' ELSE ' Inc' END) AS registrar", "s_suppkey * 10 AS created", "s_nationkey + 1 AS ns", "floor(s_acctbal) AS cert", "s_nationkey AS sans")
    cols = sc.compact_registration(*[F.col(c) for c in ("registrar", "created", "ns", "cert", "sans")])
    return rows.select("s_suppkey", *[(c if k.endswith("privacy") else c.cast("long")).alias(k) for k, c in cols.items()])


@query("c39_days_ago", "SELECT o_orderkey, datediff('microsecond', o_orderdate, TIMESTAMP '2024-06-01 12:00:00') // 86400000000 AS days FROM orders")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t("orders").select("o_orderkey", sc.days_ago(iso, F.lit("2024-06-01 12:00:00").cast("timestamp")).cast("long").alias("days"))


@query("c35_temperature_apply", "WITH " + WIDE_CTE + """, k AS (SELECT id, greatest(1e-12, least(1e0 - 1e-12, url)) AS p FROM wide) SELECT id, round(ln(p / (1e0 - p)), 6) AS logit, round(1e0 / (1e0 + exp(-ln(p / (1e0 - p)) / 25e-1)), 6) AS tempered FROM k""")
def _(t):
    return t.wide().select("id", r6(mathx.logit(F.col("url")), "logit"), r6(mathx.temper(F.col("url"), 2.5), "tempered"))


@query("c41_two_class_softmax", """SELECT l_orderkey, l_linenumber, round(greatest(1e-6, least(1e0 - 1e-6, 1e0 / (1e0 + exp(l_quantity / 1e1 - l_discount * 1e2)))), 6) AS p FROM lineitem""")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(mathx.softmax_positive(F.col("l_quantity") / 10.0, F.col("l_discount") * 100.0), "p"))


@query("c40_field_extraction", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::DOUBLE AS absent FROM events""")
def _(t):
    obj = F.from_json("props", "MAP<STRING, STRING>")
    return t("events").select("event_id", obj["k"].try_cast("double").alias("k"), obj["nope"].try_cast("double").alias("absent"))
