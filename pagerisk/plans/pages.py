"""Page-table queries (B7, B11, D16 and the steps they join): every page enriched from its markup and five lookups.

Registration facts are looked up by registered domain, of which the given pages
have three, so each owns a third of all rows; certificates by host, only for
https; requests, redirects and visual facts by page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.functions import urls as u
from pagerisk.functions.features import CHEAP_FEATURES
from pagerisk.functions.text import hash60
from pagerisk.operators import logs as lg
from pagerisk.operators import pages as pg
from pagerisk.operators.running import time_bucket
from pagerisk.plans.html import BLOCKS
from pagerisk.plans.logs import LAG, req
from pagerisk.plans.registry import query
from pagerisk.plans.scripts import ATOB, EVAL, FCC, NEWF, TITLE_CTE, n

# Scripts behind the block of each page: calls, then fingerprinting and a long encoded text.
CODE = (
    "", "<script>eval (a); new Function(b); atob(c); String.fromCharCode(1); el.addEventListener(&#39;keydown&#39;, f); location.replace(u)</script>".replace("&#39;", '"'),
    "<script>location . assign(q); /* fromcharcode */</script>",
    "<script>canvas.toDataURL(); new OfflineAudioContext(); RTCPeerConnection; fonts.enumerate(); WebGLRenderingContext; " + "QUJD" * 25 + "</script>",
)
KINDS = {"req_counts_script": ("click",), "req_counts_css": ("view",), "req_counts_xhr": ("error",), "req_counts_img": ("purchase", "signup")}


def own_pages(t):
    """Pages with some facts of their own: a registrar in every fourth row, headers by row."""
    by = lambda texts: F.get(F.array(*[F.lit(x) for x in texts]), (F.col("page_id") % 4).cast("int"))
    return t("pages").select(
        "page_id", "url", F.concat("html", by(BLOCKS), by(CODE)).alias("html"),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Own Registrar "), F.col("page_id").cast("string"))).alias("registrar"),
        F.create_map(F.when(F.col("page_id") % 2 == 0, F.lit("X-Frame-Options")).otherwise(F.lit("x-other")), F.lit("DENY")).alias("headers"),
    )


def dimensions(t):
    host, final = u.host(F.col("url_final")), F.col("url_final")
    names = F.get(F.array(*[F.lit(f"example.{x}") for x in ("com", "net", "org", "edu", "info")]), F.col("r_regionkey").cast("int"))
    k = (F.col("r_regionkey") + 1).cast("int")
    registration = t("region").select(
        names.alias("etld1"), F.concat("r_name", F.when(k % 2 == 1, F.lit(" Privacy Service")).otherwise(F.lit(""))).alias("registrar"),
        (k * 100).alias("dns_created_days_ago"), (k * 10).alias("dns_updated_days_ago"), k.alias("ns_count"), (k == 2).alias("mx_present"), (k * 60).alias("ttl_min"), (k * 75.5).alias("ttl_mean"))
    hosts = t("pages").select(u.host(F.col("url")).alias("host")).distinct()
    certificates = hosts.select("host", (F.length("host") * 10).alias("cert_age_days"), F.length("host").alias("san_count"), hash60(F.concat(F.lit("spki|"), "host")).alias("tls_issuer_spki_hash64"))
    requests = lg.request_graph(req(t), "page_id", "kind", "host", "own", KINDS)
    redirects = lg.redirect_sketch(req(t), "page_id", "ts", "host", time_bucket("ts"), ["ts", "event_id"]).withColumnRenamed("redir_hops", "redirect_hops")
    shown = t("pages").select("page_id", (F.col("page_id") % 3).cast("int").alias("iframe_form_count"), *[
        F.when(F.col("page_id") % 4 == 3, v).alias(c) for c, v in (
            ("favicon_dhash", hash60(F.concat(F.lit("fav|"), "url"))), ("logo_phash64", hash60(F.concat(F.lit("logo|"), "url"))), ("logo_from_alt_or_name", F.lit(True)))])
    page = F.col("page_id")
    return [
        pg.Dimension(registration, "etld1", F.col("etld1"), ("etld1",)),
        pg.Dimension(certificates, "host", host, ("url_final",), u.scheme(final) == "https"),
        pg.Dimension(requests, "page_id", page, ("page_id",)),
        pg.Dimension(redirects, "page_id", page, ("page_id",)),
        pg.Dimension(shown, "page_id", page, ("page_id",)),
    ]


_lists = lambda texts: ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
_hash = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
_kinds = ", ".join(f"count(*) FILTER (WHERE kind IN ({_lists(k)})) AS {c}" for c, k in KINDS.items())
FULL_CTE = f"""{LAG}, p AS (SELECT page_id, url, page_id % 4 AS v, html || ([{_lists(BLOCKS)}])[page_id % 4 + 1] || ([{_lists(CODE)}])[page_id % 4 + 1] AS html,
  lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, starts_with(url, 'https:') AS tls, CASE WHEN page_id % 4 = 0 THEN 'Own Registrar ' || page_id END AS own_registrar FROM pages),
d AS (SELECT *, page_id AS doc_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS js FROM p),
ch AS (SELECT page_id, unnest(string_split(js, '')) AS c FROM d), cn AS (SELECT page_id, c, count(*) AS k FROM ch WHERE c <> '' GROUP BY ALL),
en AS (SELECT page_id, -sum(k / tot * log2(k / tot)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY page_id) AS tot FROM cn) GROUP BY page_id),
rg AS (SELECT r_regionkey + 1 AS k, r_name || CASE WHEN r_regionkey % 2 = 0 THEN ' Privacy Service' ELSE '' END AS registrar, ['example.com', 'example.net', 'example.org', 'example.edu', 'example.info'][r_regionkey + 1] AS etld1 FROM region),
rq AS (SELECT page_id, {_kinds}, count(DISTINCT host) AS req_unique_etld1, round(count(*) FILTER (WHERE host <> own)::DOUBLE / count(*), 4) AS req_thirdparty_ratio FROM r GROUP BY page_id),
rd AS (SELECT page_id, count(*) - 1 AS redirect_hops, max(datediff('microsecond', pt, ts) // 1000) AS redirect_max_ms, count(*) FILTER (WHERE ph <> host) AS redir_cross_host FROM l GROUP BY page_id),
{TITLE_CTE}, tok AS (SELECT tt.page_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(host, '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM tt JOIN p USING (page_id)),
f AS (SELECT d.*, e, k, coalesce(own_registrar, rg.registrar) AS registrar, rg.etld1, rq.* EXCLUDE (page_id), rd.* EXCLUDE (page_id), lower(html || chr(10) || js) AS low,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round_even(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * 255e0, 0) END AS jac
  FROM d LEFT JOIN en USING (page_id) LEFT JOIN rg ON rg.etld1 = regexp_extract(host, '([^.]+\\.[^.]+)$', 1) LEFT JOIN rq USING (page_id) LEFT JOIN rd USING (page_id) LEFT JOIN tok USING (page_id))"""
_has = lambda w: f"contains(low, '{w}')"
_v = lambda v, a, b="0": f"CASE WHEN v = {v} THEN {a} ELSE {b} END"
_dots = lambda c, s: f"length({s}) - length(replace({s}, '{c}', ''))"
KEYS_SQL = "len(regexp_extract_all(js, 'addEventListener\\s*\\(\\s*[''\"](?:key(?:down|up)|paste)[''\"]'))"
EVALS, ATOBS = f"{n(EVAL)} + {n(NEWF)}", f"{n(ATOB)} + {n(FCC)}"
FORM_FP = "CASE v WHEN 1 THEN '1,1,0,1,1,' || CASE WHEN tls THEN '0' ELSE '1' END || ',1,1,1' WHEN 2 THEN '0,0,2,0,0,0,0,0,1' ELSE '0,0,0,0,0,0,0,0,0' END"
# One expression per feature; NULL counts as 0.
VECTOR_SQL = {
    "redirect_hops": "redirect_hops", "redirect_max_ms": "redirect_max_ms", "url_len": "length(url)", "num_dots": _dots(".", "host"), "num_pct": _dots("%", "url"),
    "has_at": "contains(url, '@')", "host_is_ip": "false", "host_hyphens": _dots("-", "host"), "has_punycode": "contains(host, 'xn--')",
    "redir_hops": "redirect_hops", "redir_cross_host": "redir_cross_host", "has_meta_refresh": "v = 3", "has_js_loc_replace": r"regexp_matches(js, '(?i)location\s*\.(replace|assign)\s*\(')",
    "dns_created_days_ago": "k * 100", "dns_updated_days_ago": "k * 10", "ns_count": "k", "mx_present": "k = 2", "ttl_min": "k * 60", "ttl_mean": "k * 755e-1",
    "rdap_age_days": "k * 100", "rdap_registrar_hash64": _hash("registrar"), "rdap_ns_count": "k", "rdap_has_privacy": "contains(lower(registrar), 'privacy')",
    "cert_age_days": "CASE WHEN tls THEN length(host) * 10 END", "san_count": "CASE WHEN tls THEN length(host) END",
    "tls_not_before_days": "CASE WHEN tls THEN length(host) * 10 END", "tls_san_count": "CASE WHEN tls THEN length(host) END", "tls_issuer_spki_hash64": f"CASE WHEN tls THEN {_hash(chr(39) + 'spki|' + chr(39) + ' || host')} END",
    **{c: c for c in ("req_unique_etld1", "req_thirdparty_ratio", *KINDS)},
    "form_pw_count": _v(1, 1), "form_cross_site": "v = 1", "form_login_tokens": "(v IN (1, 2))", "form_hidden_count": _v(2, 2), "form_autocomplete_off": "v = 1", "onsubmit_handlers": _v(1, 1),
    "form_fp_hash64": _hash(FORM_FP), "num_pw": _v(1, 1), "num_email": _v(1, 1), "num_hidden": _v(2, 2), "form_method_get": "v = 1", "action_cross_origin": "v = 1", "action_proto_mismatch": "v = 1 AND NOT tls",
    "iframe_login": "v = 1 AND page_id % 3 > 0", "top_form_count": "CASE v WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END", "iframe_form_count": "page_id % 3", "form_css_sig_hash64": _v(1, _hash("'a|b|c'"), "NULL"),
    "js_entropy": "round(e, 4)", "js_eval_ct": EVALS, "js_atob_ct": ATOBS, "js_b64_blob_ct": n("[A-Za-z0-9+/]{80,}={0,2}"), "js_keylog_listeners": KEYS_SQL,
    "js_eval_like": f"least(255, {n(EVAL + '|' + NEWF)})", "js_hex_ratio": f"least(255, floor({n('[0-9a-fA-F]')}::DOUBLE / length(js) * 255e0))", "js_fromcharcode": f"least(255, {n('(?i)fromCharCode')})",
    "js_hi_entropy_ratio": "least(255, floor(e / 8e0 * 255e0))", "js_atob": f"least(255, {n(ATOB)})", "key_listener_pw": f"v = 1 AND {KEYS_SQL} > 0", "key_listeners_total": KEYS_SQL,
    "fp_canvas": f"{_has('getcontext(' + chr(39) * 2 + '2d' + chr(39) * 2)} OR {_has('canvas.todataurl')} OR {_has('measuretext')}", "fp_webgl": _has("webglrenderingcontext"), "fp_audio": _has("audiocontext"),
    "fp_font_enum": f"{_has('measuretext')} OR ({_has('font')} AND {_has('enumerat')})", "fp_webrtc": f"{_has('rtcpeerconnection')} OR {_has('getusermedia')} OR {_has('enumeratedevices')}",
    "favicon_dhash64": _v(3, _hash("'fav|' || url"), "NULL"), "fav_rel_count": _v(3, 2, "1"), "fav_cross_origin": "v = 3", "logo_phash64": _v(3, _hash("'logo|' || url"), "NULL"), "logo_from_alt_or_name": "v = 3",
    "title_host_jaccard_q8": "jac",
}
assert tuple(VECTOR_SQL) == CHEAP_FEATURES


@query("b7_cheap_feature_vector", FULL_CTE + " SELECT page_id, " + ", ".join(f"coalesce(({x})::DOUBLE, 0e0) AS {c}" for c, x in VECTOR_SQL.items()) + " FROM f")
def _(t):
    vector, absent = pg.feature_vector(own_pages(t), dimensions(t), keys=("page_id",), row_key="page_id")
    if absent:
        raise ValueError(f"no source for {absent}")
    return vector


@query("b11_page_enrichment", FULL_CTE + f""" SELECT page_id, url AS url_final, coalesce(etld1, regexp_extract(host, '([^.]+\\.[^.]+)$', 1)) AS etld1, registrar, CASE WHEN page_id % 2 = 0 THEN 'DENY' END AS hdr_xfo,
 k::INTEGER AS rdap_ns_count, (CASE WHEN tls THEN length(host) END)::INTEGER AS tls_san_count, ({VECTOR_SQL['num_pw']})::INTEGER AS num_pw, ({EVALS})::INTEGER AS js_eval_ct, redirect_hops::INTEGER AS redir_hops, ttl_mean FROM (SELECT *, k * 755e-1 AS ttl_mean FROM f)""")
def _(t):
    wanted = ["url_final", "etld1", "registrar", "hdr_xfo", "rdap_ns_count", "tls_san_count", "num_pw", "js_eval_ct", "redir_hops", "ttl_mean"]
    full, _absent = pg.enrich(own_pages(t), dimensions(t), wanted, row_key="page_id")
    return full.select("page_id", *wanted)
