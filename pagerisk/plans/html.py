"""Page-markup queries.

The given pages hold no forms, icons or hidden nodes, so a block chosen by the
page id is appended to every page; the SQL twins know by construction what each
block must yield.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagerisk.functions import scripts as sc
from pagerisk.operators import html as hm
from pagerisk.functions import urls as u
from pagerisk.functions.suffixes import registered_domain
from pagerisk.plans.registry import query

BLOCKS = (
    "",
    """<form id=a action="https://evil.phish.net/login" method="GET" autocomplete="off" onsubmit="go()"><input type="password" name="pw" class="b a"><input type=email name=Mail><button class="c">Sign in</button></form>""",
    """<form action="/local" method=post><input type=hidden name=h1><input type=HIDDEN name=h2>Your Account</form><form><input type=text name=q></form><script src="https://cdn.site.org/a.js" async></script>""",
    """<div class="Modal big" style="position:fixed;top:0">close <iframe src=x></iframe></div><img alt="Company LOGO" src="/l.png" width=20 height=10><img alt=x src="brand.png" width=100 height=100><link rel="shortcut icon" href="https://cdn.site.com/f.ico"><link rel=icon href="/f2.ico"><meta http-equiv="Refresh" content="5"><p hidden>secret text</p><p style="display:none">gone</p> scan the QR now""",
)
_ARR = ", ".join("'" + b + "'" for b in BLOCKS)
H_CTE = f"WITH h AS (SELECT page_id, url, page_id % 4 AS v, html || ([{_ARR}])[page_id % 4 + 1] AS html FROM pages)"


def pages(t):
    blocks = F.array(*[F.lit(b) for b in BLOCKS])
    return t("pages").select("page_id", "url", F.concat("html", F.get(blocks, (F.col("page_id") % 4).cast("int"))).alias("html"))


def ctx(url="url"):
    return registered_domain(u.host(F.col(url))), u.scheme(F.col(url))


@query("c8_form_semantics", """SELECT page_id, CASE v WHEN 1 THEN 1 ELSE 0 END AS num_pw, CASE v WHEN 1 THEN 1 ELSE 0 END AS num_email, CASE v WHEN 2 THEN 2 ELSE 0 END AS num_hidden, CASE WHEN v IN (1, 2) THEN 1 ELSE 0 END AS form_login_tokens, v = 1 AS form_autocomplete_off, CASE v WHEN 1 THEN 1 ELSE 0 END AS onsubmit_handlers,
 v = 1 AS form_method_get, v = 1 AS form_cross_site, v = 1 AND starts_with(url, 'http:') AS action_proto_mismatch, CASE v WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS top_form_count,
 ('0x' || substr(md5(CASE v WHEN 1 THEN '1,1,0,1,1,' || CASE WHEN starts_with(url, 'http:') THEN '1' ELSE '0' END || ',1,1,1' WHEN 2 THEN '0,0,2,0,0,0,0,0,1' ELSE '0,0,0,0,0,0,0,0,0' END), 1, 15))::BIGINT AS form_fp_hash64,
 CASE WHEN v = 1 THEN ('0x' || substr(md5('a|b|c'), 1, 15))::BIGINT END AS form_css_sig_hash64 FROM (SELECT page_id, url, page_id % 4 AS v FROM pages)""")
def _(t):
    cols = hm.form_columns(F.col("page"), *ctx())
    return hm.with_parsed(pages(t), parts=hm.parts_for(cols)).select("page_id", *[c.alias(k) for k, c in cols.items()])


@query("c9_first_login_form", """SELECT page_id, CASE WHEN v = 1 THEN true END AS first_login_method_get, CASE WHEN v = 1 THEN true END AS first_login_cross_origin, CASE WHEN v = 1 THEN starts_with(url, 'http:') END AS first_login_proto_mismatch,
 CASE WHEN v = 1 THEN ('0x' || substr(md5('mail|email|pw|password'), 1, 15))::BIGINT END AS first_login_fp_hash64, CASE WHEN v = 1 THEN ('0x' || substr(md5('a|b|c'), 1, 15))::BIGINT END AS first_login_css_hash64 FROM (SELECT page_id, url, page_id % 4 AS v FROM pages)""")
def _(t):
    cols = hm.first_login_columns(F.col("page"), *ctx())
    return hm.with_parsed(pages(t), parts=hm.parts_for(cols)).select("page_id", *[c.alias(k) for k, c in cols.items()])


@query("c16_modal_and_qr", "SELECT page_id, page_id % 4 = 3 AS bitb_like_modal, page_id % 4 = 3 AS qr_flag FROM pages")
def _(t):
    cols, wanted = hm.cloak_columns(F.col("page")), ("bitb_like_modal", "qr_flag")
    return hm.with_parsed(pages(t), parts=hm.parts_for(wanted)).select("page_id", *[cols[k].alias(k) for k in wanted])


@query("c17_meta_refresh", H_CTE + " SELECT page_id, regexp_matches(html, '(?i)<meta[^>]*http-equiv=\"?refresh') AS parsed, regexp_matches(html, '(?i)<meta[^>]*http-equiv=\"?refresh') AS by_pattern FROM h")
def _(t):
    return hm.with_parsed(pages(t), parts=("pragmas",)).select("page_id", hm.cloak_columns(F.col("page"))["has_meta_refresh"].alias("parsed"), sc.has_meta_refresh(F.col("html")).alias("by_pattern"))


ENTITIES = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("c21_visible_text", H_CTE + """, s AS (SELECT page_id, replace(replace(html, '<p hidden>secret text</p>', ' '), '<p style="display:none">gone</p>', ' ') AS x FROM h),
k AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS x FROM s)
SELECT page_id, trim(regexp_replace(""" + ENTITIES.format("regexp_replace(x, '<[^>]*>', ' ', 'g')") + """, '\\s+', ' ', 'g')) AS visible FROM k""")
def _(t):
    return hm.with_parsed(pages(t), parts=("visible",)).select("page_id", F.col("page.visible").alias("visible"))


@query("c22_canonical_markup")
def _(t):
    return hm.with_parsed(pages(t), parts=("canonical",)).select("page_id", F.col("page.canonical").alias("canonical"))


@query("c23_scripts", H_CTE + """, e AS (SELECT page_id, v, unnest(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')) AS s FROM h)
SELECT page_id, CASE WHEN contains(s, 'src=') THEN regexp_extract(s, 'src="([^"]*)"', 1) END AS src, NOT contains(s, 'src=') AS inline, CASE WHEN NOT contains(s, 'src=') THEN regexp_replace(regexp_replace(s, '^<script[^>]*>', ''), '</script>$', '') END AS text, CASE WHEN contains(s, 'async') THEN 'async' ELSE '' END AS attrs FROM e""")
def _(t):
    rows = hm.with_parsed(pages(t), parts=("scripts",)).select("page_id", F.inline("page.scripts"))
    return rows.select("page_id", "src", "inline", "text", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs"))


@query("d23_external_script_fill", H_CTE + """, e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')) AS s FROM h)
SELECT page_id, CASE WHEN contains(s, 'src=') THEN regexp_extract(s, 'src="([^"]*)"', 1) END AS src, CASE WHEN NOT contains(s, 'src=') THEN regexp_replace(regexp_replace(s, '^<script[^>]*>', ''), '</script>$', '') ELSE 'body ' || page_id END AS text FROM e""")
def _(t):
    rows = hm.with_parsed(pages(t), parts=("scripts",)).select("page_id", F.inline("page.scripts")).select("page_id", "src", "text")
    captured = t("pages").select("page_id", F.lit("https://cdn.site.org/a.js").alias("src"), F.concat_ws(" ", F.lit("body"), "page_id").alias("body"))
    return hm.fill_external(rows, captured)


@query("c24_dom_nodes", H_CTE + """, k AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1', 'g') AS x FROM h), c AS (SELECT page_id, regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g') AS x FROM k),
e AS (SELECT page_id, unnest(regexp_extract_all(x, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM c) SELECT page_id, ('0x' || substr(md5(lower(tag)), 1, 15))::BIGINT AS tag_hash, count(*) AS nodes FROM e GROUP BY ALL""")
def _(t):
    graph = hm.with_parsed(pages(t), parts=("nodes",)).select("page_id", hm.dom_graph(F.col("page"), max_nodes=None).alias("g"))
    return graph.select("page_id", F.explode("g.nodes").alias("n")).groupBy("page_id", "n.tag_hash").agg(F.count(F.lit(1)).alias("nodes"))


@query("c24_dom_edges", H_CTE + """, k AS (SELECT page_id, v, regexp_replace(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1', 'g') AS x FROM h), c AS (SELECT page_id, v, regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g') AS x FROM k)
SELECT page_id, len(regexp_extract_all(x, '<[a-zA-Z]')) AS n, len(regexp_extract_all(x, '<[a-zA-Z]')) - 1 - CASE WHEN NOT contains(x, '</html>') THEN 0 WHEN v = 1 THEN 1 WHEN v = 2 THEN 3 WHEN v = 3 THEN 8 ELSE 0 END AS edges FROM c""")
def _(t):
    graph = hm.with_parsed(pages(t), parts=("nodes",)).select("page_id", hm.dom_graph(F.col("page"), max_nodes=None).alias("g"))
    return graph.select("page_id", F.col("g.n").cast("long").alias("n"), F.size("g.edges").cast("long").alias("edges"))


@query("c24_dom_graph_capped")
def _(t):
    graph = hm.with_parsed(pages(t), parts=("nodes",)).select("page_id", hm.dom_graph(F.col("page"), max_nodes=256).alias("g"))
    return graph.select("page_id", "g.n", F.size("g.edges").alias("edges"), F.aggregate("g.nodes", F.lit(0), lambda a, x: F.greatest(a, x.depth)).alias("max_depth"))


@query("c25_graph_backfill", H_CTE + """, k AS (SELECT page_id, CASE WHEN v = 3 THEN NULL WHEN v = 0 THEN html || '<p>' || url || '<b>y</b></p>' ELSE html END AS x FROM h), z AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1', 'g') AS x FROM k)
SELECT page_id, len(regexp_extract_all(regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g'), '<[a-zA-Z]')) AS n FROM z""")
def _(t):
    # A page in four has normalised markup, which comes first, and one has no markup at all.
    v = F.col("page_id") % 4
    rows = pages(t).select(
        "page_id", F.when(v == 0, F.concat("html", F.lit("<p>"), "url", F.lit("<b>y</b></p>"))).alias("html_norm"), F.when(v != 3, F.col("html")).otherwise(F.lit("")).alias("html"),
        F.lit(None).cast("struct<n: int, nodes: array<struct<tag_hash: bigint, class_hash: bigint, depth: int, text_bin: int>>, edges: array<struct<src: int, dst: int>>>").alias("dom_graph"),
    )
    return hm.backfill_graph(rows, ["html_norm", "html"]).select("page_id", F.col("dom_graph.n").cast("long").alias("n"))


@query("c34_icons_and_logos", """SELECT page_id, CASE WHEN v = 3 THEN 2 ELSE 1 END AS fav_rel_count, CASE WHEN v = 3 THEN 'https://cdn.site.com/f.ico' ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/favicon.ico' END AS favicon_url, v = 3 AS fav_cross_origin,
 CASE WHEN v = 3 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/brand.png 10000 false;' || regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/l.png 200 true' ELSE '' END AS logos FROM (SELECT page_id, url, page_id % 4 AS v FROM pages)""")
def _(t):
    c = hm.icon_columns(F.col("page"), F.col("url"))
    logos = F.array_join(F.transform(c["logo_candidates"], lambda x: F.concat_ws(" ", x.url, x.score.cast("string"), x.from_alt.cast("string"))), ";")
    return hm.with_parsed(pages(t), parts=hm.parts_for(c)).select("page_id", c["fav_rel_count"].alias("fav_rel_count"), c["favicon_url"].alias("favicon_url"), c["fav_cross_origin"].alias("fav_cross_origin"), logos.alias("logos"))


@query("m1_html_features", H_CTE + """ SELECT page_id, CASE WHEN v = 1 THEN 1 WHEN v = 2 THEN 2 ELSE 0 END AS top_form_count, v = 3 AS has_meta_refresh, trim(regexp_replace(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1), '\\s+', ' ', 'g')) AS js_text,
 trim(regexp_replace(""" + ENTITIES.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + """, '\\s+', ' ', 'g')) AS text_title FROM h""")
def _(t):
    f = hm.html_features(pages(t), columns=("top_form_count", "has_meta_refresh", "js_text", "text_title"))
    return f.select("page_id", "top_form_count", "has_meta_refresh", F.trim(F.regexp_replace("js_text", r"\s+", " ")).alias("js_text"), "text_title")


@query("c36_robust_scaling", """WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN greatest(-1e6, least(1e6, l_extendedprice - 2e4)) > 0 THEN ln(1 + least(1e6, l_extendedprice - 2e4)) ELSE greatest(-1e6, l_extendedprice - 2e4) END AS price, ln(1 + l_quantity) AS qty FROM lineitem),
q AS (SELECT quantile_cont(price, 5e-1) AS pm, quantile_cont(price, 75e-2) - quantile_cont(price, 25e-2) AS pi, quantile_cont(qty, 5e-1) AS qm, quantile_cont(qty, 75e-2) - quantile_cont(qty, 25e-2) AS qi FROM k)
SELECT l_orderkey, l_linenumber, round(greatest(-5e0, least(5e0, (price - pm) / pi)), 5) AS price, round(greatest(-5e0, least(5e0, (qty - qm) / qi)), 5) AS qty FROM k, q""")
def _(t):
    from pagerisk.functions.features import robust_scale

    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 20000.0).alias("price"), F.col("l_quantity").alias("qty"))
    out = robust_scale(rows, ["price", "qty"])
    return out.select("l_orderkey", "l_linenumber", F.round("price", 5).alias("price"), F.round("qty", 5).alias("qty"))
