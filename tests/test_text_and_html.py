import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagerisk.functions import scripts as sc
from pagerisk.functions import suffixes as sx
from pagerisk.functions import text as tx
from pagerisk.functions import urls as u
from pagerisk.functions.features import CHEAP_FEATURES, cheap_features
from pagerisk.functions.markup import parse
from pagerisk.operators import html as hm


def ev(spark, value, fn, kind="STRING"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def test_minify_golden(spark):
    assert ev(spark, "// comment\nvar x = 1;  /* block */\n\n  x += 2;", sc.minify) == "var x = 1; x += 2;"


@pytest.mark.parametrize("s", ["", "a", "aaaa", "abcabcé€😀", "x" * 999 + "yz.*[]\\"])
def test_entropy(spark, s):
    n = len(s)
    want = -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0
    assert ev(spark, s, tx.entropy) == pytest.approx(want)


def test_codes(spark):
    assert ev(spark, "aZ0~é", lambda c: tx.encode(c, tx.URL_ALPHABET)) == [2, 53, 54, len(tx.URL_ALPHABET) + 1, 1]
    assert ev(spark, "abcdef", lambda c: tx.encode(c, tx.URL_ALPHABET, 3)) == [2, 3, 4]
    assert ev(spark, "ab∕", lambda c: tx.encode(c, "ab∕")) == [2, 3, 4]
    assert ev(spark, "var é=1;\n", lambda c: tx.decode(tx.encode(c, tx.JS_ALPHABET), tx.JS_ALPHABET)) == "var =1;\n"
    assert ev(spark, "ab", lambda c: tx.ngrams(c, 3)) == [] and ev(spark, "abcd", lambda c: tx.ngrams(c, 3)) == ["abc", "bcd"]


@pytest.mark.parametrize("url,want", [
    ("  HTTP://Ex.COM//a///b/?q=1#f ", "http://ex.com/a/b?q=1"), ("ex.com", "http:///ex.com"), ("https://h", "https://h/"), ("https://h/", "https://h/"), ("", ""),
])
def test_canonical(spark, url, want):
    assert ev(spark, url, u.canonical) == want


@pytest.mark.parametrize("host,suffix,domain", [
    ("a.b.example.co.uk", "co.uk", "example.co.uk"), ("www.example.com", "com", "example.com"), ("x.y.ck", "y.ck", "x.y.ck"),
    ("www.ck", "ck", "www.ck"), ("1.2.3.4", "", "1.2.3.4"), ("localhost", "", "localhost"), ("co.uk", "co.uk", "co.uk"),
    ("a.b.com.co", "com.co", "b.com.co"), ("shop.co.at", "co.at", "shop.co.at"), ("x.gov.it", "gov.it", "x.gov.it"),
    ("b.a.xn--55qx5d.cn", "xn--55qx5d.cn", "a.xn--55qx5d.cn"), ("b.a.公司.cn", "公司.cn", "a.公司.cn"), ("x.y.kawasaki.jp", "y.kawasaki.jp", "x.y.kawasaki.jp"),
    ("a.city.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp"), ("a.b.unruled", "unruled", "b.unruled"), ("x.github.io", "io", "github.io"),
])
def test_registered_domain_by_rule_and_by_table(spark, host, suffix, domain):
    assert ev(spark, host, sx.public_suffix) == suffix and ev(spark, host, sx.registered_domain) == domain
    df = spark.createDataFrame([(host,)], "host STRING")
    assert sx.with_registered_domain(df, "host", sx.rules_table(spark)).first().etld1 == domain


def test_own_suffix_list(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("// comment\n\ncom\n*.wild.com\n!free.wild.com\n// ===BEGIN PRIVATE DOMAINS===\nhost.com\n// ===END PRIVATE DOMAINS===\nlate.org // tail\n", encoding="utf-8")
    rules, offered = (sx.read_rules(spark, str(path), private) for private in (False, True))
    rows = spark.createDataFrame([(h,) for h in ("a.b.c.wild.com", "a.free.wild.com", "a.host.com", "wild.com", "x.late.org")], "host STRING")
    got = [tuple(r) for r in rows.select(sx.registered_domain(F.col("host"), rules), sx.registered_domain(F.col("host"), offered)).collect()]
    assert got == [("b.c.wild.com", "b.c.wild.com"), ("free.wild.com", "free.wild.com"), ("host.com", "a.host.com"), ("wild.com", "wild.com"), ("x.late.org", "x.late.org")]
    assert sx.SuffixRules.parse([]).labels_sql == "h -> 1"


def test_augmentation_is_seeded(spark):
    js = "var abc = 'hello world'; f(\"xyz123\");"
    a, b = (ev(spark, js, lambda c: sc.hex_escape(c, F.lit("id1"), 0.5, s)) for s in (1, 1))
    assert a == b != js and ev(spark, js, lambda c: sc.hex_escape(c, F.lit("id1"), 0.5, 2)) != a
    assert ev(spark, js, lambda c: sc.hex_escape(c, F.lit("id1"), 0.0)) == js
    out = ev(spark, js, lambda c: sc.split_literals(c, F.lit("k"), 1.0, 3))
    assert out != js and out.replace("'+'", "").replace('"+"', "") == js
    for text in ("", "'ab' 'abc' no literal '", None, "'a\\nb\\nc'", "'" * 4):
        made = ev(spark, text, lambda c: sc.split_literals(c, F.lit("k"), 1.0, 3))
        assert (made is None) == (text is None) and (text is None or made.replace("'+'", "") == text)


def test_scripts_and_counters(spark):
    js = "eval(x);new Function(y);atob(z);String.fromCharCode(1);document.addEventListener('keydown',f);location.replace(u);" + "QUJD" * 25
    h = spark.createDataFrame([(js,)], "x STRING").select(*[c.alias(k) for k, c in sc.heuristics(F.col("x")).items()]).first()
    assert (h.js_eval_ct, h.js_atob_ct, h.js_b64_blob_ct, h.js_keylog_listeners) == (2, 2, 1, 1)
    assert ev(spark, js, sc.location_flag) and ev(spark, "eval(" * 400, lambda c: sc.micro_counters(c)["js_eval_like"]) == 255


def test_cheap_features(spark):
    assert len(CHEAP_FEATURES) == 74
    df = spark.createDataFrame([(10, True, "x"), (None, None, None)], "url_len INT, has_at BOOLEAN, js_entropy STRING")
    rows = df.select(F.array(*cheap_features(df.columns).values()).alias("v")).collect()
    assert len(rows[0].v) == 74 and sum(rows[0].v) == 11.0 and sum(rows[1].v) == 0.0


def test_cloaking_and_headers(spark):
    df = spark.createDataFrame([({"X-Frame-Options": "DENY", "x-frame-options": "later"},)], "h MAP<STRING, STRING>")
    r = df.select(*[c.alias(k) for k, c in sc.security_headers(F.col("h")).items()]).first()
    assert r.hdr_xfo in ("DENY", "later") and r.hdr_csp is None


PAGE = """<html><head><title> My  Bank &amp; Co </title><style>p{}</style><script>var a="</p>";</script>
<script src="/x.js" defer></script></head><body class="B a"><p>one<p>two<!-- c --><div hidden>no<b>pe</b></div>
<noscript>ns</noscript><span style="DISPLAY:none; x">gone</span><br>end</body></html>"""


def test_parse_page():
    p = parse(PAGE)
    assert p["title"] == "My Bank & Co" and p["visible"] == "My Bank & Co one two end"
    assert [(s["src"], s["inline"], s["text"]) for s in p["scripts"]] == [(None, True, 'var a="</p>";'), ("/x.js", False, None)]
    assert p["scripts"][1]["attrs"] == {"defer": ""}
    tags = [n["tag"] for n in p["nodes"]]
    assert tags[:3] == ["html", "head", "title"] and p["nodes"][tags.index("body")]["classes"] == "a|b"
    assert '<body class="B a">' in p["canonical"] and "<!--c-->" in p["canonical"]


def test_references_need_their_semicolon():
    p = parse("<title>a &amp; b &copy &ampc &nope; &#39;&#39 d&amp</title><p class='x&amp;y&lt'>&& &lt;i&gt;</p><!-- &amp --><script>a && b &amp; c</script>")
    assert p["title"] == "a & b &copy &ampc &nope; '&#39 d&amp"
    assert p["visible"].endswith("&& <i>") and p["nodes"][1]["classes"] == "x&y&lt"
    assert p["scripts"][0]["text"] == "a && b &amp; c" and "<!--&amp-->" in p["canonical"]


@pytest.mark.parametrize("html", [None, "", "plain text", "<", "</p></div>", "<b><i></b></i>", "<script>never closed"])
def test_parse_junk(html):
    p = parse(html)
    assert isinstance(p["nodes"], list) and all(n["parent"] < i for i, n in enumerate(p["nodes"]))


def test_dom_graph_cap(spark):
    html = "<ul>" + "<li>x</li>" * 300 + "</ul>"
    df = hm.with_parsed(spark.createDataFrame([(html,)], "html STRING"))
    g = df.select(hm.dom_graph(F.col("page"), 256).alias("a"), hm.dom_graph(F.col("page")).alias("b")).first()
    assert g.a.n == 256 and len(g.a.edges) == 255 and g.b.n == 301 and g.a.nodes[1].text_bin == 1 and g.a.nodes[1].depth == 1


def test_missing_graph_is_filled(spark):
    schema = "id INT, html STRING, dom_graph STRUCT<n: INT, nodes: ARRAY<STRUCT<tag_hash: BIGINT, class_hash: BIGINT, depth: INT, text_bin: INT>>, edges: ARRAY<STRUCT<src: INT, dst: INT>>>"
    df = spark.createDataFrame([(1, "<p>a<b>c</b></p>", None), (2, "<p>a</p>", (7, [], [])), (3, "", None)], schema)
    got = {r.id: r.n for r in hm.backfill_graph(df, ["html"]).select("id", "dom_graph.n").collect()}
    assert got == {1: 2, 2: 7, 3: None}


def test_parser_time_grows_with_the_page():
    import time

    from pagerisk.functions.markup import parse

    def seconds(n):
        page = "<form>" + "<p>a</p><script>var x = 1;</script>" * n + "</form>"
        start = time.process_time()
        assert len(parse(page)["scripts"]) == n
        return time.process_time() - start

    seconds(500)
    assert seconds(8000) < 12 * seconds(2000)


def test_pages_leave_the_parser_in_stretches():
    import pyarrow as pa

    rows = pa.array(["<p>a</p>" * 100, None, "", "<b>z</b>" * 100] * 200)
    out = list(hm.parse_stretches([rows, rows.slice(0, 0)], ("visible",), pa.struct([("visible", pa.string())]), stretch=8000))
    assert sum(len(b) for b in out) == 800 and max(len(b) for b in out) <= 20
    assert [r["visible"] for b in out for r in b.to_pylist()] == [" ".join("a" * 100), "", "", " ".join("z" * 100)] * 200


def test_queries_ask_for_the_parts_of_their_columns_only():
    assert hm.parts_for(["has_meta_refresh"]) == {"pragmas"} and hm.parts_for(["qr_flag", "bitb_like_modal"]) == {"images", "text", "modal_texts"}
