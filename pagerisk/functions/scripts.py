"""Script and page-text expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagerisk.functions import chars as ch
from pagerisk.functions.chars import MODULUS
from pagerisk.functions.text import collapse, count_of, entropy, hash60, window_entropies

# Patterns whose counts are features.
EVAL_CALL = r"\beval\s*\("
NEW_FUNCTION = r"new\s+Function\s*\("
ATOB_CALL = r"\batob\s*\("
FROM_CHAR_CODE = r"\bfromCharCode\b"
BASE64_BLOB = r"[A-Za-z0-9+/]{80,}={0,2}"
KEY_LISTENER = r"""addEventListener\s*\(\s*['"](?:key(?:down|up)|paste)['"]"""
STRING_LITERAL = r"""("(?:\\.|[^\\"])*"|'(?:\\.|[^\\'])*'|`(?:\\.|[^\\`])*`)"""
LOCATION_CALL = r"(?i)location\s*\.(?:replace|assign)\s*\("
LOCATION_REPLACE = r"location\s*\.replace\s*\("
TIMER_STRING = r"""setTimeout\s*\(\s*['"]"""
SECURITY_HEADERS = {
    "hdr_csp": "content-security-policy",
    "hdr_hsts": "strict-transport-security",
    "hdr_xfo": "x-frame-options",
    "hdr_refpol": "referrer-policy",
    "hdr_permspol": "permissions-policy",
    "hdr_xcto": "x-content-type-options",
}
FINGERPRINT_WORDS = {
    "fp_canvas": ("getcontext('2d'", "canvas.todataurl", "measuretext"),
    "fp_webgl": ("webglrenderingcontext", "getcontext('webgl'", "getcontext('experimental-webgl'"),
    "fp_audio": ("audiocontext", "offlineaudiocontext"),
    "fp_webrtc": ("rtcpeerconnection", "getusermedia", "enumeratedevices"),
}
WINDOWED = {"eval_like": r"\b(?:eval|Function)\b\s*\(", "fromcharcode": r"String\.fromCharCode", "atob": r"\batob\b", "hex": r"\\x[0-9A-Fa-f]{2}"}
HEX_DIGITS = "0123456789abcdefABCDEF"
FONT_WORDS = ("measuretext", "font", "enumerat")
META_REFRESH = r"""(?is)<meta\b[^>]*http[-_]equiv\s*=\s*["']?\s*refresh"""
PRIVACY_WORDS = "privacy|whoisguard|proxy|redacted"
SCRIPT_SEPARATOR = "\n\n<sep>\n\n"


def count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def security_headers(headers: Column) -> dict[str, Column]:
    """Six headers looked up whatever their case."""
    def find(name):
        return F.try_element_at(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(1))

    return {column: find(name) for column, name in SECURITY_HEADERS.items()}


def heuristics(js: Column) -> dict[str, Column]:
    """Call counts and entropy of the whole script text."""
    return {
        "js_entropy": F.round(entropy(js), 4),
        "js_eval_ct": count(js, EVAL_CALL) + count(js, NEW_FUNCTION),
        "js_atob_ct": count(js, ATOB_CALL) + count(js, FROM_CHAR_CODE),
        "js_b64_blob_ct": count(js, BASE64_BLOB),
        "js_keylog_listeners": count(js, KEY_LISTENER),
    }


def string_literals(js: Column) -> Column:
    quoted = F.regexp_extract_all(js, F.lit("(?s)" + STRING_LITERAL), F.lit(1))
    return F.transform(quoted, lambda q: q.substr(F.lit(2), F.length(q) - 2))


def literal_entropy(js: Column) -> Column:
    """C11: entropy over the quoted literals, over all text when there are none."""
    found = string_literals(js)
    return F.round(entropy(F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(js)), 4)


def u8(value: Column) -> Column:
    """Saturate at 255; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.lit(255), F.floor(value).cast("int")))


def micro_counters(js: Column) -> dict[str, Column]:
    """Small counters saturating at 255."""
    n = F.greatest(F.lit(1), F.length(js))
    return {
        "js_eval_like": u8(count(js, EVAL_CALL + "|" + NEW_FUNCTION)),
        "js_fromcharcode": u8(count(js, "(?i)fromCharCode")),
        "js_atob": u8(count(js, ATOB_CALL)),
        "js_hex_ratio": u8(count_of(js, HEX_DIGITS) / n * F.lit(255.0)),
        "js_hi_entropy_ratio": u8(entropy(js) / F.lit(8.0) * F.lit(255.0)),
    }


def windows(s: Column, size: int = 1024, step: int = 512) -> Column:
    """overlapping fixed windows of a string, joined from its blocks of ``step`` characters, so that no window counts from the start."""
    if size % step:
        raise ValueError("a window must be whole steps long")
    blocks = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.when(F.length(s) > 0, F.transform(blocks, lambda _, i: F.array_join(F.slice(blocks, i + 1, size // step), ""))).otherwise(F.array().cast("array<string>"))


def windowed_counters(js: Column, high: float = 7.0) -> dict[str, Column]:
    """Counters with the share of high-entropy windows, saturating at 255."""
    n = F.greatest(F.lit(1), F.length(js))
    cut = window_entropies(js)
    hot = F.size(F.filter(cut, lambda e: e > high))
    return {
        "js_eval_like": u8(count(js, WINDOWED["eval_like"]) + count(js, TIMER_STRING)),
        "js_fromcharcode": u8(count(js, WINDOWED["fromcharcode"])),
        "js_atob": u8(count(js, WINDOWED["atob"])),
        "js_hex_ratio": u8(count(js, WINDOWED["hex"]) / n * F.lit(255.0)),
        "js_hi_entropy_ratio": u8(hot / F.greatest(F.lit(1), F.size(cut)) * F.lit(255.0)),
    }


def fingerprint_flags(html: Column, js: Column) -> dict[str, Column]:
    """C14: substring tests over page and scripts."""
    low = F.lower(F.concat_ws("\n", html, js))

    def any_of(words):
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    flags = {k: any_of(v) for k, v in FINGERPRINT_WORDS.items()}
    flags["fp_font_enum"] = low.contains(FONT_WORDS[0]) | (low.contains(FONT_WORDS[1]) & low.contains(FONT_WORDS[2]))
    return flags


def location_flag(js: Column, replace_only: bool = False) -> Column:
    """Script moves the page elsewhere."""
    return js.rlike(LOCATION_REPLACE if replace_only else LOCATION_CALL)


def key_listener_rollup(listeners: Column, passwords: Column) -> dict[str, Column]:
    """Total listeners and whether they meet a password field."""
    total = F.coalesce(listeners, F.lit(0))
    return {"key_listeners_total": total, "key_listener_pw": (F.coalesce(passwords, F.lit(0)) > 0) & (total > 0)}


def unescape(s: Column) -> Column:
    """The named entities a title commonly holds; the page job decodes all of them."""
    out = s
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def title(html: Column, max_chars: int | None = None) -> Column:
    """C20: text of the first title element, whitespace collapsed."""
    t = collapse(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return t if max_chars is None else F.substring(t, 1, max_chars)


def inline_scripts(html: Column) -> Column:
    """Bodies of the script elements without a src."""
    elements = F.regexp_extract_all(html, F.lit(r"(?is)(<script\b[^>]*>.*?</script>)"), F.lit(1))
    own = F.filter(elements, lambda e: ~e.rlike(r"(?is)^<script\b[^>]*\ssrc\s*="))
    return F.transform(own, lambda e: F.regexp_replace(F.regexp_replace(e, r"(?is)^<script\b[^>]*>", ""), r"(?is)</script>$", ""))


def has_meta_refresh(html: Column) -> Column:
    """C17: a refresh pragma is present."""
    return html.rlike(META_REFRESH)


def tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: t != ""))


def jaccard_q8(a: Column, b: Column) -> Column:
    """Token overlap of two texts scaled to 0..255, half rounded to even."""
    x, y = tokens(a), tokens(b)
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(F.bround(share * 255.0).cast("int"))


def joined_scripts(texts: Column, most: int | None = None, max_chars: int | None = None) -> Column:
    """The scripts with text, trimmed and joined; ``most`` and ``max_chars`` are a model's widths."""
    full = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    out = F.array_join(full if most is None else F.slice(full, 1, most), SCRIPT_SEPARATOR)
    return out if max_chars is None else F.substring(out, 1, max_chars)


def budgeted_scripts(texts: Column, budget: int) -> Column:
    """Scripts joined by newlines while the characters taken stay within a budget."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))

    def take(acc, t):
        left = F.lit(budget) - acc.used
        chunk = t.substr(F.lit(1), left)
        more = (left > 0) & (F.length(t) > 0)
        return F.struct(
            F.when(more, F.array_append(acc.parts, chunk)).otherwise(acc.parts).alias("parts"),
            F.when(more, acc.used + F.length(chunk)).otherwise(acc.used).alias("used"),
        )

    return F.array_join(F.aggregate(F.filter(texts, lambda t: t.isNotNull()), start, take).parts, "\n")


def minify(js: Column) -> Column:
    """Comments out, whitespace collapsed."""
    no_blocks = F.regexp_replace(js, r"(?s)/\*.*?\*/", " ")
    return collapse(F.regexp_replace(no_blocks, r"//[^\n]*", " "))


@cache
def _hex_escape(limit: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from ch.in_stretches(batches, lambda s, row: ch.hex_escaped(s, row, limit), pa.string())

    return F.arrow_udf(run, "STRING")


def hex_escape(js: Column, key: Column, prob: float = 0.05, seed: int = 42) -> Column:
    """Letters and digits become \\xNN with a given chance, decided by seed, key and position."""
    row = F.pmod(hash60(F.concat(F.lit(f"{seed}|"), key.cast("string"))), F.lit(MODULUS))
    return _hex_escape(int(prob * MODULUS))(js, row)


LITERAL = "(?s)'[^']{2,}?'|\"[^\"]{2,}?\""


def split_literals(js: Column, key: Column, prob: float = 0.05, seed: int = 42) -> Column:
    """String literals of four or more characters become two joined ones with a given chance.

    The text is cut at its literals; draw and place of the cut depend on seed, key
    and the literal's number in the text, so any engine gives the same.
    """
    between = F.split(js, LITERAL, -1)
    literals = F.regexp_extract_all(js, F.lit(LITERAL), F.lit(0))

    def changed(i: Column) -> Column:
        own = F.get(literals, i)
        quote, n = F.substring(own, 1, 1), F.length(own) - 2
        draw = hash60(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|"), i.cast("string")))
        cut = F.floor(draw / F.lit(MODULUS)).cast("bigint") % F.greatest(n - 1, F.lit(1)) + 1
        halves = F.concat(own.substr(F.lit(1), (cut + 1).cast("int")), quote, F.lit("+"), quote, own.substr((cut + 2).cast("int"), F.length(own)))
        return F.when((n < 4) | (F.pmod(draw, F.lit(MODULUS)) >= int(prob * MODULUS)), own).otherwise(halves)

    return F.array_join(F.transform(between, lambda gap, i: F.concat(gap, F.coalesce(changed(i), F.lit("")))), "")


def compact_registration(registrar: Column, created_days: Column, ns_count: Column, cert_age: Column, sans: Column) -> dict[str, Column]:
    """Compact registration and certificate columns."""
    name = F.nullif(registrar, F.lit(""))
    return {
        "tls_not_before_days": cert_age.cast("int"),
        "tls_san_count": sans.cast("int"),
        "rdap_age_days": created_days.cast("int"),
        "rdap_ns_count": ns_count.cast("int"),
        "rdap_registrar_hash64": hash60(name),
        "rdap_has_privacy": F.lower(name).rlike(PRIVACY_WORDS),
    }


def days_ago(iso: Column, as_of: Column) -> Column:
    """Whole days between an ISO timestamp and ``as_of``, NULL when unreadable."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp(iso))) / F.lit(1_000_000.0)
    return (seconds / F.lit(86400.0)).cast("int")
