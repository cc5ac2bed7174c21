"""The page table: one schema, and enrichment that fills what is missing (B7, B11, C1, C7-C19, C26, C33, D16, M1 composed).

``enrich`` walks a graph of columns back from what is wanted: a step runs only if
some of its results are asked for and all it needs is there or can be made. All
results that come from markup share one parse, which yields just the parts they
need and skips rows that have everything. Values that are there already stay.
Wanted columns that nothing can make are reported, not filled with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.functions import scripts as sc
from pagerisk.functions import urls as u
from pagerisk.functions.features import CHEAP_FEATURES, cheap_features
from pagerisk.functions.suffixes import SuffixRules, registered_domain
from pagerisk.functions.text import JS_ALPHABET, JS_SEQ_CHARS, URL_ALPHABET, encode
from pagerisk.operators.html import FEATURE_PARTS, page_columns, parse_pages
from pagerisk.operators.joins import salted_join

# The columns of the page table by type.
_TYPES = {
    "STRING": "id url etld1 source html url_final tld registrar tls_version cert_issuer key_type hdr_csp hdr_hsts hdr_xfo hdr_refpol hdr_permspol hdr_xcto url_raw text_title text_visible",
    "DOUBLE": "timestamp redirect_max_ms ttl_mean req_thirdparty_ratio js_entropy",
    "INT": """label redirect_hops redir_hops redir_cross_host url_len num_dots num_pct host_hyphens dns_created_days_ago dns_updated_days_ago ns_count ttl_min
        rdap_age_days rdap_ns_count cert_age_days san_count tls_not_before_days tls_san_count req_unique_etld1 req_counts_script req_counts_css req_counts_xhr req_counts_img
        form_pw_count form_login_tokens form_hidden_count onsubmit_handlers num_pw num_email num_hidden top_form_count iframe_form_count
        js_eval_ct js_atob_ct js_b64_blob_ct js_keylog_listeners js_eval_like js_hex_ratio js_fromcharcode js_hi_entropy_ratio js_atob key_listeners_total title_host_jaccard_q8
        fav_rel_count cloak_delta_domlen""",
    "BIGINT": "rdap_registrar_hash64 tls_issuer_spki_hash64 form_fp_hash64 form_css_sig_hash64 phash64 favicon_dhash favicon_dhash64 logo_phash64",
    "BOOLEAN": """has_meta_refresh has_js_loc_replace is_idn is_punycode has_punycode has_at host_is_ip mx_present rdap_has_privacy form_cross_site form_autocomplete_off form_method_get
        action_cross_origin action_proto_mismatch iframe_login key_listener_pw fp_canvas fp_webgl fp_audio fp_font_enum fp_webrtc fav_cross_origin logo_from_alt_or_name
        bitb_like_modal qr_flag cloak_profile_mismatch""",
    "MAP<STRING, STRING>": "headers",
    "ARRAY<INT>": "url_charseq js_charseq logo_dom_color3",
    "ARRAY<STRUCT<src: STRING, inline: BOOLEAN, text: STRING, attrs: MAP<STRING, STRING>>>": "scripts",
    "STRUCT<n: INT, nodes: ARRAY<STRUCT<tag_hash: BIGINT, class_hash: BIGINT, depth: INT, text_bin: INT>>, edges: ARRAY<STRUCT<src: INT, dst: INT>>>": "dom_graph",
}
PAGE_SCHEMA = {c: t for t, names in _TYPES.items() for c in names.split()}

#: Columns that only help to make others; they are dropped unless wanted.
HELPERS = ("js_text", "favicon_url", "logo_candidates", "html_canonical")


def conform(df: DataFrame) -> DataFrame:
    """All columns of the page table with their types; absent ones are NULL, unreadable values too, others follow behind."""
    have = set(df.columns)
    scalar = lambda t: "<" not in t
    cast = lambda c, t: F.col(c).try_cast(t) if scalar(t) else F.col(c).cast(t)
    shaped = [(cast(c, t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in PAGE_SCHEMA.items()]
    return df.select(*shaped, *[c for c in df.columns if c not in PAGE_SCHEMA])


@dataclass(frozen=True)
class Step:
    """Columns made of other columns; ``any_of`` are inputs of which one is enough."""

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    make: Callable[[], dict[str, Column]] | None
    any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    """Facts looked up by ``key`` of ``table``, which has one row per key; ``source`` is the page column or an expression over ``inputs``."""

    table: DataFrame
    key: str
    source: Column
    inputs: tuple[str, ...]
    when: Column | None = None

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(c for c in self.table.columns if c != self.key)


@dataclass
class Plan:
    """What ``enrich`` will do: steps and lookups in order, parts of the parse, columns that nothing can make."""

    order: list[Step | Dimension] = field(default_factory=list)
    parsed: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()

    @property
    def parts(self) -> set[str]:
        return {p for c in self.parsed for p in FEATURE_PARTS[c]}


def _int(c: str) -> Column:
    return F.col(c).cast("int")


def _names(make: Callable[[Column], dict], *more) -> tuple[str, ...]:
    return tuple(make(F.lit(""), *more))


def steps(rules: SuffixRules | None = None) -> list[Step]:
    """The steps that need no parse and no lookup."""
    js, final = F.col("js_text"), F.col("url_final")
    text = F.array_join(F.transform(F.col("scripts"), lambda s: F.coalesce(s.text, F.lit(""))), "\n")
    registration = lambda *c: sc.compact_registration(*(F.col(x) if x else F.lit(None).cast("string") for x in c))
    one = lambda out, needs, value: Step((out,), needs, lambda: {out: value})
    return [
        Step(("url_final",), (), lambda: {"url_final": u.first_filled(F.col("url"))}, ("url",)),
        Step(("url_raw",), ("url_final",), lambda: {"url_raw": final}),
        Step(tuple(u.lexicals(F.lit("http://a.b"))), ("url_final",), lambda: u.lexicals(final)),
        Step(("etld1",), ("url_final",), lambda: {"etld1": registered_domain(u.host(final), rules)}),
        one("url_charseq", ("url_final",), encode(final, URL_ALPHABET)),
        one("js_text", ("scripts",), text),
        one("js_charseq", ("js_text",), encode(js, JS_ALPHABET, JS_SEQ_CHARS)),
        Step(_names(sc.heuristics), ("js_text",), lambda: sc.heuristics(js)),
        Step(_names(sc.micro_counters), ("js_text",), lambda: sc.micro_counters(js)),
        Step(_names(sc.fingerprint_flags, F.lit("")), ("html", "js_text"), lambda: sc.fingerprint_flags(F.col("html"), js)),
        one("has_js_loc_replace", ("js_text",), sc.location_flag(js)),
        Step(("key_listeners_total",), ("js_keylog_listeners",), lambda: {"key_listeners_total": F.col("js_keylog_listeners")}),
        Step(("key_listener_pw",), ("num_pw", "key_listeners_total"), lambda: {"key_listener_pw": sc.key_listener_rollup(F.col("key_listeners_total"), F.col("num_pw"))["key_listener_pw"]}),
        Step(tuple(sc.SECURITY_HEADERS), ("headers",), lambda: sc.security_headers(F.col("headers"))),
        one("redir_hops", ("redirect_hops",), _int("redirect_hops")),
        one("form_pw_count", ("num_pw",), _int("num_pw")),
        one("form_hidden_count", ("num_hidden",), _int("num_hidden")),
        one("action_cross_origin", ("form_cross_site",), F.col("form_cross_site")),
        one("iframe_login", ("iframe_form_count", "num_pw"), (F.col("iframe_form_count") > 0) & (F.col("num_pw") > 0)),
        one("favicon_dhash64", ("favicon_dhash",), F.col("favicon_dhash")),
        one("tls_not_before_days", ("cert_age_days",), _int("cert_age_days")),
        one("tls_san_count", ("san_count",), _int("san_count")),
        one("rdap_age_days", ("dns_created_days_ago",), _int("dns_created_days_ago")),
        one("rdap_ns_count", ("ns_count",), _int("ns_count")),
        Step(("rdap_registrar_hash64", "rdap_has_privacy"), ("registrar",), lambda: {
            k: v for k, v in registration("registrar", "", "", "", "").items() if k in ("rdap_registrar_hash64", "rdap_has_privacy")}),
    ]


_PARSE_INPUTS = ("html", "url_final", "etld1")
_LINKED = {c for c in FEATURE_PARTS if c.startswith(("form_", "first_login", "fav", "logo", "action_", "title_host"))}


def plan(columns: Iterable[str], wanted: Sequence[str], dims: Sequence[Dimension] = (), rules: SuffixRules | None = None) -> Plan:
    """Which steps make the wanted columns out of those given; nothing runs.

    A step is taken once, before those that need it. Given columns count as
    sources and, where a step can make them too, have their NULLs filled.
    """
    given, out, state = set(columns), Plan(), {}
    made = {c: s for s in reversed([*steps(rules), *dims]) for c in s.outputs}
    parsed: list[str] = []

    def reach(column: str) -> bool:
        """True if the column is there or will be made; puts what makes it into the order."""
        if column not in state:
            state[column] = column in given  # also ends a cycle
            state[column] = _make(column) or column in given
        return state[column]

    def _make(column: str) -> bool:
        if column in made:
            step = made[column]
            some = getattr(step, "any_of", ())
            ok = all([reach(c) for c in step.inputs]) and (not some or any([reach(c) for c in some]))
            if ok and step not in out.order:
                out.order.append(step)
            if ok or column not in FEATURE_PARTS:
                return ok
        if column in FEATURE_PARTS and all([reach(c) for c in (_PARSE_INPUTS if column in _LINKED else ("html",))]):
            if column not in parsed:
                parsed.append(column)
            return True
        return False

    out.absent = tuple(c for c in wanted if not reach(c))
    out.parsed = tuple(parsed)
    return out


def _fill(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    have = dict(df.dtypes)
    typed = {c: v.cast(PAGE_SCHEMA.get(c, have.get(c, ""))) if c in PAGE_SCHEMA or c in have else v for c, v in made.items()}
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in typed.items()})


def _parse(df: DataFrame, parsed: Sequence[str]) -> DataFrame:
    """One parse for all columns made of markup, of the rows that lack any of them."""
    have = set(df.columns)
    lacking = F.lit(False)
    for c in parsed:
        lacking = lacking | (F.col(c).isNull() if c in have else F.lit(True))
    parts = {p for c in parsed for p in FEATURE_PARTS[c]}
    url = F.col("url_final") if "url_final" in have else F.lit(None).cast("string")
    domain = F.col("etld1") if "etld1" in have else F.lit(None).cast("string")
    usable = F.col("html").isNotNull() & lacking
    page = df.withColumn("_page", parse_pages(F.when(usable, F.col("html")), parts))
    made = page_columns(F.col("_page"), url, domain, parsed)
    return _fill(page, {c: F.when(usable, v) for c, v in made.items()}).drop("_page")


def _look_up(df: DataFrame, dim: Dimension, wanted: set[str], row_key: str) -> DataFrame:
    """Non-NULL facts fill missing page columns; only keys that are hot among the pages are salted."""
    kept = [c for c in dim.outputs if c in wanted or c in df.columns]
    facts = dim.table.select(F.col(dim.key).alias("_key"), *[F.col(c).alias(f"_dim_{c}") for c in kept])
    usable = dim.source if dim.when is None else F.when(dim.when, dim.source)
    joined = salted_join(df.withColumn("_key", usable), facts, ["_key"], row_key)
    return _fill(joined, {c: F.col(f"_dim_{c}") for c in kept}).drop("_key", *[f"_dim_{c}" for c in kept])


def enrich(
    pages: DataFrame, dims: Sequence[Dimension] = (), wanted: Sequence[str] | None = None, row_key: str = "id", rules: SuffixRules | None = None,
) -> tuple[DataFrame, tuple[str, ...]]:
    """Fill the wanted columns (default: the whole page table) and name those that nothing can make.

    Rows are never dropped or repeated: a lookup table must hold each key once. Rows
    whose key is NULL, or has no facts, keep what they have. Columns outside the
    page table pass through.
    """
    wanted = list(PAGE_SCHEMA if wanted is None else wanted)
    todo = plan(pages.columns, wanted, dims, rules)
    asked = {c for s in todo.order for c in (*s.inputs, *getattr(s, "any_of", ()))} | set(wanted)
    pending, out = list(todo.order), pages
    # Lookups may need parsed columns and the parse needs URL columns, so each runs as soon as its inputs are there.
    parse_left = bool(todo.parsed)
    will_parse = set(todo.parsed) - set(pages.columns)
    while pending or parse_left:
        later = {c for s in pending for c in s.outputs} - set(out.columns)
        step = next((s for s in pending if not set(s.inputs) & (later | (will_parse if parse_left else set()))), None)
        if step is None:
            out, parse_left = _parse(out, todo.parsed), False
            continue
        pending.remove(step)
        if isinstance(step, Dimension):
            out = _look_up(out, step, asked, row_key)
        else:
            out = _fill(out, {c: v for c, v in step.make().items() if c in asked or c in out.columns})
    return out.drop(*[h for h in HELPERS if h not in wanted and h not in pages.columns]), todo.absent


def feature_vector(pages: DataFrame, dims: Sequence[Dimension] = (), keys: Sequence[str] = ("id",), row_key: str = "id", rules: SuffixRules | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """B7 after enrichment: the keys and all features as DOUBLE in vector order, and the names of features without a source, which are 0."""
    full, absent = enrich(pages, dims, [*CHEAP_FEATURES], row_key, rules)
    numbers = cheap_features(full.columns)
    return full.select(*keys, *[c.alias(name) for name, c in numbers.items()]), absent
