"""The ordered cheap-feature vector and its robust scaling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.functions.mathx import clamp
from pagerisk.operators.quantiles import quantiles

# The feature columns of the page table, in vector order.
CHEAP_FEATURES = (
    "redirect_hops", "redirect_max_ms", "url_len", "num_dots", "num_pct", "has_at", "host_is_ip",
    "host_hyphens", "has_punycode",
    "redir_hops", "redir_cross_host", "has_meta_refresh", "has_js_loc_replace",
    "dns_created_days_ago", "dns_updated_days_ago", "ns_count", "mx_present", "ttl_min", "ttl_mean",
    "rdap_age_days", "rdap_registrar_hash64", "rdap_ns_count", "rdap_has_privacy",
    "cert_age_days", "san_count",
    "tls_not_before_days", "tls_san_count", "tls_issuer_spki_hash64",
    "req_unique_etld1", "req_thirdparty_ratio", "req_counts_script", "req_counts_css", "req_counts_xhr", "req_counts_img",
    "form_pw_count", "form_cross_site", "form_login_tokens", "form_hidden_count", "form_autocomplete_off", "onsubmit_handlers",
    "form_fp_hash64", "num_pw", "num_email", "num_hidden", "form_method_get", "action_cross_origin", "action_proto_mismatch",
    "iframe_login", "top_form_count", "iframe_form_count", "form_css_sig_hash64",
    "js_entropy", "js_eval_ct", "js_atob_ct", "js_b64_blob_ct", "js_keylog_listeners",
    "js_eval_like", "js_hex_ratio", "js_fromcharcode", "js_hi_entropy_ratio", "js_atob", "key_listener_pw", "key_listeners_total",
    "fp_canvas", "fp_webgl", "fp_audio", "fp_font_enum", "fp_webrtc",
    "favicon_dhash64", "fav_rel_count", "fav_cross_origin", "logo_phash64", "logo_from_alt_or_name",
    "title_host_jaccard_q8",
)


def as_number(c: Column) -> Column:
    """Booleans become 0/1, NULL and unreadable text 0."""
    text = F.lower(c.cast("string"))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def cheap_features(columns: Iterable[str]) -> dict[str, Column]:
    """One DOUBLE expression per feature in order; absent columns are 0."""
    have = set(columns)
    return {c: as_number(F.col(c)) if c in have else F.lit(0.0) for c in CHEAP_FEATURES}


def squash(c: Column) -> Column:
    x = clamp(c, -1e6, 1e6)
    return F.when(x > 0, F.log1p(x)).otherwise(x)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(squashed value - median) / interquartile range, clamped to +-5.

    The statistics are three numbers per column, read once by the driver and
    put into the plan as literals, so the rows are never shuffled for scaling.
    """
    squashed = df.withColumns({c: squash(F.col(c)) for c in columns})
    long = squashed.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    stats = {(r["column"], r["prob"]): r["quantile"] for r in quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).collect()}

    def scaled(c):
        mid, iqr = stats.get((c, 0.5), 0.0), stats.get((c, 0.75), 0.0) - stats.get((c, 0.25), 0.0)
        return clamp((F.col(c) - F.lit(mid)) / F.lit(iqr if iqr >= 1e-6 else 1.0), -5.0, 5.0)

    return squashed.withColumns({c: scaled(c) for c in columns})
