"""URL expressions (B1-B5, C1, C2, C37, C38). No parse_url: it fails on junk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagerisk.functions.suffixes import public_suffix
from pagerisk.functions.text import chars, short_entropy

# Generic URI split: scheme, authority, path, query.
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    authority = F.regexp_replace(F.lower(part(url, 2)), r"^.*@", "")
    return F.regexp_replace(authority, r":[0-9]*$", "")


def canonical(url: Column) -> Column:
    """B1: lower scheme (default http) and authority, single slashes, no trailing slash, query kept, fragment dropped."""
    u = F.trim(url)
    s = F.when(part(u, 1) == "", F.lit("http")).otherwise(scheme(u))
    path = F.regexp_replace(F.concat(F.lit("/"), part(u, 3)), r"/+", "/")
    path = F.when((path != "/") & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    query = F.when(part(u, 4) != "", F.concat(F.lit("?"), part(u, 4))).otherwise(F.lit(""))
    return F.when(u == "", u).otherwise(F.concat(s, F.lit("://"), F.lower(part(u, 2)), path, query))


def with_scheme(url: Column) -> Column:
    """B2: trimmed, blank is NULL, http:// added when no http(s) prefix is there."""
    u = F.trim(url)
    return F.when(u == "", F.lit(None)).when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def first_filled(*columns: Column) -> Column:
    """First non-empty value."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def dedup_key(strategy: str, url: Column, url_final: Column, row: Column | None = None) -> Column:
    """Key strategies ``final``, ``raw``, ``final+query`` and ``sha_full`` (sha1 of the sorted JSON row)."""
    if strategy == "raw":
        return F.lower(F.trim(url))
    if strategy in ("final", "final+query"):
        return F.lower(F.trim(first_filled(url_final, url)))
    if strategy == "sha_full" and row is not None:
        return F.sha1(F.to_json(row))
    raise ValueError(f"unknown key strategy: {strategy}")


def stable_id(*candidates: Column) -> Column:
    """sha1 of the first URL field that is filled."""
    return F.sha1(F.trim(first_filled(*candidates)))


def lexicals(url: Column) -> dict[str, Column]:
    """Lexical features of a URL."""
    h = host(url)
    puny = h.startswith("xn--") | h.contains(".xn--")
    return {
        "tld": F.nullif(public_suffix(h), F.lit("")),
        "is_idn": h.rlike(r"[^\x00-\x7F]"),
        "is_punycode": puny,
        "has_punycode": puny,
        "url_len": F.length(url),
        "num_dots": F.regexp_count(h, F.lit(r"\.")),
        "num_pct": F.regexp_count(url, F.lit("%")),
        "has_at": url.contains("@"),
        "host_is_ip": h.rlike(IPV4),
        "host_hyphens": F.regexp_count(h, F.lit("-")),
    }


def shape(url: Column) -> dict[str, Column]:
    """Length, digit and symbol shares, entropy, subdomain depth."""
    u = F.trim(url)
    n = F.length(u)
    digits = F.regexp_count(u, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(u, F.lit(r"\p{L}"))
    some = n > 0
    return {
        "len": n,
        "digit_ratio": F.when(some, digits / n).otherwise(F.lit(0.0)),
        "symbol_ratio": F.when(some, (n - digits - letters) / n).otherwise(F.lit(0.0)),
        "entropy": short_entropy(u),
        "sub_depth": F.greatest(F.lit(0), F.regexp_count(host(u), F.lit(r"\.")) - 1),
    }


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda t: t != "")


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"^[^/]*://", "")


def domain_tokens(url: Column) -> Column:
    return _filled(F.split(F.regexp_extract(_rest(url), r"^([^/]*)", 1), r"[.\-]"))


def path_tokens(url: Column) -> Column:
    return _filled(F.split(F.regexp_replace(_rest(url), r"^[^/]*/?", ""), r"[/?&=_.\-]"))


def word_tokens(url: Column) -> Column:
    return F.regexp_extract_all(F.lower(url), F.lit(r"([a-z0-9]{3,})"), F.lit(1))


def domain_grams(url: Column, low: int = 3, high: int = 5) -> Column:
    from pagerisk.functions.text import ngrams

    bare = F.regexp_replace(F.regexp_extract(_rest(url), r"^([^/]*)", 1), r"[^a-z0-9]", "")
    return F.flatten(F.array(*[ngrams(bare, n) for n in range(low, high + 1)]))


def all_tokens(url: Column, longest: int | None = None) -> Column:
    """Distinct domain, path, word and n-gram tokens; ``longest`` leaves out longer ones."""
    union = F.array_distinct(F.concat(domain_tokens(url), path_tokens(url), domain_grams(url), word_tokens(url)))
    return union if longest is None else F.filter(union, lambda t: F.length(t) <= longest)


# Words that mark a term as suspicious.
SUSPICIOUS = ("login", "verify", "secure", "bank", "update", "payment", "account", "wallet")


def purity(terms: Column, words: tuple[str, ...] = SUSPICIOUS) -> Column:
    """Share of terms containing a suspicious word."""
    hits = F.size(F.filter(terms, lambda t: t.rlike("|".join(words))))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def skip_seed(url: Column, min_digits: int = 0, allow: tuple[str, ...] = (), endings: tuple[str, ...] = ()) -> Column:
    """Registered names that are all digits and long, or end with a banned ending."""
    from pagerisk.functions.suffixes import second_level_name

    name = second_level_name(host(url))
    skip = F.lit(False)
    if min_digits > 0:
        numeric = name.rlike("^[0-9]+$") & (F.length(name) >= min_digits)
        skip = skip | (numeric & ~name.isin(*allow) if allow else numeric)
    for e in endings:
        skip = skip | name.endswith(e)
    return skip


def is_positive(fields: list[Column], tag: Column) -> Column:
    """Label from the first present field; else the tag or source name."""
    # Strings that mean a positive label.
    words = ("1", "phish", "phishing", "malicious", "bad")
    value = F.coalesce(*[f.cast("string") for f in fields])
    number = value.try_cast("double")
    text = F.lower(F.trim(value))
    said = F.coalesce(number == 1, F.lit(False)) | text.isin(*words) | (text == "true")
    return F.when(value.isNotNull(), said).otherwise(F.coalesce(F.lower(tag).startswith("phish"), F.lit(False)))
