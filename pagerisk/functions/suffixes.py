"""Registered domains (C6): host -> public suffix + one label, by the published suffix list.

Rules are read from a list in the published text format: one rule a line, ``*.``
for any one label, ``!`` for an exception, comments by ``//``, names in Unicode.
Spark's distribution carries the list inside its HTTP client, which is the default;
any other copy is read with ``read_rules``.

The rules become a trie by labels from the right, laid out level by level: one
hash set of names per depth, looked up by a single expression, so a host is
matched where its row is and nothing is joined or shuffled.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IP = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
_ENTRY = "mozilla/public-suffix-list.txt"
_PRIVATE = ("===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS===")


def ascii_name(name: str) -> str:
    """The form of an internationalised name that travels in URLs."""
    return ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in name.split("."))


@dataclass
class SuffixRules:
    """Names by number of labels: suffixes, parents of any one label, and exceptions to those."""

    exact: dict[int, set[str]] = field(default_factory=dict)
    parents: dict[int, set[str]] = field(default_factory=dict)
    exceptions: dict[int, set[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: Iterable[str], private: bool = False) -> SuffixRules:
        """Rules of a list; suffixes that companies offer to others are left out unless ``private``."""
        rules, offered = cls(), False
        for line in lines:
            offered = (offered or _PRIVATE[0] in line) and _PRIVATE[1] not in line
            rule = line.split(maxsplit=1)[0].lower() if line.strip() else ""
            if not rule or rule.startswith("//") or (offered and not private):
                continue
            kind = rules.exceptions if rule.startswith("!") else rules.parents if rule.startswith("*.") else rules.exact
            name = rule.lstrip("!").removeprefix("*.").strip(".")
            kind.setdefault(name.count(".") + 1, set()).update((name, ascii_name(name)))
        return rules

    @cached_property
    def labels_sql(self) -> str:
        """SQL of a lambda from host to the number of labels of its suffix; an exception beats all, then the longest rule."""
        tail = lambda k: f"substring_index(h, '.', -{k})"
        listed = lambda k, names: f"{tail(k)} IN ({', '.join(chr(39) + n + chr(39) for n in sorted(names))})"
        cases = [f"WHEN {listed(k, names)} THEN {k - 1}" for k, names in sorted(self.exceptions.items(), reverse=True)]
        for k in range(max([1, *self.exact, *(k + 1 for k in self.parents)]), 1, -1):
            if k - 1 in self.parents:
                cases.append(f"WHEN {listed(k - 1, self.parents[k - 1])} AND {tail(k)} <> {tail(k - 1)} THEN {k}")
            if k in self.exact:
                cases.append(f"WHEN {listed(k, self.exact[k])} THEN {k}")
        # Rules of one label say what holds without a rule.
        return f"h -> CASE {' '.join(cases)} ELSE 1 END" if cases else "h -> 1"


def list_of_spark() -> list[str]:
    """Lines of the suffix list in the jars of the running Spark distribution."""
    import pyspark

    for home in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)):
        for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient*.jar"))) if home else []:
            with zipfile.ZipFile(jar) as z:
                if _ENTRY in z.namelist():
                    return z.read(_ENTRY).decode("utf-8").splitlines()
    raise FileNotFoundError("this Spark distribution has no suffix list; pass rules=read_rules(spark, path)")


@cache
def default_rules() -> SuffixRules:
    return SuffixRules.parse(list_of_spark())


def read_rules(spark: SparkSession, path: str, private: bool = False) -> SuffixRules:
    """Rules of a list in the published format, at a path Spark can read; the whole list is one small file."""
    whole = spark.read.text(path, wholetext=True)
    return SuffixRules.parse((line for r in whole.collect() for line in r[0].splitlines()), private)


def suffix_labels(host: Column, rules: SuffixRules | None = None) -> Column:
    """How many labels the public suffix of ``host`` has; one for names without a rule."""
    found = F.call_function("transform", F.array(host), F.expr((rules or default_rules()).labels_sql))
    return F.get(found, F.lit(0))


def _tail(host: Column, labels: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _nameless(host: Column) -> Column:
    return host.rlike(IP) | ~host.contains(".")


def public_suffix(host: Column, rules: SuffixRules | None = None) -> Column:
    """The suffix; empty for addresses and bare names."""
    return F.when(_nameless(host), F.lit("")).otherwise(_tail(host, suffix_labels(host, rules)))


def registered_domain(host: Column, rules: SuffixRules | None = None) -> Column:
    """eTLD+1; an address, a bare name or a name that is a suffix itself stands for itself."""
    return F.when(_nameless(host), host).otherwise(_tail(host, suffix_labels(host, rules) + 1))


def second_level_name(host: Column, rules: SuffixRules | None = None) -> Column:
    """The label before the public suffix."""
    return F.when(host.rlike(IP), host).otherwise(F.substring_index(registered_domain(host, rules), ".", 1))


def with_registered_domain(df: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """C6 with a user table ``(suffix, wildcard, exception)`` of any size and depth: longest match by join.

    Only distinct hosts are matched. Every suffix of a host is looked up; the
    longest rule wins, an exception beats a wildcard, and the last label is the
    fallback.
    """
    hosts = df.select(F.col(host).alias("_host")).distinct().filter("_host IS NOT NULL")
    parts = F.split("_host", r"\.")
    tails = hosts.select(
        "_host",
        F.size(parts).alias("_labels"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            i.alias("k"), F.array_join(F.slice(parts, -i, i), ".").alias("tail")))).alias("t"),
    ).select("_host", "_labels", "t.k", "t.tail")
    rules = suffixes.select(F.col("suffix").alias("tail"), "wildcard", "exception")
    hit = tails.join(rules, "tail").filter(~F.col("wildcard") | (F.col("k") < F.col("_labels")))
    k = F.when(F.col("exception"), F.col("k") - 1).when(F.col("wildcard"), F.col("k") + 1).otherwise(F.col("k"))
    best = hit.groupBy("_host").agg(F.max_by(k, F.struct(F.col("exception").cast("int"), k)).alias("k"))
    size = F.size(parts)
    take = F.least(size, F.coalesce(F.col("k"), F.lit(1)) + 1)
    domain = F.when(F.col("_host").rlike(IP) | (size == 1), F.col("_host")).otherwise(F.array_join(F.slice(parts, -take, take), "."))
    found = hosts.join(best, "_host", "left").select("_host", domain.alias("etld1"))
    return df.join(found, F.col(host) == F.col("_host"), "left").drop("_host")


def rules_table(spark: SparkSession, rules: SuffixRules | None = None) -> DataFrame:
    """The rules as a table ``(suffix, wildcard, exception)``."""
    held = rules or default_rules()
    rows = [(n, kind == 1, kind == 2) for kind, levels in enumerate((held.exact, held.parents, held.exceptions)) for names in levels.values() for n in sorted(names)]
    return spark.createDataFrame(rows, "suffix STRING, wildcard BOOLEAN, exception BOOLEAN")
