"""URL filtering: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The longest rule that fits a URL decides.  Where none fits, the URL's canonical form is looked up in the list: a blocked Bloom
filter (a 512-bit block per URL, one bit in each of its eight words) lets possible hits through to an exact join, which removes
false positives; all other rows are decided without a shuffle.  The filter's size is bounded (see ``bloom``), so it can
be broadcast whatever the list's size: a longer list only lets more rows through to the exact join.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and no canonical form, and is allowed; repeated rows are
judged alike; an empty list blocks nothing; null list entries are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import build_filter, flagged
from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path prefix


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without default port, path without trailing slashes, sorted query without ``utm_`` parameters; null without host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    base = F.concat(F.regexp_replace(host_of(url), ":(80|443)$", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) != "", F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.  ``rules`` is a configuration of some hundreds at most."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block); columns of these names are replaced."""
    outs = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in outs]
    urls = materialize(listed.select(canonical(F.col(f"`{listed_url}`")).alias("canonical")).where("canonical is not null").distinct(), "url-list")
    table, blocks = build_filter(urls, "canonical")

    u = F.col(f"`{url}`")
    rows = pages.select(*kept, u.alias("__url"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(verdict.isNull(), canonical(F.col("__url"))).alias("__canonical"))
    rows = flagged(rows, "__canonical", table, blocks)
    outs_now = [F.col(c) for c in ("host", "path", "rule")]
    clear = rows.where("not __maybe").select(*kept, *outs_now, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    exact = rows.where("__maybe").join(urls.select(F.col("canonical").alias("__entry"), F.lit(True).alias("__listed")), F.col("__canonical") == F.col("__entry"), "left")
    return clear.unionByName(exact.select(*kept, *outs_now, F.when(F.col("__listed"), "block").otherwise("allow").alias("verdict")))
