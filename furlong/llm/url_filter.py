r"""URL rules found through their rarest literal token, then run as expressions.

Two kinds of rule share one index. A *site rule* ``host/path`` fits the host and
its subdomains when the url's path starts with the rule's. A *pattern* is
searched for in host and path: ``*`` stands for anything, ``^`` for one
character outside ``[A-Za-z0-9]`` or the end, ``||`` for the start of a host or
of one of its parent domains.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules found by the index are broadcast up to this many.
FEW_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[A-Za-z0-9]"


@dataclass(frozen=True)
class Rule:
    """``site``: a site rule and not a pattern; site rules win over patterns."""

    text: str
    verdict: str
    site: bool = False

    def regex(self) -> str:
        if self.site:
            return r"^(?:[^/]*\.)?" + re.escape(self.text)
        body, anchor = self.text, ""
        if body.startswith("||"):
            body, anchor = body[2:], r"^(?:[^/]*\.)?"
        parts = {"*": ".*", "^": f"(?:[^A-Za-z0-9]|$)"}
        return "(?is)" + anchor + "".join(parts.get(c) or re.escape(c) for c in body)

    def tokens(self) -> list[str]:
        """Lower-case tokens that every fitting url has as whole tokens.

        A run at an open end, or beside ``*``, may be part of a longer token.
        """
        text = self.text.lower()
        if self.site or text.startswith("||"):
            text = "/" + text.removeprefix("||")
        return sorted(set(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty where the url is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict (replaced if present).

    ``rule`` is the longest fitting site rule; without one, the longest fitting
    pattern decides and is named in ``pattern``; without either, ``default``.
    Equal lengths: the smaller text in code-point order. Null urls and urls
    without ``://`` have empty host and path and fit no site rule. Rules with no
    whole token are tried on every url. Duplicate pages are judged alike; an
    empty table gives an empty result. Other columns are kept, whatever their names.
    """
    spark = pages.sparkSession
    rules = list(dict.fromkeys(rules))
    host, path = split_url(F.col("_url"))
    # a page is judged by its url alone, so each url is judged once
    urls = pages.select(F.col(f"`{url_col}`").alias("_url")).where("_url IS NOT NULL").distinct()
    urls = urls.withColumn("_subject", F.concat(host, path))
    words = F.split(F.translate("_subject", _UPPER, _LOWER), "[^a-z0-9]+")
    tokens = urls.select(
        "_url", "_subject", F.explode(F.array_distinct(F.concat(words, F.array(F.lit(""))))).alias("_token")
    )

    wanted = spark.createDataFrame(
        [(t,) for t in sorted({t for r in rules for t in r.tokens()})], "_token string"
    )
    wanted = F.broadcast(wanted) if len(rules) <= FEW_RULES else wanted
    counted = tokens.select("_token").join(wanted, "_token").groupBy("_token").count()
    seen = {r["_token"]: r["count"] for r in counted.collect()}  # a row per token of the rules
    index = [
        (
            min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default=""),
            r.regex(),
            r.site,
            len(r.text),
            r.text,
            r.verdict,
        )
        for r in rules
    ]
    index = spark.createDataFrame(
        index, "_token string, _regex string, _site boolean, _length int, _rule string, _verdict string"
    )
    index = F.broadcast(index) if len(rules) <= FEW_RULES else index
    fits = tokens.join(index, "_token").where(F.expr("_subject RLIKE _regex"))
    order = F.struct(~F.col("_site"), -F.col("_length"), F.col("_rule"))
    best = fits.groupBy("_url").agg(F.min_by(F.struct("_site", "_rule", "_verdict"), order).alias("_best"))

    # the caller's columns travel as one, so that none can clash with names used here
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_page"), F.col(f"`{url_col}`").alias("_page_url"))
    host, path = split_url(F.col("_page_url"))
    return rows.join(best, F.col("_page_url") == F.col("_url"), "left").select(
        "_page.*",
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("_best._site"), F.col("_best._rule")).alias("rule"),
        F.when(~F.col("_best._site"), F.col("_best._rule")).alias("pattern"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
    )
