"""Line deduplication by how often a line occurs within its site."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.url_filter import split_url
from furlong.scale.storage import lay_down

RATIO = 0.2
MIN_PAGES = 3

_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figure|footer|form|"
    r"h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
_TAGS = r"<[^>]*>"
# A noncharacter that parts "<" from a name where the page never closes what is opened.
_PART = "￿"
# What opens, behind the "<", and what closes it.
_CLOSED = (("!--", "-->"), (r"script\b", r"</script\s*>"), (r"style\b", r"</style\s*>"))


def _without_unclosed(text: Column, opens: str, closes: str) -> Column:
    """``<`` is parted from ``opens`` behind the last ``closes``, where searches for it would all run to the end."""
    return F.regexp_replace(text, rf"(?is)(\A.*{closes})|(<)(?={opens})", f"$1$2{_PART}")


def _with(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` of a value that it names more than once, computed once."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


def _part_unclosed(text: Column) -> Column:
    """Comments, scripts and styles parted from their ``<`` where nothing closes them; most pages need no search."""
    closed = text
    for opens, closes in _CLOSED:
        closed = _without_unclosed(closed, opens, closes)

    def left_open(low: Column) -> Column:
        plain = [(o.removesuffix(r"\b"), c.replace(r"\s*", "")) for o, c in _CLOSED]
        return reduce(Column.__or__, (F.substring_index(low, c, -1).contains("<" + o) for o, c in plain))

    return F.when(_with(F.lower(text), left_open), closed).otherwise(text)


def _part_tags(text: Column) -> Column:
    """``<`` behind the last ``>`` parted from what follows."""
    hangs = F.substring_index(text, ">", -1).contains("<")
    return F.when(hangs, _without_unclosed(text, "", ">")).otherwise(text)


def html_lines(html: Column) -> Column:
    """Non-empty trimmed lines of a page: one for each block element or line break.

    Comments, scripts, styles and tags that are not closed are text. U+FFFF is left out.
    """
    text = F.regexp_replace(_with(F.coalesce(html, F.lit("")), _part_unclosed), _UNSEEN, " ")
    text = F.regexp_replace(_with(text, _part_tags), _BLOCKS, "\n")
    text = F.regexp_replace(text, _TAGS + r"|(<[^>]*\z)", "$1")
    # a line's end is looked for from the start of the white space before it only
    lines = F.split(F.replace(text, F.lit(_PART), F.lit("")), r"(?<![\x20\x09])[\x20\x09]*[\r\n]+[\x20\x09\r\n]*")
    return F.filter(lines, lambda x: F.trim(x) != "")


def site_line_dedup(
    pages: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id_col, host, n_lines, n_dropped, text (the lines that stay).

    A line goes when the pages of its host that contain it are more than
    ``ratio`` of the host's pages and at least ``min_pages``; a page counts once
    however often it repeats the line. Urls without a host are one site, so are
    null urls. Null and empty pages have no lines and an empty text. Repeated
    pages count as often as they occur. An empty table gives an empty result.
    Other columns are ignored, whatever their names. Time grows in line with a
    page's length, closed or not, and with its lines.
    """
    host, _ = split_url(F.col(url_col))
    parsed = pages.select(
        F.col(id_col).alias("_id"), host.alias("_host"), html_lines(F.col(html_col)).alias("_lines")
    )
    digest = lambda line: F.unhex(F.md5(F.trim(line)))
    parsed = lay_down(
        parsed.withColumn("_digests", F.transform("_lines", digest)).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "site-lines",
    )
    totals = parsed.groupBy(F.col("_host").alias("_site")).agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        parsed.select("_host", F.explode(F.array_distinct("_digests")).alias("_digest"))
        .groupBy("_host", "_digest")
        .agg(F.count(F.lit(1)).alias("_with"))
        .where(F.col("_with") >= min_pages)
    )
    boiler = (
        counts.join(totals, F.col("_host") == F.col("_site"))
        .where(F.col("_with") > F.lit(float(ratio)) * F.col("_pages"))
        .select(F.col("_host").alias("_b_host"), F.col("_digest").alias("_b_digest"))
    )
    placed = parsed.select("_row", "_host", F.posexplode("_digests").alias("_at", "_digest"))
    dropped = (
        placed.join(boiler, (F.col("_host") == F.col("_b_host")) & (F.col("_digest") == F.col("_b_digest")))
        .groupBy(F.col("_row").alias("_d_row"))
        .agg(F.collect_set("_at").alias("_gone"))
    )
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stays = F.when(F.size("_lines") > 0, F.array_except(places, gone)).otherwise(F.array().cast("array<int>"))
    return parsed.join(dropped, F.col("_row") == F.col("_d_row"), "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_dropped"),
        F.concat_ws("\n", F.transform(stays, lambda i: F.trim(F.get("_lines", i)))).alias("text"),
    )
