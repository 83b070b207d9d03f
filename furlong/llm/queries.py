"""One registered query per operator: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import (
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language,
    line_dedup,
    mixing,
    neighbours,
    pieces,
    quality,
    secrets,
    spelling,
    toxicity,
    url_filter,
)
from furlong.llm.common import Query, table

QUERIES: dict[str, Query] = {}

# The site rules of the registered query.
SITE_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
# What urls without a site rule are held against.
PATTERN_RULES = (
    ("||spam-farm.", "block"),
    ("||link-farm.", "block"),
    ("||ads.", "block"),
    ("||adserver.", "block"),
    ("||doubleclick.", "block"),
    ("/casino/", "block"),
    ("-casino-", "block"),
    ("/porn/", "block"),
    ("^porn.", "block"),
    ("/xxx/", "block"),
    ("^viagra^", "block"),
    ("/affiliate/*/banner", "block"),
    ("/wp-admin/", "block"),
    ("/wp-admin/about^", "allow"),
)
RULES = tuple(url_filter.Rule(t, v, site=True) for t, v in SITE_RULES) + tuple(
    url_filter.Rule(t, v) for t, v in PATTERN_RULES
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.site_line_dedup(table(spark, sf_dir, "pages"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.selectExpr(
        "doc_id", "_size AS size", "_source_size AS source_size", "_target AS target", "_taken AS taken"
    )


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
