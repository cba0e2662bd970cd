"""Queries p8 to p10 over the test tables. Each runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread_table, table
from . import bpe, langid, leaks


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(spread_table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread_table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and the largest share one holds."""
    found = leaks.leaks(spread_table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's segments in order, each with its language and confidence."""
    found = langid.segments(spread_table(spark, d, "documents"), table(spark, d, "lang_samples"))
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.segment", "s.lang", "s.confidence", "s.sentences")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's languages with their proportions, as the mixture gives them."""
    found = langid.segments(spread_table(spark, d, "documents"), table(spark, d, "lang_samples"))
    return found.select("doc_id", F.explode("languages").alias("l")).select("doc_id", "l.lang", "l.share")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(langid.segments(spread_table(spark, d, "documents"), table(spark, d, "lang_samples")))


QUERIES = {f.__name__: f for f in (p8_ids, p9_found, p9_items, p10_found, p10_segments, p10_languages)}
SQL: dict[str, str] = {}
