"""Queries of the text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.llm.leaks import leaked_items
from cairnworks.llm.lookalikes import same_looking_classes, same_looking_pairs
from cairnworks.llm.main_text import main_lines
from cairnworks.llm.mixing import reached_shares, training_order
from cairnworks.llm.near_dups import near_duplicate_classes, near_duplicate_pairs
from cairnworks.llm.oracles import SQL
from cairnworks.llm.pii import masked_fields, personal_mentions
from cairnworks.llm.reading import reading_levels
from cairnworks.llm.residue import residue_fields
from cairnworks.runtime import table

__all__ = ["QUERIES", "SQL"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_fields(table(spark, sf_dir, "offers"), "url", "title", "raw_text", "source").withColumnRenamed("key", "url")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(_described(spark, sf_dir), "url", F.concat_ws(" ", "title", "description"), n=3, threshold=0.5)
    return pairs.select(F.col("key_a").alias("url_a"), F.col("key_b").alias("url_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of p4_found with one row per offer: its class of equal texts, the group its links lead to, and their number."""
    return near_duplicate_classes(_described(spark, sf_dir), "url", F.concat_ws(" ", "title", "description"), n=3, threshold=0.5).withColumnRenamed("key", "url")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "offers").filter("description IS NOT NULL AND description <> ''")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_lines(table(spark, sf_dir, "offers"), "url", "title", "raw_text", "source").select(F.col("key").alias("url"), "line_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(table(spark, sf_dir, "offers"), "url", ["title", "description"]).select(
        F.col("key_a").alias("url_a"), F.col("key_b").alias("url_b"), "field_name"
    )


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of p6_found with one row per offer and field, and no pairs."""
    return same_looking_classes(table(spark, sf_dir, "offers"), "url", ["title", "description"]).withColumnRenamed("key", "url")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_mentions(table(spark, sf_dir, "offers"), "url", ["description", "raw_text"]).withColumnRenamed("key", "url")


def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_fields(table(spark, sf_dir, "offers"), "url", ["description", "raw_text"]).withColumnRenamed("key", "url")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("edits = 0").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents it leaks into, unchanged and edited."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), budget=2)
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("edits") == 0).alias("unchanged"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_classes, p5_found, p6_found, p6_classes, p7_found, p7_masked, p8_found, p8_leaks, p9_mix, p9_shares, p10_found)}
