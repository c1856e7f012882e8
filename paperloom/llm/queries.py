"""Queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm import abuse, groups, increments, language, neighbours, packing, privacy, scans, survivor, tokens
from paperloom.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    images = load(spark, d, "images")
    return survivor.surviving_rows(survivor.unpivoted(images, survivor.pointer_groups(images)))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    images = load(spark, d, "images")
    return survivor.merged_records(survivor.unpivoted(images, survivor.pointer_groups(images)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.protected_values(load(spark, d, "images"), load(spark, d, "metadata"), load(spark, d, "name_parts"))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of protected values."""
    return privacy.sanitised(load(spark, d, "images"), load(spark, d, "metadata"), load(spark, d, "name_parts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.duplicate_uploads(load(spark, d, "images"), load(spark, d, "incoming_uploads"))


def p3_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every upload with its decision."""
    return increments.decided(load(spark, d, "images"), load(spark, d, "incoming_uploads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.image_groups(load(spark, d, "images"), load(spark, d, "image_relationships"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(load(spark, d, "images"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every scan text as continuous paragraphs."""
    return scans.repaired_texts(load(spark, d, "images"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(load(spark, d, "visual_regions"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(load(spark, d, "images"), load(spark, d, "lang_samples"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    images, samples = load(spark, d, "images"), load(spark, d, "lang_samples")
    return language.text_segments(images, language.model_of(images, samples))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(load(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one that exceeds the capacity, in a container of each capacity."""
    items = tokens.lengths(load(spark, d, "documents")).withColumnRenamed("doc_id", "item_id")
    return packing.packed(items, load(spark, d, "pack_capacities"))


def p9_used(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of space used per capacity."""
    return packing.use_of_space(p9_packed(spark, d), load(spark, d, "pack_capacities"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.content_kinds(load(spark, d, "documents"), load(spark, d, "content_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(load(spark, d, "documents"), load(spark, d, "content_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_texts, p3_found, p3_decisions, p4_found, p5_found, p5_texts, p6_found, p7_found, p7_segments, p8_ids, p9_packed, p9_used, p10_found, p10_rates)}
