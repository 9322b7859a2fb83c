"""Registered queries: each operator over its whole table, as its contract asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import (
    bpe, collisions, decontaminate, filter_audit, jaccard, language, licenses, lines, neighbours, prefix_trie, quality, suffixes, toxicity,
)
from factloom.llm.tables import crc_mod, table
from workloads.registry import Registry

query = Registry()


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"), ids=False)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = crc_mod("doc_id", 3)
    model = toxicity.fit_toxicity(docs, table(spark, sf, "labels"), part != 1)
    return toxicity.score_toxicity(docs, model, part == 1)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = crc_mod("doc_id", 5)
    model = quality.fit_quality(docs, table(spark, sf, "labels"), part != 0)
    return quality.score_quality(docs, model, part == 0)


@query("op10_language")
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = crc_mod("doc_id", 4)
    return language.predict_language(docs, language.fit_language_model(docs, part != 2), part == 2)


@query("op2_license_scan", licenses.scan_sql())
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_decisions(table(spark, sf, "documents"))


@query("op9_nearest_vectors")
def op9_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf, "documents"))


@query("op11_filter_audit", filter_audit.audit_sql())
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_prefix_trie", prefix_trie.trie_sql())
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf, "conversations")).drop("node")


@query("op13_near_vectors")
def op13_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf, "embeddings"))
