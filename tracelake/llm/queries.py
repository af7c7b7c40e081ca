"""The training-data queries: one ``opN_`` query an operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, decontaminate, filter_audit, html, license_set, licenses, ngram, paragraphs, pii, quality, secrets, simhash, toxicity, vector_codes
from tracelake.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op4_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram.score(docs, ngram.train(docs))


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.measure(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), license_set.templates())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_html, op4_ngram, op5_paragraphs, op6_toxicity, op7_quality, op8_simhash, op9_licenses, op10_bpe, op11_filter_audit, op12_vector_codes, op13_secrets)}
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": filter_audit.AUDIT_SQL, "op12_vector_codes": vector_codes.CODES_SQL}
