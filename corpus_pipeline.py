"""From raw documents to token ids: toxicity, near-duplicates, decontamination, personal data, BPE.

Every stage takes the whole of what the one before it kept, written as Parquet and read again:

- ``toxicity`` drops documents that score at or above the threshold;
- ``near_duplicates`` keeps the document with the least id of each SimHash component;
- ``decontaminate`` drops documents that hold a window of a benchmark item;
- ``personal_data`` replaces identifiers, plain or disguised, by their kind in brackets;
- ``tokens`` encodes each text and decodes the ids again.

All but the last return the columns of ``documents``. Null texts count as empty and pass every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, pii, simhash, toxicity
from tracelake.llm.common import cut, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("decontaminate", _decontaminate), ("personal_data", _personal_data), ("tokens", _tokens)]

#: The toxicity model is not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
