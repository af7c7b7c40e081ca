"""Rows that operators must stand: nulls, empty, long, tied and repeated texts, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, hash string, n_words string, __t string"


def awkward(spark, texts):
    rows = [(k, t, None if k % 3 else "en", "s", len(t or ""), 0.0, "h", "w", "x") for k, t in enumerate(texts)]
    rows += [(None, "null id here", None, None, None, None, None, None, None), rows[-1]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir, n=10_000):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("hash", F.lit("clash"))


def rows(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
