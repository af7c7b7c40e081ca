"""Runs as they arrive: a ledger that follows a folder of evidence and takes each run once.

Run documents are read as a stream of files. A batch goes to a folder of its own by its number, so a batch that is
repeated after a failure replaces what it had written; runs that other batches hold are left out. What a stream has
read is in its checkpoint; the ledger alone would do as well, as a run in it is never taken again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tracelake.sources.evidence import META

_ENTRY = f"{META}, dir string"


def arriving(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of run documents under ``root``, a row a readable document, with its folder ``dir``."""
    found = spark.readStream.schema(META).option("multiLine", True).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(f"{root}/*/meta.json")
    return found.where("run_id <> ''").withColumn("dir", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The runs taken so far: the columns of a document, ``dir`` and the number of the batch."""
    schema = StructType.fromDDL(f"{_ENTRY}, batch bigint")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def take(batch: DataFrame, number: int, path: str) -> None:
    """Adds the runs of a batch that no other batch has. Of several documents of one run the first by folder is taken."""
    spark = batch.sparkSession
    before = ledger(spark, path).where(F.col("batch") != number).select("run_id")
    rest = [c for c in batch.columns if c not in ("run_id", "dir")]
    first = batch.groupBy("run_id").agg(F.min_by(F.struct(*rest), "dir").alias("x"), F.min("dir").alias("dir")).select("run_id", "x.*", "dir")
    first.join(before, "run_id", "left_anti").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def follow(spark: SparkSession, root: str, path: str, checkpoint: str, files_a_batch: int = 1000) -> DataStreamWriter:
    """The stream that keeps the ledger at ``path``, to be started with the caller's trigger."""
    return arriving(spark, root, files_a_batch).writeStream.foreachBatch(lambda batch, number: take(batch, number, path)).option("checkpointLocation", checkpoint)
