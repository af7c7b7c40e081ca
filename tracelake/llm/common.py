"""Helpers that the training-data operators share.

Python stages are ``mapInArrow`` over the columns that a stage needs, and nothing else: extra
columns of an input, whatever their names, never reach Python.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


#: Rows of a batch that a Python worker turns into Python objects at a time.
SLICE_ROWS = 1000


def slices(batches, rows: int | None = SLICE_ROWS):
    """Batches in slices of so many rows, or whole; then gives unused memory back, as workers outlive their stage."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
            yield batch.slice(k, rows or batch.num_rows)
    pa.default_memory_pool().release_unused()


_held: dict = {}


def hold(key: tuple, build: Callable):
    """What a worker keeps from task to task: one object, the last stage's."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def map_arrow(df: DataFrame, columns: dict[str, Column], schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict]], rows: int | None = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over the named columns. ``fn`` gets a batch of ``rows`` rows at most and yields dicts of output lists by column."""
    small = df.select(*[c.alias(k) for k, c in columns.items()])
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in _fields(schema)])

    def run(batches):
        for batch in slices(batches, rows):
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return small.mapInArrow(run, schema)


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay: letters that are more than one there stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


#: Characters of text that a task holds as arrays or lists at a time (one longer text goes alone).
CHUNK_CHARS = 2_000_000


def portions(texts: list[str]):
    """Begin and end of texts in a row that have about CHUNK_CHARS characters together."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset (as in
    tests on one machine) a folder under the warehouse is used and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which ends the lineage there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
