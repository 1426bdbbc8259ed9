"""Adds computed columns to a table by a kernel over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Kernel = Callable[[pa.Array], Sequence[pa.Array]]


def with_text_columns(docs: DataFrame, text: str, keep: Sequence[str] | None, added: Sequence[T.StructField], make: Callable[[], Kernel]) -> DataFrame:
    """``keep`` (all if None) and the columns that the kernel makes of the texts.

    ``make`` builds the kernel once per task. A kept column that bears the name of an added
    one is replaced. Other columns go through as they are.
    """
    lean(docs)
    names = [f.name for f in added]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in rest), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = kernel(batch.column(len(rest)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *made], names=[*rest, *names])

    return source.mapInArrow(tidied(run), schema)


def lean(df: DataFrame) -> None:
    """Keeps the session's Arrow batches small, as tasks hold several copies of one; never raises what is set lower."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 1 << 24)):
        now = str(conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def tidied(run: Callable) -> Callable:
    """A mapping of batches that gives its worker's free memory back in the end; idle workers would keep it."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return mapped


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and 0/1 labels of at most ``most`` labelled rows of each class, in hash order.

    Rows with a null id or a label other than 0 and 1 are not taken. The chosen ids are at
    most 2 * most, which bounds what is broadcast.
    """
    rows = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("label")).where(F.col("__id").isNotNull())
    rows = rows.groupBy("__id").agg(F.max("label").alias("label")).withColumnRenamed("__id", doc_id).where(allowed)
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64(doc_id), doc_id).limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    return docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), doc_id)
