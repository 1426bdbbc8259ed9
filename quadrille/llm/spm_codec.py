"""Operator 8: SentencePiece encoding and decoding by a distinct-chunk table.

``encode_decode`` adds ``ids array<int>`` and ``decoded string`` to any table that has a
text column: exactly what the library gives for encode(text) without begin and end ids
and for decode(ids). A null or empty text gives no ids and an empty text. Other columns,
repeated rows and their order within a partition stay; an empty table stays empty; columns
named ``ids`` or ``decoded`` are replaced. Texts of any length are taken whole.

Each task keeps a table of distinct chunks, segments each once, and joins the ids back by
position with an index gather, so no word is shuffled. The table is emptied beyond a
fixed size, which bounds memory at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import lean, tidied
from .pieces import ChunkTable

#: Characters of text that one output batch holds, unless one document is longer.
BATCH_CHARS = 2_000_000


def text_groups(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    lean(docs)
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            for i, j in text_groups(texts):
                ids, decoded = table.encode(texts[i:j])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                part = batch.slice(i, j - i)
                arrays = [part.column(k) for k in range(len(rest))]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "ids", "decoded"])

    return source.mapInArrow(tidied(run), schema)
