"""Operator 10: exact token counts by prefix dynamic programming.

``token_counts`` adds to any table with a text column:

- ``n_bytes long``: UTF-8 bytes, ``n_tokens long``: tokens as the sentencepiece library
  counts them, without begin and end ids;
- ``cut_chars long``: characters of the longest prefix with at most ``budget`` tokens;
- with ``keep_prefixes``, ``prefix_tokens array<int>``: entry i is the exact token count of the
  first i characters. ``tokens_of`` and ``chars_within`` answer from it in the JVM.

All of them are read from the prefix counts that the dynamic programme gives, so no text is
encoded as a whole. A null text counts as empty: 0, 0, 0 and [0]. Repeated rows and other columns stay; columns of these
names are replaced; an empty table stays empty. Texts are taken whole at any length. The
tables of a task are emptied beyond a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import lean, tidied
from .pieces import PrefixTable
from .spm_codec import text_groups

ADDED = ("n_bytes", "n_tokens", "cut_chars")
PREFIXES = "prefix_tokens"


def token_counts(docs: DataFrame, model_path: str, budget: int = 4096, text: str = "text", keep_prefixes: bool = False) -> DataFrame:
    lean(docs)
    added = [T.StructField(c, T.LongType(), False) for c in ADDED]
    if keep_prefixes:
        added.append(T.StructField(PREFIXES, T.ArrayType(T.IntegerType(), False), False))
    names = [f.name for f in added]
    rest = [c for c in docs.columns if c not in names]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in rest] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PrefixTable(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            for first, end in text_groups(texts):
                part, group = batch.slice(first, end - first), texts[first:end]
                counts = table.at_chars(group)
                found = np.array([(len(t.encode()), c[-1], _within(c, budget)) for t, c in zip(group, counts, strict=True)], np.int64).T
                arrays = [*(part.column(k) for k in range(len(rest))), *map(pa.array, found)]
                if keep_prefixes:
                    offsets = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(counts), pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *names])

    return source.mapInArrow(tidied(run), schema)


def _within(counts: np.ndarray, budget: int) -> int:
    """The last prefix with at most ``budget`` tokens; a longer prefix can have fewer tokens than a shorter one."""
    if counts[-1] <= budget:
        return len(counts) - 1
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def tokens_of(chars: Column | int) -> Column:
    """Tokens of the first characters of a text whose prefix counts are kept; null past its end."""
    return F.get(F.col(PREFIXES), chars)


def chars_within(budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the kept prefix counts."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    turned = F.reverse(F.transform(PREFIXES, lambda n: n <= budget))
    return F.greatest(F.size(PREFIXES) - F.array_position(turned, True), F.lit(0))
