"""Operator 4: quality by regularised quadratic discriminant analysis.

Each text gives document statistics, transformed to be closer to normal. Per class the
covariance is shrunk towards the pooled one and that towards a multiple of the identity;
inverses of the Cholesky factors and log determinants are cached in the model. The score
is a calibrated logistic function of the difference of Mahalanobis log densities.

``fit`` takes at most ``SAMPLE`` labelled rows of each class; only their statistics come
to the driver. Null and empty texts get the score of all-zero statistics; texts are taken
whole at any length; equal texts get equal scores; an empty table stays empty; a clashing
column is replaced. With one class only, the score is that class's share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import text as W
from .columns import labelled_sample, with_text_columns

#: Labelled rows of each class, at most, from which the model is fitted.
SAMPLE = 6000
SHRINK_TO_POOLED, SHRINK_TO_SPHERE = 0.2, 0.05
_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "pipe", "symbol", "dash", "beyond")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
for _kind, _chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".?;:", "comma": b",", "bang": b"!", "pipe": b"|", "dash": b"-'\"()", "beyond": range(128, 256)}.items():
    _KIND[list(_chars)] = _KINDS.index(_kind)
FEATURES = (*_KINDS, "words", "word_length", "word_spread", "distinct", "top_word", "adjacent", "triples", "symbol_ends", "capital_starts", "lines", "line_repeats")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for s in W.slices(column):
        rows, lens = len(s.offsets) - 1, np.diff(s.offsets)
        own = out[s.first : s.first + rows]
        kinds = _KIND[s.data]
        row = np.repeat(np.arange(rows), lens)
        own[:, : len(_KINDS)] = np.log((np.bincount(row * 16 + kinds, minlength=rows * 16).reshape(rows, 16)[:, : len(_KINDS)] + 0.5) / (lens[:, None] + 16.0))
        own[lens == 0, : len(_KINDS)] = 0
        w = W.words(s)
        n = np.diff(w.bounds)
        at = np.repeat(np.arange(rows), n)
        some = np.maximum(n, 1)
        size = (w.ends - w.starts).astype(float)
        mean = np.bincount(at, size, rows) / some
        var = np.bincount(at, size * size, rows) / some - mean * mean
        same = np.zeros(len(at), bool)
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (at[1:] == at[:-1])
        key, first = W.mix(w.hashes + at.astype(W.U64) * W.U64(0x632BE59BD9B4E019)), None
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        distinct = np.bincount(at[first], minlength=rows)
        top = np.zeros(rows)
        np.maximum.at(top, at[first], counts)
        inside = at[2:] == at[:-2]
        three = (W.mix(key[:-2]) + W.mix(key[1:-1] + W.U64(1)) + W.mix(key[2:] + W.U64(2)))[inside]
        _, first3 = np.unique(three, return_index=True)
        triples = np.bincount(at[2:][inside][first3], minlength=rows)
        all3 = np.maximum(np.bincount(at[2:][inside], minlength=rows), 1)
        odd = np.isin(kinds[w.ends - 1], [_KINDS.index("symbol"), _KINDS.index("bang"), _KINDS.index("pipe")])
        capital = kinds[w.starts] == _KINDS.index("upper")
        breaks = np.flatnonzero(kinds == _KINDS.index("newline"))
        starts = np.union1d(breaks + 1, s.offsets[:-1][lens > 0])
        starts = starts[starts < len(s.data)]
        ends = np.append(starts[1:], len(s.data))
        line_row = np.searchsorted(s.offsets, starts, "right") - 1
        line = W.spans_hash(s.data, starts, ends) + W.mix(line_row.astype(W.U64))
        _, first_line = np.unique(line, return_index=True)
        lines = np.bincount(line_row, minlength=rows)
        once = np.bincount(line_row[first_line], minlength=rows)
        own[:, len(_KINDS) :] = np.column_stack(
            [
                np.log1p(n),
                np.log1p(mean),
                np.log1p(np.sqrt(np.maximum(var, 0))),
                np.log((distinct + 1) / (n + 1.0)),
                np.log((top + 1) / (n + 2.0)),
                np.log((np.bincount(at, same, rows) + 0.5) / (n + 8.0)),
                np.log((triples + 1) / (all3 + 1.0)),
                np.log((np.bincount(at, odd, rows) + 0.5) / (n + 8.0)),
                np.log((np.bincount(at, capital, rows) + 0.5) / (n + 8.0)),
                np.log1p(lines),
                np.log((lines - once + 0.5) / (lines + 4.0)),
            ]
        )
        own[n == 0] = 0
    return out


@dataclass
class Discriminant:
    """Standardisation, and per class the mean, inverse Cholesky factor and constant."""

    center: np.ndarray
    spread: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    slope: tuple[float, float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.center) / self.spread, -8, 8)
        logs = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) + const for m, inv, const in self.classes]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.slope[0])
        d = self.difference(x)
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + self.slope[1] * np.sign(d) * np.log1p(np.abs(d)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Discriminant:
    p = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Discriminant(np.zeros(p), np.ones(p), [], (float(y.mean()) if len(y) else 0.5, 0.0))
    center, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - center) / spread, -8, 8)
    means = [z[y == k].mean(0) for k in (0, 1)]
    own = [np.cov(z[y == k].T, bias=True).reshape(p, p) for k in (0, 1)]
    pooled = sum(np.mean(y == k) * own[k] for k in (0, 1))
    pooled = (1 - SHRINK_TO_SPHERE) * pooled + SHRINK_TO_SPHERE * np.trace(pooled) / p * np.eye(p)
    classes = []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - SHRINK_TO_POOLED) * own[k] + SHRINK_TO_POOLED * pooled + 1e-6 * np.eye(p))
        classes.append((means[k], np.linalg.inv(factor), float(-np.log(np.diag(factor)).sum() + np.log(np.mean(y == k)))))
    model = Discriminant(center, spread, classes, (0.0, 1.0))
    d = model.difference(x)
    d = np.sign(d) * np.log1p(np.abs(d))
    a, c = np.column_stack([np.ones(len(d)), d]), np.zeros(2)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        c -= np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (q - y) + 1e-3 * c)
    model.slope = (float(c[0]), float(c[1]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Discriminant:
    sample = labelled_sample(docs, labels, label, allowed, most, doc_id, text)
    rows = _with_statistics(sample, ["label"], "text").collect()
    x = np.array([r["statistics"] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r["label"] for r in rows], np.int64))


def _with_statistics(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    def make():
        def kernel(column: pa.Array):
            x = statistics(column)
            return (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())),)

        return kernel

    return with_text_columns(docs, text, keep, [T.StructField("statistics", T.ArrayType(T.DoubleType(), False), False)], make)


def score(docs: DataFrame, model: Discriminant, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Adds quality_score double, from 0 to 1."""

    def make():
        return lambda column: (pa.array(model.score(statistics(column))),)

    return with_text_columns(docs, text, keep, [T.StructField("quality_score", T.DoubleType(), False)], make)
