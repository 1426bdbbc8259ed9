"""Operator 2: toxicity by a weighted lexicon.

Texts are lower-cased, homoglyphs and digit substitutions are folded one character for one,
and an Aho-Corasick automaton finds lexicon entries (words, and stems that a word starts
with) and exception phrases. A hit counts if it starts at the start of a word, if a whole
word ends where it ends, and if no exception phrase covers it. The hits' weights, as they
are and per length of the text, give a calibrated score from 0 to 1.

``fit`` learns entries and weights from at most ``SAMPLE`` labelled texts a class, beside
the fixed entries. It counts an entry by distinct preceding words, so that copies of one
text count once.

Null and empty texts get the score of a text without hits; texts of any length are taken
whole; repeated rows get equal scores; without labels the fixed entries and default
coefficients remain; an empty table stays empty; columns that clash with an added one are
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import labelled_sample, with_text_columns

#: Labelled rows of each class, at most, from which entries and weights are learned.
SAMPLE = 1500
# Entries known before any label is seen, all of the same weight.
WORDS = ("idiot", "idiots", "moron", "morons", "scum", "trash", "loser", "losers", "clown", "clowns", "worthless", "pathetic", "disgusting", "stupid")
WEIGHT = 4.0
# Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "clown shoes", "circus clown", "trash can", "trash bin", "trash bag", "idiot proof", "stupid question", "stupid simple")
# Look-alikes and substitutions, folded one to one.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ı": "i", "ℓ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W\d_]+")
STEM_LENGTHS = (4, 5, 6)


def fold(text: str) -> tuple[str, str]:
    """The lower-cased text, and the same with look-alikes folded, character for character."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low, low.translate(_FOLD)


@dataclass
class Lexicon:
    """Entries as (text, is it a stem) -> weight; coefficients of the score."""

    entries: dict[tuple[str, bool], float] = field(default_factory=lambda: {(w, False): WEIGHT for w in WORDS})
    coefficients: tuple[float, float, float] = (-4.0, 4.0, 1.0)
    exceptions: Sequence[str] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        by: dict[str, list] = defaultdict(list)
        for (w, stem), weight in self.entries.items():
            by[w].append((len(w), stem, weight))
        for p in self.exceptions:
            by[p].append((len(p), None, 0.0))
        for w, found in by.items():
            a.add_word(w, tuple(found))
        if by:
            a.make_automaton()
        return a


def hits(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the hits that count, in characters of the folded text."""
    low, folded = fold(text)
    found, safe = {}, []
    for last, entries in automaton.iter(folded) if len(automaton) else ():
        for n, stem, weight in entries:
            start = last + 1 - n
            if start and low[start - 1].isalpha():
                continue
            if not stem and last + 1 < len(low) and low[last + 1].isalpha():
                continue
            if stem is None:
                safe.append((start, last + 1))
            elif start not in found or found[start][1] < weight:
                found[start] = (last + 1, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in safe)]


def inputs(total: float, words: int) -> tuple[float, float]:
    """What the score rests on: the hits' weight, as it is and by length."""
    return math.log1p(total), math.log1p(100 * total / (words + 100))


def _learn(texts: list[str], label: np.ndarray) -> Lexicon:
    toxic, clean = int(label.sum()), int(len(label) - label.sum())
    model = Lexicon()
    if toxic and clean:
        without: Counter = Counter()
        having: dict[tuple[str, bool], set] = defaultdict(set)
        docs: Counter = Counter()
        for t, y in zip(texts, label, strict=True):
            ws = _WORD.findall(fold(t)[1])
            own: set = set()
            before = ""
            for w in ws:
                if 4 <= len(w) <= 32 and w not in WORDS:
                    fs = [(w, False), *((w[:n], True) for n in STEM_LENGTHS if len(w) >= n)]
                    own.update(fs)
                    if y:
                        for f in fs:
                            having[f].add(before)
                before = w
            (docs if y else without).update(own)
        # By chance alone, an entry's contexts would all be toxic with this probability a context.
        chance = math.log((toxic + clean) / toxic)
        taken: set[str] = set()
        for f in sorted((f for f, c in having.items() if len(c) * chance >= 18 and docs[f] >= 5), key=lambda f: (not f[1], len(f[0]), f)):
            if without[f] / clean > 0.01 * docs[f] / toxic or any(f[0][:n] in taken for n in STEM_LENGTHS if n <= len(f[0]) - f[1]):
                continue
            if f[1]:
                taken.add(f[0])
            model.entries[f] = min(6.0, max(2.0, math.log((docs[f] + 0.5) / (toxic + 1)) - math.log((without[f] + 0.5) / (clean + 1))))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    c = np.array([-4.0, 2.0, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * np.r_[0.0, c[1:]]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, g)
        c -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return tuple(map(float, c))


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    """Learn from at most ``most`` allowed rows of each class, in one task."""
    sample = labelled_sample(docs, labels, label, allowed, most, doc_id, text)
    schema = "entry string, stem boolean, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        ys: list[int] = []
        for b in batches:
            texts += b["text"].fillna("").tolist()
            ys += b["label"].tolist()
        label = np.array(ys, np.int64)
        model = _learn(texts, label)
        rows = [(w, stem, weight) for (w, stem), weight in model.entries.items()]
        if label.any() and not label.all():
            a = model.automaton()
            x = np.array([inputs(sum(h[2] for h in hits(t, a)), t.count(" ") + 1) for t in texts])
            # Entries seen with one class only leave the two apart; some pull keeps the score finite.
            rows += [(None, None, c) for c in _calibrate(x, label.astype(float), np.ones(len(label)))]
        yield pd.DataFrame(rows, columns=["entry", "stem", "weight"])

    found = sample.select("text", "label").repartition(1).mapInPandas(run, schema).collect()
    model = Lexicon()
    coefficients = [r["weight"] for r in found if r["entry"] is None]
    model.entries |= {(r["entry"], r["stem"]): r["weight"] for r in found if r["entry"] is not None}
    if len(coefficients) == 3 and coefficients[1] > 0:
        model.coefficients = tuple(coefficients)
    return model


def score(docs: DataFrame, model: Lexicon, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Adds toxic_score double and toxic_hits array<string>, the folded words that count."""
    added = [T.StructField("toxic_score", T.DoubleType(), False), T.StructField("toxic_hits", T.ArrayType(T.StringType(), False), False)]
    c0, c1, c2 = model.coefficients

    def make():
        automaton = model.automaton()

        def kernel(column: pa.Array):
            scores, words = np.empty(len(column)), []
            for i, value in enumerate(column):
                t = value.as_py() or ""
                found = hits(t, automaton)
                if found:
                    folded = fold(t)[1]
                    words.append([folded[s:e] for s, e, _ in found])
                else:
                    words.append([])
                x1, x2 = inputs(sum(h[2] for h in found), t.count(" ") + 1)
                scores[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * x1 + c2 * x2))))
            return pa.array(scores), pa.array(words, pa.list_(pa.string()))

        return kernel

    return with_text_columns(docs, text, keep, added, make)
