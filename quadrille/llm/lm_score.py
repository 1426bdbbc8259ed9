"""Operator 1: masked pseudo-likelihood by a bidirectional window network trained in numpy.

Tokens are words (between ASCII white space, A-Z lowered). The ``KNOWN`` most frequent words
of the whole corpus have numbers of their own; other words share ``HASHED`` numbers by hash.
The network sees the two tokens before and the two after a masked one, each embedded and
weighted by place, and gives the masked token's probability in two steps: its group, then
the token in the group. A third step gives a word its share of the number it has in common
with others, c / (C + 1) by the corpus counts c of the word and C of the number; the 1 is
for words that the corpus does not hold. So each distinct word has a probability of its own,
however many there are, and all add up to one. A document's score is the sum of all its
tokens' conditional log-probabilities, and the mean of that.

Training runs where the text is: each partition trains from the same start on every token of
each of its documents, in one pass, and the parameters are averaged by token counts in a tree
of tasks of ``FAN`` each. So what is counted, trained on and gathered grows
with the corpus, while the driver only ever holds the known words and one set of parameters,
both of fixed size. The counts of the other words stay a table, which the rare words of the
documents are joined with; texts are known there by a 64-bit hash.

Null and empty texts have no tokens, log-probability 0 and a null mean; repeated rows score
alike; an empty corpus leaves the untrained network; other columns go through, and those
of the added names are replaced; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as W
from .columns import tidied, with_text_columns
from .components import checkpointed

GROUPS, IN_GROUP, HASHED, DIM = 64, 64, 64, 16
TOKENS = GROUPS * IN_GROUP
KNOWN = TOKENS - HASHED
PAD = TOKENS
PLACES = (-2, -1, 1, 2)
BATCH, RATE, FAN = 4096, 0.08, 16


@dataclass
class Vocabulary:
    """Hashes of the known words in ascending order, their numbers, all tokens' counts, and (hash, count) of every word."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    table: DataFrame | None

    def __getstate__(self) -> dict:
        """Tasks get all but the table."""
        return {**self.__dict__, "table": None}

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        rest = KNOWN + (hashes % W.U64(HASHED)).astype(np.int64)
        if not len(self.hashes):
            return rest
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], rest)


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, count) of every word of the corpus, combined within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        for batch in batches:
            for s in W.slices(batch.column(0)):
                kept.append(np.unique(W.words(s, lower=True).hashes, return_counts=True))
                size += len(kept[-1][0])
                if size > 2_000_000:
                    kept = [merged()]
                    size = 0
        if kept:
            u, c = merged()
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], names=["hash", "count"])

    return texts.mapInArrow(tidied(run), "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The most frequent words; the counts of the others are added up by shared number."""
    counts = checkpointed(count_words(texts))
    top = counts.orderBy(F.desc("count"), "hash").limit(KNOWN).collect()
    h = np.array([r["hash"] for r in top], np.int64).view(W.U64)
    c = np.zeros(TOKENS)
    c[: len(top)] = [r["count"] for r in top]
    for r in counts.groupBy(F.col("hash").bitwiseAND(HASHED - 1).alias("rest")).agg(F.sum("count").alias("count")).collect():
        c[KNOWN + r["rest"]] = r["count"]
    np.subtract.at(c, KNOWN + (h % W.U64(HASHED)).astype(np.int64), c[: len(top)])
    order = np.argsort(h)
    return Vocabulary(h[order], order, c, counts)


def rare_words(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """(key, hash) of each place of a text (key, text) with a word that has no number of its own; few of them stand twice in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for s in W.slices(batch.column(1)):
                w = W.words(s, lower=True)
                rare = np.flatnonzero(words.tokens(w.hashes) >= KNOWN)
                row = np.searchsorted(w.bounds, rare, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[s.first + row]), pa.array(w.hashes[rare].view(np.int64))], names=["key", "hash"])

    return texts.mapInArrow(tidied(run), "key long, hash long")


def rare_logs(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """(key, rare): the mean log count of the rare words of each text (key, text); copies share a key and a mean."""
    found = rare_words(texts, words).join(words.table, "hash", "left")
    log = F.log(F.coalesce(F.col("count"), F.lit(1)).cast("double"))
    return found.groupBy("key").agg(F.avg(log).alias("rare"))


class Network:
    """Parameters as views of one vector, so that they are averaged and sent as one."""

    SHAPES = {"embed": (TOKENS + 1, DIM), "place": (len(PLACES), DIM), "group": (DIM, GROUPS), "group_bias": (GROUPS,), "word": (GROUPS, DIM, IN_GROUP), "word_bias": (GROUPS, IN_GROUP)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights, and biases that give each token its share of the corpus."""
        rng = np.random.default_rng(5)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        net.embed[:TOKENS] = rng.normal(0, 0.1, (TOKENS, DIM))
        net.place[:] = 1.0
        net.group[:] = rng.normal(0, 0.1, net.group.shape)
        net.word[:] = rng.normal(0, 0.1, net.word.shape)
        c = counts.reshape(GROUPS, IN_GROUP) + 0.1
        net.group_bias[:] = np.log(c.sum(1) / c.sum())
        net.word_bias[:] = np.log(c / c.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embed[context[:, 0]] * self.place[0]
        for k in range(1, len(PLACES)):
            h += self.embed[context[:, k]] * self.place[k]
        return np.tanh(h, out=h)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(target // IN_GROUP, kind="stable")
        target = target[order]
        h = self.hidden(context[order])
        group, at = target // IN_GROUP, np.arange(len(h))
        logits = h @ self.group + self.group_bias
        found = logits[at, group]
        found -= _log_sum(logits)
        logits = self.word_bias[group]
        first = 0
        for g, end in enumerate(np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()):
            if end > first:
                logits[first:end] += h[first:end] @ self.word[g]
            first = end
        found += logits[at, target % IN_GROUP]
        found -= _log_sum(logits)
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, seen: np.ndarray) -> None:
        """One AdaGrad step on a batch; seen: sums of squared gradients, as the parameters."""
        n = len(target)
        grad = Network(np.zeros_like(self.flat))
        # By group, so that each group's rows are one slice.
        order = np.argsort(target // IN_GROUP, kind="stable")
        context, target = context[order], target[order]
        h = self.hidden(context)
        group, inner = target // IN_GROUP, target % IN_GROUP
        p = _softmax(h @ self.group + self.group_bias)
        p[np.arange(n), group] -= 1
        grad.group[:], grad.group_bias[:] = h.T @ p, p.sum(0)
        dh = p @ self.group.T
        # Products by group, everything else on all rows at once.
        ends = np.cumsum(np.bincount(group, minlength=GROUPS))
        used = np.flatnonzero(np.diff(ends, prepend=0))
        spans = list(zip(used.tolist(), np.r_[0, ends[used][:-1]].tolist(), ends[used].tolist(), strict=True))
        q = np.empty((n, IN_GROUP), h.dtype)
        for g, first, end in spans:
            np.matmul(h[first:end], self.word[g], out=q[first:end])
        q += self.word_bias[group]
        _softmax(q)
        q[np.arange(n), inner] -= 1
        grad.word_bias[used] = np.add.reduceat(q, [first for _, first, _ in spans], axis=0)
        for g, first, end in spans:
            np.matmul(h[first:end].T, q[first:end], out=grad.word[g])
            dh[first:end] += q[first:end] @ self.word[g].T
        dh *= 1 - h * h
        for k in range(len(PLACES)):
            grad.place[k] = np.einsum("ij,ij->j", dh, self.embed[context[:, k]])
        # Flat, as adding by places is several times faster in one dimension.
        at = context[:, :, None] * DIM + np.arange(DIM)
        np.add.at(grad.embed.reshape(-1), at.reshape(-1), (dh[:, None, :] * self.place).reshape(-1))
        grad.embed[PAD] = 0
        grad.flat /= n
        seen += grad.flat**2
        grad.flat *= rate
        grad.flat /= np.sqrt(seen) + 1e-4
        self.flat -= grad.flat


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; overwrites x."""
    top = x.max(1, keepdims=True)
    x -= top
    return np.log(np.exp(x, out=x).sum(1)) + top[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row; overwrites x."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def contexts(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens around the places ``at``; PAD where a place lies outside the document."""
    row = np.searchsorted(bounds, at, "right") - 1
    low, high = bounds[row], bounds[row + 1]
    out = np.empty((len(at), len(PLACES)), np.int64)
    for k, d in enumerate(PLACES):
        near = at + d
        inside = (near >= low) & (near < high)
        out[:, k] = np.where(inside, tokens[np.where(inside, near, 0)], PAD)
    return out


def train(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    start = Network.start(words.counts).flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, n = Network(start.copy()), np.zeros_like(start), 0
        for batch in batches:
            for s in W.slices(batch.column(0)):
                w = W.words(s, lower=True)
                if not len(w.hashes):
                    continue
                tokens = words.tokens(w.hashes)
                n += len(tokens)
                for i in range(0, len(tokens), BATCH):
                    some = np.arange(i, min(i + BATCH, len(tokens)))
                    net.step(contexts(tokens, w.bounds, some), tokens[some], RATE, seen)
        yield _blob(net.flat * np.float64(n), n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(start)), 0
        for batch in batches:
            for blob, m in zip(batch.column(0), batch.column(1), strict=True):
                total += np.frombuffer(blob.as_buffer(), np.float32).astype(float) * m.as_py()
                n += m.as_py()
        yield _blob(total, n)

    schema = "parameters binary, tokens long"
    sums = texts.mapInArrow(tidied(run), schema)
    parts = max(1, sums.rdd.getNumPartitions())
    while parts > 1:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, schema)
    rows = [r for r in sums.collect() if r["tokens"]]
    return np.frombuffer(rows[0]["parameters"], np.float32).copy() if rows else start


def _blob(total: np.ndarray, n: int) -> pa.RecordBatch:
    """Mean parameters and the number of tokens they stand for."""
    return pa.RecordBatch.from_arrays([pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["parameters", "tokens"])


def score(docs: DataFrame, words: Vocabulary, parameters: np.ndarray, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Adds n_tokens long, log_prob double and mean_log_prob double."""
    names = ("n_tokens", "log_prob", "mean_log_prob")
    added = [T.StructField("n_tokens", T.LongType(), False), T.StructField("log_prob", T.DoubleType(), False), T.StructField("__n_rare", T.LongType(), False)]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in names]
    share = np.zeros(TOKENS)
    share[KNOWN:] = np.log(words.counts[KNOWN:] + 1)

    def make():
        net = Network(parameters)

        def kernel(column: pa.Array):
            n, total, n_rare = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), np.int64)
            for s in W.slices(column):
                w = W.words(s, lower=True)
                tokens, rows = words.tokens(w.hashes), len(w.bounds) - 1
                logs = np.zeros(len(tokens))
                for i in range(0, len(tokens), 8192):
                    some = np.arange(i, min(i + 8192, len(tokens)))
                    logs[some] = net.log_probabilities(contexts(tokens, w.bounds, some), tokens[some])
                row = np.repeat(np.arange(rows), np.diff(w.bounds))
                n[s.first : s.first + rows] = np.diff(w.bounds)
                total[s.first : s.first + rows] = np.bincount(row, logs - share[tokens], rows)
                n_rare[s.first : s.first + rows] = np.bincount(row[tokens >= KNOWN], minlength=rows)
            return pa.array(n), pa.array(total), pa.array(n_rare)

        return kernel

    keyed = docs.withColumn("__key", F.xxhash64(F.col(f"`{text}`").cast("string")))
    out = with_text_columns(keyed, text, [*rest, "__key"], added, make)
    rare = rare_logs(keyed.select(F.col("__key").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), words)
    log_prob = F.col("log_prob") + F.col("__n_rare") * F.coalesce("rare", F.lit(0.0))
    out = out.join(rare, F.col("__key") == F.col("key"), "left").withColumn("log_prob", log_prob)
    return out.select(*(F.col(f"`{c}`") for c in rest), "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def score_corpus(docs: DataFrame, keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Count, train and score on the same documents."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    words = vocabulary(texts)
    return score(docs, words, train(texts, words), keep, text)
