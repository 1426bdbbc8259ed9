"""Operator 5: repeated passages, found by matching statistics on suffix automata.

A window is ``size`` consecutive words of one document (words are what stands between ASCII
white space, unchanged). Every word that lies in a window whose word sequence also starts
anywhere else, in the same document too, is removed.

One automaton of all other documents would have to be broadcast to each, at a cost that
grows with the square of the corpus. So reference shards are cut by content:

1. Each window is assigned to its anchor, the smallest hash among the runs of ``ANCHOR``
   words in it. A segment is a maximal row of windows with one anchor occurrence. Equal
   windows have equal anchors. Anchors are counted over the whole corpus, segments by
   content (128 bits) too; both counts are combined before the shuffle.
2. A segment whose content occurs twice is repeated as a whole. A segment whose anchor
   occurs once is not repeated anywhere.
3. What is left, segments new in content with a shared anchor, is compared with the
   distinct contents of that anchor: the shard. A suffix automaton is built of the shard's
   contents and the segments are streamed through it: the matching statistics tell where
   ``size`` words or more also stand in another segment.
4. An anchor with more than ``SHARD_WORDS`` words of distinct contents is not brought to one
   task: its windows are counted by 128-bit hash instead, which is combined before the
   shuffle and as exact.

``repeats`` returns the removed spans; ``remove_repeats`` returns the documents without
them. Null texts have no words; repeated rows count as so many documents, so copies remove
each other; an empty table stays empty; documents under ``size`` words stay as they are;
other columns go through, and texts are taken whole at any length. Rows are told apart by
id and text hash, so ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as W
from .columns import lean, tidied

WINDOW, ANCHOR = 35, 8
#: Words of distinct contents of one anchor that one task takes into an automaton.
SHARD_WORDS = 50_000


class SuffixAutomaton:
    """Suffix automaton over sequences of integers, with how many sequences hold each state.

    Sequences are added one after the other, each starting from the root. ``twice`` marks
    states whose strings end at two places or more.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int, ends: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the longest string of p with c appended, parted from longer ones."""
        q = self.next[p][c]
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q], 0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int], weight: int = 1) -> None:
        last = 0
        for c in sequence:
            p = last
            if c in self.next[p]:
                last = self._split(p, c)
            else:
                last = self._state(self.length[p] + 1, {}, 0, 0)
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                self.link[last] = 0 if p < 0 else self._split(p, c)
            self.ends[last] += weight

    def finish(self) -> None:
        """Adds up the places at which each state's strings end."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] += self.ends[s]

    def matching(self, sequence: list[int], size: int) -> np.ndarray:
        """At each place, whether the last ``size`` items also end at another place."""
        out, s, n = np.zeros(len(sequence), bool), 0, 0
        for i, c in enumerate(sequence):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            while s and self.length[self.link[s]] >= size:
                s = self.link[s]
                n = self.length[s]
            out[i] = n >= size and self.ends[s] > 1
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each window of ``width``."""
    n = len(values) - width + 1
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(best) - step), slice(step, None)
        take = best[right] < best[left]
        best, at = np.where(take, best[right], best[left]), np.where(take, at[right], at[left])
        have += step
    return at[:n]


SEGMENT = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("windows", T.IntegerType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("content", T.LongType()),
    ]
)


def _cuts(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of the segments of a document with a window."""
    n = len(hashes) - size + 1
    runs = W.rolling(hashes, ANCHOR, 3)
    at = sliding_min(runs, size - ANCHOR + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, n]), runs[at[first]]


def _contents(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words first .. first + count + size - 2 of each segment."""
    up, down = W._Powers.of(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, W.U64)
    np.cumsum(W.mix(hashes + W.U64(11)) * up[: len(hashes)], out=sums[1:])
    return W.mix((sums[first + count + size - 1] - sums[first]) * down[first] + count.astype(W.U64))


def _segments(keyed: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for s in W.slices(batch.column(2)):
                w = W.words(s)
                parts = []
                for i in range(len(s.offsets) - 1):
                    h = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    if len(h) >= size:
                        first, count, anchor = _cuts(h, size)
                        parts.append((s.first + i, first, count, anchor, _contents(h, first, count, size)))
                if parts:
                    at = pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]))
                    first, count, *hashes = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
                    yield pa.RecordBatch.from_arrays([ids.take(at), marks.take(at), pa.array(first, pa.int32()), pa.array(count, pa.int32()), *(pa.array(x.view(np.int64)) for x in hashes)], schema=_arrow(SEGMENT))

    return keyed.mapInArrow(tidied(run), SEGMENT)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc and text_hash, which tell rows apart, the text, and the other columns in one."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_words", "n_removed")]
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.xxhash64(t).alias("text_hash"), t.alias("text"), F.struct(*rest).alias("row"))


SPAN = "doc long, text_hash long, start int, windows int"


def _same(a: str, b: str):
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def repeats(source: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, text_hash, spans) of a ``keyed`` table: starts and numbers of repeated windows, which can touch or overlap."""
    if size <= ANCHOR:
        raise ValueError(f"a window needs more than {ANCHOR} words")
    segments = _segments(source.select("doc", "text_hash", "text"), size)
    # An anchor has several contents if the smallest and largest content hash differ.
    anchors = segments.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    anchors = anchors.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    # Kept until the session drops it, as the result is lazy: one query shares the shuffles of texts.
    near = segments.join(anchors, "anchor").persist(StorageLevel.MEMORY_AND_DISK)
    place = ["doc", "text_hash", "start", "windows"]
    mixed = near.where("mixed")
    # The anchor is part of the content, so the two hashes together identify it by 128 bits.
    contents = mixed.groupBy("anchor", "content").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in place)).persist(StorageLevel.MEMORY_AND_DISK)
    load = contents.groupBy("anchor").agg(F.sum(F.col("windows") + (size - 1)).alias("words"))
    loaded = contents.join(load, "anchor")
    parts = _with_words(loaded, source, size, False)
    small = parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shard_kernel(size), SPAN)
    windows = _with_words(loaded, source, size, True, _window_kernel(size), SPAN + ", h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    large = windows.join(twice, ["h1", "h2"], "left_semi").select(place)
    whole = near.where("not mixed").select(place).unionAll(mixed.join(contents.where("n > 1"), ["anchor", "content"], "left_semi").select(place))
    return whole.unionAll(small).unionAll(large).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


WORDS_OF_SEGMENT = "anchor long, n long, doc long, text_hash long, start int, windows int, hashes binary"


def _with_words(left: DataFrame, source: DataFrame, size: int, large: bool, then=None, schema: str = WORDS_OF_SEGMENT) -> DataFrame:
    """Brings the segments of small or of large anchors the hashes of their words, 6 bytes each, from the document that holds them.

    ``then`` maps the batches in the same task. The sizes are told apart there, so that both
    calls use one shuffle.
    """
    listed = left.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("anchor", "words", "n", "start", "windows")).alias("segments"))
    both = source.alias("d").join(listed.alias("l"), _same("d", "l")).select("d.doc", "d.text_hash", "d.text", "l.segments", "d.row")
    names = ["anchor", "n", "doc", "text_hash", "start", "windows", "hashes"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, lists = batch.column(0), batch.column(1), batch.column(3)
            for s in W.slices(batch.column(2)):
                w = W.words(s)
                rows = []
                for i in range(len(s.offsets) - 1):
                    h = np.ascontiguousarray(w.hashes[w.bounds[i] : w.bounds[i + 1], None].view(np.uint8)[:, :6])
                    doc, mark = ids[s.first + i].as_py(), marks[s.first + i].as_py()
                    for x in lists[s.first + i].as_py():
                        if (x["words"] > SHARD_WORDS) == large:
                            rows.append((x["anchor"], x["n"], doc, mark, x["start"], x["windows"], h[x["start"] : x["start"] + x["windows"] + size - 1].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.mapInArrow(tidied((lambda batches: then(run(batches))) if then else run), schema)


def _hashes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(W.U64).ravel()


def _runs(doc: int | None, mark: int, start: int, hit: np.ndarray) -> list[tuple]:
    """Spans of the windows that hit."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(doc, mark, start + int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "text_hash", "start", "windows"])


def _shard_kernel(size: int):
    def shard(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []  # equal windows of one segment would have different anchors
        sequences = [_hashes(r[6]).tolist() for r in rows]
        automaton = SuffixAutomaton()
        for q in sequences:
            automaton.add(q)
        automaton.finish()
        out = []
        for r, q in zip(rows, sequences, strict=True):
            if r[1] == 1:  # segments that occur again are removed as a whole already
                out += _runs(r[2], r[3], r[4], automaton.matching(q, size)[size - 1 :])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    out += shard(rows)
                    rows = []
                rows.append(r)
            if len(out) > 10_000:
                yield _spans(out)
                out = []
        out += shard(rows)
        yield _spans(out)

    return run


def _window_kernel(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc, mark, start, blob in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 6)), strict=True):
                h = _hashes(blob)
                h1, h2 = W.rolling(h, size, 11), W.rolling(h, size, 29)
                columns[0] += [doc] * len(h1)
                columns[1] += [mark] * len(h1)
                columns[2].append(start + np.arange(len(h1), dtype=np.int32))
                columns[3].append(h1.view(np.int64))
                columns[4].append(h2.view(np.int64))
            if columns[2]:
                start, h1, h2 = (np.concatenate(c) for c in columns[2:])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(start), pa.array(np.ones(len(start), np.int32)), pa.array(h1), pa.array(h2)], names=["doc", "text_hash", "start", "windows", "h1", "h2"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents with their kept words joined by one space, n_words and n_removed.

    Texts that lose nothing are joined by one space as well; columns of the added names are
    replaced.
    """
    source = keyed(docs, doc_id, text)
    lean(docs)
    listed = repeats(source, size)
    rest = [c for c in docs.columns if c not in (text, "n_words", "n_removed")]
    out = source.alias("d").join(listed.alias("l"), _same("d", "l"), "left").select(*(F.col(f"d.row.`{c}`") for c in rest), F.col("d.text").alias("__text"), F.col("l.spans").alias("__spans"))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            spans = batch.column(len(rest) + 1)
            for i, value in enumerate(batch.column(len(rest))):
                words = value.as_py().encode().split()
                kept, cuts = words, spans[i].as_py()
                if cuts:
                    step = np.zeros(len(words) + 1, np.int32)
                    start = np.array([x["start"] for x in cuts])
                    np.add.at(step, start, 1)
                    np.add.at(step, start + [x["windows"] + size - 1 for x in cuts], -1)
                    keep = np.cumsum(step[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                texts.append(b" ".join(kept).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*rest, text, "n_words", "n_removed"])

    return out.mapInArrow(tidied(run), schema)


def brute_force(texts: list[str | None], size: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) by comparing all windows; for tests."""
    docs = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for ws in docs:
        for i in range(len(ws) - size + 1):
            seen[tuple(ws[i : i + size])] = seen.get(tuple(ws[i : i + size]), 0) + 1
    out = []
    for ws in docs:
        gone = set()
        for i in range(len(ws) - size + 1):
            if seen[tuple(ws[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
