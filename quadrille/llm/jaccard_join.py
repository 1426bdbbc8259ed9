"""Operator 9: exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``size`` words (A-Z lowered, words between
ASCII white space); with fewer words the whole sequence is its one shingle; without words
the set is empty and links with nothing. Two documents link if 100 * intersection >=
percent * union. The result is each document's set size and component: the smallest id
reachable by links.

1. Equal sets are one class, known by two 64-bit hashes; a clash of the first is noticed by
   the second, and all is hashed anew. Copies give their prefix once a task.
2. Shingles have one global order: those that a count sketch finds frequent come last, by
   their counts. The first p = n - ceil(percent * n) + 1 shingles of a set hold one of any set
   that links with it. A prefix longer by l - 1 must share l.
3. How many classes have a shingle in their prefixes is its estimated candidate cost. A first
   pass counts it. A prefix with c shingles that cost more than ``SMALL`` is lengthened past
   them: it must share c + 1, so one of those that cost less, and they alone are its entries
   in the index, as if the others came later in the order. Only a set that has too few
   cheaper ones keeps crowded entries, and brings a still longer prefix to their blocks: each
   doubling of the cost doubles its length, up to the whole set (l = what a link must share).
   It comes as a parity sketch: a bit flips for each of its shingles, so two sketches differ
   in no more bits than the prefixes do in shingles.
4. Blocks of the same classes are one, and larger blocks within larger ones are left out. Pairs from small blocks, 28 a block at most, must share
   as many base shingles, added up over blocks, as a link needs; pairs within larger blocks must share the l of their longer
   prefixes by their sketches. All comparisons of a larger block run inside a task on
   ``BLOCK`` classes or twice that, and no pair leaves it but the edges of a least spanning
   forest: those that are verified on whole sets merge components.
5. A block with a candidate pair that its forest left out and an edge that is no link, or with
   several pieces, is searched again for pairs between different components, with ``MORE`` times as many
   disjoint forests each time, until none is left out. So links between components are never
   missed, and what leaves the tasks stays in proportion to the postings of such blocks.

Ids identify documents: rows of one id count as linked with each other, those without words
too; rows with a null id take no part and get a null component. Null texts are empty; an empty
table stays empty; other columns are not read, whatever their names; repeated rows and copies
get their rows in the result; texts are taken whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as W
from .columns import lean, tidied
from .components import checkpointed, components, release

SIZE, PERCENT = 4, 85
#: Cells of the count sketch, and the count in one task from which a cell is told of.
CELLS, FREQUENT = 1 << 22, 8
#: Cells that the order keeps, at most; others count as rare, which keeps the join exact.
MOST_CELLS = 200_000
#: Classes of a block up to which base prefixes do; levels of longer prefixes, the last the whole set.
SMALL, LEVELS = 8, 3
#: Classes of a block that one task compares at once; a larger one is cut into pieces.
BLOCK = 2048
#: Postings whose counts one bucket adds up, without copies.
BUCKET = 1 << 14
#: Times as many forests in each further round.
MORE = 16
#: Bits of the bit maps by which rows are dropped early that a join would drop anyway.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
FAR = np.int32(1 << 30)


def sets_of(s: W.Slice, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    w = W.words(s, lower=True)
    m = W.mix(w.hashes)
    every = np.zeros(max(0, len(m) - size + 1), W.U64)
    for k in range(size):
        every += m[k : k + len(every)] * W.U64(2 * k + 3)
    every = W.mix(every + W.U64(size))
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            x = np.sort(every[a : b - size + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif n:
            yield W.shingles(w.hashes[a:b], n, seed=n + 7)
        else:
            yield np.empty(0, W.U64)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> W.U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequent_cells(texts: DataFrame, size: int) -> np.ndarray:
    """Cells of shingles that are frequent in some task, in order of their counts; at most MOST_CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        total = 0
        for batch in batches:
            for s in W.slices(batch.column(0)):
                for x in sets_of(s, size):
                    counts[_cell(x)] += 1
                    total += len(x)
        some = np.flatnonzero(counts >= FREQUENT + 6 * total // CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some].astype(np.int64))], names=["cell", "count"])

    found = texts.mapInArrow(tidied(run), "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count"))
    rows = found.orderBy(F.desc("count"), "cell").limit(MOST_CELLS).collect()
    return np.array([r["cell"] for r in rows][::-1], np.int64)


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100).cast("long") + 1


def signature(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for a set of shingles, as an array of one."""
    return W.mix(W.mix(x + W.U64(seed)).sum(dtype=W.U64, keepdims=True) + W.U64(len(x)))


def parity(x: np.ndarray) -> bytes:
    """Of each of two to four times as many cells as there are shingles, whether it holds an odd number of them."""
    cells = max(128, 1 << (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((W.mix(x) & W.U64(cells - 1)).astype(np.int64), minlength=cells) & 1 == 1).tobytes()


def _hash_bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(keys.view(W.U64)) & W.U64(bits - 1)).astype(np.int64)


class BitMap:
    """One bit for the hash of each key; its size follows their number up to a bound, beyond which it drops less."""

    def __init__(self, keys: DataFrame):
        """keys: a table of one column, checkpointed."""
        count = keys.count()
        bits = self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = np.zeros(bits // 64, np.int64)
            for batch in batches:
                at = _hash_bit(batch.column(0).to_numpy(), bits)
                np.bitwise_or.at(some, at >> 6, np.int64(1) << (at & 63))
            used = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(some[used])], names=["word", "bits"])

        found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, np.int64)
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _hash_bit(keys, self.bits)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1


class Order:
    """The global order of shingles; a task makes its table from the frequent cells."""

    def __init__(self, cells: np.ndarray, crowded: BitMap | None):
        self.rank, self.crowded = np.zeros(CELLS, np.int32), crowded
        self.rank[cells] = 2 * np.arange(1, len(cells) + 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A sorted set in this order."""
        late = self.rank[_cell(x)]
        if self.crowded:
            late += self.crowded(x)
        return x[np.argsort(late, kind="stable")]


def _documents(source: DataFrame, size: int, seed: int) -> DataFrame:
    """id, n, class and a second hash of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(1)):
                found = [(len(x), signature(x, seed)[0], signature(x, seed + 1)[0]) for x in sets_of(s, size)]
                n, first, second = (np.array(c, k) for c, k in zip(zip(*found, strict=True), (np.int64, W.U64, W.U64), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(n)), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], names=["id", "n", "class", "second"])

    return source.mapInArrow(tidied(run), "id long, n long, class long, second long")


def _prefixes(batches: Iterator[pa.RecordBatch], order: Order, size: int, percent: int, seed: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Classes and their base prefixes, each class once a task."""
    seen = set()
    for batch in batches:
        for s in W.slices(batch.column(1)):
            signs, prefixes = [], []
            for x in sets_of(s, size):
                if len(x) and (sign := int(signature(x, seed)[0])) not in seen:
                    seen.add(sign)
                    signs.append(sign)
                    prefixes.append(order(x)[: len(x) - needed(len(x), percent) + 1])
            if signs:
                yield np.array(signs, W.U64), prefixes


def crowded_tokens(source: DataFrame, cells: np.ndarray, size: int, percent: int, seed: int, postings: int) -> DataFrame:
    """(token): shingles in the first prefixes of more than SMALL classes, a copy in each task counted.

    Counts are added up in each task first; so a bucket of tokens holds a bounded share of
    all postings, and of a frequent token one count of each task.
    """
    buckets = max(1, postings // BUCKET)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        bucket = ((tokens >> W.U64(32)) * W.U64(buckets) >> W.U64(32)).astype(np.int64)
        used, first = np.unique(bucket, return_index=True)
        ends = np.r_[first[1:], len(tokens)]
        blobs = ([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for x in (tokens, counts.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, prefixes in _prefixes(batches, Order(cells, None), size, percent, seed):
            parts += prefixes
            held += sum(map(len, prefixes))
            if held > 1 << 20:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            tokens, at = np.unique(np.frombuffer(b"".join(block.column("tokens").to_pylist()), W.U64), return_inverse=True)
            counts = np.bincount(at, np.frombuffer(b"".join(block.column("counts").to_pylist()), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[counts > SMALL].view(np.int64))], names=["token"])

    counts = source.where("id is not null").mapInArrow(tidied(run), "bucket long, tokens binary, counts binary")
    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "token long")


def _postings(source: DataFrame, order: tuple, size: int, percent: int, seed: int) -> DataFrame:
    """(token, class) of the base prefixes, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for signs, prefixes in _prefixes(batches, Order(*order), size, percent, seed):
            classes = np.repeat(signs, [len(p) for p in prefixes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes).view(np.int64)), pa.array(classes.view(np.int64))], names=["token", "class"])

    return source.where("id is not null").mapInArrow(tidied(run), "token long, class long")


def _shared(postings: DataFrame) -> DataFrame:
    """The distinct postings whose token several classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last distinct posting so far, and whether it has been given out.
        last, told = np.empty((2, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.hstack([last, np.stack([c.to_numpy() for c in batch.columns])])
            both = both[:, np.r_[True, (both[:, 1:] != both[:, :-1]).any(0)]]
            same = both[0, 1:] == both[0, :-1]
            out = np.r_[same, False] | np.r_[False, same]
            held = out.copy()
            held[0] &= not (told and last.size)
            told = bool(out[-1]) or (told and both.shape[1] == 1 and bool(last.size))
            last = both[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in both[:, held]], names=["token", "class"])

    return postings.repartition("token").sortWithinPartitions("token", "class").mapInArrow(run, "token long, class long")


def _sets(source: DataFrame, docs: DataFrame, size: int) -> Iterator:
    """A mapping of Arrow batches that gives (ids, sets) of the rows whose id is in a table of docs, and few others."""
    marked = BitMap(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(batch.column(0).to_numpy())))
            ids = batch.column(0).to_numpy()
            for s in W.slices(batch.column(1)):
                yield from zip(ids[s.first : s.first + len(s.offsets) - 1].tolist(), sets_of(s, size), strict=True)

    return source.where("id is not null").select("id", "text"), each


def _some(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last column is binary, with about ``most`` bytes each."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += 64 + len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _signed(hashed: np.ndarray) -> int:
    return int(hashed.view(np.int64)[0])


def _whole_sets(source: DataFrame, docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(doc, class, set), the shingles as bytes, of the documents of a table and few others; each class of a document once a task."""
    texts, each = _sets(source, docs, size)
    schema = pa.schema([("doc", pa.int64()), ("class", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()

        def rows():
            for doc, x in each(batches):
                key = (doc, _signed(signature(x, seed)))
                if key not in seen:
                    seen.add(key)
                    yield *key, x.tobytes()

        yield from _some(rows(), schema)

    return texts.mapInArrow(tidied(run), "doc long, class long, set binary")


def _level(cost: Column) -> Column:
    """0 for the base prefix; each doubling of the candidate cost beyond SMALL is a level."""
    return F.least(F.ceil(F.log2(cost / SMALL)), F.lit(LEVELS)).cast("int")


def length_at(n: int, level: int, percent: int) -> int:
    """Length of the prefix of a set of n shingles."""
    return n if level >= LEVELS else min(n, (n - needed(n, percent) + 1) << level)


def _sketches(source: DataFrame, docs: DataFrame, order: tuple, size: int, percent: int, seed: int) -> DataFrame:
    """(doc, class, level, length, sketch): the longer prefixes of the documents of a table and few others."""
    texts, each = _sets(source, docs, size)
    schema = pa.schema([("doc", pa.int64()), ("class", pa.int64()), ("level", pa.int32()), ("length", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordering, seen = Order(*order), set()

        def rows():
            for doc, x in each(batches):
                key = (doc, _signed(signature(x, seed)))
                if len(x) and key not in seen:
                    seen.add(key)
                    ordered = ordering(x)
                    for level in range(1, LEVELS + 1):
                        length = length_at(len(x), level, percent)
                        yield *key, level, length, parity(ordered[:length])

        yield from _some(rows(), schema)

    return texts.mapInArrow(tidied(run), "doc long, class long, level int, length long, sketch binary")


def _linkable(k, na, nb, rest, percent: int):
    """Whether k shared prefix shingles and ``rest`` beyond the prefixes leave enough for a link."""
    return (k + rest) * (100 + percent) >= (na + nb) * percent


def _small_pairs(post: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share small blocks, if they share as many base shingles as a link needs.

    Shingles of larger blocks are taken as shared by as many as both have of these.
    """
    crowded = post.groupBy("class").agg(F.sum(F.when(F.col("cost") > SMALL, F.col("times")).otherwise(0)).alias("more"))
    rows = post.where(F.col("cost") <= SMALL).join(crowded, "class").select("token", "class", "n", "more", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)
        for batch in batches:
            old = held.shape[1]
            t = np.hstack([held, np.stack([c.to_numpy() for c in batch.columns])])
            for step in range(1, SMALL):
                second = np.arange(max(old, step), t.shape[1])
                x, y = t[:, second - step], t[:, second]
                near = (x[0] == y[0]) & (100 * np.minimum(x[2], y[2]) >= percent * np.maximum(x[2], y[2]))
                x, y = x[1:, near], y[1:, near]
                x, y = np.where(x[0] < y[0], x, y), np.where(x[0] < y[0], y, x)
                if near.any():
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (x[0], y[0], x[1], y[1], np.minimum(x[2], y[2]), x[3]))], names=["a", "b", "na", "nb", "more", "times"])
            held = t[:, -SMALL:]

    pairs = rows.repartition("token").sortWithinPartitions("token", "class").mapInArrow(run, "a long, b long, na long, nb long, more long, times long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("more").alias("more"))

    def beyond(n: str) -> Column:
        return F.col(n) - _prefix_size(F.col(n), percent)

    return pairs.where(_linkable(F.col("k") + F.col("more"), F.col("na"), F.col("nb"), F.greatest(beyond("na"), beyond("nb")), percent)).select("a", "b")


def _allowed(pairs: DataFrame, classes: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches of their whole sets allow."""
    whole = sketches.where(F.col("level") == LEVELS).join(classes, ["class", "doc"]).select("class", "n", "sketch")
    for x in ("a", "b"):
        pairs = pairs.join(whole.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for i, both in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = (np.frombuffer(b, np.uint8) for b in sorted(both, key=len))
                apart[i] = np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum(dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_linkable((na + nb - apart) // 2, na, nb, 0, percent)))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").dropDuplicates()


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and (i or any(held[0].column(j)[0].as_py() != k[j, 0] for j in range(keys))):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _distances(n: np.ndarray, length: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Between the rows of a block, FAR where sizes or sketches rule a link out."""
    width = np.array([len(s) for s in sketches])
    out = np.full((len(n), len(n)), FAR)
    at = {v: np.flatnonzero(width == v) for v in np.unique(width).tolist()}
    bits = {v: np.frombuffer(b"".join([sketches[i] for i in x]), np.uint8).reshape(len(x), -1) for v, x in at.items()}
    for v, rows in at.items():
        left = bits[v].view(W.U64)
        for u, columns in at.items():
            if u < v or 100 * n[rows].max() < percent * n[columns].min() or 100 * n[columns].max() < percent * n[rows].min():
                continue
            # A wider sketch folds into a narrower one.
            right = np.bitwise_xor.reduce(bits[u].reshape(len(columns), u // v, v), axis=1).view(W.U64)
            step = max(1, (1 << 21) // (len(columns) * (v // 8)))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                apart = np.bitwise_count(left[i : i + step, None] ^ right[None]).sum(2, dtype=np.int64)
                na, nb, la, lb = n[some, None], n[None, columns], length[some, None], length[None, columns]
                ok = _linkable((la + lb - apart) // 2, na, nb, np.maximum(na - la, nb - lb), percent) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                d = np.where(ok, (apart << 12) // (na + nb), FAR).astype(np.int32)
                out[np.ix_(some, columns)] = d
                out[np.ix_(columns, some)] = d.T
    return out


def spanning_edges(cost: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a least spanning forest; costs from 0 on, those below join for free, FAR not at all."""
    m, edges = len(cost), []
    best, near, out = np.full(m, FAR), np.zeros(m, np.int64), np.zeros(m, bool)
    for _ in range(m):
        i = int(best.argmin())
        if out[i]:  # all of this tree's neighbours are in
            i = int(out.argmin())
        elif 0 <= best[i] < FAR:
            edges.append((int(near[i]), i))
        out[i] = True
        less = (cost[i] < best) & ~out
        best[less], near[less] = cost[i][less], i
        best[i] = FAR
        if best[i] == FAR and out.all():
            break
    return edges


def _forests(cost: np.ndarray, comp: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Edges of up to ``most`` disjoint forests between components, and whether a candidate pair is left out."""
    same = comp[:, None] == comp[None]
    open_ = (cost < FAR) & ~same
    some = np.flatnonzero(open_.any(1))
    if not len(some):
        return [], False
    cost = np.where(same, -1, cost)[np.ix_(some, some)]
    open_ = open_[np.ix_(some, some)]
    edges: list[tuple[int, int]] = []
    for _ in range(most):
        new = spanning_edges(np.where(open_ | (cost < 0), cost, FAR))
        for a, b in new:
            open_[a, b] = open_[b, a] = False
        edges += [(int(some[a]), int(some[b])) for a, b in new]
        if not open_.any():
            return edges, False
    return edges, True


def _crowded_pairs(live: DataFrame, forests: int, percent: int) -> DataFrame:
    """(token, a, b) of the forests' edges; a null a tells that a candidate pair of the token is left out.

    live: token, piece columns x and y, class, comp, n, length, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in _blocks(batches, 3):
            if block.num_rows < 2:
                continue
            classes, comp, n, length = (block.column(c).to_numpy() for c in ("class", "comp", "n", "length"))
            edges, left = _forests(_distances(n, length, block.column("sketch").to_pylist(), percent), comp, forests)
            token = block.column(0)[0].as_py()
            out += [(token, *sorted((int(classes[i]), int(classes[j])))) for i, j in edges]
            if left:
                out.append((token, None, None))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["token", "a", "b"])

    live = live.select("token", "x", "y", "class", "comp", "n", "length", "sketch")
    return live.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(run, "token long, a long, b long")


def _pieces(live: DataFrame, block: int, whole: bool) -> DataFrame:
    """Adds the pieces (x, y) of its block that a posting belongs to; live has token, class and comp.

    A block of up to ``block`` classes is one piece. In a larger one, classes are dealt into
    parts; without ``whole`` each part is a piece, else each two parts are, but those of the
    largest component of the block only with parts of the others.
    """
    sizes = live.groupBy("token", "comp").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("top")).select("token", "all", F.col("top.c").alias("main"), F.col("top.comp").alias("main_comp")).where("main < all")
    live = live.join(sizes, "token")
    parts = lambda size: F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    own = lambda many: F.pmod(F.xxhash64("class"), many).cast("int")
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    if not whole:
        n = parts(F.col("all"))
        return live.withColumn("x", own(n)).withColumn("y", F.col("x")).drop("all", "main", "main_comp")
    mains, others = parts(F.col("main")), parts(F.col("all") - F.col("main"))
    main = F.transform(F.sequence(F.lit(0), others - 1), lambda j: pair(-1 - own(mains), j))
    other = F.concat(F.transform(F.sequence(F.lit(0), mains - 1), lambda i: pair(-1 - i, own(others))), F.transform(F.sequence(F.lit(0), others - 1), lambda j: pair(F.least(j, own(others)), F.greatest(j, own(others)))))
    at = F.when(F.col("all") <= block, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("comp") == F.col("main_comp"), main).otherwise(other)
    return live.withColumn("at", F.explode(at)).select("*", "at.x", "at.y").drop("at", "all", "main", "main_comp")


def _verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(x), F.col("doc").alias(f"d{x}")), x)
    pairs = checkpointed(pairs)
    sets = _whole_sets(source, pairs.select(F.col("da").alias("doc")).union(pairs.select("db")), size, seed)
    left = sets.select(F.col("doc").alias("da"), F.col("class").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("doc").alias("db"), F.col("class").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), W.U64), np.frombuffer(y.as_buffer(), W.U64)
                both = np.sort(np.concatenate([x, y]))
                k = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * k >= percent * (len(x) + len(y) - k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return checkpointed(pairs.join(left, ["a", "da"]).join(right, ["b", "db"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (class, comp) after edges (a, b) between components: the smallest document of each."""
    found = components(edges)
    return checkpointed(labels.join(found, labels["comp"] == found["node"], "left").select("class", F.coalesce("component", "comp").alias("comp")))


def _edges(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between classes as edges between their components."""
    a = labels.select(F.col("class").alias("a"), F.col("comp").alias("ca"))
    b = labels.select(F.col("class").alias("b"), F.col("comp").alias("cb"))
    return links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _classes(source: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows (id, n, class), the classes (class, n, doc) and the seed under which no two sets share a class."""
    for seed in range(0, 1000, 2):
        rows = checkpointed(_documents(source, size, seed))
        found = rows.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.min("second").alias("lo"), F.max("second").alias("hi"))
        found = checkpointed(found)
        if found.where("lo != hi").isEmpty():
            return rows.select("id", "n", "class"), found.select("class", "n", "doc"), seed
    raise RuntimeError("sets clash under every seed")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component of each row."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    lean(docs)
    rows, classes, seed = _classes(source, size)
    known = rows.where("id is not null and n > 0")
    cells = frequent_cells(source.where("id is not null").select("text"), size)
    total = classes.agg(F.sum(_prefix_size(F.col("n"), percent))).first()[0] or 0
    order = cells, BitMap(checkpointed(crowded_tokens(source, cells, size, percent, seed, total)))
    shared = checkpointed(_shared(_postings(source, order, size, percent, seed)))
    release(docs.sparkSession)
    post = checkpointed(shared.join(_unlike_blocks(shared), "token").join(classes, "class"))

    same = _of_one_id(known, classes)
    labels = checkpointed(classes.join(shared.select("class").distinct(), "class", "left_semi").unionAll(classes.join(same.select("class"), "class", "left_semi")).select("class", F.col("doc").alias("comp")).distinct())
    if not same.isEmpty():
        labels = _merged(labels, same.select("a", "b"))

    crowded = _outer_blocks(post.where(F.col("cost") > SMALL)).select("token", "class", "n", "doc", _level(F.col("cost")).alias("level"), "cost")
    found = checkpointed(_small_pairs(post, percent))
    ends = found.select(F.col("a").alias("class")).union(found.select("b")).distinct().join(classes, "class")
    sketches = checkpointed(_sketches(source, checkpointed(crowded.select("doc").union(ends.select("doc")).distinct()), order, size, percent, seed))
    found = _allowed(found, classes, sketches, percent)
    crowded = checkpointed(crowded.join(sketches, ["doc", "class", "level"]).select("token", "class", "n", "length", "sketch", "cost"))

    forests = 1
    live = _pieces(crowded.join(labels, "class"), block, False)
    while True:
        told = checkpointed(_crowded_pairs(live, forests, percent))
        pairs = told.where("a is not null").select("a", "b")
        links = _verified((found.unionAll(pairs) if found is not None else pairs).distinct(), classes, source, size, percent, seed)
        labels = _merged(labels, _edges(labels, links))
        # Where all edges of a block link, none of its pairs is left between components.
        failed = told.where("a is not null").join(links, ["a", "b"], "left_anti").select("token")
        again = told.where("a is null").select("token").join(failed, "token", "left_semi")
        if forests == 1:
            again = again.unionAll(crowded.where(F.col("cost") > block).select("token"))
        again = checkpointed(again.distinct())
        del told, pairs, links, failed, live
        release(docs.sparkSession)
        if again.isEmpty():
            break
        forests, found = forests * MORE, None
        live = _pieces(crowded.join(again, "token", "left_semi").join(labels, "class"), block, True)

    component = classes.join(labels, "class", "left").select("class", F.coalesce("comp", "doc").alias("component"))
    # By id, as rows without words follow those of their id; all classes of an id are in one component.
    of_id = known.select("id", "class").join(component, "class").groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select("id", "n").join(of_id, "id", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _unlike_blocks(shared: DataFrame) -> DataFrame:
    """(token, cost, times): one token of those that the same classes have, and how many these are."""
    classes = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"x{k}") for k in range(2)]
    tokens = shared.groupBy("token").agg(F.count("*").alias("cost"), *classes)
    return tokens.groupBy("cost", "x0", "x1").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "cost", "times")


def _outer_blocks(crowded: DataFrame) -> DataFrame:
    """Without the blocks whose classes all have one and the same larger block as their largest, which compares them too."""
    largest = crowded.groupBy("class").agg(F.max(F.struct("cost", "token"))["token"].alias("largest"))
    within = crowded.select("token", "class").join(largest, "class").groupBy("token").agg(F.min("largest").alias("lo"), F.max("largest").alias("hi"))
    return crowded.join(within.where("lo = hi and lo != token").select("token"), "token", "left_anti")


def _of_one_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, a, b): of ids with several classes, these, and the edges from the id to their documents."""
    several = known.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("id")
    rows = known.select("id", "class").join(several, "id").join(classes, "class")
    return checkpointed(rows.select("class", F.col("id").alias("a"), F.col("doc").alias("b")).distinct())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of texts that links connect: that of the smallest id, then text.

    Here texts link, not ids: rows of one id with unlike texts all stay, and of repeated rows
    one. A null id comes after all others. Rows without words link with nothing and all stay.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # In one column, so that no name clashes.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), t.alias("text"), F.xxhash64(t).alias("key"))
    found = join_components(keyed.select("key", "text"), "key", "text", size, percent).where("n_shingles > 0").select(F.col("id").alias("key"), "component").distinct()
    places = keyed.select("id", "key").join(found, "key")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("id"), "key"))
    places = checkpointed(places.groupBy("component", "id", "key").agg(F.count("*").alias("times")))
    firsts = places.groupBy("component").agg(first.alias("first")).select("component", F.when(~F.col("first.last"), F.col("first.id")).alias("id"), F.col("first.key").alias("key"))
    same = lambda a, b: (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))
    gone = places.alias("p").join(firsts.alias("f"), (F.col("p.component") == F.col("f.component")) & same("p", "f"), "left_anti")
    twice = places.where("times > 1")
    left = keyed.alias("d").join(gone.unionAll(twice).alias("g"), same("d", "g"), "left_anti").select("row.*")
    # Rows that stand several times in the same way give one.
    again = twice.alias("p").join(firsts.alias("f"), (F.col("p.component") == F.col("f.component")) & same("p", "f"), "left_semi")
    picked = keyed.alias("d").join(again.alias("g"), same("d", "g"), "left_semi").groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
    return left.unionAll(picked)


def brute_force(ids: list[int], texts: list[str | None], size: int = SIZE, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(id, n_shingles, component) by comparing all pairs; for tests."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        ws = (t or "").translate(lower).encode().split()
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    root = dict(zip(ids, ids, strict=True))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            k = len(x & sets[j])
            if k and 100 * k >= percent * (len(x) + len(sets[j]) - k):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return [(i, len(x), find(i)) for i, x in zip(ids, sets, strict=True)]
