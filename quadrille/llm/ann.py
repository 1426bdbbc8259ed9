"""Operator 3: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on at most ``SAMPLE`` vectors, taken in hash
order; every vector is indexed. A vector belongs to the list of its nearest centroid and
holds the codes of its residual, one byte for each sub-space. A query visits its nearest
lists; how many, the sample tells: as many as hold ``REACH`` of the sample's true
neighbours. It goes on until the lists hold k others; a query for which these are farther
than usual, as it lies apart from all vectors, visits all lists that are hardly farther. In a list, asymmetric distance tables rank the rows and the best ``RERANK``
are ranked again by exact Euclidean distance in double precision.

Lists are dealt into blocks of about ``BLOCK`` rows by the hash of their ids, and the queries
of a list into parts of about ``QUERIES``; a task holds one block and one part, whatever the
size of a list, and a list is copied only if more than ``QUERIES`` visit it.
Equal vectors have equal codes and ties go to the smaller id, so copies of one vector do
not push each other out.

Vectors that are null, zero, of another length than most, or that hold a null or a
component that is not finite take no part, nor do rows with a null id; a query gets all
candidates if there are fewer than k; rows that bear the query's id are its own; repeated
ids are candidates each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed

SAMPLE, LISTS, CODES, SUB = 16_384, 2048, 256, 4
REACH, RERANK, BLOCK, QUERIES = 0.98, 200, 8192, 16_384


#: Share of the sample's neighbours whose list is no farther beyond the nearest one than the gap.
GAP = 0.99


@dataclass
class Index:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # sub-spaces x codes x width
    probes: int
    far: float = np.inf
    gap: float = 0.0

    def visited(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query visits, which hold ``least`` rows if all together do."""
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * q @ self.centroids.T, 0))
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        enough = np.minimum((np.cumsum(sizes[order], axis=1) < least).sum(1) + 1, d.shape[1])
        edge = d[np.arange(len(d)), enough - 1, None]
        near = np.where(edge[:, 0] > self.far, (d <= edge + self.gap).sum(1), 0)
        return [o[:n] for o, n in zip(order, np.maximum(np.maximum(near, enough), self.probes).tolist(), strict=True)]

    def lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        r = (x - self.centroids[lists]).reshape(len(x), m, width)
        out = np.empty((len(x), m), np.uint8)
        for j in range(m):
            out[:, j] = ((self.books[j] ** 2).sum(1) - 2 * r[:, j] @ self.books[j].T).argmin(1)
        return out

    def table(self, q: np.ndarray, number: int) -> np.ndarray:
        """Squared distances of the query's residual to every code: sub-spaces x codes."""
        m, _, width = self.books.shape
        r = (q - self.centroids[number]).reshape(m, 1, width)
        return ((r - self.books) ** 2).sum(2)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """Lloyd's steps from distinct rows; a centroid without rows stays."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(steps):
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.column_stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])])
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def usable(column: pa.ListArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector of that length, and these vectors."""
    n = len(column)
    lens = np.array(column.value_lengths().fill_null(0), np.int64)
    if dim is None:
        dim = int(np.bincount(lens[lens > 0]).argmax()) if (lens > 0).any() else 0
    ok = (lens == dim) & (dim > 0)
    rows = column.filter(pa.array(ok))
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(dim, 1))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok if n else np.zeros(0, bool), x[good]


def fit(vectors: DataFrame, total: int, k: int = 10) -> Index | None:
    """From a table (id, v) of usable and other vectors."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    _, x = usable(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample)
    if not len(x):
        return None
    rng = np.random.default_rng(7)
    lists = int(min(LISTS, max(1, round(np.sqrt(total)))))
    centroids = kmeans(x, lists, rng)
    index = Index(centroids, np.zeros((1, 1, x.shape[1])), 1)
    dim = x.shape[1]
    width = next(w for w in (SUB, 3, 2, 1) if dim % w == 0)
    r = (x - centroids[index.lists(x)[:, 0]]).reshape(len(x), dim // width, width)
    books = [kmeans(r[:, j], CODES, rng, 8) for j in range(dim // width)]
    most = max(map(len, books))
    index.books = np.stack([np.vstack([b, np.repeat(b[:1], most - len(b), 0)]) for b in books])
    # Lists to visit: where the sample's own neighbours lie.
    own = index.lists(x)[:, 0]
    asked = rng.permutation(len(x))[:400]
    order = index.lists(x[asked], len(centroids))
    ranks, gaps = [], []
    for i, q in enumerate(asked):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[:k]
        place = np.empty(len(centroids), np.int64)
        place[order[i]] = np.arange(len(centroids))
        ranks.append(place[own[near]])
        apart = np.sqrt(((centroids - x[q]) ** 2).sum(1))
        gaps.append(apart[own[near]] - apart[order[i][0]])
    index.probes = int(np.quantile(np.concatenate(ranks), REACH)) + 1
    index.gap = float(np.quantile(np.concatenate(gaps), GAP))
    index.far = float(np.quantile(np.sqrt(((x - centroids[own]) ** 2).sum(1)), REACH))
    return index


def _search(index: Index, number: int, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> list[tuple]:
    order = np.argsort(ids, kind="stable")
    ids, codes, x = ids[order], codes[order], x[order]
    columns = np.arange(codes.shape[1])
    out = []
    for one, v in zip(asked, q, strict=True):
        t = index.table(v, number)
        d = t[columns, codes].sum(1)
        d[ids == one] = np.inf
        if len(d) > RERANK:
            edge = np.partition(d, RERANK - 1)[RERANK - 1]
            take = np.r_[np.flatnonzero(d < edge), np.flatnonzero(d == edge)][:RERANK]
        else:
            take = np.arange(len(d))
        take = take[np.isfinite(d[take])]
        exact = np.sqrt(((x[take] - v) ** 2).sum(1))
        best = np.lexsort((ids[take], exact))[:k]
        out += [(one, ids[take[b]], exact[b]) for b in best]
    return out


def search(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row."""
    spark = table.sparkSession
    vectors = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counted = vectors.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    index = fit(vectors.select("id", "v"), counted["n"], k) if counted["n"] else None
    if index is None:
        return empty
    dim = index.centroids.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = usable(batch.column(1), dim)
            if not len(x):
                continue
            own = index.lists(x)[:, 0]
            codes, keep = index.codes(x, own), pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(2).filter(keep), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["id", "q", "list", "codes", "v"],
            )

    rows = checkpointed(vectors.mapInArrow(encode, "id long, q boolean, list int, codes binary, v binary"))
    # One number for each list, of which there are LISTS at most.
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in rows.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    if not sizes.any():
        return empty

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dim)
            lists = index.visited(q, sizes, k + 1)
            at = pa.array(np.repeat(np.arange(len(q)), list(map(len, lists))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(lists).astype(np.int32) if lists else [], pa.int32())], names=["id", "v", "list"])

    asked = checkpointed(rows.where("q").select("id", "v").mapInArrow(visit, "id long, v binary, list int"))
    visits = np.zeros(len(sizes), np.int64)
    for r in asked.groupBy("list").count().collect():
        visits[r["list"]] = r["count"]

    def of_list(counts: np.ndarray, most: int) -> Column:
        """How many pieces of ``most`` a row's list is cut into."""
        return F.get(F.array(*(F.lit(max(1, -(-int(c) // most))) for c in counts)), F.col("list"))

    blocks, parts = of_list(sizes, BLOCK), of_list(visits, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    indexed = rows.select("id", "list", "codes", "v", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), every(parts).alias("part"))
    asked = asked.select("id", "v", "list", F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("part"), every(blocks).alias("block"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(a) and len(b):
            m = index.books.shape[0]
            codes = np.frombuffer(b"".join(a["codes"]), np.uint8).reshape(-1, m)
            x, q = (np.frombuffer(b"".join(t["v"])).reshape(-1, dim) for t in (a, b))
            found = _search(index, int(a["list"].iat[0]), a["id"].to_numpy(), codes, x, b["id"].to_numpy(), q, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["list", "block", "part"]
    found = indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(both, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
