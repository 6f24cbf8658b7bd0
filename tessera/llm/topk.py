"""Exact top-k search by inner product over norm-sorted vectors.

Components become integers, floor(256 * x), so scores are exact. Vectors are written once, in order of descending
length, each with its components turned by an orthogonal rotation (from the SVD of a bounded sample) that puts most of
the length in the leading coordinates. Queries go in portions of bounded size, which are broadcast. First the longest
vectors, a bounded number, give every query a k-th best score so far. Then each task goes through its vectors by
descending length, a block at a time: a block is left out if its longest vector can't beat the k-th best score of any
query (Cauchy-Schwarz). In a block a partial sum over the leading coordinates plus the product of the residual lengths
bounds each score, and only vectors whose bound reaches the query's k-th best score are multiplied out, in integers. A
task gives at most k rows for each query. Any rotation gives right results; the sample only makes bounds tight.

Vectors aren't shuffled but for their order; the driver holds one portion of queries at a time.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Vectors of another
length than the query's aren't candidates: each length is searched by itself. Zero vectors take part. Equal scores rank
by smaller vec_id (null last). Repeated rows are candidates of their own; rows with the query's own vec_id are none, and
a query that occurs in several rows gets its best of all of them. With fewer than k candidates all are given; an empty
table gives no rows. Vectors so long that products could leave 64 bits (256 * length of 2^31 or more) are an error.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, tidy
from tessera.llm.vectors import lengths, usable

ITEMS, QUERIES, PORTION = 8192, 8192, 1024  # longest vectors searched first; queries of a portion; vectors of a block
GROUP = 512  # queries bounded at once
MOST = 2.0**31  # no vector is as long
_NO_ID = 2**63 - 1


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, d, x (int64 components as bytes), norm, for vectors of any lengths."""
    for batch in batches:
        v = batch.column("v")
        x = np.floor(256 * v.flatten().to_numpy(zero_copy_only=False))
        ends = np.cumsum(batch.column("d").to_numpy())
        norm = np.sqrt(np.add.reduceat(x**2, ends - batch.column("d").to_numpy())) if len(ends) else np.zeros(0)
        if len(norm) and not norm.max() < MOST:
            raise ValueError("vectors are too long for scores of 64 bits")
        x = x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("d"), pa.array([r.tobytes() for r in np.split(x, ends[:-1])] if len(ends) else [], pa.binary()), pa.array(norm)], names=["vec_id", "d", "x", "norm"])


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal columns by descending share of the sample's squared length."""
    return np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(sample.shape[1])


class Search:
    """The best k so far of some queries; vectors come in any number of batches."""

    def __init__(self, q_id: np.ndarray, q: np.ndarray, kth: np.ndarray, rot: np.ndarray, k: int, lead: int = 16):
        self.id, self.q, self.rot, self.k, self.lead = q_id, q, rot, k, lead
        self.norm = np.linalg.norm(q.astype(np.float64), axis=1)
        self.kth = kth.astype(np.float64)
        turned = q @ rot
        self.first, self.rest = turned[:, :lead], self.residual(turned)
        self.best: list[list[tuple[int, int]]] = [[] for _ in q_id]

    def residual(self, turned: np.ndarray) -> np.ndarray:
        return np.sqrt((turned[:, self.lead :] ** 2).sum(1))

    def meet(self, x_id: np.ndarray, x: np.ndarray) -> None:
        """Vectors in any order; those of descending length let more blocks be left out."""
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        for a in range(0, len(x), PORTION):
            b = slice(a, a + PORTION)
            slack = 1e-9 * (1 + self.norm * norm[b].max())  # rounding of the bounds
            open_ = np.flatnonzero(self.norm * norm[b].max() + slack >= self.kth)
            if not len(open_):
                continue
            turned = x[b] @ self.rot
            first, rest = turned[:, : self.lead], self.residual(turned)
            for g in range(0, len(open_), GROUP):
                o = open_[g : g + GROUP]
                bound = self.first[o] @ first.T + self.rest[o][:, None] * rest
                hit, at = np.nonzero((bound + slack[o][:, None] >= self.kth[o][:, None]) & (x_id[b][None, :] != self.id[o][:, None]))
                if len(hit):
                    self._verify(o[hit], x_id[b][at], x[b][at])

    def _verify(self, of: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score = np.einsum("ij,ij->i", self.q[of], x)
        good = np.flatnonzero(score >= self.kth[of])
        if not len(good):
            return
        order = good[np.lexsort((ids[good], -score[good], of[good]))]
        each, since = np.unique(of[order], return_index=True)
        for o, lo, hi in zip(each.tolist(), since.tolist(), np.append(since[1:], len(order)).tolist(), strict=True):
            mine = order[lo : min(hi, lo + self.k)]
            self.best[o] = sorted(self.best[o] + list(zip((-score[mine]).tolist(), ids[mine].tolist(), strict=True)))[: self.k]
            if len(self.best[o]) == self.k:
                self.kth[o] = max(self.kth[o], -self.best[o][-1][0])

    def rows(self) -> pa.RecordBatch:
        found = [(int(self.id[o]), v, -s) for o, best in enumerate(self.best) for s, v in best]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score long"


def _matrix(rows: pa.Table | pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components."""
    x = rows.column("x")
    flat = b"".join(x.to_pylist())
    return rows.column("vec_id").fill_null(_NO_ID).to_numpy(), np.frombuffer(flat, np.int64).reshape(len(x), d)


@tidy
def _searched(batches: Iterator[pa.RecordBatch], queries, rot: np.ndarray, d: int, k: int) -> Iterator[pa.RecordBatch]:
    task = Search(*queries.value, rot, k)
    for batch in batches:
        task.meet(*_matrix(batch, d))
    yield task.rows()


@tidy
def _started(batches: Iterator[pa.RecordBatch], longest, rot: np.ndarray, d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries with kth, the k-th best score among the longest vectors (null if there are fewer)."""
    for batch in batches:
        for i in range(0, batch.num_rows, QUERIES):
            part = batch.slice(i, QUERIES)
            ids, q = _matrix(part, d)
            task = Search(ids, q, np.full(len(q), -(2.0**62)), rot, k)
            task.meet(*longest.value)
            kth = [-best[-1][0] if len(best) == k else None for best in task.best]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(kth, pa.int64())], names=["vec_id", "x", "kth"])


def _search(ws: Workspace, rows: DataFrame, d: int, is_query: Column, k: int, sample: int, seed: int) -> list[DataFrame]:
    """What each portion of the queries of length d found, at most k rows for each query and task."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    rows = rows.filter(F.col("d") == d).select("vec_id", "x", "norm")
    some = rows.select("x").orderBy(F.xxhash64("vec_id", "x", F.lit(seed))).limit(sample).toArrow()
    rot = rotation(np.frombuffer(b"".join(some.column("x").to_pylist()), np.int64).reshape(-1, d).astype(np.float64))
    # in order of length; equal lengths, any number of them, by a hash
    items = ws.write(rows.repartitionByRange(F.desc("norm"), F.xxhash64("vec_id", "x")).sortWithinPartitions(F.desc("norm")), f"items{d}")
    longest = sc.broadcast(_matrix(items.orderBy(F.desc("norm")).limit(ITEMS).select("vec_id", "x").toArrow(), d))
    queries = ws.write(items.filter(is_query).select("vec_id", "x").mapInArrow(partial(_started, longest=longest, rot=rot, d=d, k=k), "vec_id long, x binary, kth long"), f"queries{d}")
    portions = -(-queries.count() // QUERIES)
    out = []
    for p in range(portions):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id", "x"), F.lit(portions)) == p).toArrow()  # about QUERIES rows
        given = sc.broadcast((*_matrix(mine, d), mine.column("kth").fill_null(-(2**62)).to_numpy()))
        found = items.select("vec_id", "x").mapInArrow(partial(_searched, queries=given, rot=rot, d=d, k=k), _FOUND)
        out.append(ws.write(found, f"found{d}_{p}"))
        given.unpersist()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = 20_000, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query's best k. ``is_query`` is a condition on vec_id."""
    ws = Workspace(vectors.sparkSession, "topk")
    rows = ws.write(usable(vectors).filter("v is not null").mapInArrow(_packed, "vec_id long, d int, x binary, norm double"), "rows")
    found = vectors.sparkSession.createDataFrame([], _FOUND)
    for d in lengths(rows):
        for part in _search(ws, rows, d, is_query, k, sample, seed):
            found = found.unionByName(part)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(back("query_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), back("vec_id").alias("vec_id"), "score")
