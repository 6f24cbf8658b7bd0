"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves; a codebook for each half, learned by k-means on a bounded
sample, makes a product grid of cells, finer for more vectors. For each cell a multi-sequence traversal visits cells in
order of the summed distances of their halves' codewords. How many it visits comes from the target recall: pairs of the
sample that link, and vectors at exactly the threshold's angle from sample vectors, must be found with that
probability. Two cells meet if either's traversal visits the other, and every found pair is verified in double
precision. With ``target`` 1 all links are found: cells meet unless the triangle inequality, with the largest distance
of any vector from its codeword, rules links between them out.

Equal vectors become one node with a count first. Each pair of cells belongs to the region of one of them: regions are
neighbouring codewords of the first half, with about ``OWN`` vectors or one codeword each. A task gets a block of a region's own vectors and a block of those they meet, both of bounded
size, adds up link counts and emits edges that join its nodes, never all pairs. Which cells meet is a table.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors
of one length link with each other only; each length has an index of its own. Repeated rows are vectors of their own
and link with each other. A cosine equal to the threshold in double precision links. A null vec_id takes part but
names no component. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, connected_components, ranges, tidy
from tessera.llm.vectors import lengths, usable

OWN, MET, BYTES = 8192, 16384, 64 << 20  # rows of a block, and bytes of the larger one


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c**2).sum(1)
    return np.concatenate([(size - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, max(len(x), 1), 4096)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n pairs (i, j) of least d1[i] + d2[j], nearest first, without forming the grid."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    heap, seen, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(s1) and y < len(s2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (s1[x] + s2[y], x, y))
    return out


class MultiIndex:
    """Two codebooks, and how many cells a traversal visits (None: all that can hold a link)."""

    probes: int | None
    radii: list[np.ndarray]  # per half and codeword the largest distance of a vector from it
    region: np.ndarray  # of each codeword of the first half

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target: float, seed: int):
        rng = np.random.default_rng(seed)
        self.apart = 2 - 2 * threshold + 1e-9  # the largest squared distance of vectors that link
        self.half = sample.shape[1] // 2
        self.books = [kmeans(h, k, rng) for h in self._halves(sample)]
        self.between = [squared(c, c) for c in self.books]
        self.probes = None
        if target >= 1:
            return
        # pairs to be found: those of the sample, and others at the threshold's angle
        part = sample[:1000]
        near = np.argwhere(np.triu(part @ sample.T >= threshold, 1))
        near = near[rng.permutation(len(near))[:4000]]
        x = sample[:4000]
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * u
        rank = self.ranks(self.cells(x), self.cells(y))
        probes = np.quantile(rank, target)
        if len(near):
            rank = self.ranks(self.cells(sample[near[:, 0]]), self.cells(sample[near[:, 1]]))
            probes = max(probes, np.quantile(rank, target))
        self.probes = int(probes) + 1

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(h, c) for h, c in zip(self._halves(x), self.books, strict=True))
        return a * len(self.books[1]) + b

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many cells come before the other's in the traversal, from the better side."""
        k = len(self.books[1])
        d1, d2 = self.between
        s2 = np.sort(d2, 1)
        out = []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            at = d1[p // k, q // k] + d2[p % k, q % k]
            out.append(min(sum(np.searchsorted(s2[y % k], at - d1[y // k] - 1e-12).tolist()) for y in (p, q)))
        return np.array(out)

    def least_apart(self, half: int, a, b) -> np.ndarray:
        """The least squared distance that vectors of two codewords can have in a half."""
        return np.maximum(np.sqrt(self.between[half][a, b]) - self.radii[half][a] - self.radii[half][b], 0) ** 2

    def visited(self, cell: int) -> tuple[list[int], float]:
        """The cells that a traversal from a cell visits, and how far it comes (a sum of squared distances)."""
        k = len(self.books[1])
        if self.probes is not None:
            d1, d2 = (d[i] for d, i in zip(self.between, divmod(cell, k), strict=True))
            found = multi_sequence(d1, d2, self.probes)
            return [i * k + j for i, j in found], float(d1[found[-1][0]] + d2[found[-1][1]])
        low1, low2 = (self.least_apart(h, i, slice(None)) for h, i in enumerate(divmod(cell, k)))
        by = np.argsort(low2, kind="stable")
        many = np.searchsorted(low2[by], self.apart - low1, "right")
        return [int(i * k + j) for i in np.flatnonzero(many) for j in by[: many[i]]], 0.0

    def meet(self, a: np.ndarray, reach_a: np.ndarray, b: np.ndarray, reach_b: np.ndarray) -> np.ndarray:
        """Which of the cells a meet which of the cells b; ``reach``: how far their traversals came."""
        k = len(self.books[1])
        if self.probes is None:
            return self.least_apart(0, (a // k)[:, None], b // k) + self.least_apart(1, (a % k)[:, None], b % k) <= self.apart
        apart = self.between[0][(a // k)[:, None], b // k] + self.between[1][(a % k)[:, None], b % k]
        return apart <= np.maximum(reach_a[:, None], reach_b) + 1e-12


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@tidy
def _celled(batches: Iterator[pa.RecordBatch], index: MultiIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.append_column("cell", pa.array(index.cells(_unit(batch)).astype(np.int32)))


@tidy
def _radii(batches: Iterator[pa.RecordBatch], index: MultiIndex) -> Iterator[pa.RecordBatch]:
    """half, codeword and the largest distance of a vector from it, as far as a task knows."""
    far = [np.zeros(len(b)) for b in index.books]
    for batch in batches:
        x, cell = _unit(batch) if batch.num_rows else np.zeros((0, 2)), batch.column("cell").to_numpy()
        for most, half, book, at in zip(far, index._halves(x), index.books, divmod(cell, len(index.books[1])), strict=True):
            if len(at):
                np.maximum.at(most, at, np.linalg.norm(half - book[at], axis=1))
    for h, most in enumerate(far):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(most), h, np.int32)), pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], names=["half", "codeword", "r"])


@tidy
def _traversed(batches: Iterator[pa.RecordBatch], index: MultiIndex) -> Iterator[pa.RecordBatch]:
    """cell, other: the cells that each filled cell visits, and itself with how far it came (reach)."""
    for batch in batches:
        for cell in batch.column("cell").to_pylist():
            found, reach = index.visited(cell)
            other = np.array([cell, *found], np.int32)
            g = index.region[np.minimum(other, cell) // len(index.books[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), cell, np.int32)), pa.array(other), pa.array(g.astype(np.int32)), pa.array([reach] + [None] * len(found), pa.float64())], names=["cell", "other", "g", "reach"])


def regions(book: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The region of each codeword: neighbours along the book's widest direction share one while it has at most ``most`` vectors."""
    middle = book - book.mean(0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable") if book.shape[1] else np.arange(len(book))
    out, held, g = np.zeros(len(book), np.int64), 0, 0
    for c in order.tolist():
        if held and held + sizes[c] > most:
            held, g = 0, g + 1
        held += sizes[c]
        out[c] = g
    return out


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes over edges a-b."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            return label


def _block_links(rows: pa.Table, index: MultiIndex, threshold: float, dtype) -> pa.Table:
    own = rows.column("own").to_numpy(zero_copy_only=False)
    key, m, cell, reach = (rows.column(c).to_numpy() for c in ("key", "m", "cell", "reach"))
    x = np.stack([np.frombuffer(v, dtype) for v in rows.column("x").to_pylist()]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    left = np.flatnonzero(own)
    right = np.flatnonzero(~own)
    right = right[np.argsort(cell[right], kind="stable")]
    cells, first, many = np.unique(cell[right], return_index=True, return_counts=True)
    total = np.zeros(len(key), np.int64)
    ea, eb = [], []
    for c in np.unique(cell[left]):
        a = left[cell[left] == c]
        at = np.flatnonzero((cells >= c) & index.meet(cell[a[:1]], reach[a[:1]], cells, reach[right[first]])[0]) if len(right) else first[:0]
        b = right[ranges(first[at], many[at])]
        if not len(b):
            continue
        hit = x[a] @ x[b].T >= threshold
        same = np.flatnonzero(cell[b] == c)  # within one cell each pair counts from the smaller key
        hit[:, same] &= key[a][:, None] < key[b[same]][None, :]
        i, j = np.nonzero(hit)
        np.add.at(total, a[i], m[b[j]])
        np.add.at(total, b[j], m[a[i]])
        if len(i):
            ea.append(a[i])
            eb.append(b[j])
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not ea:
        return none
    # a node may stand on both sides: one number for each key
    names, at = np.unique(key, return_inverse=True)
    label = stars(at[np.concatenate(ea)], at[np.concatenate(eb)], len(names))
    moved = np.flatnonzero(label != np.arange(len(names)))
    counted = np.flatnonzero(total)
    return pa.table(
        {
            "a": pa.array(np.concatenate((key[counted], names[moved]))),
            "b": pa.array(np.concatenate((np.zeros(len(counted), np.int64), names[label[moved]])), mask=np.arange(len(counted) + len(moved)) < len(counted)),
            "n": pa.array(np.concatenate((total[counted], np.zeros(len(moved), np.int64)))),
        }
    )


def _packed(batches: Iterator[pa.RecordBatch], dtype) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, in the type of the column: single precision goes through the shuffle as such."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)
            yield batch.drop_columns(["v"]).append_column("x", pa.array([r.tobytes() for r in x], pa.binary()))


def _found(ws: Workspace, nodes: DataFrame, d: int, n: int, threshold: float, target: float, sample: int, per_cell: int, seed: int, dtype) -> DataFrame:
    """Link counts (a, null, n) and joining edges (a, b, 0) of the n nodes of length d; a node may have several counts."""
    spark = nodes.sparkSession
    some = nodes.select("v").orderBy(F.xxhash64("key", F.lit(seed))).limit(sample).toArrow().combine_chunks()
    k = int(np.clip(np.sqrt(n / per_cell), 4, max(4, sample // 16)))
    index = MultiIndex(_unit(some.to_batches()[0]), k, threshold, target, seed)
    celled = ws.write(nodes.mapInArrow(partial(_celled, index=index), "key long, m long, vec_id long, v array<double>, d int, cell int"), f"celled{d}")
    if index.probes is None:
        index.radii = [np.zeros(len(b)) for b in index.books]
        for r in celled.mapInArrow(partial(_radii, index=index), "half int, codeword int, r double").groupBy("half", "codeword").agg(F.max("r").alias("r")).collect():  # a row per codeword
            index.radii[r["half"]][r["codeword"]] = r["r"] + 1e-9
    width = len(index.books[1])

    # which cells meet, each pair in the region of its smaller cell; per region blocks of its own vectors and of those they meet
    filled = ws.write(celled.groupBy("cell").agg(F.count("*").alias("n")), f"filled{d}")
    sizes = np.zeros(len(index.books[0]), np.int64)
    for r in filled.groupBy(F.expr(f"cell div {width}").alias("codeword")).agg(F.sum("n").alias("n")).collect():  # a row per codeword
        sizes[r["codeword"]] = r["n"]
    most_met = min(MET, max(256, BYTES // (8 * d)))
    most_own = min(OWN, max(128, most_met // 2))
    index.region = regions(index.books[0], sizes, most_own)
    visits = ws.write(filled.select("cell").mapInArrow(partial(_traversed, index=index), "cell int, other int, g int, reach double"), f"visits{d}")
    mine = visits.filter("reach is not null").select("g", "cell", "reach").join(filled, "cell")
    met = visits.select("g", F.greatest("cell", "other").alias("cell")).distinct().join(filled, "cell")
    blocks = mine.groupBy("g").agg(F.ceil(F.sum("n") / most_own).cast("int").alias("ob")).join(met.groupBy("g").agg(F.ceil(F.sum("n") / most_met).cast("int").alias("mb")), "g")
    plan = mine.select("g", "cell").withColumn("own", F.lit(True)).unionByName(met.select("g", "cell").withColumn("own", F.lit(False))).join(blocks, "g").join(mine.select("cell", "reach"), "cell")

    # a vector goes to a block of its kind, and to all blocks of the other kind in the region
    packed = celled.select("key", "m", "v", "cell").mapInArrow(partial(_packed, dtype=dtype), "key long, m long, cell int, x binary")
    placed = packed.join(ws.write(plan, f"plan{d}"), "cell")
    spread = lambda c, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(c).cast("long")).cast("int")
    dealt = placed.withColumn("at", F.when(F.col("own"), spread("ob", 1)).otherwise(spread("mb", 2))).withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("mb")).otherwise(F.col("ob")) - 1)))
    work = dealt.select("g", F.when(F.col("own"), F.col("at")).otherwise(F.col("to")).alias("o"), F.when(F.col("own"), F.col("to")).otherwise(F.col("at")).alias("t"), "own", "key", "m", "cell", "reach", "x")
    shared = spark.sparkContext.broadcast(index)  # codebooks of a bounded sample
    return ws.write(work.groupBy("g", "o", "t").applyInArrow(lambda rows: _block_links(rows, shared.value, threshold, dtype), "a long, b long, n long"), f"found{d}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, target: float = 0.99, sample: int = 20_000, per_cell: int = 48, seed: int = 5) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Pairs with cosine at or above ``threshold`` link.

    ``target`` is the share of links to be found, 1 for all. A codebook has at most a codeword for 16 vectors of the
    sample, beyond which cells grow.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "imi")
    rows = usable(vectors).select("vec_id", "d", F.when(F.exists("v", lambda x: x != 0), F.col("v")).alias("v"))
    rows = ws.write(rows.select("vec_id", "v", "d", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key")), "rows")
    nodes = ws.write(rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v"), F.first("d").alias("d")), "nodes")
    dtype = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    found = spark.createDataFrame([], "a long, b long, n long")
    for d in lengths(nodes):
        some = nodes.filter(F.col("d") == d)
        if n := some.count():
            found = found.unionByName(_found(ws, some, d, n, threshold, target, sample, per_cell, seed, dtype))
    links = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    comp = connected_components(ws, found.filter("b is not null").select("a", "b"), "cc").withColumnRenamed("node", "key")
    named = nodes.select("key", "m", "vec_id").join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "component").join(links, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
