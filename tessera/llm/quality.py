"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts (lengths, shares of kinds of bytes, repetition of words and lines) are standardised and
mapped to random Fourier features, which approximate a Gaussian kernel. Each partition of the labelled rows sums its
part of the normal equations; the driver adds a bounded number of such parts and solves. Raw scores of labelled rows
kept out of that fit are counted in a fixed grid, and pooling adjacent violators turns the grid into probabilities.

Labelled rows beyond ``most`` are thinned by a hash to about that many (the documented bound of the fit). Labels,
lang, source and doc_id are no inputs of a score.

Defined results: null counts as the empty text, which gets a score like any other. Repeated rows give a row each;
a document with several labels counts with their mean. A null doc_id is never learned from. Without any usable
label every score is 0.5. Other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, _text_buffers, hash_segments, hash_words, text_batches, text_slices, tidy

_KIND = np.zeros(256, np.uint8)  # 0: other letters and bytes
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 4
_KIND[ord("!")] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7
N_STATS = 18
GRID, LOW, HIGH = 2048, -0.5, 1.5


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers per text."""
    words = hash_words(texts)
    n = len(texts)
    raw, offs = _text_buffers(texts)
    size = np.maximum(np.diff(offs), 1).astype(float)

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[offs[1:]] - c[offs[:-1]]

    kinds = [per_text(_KIND[raw] == k) / size for k in range(1, 8)]
    n_words = np.diff(words.doc_ptr)
    some = np.maximum(n_words, 1).astype(float)
    doc = np.repeat(np.arange(n), n_words)
    distinct, top = _distinct(doc, words.hashes, n)
    lens = (words.ends - words.starts).astype(float)
    mean_len = np.bincount(doc, lens, n) / some
    var_len = np.maximum(np.bincount(doc, lens**2, n) / some - mean_len**2, 0)
    last = _KIND[words.data[words.ends - 1]] if len(lens) else np.zeros(0, np.uint8)
    marked = np.bincount(doc[last == 6], minlength=n) / some
    shouted = np.bincount(doc[last == 5], minlength=n) / some
    # lines
    cut = raw == 10
    at = offs[1:][np.diff(offs) > 0] - 1
    cut[at] = True
    ends = np.flatnonzero(cut) + 1
    line_doc = np.searchsorted(offs, ends - 1, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    d_lines, _ = _distinct(line_doc, hash_segments(raw, ends) if len(ends) else np.zeros(0, np.uint64), n)
    out = [np.log1p(np.diff(offs)), np.log1p(n_words), mean_len, np.sqrt(var_len), distinct / some, top / some, marked, shouted, d_lines / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1)), *kinds, (n_words == 0).astype(float)]
    return np.stack(out, 1)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per text, and how often the most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]))))
    runs = np.diff(new, append=len(h))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    return np.bincount(d[new], minlength=n), top


@tidy
def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            x = statistics(texts.slice(a, b - a))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "x"])


@dataclass(frozen=True)
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None
    knots: np.ndarray | None
    values: np.ndarray | None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), z, np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        s = self.raw(x)
        return np.clip(np.interp(s, self.knots, self.values), 0, 1) if self.knots is not None else np.clip(s, 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _equations(batches: Iterator[pa.RecordBatch], model: Quality) -> Iterator[pa.RecordBatch]:
    m = len(model.phase) + N_STATS + 1
    a, b = np.zeros((m, m)), np.zeros(m)
    for batch in batches:
        z, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
        a += z.T @ z
        b += z.T @ y
    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])


def _counted(batches: Iterator[pa.RecordBatch], model: Quality) -> Iterator[pa.RecordBatch]:
    n, s = np.zeros(GRID), np.zeros(GRID)
    for batch in batches:
        k = np.clip(((model.raw(_matrix(batch)) - LOW) / (HIGH - LOW) * GRID).astype(int), 0, GRID - 1)
        n += np.bincount(k, minlength=GRID)
        s += np.bincount(k, batch.column("y").to_numpy(zero_copy_only=False), GRID)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], names=["cell", "n", "s"])


def isotonic(n: np.ndarray, s: np.ndarray) -> list[tuple[int, int, float]]:
    """Pool adjacent violators over cells with n rows of label sum s: (first cell, last cell, mean) of each block."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(n):
        blocks.append([k, k, n[k], s[k]])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, m, t = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += m
            blocks[-1][3] += t
    return [(int(a), int(b), t / m) for a, b, m, t in blocks]


def learnable(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from; a null doc_id's may not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, width: int = 256, most: int = 100_000, ridge: float = 1e-2, seed: int = 7, parts: int = 16) -> Quality:
    """Learn from ``labels`` (doc_id, quality) and the statistics (doc_id, x) of documents."""
    lab = labels.filter(F.col("quality").isNotNull() & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    total = lab.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    if total > most:
        lab = lab.filter(u < int(most / total * (1 << 30)))
    rows = stats.join(lab, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)))
    rng = np.random.default_rng(seed)
    omega, phase = rng.standard_normal((N_STATS, width)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, width)
    sums = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    blank = Quality(np.zeros(N_STATS), np.ones(N_STATS), omega, phase, None, None, None)
    if not sums["n"]:
        return blank
    mean = np.array([sums[f"avg{i}"] for i in range(N_STATS)])
    scale = np.array([sums[f"stddev_pop{i}"] for i in range(N_STATS)])
    base = Quality(mean, np.where(scale > 1e-9, scale, 1.0), omega, phase, None, None, None)
    rows = rows.repartition(parts).persist()
    got = rows.filter("fold <> 0").mapInArrow(partial(_equations, model=base), "a binary, b binary").toArrow()  # `parts` rows
    m = width + N_STATS + 1
    a = sum(np.frombuffer(v, np.float64) for v in got.column("a").to_pylist()).reshape(m, m)
    b = sum(np.frombuffer(v, np.float64) for v in got.column("b").to_pylist())
    if not a.any():
        rows.unpersist()
        return blank
    beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1] * 1e-3) * np.eye(m), b)
    fitted = Quality(base.mean, base.scale, omega, phase, beta, None, None)
    cells = rows.filter("fold = 0").mapInArrow(partial(_counted, model=fitted), "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    rows.unpersist()
    n, s = np.zeros(GRID), np.zeros(GRID)
    n[cells.column("cell").to_numpy()], s[cells.column("cell").to_numpy()] = cells.column("n").to_numpy(), cells.column("s").to_numpy()
    if not n.any():
        return fitted
    blocks = isotonic(n, s)
    centre = lambda k: LOW + (k + 0.5) * (HIGH - LOW) / GRID
    knots = [x for first, last, _ in blocks for x in ((centre(first), centre(last)) if last > first else (centre(first),))]
    values = [v for first, last, v in blocks for _ in range(1 + (last > first))]
    return Quality(base.mean, base.scale, omega, phase, beta, np.array(knots), np.array(values))


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stats_rows, "doc_id long, x array<double>")


@tidy
def _scored(batches: Iterator[pa.RecordBatch], model: Quality) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0)."""
    text_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.write(document_statistics(docs), "stats")
    model = fit(stats, labels, **params)
    out = stats.mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


@tidy
def _good(batches: Iterator[pa.RecordBatch], model: Quality, threshold: float, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text)
        keep = [model.score(statistics(texts.slice(a, b - a))) >= threshold for a, b in text_slices(texts)]
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is at least ``threshold``; texts aren't shuffled."""
    text_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "quality")
    model = fit(ws.write(document_statistics(docs), "stats"), labels, **params)
    ws.drop()
    return docs.mapInArrow(partial(_good, model=model, threshold=threshold, text="text"), docs.schema)
