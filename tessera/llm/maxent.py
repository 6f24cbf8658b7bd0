"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A text is its words (A-Z in lower case) and one end. Every word has a type: its own, if it is among the heads (words
with ``HEAD_LEAST`` training tokens or more, the ``HEADS_MOST`` most frequent of them), else one by the hash of its
last three bytes. Types are grouped into classes by the words that precede them (a table summed over the training
texts; k-means), and each class into ``WIDTH`` cells: its most frequent types have a cell each, the others share
``SHARED`` cells. Then

    p(word | history) = p(class | history) * p(cell | class, history) * (c(word) + 0.1) / (N_cell + 0.1 * (V_cell + 1))

where c counts training tokens, N_cell and V_cell are tokens and distinct words of the cell, and each cell has one
unseen word, so that the probabilities add up to 1. Both factors are softmaxes over sums of weights of hashed features:
a bias, the last type, the last two, and the one before the last (a skip); those of the second factor also hold the
class. Biases start at the counts, so the untrained model is the smoothed unigram one.

Training is by distributed gradient updates. Training texts are dealt to shards by a hash of doc_id and words; a shard
has about ``shard_tokens`` tokens, whatever the size of the corpus, and shards are dealt to ``rounds`` rounds, so each
text is used once. In a round each shard runs minibatch steps (AdaGrad) from the same weights over its texts in the
order of their hashes, and weights and step sizes are averaged by row, weighted by the tokens that met the row. Nothing
depends on partitions, and a round makes as many steps on a large corpus as on a small one. Weight rows grow with the
training tokens (a row per feature kind and about 128 tokens) up to ``bits_most``: weights are broadcast, 25 MB then.

Counts of the most frequent words, a bounded number, go to the tasks; the rest of the occurrences meet their counts in
a join, where no key is frequent.

Defined results: null text is the empty text, whose only token is the end. Repeated rows count as often as they
occur and give a row each. A null doc_id is held out. Without training texts c, N and V are 0. A very long text is a
row of ids like others, trained and scored in portions. Other columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Workspace, hash_words, mix64, partitions, ranges, text_batches, text_slices, tidy

HEADS_MOST, HEAD_LEAST, SUFFIXES, CONTEXTS = 8192, 16, 4096, 32
END, START, TYPES = SUFFIXES, SUFFIXES + 1, SUFFIXES + 2 + HEADS_MOST  # types: by suffix, the end, the start, heads
WIDTH, SHARED = 32, 8  # classes (the last is the end's), cells of each; the cells that several types share
KINDS = 3  # of hashed features
KNOWN = 200_000  # words whose counts are broadcast
RATE = 0.25  # of the gradient steps
PORTION = 1 << 18  # tokens whose features are formed at once
END_HASH = np.array([0x0E4D_0E4D_0E4D_0E4D], U64)


def learned(doc_id: Column) -> Column:
    """Whether a document is learned from; one with a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix type of every token, ends included, and where each text starts."""
    w = hash_words(texts)
    sfx = np.zeros(len(w.hashes), np.int64)
    if len(sfx):
        last = w.ends - 1
        key = w.data[last].astype(U64)
        for back in (1, 2):
            key = key * U64(256) + np.where(last - back >= w.starts, w.data[np.maximum(last - back, 0)], 0).astype(U64)
        sfx = (mix64(key) % U64(SUFFIXES)).astype(np.int64)
    at = w.doc_ptr[1:]
    return np.insert(w.hashes, at, END_HASH[0]), np.insert(sfx, at, -1), w.doc_ptr + np.arange(len(w.doc_ptr))


def _summed(h: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, s[first], np.bincount(inv, c, len(u)).astype(np.int64)


@tidy
def _counts(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of training tokens."""
    held: list[tuple] = []
    n = 0

    def out() -> pa.RecordBatch:
        h, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], names=["h", "sfx", "c"])

    for batch in batches:
        for a, b in text_slices(batch.column("text")):
            h, s, _ = _tokens(batch.column("text").slice(a, b - a))
            held.append(_summed(h, s, np.ones(len(h))))
            n += len(held[-1][0])
            if n > most:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > most // 2:
                    yield out()
                    held, n = [], 0
    if held:
        held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        yield out()


class Lookup:
    """Sorted hashes of the known words with their counts and, for the heads among them, types."""

    def __init__(self, h: np.ndarray, c: np.ndarray, head: np.ndarray):
        order = np.argsort(h)
        self.h, self.c, self.head = h[order], c[order], head[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


_ENCODED = "uid long, doc_id long, train boolean, key long, n_tokens long, n_known long, log_sum double, types binary, rare array<long>, times array<int>"


@tidy
def _encoded(batches: Iterator[pa.RecordBatch], lookup) -> Iterator[pa.RecordBatch]:
    """Types of all tokens, the summed logarithm of the known words' counts, and the other words with their counts."""
    known: Lookup = lookup.value
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            h, s, ptr = _tokens(texts.slice(a, b - a))
            u, inv = np.unique(h, return_inverse=True)
            at = known.find(u)[inv]
            is_known = at >= 0
            head = np.where(is_known, known.head[at] if len(known.h) else -1, -1)
            types = np.where(s < 0, END, np.where(head >= 0, START + 1 + head, s)).astype(np.uint16)
            logs = np.where(is_known, np.log10((known.c[at] if len(known.h) else 0) + 0.1), 0.0)
            doc = np.repeat(np.arange(b - a), np.diff(ptr))
            key = mix64(np.add.reduceat(h * (np.arange(len(h)) - ptr[doc] + 1).astype(U64), ptr[:-1])).view(np.int64)  # of a text's words in order
            cols = {"log_sum": np.bincount(doc, logs, b - a), "n_known": np.bincount(doc, is_known, b - a).astype(np.int64)}
            r, rd = h[~is_known], doc[~is_known]
            order = np.lexsort((r, rd))
            r, rd = r[order], rd[order]
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (rd[1:] != rd[:-1])))) if len(r) else np.zeros(0, np.int64)
            offs = pa.array(np.searchsorted(rd[new], np.arange(b - a + 1)), pa.int32())
            n = b - a
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)), batch.column("doc_id").slice(a, n), batch.column("train").slice(a, n), pa.array(key), pa.array(np.diff(ptr)), pa.array(cols["n_known"]), pa.array(cols["log_sum"]),
                    pa.array([types[i:j].tobytes() for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(offs, pa.array(r[new].view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(np.diff(new, append=len(r)).astype(np.int32))),
                ],
                names=["uid", "doc_id", "train", "key", "n_tokens", "n_known", "log_sum", "types", "rare", "times"],
            )
            uid += n


def _histories(types: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All types of some texts, the three before each (columns; START before the text), and each text's length."""
    n = np.array([len(t) // 2 for t in types], np.int64)
    x = np.frombuffer(b"".join(types), np.uint16).astype(np.int64)
    pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    before = np.full((len(x), 3), START)
    for k in range(3):
        before[k + 1 :, k] = x[: len(x) - k - 1]
        before[pos <= k, k] = START
    return x, before, n


def context_of(prev: np.ndarray) -> np.ndarray:
    return (mix64(prev.astype(U64) + U64(77)) % U64(CONTEXTS)).astype(np.int64)


@tidy
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each type follows each group of types."""
    total = np.zeros(TYPES * CONTEXTS, np.int64)
    for batch in batches:
        lists = batch.column("types").to_pylist()
        for k in range(0, len(lists), 500):
            x, before, _ = _histories(lists[k : k + 500])
            total += np.bincount(x * CONTEXTS + context_of(before[:, 0]), minlength=len(total))
    total = total.reshape(TYPES, CONTEXTS)
    at = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(CONTEXTS))], names=["type", *(f"n{k}" for k in range(CONTEXTS))])


def classes_of(table: np.ndarray, k: int = WIDTH - 1, seed: int = 11, rounds: int = 25) -> np.ndarray:
    """k-means of the types by the square roots of their context shares, weighted by the logarithm of their counts; the end is a class of its own."""
    rng = np.random.default_rng(seed)
    n = table.sum(1)
    x = np.sqrt(table / np.maximum(n, 1)[:, None])
    x -= np.sqrt(table.sum(0) / max(n.sum(), 1))
    w = np.log1p(n)
    w[[END, START]] = 0
    if not w.any():
        out = np.zeros(len(table), np.int64)
    else:
        centres = x[rng.choice(len(x), k, p=w / w.sum())]
        for _ in range(rounds):
            out = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            size = np.bincount(out, w, k)
            for j in range(x.shape[1]):
                centres[:, j] = np.where(size > 0, np.bincount(out, w * x[:, j], k) / np.maximum(size, 1e-12), centres[:, j])
    out[[END, START]] = k
    return out


def cells_of(classes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The cell of each type within its class: the types with most tokens have one each, the others share the last ones."""
    own = WIDTH - SHARED
    order = np.lexsort((np.arange(len(classes)), -tokens, classes))
    first = np.searchsorted(classes[order], classes[order])
    rank = np.empty(len(classes), np.int64)
    rank[order] = np.arange(len(classes)) - first
    cell = np.where((rank < own) & (tokens > 0), rank, own + np.arange(len(classes)) % SHARED)
    cell[END] = 0
    return cell


@dataclass(frozen=True)
class Model:
    """Classes and cells of the types, the log10 sizes of cells, and the weights.

    Rows of ``theta`` (WIDTH wide) and ``steps`` (summed squared gradients): the classes' biases; the biases of the
    cells of each class; then 1 << bits for each kind of feature, of classes and then of cells.
    """

    classes: np.ndarray
    cells: np.ndarray
    log_size: np.ndarray
    bits: int
    theta: np.ndarray
    steps: np.ndarray

    @classmethod
    def untrained(cls, classes: np.ndarray, per_type: np.ndarray, bits: int) -> Model:
        """``per_type``: training tokens and distinct words of each type."""
        cells = cells_of(classes, per_type[:, 0])
        at = classes * WIDTH + cells
        at[START] = at[END]
        size = (np.bincount(at, per_type[:, 0], WIDTH**2) + 0.1 * (np.bincount(at, per_type[:, 1], WIDTH**2) + 1)).reshape(WIDTH, WIDTH)
        there = np.bincount(at, minlength=WIDTH**2).reshape(WIDTH, WIDTH) > 0
        theta = np.zeros((1 + WIDTH + 2 * (KINDS << bits), WIDTH), np.float32)
        theta[0] = np.log(np.where(there, size, 0).sum(1) + 1e-30)
        theta[1 : 1 + WIDTH] = np.where(there, np.log(size), -1e9)  # cells without types take nothing
        return cls(classes, cells, np.log10(size), bits, theta, np.zeros(len(theta), np.float32))

    def rows(self, before: np.ndarray, of: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per kind of feature the row of each token, for its class and for its cell in the class ``of``."""
        a, b = (before[:, i].astype(U64) for i in range(2))
        keys = [a + U64(1), (a * U64(TYPES) + b) + U64(1 << 40), b + U64(1 << 41)]
        shift, first, second = U64(64 - self.bits), [], []
        for x in keys:
            h = mix64(x)
            first.append((h >> shift).astype(np.uint16))
            second.append((((h ^ of.astype(U64)) * U64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint16))
        return first, second

    def offsets(self, second: bool) -> list[int]:
        return [1 + WIDTH + ((KINDS * second + f) << self.bits) for f in range(KINDS)]


_ONES = np.ones(WIDTH, np.float32)
STEP = 1024  # tokens whose outcomes are formed at once, so that they stay near the processor


def _outcomes(model: Model, bias: np.ndarray, rows: list[np.ndarray], second: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some tokens at a time (in buffers that the next ones take): summed weights of the WIDTH outcomes, their
    exponentials, and the sums of these."""
    z_all, w_all, e_all = np.empty((3, min(STEP, len(bias)), WIDTH), np.float32)
    for i in range(0, len(bias), STEP):
        at = slice(i, min(i + STEP, len(bias)))
        z, w, e = (x[: at.stop - i] for x in (z_all, w_all, e_all))
        np.take(model.theta, bias[at], 0, z, "clip")
        for r, start in zip(rows, model.offsets(second), strict=True):
            z += np.take(model.theta, r[at].astype(np.intp) + start, 0, w, "clip")
        with np.errstate(over="ignore"):
            total = np.exp(z, e) @ _ONES
        if not (np.isfinite(total) & (total > 1e-30)).all():
            z -= z.max(1, keepdims=True)
            total = np.exp(z, e) @ _ONES
        yield at, z, e, total


def log_softmax(model: Model, bias: np.ndarray, rows: list[np.ndarray], second: bool) -> np.ndarray:
    """Log probabilities (natural) of the WIDTH outcomes of each token."""
    return np.concatenate([z - np.log(total)[:, None] for _, z, _, total in _outcomes(model, bias, rows, second)])


def _log_of(model: Model, bias: np.ndarray, rows: list[np.ndarray], second: bool, y: np.ndarray) -> np.ndarray:
    """Those of the outcomes y."""
    out = np.empty(len(y))
    for at, z, _, total in _outcomes(model, bias, rows, second):
        out[at] = z.ravel().take(np.arange(len(z)) * WIDTH + y[at])
        out[at] -= np.log(total)
    return out


def _sums(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct entries of r, how often each occurs, and the sums of its rows of g."""
    order = np.argsort(r, kind="stable")
    r = r[order]
    new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    n = np.diff(new, append=len(r))
    total = np.take(g, order[new], 0)
    if len(several := np.flatnonzero(n > 1)):
        m = n[several]
        start = np.cumsum(m) - m
        total[several] = np.add.reduceat(np.take(g, order[ranges(new[several], m)], 0), start)
    return r[new].astype(np.intp), n, total


def _descend(model: Model, seen: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], second: bool, y: np.ndarray, rate: float, g_all: np.ndarray) -> None:
    """One step of one factor; the model's arrays change. ``g_all`` is a buffer."""
    g = g_all[: len(y)]
    for at, _, e, total in _outcomes(model, bias, rows, second):
        np.divide(e, total[:, None], g[at])
        g[at].reshape(-1)[np.arange(len(e)) * WIDTH + y[at]] -= 1
    for r, start in zip([bias.astype(np.uint16), *rows], [0, *model.offsets(second)], strict=True):
        u, n, total = _sums(g, r)
        u += start
        total /= np.sqrt(n, dtype=np.float32)[:, None]  # rows with many tokens step as steadily as rare ones
        steps = model.steps[u] + (total * total) @ _ONES / WIDTH
        total *= (rate / np.sqrt(steps + np.float32(0.1)))[:, None]
        model.steps[u] = steps
        model.theta[u] = np.take(model.theta, u, 0) - total
        seen[u] += n


def train_shard(model: Model, types: list[bytes], rate: float) -> tuple[Model, np.ndarray]:
    """The model after minibatch steps over some texts, and how many tokens met each row."""
    new = replace(model, theta=model.theta.copy(), steps=model.steps.copy())
    seen = np.zeros(len(model.theta), np.int64)
    total = sum(len(t) // 2 for t in types)
    size = min(max(total // 64, 256), 8192)  # short shards still make several steps
    g = np.empty((size, WIDTH), np.float32)
    for x, before in _portions(types):
        of, cell = model.classes[x], model.cells[x]
        first, second = model.rows(before, of)
        for i in range(0, len(x), size):
            at = slice(i, i + size)
            _descend(new, seen, np.zeros(len(of[at]), np.int64), [r[at] for r in first], False, of[at], rate, g)
            _descend(new, seen, 1 + of[at], [r[at] for r in second], True, cell[at], rate, g)
    return new, seen


def _portions(types: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Types and histories of texts, in order, about PORTION tokens at a time (a text may be cut)."""
    held, n = [], 0
    for t in [*types, None]:
        if held and (t is None or n + len(t) // 2 > PORTION):
            x, before, _ = _histories(held)
            for i in range(0, len(x), PORTION):
                yield x[i : i + PORTION], before[i : i + PORTION]
            held, n = [], 0
        if t is not None:
            held.append(t)
            n += len(t) // 2


_CHANGES = "row int, w double, s double, " + ", ".join(f"d{c} float" for c in range(WIDTH))


def _trained(weights, rate: float) -> Callable[[pa.Table], pa.Table]:
    """From a shard's texts the changes of the rows that they met, times the tokens that met them."""

    def run(shard: pa.Table) -> pa.Table:
        model: Model = weights.value
        shard = shard.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        new, seen = train_shard(model, shard.column("types").to_pylist(), rate)
        at = np.flatnonzero(seen)
        w = seen[at].astype(np.float64)
        change = (new.theta[at] - model.theta[at]) * w[:, None].astype(np.float32)
        cols = [pa.array(at.astype(np.int32)), pa.array(w), pa.array((new.steps[at] - model.steps[at]) * w), *(pa.array(np.ascontiguousarray(change[:, c])) for c in range(WIDTH))]
        return pa.Table.from_arrays(cols, names=["row", "w", "s", *(f"d{c}" for c in range(WIDTH))])

    return run


def averaged(model: Model, changes: pa.Table) -> Model:
    """The model after a round: ``changes`` has, per row, weighted sums over the shards and the sum of the weights."""
    theta, steps = model.theta.copy(), model.steps.copy()
    if changes.num_rows:
        at, w = changes.column("row").to_numpy(), changes.column("w").to_numpy()
        for c in range(WIDTH):
            theta[at, c] += changes.column(f"d{c}").to_numpy() / w
        steps[at] += changes.column("s").to_numpy() / w
    return replace(model, theta=theta, steps=steps)


def model_scores(model: Model, types: list[bytes]) -> np.ndarray:
    """Per text the log10 probability of its classes and cells, less the log10 sizes of the cells."""
    n = np.array([len(t) // 2 for t in types], np.int64)
    each = []
    for x, before in _portions(types):
        of, cell = model.classes[x], model.cells[x]
        first, second = model.rows(before, of)
        p = _log_of(model, np.zeros(len(x), np.int64), first, False, of) + _log_of(model, 1 + of, second, True, cell)
        each.append(p / np.log(10) - model.log_size[of, cell])
    return np.add.reduceat(np.concatenate(each), np.cumsum(n) - n) if each else np.zeros(0)  # every text has a token


_SCORED = ["uid", "doc_id", "train", "n_tokens", "n_known", "log_sum"]


@tidy
def _scored(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = model_scores(weights.value, batch.column("types").to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _SCORED), pa.array(out)], names=[*_SCORED, "model_sum"])


def score(docs: DataFrame, rounds: int = 4, rate: float = RATE, shard_tokens: int = 1 << 21, bits_most: int = 15) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    if not 1 <= bits_most <= 16:
        raise ValueError("bits_most is between 1 and 16")
    spark = docs.sparkSession
    sc = spark.sparkContext
    text_batches(spark)
    ws = Workspace(spark, "maxent")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learned(F.col("doc_id")).alias("train"))

    vocab = rows.filter("train").select("text").mapInArrow(_counts, "h long, sfx int, c long").groupBy("h").agg(F.min("sfx").alias("sfx"), F.sum("c").alias("c"))
    vocab = ws.write(vocab, "vocab")
    steps = sorted(vocab.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect(), reverse=True)  # a row per power of two
    n_all, v_all = sum(r["n"] for r in steps), sum(r["v"] for r in steps)
    least, held = 1 << 62, 0
    for r in steps:
        held += r["v"]
        if held > KNOWN:
            break
        least = 1 << r["b"]
    known = vocab.filter(F.col("c") >= least).select("h", "sfx", "c").toArrow()  # at most KNOWN rows
    h, sfx, c = (known.column(k).to_numpy() for k in ("h", "sfx", "c"))
    head = np.full(len(h), -1)
    words = np.flatnonzero((sfx >= 0) & (c >= HEAD_LEAST))
    top = words[np.lexsort((h[words], -c[words]))[:HEADS_MOST]]
    head[top] = np.arange(len(top))
    lookup = sc.broadcast(Lookup(h.view(U64), c, head))
    encoded = ws.write(rows.mapInArrow(partial(_encoded, lookup=lookup), _ENCODED), "encoded")

    # classes, and tokens and words of each type
    train = encoded.filter("train")
    found = train.select("types").mapInArrow(_contexts, "type long, " + ", ".join(f"n{k} long" for k in range(CONTEXTS))).groupBy("type").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(CONTEXTS)]).toArrow()  # a row per type
    table = np.zeros((TYPES, CONTEXTS))
    if found.num_rows:
        table[found.column("type").to_numpy()] = np.stack([found.column(f"n{k}").to_numpy() for k in range(CONTEXTS)], 1)
    sized = vocab.groupBy("sfx").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # a row per suffix type
    per_type = np.zeros((TYPES, 2))
    at = sized.column("sfx").to_numpy().astype(np.int64)
    per_type[np.where(at < 0, END, at)] = np.stack((sized.column("n").to_numpy(), sized.column("v").to_numpy()), 1)
    heads = np.stack((c[top], np.ones(len(top))), 1)
    np.subtract.at(per_type, sfx[top], heads)
    per_type[START + 1 : START + 1 + len(top)] = heads
    bits = int(np.clip(np.ceil(np.log2(max(n_all, 1) / 128)), 8, bits_most))
    model = Model.untrained(classes_of(table), per_type, bits)

    # training: shards of texts, the same whatever the partitions
    per_round = max(1, -(-n_all // (rounds * shard_tokens)))
    dealt = train.select("key", "doc_id", "types", F.pmod(F.xxhash64("doc_id", "key"), F.lit(rounds * per_round)).alias("shard"))
    tasks = min(per_round, max(partitions(spark), sc.defaultParallelism))
    for k in range(rounds):
        weights = sc.broadcast(model)
        shards = dealt.filter(F.col("shard") % rounds == k).repartition(tasks, "shard").groupBy("shard")
        changes = shards.applyInArrow(_trained(weights, rate), _CHANGES).groupBy("row")
        model = averaged(model, changes.agg(F.sum("w").alias("w"), F.sum("s").alias("s"), *[F.sum(f"d{j}").cast("float").alias(f"d{j}") for j in range(WIDTH)]).toArrow())  # a row per weight row
        weights.destroy()

    weights = sc.broadcast(model)
    scored = encoded.mapInArrow(partial(_scored, weights=weights), "uid long, doc_id long, train boolean, n_tokens long, n_known long, log_sum double, model_sum double")
    # the other words: none is frequent, so no key of the join is
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    counts = vocab.filter(F.col("c") < least).select("h", "c")
    seen = rare.join(counts, "h", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    out = scored.join(seen, "uid", "left")
    logs = F.col("log_sum") + F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_all + 0.1 * (v_all + 1))))).alias("base_score"), (logs + F.col("model_sum")).alias("score"),
    )
