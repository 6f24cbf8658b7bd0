"""Shared plumbing of the training-data operators: working folders, word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- working folder
_OWN: dict[str, str] = {}  # folders of local sessions without the setting


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local-mode session may go without it; it then gets a folder of its own.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"set {key} to a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tessera-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


_MADE: contextvars.ContextVar[list[Workspace] | None] = contextvars.ContextVar("made", default=None)
_LEFT: dict[str, Workspace] = {}  # by root


class Workspace:
    """Tables of one operator call, as Parquet below the shared folder.

    A written table cuts the lineage: a lost executor costs the current stage only. Results read from these tables, so
    they stay until ``scratch`` ends, or else the driver program.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._conf, self._path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        if not _LEFT:
            atexit.register(_drop_left)
        _LEFT[self.root] = self
        if (made := _MADE.get()) is not None:
            made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables nothing reads any more; without names, the whole workspace."""
        for p in [self.path(t) for t in tables] or [self.root]:
            path = self._path(p)
            path.getFileSystem(self._conf).delete(path, True)
        if not tables:
            _LEFT.pop(self.root, None)


def _drop_left() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        for ws in list(_LEFT.values()):
            ws.drop()


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Workspaces of the operators called within are deleted at the end; write results before it."""
    made: list[Workspace] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for ws in made:
            ws.drop()


def tidy(f):
    """A batch function whose worker gives memory back when a partition ends; idle workers stay beside the JVM."""

    @functools.wraps(f)
    def run(*args, **params):
        try:
            yield from f(*args, **params)
        finally:
            trim()

    return run


def trim() -> None:
    """Give memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], by: str, rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, a row for each of the keys and ``members``, how many rows of ``big`` have them.

    Keys with many members are dealt over several tasks by a hash of the column ``by``. There are at most 100,000 such
    keys, whatever the number of ``rows`` of ``big``, and they are broadcast.
    """
    most = max(512, rows // 100_000)
    hot = F.broadcast(small.filter(F.col("members") > most).select(*keys, F.ceil(F.col("members") / most).cast("int").alias("_parts")))
    left = big.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts").cast("long")).cast("int"), F.lit(0))).drop("_parts")
    right = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("members") > most, F.ceil(F.col("members") / most).cast("int") - 1).otherwise(0))))
    return left.join(right, [*keys, "_part"], how).drop("_part", "members")


def text_batches(spark: SparkSession) -> None:
    """Let workers get 2,000 texts at a time, unless the session says how many: with Spark's own 10,000 rows a worker and
    the JVM beside it hold a few times that many whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


# ---------------------------------------------------------------- word hashing
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_POW = np.ones(1, U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(256, 1 << (n - 1).bit_length())
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        _POW = np.multiply.accumulate(steps)
    return _POW


@dataclass
class Words:
    """The words of some texts. ``hashes`` has a 64-bit hash per word; words of text i are doc_ptr[i]:doc_ptr[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc_ptr: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    o = np.frombuffer(offs, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def hash_words(texts: pa.Array, lower: bool = True, cut_stops: bool = False) -> Words:
    """Split texts at runs of ASCII white space (0x20, 0x09-0x0D) and hash each word, all in numpy.

    ``lower`` maps A-Z to a-z first; ``cut_stops`` also cuts between an ASCII letter and a following ``.`` or ``,``. Equal words get equal hashes; unequal ones collide with a chance of 2^-64.
    """
    raw, offs = _text_buffers(texts)
    if lower:
        raw = _LOWER[raw]
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64))
    inside = ~_SPACE[raw]
    before = np.concatenate(([False], inside[:-1]))
    before[offs[:-1][offs[:-1] < len(raw)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[offs[1:][offs[1:] > 0] - 1] = False
    if cut_stops:
        cut = np.flatnonzero(before & _STOP[raw])
        cut = cut[_LETTER[raw[cut - 1]]]
        before[cut] = False
        after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    lens = ends - starts
    ptr = np.cumsum(lens) - lens
    if len(starts):
        at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(ptr, lens)
        v = _BYTE[raw[inside]]
        v *= _powers(int(lens.max()))[at]
        h = mix64(np.add.reduceat(v, ptr) + lens.astype(U64))
    else:
        h = np.zeros(0, U64)
    return Words(raw, starts, ends, h, np.searchsorted(starts, offs))


def text_slices(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one row), so that numpy's temporaries stay small."""
    _, offs = _text_buffers(texts) if len(texts) else (None, np.zeros(1, np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(offs, offs[a] + most, "right")) - 1
        b = min(max(b, a + 1), len(texts))
        yield a, b
        a = b


# ---------------------------------------------------------------- connected components
def connected_components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the least node reachable.

    Alternating large-star and small-star steps; each is a minimum per node (summed before the shuffle) and an
    equi-join that deals out nodes with many edges, and its result is written to the shared folder. Nothing reaches the
    driver but two sums a round.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def step(e: DataFrame, both: bool, rows: int) -> DataFrame:
        pairs = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            pairs = pairs.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("members")).select("u", F.least("u", "m").alias("m"), "members")
        joined = join_spread(pairs, least, ["u"], "v", rows)
        if both:  # large star: larger neighbours move to the least one
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # small star: smaller neighbours and the node itself
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = ws.write(e, f"{tag}0")
    was, n = None, 0
    while (now := state(e)) != was:
        was, n = now, n + 1
        rows = 2 * now[0]  # the edges from both ends; a step makes no more
        large = ws.write(step(e, True, rows), f"{tag}{n}large")  # written, as each step names its edges three times
        e = ws.write(step(large, False, rows), f"{tag}{n}")
        ws.drop(f"{tag}{n}large", f"{tag}{n - 1}")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------- ids of words
def hash_segments(raw: np.ndarray, ends: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """64-bit hashes of consecutive non-empty byte segments that cover ``raw``; about ``most`` bytes are worked on at once."""
    out, lens, a, start = np.empty(len(ends), U64), np.diff(ends, prepend=0), 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, start + most, "right")))
        n = lens[a:b]
        ptr = np.cumsum(n) - n
        at = np.arange(int(ends[b - 1]) - start, dtype=np.int64) - np.repeat(ptr, n)
        v = _BYTE[raw[start : ends[b - 1]]]
        v *= _powers(int(n.max()))[at]
        out[a:b] = mix64(np.add.reduceat(v, ptr) + n.astype(U64))
        a, start = b, int(ends[b - 1])
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i]+length[i]-1."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total, dtype=np.int64)


class IdCache:
    """Ids of words by hash, for encoders that treat words independently of each other.

    It saves work only: past ``most`` words those met in one portion alone go, and every word that isn't there is encoded.
    """

    def __init__(self, dtype, most: int = 300_000):
        self.dtype, self.most = dtype, most
        self._reset(np.zeros(0, U64), np.zeros(0, dtype), np.zeros(0, np.int64))

    def _reset(self, keys: np.ndarray, pool: np.ndarray, length: np.ndarray) -> None:
        self.at: dict[int, int] = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.pool, self.used = pool, len(pool)
        self.length, self.start = length, np.cumsum(length) - length
        self.met = np.zeros(len(keys), np.int32)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.met[: len(self.at)] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        keys = np.fromiter(self.at, U64, len(self.at))[keep]
        length = self.length[keep]
        self._reset(keys, self.pool[ranges(self.start[keep], length)], length)

    def _room(self, words: int, ids: int) -> None:
        def grown(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))

        self.pool = grown(self.pool, self.used + ids)
        self.start, self.length, self.met = (grown(v, len(self.at) + words) for v in (self.start, self.length, self.met))

    def lookup(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has. ``encode`` maps positions of words to their ids, one after the other, and the numbers of them."""
        if len(self.at) > self.most:
            self._shrink()
        uniq, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        keys, get = uniq.tolist(), self.at.get
        known = np.fromiter((get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            ids, n = encode(first[new].tolist())
            self._room(len(new), len(ids))
            k = len(self.at)
            self.pool[self.used : self.used + len(ids)] = ids
            self.length[k : k + len(new)] = n
            self.start[k : k + len(new)] = self.used + np.cumsum(n) - n
            self.used += len(ids)
            self.at.update(zip(uniq[new].tolist(), range(k, k + len(new)), strict=True))
            known[new] = np.arange(k, k + len(new))
        self.met[known] += 1
        known = known[inv]
        length = self.length[known]
        return self.pool[ranges(self.start[known], length)], length


def flat(lists: list[list[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their lengths."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), dtype, int(n.sum())), n
