"""MinHash near-dedup by bottom-k sketches from one hash function.

Method. A document's set is its distinct word shingles, hashed once to 64 bits; its sketch is the k least hashes.
Documents with equal sets form one class before anything else, so exact copies cost nothing later. Retained values
go to inverted lists. A pair at or above the threshold shares at least t of its ``index_k`` least values (exactly for
small sets, but for a chance of ``miss`` otherwise), so under any order of all values it shares one of each side's
first index_k - t + 1; values are ordered by how often sketches hold them (a counting table that grows with the number
of sets up to 4 million slots), which keeps very common passages out of the lists. Lists give candidates in two steps: every member against the list's
first document, which links groups of near copies in linear work (the union of two sketches estimates the overlap and
drops far pairs, full sets decide); then, for lists whose members are still in different components, blocks of members
against blocks within the possible size range, but for pairs within the list's largest component. Before that,
documents too much of which no other one in such lists has are dropped, as they can't link. Blocks carry full sets,
built again for those documents only and bounded in rows and bytes, and give no more links than join their components;
pairs that don't link are never rows. Joins by a list's value or first document deal out frequent ones.

Defined results: null or empty text, or text without words: an empty set, linked with nothing, a component of its
own. Fewer words than a shingle: the whole word sequence is the one shingle. Repeated rows (same doc_id) each give a
row. A null doc_id takes part; a component's id is the least doc_id that is not null. A very long text is a set like
any other, hashed in one piece. An empty table gives no rows. Columns besides doc_id and text, whatever their names,
are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import U64, Workspace, connected_components, hash_words, join_spread, mix64, ranges, text_batches, text_slices, tidy, trim

_COEF = mix64(np.arange(1, 257, dtype=np.uint64)) | U64(1)
_SETS = "doc_id long, cls long, n_shingles long, sketch binary"


def shingle_hashes(words, n: int, d: int, windows: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of text d."""
    a, b = int(words.doc_ptr[d]), int(words.doc_ptr[d + 1])
    if b - a >= n:
        return np.unique(windows[a : b - n + 1])
    if b > a:  # fewer words than a shingle: the sequence is the one shingle
        return mix64((words.hashes[a:b] * _COEF[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a))
    return windows[:0]


def shingle_windows(words, n: int) -> np.ndarray:
    h = words.hashes
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.full(len(h) - n + 1, n, U64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _COEF[i]
    return mix64(out)


def class_of(s: np.ndarray) -> int:
    """A 64-bit identity of a set: equal sets get equal ones."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(s)
        return int(mix64(np.array([s.sum(dtype=U64) + x * U64(0x9E3779B97F4A7C15) + U64(len(s))], U64)).view(np.int64)[0])


@tidy
def _document_sets(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            words = hash_words(texts.slice(a, b - a))
            windows = shingle_windows(words, n)
            cls, size, sketch = [], [], []
            for d in range(b - a):
                s = shingle_hashes(words, n, d, windows)
                size.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                sketch.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "cls", "n_shingles", "sketch"])


@tidy
def _full_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts):
            words = hash_words(texts.slice(a, b - a))
            windows = shingle_windows(words, n)
            sets = [shingle_hashes(words, n, d, windows) for d in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "full"])


# ---------------------------------------------------------------- bounds
def least_shared(p: float, k: int, miss: float) -> int:
    """The largest t with P(Binomial(k, p) < t) <= miss."""
    total = 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > miss:
            return t
    return k


def prefix_length(n: int, p100: int, index_k: int, t: int) -> int:
    """How many of a set's least values, in the global order, must be listed."""
    held = min(n, index_k)
    if n * 100 <= index_k * p100:  # any partner is held whole, too: exact
        return n - -(-n * p100 // 100) + 1
    return max(1, held - min(t, -(-n * p100 // 100)) + 1)


@tidy
def _listed(batches: Iterator[pa.RecordBatch], counts, bits: int, p100: int, index_k: int, t: int) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        at, out = [], []
        for n, sk in zip(batch.column("n_shingles").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
            s = np.frombuffer(sk, U64)[:index_k]
            m = prefix_length(n, p100, index_k, t)
            if m < len(s):
                s = s[np.lexsort((s, table[(s >> U64(64 - bits)).astype(np.int64)]))[:m]]
            out.append(s)
            at.append(len(s))
        if out:
            rows = pa.array(np.repeat(np.arange(len(at)), at))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("cls", "doc_id", "n_shingles")), pa.array(np.concatenate(out).view(np.int64))], names=["cls", "doc_id", "n", "value"])


@tidy
def _slots(batches: Iterator[pa.RecordBatch], bits: int, index_k: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of sketch values by slot of the counting table."""
    total = np.zeros(1 << bits, np.int64)
    for batch in batches:
        for sk in batch.column("sketch").to_pylist():
            total[(np.frombuffer(sk, U64)[:index_k] >> U64(64 - bits)).astype(np.int64)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def overlap_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of the k least values of the union that both sketches hold."""
    u = np.unique(np.concatenate((a, b)))[:k]
    return np.isin(u, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean() if len(u) else 0.0


@tidy
def _estimated(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [overlap_estimate(np.frombuffer(x, U64), np.frombuffer(y, U64), k) >= least for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


@tidy
def _verified(batches: Iterator[pa.RecordBatch], p100: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= p100 * (len(s) + len(t) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


@tidy
def _values(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """A row for each value of each set."""
    for batch in batches:
        cls = batch.column("cls").to_numpy()
        for k in range(0, len(cls), 500):
            sets = [np.frombuffer(v, np.int64) for v in batch.column(column).slice(k, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls[k : k + 500], [len(s) for s in sets])), pa.array(np.concatenate(sets))], names=["cls", "value"])


def private_counts(sets: DataFrame, column: str) -> DataFrame:
    """cls, private: how many values of a set are in no other one."""
    rows = sets.select("cls", column).mapInArrow(partial(_values, column=column), "cls long, value long")
    once = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).filter("n = 1")
    return once.groupBy("cls").agg(F.count("*").alias("private"))


def _block_links(rows: pa.Table, p100: int) -> pa.Table:
    """Links between two blocks of one list, by full sets, as far as they join components that aren't joined yet."""
    left = rows.column("left").to_numpy(zero_copy_only=False)
    la, ra = rows.filter(pa.array(left)), rows.filter(pa.array(~left))
    if not la.num_rows or not ra.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    (ca, na, ea, ga), (cb, nb, eb, gb) = ([x.column(c).to_numpy() for c in ("cls", "n", "shared", "comp")] for x in (la, ra))
    minor = ra.column("minor").to_numpy(zero_copy_only=False)
    names, flat = np.unique(np.concatenate((ga, gb)), return_inverse=True)
    ga, gb = flat[: len(ga)], flat[len(ga) :].copy()
    root = np.arange(len(names))  # of each component
    sb = [np.frombuffer(v, U64) for v in ra.column("full").to_pylist()]
    values = np.concatenate(sb)
    owner = np.repeat(np.arange(len(sb)), [len(v) for v in sb])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    outs = []
    for i, v in enumerate(la.column("full").to_pylist()):
        # an overlap is at most what each side shares with any set
        most = np.minimum(ea[i], eb)
        ok = (root[ga[i]] != root[gb]) & ((100 + p100) * most >= p100 * (na[i] + nb)) & (~minor | (cb > ca[i]))
        if not ok.any():
            continue
        s = np.frombuffer(v, U64)
        lo, hi = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        both = np.bincount(owner[ranges(lo, hi - lo)], minlength=len(sb))
        for j in np.flatnonzero(ok & (100 * both >= p100 * (na[i] + nb - both))):
            x, y = root[ga[i]], root[gb[j]]
            if x != y:
                root[root == y] = x
                outs.append((ca[i], cb[j]))
    x = np.array(outs, np.int64).reshape(-1, 2)
    del sb, values, owner, order
    trim()
    return pa.table({"a": x[:, 0], "b": x[:, 1]})


# ---------------------------------------------------------------- operator
def _open_lists(member: DataFrame, rows: int) -> DataFrame:
    """Rows of lists whose members are in more than one component."""
    lists = member.groupBy("value").agg(F.count("*").alias("members"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("value", "members")
    return join_spread(member, lists, ["value"], "cls", rows)


def _classes(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, index_k: int = 32, block: int = 512, block_bytes: int = 32 << 20, miss: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, cls, n_shingles; cls null without shingles), and the classes of equal sets (cls, the least doc_id, component)."""
    spark = docs.sparkSession
    text_batches(spark)
    ws = Workspace(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = ws.write(texts.mapInArrow(partial(_document_sets, n=words, k=k), _SETS), "sets")
    reps = sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = ws.write(reps, "reps")
    sketches = reps.select("cls", "n_shingles", "sketch")

    # inverted lists, rarest values first; a slot for every 64 values, and rarity in eighths of a power of two
    t = least_shared(percent / 100, index_k, miss)
    slots_bits = min(max((reps.count() * index_k // 64).bit_length(), 16), 22)
    counted = reps.select("sketch").mapInArrow(partial(_slots, bits=slots_bits, index_k=index_k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << slots_bits, np.uint8)
    table[counted.column("slot").to_numpy()] = 8 * np.log2(counted.column("n").to_numpy() + 1)
    counts = spark.sparkContext.broadcast(table)
    lists = ws.write(reps.mapInArrow(partial(_listed, counts=counts, bits=slots_bits, p100=percent, index_k=index_k, t=t), "cls long, doc_id long, n long, value long"), "lists")
    first = reps.select("cls", "doc_id")
    heads = lists.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "cls")).alias("lead")).filter("members > 1")
    heads = ws.write(heads.select("value", "members", F.col("lead.cls").alias("a")), "heads")
    shared = ws.write(join_spread(lists, heads, ["value"], "cls", lists.count()).drop("doc_id"), "shared")
    n_shared = shared.count()

    share = least_shared(percent / 100, k, miss) / k
    def full_sets(need: DataFrame, tag: str) -> DataFrame:
        ids = need.join(first, "cls").select("doc_id").distinct()
        again = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")
        rows = again.mapInArrow(partial(_full_sets, n=words), "cls long, full binary").join(need, "cls", "left_semi")
        return ws.write(rows.groupBy("cls").agg(F.first("full").alias("full")), tag)

    def with_lead(pairs: DataFrame, what: DataFrame, n: int) -> DataFrame:
        """Pairs with what belongs to their first documents, some of which are in very many pairs."""
        met = pairs.groupBy("a").agg(F.count("*").alias("members"))
        return join_spread(pairs, met.join(what, "a"), ["a"], "b", n)

    # step 1: each list's members against its first document
    pairs = shared.filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    pairs = ws.write(pairs, "met")
    sk = reps.select("cls", "sketch")
    joined = with_lead(pairs, sk.toDF("a", "sa"), pairs.count()).join(sk.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    pairs = ws.write(joined.mapInArrow(partial(_estimated, k=k, least=share), "a long, b long"), "pairs")
    full = full_sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "full1")
    both = with_lead(pairs, full.toDF("a", "fa"), pairs.count()).join(full.toDF("b", "fb"), "b").select("a", "b", "fa", "fb")
    links = ws.write(both.mapInArrow(partial(_verified, p100=percent), "a long, b long"), "links1")
    ws.drop("full1", "pairs", "met", "lists", "heads")
    comp = ws.write(connected_components(ws, links, "cc"), "comp")

    # step 2: lists whose members are not in one component yet. A set can't link if too much of it is in no other set
    # of such lists: first by sketches (but for the same chance), then by full sets
    member = shared.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).select("value", "cls", "n", "comp")
    member = ws.write(_open_lists(member, n_shared), "open")
    near = member.select("cls").distinct().join(sketches, "cls")
    alone = k - least_shared(percent / 100, k, miss)
    most_alone = F.when(F.col("n_shingles") >= k, F.lit(alone)).otherwise(F.greatest(F.lit(0), F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100 * 0.6)))
    near = near.join(private_counts(near, "sketch"), "cls", "left").filter(F.coalesce("private", F.lit(0)) <= most_alone).select("cls")
    full = full_sets(ws.write(near, "near"), "full2")
    sizes = full.select("cls", (F.length("full") / 8).cast("long").alias("n"))
    held = sizes.join(private_counts(full, "full"), "cls", "left").select("cls", (F.col("n") - F.coalesce("private", F.lit(0))).alias("shared"), "n").filter(F.col("shared") * 100 >= F.col("n") * percent)
    member = _open_lists(member.join(ws.write(held.select("cls", "shared"), "held"), "cls"), n_shared)
    member = ws.write(member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")), "members")
    # the list's largest component is in one already: only pairs with a member of another one matter
    per_comp = member.groupBy("value", "comp").agg(F.count("*").alias("c"))
    largest = per_comp.groupBy("value").agg(F.sum("c").alias("members"), F.max(F.struct("c", "comp")).alias("x")).select("value", "members", F.col("x.comp").alias("major"))
    member = ws.write(join_spread(member, largest, ["value"], "cls", n_shared).withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "placed")
    blocks_of = lambda rows, n: F.ceil(F.greatest(rows / block, F.coalesce(n, F.lit(0)) * 8 / block_bytes)).cast("int")
    per = member.groupBy("value", "band").agg(F.count("*").alias("members"), blocks_of(F.count("*"), F.sum("n")).alias("all"), blocks_of(F.count_if("minor"), F.sum(F.when(F.col("minor"), F.col("n")))).alias("minors"))

    def spots(column: str, sub: str) -> DataFrame:
        return per.filter(F.col(column) > 0).select("value", "band", F.explode(F.sequence(F.lit(0), F.col(column) - 1)).alias(sub))

    # a block of minor members of band g meets the blocks of bands g-2 to g+2 (rounding of the logarithm included)
    around = spots("all", "q_sub").select("value", F.col("band").alias("q_band"), "q_sub", F.explode(F.array(*[F.col("band") + i for i in range(-2, 3)])).alias("band"))
    meet = spots("minors", "p_sub").join(around, ["value", "band"]).select("value", F.col("band").alias("p_band"), "p_sub", "q_band", "q_sub")
    spot = lambda column: F.pmod(F.xxhash64("cls", "n"), F.col(column).cast("long")).cast("int")
    at = join_spread(member, per, ["value", "band"], "cls", n_shared)
    cols = ["value", "p_band", "p_sub", "q_band", "q_sub", "left", "cls", "n", "shared", "comp", "minor"]
    left = at.filter("minor").select("value", F.col("band").alias("p_band"), spot("minors").alias("p_sub"), F.lit(True).alias("left"), "cls", "n", "shared", "comp", "minor").join(meet, ["value", "p_band", "p_sub"])
    right = at.select("value", F.col("band").alias("q_band"), spot("all").alias("q_sub"), F.lit(False).alias("left"), "cls", "n", "shared", "comp", "minor").join(meet, ["value", "q_band", "q_sub"])
    blocks = left.select(cols).unionByName(right.select(cols)).join(full, "cls")
    more = ws.write(blocks.groupBy("value", "p_band", "p_sub", "q_band", "q_sub").applyInArrow(lambda rows: _block_links(rows, percent), "a long, b long"), "links2")
    ws.drop("full2")
    comp = ws.write(connected_components(ws, links.unionByName(more), "cd"), "components")

    ws.drop("shared", "open", "members", "placed", "held", "near")
    names = first.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    return sets.select("doc_id", "cls", "n_shingles"), names


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the document whose id names its component).

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets. ``params`` as in ``_classes``.
    """
    sets, names = _classes(docs, **params)
    # class -> least doc_id of its component -> documents
    least = names.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = sets.join(names.join(least, "component").select("cls", "component_id"), "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_ID, _NO_ID, _NO_SET = 0, 1, 2  # kinds of rows
_KEY = ["_cls", "_id", "_kind"]


@tidy
def _row_keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows with a key: class, id (0 for null) and kind; for rows without shingles a number of their own, id and kind.

    Of rows with one key a batch gives one, so that many copies with one id, or none, don't meet in one task.
    """
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = batch.column("_text")
        cls = np.arange(row, row + len(texts))
        row += len(texts)
        ids = batch.column("_id")
        kind = np.where(ids.is_null().to_numpy(zero_copy_only=False), _NO_ID, _ID)
        for a, b in text_slices(texts):
            w = hash_words(texts.slice(a, b - a))
            windows = shingle_windows(w, n)
            for d in range(b - a):
                s = shingle_hashes(w, n, d, windows)
                if len(s):
                    cls[a + d] = class_of(s)
                else:
                    kind[a + d] = _NO_SET
        key = np.stack((cls, ids.fill_null(0).to_numpy(), kind), 1)
        at = np.sort(np.unique(key, axis=0, return_index=True)[1])
        key = key[at]
        out = batch.drop_columns(["_text", "_id"]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(key[:, j]) for j in range(3))], names=[*out.schema.names, *_KEY])


def drop_near_duplicates(docs: DataFrame, words: int = 5, **params) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one row of each component, and every row without shingles.

    The row is one with the least doc_id of its component (without ids, one of the least class); among rows with the
    same id and shingle set any. Rows are told apart by class and id, never by id alone. The join deals rows out by
    the key that dropping repeats needs as well: texts are shuffled once.
    """
    _, names = _classes(docs, words=words, **params)
    best = names.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("x"))
    kind = F.when(F.col("x.none"), F.lit(_NO_ID)).otherwise(F.lit(_ID)).cast("long")
    best = best.select(F.col("x.cls").alias("_cls"), F.coalesce("x.doc_id", F.lit(0)).cast("long").alias("_id"), kind.alias("_kind"), F.lit(True).alias("_best"))
    # the columns go by number meanwhile: they may have any names
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    own = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    schema = StructType([*fields, *(StructField(c, LongType()) for c in _KEY)])
    rows = docs.select(*own, F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("_id")).mapInArrow(partial(_row_keys, n=words), schema)
    out = rows.join(best, _KEY, "left").filter((F.col("_kind") == _NO_SET) | F.col("_best"))
    return out.dropDuplicates(_KEY).select(*[F.col(f.name).alias(c) for f, c in zip(fields, docs.columns, strict=True)])
