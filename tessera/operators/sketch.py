"""Sketches: means of features over the rows of a DataFrame, in one pass.

A sketch is a DataFrame of ``by`` columns, j, re, im, n (rows), w (their weight) and weighted: a mean over n or, with
weights, the sum of weighted features. It depends on the data by sums only, so sketches of parts merge exactly.

``arrow`` sums features per partition with NumPy (one matrix product per batch) and shuffles m rows per partition and
group; sums of many groups are given out whenever they reach ``HELD`` bytes. ``catalyst`` stays in the JVM: every row
meets an array literal of the frequencies, and whole-stage code sums; it takes maps of up to ``WIDE`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tessera.operators.feature_map import FeatureMap

CELLS = 1 << 19  # features that are formed at once
HELD = 64 << 20  # bytes of sums of groups that a task holds
WIDE = 1 << 14  # frequencies times dimensions of a map that becomes text of a plan


def _clean(df: DataFrame, cols: list[str], vector: str | None, weight: str | None, nulls: str, d: int | None = None) -> DataFrame:
    """Rows whose features are all there, finite and, in a vector, d in number: ``drop`` leaves others out, ``error`` stops at them."""
    if nulls not in ("drop", "error"):
        raise ValueError("nulls is drop or error")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.lit(False)
    for c in [*cols, *([weight] if weight else [])]:
        bad = bad | odd(F.col(c).cast("double"))
    if vector:
        bad = bad | F.col(vector).isNull() | F.coalesce(F.exists(vector, lambda v: odd(v.cast("double"))), F.lit(True))
        if d is not None:
            bad = bad | (F.size(vector) != d)
    if nulls == "drop":
        return df.filter(~bad)
    return df.filter(F.when(bad, F.raise_error(F.lit("a feature is null or not finite, or a vector of another length"))).otherwise(F.lit(True)))


def _partial_sums(batches: Iterator[pa.RecordBatch], fmap: FeatureMap, cols: list[str], by: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, list] = {}
    step = max(1, CELLS // fmap.m)

    def out() -> Iterator[pa.RecordBatch]:
        for key, (z, n, total) in sums.items():
            re, im = fmap.c_norm * z
            columns = [[v] * fmap.m for v in key] + [np.arange(fmap.m, dtype=np.int32), re, im, [n] * fmap.m, [total] * fmap.m]
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema)
        sums.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        if cols:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], 1)
        else:
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        w = batch.column("_w").to_numpy(zero_copy_only=False) if "_w" in batch.schema.names else None
        keys, starts = [()], np.zeros(1, np.int64)
        if by:  # rows in order of their groups
            groups = pa.Table.from_batches([batch.select(by)]).append_column("_i", pa.array(np.arange(batch.num_rows))).group_by(by).aggregate([("_i", "list")])
            lists = groups.column("_i_list").combine_chunks()
            order, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1].astype(np.int64)
            keys = list(zip(*(groups.column(b).to_pylist() for b in by), strict=True))
            x, w = x[order], None if w is None else w[order]
        for k in range(0, len(x), step):
            part, pw = x[k : k + step], None if w is None else w[k : k + step]
            first = int(np.searchsorted(starts, k, "right")) - 1
            at = np.maximum(starts[first : int(np.searchsorted(starts, k + len(part)))] - k, 0)
            n = np.diff(at, append=len(part))
            total = n.astype(float) if pw is None else np.add.reduceat(pw, at)
            features = []
            for y in fmap.f.parts(part @ fmap.omega + fmap.xi):
                y = y if pw is None else y * pw[:, None]
                features.append(np.add.reduceat(y, at, 0) if len(at) > 1 else y.sum(0)[None])
            for g, key in enumerate(keys[first : first + len(at)]):
                acc = sums.setdefault(key, [np.zeros((2, fmap.m)), 0, 0.0])
                for row, y in zip(acc[0], features):  # noqa: B905  a real wave has one part
                    row += y[g]
                acc[1] += int(n[g])
                acc[2] += float(total[g])
            if len(sums) * fmap.m * 16 > HELD:
                yield from out()
    yield from out()


def spread(rows: DataFrame, least_bytes: int = 1 << 20, split_bytes: int = 64 << 20) -> DataFrame:
    """Deal the narrow rows of a small input over the cores: its files may have fewer row groups than there are cores.

    Inputs of over ``split_bytes`` per core fill the cores as they are and are never shuffled here; tiny ones aren't
    worth it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if least_bytes <= size < cores * split_bytes else rows


def _summed(df: DataFrame, fmap: FeatureMap, cols: list[str], vector: str | None, weight: str | None, by: list[str], backend: str) -> DataFrame:
    """by, j, sre, sim, n, w."""
    if backend == "arrow":
        from pyspark.sql.pandas.types import to_arrow_schema

        own = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)] or [F.col(vector).cast("array<double>").alias("_v")]
        rows = df.select(*by, *own, *([F.col(weight).cast("double").alias("_w")] if weight else []))
        rows = spread(rows)
        out = StructType([*(df.schema[b] for b in by), *(StructField(c, k) for c, k in (("j", IntegerType()), ("sre", DoubleType()), ("sim", DoubleType()), ("n", LongType()), ("w", DoubleType())))])
        parts = rows.mapInArrow(partial(_partial_sums, fmap=fmap, cols=[f"_x{i}" for i in range(len(cols))], by=by, schema=to_arrow_schema(out)), out)
        return parts.groupBy(*by, "j").agg(*[F.sum(c).alias(c) for c in ("sre", "sim", "n", "w")])
    if backend != "catalyst":
        raise ValueError("backend is arrow or catalyst")
    return catalyst_groups(df, fmap, cols, vector, weight, by)


def catalyst_rows(df: DataFrame, fmap: FeatureMap, cols: list[str], vector: str | None, weight: str | None, keep: list[str]) -> DataFrame:
    """A row per example and frequency: the kept columns, j, fre, fim, fw. All of it is built-in expressions."""
    if fmap.f.name == "user":
        raise ValueError("a function of your own needs the arrow backend")
    if fmap.m * fmap.d > WIDE:
        raise ValueError(f"the map has over {WIDE} numbers; use the arrow backend")
    spec = ", ".join(f"named_struct('j', {j}, 'xi', {float(fmap.xi[j])!r}D, {', '.join(f"'w{i}', {float(v)!r}D" for i, v in enumerate(fmap.omega[:, j]))})" for j in range(fmap.m))
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)] if cols else [F.col(vector).cast("array<double>").alias("_v")]
    rows = df.select(*keep, *x, weights.alias("_w"))
    rows = (rows if df.isStreaming else spread(rows)).withColumn("_f", F.explode(F.expr(f"array({spec})")))
    value = (lambda i: f"_x{i}") if cols else (lambda i: f"_v[{i}]")
    t = " + ".join([f"{value(i)} * _f.w{i}" for i in range(fmap.d)] + ["_f.xi"])
    rows = rows.select(*keep, F.col("_f.j").alias("j"), F.expr(t).alias("_t"), F.col("_w").alias("fw"))
    parts = fmap.f.columns("_t")
    return rows.select(*keep, "j", (fmap.c_norm * parts[0]).alias("fre"), (fmap.c_norm * parts[1] if len(parts) > 1 else F.lit(0.0)).alias("fim"), "fw")


def feature_sums(groups: GroupedData) -> DataFrame:
    """Sums of ``catalyst_rows`` by whatever they are grouped by."""
    return groups.agg(F.sum(F.col("fre") * F.col("fw")).alias("sre"), F.sum(F.col("fim") * F.col("fw")).alias("sim"), F.count("*").alias("n"), F.sum("fw").alias("w"))


def catalyst_groups(df: DataFrame, fmap: FeatureMap, cols: list[str], vector: str | None, weight: str | None, by: list[str]) -> DataFrame:
    return feature_sums(catalyst_rows(df, fmap, cols, vector, weight, by).groupBy(*by, "j"))


def sketch(df: DataFrame, fmap: FeatureMap, cols: list[str] | None = None, vector: str | None = None, weight: str | None = None, by: list[str] | None = None, backend: str = "arrow", nulls: str = "drop") -> DataFrame:
    """The sketch of feature columns ``cols`` or of an array column ``vector``, whole or per group.

    Without weights: re, im are means. With weights: sums of weight times feature, not divided by anything.
    """
    if bool(cols) == bool(vector):
        raise ValueError("give cols or vector")
    if cols and len(cols) != fmap.d:
        raise ValueError(f"the map has {fmap.d} dimensions, cols {len(cols)}")
    by, cols = by or [], cols or []
    s = _summed(_clean(df, cols, vector, weight, nulls, fmap.d), fmap, cols, vector, weight, by, backend)
    over = F.lit(1.0) if weight else F.col("n")
    return s.select(*by, "j", (F.col("sre") / over).alias("re"), (F.col("sim") / over).alias("im"), "n", "w", F.lit(bool(weight)).alias("weighted"))


def _merged(grouped: GroupedData, *more) -> DataFrame:
    """Sums of sketches times what they are means over, and what they are sums of; a sketch says which."""
    return grouped.agg(F.sum("_re").alias("_re"), F.sum("_im").alias("_im"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("weighted").alias("weighted"), F.max("weighted").alias("_other"), *more)


def _as_sums(s: DataFrame) -> DataFrame:
    of = F.when(F.col("weighted"), 1.0).otherwise(F.col("n"))
    return s.withColumns({"_re": F.col("re") * of, "_im": F.col("im") * of})


def _as_sketch(s: DataFrame, *keys: str) -> DataFrame:
    kinds = F.when(F.col("weighted") != F.col("_other"), F.raise_error(F.lit("weighted sketches don't merge with others")).cast("boolean")).otherwise(F.col("weighted"))
    over = F.when(F.col("weighted"), 1.0).otherwise(F.col("n"))
    return s.select(*keys, (F.col("_re") / over).alias("re"), (F.col("_im") / over).alias("im"), "n", "w", kinds.alias("weighted"))


def merge(sketches: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """The sketch of the union of the parts' rows; weighted sketches give the sum of the parts'."""
    by = by or []
    all_ = sketches[0]
    for s in sketches[1:]:
        all_ = all_.unionByName(s)
    return _as_sketch(_merged(_as_sums(all_).groupBy(*by, "j")), *by, "j")


def rollup(groups: DataFrame, by: list[str]) -> DataFrame:
    """Sketches per group and for every coarser level, from the groups' sketches alone.

    ``level`` tells a null group from a total: it has a bit for each of ``by`` (the last one the lowest), set where that column is summed over.
    """
    rows = _as_sums(groups).withColumn("_key", F.col("j"))
    out = _merged(rows.rollup("_key", *by), F.grouping_id().cast("long").alias("level")).filter(F.col("_key").isNotNull())
    return _as_sketch(out.withColumn("j", F.col("_key")), *by, "level", "j")


def to_vector(s: DataFrame) -> tuple[np.ndarray, int]:
    """A whole sketch as a complex array, and n. It has m entries, whatever the data's size."""
    t = s.select("j", "re", "im", "n").toArrow().sort_by("j")
    if not t.num_rows:
        raise ValueError("the dataset is empty")
    return t.column("re").to_numpy() + 1j * t.column("im").to_numpy(), t.column("n")[0].as_py()


def from_vector(spark, z: np.ndarray, n: int) -> DataFrame:
    return spark.createDataFrame([(j, float(v.real), float(v.imag), n, float(n), False) for j, v in enumerate(np.asarray(z, complex))], "j int, re double, im double, n long, w double, weighted boolean")


def sketch_callable(df: DataFrame, phi, cols: list[str], rows: bool = False) -> np.ndarray:
    """The mean of any function: of one row (d numbers in, m out) or, with ``rows``, of many ((k, d) in, (k, m) out),
    which spares a call for each row."""
    many = phi if rows else lambda x: np.stack([np.asarray(phi(r), complex) for r in x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                y = np.asarray(many(np.stack([b.column(c).slice(k, 8192).to_numpy(zero_copy_only=False) for c in cols], 1)), complex)
                total, n = y.sum(0) if total is None else total + y.sum(0), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.real), pa.array(total.imag), pa.array(np.full(len(total), n))], names=["j", "re", "im", "n"])

    own = _clean(df, cols, None, None, "drop").select(*[F.col(c).cast("double").alias(c) for c in cols])
    t = own.mapInArrow(run, "j long, re double, im double, n long").groupBy("j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n")).toArrow().sort_by("j")
    if not t.num_rows:
        raise ValueError("the dataset is empty")
    return (t.column("re").to_numpy() + 1j * t.column("im").to_numpy()) / t.column("n").to_numpy()
