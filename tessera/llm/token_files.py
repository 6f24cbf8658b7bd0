"""Token-id output in the Arrow stream-file format (IPC file) with fixed-size-list batches.

``write_token_files`` encodes whole texts, appends the end id to each, and writes the ids in ascending doc_id order.
Each part has two files: ``tokens`` holds sequences of equal length (a fixed-size list of ids and one of mask bits,
false where the last sequence is padded) in record batches of a fixed number of sequences, so that id number i of a
part is at batch i // (batch * length) and is read as a view of the mapped file; ``docs`` holds doc_id, first id and
number of ids. A manifest (one row a part) names the files of the attempts that succeeded: a task that is run again
writes new files and leaves no half-written part behind.

Defined results: null or empty text gives the end id alone. Repeated doc_ids give a row each, next to each other.
Null doc_ids come first. An empty table writes no ids and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import IdCache, Workspace, flat, hash_words, partitions, text_slices, tidy

LENGTH, BATCH = 2048, 128
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def id_dtype(vocabulary: int):
    """The narrowest unsigned type that holds every id."""
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return tok, IdCache(id_dtype(tok.get_vocab_size()))


def splits_at_white_space(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space, and never joins across it or letters and stops, so that
    words can be encoded one by one."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = ((spec[k] or {}).get(part, []) for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    folds = any(n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" for n in norm)
    drops = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and r"[^\s" in p["pattern"].get("Regex", "") for p in pre)
    lowers = any(n["type"] == "Lowercase" for n in norm)
    return folds and drops and lowers and not any(not t["content"].startswith("<|") or set(t["content"]) & set(" \t\n\v\f\r") or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])


def _encode_words(tok, words: list[str], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that are encoded in one text, between separators that are one id and in none of the words."""
    text = "".join(words)
    for sep in "§¶¤©®÷×":
        one = tok.encode(sep, add_special_tokens=False).ids
        if len(one) == 1 and sep not in text:
            ids = np.array(tok.encode_batch_fast([f" {sep} ".join(words)], add_special_tokens=False)[0].ids)
            at = np.flatnonzero(ids == one[0])
            if len(at) == len(words) - 1:
                return np.delete(ids, at).astype(dtype), np.diff(at, prepend=-1, append=len(ids)) - 1
    return flat([e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)], dtype)


def encode_texts(texts: pa.Array, path: str, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, one after the other, and the number of ids of each."""
    tok, cache = _tokenizer(path)
    if not by_word:
        got = [e.ids for e in tok.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.asarray(x, cache.dtype) for x in got]), np.array([len(x) for x in got], np.int64)
    # letters in lower case and stops apart, as the tokenizer has them; added tokens keep their case
    words = hash_words(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py(), cut_stops=True)
    if not len(words.hashes):
        return np.zeros(0, cache.dtype), np.zeros(len(texts), np.int64)
    ids, n = cache.lookup(words.hashes, lambda at: _encode_words(tok, [words.word(i).decode() for i in at], cache.dtype))
    total = np.concatenate(([0], np.cumsum(n)))
    return ids, np.diff(total[words.doc_ptr])


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


class SequenceWriter:
    """Writes a stream of ids as sequences of ``length`` in batches of ``batch`` sequences."""

    def __init__(self, sink, dtype, length: int, batch: int):
        self.length, self.batch, self.dtype = length, batch, dtype
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        size = self.length * self.batch
        if self.n >= size:
            x = np.concatenate(self.held)
            for k in range(0, len(x) - size + 1, size):
                self._write(x[k : k + size], size)
            rest = x[len(x) // size * size :].copy()
            self.held, self.n = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            x = np.concatenate(self.held)
            full = -(-len(x) // self.length) * self.length
            self._write(np.concatenate((x, np.zeros(full - len(x), self.dtype))), len(x))
        self.writer.close()


class SequenceReader:
    """Random access to the ids of one ``tokens`` file; a mapped file is not copied."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(_open(uri))
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.at, self.ids, self.size = -1, None, 0
        self.size = self.length * self._batch(0).num_rows if self.reader.num_record_batches else 0

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.batch = self.reader.get_batch(k)
            self.at, self.ids = k, self.batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i and its mask."""
        per = self.size // self.length
        b = self._batch(i // per)
        j = i % per
        return self.ids[j * self.length : (j + 1) * self.length], b.column("mask")[j].values

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start+n-1, as views."""
        while n:
            self._batch(start // self.size)
            part = self.ids[start % self.size : start % self.size + n]
            yield part
            start, n = start + len(part), n - len(part)


@tidy
def _write_part(batches: Iterator[pa.RecordBatch], root: str, path: str, end_id: int, by_word: bool, length: int, batch: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
    fs, folder = pafs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    dtype = _tokenizer(path)[1].dtype
    total = docs = 0
    with fs.open_output_stream(f"{folder}/{name}.tokens") as a, fs.open_output_stream(f"{folder}/{name}.docs") as b:
        tokens, index = SequenceWriter(a, dtype, length, batch), pa.ipc.new_file(b, _DOCS)
        for rows in batches:
            texts, ids_of = rows.column("text"), rows.column("doc_id")
            for lo, hi in text_slices(texts, 1 << 20):
                ids, n = encode_texts(texts.slice(lo, hi - lo), path, by_word)
                with_end = np.insert(ids, np.cumsum(n), np.asarray(end_id, dtype))
                tokens.add(with_end)
                n = n + 1
                index.write_batch(pa.RecordBatch.from_arrays([ids_of.slice(lo, hi - lo), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=_DOCS))
                total += int(n.sum())
                docs += hi - lo
        tokens.close()
        index.close()
    yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{root}/{name}"], "docs": [docs], "tokens": [total]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, root: str | None = None, parts: int | None = None, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Encode, write, and return the manifest: part, file (without the endings .tokens and .docs), docs, tokens."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts or partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    write = partial(_write_part, root=root or ws.path("files"), path=path, end_id=end_id, by_word=splits_at_white_space(path), length=length, batch=batch)
    return ws.write(rows.mapInArrow(write, "part int, file string, docs long, tokens long"), "manifest")


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for file, base in zip(rows.column("file").to_pylist(), rows.column("base").to_pylist(), strict=True):
            tokens, index = SequenceReader(f"{file}.tokens"), pa.ipc.open_file(_open(f"{file}.docs"))
            for k in range(index.num_record_batches):
                b = index.get_batch(k)
                crc = []
                for start, n in zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                    c = 0
                    for ids in tokens.span(start, n):
                        c = zlib.crc32(ids.astype("<u4").tobytes(), c)
                    crc.append(c)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(b.column("start").to_numpy() + base), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian uint32 ids)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = manifest.filter("docs > 0").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = parts.repartition(partitions(manifest.sparkSession))
    return spread.select("file", "base").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
