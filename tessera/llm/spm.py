"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces of a model.

The installed models are of the merging kind (BPE), whose encoding is not the path of least cost over piece scores.
It is still a shortest-path problem: an encoding is valid exactly if its first piece is and every two neighbours are
the encoding of their own concatenation, and every prefix of a text has one valid encoding. So the search has 0 for
a valid transition and infinity for others; position i keeps one backpointer. A piece that ends later can start at
most the maximum piece length back, so the search keeps that window; whenever the backpointer paths of all positions
in it meet at one boundary, the ids before it are committed and their positions dropped. The ids equal those of the
sentencepiece library, byte fallback included.

Every text goes through that search in stretches. White space starts a piece and never follows other characters within
one, so no path crosses the place before it: all paths meet there, the ids up to it are committed, and what follows is
a search of its own. A stretch between two such places is fed and committed like any other text, whatever its length;
what it came to is remembered (a bounded number of stretches), as is the state of the positions that a stretch has in
common with the one before it. Texts that hold U+2581 itself are one stretch.

Defined results: null and empty texts have no ids and decode to the empty text. U+2581 decodes to a space, as in the
library. Null or repeated doc_ids, repeated rows, empty tables and other columns, whatever their names, don't matter to
``encode``, a row in a row out. Very long texts are fed like others; the search holds a window, not the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, IdCache, flat, hash_segments, ranges, _text_buffers, text_batches, text_slices, tidy

MARK = "▁"
SHORT = (2, 1)
PORTION = 64  # characters between two looks for a boundary


class Model:
    """The pieces of a sentencepiece model, with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        texts: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b] = i
                texts.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                texts.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                texts.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        # lengths of the pieces by their last three characters, the longest first
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], {1, 2}).add(len(p))
        self.tails = {k: sorted(v, reverse=True) for k, v in tails.items()}
        # bytes before which every text may be cut: a space, if the mark never follows other characters in a piece, and white space in no piece
        self.cuts = np.zeros(256, bool)
        self.cuts[[ord(c) for c in "\t\n\v\f" if not any(c in p for p in self.ids)]] = True
        self.cuts[0x20] = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.cache = IdCache(np.int32, 300_000)

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by the definition: merge the best-scored neighbours, leftmost first."""
        x = list(s)
        while True:
            best, at = None, -1
            for i in range(len(x) - 1):
                sc = self.score.get(x[i] + x[i + 1])
                if sc is not None and (best is None or sc > best):
                    best, at = sc, i
            if at < 0:
                return x
            x[at : at + 2] = [x[at] + x[at + 1]]

    def valid(self, before: int, piece: int) -> bool:
        """Whether ``piece`` can follow ``before`` (-1: the start, or a character without a piece)."""
        p = self.pieces[piece]
        if before < 0:
            ok = self.alone[piece] = self.merged(p) == [p]
            return ok
        if len(self.pairs) > 400_000:  # saves work only
            self.pairs.clear()
        q = self.pieces[before]
        ok = self.pairs[before << 32 | piece] = self.merged(q + p) == [q, p]
        return ok


class StreamingViterbi:
    """Feed text in portions; each call returns the ids that are certain by then."""

    def __init__(self, model: Model):
        self.model = model
        self.fed = self.committed = self.widest = 0  # characters searched, ids given out, the widest window
        self._start()

    def _start(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.back = [-1]  # per position of it: where its last piece starts
        self.last = [-1]  # per position: its last piece; -1 at the start and after a character without one
        self.cut = False  # whether something was committed since the text began

    def feed(self, s: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(s), PORTION):
            done = len(self.text)
            self.text += s[at : at + PORTION]
            self._search(done)
            self.widest = max(self.widest, len(self.text))
            if len(self.text) > PORTION:  # a shorter window is let grow, to look for boundaries less often
                out += self._commit(self._boundary(len(self.text)))
        return out

    def close(self) -> list[int]:
        """The text ends here, or white space follows: no piece goes on, and all paths meet at the last position."""
        out = self._emit(len(self.text))
        self.committed += len(out)
        return out

    def rewind(self, n: int) -> int:
        """Begin another text that shares n characters with the last one: those of them that are still in the window
        needn't be searched again. Gives how many that are."""
        if self.cut:  # the window's start isn't the text's
            self._start()
            return 0
        self.text = self.text[:n]
        del self.back[n + 1 :], self.last[n + 1 :]
        return n

    def _search(self, done: int) -> None:
        """Fill the positions after ``done``; those up to it depend on the text before them only."""
        m, text, back, last = self.model, self.text, self.back, self.last
        self.fed += len(text) - done
        piece, tails, pairs, alone = m.ids.get, m.tails.get, m.pairs.get, m.alone
        for i in range(done + 1, len(text) + 1):
            if piece(text[i - 1]) is None:
                back.append(i - 1)
                last.append(-1)
                continue
            for n in tails(text[i - 3 : i], SHORT) if i > 2 else SHORT:
                j = i - n
                if j >= 0 and (p := piece(text[j:i])) is not None:
                    q = last[j]
                    ok = alone.get(p) if q < 0 else pairs(q << 32 | p)
                    if m.valid(q, p) if ok is None else ok:
                        back.append(j)
                        last.append(p)
                        break
            else:
                raise ValueError(f"no valid encoding ends after {text[max(0, i - 20):i]!r}")

    def _boundary(self, end: int) -> int:
        """Where the paths of all positions that a later piece can start from meet."""
        live = set(range(max(0, end - self.model.longest + 1), end + 1))
        while len(live) > 1:
            x = max(live)
            live.discard(x)
            live.add(self.back[x])
        return live.pop()

    def _emit(self, to: int) -> list[int]:
        last, back, byte_id, out = self.last, self.back, self.model.byte_id, []
        while to > 0:
            p, j = last[to], back[to]
            if p >= 0:
                out.append(p)
            else:
                out += [byte_id[b] for b in reversed(self.text[j:to].encode())]
            to = j
        out.reverse()
        return out

    def _commit(self, b: int) -> list[int]:
        if b <= 0:
            return []
        out = self._emit(b)
        self.committed += len(out)
        self.cut = True
        # the piece before the boundary stays known: it decides what may follow
        self.text, self.back, self.last = self.text[b:], [x - b for x in self.back[b:]], self.last[b:]
        self.back[0] = -1
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode_many(model: Model, stretches: list[str], search: StreamingViterbi | None = None) -> list[list[int]]:
    """The ids of stretches (spaces as U+2581), in alphabetical order, so that one begins where the last is still in the window."""
    out: list[list[int]] = [[]] * len(stretches)
    v, was = search or StreamingViterbi(model), ""
    for i in sorted(range(len(stretches)), key=stretches.__getitem__):
        s, n = stretches[i], 0
        for x, y in zip(s, was):  # noqa: B905  the shorter ends it
            if x != y:
                break
            n += 1
        was = s
        out[i] = v.feed(s[v.rewind(n) :]) + v.close()
    return out


def encode_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, one after the other, and the number of ids of each."""
    raw, offs = _text_buffers(texts)
    sizes = np.diff(offs)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    mark = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
    if mark.any() or not model.cuts[0x20]:
        got = encode_many(model, [(MARK + t.replace(" ", MARK)) if t else "" for t in texts.fill_null("").to_pylist()])
        return np.concatenate([np.asarray(x, np.int32) for x in got]), np.array([len(x) for x in got], np.int64)
    # a stretch: bytes to cut at and what follows them; the last of a text may be such bytes alone
    inside = ~model.cuts[raw]
    after = np.concatenate((inside[1:], [False]))
    text_ends = offs[1:][sizes > 0]
    after[text_ends - 1] = False
    cut = inside & ~after
    cut[text_ends - 1] = True
    ends = np.flatnonzero(cut) + 1
    h = hash_segments(raw, ends)
    starts = np.concatenate(([0], ends[:-1]))
    first = np.isin(starts, offs[:-1])  # these have the prefix mark
    h = np.where(first, h * U64(3) + U64(1), h)

    def encode(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return flat(encode_many(model, [MARK * bool(first[i]) + raw[starts[i] : ends[i]].tobytes().decode().replace(" ", MARK) for i in at]), np.int32)

    ids, n = model.cache.lookup(h, encode)
    total = np.concatenate(([0], np.cumsum(n)))
    return ids, np.diff(total[np.searchsorted(starts, offs)])


def decode_batch(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Texts (UTF-8) of consecutive runs of ids; the space of the prefix mark goes."""
    out: list[bytes] = []
    ends, a = np.cumsum(counts), 0
    while a < len(ends):  # some texts at a time
        at = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, at + (1 << 15), "right")))
        some = ids[at : ends[b - 1]]
        n = model.length[some]
        raw = model.bytes[ranges(model.start[some], n)]
        total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends[a:b] - at))]
        for i, j in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
            t = raw[i:j].tobytes()
            out.append(t[1:] if t[:1] == b" " else t)
        a = b
    return out


@tidy
def _encoded(batches: Iterator[pa.RecordBatch], path: str, digest: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_slices(texts, 1 << 20):
            part = texts.slice(a, b - a)
            ids, n = encode_batch(model, part)
            ptr = np.concatenate(([0], np.cumsum(n)))
            back = decode_batch(model, ids, n)
            were = [(t or "").replace(MARK, " ").encode() for t in part.to_pylist()]
            same = pa.array([x == y for x, y in zip(back, were, strict=True)])
            keep = [batch.column(c).slice(a, b - a) for c in names]
            if digest:
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                more = {"n_ids": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "text_crc32": pa.array([zlib.crc32(t) for t in back], pa.int64()), "round_trip": same}
            else:
                more = {"ids": pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids)), "n_ids": pa.array(n), "round_trip": same}
            yield pa.RecordBatch.from_arrays([*keep, *more.values()], names=[*names, *more])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Per document: the ``keep`` columns, ids (or with ``digest`` ids_crc32 and, of the text decoded from them,
    text_crc32), n_ids, and whether the decoded text is the text."""
    text_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in keep}
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    out = "n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean" if digest else "ids array<int>, n_ids long, round_trip boolean"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(partial(_encoded, path=path, digest=digest, names=list(keep)), f"{schema}, {out}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with a column ``text`` decoded from ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            texts = decode_batch(model, lists.flatten().to_numpy(zero_copy_only=False), np.array([len(x) for x in lists], np.int64))
            yield batch.append_column("text", pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))

    from pyspark.sql.types import StringType, StructField, StructType

    encoded = encoded.drop("text")
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))
