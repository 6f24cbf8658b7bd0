import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, embed_dedup, linkgraph, maxent, minhash, mixing, quality, spm, token_files, topk
from tessera.llm import queries as q
from tessera.llm.common import Workspace, connected_components, hash_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCAB = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(900)]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(t, every, seed):
    w = t.split(" ")
    r = random.Random(seed)
    for i in range(every // 2, len(w), every):
        w[i] = r.choice(VOCAB)
    return " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(60 + i, i)) for i in range(20)]
    rows += [(100 + i, edited(rows[0][1], 40, i)) for i in range(12)]  # near copies
    rows += [(200 + i, edited(rows[1][1], 7, i)) for i in range(12)]  # too far apart
    rows += [(300 + i, rows[2][1]) for i in range(6)] + [(300, rows[2][1])]  # copies, one a repeated row
    rows += [(400 + i, prose(50, 900) + " " + prose(70, 1000 + i)) for i in range(15)]  # a shared passage
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One two"), (504, "one  TWO"), (505, "two one"), (506, "x" * 5000), (507, "é " * 3000), (None, rows[2][1]), (None, None), (508, rows[3][1].upper() + "\n")]
    return rows


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def key(rows):
    return sorted(rows, key=repr)


def by_sql(df, table, name, columns):
    """The rows of a query's SQL over a table."""
    import duckdb

    db = duckdb.connect()
    db.register(table, df.toArrow())
    return db.sql(f"SELECT {columns} FROM ({q.oracle_sql()[name]})").fetchall()


# ---------------------------------------------------------------- shared
def test_word_hashes_follow_the_definition():
    texts = ["Ab  cd\n\x0bAB", None, "", " x ", "ÄB äb", "a.b c.", "z"]
    w = hash_words(pa.array(texts))
    got = [[w.word(i).decode() for i in range(w.doc_ptr[d], w.doc_ptr[d + 1])] for d in range(len(texts))]
    assert got == [WORD.findall(ascii_lower(t)) for t in texts]
    flat = [x for g in got for x in g]
    assert len(set(w.hashes.tolist())) == len(set(flat)) and w.hashes[0] == w.hashes[2]
    assert len(hash_words(pa.array([None, ""])).hashes) == 0
    part = pa.array(texts).slice(3, 2)
    assert hash_words(part).doc_ptr.tolist() == [0, 1, 3]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    edges += [(2000, 2001 + i) for i in range(1500)] + [(5000, 3600 + i) for i in range(900)]  # nodes that are dealt over tasks
    got = {x["node"]: x["component"] for x in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    n = max(max(e) for e in edges) + 1
    label = embed_dedup.stars(*(np.array(x) for x in zip(*edges, strict=True)), n)
    assert got == {v: int(label[v]) for e in edges if e[0] != e[1] for v in e}
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1
def brute_links(vectors, threshold):
    unit = [None if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in vectors]
    same = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
    n = len(vectors)
    hit = [[i != j and same(i, j) and float(unit[i] @ unit[j]) >= threshold for j in range(n)] for i in range(n)]
    a, b = np.nonzero(np.array(hit))
    label = embed_dedup.stars(a, b, n)
    ids = [v for v, _ in vectors]
    least = {g: min((ids[i] for i in range(n) if label[i] == g and ids[i] is not None), default=None) for g in set(label.tolist())}
    return [(ids[i], sum(hit[i]), least[int(label[i])] if unit[i] is not None else ids[i]) for i in range(n)]


@pytest.mark.parametrize(("block", "target"), [(None, 0.99), (7, 0.99), (9, 1.0)])
def test_embedding_dedup(spark, monkeypatch, block, target):
    if block:  # many blocks for each region
        monkeypatch.setattr(embed_dedup, "OWN", block)
        monkeypatch.setattr(embed_dedup, "MET", 2 * block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + 0.05 * rng.standard_normal(8)).tolist()) for i in range(25)]
    rows += [(200 + i, (base[1] + 0.45 * rng.standard_normal(8)).tolist()) for i in range(25)]
    rows += [(300 + i, base[2].tolist()) for i in range(5)] + [(300, base[2].tolist()), (310, (3 * base[2]).tolist())]
    rows += [(400, None), (401, [0.0] * 8), (402, [None] + [1.0] * 7), (403, [float("nan")] + [1.0] * 7), (404, [float("inf")] + [1.0] * 7), (405, []), (None, base[3].tolist())]
    rows += [(500 + i, (base[4][:3] + 0.2 * rng.standard_normal(3)).tolist()) for i in range(9)] + [(520, [2.0]), (521, [3.0]), (522, [-1.0])]  # other lengths
    rows += [(600, [0.9, math.sqrt(1 - 0.9 * 0.9)]), (601, [1.0, 0.0])]  # at the threshold
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "vec_id long, embedding array<double>, n_links int, key int, cell int")
    got = embed_dedup.near_duplicates(df, target=target).collect()
    assert key((r.vec_id, r.n_links, r.component_id) for r in got) == key(brute_links(rows, 0.9))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert key(by_sql(df, "embeddings", "op1_embedding_dedup", "vec_id, n_links, component_id, kept")) == key((*w, w[0] == w[2]) for w in brute_links(rows, 0.9))
    for few in (rows[:1], rows[61:67], []):
        df = spark.createDataFrame([(a, b, 1) for a, b in few], "vec_id long, embedding array<double>, n_links int")
        assert embed_dedup.near_duplicates(df).count() == len(few)


def test_embedding_links_just_above_the_threshold(spark):
    """Pairs at cosine 0.905, the hardest to find: the target's share of them, and all if asked for."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate((x, y)).tolist())], "vec_id long, embedding array<double>")
    truth = int((np.triu(np.concatenate((x, y)) @ np.concatenate((x, y)).T >= 0.9, 1)).sum())
    share = [embed_dedup.near_duplicates(df, target=t, per_cell=16).agg(F.sum("n_links")).first()[0] / 2 / truth for t in (0.99, 1.0)]
    assert 0.97 < share[0] <= 1 and share[1] == 1


def test_index_recall_and_traversal():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(6), rng.random(9)
    order = embed_dedup.multi_sequence(d1, d2, 54)
    sums = [d1[i] + d2[j] for i, j in order]
    assert sums == sorted(sums) and len(set(order)) == 54
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embed_dedup.MultiIndex(x, 10, 0.9, 0.99, 1)
    assert index.probes < 100
    y = 0.9 * x + np.sqrt(1 - 0.81) * (lambda u: u / np.linalg.norm(u, axis=1, keepdims=True))((u := rng.standard_normal(x.shape)) - (u * x).sum(1, keepdims=True) * x)
    assert (index.ranks(index.cells(x), index.cells(y)) < index.probes).mean() > 0.97


# ---------------------------------------------------------------- 2
def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ITEMS", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * 10 ** rng.uniform(-1, 1)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(8)] + [(50, rows[50][1])]  # ties, a repeated row
    rows += [(2000, None), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2100, [float("nan")] * 6), (2101, []), (2150, [0.0] * 6), (2102, [1.0])]
    rows += [(3000 + i, rng.standard_normal(2).tolist()) for i in range(120)] + [(3150, [1.0] * 7)]  # other lengths: searched by themselves, one has no candidate
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for qid in sorted({i for i, _ in ok if i % 50 == 0}):
        qs = [v for i, v in ok if i == qid]
        best = sorted(((-sum(a * b for a, b in zip(v, x, strict=True)), i) for v in qs for i, x in ok if i != qid and len(x) == len(v)))[:5]
        want += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    with pytest.raises(Exception, match="too long"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]


# ---------------------------------------------------------------- 3
def test_token_files(spark):
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, prose(30 * i, i).capitalize() + "., don't  Übung 12 \u00a0x\n" + "é́") for i in range(40)]
    rows += [(90, None), (91, ""), (92, "a <|endoftext|> B <|ENDOFTEXT|>"), (93, "§ ¶ ©" * 4), (94, "y" * 4000), (20, "again"), (-5, "first"), (95, prose(9000, 1)), (96, "Σας ΣΑΣ a.b c.,d"), (None, "no id")]
    assert token_files.splits_at_white_space(path)
    manifest = token_files.write_token_files(frame(spark, rows), path, end_id=2, parts=3, length=64, batch=4)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(manifest).collect()]
    at, want, ids_of = 0, [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of[at] = ids
        at += len(ids)
    twenty = {r[1:] for r in got if r[0] == 20}
    assert key(r for r in got if r[0] != 20) == key(r for r in want if r[0] != 20)
    # of two rows with one id either may come first
    (a, n, _), (b, _, _) = sorted(twenty)
    assert b == a + n and a == min(r[1] for r in want if r[0] == 20) and {r[1:] for r in twenty} == {r[2:] for r in want if r[0] == 20}
    part = [m for m in manifest.orderBy("part").collect() if m.docs][0]
    reader = token_files.SequenceReader(part.file + ".tokens")
    assert reader.length == 64 and reader.reader.schema.field("input_ids").type == pa.list_(pa.uint16(), 64)
    first, mask = reader.sequence(0)
    assert first.tolist() == [x for s in sorted(ids_of) for x in ids_of[s]][:64] and all(mask.to_pylist())
    last = -(-part.tokens // 64) - 1
    assert sum(reader.sequence(last)[1].to_pylist()) == part.tokens - 64 * last
    assert not first.flags.owndata  # a view
    empty = token_files.write_token_files(frame(spark, []), path)
    assert token_files.read_digests(empty).count() == 0


# ---------------------------------------------------------------- 4
def test_chats(spark):
    rows = [(1, 1, "assistant", "a\\[INST] </s>[TURN]\\"), (1, 0, "user", "<s>hi"), (1, 2, "assistant", "b"), (1, 3, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "a[/INST]s", ""), (None, 5, "assistant", "y" * 3000), (4, None, "assistant", "é\U0001f600"), (5, 0, "assistant", "\\"), (5, 1, "assistant", "\\")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df)
    assert {r.conv_id: r.blocks for r in out.collect()}[1] == 3
    back = {r.conv_id: r for r in chat.read_chats(out).collect()}
    import hashlib

    digest = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -(2**63), ro or "", x or "") for cc, t, ro, x in rows if cc == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(ro, x) for _, ro, x in turns]
        loss = "".join(x for _, ro, x in turns if ro == "assistant")
        assert back[c].loss_text == loss and digest[c].loss_chars == len(loss) and digest[c].formatted_chars == len(back[c].formatted)
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in turns).encode()).hexdigest()
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[c].n_turns == len(turns)
    plan = chat.digests(out)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and chat.format_chats(df.filter("conv_id > 99")).count() == 0
    # rows without a conversation's id are conversations of their own
    lone = spark.createDataFrame([(None, i, "assistant", f"t{i}") for i in range(5)], "conv_id long, turn long, role string, text string")
    assert sorted(r.loss_text for r in chat.read_chats(chat.format_chats(lone)).collect()) == [f"t{i}" for i in range(5)]


def test_long_chats_take_work_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id) text")
        out = chat.format_chats(df).cache()
        start = time.time()
        out.count()
        took = time.time() - start
        row = chat.read_chats(out).collect()[0]
        assert len(row.turns) == n and row.loss_text == "".join(f"t{i}" for i in range(1, n, 2))
        return took

    seconds(100)
    assert seconds(20_000) < 15


# ---------------------------------------------------------------- 5
def brute_mix(rows, weights, max_epochs, seed, budget=None):
    import hashlib

    meta = []
    for i, t, lang, source in rows:
        s = source or ""
        m = re.search(r"([0-9]{1,9})$", s)
        meta.append((i, (f"d{int(m[1]) % 3 if m else 0}", lang or "", s), len(WORD.findall(t or ""))))
    tokens = Counter()
    for _, leaf, n in meta:
        tokens[leaf] += n
    w = lambda level, name: getattr(weights, level).get(name, weights.other)

    def share(total, children):  # name -> (weight, capacity)
        got, open_ = {}, dict(children)
        while open_:
            all_w = sum(x[0] for x in open_.values())
            full = [n for n, (a, c) in open_.items() if c * all_w <= total * a]
            if not full:
                return got | {n: a * total // all_w for n, (a, c) in open_.items()}
            n = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
            got[n] = open_.pop(n)[1]
            total -= got[n]
        return got

    cap = {leaf: n * max_epochs for leaf, n in tokens.items()}
    total = sum(tokens.values()) if budget is None else budget
    got = {}
    doms = {leaf[0] for leaf in tokens}
    by_d = share(total, {d: (w("domain", d), sum(c for leaf, c in cap.items() if leaf[0] == d)) for d in doms})
    for d in doms:
        langs = {leaf[1] for leaf in tokens if leaf[0] == d}
        by_l = share(by_d[d], {x: (w("lang", x), sum(c for leaf, c in cap.items() if leaf[:2] == (d, x))) for x in langs})
        for x in langs:
            got |= {(d, x, s): v for s, v in share(by_l[x], {leaf[2]: (w("source", leaf[2]), c) for leaf, c in cap.items() if leaf[:2] == (d, x)}).items()}
    out = []
    for leaf in tokens:
        epochs, rest = divmod(got[leaf], tokens[leaf]) if tokens[leaf] else (1, 0)
        keyed = [(hashlib.md5(f"{seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest(), i, n) for i, lf, n in meta if lf == leaf]
        for k, i, n in keyed:
            cum = sum(x for kk, _, x in keyed if kk <= k)
            if copies := epochs + (rest > 0 and cum <= rest):
                out.append((i, *leaf, n, copies))
    return out


@pytest.mark.parametrize("budget", [None, 500, 0, 10**6])
def test_mixing(spark, budget):
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 40), i), r.choice(["en", "de", None]), r.choice(["src0", "src1", "src2", "src31", "web", None])) for i in range(150)]
    rows += [(i, prose(9, i), "en", "src4") for i in range(200, 400)] + [(7, "a b", "en", "src4"), (7, "a b", "en", "src4"), (None, "c", "en", "src4"), (998, None, "xx", "src5"), (999, "", "xx", "src5")]
    df = spark.createDataFrame([(i, t, a, b, 0, "c") for i, t, a, b in rows], DOCS + ", copies string")
    weights = mixing.Weights({"d0": 5, "d1": 2}, {"en": 3}, {"src4": 7}, other=1)
    got = [tuple(x) for x in mixing.mix(df, weights, budget=budget, max_epochs=3, seed=5).collect()]
    want = brute_mix(rows, weights, 3, 5, budget)
    assert key(got) == key(want)
    mixed = mixing.mixed_documents(df, weights, budget=budget, max_epochs=3, seed=5)
    assert mixed.columns == df.columns and mixed.count() == sum(x[-1] for x in want)
    assert mixing.mix(df.filter("doc_id < -1"), weights).count() == 0


# ---------------------------------------------------------------- 6
def test_language_model(spark, corpus):
    rows = [(i, t) for i, t in corpus] + [(600 + i, prose(80, 600 + i)) for i in range(40)]
    out = maxent.score(frame(spark, rows), rounds=2).collect()
    toks = lambda t: [*WORD.findall(ascii_lower(t)), None]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t in rows if learn(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = [(i, not learn(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in rows]
    assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == key(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert maxent.score(frame(spark, [])).count() == 0
    none = maxent.score(frame(spark, [(None, "a b"), (None, None)]), rounds=1).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def test_language_model_learns(spark):
    """Texts in two invented languages: the class of a word tells much about the next one's."""
    r = random.Random(5)
    words = [["".join(r.choice(a) for _ in range(4)) for _ in range(150)] for a in ("abcde", "vwxyz")]
    rows = [(i, " ".join(r.choice(words[i % 2]) for _ in range(120))) for i in range(900)]
    out = maxent.score(frame(spark, rows)).toPandas()
    held = out[out.held_out]
    assert (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum() > 0.1
    assert np.isclose(out.score.sum(), maxent.score(frame(spark, rows[::-1]).repartition(7)).toPandas().score.sum(), rtol=1e-9)


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * by % 2**64
    return x ^ (x >> 31)


def brute_scores(spark, rows, rounds, rate, bits):
    """The model by its definition, a token at a time in plain Python."""
    w, t = maxent.WIDTH, maxent.TYPES
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    texts = [[*WORD.findall(ascii_lower(x)), None] for _, x in rows]
    count = Counter(x for ok, text in zip(learn, texts, strict=True) if ok for x in text)
    word_hash = {x: int(hash_words(pa.array([x])).hashes[0]) for text in texts for x in text if x} | {None: int(maxent.END_HASH[0])}

    def suffix(x):
        b = x.encode()[::-1][:3]
        return mixed(int.from_bytes(b.ljust(3, b"\0"), "big")) % maxent.SUFFIXES

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    heads = sorted((x for x in count if x and count[x] >= maxent.HEAD_LEAST), key=lambda x: (-count[x], signed(word_hash[x])))
    type_of = {x: maxent.START + 1 + heads.index(x) if x in heads else suffix(x) if x else maxent.END for text in texts for x in text}
    types = [[type_of[x] for x in text] for text in texts]
    table = np.zeros((t, maxent.CONTEXTS))
    for ok, text in zip(learn, types, strict=True):
        for was, x in zip([maxent.START, *text], text, strict=False):
            table[x, mixed(was + 77) % maxent.CONTEXTS] += ok
    classes = maxent.classes_of(table)
    tokens, words = Counter(), Counter()
    for x, c in count.items():
        tokens[type_of[x]] += c
        words[type_of[x]] += 1
    cell = {}
    for k in range(w):
        mine = sorted((x for x in range(t) if classes[x] == k), key=lambda x: (-tokens[x], x))
        cell |= {x: r if r < w - maxent.SHARED and tokens[x] else w - maxent.SHARED + x % maxent.SHARED for r, x in enumerate(mine)}
    cell[maxent.END] = cell[maxent.START] = 0
    size = np.full((w, w), 0.1)
    there = np.zeros((w, w), bool)
    for x in range(t):
        size[classes[x], cell[x]] += tokens[x] + 0.1 * words[x]
        there[classes[x], cell[x]] = True
    bias = {(): np.log(np.where(there, size, 0).sum(1) + 1e-30)} | {(k,): np.where(there[k], np.log(size[k]), -1e9) for k in range(w)}
    theta, steps = {k: v.copy() for k, v in bias.items()}, {}

    def features(text, i):
        a, b = (text[i - k] if i >= k else maxent.START for k in (1, 2))
        hashes = [mixed(x) for x in (a + 1, a * t + b + 2**40, b + 2**41)]
        k = int(classes[text[i]])
        first = [(), *(("class", f, h >> (64 - bits)) for f, h in enumerate(hashes))]
        return (first, k), ([(k,), *(("cell", f, (h ^ k) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits)) for f, h in enumerate(hashes))], cell[text[i]])

    def probabilities(weights, keys):
        z = sum(weights.get(f, np.zeros(w)) for f in keys)
        e = np.exp(z - z.max())
        return e / e.sum()

    key = [signed(mixed(sum((i + 1) * word_hash[x] for i, x in enumerate(text)) % 2**64)) for text in texts]
    ids = spark.createDataFrame([(n, i, k) for n, ((i, _), k) in enumerate(zip(rows, key, strict=True))], "n long, doc_id long, key long")
    shard = {r.n: r.s for r in ids.select("n", F.pmod(F.xxhash64("doc_id", "key"), F.lit(rounds)).alias("s")).collect()}
    for r in range(rounds):
        mine = sorted((n for n in range(len(rows)) if learn[n] and shard[n] == r), key=lambda n: (key[n], rows[n][0]))
        all_ = [features(types[n], i) for n in mine for i in range(len(types[n]))]
        step = min(max(len(all_) // 64, 256), 8192)
        for i in range(0, len(all_), step):
            for factor in (0, 1):
                moves = {}
                for keys, y in (x[factor] for x in all_[i : i + step]):
                    g = probabilities(theta, keys)
                    g[y] -= 1
                    for f in keys:
                        moves.setdefault(f, []).append(g)
                for f, gs in moves.items():
                    g = sum(gs) / math.sqrt(len(gs))
                    steps[f] = steps.get(f, 0) + (g**2).mean()
                    theta[f] = theta.get(f, np.zeros(w)) - rate * g / math.sqrt(steps[f] + 0.1)
    out = []
    for (i, _), text, ts in zip(rows, texts, types, strict=True):
        p = 0.0
        for n, x in enumerate(text):
            for keys, y in features(ts, n):
                p += math.log10(probabilities(theta, keys)[y])
            p += math.log10((count[x] + 0.1) / size[classes[ts[n]], cell[ts[n]]])
        out.append((i, p))
    return out


def test_language_model_equals_brute_force_whatever_the_partitions(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(VOCAB[: 40 + 400 * (i % 2)]) for _ in range(r.randint(0, 60)))) for i in range(70)] + [(None, "a b"), (500, None), (501, "never seen before"), (7, "twice"), (7, "twice")]
    want = sorted(brute_scores(spark, rows, 2, 0.25, 8), key=repr)
    for parts in (1, 4, 16):
        df = frame(spark, rows).withColumns({"score": F.lit("x"), "train": F.lit(1), "key": F.lit(2)}).repartition(parts)
        got = sorted(((x.doc_id, x.score) for x in maxent.score(df, rounds=2).collect()), key=repr)
        assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], rtol=1e-4)


def test_language_model_averages_shards_and_adds_up_to_one(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(VOCAB[:60]) for _ in range(50))) for i in range(200)]
    one, many = (maxent.score(frame(spark, rows).repartition(n), rounds=2, shard_tokens=900).toPandas().sort_values("doc_id").score for n in (1, 9))
    assert np.allclose(one, many, rtol=1e-6)
    classes = np.arange(maxent.TYPES) % (maxent.WIDTH - 1)
    classes[[maxent.END, maxent.START]] = maxent.WIDTH - 1
    counts = np.random.default_rng(1).integers(0, 3, (maxent.TYPES, 1)).repeat(2, 1)
    m = maxent.Model.untrained(classes, counts, 8)
    m.theta[1 + maxent.WIDTH :] = np.random.default_rng(2).standard_normal(m.theta[1 + maxent.WIDTH :].shape)
    before = np.array([[1, 2, 3], [maxent.START] * 3])
    total = np.zeros(2)
    p = np.exp(maxent.log_softmax(m, np.zeros(2, int), m.rows(before, np.zeros(2, int))[0], False))
    for k in range(maxent.WIDTH):  # cells with types only, and the words of each with one unseen add up to 1
        total += p[:, k] * np.exp(maxent.log_softmax(m, np.full(2, 1 + k), m.rows(before, np.full(2, k))[1], True)).sum(1)
    assert np.allclose(total, 1, atol=1e-4)


# ---------------------------------------------------------------- 7
def test_sentencepiece(spark):
    import sentencepiece

    path = q.tokenizer_file("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), spm.load(path)
    r = random.Random(2)
    letters = ' \n\t\rabcdeéßth.,inger▁中文日本👍АБвгaaaa   ===---0123456789"\'<>'
    texts = [None, "", " ", "   ", "a" * 700, "=" * 900, " " * 333, "\r\n a\r", "x▁ y", *("".join(r.choice(letters) for _ in range(r.randint(1, 90))) for _ in range(500)), prose(5000, 3)]
    ids, n = spm.encode_batch(m, pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in sp.encode(t or "")] and n.tolist() == [len(sp.encode(t or "")) for t in texts]
    df = frame(spark, list(enumerate(texts)))
    rows = spm.encode(df, path).collect()
    assert [x.ids for x in sorted(rows, key=lambda x: x.doc_id)] == [sp.encode(t or "") for t in texts] and all(x.round_trip for x in rows)
    back = spm.decode(spm.encode(df, path), path).collect()
    assert {x.doc_id: x.text for x in back} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert spm.encode(frame(spark, []), path, digest=True).count() == 0


def test_streaming_commits_within_a_bounded_window():
    import sentencepiece

    path = q.tokenizer_file("piece_bpe_32k.model")
    m = spm.load(path)
    text = ("internationalization-of-everything" + "=" * 37) * 60
    v, out = spm.StreamingViterbi(m), []
    for k in range(0, len(text), 11):  # however it arrives
        out += v.feed(text[k : k + 11])
        assert len(v.text) <= 4 * m.longest + 64
    assert len(out) > 100  # before the text ends
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert spm.encode_many(m, [text]) == [out + v.close()] and v.committed == len(out + v.close()) and v.fed == len(text)
    assert spm.encode_many(m, ["\u2581" + text]) == [sp.encode(text)]


def test_every_stretch_is_fed_and_committed(monkeypatch):
    """The query's path: whatever isn't remembered is searched by the streaming search, in a bounded window."""
    import sentencepiece

    path = q.tokenizer_file("piece_bpe_32k.model")
    m, sp = spm.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    seen = []

    class Counting(spm.StreamingViterbi):
        def __init__(self, model):
            super().__init__(model)
            seen.append(self)

    monkeypatch.setattr(spm, "StreamingViterbi", Counting)
    texts = [prose(400, 1), prose(30, 2) + "-" * 500 + prose(5, 3).replace(" ", "."), "x" * 5000, "one", ""]
    for text in texts:
        m.cache = spm.IdCache(np.int32)  # nothing is remembered from other texts
        seen.clear()
        ids, _ = spm.encode_batch(m, pa.array([text]))
        assert ids.tolist() == sp.encode(text)
        new = {("" if i else "\u2581") + x for i, x in enumerate(re.findall(r" *[^ ]+", text))}
        assert sum(v.committed for v in seen) == sum(len(sp.encode(x.replace("\u2581", "", 1)) if x[0] == "\u2581" else sp.encode(x[1:])) for x in new)
        assert max((v.widest for v in seen), default=0) <= 3 * spm.PORTION and sum(v.fed for v in seen) <= sum(map(len, new))
    assert sum(v.fed for v in seen) == 0


# ---------------------------------------------------------------- 8
def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        t = prose(r.randint(20, 120), i)
        if junk:
            t = " ".join(w + r.choice(["$$$", "###", "***"]) for w in t.split()) if i % 8 else " ".join(["buy now"] * 40)
        rows.append((i, t))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not junk), 0))
    rows += [(900, None), (901, ""), (902, " "), (903, "z" * 50_000), (None, "abc"), (5, rows[5][1])]
    labels += [(0, None, 0), (4, 0, 0), (None, 1, 0), (7777, 1, 0)]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(df, lab).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    ids = out.doc_id.notna()
    assert (out[ids].held_out == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in out[ids].doc_id]).all() and out[~ids].held_out.all()
    held = out[ids & out.held_out & (out.doc_id < 400)]
    assert ((held.doc_id % 4 != 0).astype(int) == held.predicted).mean() > 0.97
    kept = quality.keep_good(df.withColumn("score", F.lit("s")), lab)
    assert kept.columns == [*df.columns, "score"] and kept.count() == int(out.predicted.sum())
    # what isn't learned from changes nothing: flip the labels of held-out rows
    flipped = lab.withColumn("quality", F.when(quality.learnable(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert np.allclose(quality.score(df, flipped).toPandas().sort_values("doc_id").score, out.sort_values("doc_id").score)
    assert (quality.score(df, lab.filter("doc_id < -5")).toPandas().score == 0.5).all() and quality.score(frame(spark, []), lab).count() == 0


def test_isotonic_is_monotone_and_least_squares():
    n, s = np.array([2, 0, 3, 1, 4.0]), np.array([1, 0, 3, 0, 3.0])
    blocks = quality.isotonic(n, s)
    values = [v for _, _, v in blocks]
    assert values == sorted(values) and math.isclose(sum(v * n[a : b + 1].sum() for a, b, v in blocks), s.sum())


# ---------------------------------------------------------------- 9
@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_minhash(spark, corpus, words, percent):
    df = frame(spark, corpus).withColumns({"cls": F.lit("x"), "kept": F.lit(1)})
    got = minhash.near_duplicates(df, words=words, percent=percent, block=4).collect()
    want = brute_components(corpus, words, percent)
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if words == 3:
        assert key(by_sql(df, "documents", "op9_minhash_dedup", "doc_id, n_shingles, component_id, kept")) == key((*w, w[0] == w[2]) for w in want)
    stay = minhash.drop_near_duplicates(df, words=words, percent=percent)
    assert stay.columns == df.columns
    assert key({r.doc_id for r in stay.collect()}) == key({i for i, _, c in want if i == c}) and stay.count() == len({i for i, _, c in want if i == c})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_families_of_near_copies(spark, seed):
    """Families whose members link only in part, without their original."""
    r = random.Random(seed)
    rows = []
    for f in range(6):
        base = prose(r.randint(30, 160), 7000 + 10 * seed + f)
        rows += [(1000 * f + i, edited(base, r.choice([9, 14, 25, 40, 70]), 100 * f + i)) for i in range(14)]
    rows += [(9000 + i, " ".join(prose(r.randint(1, 12), i).split())) for i in range(30)]
    got = minhash.near_duplicates(frame(spark, rows), words=3, percent=85, block=r.choice([1, 3, 512])).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(brute_components(rows, 3, 85))


def test_minhash_small_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c"), (2, None), (3, "A  b\tc")]
    assert key((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_minhash_chain_of_near_copies(spark):
    """Neighbours link, ends don't: one component all the same."""
    t = prose(300, 77).split(" ")
    rows = []
    for i in range(12):
        rows.append((i, " ".join(t)))
        t[i * 20 : i * 20 + 7] = prose(7, 5000 + i).split(" ")
    got = minhash.near_duplicates(frame(spark, rows), words=3, percent=85, block=2).collect()
    want = brute_components(rows, 3, 85)
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(want) and {c for _, _, c in want} == {0}


def test_dropping_near_duplicates_goes_by_row_not_by_id(spark):
    """Rows with null or repeated ids: one of each component stays, and each row without shingles."""
    a, b = prose(40, 1), prose(40, 2)
    rows = [(5, a), (5, b), (3, b), *[(None, prose(30, 10 + i)) for i in range(6)], (None, prose(30, 10)), (None, b), (None, None), (None, ""), (8, None), (8, " ")]
    df = frame(spark, rows).withColumns({c: F.lit(7) for c in ("_cls", "_id", "_kind", "_best", "_text", "_kept_key", "c0", "a.b")})
    for order in (df.repartition(3), df.orderBy("text"), df.orderBy(F.desc("doc_id"))):
        stay = minhash.drop_near_duplicates(order)
        assert stay.columns == df.columns and stay.schema["_cls"].dataType == df.schema["_cls"].dataType
        stay = stay.collect()
        assert all(r["a.b"] == r["_kept_key"] == 7 for r in stay)
        got = key((r.doc_id, r.text) for r in stay)
        assert got == key(want_rows(a, b))


def want_rows(a, b):
    return [(5, a), (3, b), *[(None, prose(30, 10 + i)) for i in range(6)], (None, None), (None, ""), (8, None), (8, " ")]


def test_minhash_with_frequent_lists_and_small_blocks(spark, monkeypatch):
    """Joins that deal frequent keys over tasks, and blocks bounded by bytes, change nothing."""
    from tessera.llm import common

    was = common.join_spread
    monkeypatch.setattr(minhash, "join_spread", lambda big, small, keys, by, rows, how="inner": was(big, small, keys, by, rows, how))
    monkeypatch.setattr(common, "max", lambda *a: 3 if a and a[0] == 512 else max(*a), raising=False)  # every key with over three rows
    rows = [(i, edited(prose(120, 5000 + i % 3), 30, i)) for i in range(60)] + [(100 + i, edited(prose(90, 6000), 8, i)) for i in range(30)]
    got = minhash.near_duplicates(frame(spark, rows), words=3, percent=85, block_bytes=4000).collect()
    assert key((r.doc_id, r.n_shingles, r.component_id) for r in got) == key(brute_components(rows, 3, 85))


def test_workspaces_are_deleted(spark):
    import os

    from tessera.llm.common import scratch, shared_dir

    root = shared_dir(spark).removeprefix("file://")
    was = set(os.listdir(root))
    with scratch():
        assert minhash.near_duplicates(frame(spark, [(1, "a b c"), (2, "a b c")])).count() == 2
        assert set(os.listdir(root)) > was
    assert set(os.listdir(root)) == was


def test_minhash_bounds():
    for p in (0.8, 0.85):
        t = minhash.least_shared(p, 32, 1e-6)
        assert sum(math.comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(t)) <= 1e-6
    assert minhash.prefix_length(10, 85, 32, 16) == 2 and minhash.prefix_length(1000, 85, 32, 16) == 17


# ---------------------------------------------------------------- 10
def brute_judge(pages, rules, damping=85):
    lower = lambda s: ascii_lower(s)
    parsed = []
    for i, url, html in pages:
        _, found, rest = (url or "").partition("://")
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        parsed.append((i, lower(m[1]) if found else "", m[2] if found else "", html or ""))
    best, seeds, links = [], {}, Counter()
    for _, h, p, html in parsed:
        fit = [(len(r), v, r) for v, r in rules for rh, _, rp in [r.partition("/")] if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp)]
        b = max(fit, default=None)
        best.append(b and b[1:])
        s = seeds.setdefault(h, [0, 0])
        if b:
            s[b[1] == "block"] += 1
        for u in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)""", html):
            d = lower(re.match(r"[^/?#]*", u.partition("//")[2])[0])
            if d and d != h:
                links[h, d] += 1
    hosts = {*seeds, *(x for e in links for x in e)}
    total = [max(1, sum(s[k] for s in seeds.values())) for k in (0, 1)]
    start = {h: [seeds.get(h, [0, 0])[k] * 10**9 for k in (0, 1)] for h in hosts}
    out_w, in_w = Counter(), Counter()
    for (a, b), w in links.items():
        out_w[a] += w
        in_w[b] += w
    now, was = {h: [0, 0] for h in hosts}, None
    while now != was:
        was, got = now, {h: [0, 0] for h in hosts}
        for (a, b), w in links.items():
            got[b][0] += -(-now[a][0] * w // out_w[a])
            got[a][1] += -(-now[b][1] * w // in_w[b])
        now = {h: [-(-((100 - damping) * start[h][k] + damping * got[h][k]) // 100) for k in (0, 1)] for h in hosts}
    return [(i, h, p, b and b[1], b[0] if b else ("block" if now[h][1] * total[0] > now[h][0] * total[1] else "allow")) for (i, h, p, _), b in zip(parsed, best, strict=True)]


def test_url_filter(spark):
    link = lambda *u: "".join(f'<A class="x" href="{x}">t</A>' for x in u)
    pages = [
        (1, "https://Bad.com/en/1", ""), (2, "http://friend.com/x", link("https://bad.com/en/1", "//bad.com/y", "/own")), (3, "http://far.org/", link("http://friend.com/")), (4, "http://a.example.com/en/7?x=1", link("http://good.net/a", "http://far.org/")),
        (5, "http://good.net/b#f", None), (6, "http://x.net/de/1", link("http://both.io/")), (7, None, link("http://bad.com/")), (8, "no url", ""), (9, "ftp://net/de/8", ""), (10, "http://example.net/de/8/1", ""), (11, "http://z.example.net/de/81", ""),
        (12, "http://notcom/en/", ""), (13, "http://both.io", link("http://bad.com/")), (14, "a://b://c/d", ""), (None, "http://bad.com/fr", ""), (1, "https://Bad.com/en/1", ""), (15, "HTTP://ÄÖ.org/es/", "<a href=//q.org/es>"), (16, "://", "<a href='x://'>"),
    ]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, host string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(df, q.RULES).collect()]
    want = brute_judge(pages, q.RULES)
    assert key(got) == key(want)
    import duckdb

    db = duckdb.connect()
    db.register("pages", df.select("page_id", "url", "html").toArrow())
    assert key(db.sql(q.oracle_sql()["op10_url_filter"]).fetchall()) == key(want)
    plan = linkgraph.judge(df, q.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    by_id = {w[0]: w for w in want}
    assert by_id[2][4] == "block" and by_id[5][4] == "allow"  # distrust went against a link, trust along one
    assert linkgraph.judge(df.filter("page_id > 99"), q.RULES).count() == 0 and linkgraph.judge(df, []).count() == len(pages)


def test_url_filter_is_not_cut_by_resolution_or_rounds(spark):
    """Distrust arrives through 16 hosts and by one link of 20,000, whatever else the table holds."""
    ws = Workspace(spark, "far")
    chain = [(f"h{i}", f"h{i + 1}", 1) for i in range(16)]
    fan = [("rest", f"h{i + 1}", 19_999) for i in (2, 5, 8)]
    links = spark.createDataFrame(chain + fan, "src string, dst string, w long")
    seeds = spark.createDataFrame([("h16", 0, 10**9), ("z", 10**9, 0)], "host string, trust long, distrust long")
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(ws, seeds, links, damping=30).collect()}
    assert all(got[f"h{i}"][0] == 0 and got[f"h{i}"][1] > 0 for i in range(17)) and got["z"] == (10**9 * 70 // 100, 0)


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    good = [(i, prose(80, i), "en", f"src{i % 5}") for i in range(120)]
    junk = [(200 + i, " ".join(w + "$$$" for w in prose(60, i).split()), "en", "src1") for i in range(40)]
    copies = [(300 + i, edited(good[i][1], 60, i), "de", "src2") for i in range(20)]
    rows = [(i, t, a, b, len(t)) for i, t, a, b in good + junk + copies] + [(400, None, None, None, None), (401, "", "en", "src1", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 200 or i >= 300), 0) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [k for k, _ in cp.STAGES] == ["quality_classifier", "minhash_dedup", "source_mix", "sentencepiece"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        was = docs
        docs = stage(spark, was, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 3:
            assert docs.columns == was.columns
        seen.append((was, docs))
    kept = {r.doc_id for r in seen[0][1].collect()}
    assert kept >= {i for i, *_ in good + copies} and not kept & {i for i, *_ in junk}
    before = [(r.doc_id, r.text) for r in seen[0][1].collect()]
    assert {r.doc_id for r in seen[1][1].collect()} == {i for i, _, c in brute_components(before, 5, 80) if i == c}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in seen[1][1].collect()]
    want = Counter({x[0]: x[-1] for x in brute_mix(rows, q.MIX, q.MIX_EPOCHS, q.MIX_SEED)})
    assert Counter(r.doc_id for r in seen[2][1].collect()) == want
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in seen[2][1].collect()}
    last = seen[3][1].collect()
    assert len(last) == sum(want.values()) and all(r.ids == sp.encode(texts[r.doc_id] or "") and r.round_trip for r in last)
    assert key((r.doc_id, tuple(r.ids)) for r in cp.run(spark, str(tmp_path)).collect()) == key((r.doc_id, tuple(r.ids)) for r in last)
    assert json.dumps(cp.ORACLE_SQL) == "null"


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, a very long text, extra columns with names used inside, and an empty table."""
    import os

    import corpus_pipeline as cp
    from tessera.llm.common import shared_dir

    texts = [prose(60, i) for i in range(30)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (29, texts[5], "en", "src1", 1), (None, texts[6], None, None, None), (None, prose(60, 99), None, None, None)]
    rows += [(None, None, None, None, None), (50, None, "en", "src1", 0), (51, "", "en", "src1", 0), (52, prose(60_000, 7), "de", "src2", 1)]
    odd = ("_cls", "_id", "_text", "score", "copies", "domain", "ids", "key", "train", "cls", "c0")
    for name, some in (("full", rows), ("empty", [])):
        path = tmp_path / name
        spark.createDataFrame(some, DOCS).withColumns({c: F.lit("x") for c in odd}).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        docs = spark.read.parquet(str(path / "documents.parquet"))
        for k, (_, stage) in enumerate(cp.STAGES[:3]):
            out = stage(spark, docs, str(path))
            assert out.columns == docs.columns
            docs = Workspace(spark, "odd").write(out, f"s{k}")
            if k == 1 and some:
                assert key((r.doc_id, r.text) for r in docs.collect()) == key([(i, t) for i, t in enumerate(texts)] + [(None, prose(60, 99)), (None, None), (50, None), (51, ""), (52, prose(60_000, 7))])
        made = set(os.listdir(shared_dir(spark).removeprefix("file://")))
        got = cp.run(spark, str(path))
        assert got.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip"] and (got.count() > 0) == bool(some)
        assert len(set(os.listdir(shared_dir(spark).removeprefix("file://"))) - made) == 1  # the result's own folder


def test_queries_and_their_sql_have_the_same_columns(spark):
    assert set(q.oracle_sql()) <= set(q.queries()) and [int(re.match(r"op(\d+)_", n)[1]) for n in q.queries()] == list(range(1, 11))
