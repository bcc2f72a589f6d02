"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from lumenflow.llm import op11_topk as op11  # noqa: E402
from lumenflow.llm import op12_resampling as op12  # noqa: E402
from lumenflow.llm import op13_trie as op13  # noqa: E402


# --- 11


def best(rows, k=20, step=20):
    """(query_id, rank, vec_id, score) by plain integers."""
    ok = [(i, tuple(math.floor(64 * c) for c in x)) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    ok = [(i, tuple(max(-(1 << 26), min(1 << 26, c)) for c in x)) for i, x in ok]
    out = []
    for i, q in dict.fromkeys(r for r in ok if r[0] is not None and r[0] % step == 0):
        found = sorted(((-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, x in ok if j != i))[:k]
        out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [64, 1 << 15])
def test_top_products_of_odd_rows(spark, block_rows):
    rng = random.Random(3)
    vector = lambda n=9: [rng.gauss(0, 0.4) for _ in range(n)]
    hot = vector()
    rows = [(i, vector()) for i in range(300)] + [(1000 + i, hot) for i in range(150)]
    rows += [(40, rows[40][1]), (60, vector()), (81, rows[81][1]), (None, hot), (None, vector()), (-20, hot)]
    rows += [(400, None), (401, [0.1, None]), (402, [float("nan")] * 9), (420, [float("inf")] * 9), (440, []), (441, []), (460, vector(5)), (461, vector(14)), (480, [3e9, -3e9, 0.5]), (481, [1e30] * 9), (500, [0.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(0), "block": F.lit(1)})
    got = op11.top_products(df, block_rows=block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == best(rows)


def test_top_products_of_few_rows(spark):
    few = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.25, -1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, op11.top_products(few).collect())) == [(0, 1, 2, 32 * 64), (0, 2, 1, 32 * 16 - 32 * 64)]
    assert op11.top_products(few.filter("vec_id > 0")).count() == 0
    assert op11.top_products(few.limit(0)).count() == 0
    assert op11.top_products(few.filter("vec_id = 0")).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(4)
    x = rng.integers(-70, 70, size=(200, 17))
    least, planes = op11.sliced(x)
    block = op11.Block(200, np.arange(200), 0, least, planes)
    for q in (x[0], np.zeros(17, dtype=np.int64), -x[3] * 5, np.eye(17, dtype=np.int64)[2]):
        bits = block.sums(q)
        sums = sum(np.unpackbits(b.view(np.uint8), bitorder="little")[:200].astype(np.int64) << w for w, b in enumerate(bits))
        score = x @ q
        assert (sums - sums[0] == score - score[0]).all()
        assert (block.scores(np.arange(200), q) == score).all()


# --- 12


def resampled(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def features(text):
        ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(ws), Counter(crc32(f) % buckets for f in ws + [a + b" " + b for a, b in zip(ws, ws[1:])])

    own, want = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = sum((c for _, c in own), Counter()), sum((c for _, c in want), Counter())
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (n, c) in zip(rows, own):
        weight = sum(k * math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b, k in c.items()) // max(1, sum(c.values()))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


def texts(rng, n):
    words = ["Alpha", "beta", "ünï", "漢字", "gamma7", "x", "DELTA", "42", "Ärger", "zeta"]
    return [" ".join(rng.choice(words) + rng.choice(["", ".", "-y", "\n"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("slice_", [64, 1 << 20])
def test_resampling_of_odd_rows(spark, monkeypatch, slice_):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 120)))
    long = " ".join(texts(rng, 300))
    rows += [(200, None), (201, ""), (202, " .,\x00 "), (203, "x" * 100_000), (204, long), (5, rows[5][1]), (6, "other text"), (None, long), (None, None), (205, "É" * 50 + " " + "é" * 50), (-3, "A\x7fB\x80C")]
    target = ["alpha beta 42", None, "", "Ärger"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"weight": F.lit("x"), "rank": F.lit(1), "words": F.lit(2)})
    from lumenflow.llm.op12_resampling import _counted

    matrix = [_counted([memoryview((t or "").encode())], 10_000) for _, t in rows]
    monkeypatch.setattr(op12, "SLICE", slice_)
    for (words, _, indices, counts), (_, t) in zip(matrix, rows):  # slices change nothing
        again = op12._counted([memoryview((t or "").encode())], 10_000)
        assert again[0] == words and (again[2] == indices).all() and (again[3] == counts).all()
    got = op12.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(random.Random(6), 30))], "doc_id long, text string")
    none = docs.limit(0)
    assert op12.resampled(none, docs).count() == 0
    want = resampled([tuple(r) for r in docs.collect()], [])
    assert sorted(map(tuple, op12.resampled(docs, none).collect()), key=str) == want


def test_count_matrix_blocks(spark):
    rows = list(enumerate(texts(random.Random(7), 50)))
    blocks = op12.count_matrix(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = {}
    for b in blocks:
        assert b.indptr[0] == 0 and b.indptr[-1] == len(b.indices) == len(b.counts) and len(b.indptr) == len(b.doc_ids) + 1
        n |= {i: sum(b.counts[x:y]) for i, x, y in zip(b.doc_ids, b.indptr, b.indptr[1:])}
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    assert n == {i: max(0, 2 * words(t) - 1) for i, t in rows}


# --- 13


def trie(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def talks(rng, n, most=12):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["yes", "no", "ünï", ""])))
    return rows


def test_trie_of_odd_rows(spark):
    rng = random.Random(8)
    rows = talks(rng, 60)
    rows += [(100 + i, t, r, x) for i in range(40) for t, r, x in [(0, "user", "hi"), (1, "assistant", "hot"), (2, "user", "bye")]]  # a large group of copies
    rows += [(200, t, "user", f"turn {t}") for t in range(25)] + [(1200, t, "user", f"turn {t}") for t in range(24)]  # long ones that share
    rows += [(300, None, None, None), (300, 1, None, "x"), (300, 1, "x", None), (300, 1, "x", None), (-7, 0, "user", "a"), (-5, 3, "user", "b"), (None, 0, "user", "lost"), (311, 0, "user", "has base?"), (-1, 0, "user", "a"), (0, 99, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "n_convs": F.lit(1), "digest": F.lit("y")})
    got = op13.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert op13.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(7, 0, "user", "x")], [(c, 0, "user", "x") for c in (1, 2, 3, 4)], [(None, 0, "user", "x")]):
        assert sorted(map(tuple, op13.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == trie(rows)


def test_joined_hashes_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(op13, "PIECE", 50)
    rows = [(k, i) for k in (1, 2) for i in range(k, 900 * k, 7)]
    got = {r.class_id: r.ends for r in op13.joined_hashes(spark.createDataFrame(rows, "class_id long, conv_id long")).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for c, i in rows if c == k).encode()).hexdigest() for k in (1, 2)}
