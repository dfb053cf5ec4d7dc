"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import cover_tree, exact_dedup, simhash, suffix_dedup
from sparkloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, salt string, digest string, norm string"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, "y") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["the", "Ärger", "of", "zu", "data", "q9", "…", "lorem"]) + rng.choice(["", "", "x", "yz"]) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([0, 1, 2, 5, 30, 80])) for _ in range(40)]
    passage = words(rng, 20)
    out = list(base)
    for t in base[:20]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
        out.append(rng.choice(["", "  "]) + t.replace(" ", rng.choice([" ", "\t", "\n "])))
        out.append(t + " " + passage)
    out += ["ab" * 60, "ab" * 61, "a" * 49, "a" * 50, "a" * 120, None, "", " \n", "word " * 3000]
    rng.shuffle(out)
    rows = list(enumerate(out))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, None)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 261)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact(spark, digest):
    rows = corpus(1)
    got = exact_dedup.exact_groups(docs_of(spark, rows), digest=digest).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = sorted((str(i), str(min(groups[norm(t)])[2]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0
    stay = exact_dedup.exact_dedup(docs_of(spark, [r for r in rows if r[0] is not None]))
    assert stay.count() == len({norm(t) for i, t in rows if i is not None}) and stay.columns[0] == "doc_id" and len(stay.columns) == 8


def test_stages_take_any_column_names(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a  b c d e f "), (3, None), (4, ""), (None, "x y z"), (None, "x y  z"), (5, "p q r"), (5, "unrelated words here")]
    names = ["keep", "sha", "nth", "gone", "__keep", "__n", "__sha", "__gone", "node", "component", "best", "doc_id_2", "n", "chars"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for dedup, want in ((exact_dedup.exact_dedup, 5), (simhash.simhash_dedup, 5)):
        got = dedup(docs)
        assert got.columns == docs.columns
        assert got.count() == want


def test_exact_dedup_of_a_hot_null_id(spark):
    rows = [(None, "same text" + " " * (k % 3)) for k in range(90)] + [(None, f"t{k}") for k in range(5)]
    got = [r.text for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted(["same text  "] + [f"t{k}" for k in range(5)])


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus(2)
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    low = {f: f for _, f in fps}
    for _ in low:
        for f in low:
            low[f] = min(low[g] for g in low if (f ^ g).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[low[f]] = min(i, least.get(low[f], i))
    want = sorted((str(i), f"{f:016x}", str(least.get(low[f]))) for i, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    few = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "other words here"), (None, "x y z"), (None, "x y z"), (None, None)]
    stay = simhash.simhash_dedup(docs_of(spark, few))
    assert sorted((str(r.doc_id), str(r.text)) for r in stay.collect()) == [("1", "a b c d"), ("3", "other words here"), ("None", "None"), ("None", "x y z")]


@pytest.mark.parametrize("short", [2, 48])
def test_ring_links_find_every_link(short, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    rng = np.random.default_rng(3)
    x = [int(v) for v in rng.integers(0, 2**63, 40)]
    for _ in range(400):
        v = x[rng.integers(len(x))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            v ^= 1 << int(b)
        x.append(v)
    fps = np.array(sorted(set(x)), dtype=np.uint64)
    links = [simhash.ring_links(fps, s) for s in range(simhash.SEGMENTS)]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for to in links:
        for i, j in enumerate(to.tolist()):
            up[root(i)] = root(j)
    want = list(range(len(fps)))
    for _ in range(40):
        for i, f in enumerate(fps):
            near = np.flatnonzero(np.bitwise_count(fps ^ f) <= 2)
            want[i] = min(want[k] for k in near)
    assert len({(root(i), want[i]) for i in range(len(fps))}) == len(set(want)) == len({root(i) for i in range(len(fps))})


@pytest.mark.parametrize("limits", [{}, {"ARRAY_BYTES": 200}, {"ARRAY_BYTES": 200, "PLACE_BITS": 9}])
def test_passages(spark, monkeypatch, limits):
    """Also with common anchors (a shared phrase between unlike words) whose groups are parted, and texts cut in parts."""
    if limits:  # by the same steps in this process: patches don't reach the workers
        check_passages_here(monkeypatch, limits)
        return
    for seed in (3, 4):
        rows = corpus(seed)
        got = suffix_dedup.passage_dedup(docs_of(spark, rows), block_mb=0.004).collect()
        first = {}
        for i, t in rows:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], 10**9), 10**9 if i is None else i)
        want = []
        for i, t in rows:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < (10**9 if i is None else i):
                    gone[k : k + 50] = b"\1" * 50
            want.append((str(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert suffix_dedup.passage_dedup(docs_of(spark, [])).count() == 0


def check_passages_here(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(7)
    common = "this phrase of thirty-five bytes is here"
    texts = [t or "" for _, t in corpus(5)] + [f"{rng.choice(['ab', 'cd', 'ef'])}{rng.choice('xyz') * 9}{common}{rng.choice('uvw') * 12}{rng.random()}" for _ in range(150)]
    data = [t.encode() for t in texts]
    first = {}
    for i, b in enumerate(data):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    keys, ctxs, docs, places = [], [], [], []
    for a, flat, starts, at, z, f, l in suffix_dedup._parts(data):
        doc = np.searchsorted(starts, at, side="right") - 1
        keys.append(z), ctxs.append(suffix_dedup._contexts(flat, at, f, l)), docs.append(a + doc), places.append(at - starts[doc])
    keys, ctxs, docs, places = map(np.concatenate, (keys, ctxs, docs, places))
    lows = suffix_dedup._resolve(keys, ctxs, docs.astype(np.int64))
    seen = set()
    for r in range(len(keys)):
        for o in range(int(ctxs[r, suffix_dedup.CONTEXT]), int(ctxs[r, suffix_dedup.CONTEXT + 1]) - 49):
            start = int(places[r]) - suffix_dedup.SIDE + o
            seen.add((int(docs[r]), start))
            assert lows[r, o] == first[data[docs[r]][start : start + 50]]
    assert seen == {(i, k) for i, b in enumerate(data) for k in range(len(b) - 49)}


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_cover_tree(spark, block_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    near = [x[k % 9] + rng.normal(size=8) * rng.choice([1e-9, 0.05, 0.2, 0.3]) for k in range(160)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([*x, *near, *x[:30], *x[:5] * 3])]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-0.0, 1.0] * 4), (909, [0.0, 1.0] * 4), (None, rows[0][1]), (7, rows[7][1])]
    got = cover_tree.near_duplicates(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, mult int"), block_rows=block_rows).collect()

    def unit(i, v):
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    u = [unit(*r) for r in rows]
    link = [[b for b in range(len(u)) if b != a and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9] for a in range(len(u))]
    low = [r[0] for r in rows]
    for _ in rows:
        for a, to in enumerate(link):
            if to:
                low[a] = min(low[a], *(low[b] for b in to))
    want = sorted((str(i), len(link[a]), str(low[a]), i is not None and i == low[a]) for a, (i, _) in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_sends_blocks_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *(x[k % 7] + rng.normal(size=6) * 0.2 for k in range(60))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent, real = [], cover_tree.cut

    def cut(frame):
        out = real(frame)
        if out.columns == ["id", "links", "root"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(cover_tree, "cut", cut)
    want = sorted(map(tuple, cover_tree.near_duplicates(df).collect()))
    once = len(sent)
    got = sorted(map(tuple, cover_tree.near_duplicates(df, block_rows=40, round_bytes=1).collect()))
    assert got == want and any(r[1] for r in got)
    assert len(sent) - once > 2


def test_cover_tree_of_repeated_ids_and_huge_values(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, -1.0])]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    rows = [(1, [1e200, 1e199]), (2, [9e199, 1.5e199]), (3, [1e-200, 1e-201]), (4, [-1e200, 0.0]), (5, [5e-324, 0.0])]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 3, 1)]


class Here:
    """Steps over groups run in this process, on frames of pandas; `most` gets the most memory that a call took, by the function's name."""

    def __init__(self, pdf, most, key=None, other=None):
        self.pdf, self.most, self.key, self.other = pdf, most, key, other

    def groupBy(self, key):
        return Here(self.pdf, self.most, key)

    def cogroup(self, other):
        return Here(self.pdf, self.most, self.key, other)

    def applyInPandas(self, f, schema):
        out = []
        for k in sorted(set(self.pdf[self.key]) | (set(self.other.pdf[self.key]) if self.other else set())):
            frames = [x.pdf[x.pdf[self.key] == k].reset_index(drop=True) for x in (self, self.other) if x]
            tracemalloc.start()
            out.append(f(*frames))
            self.most.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        return Here(pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True), self.most)

    def mapInPandas(self, f, schema):
        return Here(pd.concat(f(iter([self.pdf])), ignore_index=True), self.most)


def test_passages_take_little_memory(monkeypatch):
    """Every text occurs twice, so each string has its context sent and resolved: the most that a task has to hold."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.randrange(10**9):x}" for _ in range(900)).encode() for _ in range(200)] * 2
    size = sum(map(len, texts)) // 2
    docs = pd.DataFrame({"block": [i % 2 for i in range(200)] * 2, "doc_id": range(400), "text": texts})
    most = []
    monkeypatch.setattr(suffix_dedup, "in_blocks", lambda *a: (Here(docs, most), 2))
    got = suffix_dedup.passage_dedup(None).pdf
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got.sort_values("doc_id").itertuples()] == [(len(t), len(t) * (i >= 200), int(i >= 200)) for i, t in enumerate(texts)]
    assert max(most) < 25 * size, [round(m / size, 1) for m in most]


@pytest.mark.parametrize("limits", [{}, {"SLICE_ROWS": 1, "CHUNK_BYTES": 1}, {"SLICE_ROWS": 7, "CHUNK_BYTES": 300, "ARRAY_BYTES": 200}])
def test_passages_in_slices(monkeypatch, limits):
    """Blocks and buckets of a few rows at a time, common anchors that outgrow a slice, empty texts between others, null and repeated ids."""
    for name, value in limits.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(13)
    rows = corpus(6) + [(None if k % 9 == 0 else 500 + k // 2, f"{rng.choice(['ab', 'cd'])}{rng.choice('xyz') * 9}this phrase of thirty-five bytes is here{rng.choice('uvw') * 12}{k % 40}") for k in range(120)]
    rng.shuffle(rows)
    data = [(10**9 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 10**9), i)
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.append((i, b, [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    docs = pd.DataFrame({"block": [k % 3 for k in range(len(rows))], "doc_id": pd.array([i for i, _ in rows], dtype=object), "text": [b for _, b in data]})
    monkeypatch.setattr(suffix_dedup, "in_blocks", lambda *a: (Here(docs, []), 4))
    got = suffix_dedup.passage_spans(None).pdf
    assert sorted((10**9 if i is None else i, t, list(zip(s, e))) for i, t, s, e in got.itertuples(index=False)) == sorted(want)
