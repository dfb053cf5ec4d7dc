"""BPE against the whole-text library, Katz scores against dictionaries."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from sparkloom.llm import bpe, katz
from tests.llm.test_dedup import corpus, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_encode_like_the_whole():
    rng = random.Random(8)
    alphabet = ["a", "Z", "é", "é", "̈", " ", "\n", "\t", "　", " ", "\x1c", "\x85", "1", "'s", "'", "!", "漢字", "İ", "Σ", "ς", "😀", "<|endoftext|>", "<|start", "the ", "word ", "\x00", "\a", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += ["x" * 5000, "漢" * 3000, "a b " * 900, "", " ", "<|endoftext|> a <|endoftext|>"]
    t = bpe.tokenizer(PATH)
    encoder = bpe.Encoder(PATH)
    for text, doc in zip(texts, bpe.pieces([x.encode() for x in texts]), strict=True):
        assert b"".join(p for p, _ in doc) == text.encode()
        got = encoder.encode([p for p, _ in doc])
        want = t.encode(text, add_special_tokens=False)
        ids = [int(i) for g in got for i in g[0].split()]
        assert ids == want.ids
        assert b" ".join(g[1] for g in got if g[0]).decode() == t.decode(want.ids, skip_special_tokens=False)


def odd_texts():
    rng = random.Random(18)
    alphabet = ["a", "Z", "é", "̈", " ", " ", "\n", "\t", "\x85", "1", "'s", "!", "漢字", "İ", "Σ", "😀", "<|endoftext|>", "the ", "word ", "\a", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(80)]
    return texts + ["x" * 5000, "漢" * 3000, "a b " * 900, "", " ", " " * 3000 + "a" + " " * 3000, "\x85 " * 900]


def test_joins_are_repaired():
    """Cores are encoded once, joins with the words beside them; wrong ids of a core are noticed."""
    texts = odd_texts()
    encoder = bpe.Encoder(PATH)
    assert encoder.by_words
    docs = [bpe.alternating(d) for d in bpe.pieces([t.encode() for t in texts])]
    assert all(a[1] != b[1] for d in docs for a, b in zip(d, d[1:])) and sum(c for d in docs for _, c in d) > 30
    entries = [[(p, encoder.encode([p])[0] if core else None) for p, core in d] for d in docs]
    want = [encoder.whole(t.encode()) for t in texts]
    assert encoder.repair(entries) == want
    widths = []
    real = bpe.window_edges

    def spy(left, right, n):
        widths.append(n)
        return real(left, right, n)

    mp = pytest.MonkeyPatch()
    with mp.context() as m:  # the window's ids never begin as the core's end: it grows, then the text is encoded whole
        m.setattr(bpe, "window_edges", spy)
        m.setattr(bpe, "ends_with", lambda ids, part: False)
        assert encoder.repair(entries) == want
    assert max(widths) > 8
    with mp.context() as m:  # agreement needs two words: the join's entry is the same
        m.setattr(bpe, "starts_with", lambda ids, part: len(part.split()) != 1)
        assert encoder.repair(entries) == want


def test_words_without_ids_among_others():
    encoder = bpe.Encoder(PATH)
    words = [w.encode() for w in ["a", "\x85", "b", "\x85\x85", "\x85", "the", "<|x", "\a", "x\ay", "THE", "iT", "It's", "É", "J\u030c", "x1", "A-b", "<|ENDOFTEXT|>", "<|endoftext|>"]]
    rng = random.Random(1)
    words += list({"".join(rng.choice("abcXYZ019'-.é漢") for _ in range(rng.randint(1, 12))).encode() for _ in range(3000)})
    encoder.learn(words)
    t = bpe.tokenizer(PATH)
    for w in words:
        ids = t.encode(w.decode(), add_special_tokens=False).ids
        assert encoder.words[w] == encoder.entry(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    t = bpe.tokenizer(path)
    assert not bpe.Encoder(path).by_words
    rows = list(enumerate(odd_texts()[:40]))
    got = bpe.encode_documents(docs_of(spark, rows), path, block_mb=0.01, ids=True).collect()
    for r in got:
        ids = t.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pieces_do_not_depend_on_neighbours():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "be", "gamma,", "d"]) for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    assert [list(next(bpe.pieces([t]))) for t in texts] == [list(p) for p in bpe.pieces(texts)]


def test_documents(spark):
    rows = corpus(6) + [(500 + k, "shared passage of words " * 60 + str(k)) for k in range(6)]
    t = bpe.tokenizer(PATH)
    got = bpe.encode_documents(docs_of(spark, rows), PATH, block_mb=0.01, ids=True).collect()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)), str(ids)))
    assert sorted((str(r[0]), *r[1:4], str(r[4])) for r in got) == sorted(want)
    assert bpe.encode_documents(docs_of(spark, []), PATH).count() == 0


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [None]


def good_turing(counts):
    """Discounts by count up to 5, written down anew: Katz's formula, on a line through log n_r where it fails."""
    n = [sum(c == r for c in counts.values()) for r in range(1, 7)]

    def formula(n):
        most = 6 * n[5] / n[0]
        return [((r + 1) * n[r] / n[r - 1] / r - most) / (1 - most) for r in range(1, 6)] if most != 1 else [0]

    tried = [formula(n)] if all(n) else []
    seen = [(r, x) for r, x in enumerate(n, 1) if x]
    if len(seen) > 1:
        width = lambda k: ((seen[k + 1][0] if k + 1 < len(seen) else 2 * seen[k][0] - (seen[k - 1][0] if k else 0)) - (seen[k - 1][0] if k else 0)) / 2
        x, y = [math.log(r) for r, _ in seen], [math.log(m / width(k)) for k, (_, m) in enumerate(seen)]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        if slope < -1:
            tried.append(formula([math.exp(my + slope * (math.log(r) - mx)) for r in range(1, 7)]))
    for d in tried:
        if all(0 < v <= 1 for v in d):
            return [1.0, *d]
    cut = min(n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5, 0.99)
    return [1.0] + [1 - cut / r for r in range(1, 6)]


def brute(rows, order=2):
    """The model by dictionaries, without any of the operator's code."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    docs = [tokens(t) for _, t in rows]
    grams = [collections.Counter() for _ in range(order)]
    padded = lambda d: ["^"] * (order - 1) + d
    for d, h in zip(docs, held):
        if not h:
            for k in range(order):
                grams[k].update(tuple(padded(d)[i + order - 1 - k : i + order]) for i in range(len(d)))
    uni = grams[0]
    n, d = sum(uni.values()), [good_turing(g) for g in grams]
    cut = lambda level, c: d[level][c] * c if c <= 5 else c
    rest = sum(c - cut(0, c) for c in uni.values())
    unknown, weight = (max(rest / n, 1 / (n + 1)), n - rest) if n else (1.0, 1.0)
    after = [collections.defaultdict(dict) for _ in range(order)]
    for k in range(1, order):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c

    @functools.cache
    def weights(context):
        """Denominator, and backoff weight."""
        level = len(context)
        seen = after[level][context]
        total = sum(seen.values())
        left = total - sum(cut(level, c) for c in seen.values())
        if all(c > 5 or d[level][c] == 1 for c in seen.values()):
            total, left = total + 1, 1.0
        return total, left / total / (1 - sum(p(w, context[1:]) for w in seen))

    @functools.cache
    def p(w, context):
        if not context:
            return (1 - unknown) * cut(0, uni[w,]) / weight if uni[w,] else unknown
        seen = after[len(context)].get(context)
        if seen is None:
            return p(w, context[1:])
        total, alpha = weights(context)
        return cut(len(context), seen[w]) / total if w in seen else alpha * p(w, context[1:])

    for level in range(1, order):
        for a in list(after[level])[:30] + [("never",) * level]:  # known words and one unknown word: exactly normalised
            assert abs(sum(p(w, a) for (w,) in uni) + p("unknown word", a) - 1) < 1e-9
    out = []
    for (i, _), h, t in zip(rows, held, docs):
        base = sum(math.log10((uni[w,] + 1) / (n + len(uni) + 1)) for w in t)
        score = sum(math.log10(p(w, tuple(padded(t)[k : k + order - 1]))) for k, w in enumerate(t))
        out.append((str(i), h, len(t), sum(uni[w,] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "order"), [(1, 2), (2, 2), (1, 3), (2, 4), (3, 1)])
def test_katz(spark, seed, order):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = corpus(seed) + [(1000 + k, " ".join(vocabulary[min(299, int(rng.expovariate(0.03)))] for _ in range(120))) for k in range(60)]
    got = katz.katz_scores(docs_of(spark, rows), block_mb=0.01, order=order).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == brute(rows, order)
    assert katz.katz_scores(docs_of(spark, []), order=order).count() == 0


def test_katz_of_one_common_context(spark):
    """A third of all pairs begin with one word: its pairs lie in several buckets."""
    rng = random.Random(5)
    rows = [(k, " ".join(x for _ in range(40) for x in ("the", f"n{rng.randrange(400)}", f"v{rng.randrange(40)}"))) for k in range(80)]
    got = katz.katz_scores(docs_of(spark, rows), block_mb=0.004).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == brute(rows)
    pdf = pd.DataFrame({"doc_id": [k for k, _ in rows], "text": [t.encode() for _, t in rows]})
    block = katz.Block(pdf, 8)
    told = {b: (lambda r: katz.unpack(r["blob"].iloc[0]))(katz._merge_words(pd.DataFrame({"bucket": [b], "block": [0], "blob": [katz.pack(*a)]}))) for b, a in block.ask()}
    block.climb({1: told}, 1)
    level = block.descend()
    runs = sorted((sum(len(level.asked(b)[2]) for b in range(8)), max(len(level.asked(b)[2]) for b in range(8))))
    assert runs[1] == len(level.context) and runs[0] < 0.3 * runs[1]


def test_katz_without_training_text(spark):
    rows = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.katz_scores(docs_of(spark, rows)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_discounts_stay_good_turing():
    """Numbers of sf0.1/documents, for which Katz's formula on the raw numbers leaves (0, 1]."""
    for n in ([207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580], [900, 200, 0, 50, 30, 0]):
        seen = [(r, x) for r, x in enumerate(n, 1) if x]
        width = lambda k: ((seen[k + 1][0] if k + 1 < len(seen) else 2 * seen[k][0] - seen[k - 1][0]) - (seen[k - 1][0] if k else 0)) / 2
        x, y = [math.log(r) for r, _ in seen], [math.log(m / width(k)) for k, (_, m) in enumerate(seen)]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        most = 6 ** (slope + 1)  # (K + 1) n_{K+1} / n_1 on the line
        want = [(((r + 1) / r) ** (slope + 1) - most) / (1 - most) for r in range(1, 6)]
        got = katz.discounts(np.array(n))[1:]
        assert np.allclose(got, want) and all(0 < a < b <= 1 for a, b in zip(got, got[1:]))
    r = np.arange(1, 6)
    n = np.array([1000.0, 300, 140, 80, 50, 34])  # the formula holds as it is: nothing is smoothed
    most = 6 * n[5] / n[0]
    assert np.allclose(katz.discounts(n)[1:], ((r + 1) * n[1:] / n[:-1] / r - most) / (1 - most))
    assert np.allclose(katz.discounts(np.array([5, 0, 0, 0, 0, 0]))[1:], 1 - 0.99 / r)
