"""Near copies by word shingles against brute force."""

import random

import corpus_pipeline
from sparkloom.llm import shingle_dedup, simhash
from tests.llm.test_dedup import brute_fingerprint, corpus, docs_of


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def near_copies(seed):
    """Texts of unlike words, each followed by copies with a similarity of 0.8 or more, and some with less."""
    rng = random.Random(seed)
    rows = []
    for k in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(w))
        for share in (0.02, 0.1, 0.18, 0.4):
            rows.append(" ".join(w[: len(w) - int(len(w) * share)] + [f"n{k}"]))
    return list(enumerate(rows))


def brute(rows, linked):
    """Least id of the component of each row."""
    low = list(range(len(rows)))
    for _ in rows:
        new = [min([low[j] for j in range(len(rows)) if linked[i][j]] + [low[i]]) for i in range(len(rows))]
        if new == low:
            break
        low = new
    return low


def test_stage_reaches_similar_texts(spark):
    rows = near_copies(1)
    fps = [brute_fingerprint(t) for _, t in rows]
    sim = [[similarity(a, b) for _, b in rows] for _, a in rows]
    far = sum(sim[i][j] >= 0.8 and (fps[i] ^ fps[j]).bit_count() > 2 for i in range(len(rows)) for j in range(i))
    assert far > 20  # op10's rule alone leaves these
    low = brute(rows, [[sim[i][j] >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2 for j in range(len(rows))] for i in range(len(rows))])
    stay = corpus_pipeline.near(spark, docs_of(spark, rows), "")
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(low)) and len(stay.columns) == 8


def test_groups_are_exact(spark):
    rows = near_copies(2) + [(1000 + k, t) for k, (_, t) in enumerate(corpus(3))]
    texts = sorted({(t or "").encode() for _, t in rows})
    sim = [[similarity(a.decode(), b.decode()) for b in texts] for a in texts]
    want = brute(texts, [[s >= 0.8 for s in line] for line in sim])
    assert shingle_dedup.similar_groups(texts).tolist() == want
    keys = shingle_dedup.band_keys(texts)
    assert all((keys[i] == keys[j]).any() for i in range(len(texts)) for j in range(i) if sim[i][j] >= 0.8)


def test_repeated_and_null_ids(spark):
    t = near_copies(4)
    rows = [(5, t[0][1]), (5, t[5][1]), (3, t[6][1]), (None, t[10][1]), (None, t[11][1]), (None, t[15][1]), (None, t[15][1])]
    stay = shingle_dedup.near_copy_dedup(docs_of(spark, rows)).collect()
    left = [(r.doc_id, r.text) for r in stay]
    assert (5, t[0][1]) in left and (3, t[6][1]) in left and len(left) == 4
    assert sum(i is None for i, _ in left) == 2
    assert shingle_dedup.near_copy_dedup(docs_of(spark, [])).count() == 0


def test_simhash_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(3))
    upper = str.upper  # another text with the same fingerprint
    rows = [(5, a), (5, b), (3, upper(a)), (None, c), (None, upper(c))]
    left = [(r.doc_id, r.text) for r in simhash.simhash_dedup(docs_of(spark, rows)).collect()]
    assert sorted(left, key=str)[:2] == [(3, upper(a)), (5, b)] and len(left) == 3 and left.count((None, c)) + left.count((None, upper(c))) == 1


def test_large_clusters_are_exact(spark):
    """Groups around two texts, chains, and texts that share bands without being similar, in parts of a few rows."""
    rng = random.Random(11)
    rows = []
    for base in range(2):
        w = [f"b{base}_{rng.randrange(900)}" for _ in range(120)]
        for k in range(70):
            v = list(w)
            for _ in range(rng.choice([1, 2, 2, 5, 9])):
                v[rng.randrange(len(v))] = f"e{base}_{k}"
            rows.append(" ".join(v))
    w = [f"c{k}" for k in range(100)]
    for k in range(40):  # a chain: each text is similar to the next ones only
        rows.append(" ".join(w[k:] + [f"d{j}" for j in range(k)]))
    rows = list(enumerate(rows))
    texts = [t for _, t in rows]
    fps = [brute_fingerprint(t) for t in texts]
    low = brute(rows, [[similarity(a, b) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2 for j, b in enumerate(texts)] for i, a in enumerate(texts)])
    docs = docs_of(spark, rows)
    nodes = {r.node: r.doc_id for r in docs.select("doc_id", simhash.text_key(docs.text).alias("node")).collect()}
    want = sorted(sorted(i for i, x in enumerate(low) if x == c) for c in set(low) if low.count(c) > 1)
    for options in ({"task_rows": 10}, {"task_bytes": 5000}, {}):
        groups = {}
        for r in shingle_dedup.near_copies(docs, **options).collect():
            groups.setdefault(r.component, []).append(nodes[r.node])
        assert sorted(map(sorted, groups.values())) == want
