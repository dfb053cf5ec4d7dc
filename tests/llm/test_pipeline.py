"""Each stage of the pipeline against a plain Python version on its own input."""

import collections
import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sparkloom.llm import bpe, ordinal
from tests.llm.test_dedup import brute_fingerprint
from tests.llm.test_mixing import brute_targets
from tests.llm.test_shingles import shingles

DATA = "/root/testdata/sf0.01"


def quality_ids(rows, model):
    """Ids whose probability of the top grade is 0.7 or more, feature by feature."""
    out = []
    for r in rows:
        flat, _ = ordinal.features([(r.text or "").encode()])
        score = sum(model.weights[k] for k in flat)
        if 1 - 1 / (1 + np.exp(-(model.thresholds[-1] - score))) >= 0.7:
            out.append(r.doc_id)
    return sorted(out)


def exact_ids(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    return sorted(min(g)[1] for g in groups.values())


def near_ids(rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    sets, fps = [shingles(r.text) for r in rows], [brute_fingerprint(r.text) for r in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    linked = [collections.defaultdict(bool) for _ in rows]
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x] if j != i)
        for j, n in shared.items():
            linked[i][j] = n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9
        for j in range(len(rows)):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                linked[i][j] = True
    low = list(range(len(rows)))
    while True:
        new = [min([low[i], *(low[j] for j, yes in linked[i].items() if yes)]) for i in range(len(rows))]
        if new == low:
            return [rows[i].doc_id for i in sorted(set(low))]
        low = new


def mixed_ids(rows):
    """Copies by source, in the order of md5(doc_id), pass after pass, while a copy's middle word lies below the target."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = brute_targets(sizes, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(ranked)})
    out = []
    for s in sizes:
        mine = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, len((r.text or "").split())) for r in rows if r.source == s)
        for turn in range(3):
            at = turn * sizes[s]
            for _, i, n in mine:
                if at + n / 2 < target[s]:
                    out.append(i)
                at += n
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    model = ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{DATA}/labels.parquet")))
    plain = {"quality": lambda x: quality_ids(x, model), "exact": exact_ids, "near": near_ids, "mix": mixed_ids}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, DATA))
        assert out.columns == columns
        given = {r.doc_id: r for r in rows}
        want, got = plain[name](rows), out.collect()
        assert sorted(r.doc_id for r in got) == want, name
        assert all(given[r.doc_id] == r for r in got)  # every column as it was
        docs, rows = out, got
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.tokens(spark, docs, DATA).collect())
    t = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def encoded(r):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        return r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))

    assert got == sorted(map(encoded, rows))


def test_written_frames_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions.storage import CLEANUP, cut

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    before, setting = set(files()), spark.conf.get(CLEANUP)
    out = cut(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count())
    assert not [f for f in files() if f not in before and "/shuffle_" in f]
    assert out.count() == 7 and spark.conf.get(CLEANUP) == setting
