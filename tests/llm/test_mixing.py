"""The curriculum against a step-by-step version."""

import hashlib
import random

from sparkloom.llm import curriculum
from tests.llm.test_dedup import docs_of


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], "doc_id long, text string, source string, size long, key string")


def brute_targets(sizes, weights, cap=3):
    """Shares by weight; what is above a cap goes to the others by weight, again and again."""
    total, target, open_ = sum(sizes.values()), dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}
    rest = float(total)
    while open_ and rest > 1e-9:
        whole = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += rest * weights[s] / whole
        rest = sum(max(0.0, target[s] - cap * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def test_targets_and_order(spark):
    rng = random.Random(1)
    sources = [None, "a", "b", "c", "d", "é", "Z"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40])) if i % 11 else None, rng.choices(sources, [1, 1, 30, 3, 2, 8, 1])[0]) for i in range(400)]
    rows += [(7, "repeat me", "b"), (None, "no id", "b"), (None, None, None)]
    got = curriculum.curriculum(docs(spark, rows), curriculum.ranked_schedules).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    ranked = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = brute_targets(sizes, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(ranked)})
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and max(abs(r.target - target[s]) for r in mine) < 1e-6
        assert abs(sum(r.taken for r in mine) - target[s]) <= 40
        copies = sorted((k, hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest(), p) for r in mine for k, p in enumerate(r.positions))
        assert [p for _, _, p in copies] == sorted(p for _, _, p in copies) and all(0 <= p <= 1 for _, _, p in copies)
    assert all(r.taken <= 3 * r.size and r.copies <= 3 for r in got)
    again = curriculum.curriculum(docs(spark, rows[::-1]), curriculum.ranked_schedules).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_demand_follows_the_schedule(spark):
    rows = [(i, "one", "a") for i in range(2000)]
    fade_in = lambda t: t.select("source", "source_size", curriculum.schedule((0, 0.0), (1, 2.0)).alias("knots"))
    got = sorted(r.positions[0] for r in curriculum.curriculum(docs(spark, rows), fade_in).collect() if r.copies)
    assert len(got) == 2000
    assert all(abs(p - ((k + 0.5) / 2000) ** 0.5) < 1e-9 for k, p in enumerate(got))


def test_training_order_and_empty(spark):
    rows = [(i, "a b c", "x" if i % 3 else "y") for i in range(60)]
    frame = docs_of(spark, [(i, t) for i, t, _ in rows])
    out = curriculum.training_order(frame, curriculum.ranked_schedules)
    assert out.columns == frame.columns and 0 < out.count() <= 180
    assert curriculum.curriculum(docs(spark, []), curriculum.ranked_schedules).count() == 0
    assert curriculum.curriculum(docs(spark, [(1, None, None), (2, "", "a")]), curriculum.ranked_schedules).count() == 2
