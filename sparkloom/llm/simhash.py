"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, cut, fresh, hashable, salted_join

BITS, SEGMENTS, DISTANCE, SEED, SHINGLE = 64, 3, 2, 42, 3
#: Runs of equal first segments up to this long are compared by offsets, longer ones by probing variants.
SHORT_RUN = 48
SALTS = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the repeated word shingles of one text, lower-cased over A-Z; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; whole texts, null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring_masks() -> list[tuple[int, list[int], list[int]]]:
    """For each start of a chain: the shift of its first segment, and the masks of the ring's segments from it on."""
    bounds = [round(BITS * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]
    return [(bounds[i], [masks[(i + k) % SEGMENTS] for k in range(SEGMENTS)], [DISTANCE * (k + 1) // SEGMENTS for k in range(SEGMENTS)]) for i in range(SEGMENTS)]


def _viable(x: np.ndarray, masks: list[int], budgets: list[int]) -> np.ndarray:
    """Whether each prefix of the chain of segments stays within its proportional share of the distance."""
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for mask, budget in zip(masks, budgets, strict=True):
        total += np.bitwise_count(x & np.uint64(mask)).astype(np.int64)
        ok &= total <= budget
    return ok


def _variants(masks: list[int], budgets: list[int]) -> np.ndarray:
    """All differences of a viable chain that leave the first segment equal."""
    bits = [np.uint64(1 << b) for b in range(BITS) if not masks[0] >> b & 1]
    pairs = [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    every = np.array(bits + pairs, dtype=np.uint64)
    return every[_viable(every, masks, budgets)]


class _Forest:
    """Least member of each component, over edges that arrive in parts."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            odd = la != lb
            if not odd.any():
                return
            a, b, la, lb = a[odd], b[odd], la[odd], lb[odd]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def ring_links(fps: np.ndarray, start: int) -> np.ndarray:
    """For distinct fingerprints, the position of the least linked one among those that share segment `start`.

    Two fingerprints within the distance have, by the pigeonring principle, a start whose chain is viable;
    its first segment is then equal. Every such pair is found by the start that makes it viable, and only a
    spanning star of what is found is kept, so a group of copies never makes its pairs.
    """
    shift, masks, budgets = ring_masks()[start]
    key = fps & np.uint64(masks[0])
    order = np.lexsort((fps, key))
    x, key = fps[order], key[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(x) else np.zeros(0, dtype=bool)
    run = np.cumsum(first) - 1
    lengths = np.bincount(run) if len(x) else np.zeros(0, dtype=np.int64)
    forest, long = _Forest(len(x)), lengths[run] > SHORT_RUN if len(x) else first
    at = np.flatnonzero(~long)
    for k in range(1, SHORT_RUN):
        left = at[at + k < len(x)]
        left = left[run[left] == run[left + k]]
        if not len(left):
            break
        hit = left[_viable(x[left] ^ x[left + k], masks, budgets)]
        forest.join(hit, hit + k)
    if long.any():
        where = np.flatnonzero(long)
        big = np.sort(x[where])
        where = where[np.argsort(x[where], kind="stable")]
        for v in _variants(masks, budgets):
            want = big ^ v
            up = np.flatnonzero(want > big)
            pos = np.searchsorted(big, want[up])
            ok = pos < len(big)
            ok[ok] = big[pos[ok]] == want[up][ok]
            forest.join(where[up[ok]], where[pos[ok]])
    out = np.arange(len(x))
    out[order] = order[forest.label]
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 60_000) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Equal fingerprints are grouped first, so copies cost one entry each way. Each distinct fingerprint goes to
    one task per chain start, dealt by its first segment; those that link there come back as a star, and the
    stars are joined into components. Null text is empty, documents without words have fingerprint zero, and
    those link like any other. A null id belongs to the component of its fingerprint but never names it; if
    no member has an id the component_id is null. Repeated rows come back as often as they were given; an
    empty table gives no rows; other columns are ignored.
    """
    docs_fp = cut(fingerprints(docs, id_col, text_col))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    fps = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("salts")))
    tasks = max(4, fps.count() // rows_per_task + 1)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(np.uint64(m[0]).astype(np.int64).item()))), F.lit(tasks)).alias("part")) for i, (_, m, _) in enumerate(ring_masks())])).alias("d")).select("fp", "d.*")

    def link(pdf):
        x = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
        to = ring_links(x, int(pdf["start"].iloc[0]))
        odd = np.flatnonzero(to != np.arange(len(x)))
        return pdf.iloc[odd].assign(u=x[odd].view(np.int64), v=x[to[odd]].view(np.int64))[["u", "v"]]

    edges = dealt.groupBy("start", "part").applyInPandas(link, "u long, v long")
    comps = connected_components(edges)
    named = comps.join(fps.select(F.col("fp").alias("node"), "least"), "node")
    lows = named.groupBy("component").agg(F.min("least").alias("low"))
    of_fp = salted_join(named, lows, "component", "node").select(F.col("node").alias("fp"), "low")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    spread = fps.join(of_fp, "fp", "left").select("fp", F.explode(salts).alias("salt"), F.coalesce("low", "least").alias("component_id"))
    out = docs_fp.withColumn("salt", salt).join(spread, ["fp", "salt"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def components_of_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component) of distinct texts: the key of a text, and the least key of its near copies."""
    keyed = docs.select(text_key(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    return near_duplicates(keyed).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct()


def one_of_each(docs: DataFrame, comps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` without those that `comps` (node, component; nodes are text keys) makes copies of others.

    The row with the least id stays, a null id last; of rows with equal text likewise one. Columns may have any name.
    """
    rows = docs.select(text_key(F.col(text_col)).alias("node"), F.col(id_col).alias("id"))
    best = rows.join(comps, "node").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best")).select(F.col("best.node").alias("node"))
    gone, nth = fresh(docs, "gone", "nth")
    lost = comps.join(best, "node", "left_anti").select(F.col("node").alias(gone))
    out = docs.join(lost, text_key(F.col(text_col)) == F.col(gone), "left_anti")
    if not rows.groupBy("node").count().where("count > 1").take(1):
        return out
    w = Window.partitionBy(text_key(F.col(text_col))).orderBy(F.asc_nulls_last(id_col), F.xxhash64(*hashable(docs)))
    return out.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each component, the one with the least id, a null id last.

    Rows are told apart by 64-bit hashes of their texts, so unrelated texts under one id or none are rows of their own.
    """
    return one_of_each(docs, components_of_texts(docs, text_col), id_col, text_col)
