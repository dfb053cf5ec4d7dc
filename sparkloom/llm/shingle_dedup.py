"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, whole sets decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm.blocks import chunks, mix
from sparkloom.llm.common import connected_components, cut, salted_join
from sparkloom.llm.katz import words_of

SHINGLE, LEAST = 5, 0.8
#: Two texts with a similarity of 0.8 share all ROWS minima of one of BANDS bands but for 6 cases in 100,000.
BANDS, ROWS = 32, 6
#: Bytes of text at a time: the arrays of a chunk take some hundred times its size.
CHUNK = 250_000
#: Texts and bytes of candidates that one task compares.
TASK_ROWS, TASK_BYTES = 1000, 8_000_000


def shingled(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of all texts, lower-cased over A-Z, and bounds of the texts.

    A text of fewer words is one shingle, and so is a text without words.
    """
    h, bounds = words_of(texts)
    if not texts:
        return h, bounds
    end, owner = bounds[1:] - 1, np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.arange(len(h))
    first = np.flatnonzero((at + shingle <= end[owner]) | ((at == bounds[owner]) & (end[owner] - at < shingle)))
    of, out = owner[first], np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, odd in enumerate(mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)):
            here = first + k < end[of]
            out[here] += h[first[here] + k] * odd
    return mix(out + np.uint64(1)), np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))]


def band_keys(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """One row of BANDS keys per text; a key is a hash of the band and its ROWS minima."""
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS, 2)
    parts = [np.zeros((0, BANDS), dtype=np.uint64)]
    for a, b in chunks(texts, CHUNK):
        x, bounds = shingled(texts[a:b], shingle)
        keys = np.zeros((b - a, BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                key = np.full(b - a, band + 1, dtype=np.uint64)
                for flip, odd in seeds[band]:
                    key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.minimum.reduceat((x ^ flip) * (odd | np.uint64(1)), bounds[:-1]))
                keys[:, band] = key
        parts.append(keys)
    return np.concatenate(parts)


def similar_groups(texts: list[bytes], shingle: int = SHINGLE, least: float = LEAST, known: np.ndarray | None = None) -> np.ndarray:
    """For each text the position of the first one it is linked to, directly or over others, by whole shingle sets.

    Texts with an equal number in `known` are linked as well.
    """
    sets = []
    for a, b in chunks(texts, CHUNK):
        x, bounds = shingled(texts[a:b], shingle)
        sets += [np.unique(x[p:q]) for p, q in zip(bounds, bounds[1:], strict=False)]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, dtype=np.int64)
    start = np.r_[0, np.cumsum(size)]
    mark, group, left = np.zeros(len(codes), dtype=bool), np.full(len(sets), -1), np.arange(len(sets))
    while len(left):
        group[left[0]] = left[0]
        reached, left = [left[0]], left[1:]
        while reached and len(left):  # each text reached is compared once with all that no group has yet
            i = reached.pop()
            if known is not None and (same := left[known[left] == known[i]]).size:
                group[same] = group[i]
                reached += same.tolist()
                left = left[group[left] < 0]
            mine = codes[start[i] : start[i + 1]]
            close = left[(size[left] >= least * size[i]) & (size[i] >= least * size[left])]
            if len(close):
                mark[mine] = True
                lengths = size[close]
                heads = np.cumsum(lengths) - lengths
                flat = np.arange(lengths.sum()) + np.repeat(start[close] - heads, lengths)
                both = np.add.reduceat(mark[codes[flat]].astype(np.int64), heads)
                mark[mine] = False
                hit = close[both >= least * (lengths + size[i] - both) - 1e-9]
                group[hit] = group[i]
                reached += hit.tolist()
                left = left[group[left] < 0]
    return group


def near_copies(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, task_rows: int = TASK_ROWS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(node, component): text keys of texts in a group of two or more, and the least key of the group.

    Texts that share a band meet in its least key, those of a component of SimHash in that one's; what is joined so
    is a cluster of candidates. The whole shingle sets (as 64-bit hashes) decide: texts with a similarity of `least`
    or more are linked, and so are those that SimHash links. A cluster of at most `task_rows` texts and
    `task_bytes` bytes is compared by one task, a larger one by `_pivoted`.
    """
    keyed = docs.select(simhash.text_key(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def sign(batches):
        for b in batches:
            keys = band_keys(b.column(1).to_pylist(), shingle).view(np.int64)
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["node", "bands"])

    def decide(pdf):
        pdf = pdf.sort_values("node", ignore_index=True)
        node = pdf["node"].to_numpy()
        to = similar_groups(pdf["text"].tolist(), shingle, least, pdf["known"].to_numpy())
        many = np.bincount(to, minlength=len(to))[to] > 1
        return pd.DataFrame({"node": node[many], "component": node[to[many]]})

    def shingle_sets(batches):
        for b in batches:
            sets = []
            texts = b.column(3).to_pylist()
            for x, y in chunks(texts, CHUNK):
                h, bounds = shingled(texts[x:y], shingle)
                sets += [np.unique(h[p:q]).view(np.int64) for p, q in zip(bounds, bounds[1:], strict=False)]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(flat)), b.column(4), b.column(5)], names=["cluster", "node", "known", "shingles", "n", "salts"])

    known = cut(simhash.components_of_texts(docs, text_col).where("node != component").select("node", F.col("component").alias("known")))
    flat = cut(keyed.mapInArrow(sign, "node long, bands array<long>")).select("node", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    stars = flat.join(shared, "band").where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    clusters = connected_components(stars.union(known)).join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
    texts = keyed.join(clusters, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("component", "known", "text")])
    texts = cut(texts.select(F.col("component").alias("cluster"), "node", "known", "text"))
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = cut(sizes.withColumn("large", (F.col("n") > task_rows) | (F.col("bytes") > task_bytes)).withColumn("salts", F.greatest(F.ceil(F.col("n") / task_rows), F.ceil(F.col("bytes") / task_bytes)).cast("int")))
    sized = salted_join(texts, sizes.drop("bytes"), "cluster", "node")
    out = sized.where("NOT large").groupBy("cluster").applyInPandas(decide, "node long, component long")
    if sizes.where("large").take(1):
        sets = sized.where("large").select("cluster", "node", "known", "text", "n", "salts").mapInArrow(shingle_sets, "cluster long, node long, known long, shingles array<long>, n long, salts int")
        out = out.unionByName(_pivoted(cut(sets), least))
    return cut(out)


def _pivoted(sets: DataFrame, least: float) -> DataFrame:
    """(node, component) of the texts in large clusters, by rounds of pivots; exact, and no task holds a cluster.

    `sets`: cluster, node, known, shingles (distinct), n and salts of the cluster. A round takes the next part of a
    cluster's texts, in the order of a hash, as pivots, first 64, then 8 times more each round, and compares each
    with every text of the cluster that isn't yet in its component. After the first round a cluster's largest
    component is its giant, and texts that lie in the giant are no pivots any more: of two texts that end in
    different components, one was never in the giant, so it has been a pivot and both were compared. A group of
    near copies joins its giant early; what is left to compare grows with the texts outside of it.
    """
    labels = cut(sets.select("cluster", "node", F.col("known").alias("label")))
    spot = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("n")  # a text's place in the order
    sets = sets.withColumn("spot", spot)
    most = sets.agg(F.max("n").alias("n")).first()["n"]
    done, width, giants = 0.0, 64.0, None
    while done < most:
        now = sets.join(labels, ["cluster", "node"])
        pivots = now.where((F.col("spot") >= done) & (F.col("spot") < done + width))
        if giants is not None:
            pivots = pivots.join(labels.join(giants, ["cluster", "node"]).select("cluster", F.col("label").alias("giant")), "cluster").where("label != giant")
        # a cluster's texts are dealt to parts of bounded size; every part gets the pivots
        pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("label").alias("of"), F.col("shingles").alias("mine"))
        others = now.select("cluster", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "label", "shingles")
        both = F.size(F.array_intersect("shingles", "mine"))
        a, b = F.size("shingles"), F.size("mine")
        alike = (F.least(a, b) >= F.greatest(a, b) * least) & (both >= (a + b - both) * least - 1e-9)
        found = others.join(pivots, ["cluster", "salt"]).where(F.col("label") != F.col("of")).where(alike)
        edges = cut(found.select(F.col("label").alias("u"), F.col("of").alias("v")).distinct())
        if edges.take(1):
            joined = connected_components(edges).select(F.col("node").alias("label"), F.col("component").alias("to"))
            labels = cut(salted_join(labels, joined, "label", "node", "left").select("cluster", "node", F.coalesce("to", "label").alias("label")))
        done, width = done + width, width * 8
        if giants is None:
            counts = labels.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.min("node").alias("node"))
            giants = cut(counts.groupBy("cluster").agg(F.max_by("node", F.struct("n", "node")).alias("node")))
    lows = labels.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return salted_join(labels, lows.select("label", "component"), "label", "node").select("node", "component")


def near_copy_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of `docs` that stay: one of each group of near copies.

    Near copies are texts whose word shingles have a Jaccard similarity of `least` or more, and those that
    `simhash.near_duplicates` links; groups are joined over both. The row with the least id stays (a null id comes
    last). Ids may repeat or be null: rows are told apart by 64-bit hashes of their texts. Null text is empty.
    """
    return simhash.one_of_each(docs, near_copies(docs, text_col=text_col, shingle=shingle, least=least), id_col, text_col)
