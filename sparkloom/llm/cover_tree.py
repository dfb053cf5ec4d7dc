"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sparkloom.llm.common import connected_components, cut, salted_join

SALTS, LEAF = 64, 24
#: The top level is a net of at most so many centres, chosen from a bounded sample of the vectors.
MAX_CELLS, SAMPLE = 1024, 4096
#: Vectors in one block: what a task holds of either side.
BLOCK_ROWS = 4096
#: A round of pairs of blocks sends so many bytes at least; the results of so many rounds are made one.
ROUND_BYTES, MERGED = 64_000_000, 16
SAFE = 1e-9


def _net(x: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy net: groups of `rows`, each led by its centre, whose members lie within `radius` of it.

    Centres are more than `radius` apart; the first row, the parent's centre, is one (nesting).
    """
    least = 1 - radius * radius / 2
    groups: list[list[np.ndarray]] = []
    while len(rows):
        head, rest = rows[:256], rows[256:]
        near = x[head] @ x[head].T >= least
        free, centres = np.ones(len(head), dtype=bool), []
        for i in range(len(head)):
            if free[i]:
                mine = np.flatnonzero(free & near[i])
                mine = np.r_[i, mine[mine != i]]
                free[mine] = False
                centres.append(i)
                groups.append([head[mine]])
        base = len(groups) - len(centres)
        if len(rest):
            dots = x[rest] @ x[head[centres]].T
            best = dots.argmax(axis=1)
            inside = dots[np.arange(len(rest)), best] >= least
            for c in np.unique(best[inside]):
                groups[base + c].append(rest[inside & (best == c)])
            rest = rest[~inside]
        rows = rest
    return [np.concatenate(g) for g in groups]


class CoverTree:
    """Nested levels with halving radii over unit vectors; a node's points are contiguous in `order`."""

    def __init__(self, x: np.ndarray):
        self.x, order, nodes = x, np.zeros(len(x), dtype=np.int64), []
        todo = [(np.arange(len(x)), 2.0, 0, -1)]
        while todo:
            rows, radius, start, parent = todo.pop()
            far = self.reach(x, rows)
            me = len(nodes)
            nodes.append([rows[0], far, start, start + len(rows), parent, []])
            if parent >= 0:
                nodes[parent][5].append(me)
            order[start : start + len(rows)] = rows
            if len(rows) > LEAF and far > 1e-6:
                radius = min(radius, far)
                parts = [rows]
                while len(parts) == 1:
                    radius /= 2
                    parts = _net(x, rows, radius)
                for p in parts:
                    todo.append((p, radius, start, me))
                    start += len(p)
        self.order = order
        self.centre = np.array([n[0] for n in nodes])
        self.radius = np.array([n[1] for n in nodes])
        self.start, self.end = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        leaf = np.zeros(0, dtype=np.int64)
        self.children = [np.array(n[5], dtype=np.int64) if n[5] else leaf for n in nodes]

    @staticmethod
    def reach(x: np.ndarray, rows: np.ndarray) -> float:
        """Covering radius: a bound, never below the true one, on the distance from the first row to the others."""
        if len(rows) == 1:
            return 0.0
        return float(np.sqrt(max(0.0, 2 - 2 * (x[rows] @ x[rows[0]]).min())) + SAFE)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]


def dual_traversal(a: CoverTree, b: CoverTree, least: float, found) -> None:
    """Calls found(rows of a, rows of b, mask or None) for groups of pairs with cosine >= `least`; None: all pairs.

    A node pair is dropped when its centres are farther apart than the threshold distance plus both covering
    radii, and taken whole when they are nearer than the threshold less both radii.
    """
    limit = np.sqrt(2 - 2 * least)
    stack = [(0, 0)] if len(a.x) and len(b.x) else []
    while stack:
        i, j = stack.pop()
        ci, cj = a.children[i], b.children[j]
        if not len(ci) and not len(cj):
            ri, rj = a.rows(i), b.rows(j)
            mask = a.x[ri] @ b.x[rj].T >= least
            if mask.any():
                found(ri, rj, mask)
            continue
        ci, cj = (ci if len(ci) else np.array([i])), (cj if len(cj) else np.array([j]))
        for part in range(0, len(ci), 512):
            left = ci[part : part + 512]
            dots = a.x[a.centre[left]] @ b.x[b.centre[cj]].T
            reach = a.radius[left][:, None] + b.radius[cj][None, :]
            bound = 1 - (limit + reach + SAFE) ** 2 / 2  # of the cosine of the centres
            p, q = np.nonzero(dots >= np.where(limit + reach + SAFE < 2, bound, -2))
            d, r = np.sqrt(np.maximum(0.0, 2 - 2 * dots[p, q])), reach[p, q]
            points = r == 0
            single = points & (dots[p, q] >= least)
            if single.any():
                found(a.centre[left[p[single]]], b.centre[cj[q[single]]], "pairs")
            for u, v, dist, rad, point in zip(left[p].tolist(), cj[q].tolist(), d.tolist(), r.tolist(), points.tolist(), strict=True):
                if point:
                    continue
                if dist + rad <= limit - 2 * SAFE:
                    found(a.rows(u), b.rows(v), None)
                else:
                    stack.append((u, v))


class _Links:
    """Weighted link counts and a spanning forest of what the traversal finds."""

    def __init__(self, mult_a: np.ndarray, mult_b: np.ndarray, same: bool):
        self.na, self.nb, self.same = len(mult_a), len(mult_b), same
        self.mult_a, self.mult_b = mult_a, mult_b
        self.count_a, self.count_b = np.zeros(self.na, dtype=np.int64), np.zeros(self.nb, dtype=np.int64)
        self.up = list(range(self.na if same else self.na + self.nb))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, p: int, q: int) -> None:
        p, q = self.root(p), self.root(q)
        if p != q:
            self.up[max(p, q)] = min(p, q)

    def __call__(self, ra: np.ndarray, rb: np.ndarray, mask) -> None:
        off = 0 if self.same else self.na
        if isinstance(mask, str):
            np.add.at(self.count_a, ra, self.mult_b[rb])
            np.add.at(self.count_b, rb, self.mult_a[ra])
            for p, q in zip(ra.tolist(), rb.tolist(), strict=True):
                self.tie(p, off + q)
            return
        if mask is None:
            self.count_a[ra] += self.mult_b[rb].sum()
            self.count_b[rb] += self.mult_a[ra].sum()
            for p in ra.tolist():
                self.tie(p, off + int(rb[0]))
            for q in rb.tolist():
                self.tie(int(ra[0]), off + q)
            return
        self.count_a[ra] += mask @ self.mult_b[rb]
        self.count_b[rb] += self.mult_a[ra] @ mask
        for p, q in zip(*(k.tolist() for k in np.nonzero(mask)), strict=True):
            self.tie(int(ra[p]), off + int(rb[q]))

    def rows(self, ids_a: np.ndarray, ids_b: np.ndarray) -> pd.DataFrame:
        if self.same:  # every ordered pair and each vector with itself came once
            ids, links = ids_a, self.count_a - self.mult_a
        else:
            ids, links = np.r_[ids_a, ids_b], np.r_[self.count_a, self.count_b]
        roots = np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)
        out = pd.DataFrame({"id": ids, "links": links, "root": ids[roots]})
        return out[(out.links > 0) | (out.id != out.root)]


def _unit(embedding) -> np.ndarray:
    x = np.array([np.asarray(e, dtype=np.float64) for e in embedding])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by a power of two, so squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block_rows: int = BLOCK_ROWS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one point with a multiplicity. The top level of the cover tree is a net of centres from
    a bounded sample; points go to their nearest centre, and a cell of many points is cut into blocks by hash.
    Cell pairs that the covering-radius bound rules out are dropped; every other pair of blocks is one task,
    which traverses the two blocks' trees. A task returns sums and a spanning forest, never pairs.

    Null, empty, zero vectors and vectors with null or non-finite components link with nothing (component_id
    is their own id), as do vectors of different lengths. Rows with a null id take no part: n_links 0,
    component_id null, kept false. Rows that repeat an id are vectors of their own, each with its own links;
    as components are named by ids, each of them is `kept` whose component has that name. Other columns are
    ignored; an empty table gives no rows.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else "array<double>"  # computed in doubles either way
    v = F.col("e")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("e"))
    rows = rows.withColumn("e", F.when(good, v)).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    points = rows.where("e IS NOT NULL").groupBy("e").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts"))
    points = cut(points.withColumn("id", F.monotonically_increasing_id()))  # a point's number, whatever ids its vectors have
    placed, pairs = _blocks(points, block_rows, float(np.sqrt(2 - 2 * least)))
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    result = cut(_pair_tasks(placed, pairs, least, round_bytes))
    links = result.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(result.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    lows = comps.join(points.select("id", "low"), "id").groupBy("component").agg(F.min("low").alias("least"))
    known = points.join(links, "id", "left").join(salted_join(comps, lows, "component", "id").select("id", "least"), "id", "left")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    known = known.select("e", F.explode(salts).alias("salt"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    out = rows.join(known, ["e", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _blocks(points: DataFrame, block_rows: int, limit: float) -> tuple[DataFrame, DataFrame | None]:
    """Points with their block, and the pairs (a, b) of blocks that the top level of the tree leaves.

    The driver sees the bounded top level alone: at most MAX_CELLS cells a length and their pairs. Blocks and
    their pairs are made by the executors.
    """
    spark = points.sparkSession
    sizes = {r["dim"]: r["n"] for r in points.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return points, None
    centres: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        sample = [r["e"] for r in points.where(F.size("e") == dim).orderBy(F.xxhash64("e")).limit(SAMPLE).select("e").collect()] if n > block_rows else [points.where(F.size("e") == dim).first()["e"]]
        x, picked = _unit(sample), [0]
        near = x @ x[0]
        while len(picked) < min(MAX_CELLS, n // block_rows + 1, len(x)):
            picked.append(int(near.argmin()))  # farthest first
            near = np.maximum(near, x @ x[picked[-1]])
        centres[dim] = x[picked]

    def place(batches):
        for pdf in batches:
            dims = pdf["e"].map(len)
            cell, dist = np.empty(len(pdf), dtype=object), np.zeros(len(pdf))
            for dim in dims.unique():
                at = np.flatnonzero(dims == dim)
                dots = _unit(pdf["e"].iloc[at]) @ centres[dim].T
                best = dots.argmax(axis=1)
                cell[at] = [f"{dim}/{c}" for c in best]
                dist[at] = np.sqrt(np.maximum(0.0, 2 - 2 * dots[np.arange(len(at)), best])) + SAFE
            yield pdf[["id", "mult", "e"]].assign(cell=cell, dist=dist)

    celled = cut(points.mapInPandas(place, f"id long, mult long, e {points.schema['e'].dataType.simpleString()}, cell string, dist double"))
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far"))
    cells = cut(cells.withColumn("parts", F.floor(F.col("n") / block_rows).cast("int") + 1))
    top = {(int(r["cell"].split("/")[0]), int(r["cell"].split("/")[1])): r["far"] for r in cells.collect()}
    near = []
    for dim, c in centres.items():
        mine = sorted(k for d, k in top if d == dim)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c[mine] @ c[mine].T)))
        far = np.array([top[dim, k] for k in mine])
        p, q = np.nonzero(np.triu(apart <= far[:, None] + far[None, :] + limit + SAFE))
        near += [(f"{dim}/{mine[i]}", f"{dim}/{mine[j]}") for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    pairs = spark.createDataFrame(near, "c string, d string")
    for side, part in (("c", "p"), ("d", "q")):
        pairs = pairs.join(cells.select(F.col("cell").alias(side), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(part)), side)
    name = lambda cell, part: F.concat_ws("/", cell, F.col(part).cast("string"))
    pairs = pairs.where((F.col("c") != F.col("d")) | (F.col("p") <= F.col("q"))).select(name("c", "p").alias("a"), name("d", "q").alias("b"))
    placed = celled.join(cells.select("cell", "parts"), "cell")
    return placed.withColumn("block", F.concat_ws("/", "cell", F.pmod(F.xxhash64("e"), F.col("parts")).cast("string"))), pairs


def _pair_tasks(placed: DataFrame, pairs: DataFrame, least: float, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(id, links, root) of all pairs of blocks, in rounds.

    A block goes to as many tasks as it has partners, so what is sent grows with the square of the input. A round
    sends about as much as all blocks hold (`round_bytes` where they hold less), and its files go when it is written.
    """
    def pack(pdf):
        x = _unit(pdf["e"])
        tree = CoverTree(x)  # once per block, not per pair
        if np.asarray(pdf["e"].iloc[0]).dtype == np.float32:
            tree.x = np.array(pdf["e"].tolist(), dtype=np.float32)  # half the bytes; made unit vectors again where it is used
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tree": [pickle.dumps((pdf["id"].to_numpy(np.int64), pdf["mult"].to_numpy(np.int64), tree), protocol=5)]})

    def match(pdf):
        sides = {b: pickle.loads(t) for b, t in zip(pdf["block"], pdf["tree"], strict=True)}
        a, b = (sides.get(k) for k in (pdf["a"].iloc[0], pdf["b"].iloc[0]))
        if a is None or b is None:
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        for tree in {id(t): t for t in (a[2], b[2])}.values():
            tree.x = _unit(tree.x) if tree.x.dtype == np.float32 else tree.x
        links = _Links(a[1], b[1], a is b)
        dual_traversal(a[2], b[2], least, links)
        return links.rows(a[0], b[0])

    packed = cut(placed.groupBy("block").applyInPandas(pack, "block string, tree binary"))
    size = F.octet_length("tree")
    held = packed.agg(F.sum(size).alias("n")).first()["n"]
    wanted = cut(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")))
    sent = wanted.join(packed.select("block", size.alias("n")), "block").agg(F.sum("n").alias("n")).first()["n"] or 0
    rounds = -(-sent // max(round_bytes, held))
    parts: list[DataFrame] = []
    for k in range(rounds):
        # a round's pairs are about as many as the blocks
        mine = wanted.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) if rounds > 1 else wanted
        parts.append(cut(packed.join(F.broadcast(mine), "block").groupBy("a", "b").applyInPandas(match, "id long, links long, root long")))
        if len(parts) == MERGED:
            parts = [_merged(parts)]
    return _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The parts as one frame, with links that have the same ends summed."""
    if len(parts) == 1:
        return parts[0]
    return cut(reduce(DataFrame.union, parts).groupBy("id", "root").agg(F.sum("links").alias("links")).select("id", "links", "root"))
