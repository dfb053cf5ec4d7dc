"""Language-model scoring with a Katz backoff model."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.llm.blocks import SPACES, by_bucket, chunks, ids_of, in_blocks, mix, pack, unpack, word_spans

#: Counts up to K are discounted.
K = 5
END = np.uint64(0)
HELD_OUT_MOD, HELD_OUT = 7, 2
#: A context with more than a bucket's tokens / SPLIT goes to several buckets, by the word that follows.
SPLIT = 4

def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, lower-cased over A-Z, an end after each text; bounds of the texts."""
    out, sizes = [], []
    for a, b in chunks(texts):
        data = np.frombuffer(b" ".join(texts[a:b]).lower() + b" ", dtype=np.uint8)
        first, _, h = word_spans(data, SPACES)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        upto = np.searchsorted(first, ends)
        out.append(np.insert(h, upto, END))
        sizes.append(np.diff(np.r_[0, upto]) + 1)
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(sizes))]


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x


def smoothed(n: np.ndarray) -> np.ndarray | None:
    """Simple Good-Turing: n_1..n_{K+1} on the line fitted to log n_r over log r; None if it falls no faster than 1/r.

    Counts r that no type has are left out, and a count next to them stands for them as well: its number is
    spread over half the way to its neighbours.
    """
    r = np.flatnonzero(n > 0) + 1
    if len(r) < 2:
        return None
    below = np.r_[0, r[:-1]]
    above = np.r_[r[1:], 2 * r[-1] - below[-1]]
    slope, at_one = np.polyfit(np.log(r), np.log(n[r - 1] / (0.5 * (above - below))), 1)
    return np.exp(at_one + slope * np.log(np.arange(1, K + 2))) if slope < -1 else None


def katz_formula(n: np.ndarray) -> np.ndarray:
    """d_1..d_K from n_1..n_{K+1}, which are all above zero."""
    r = np.arange(1, K + 1)
    most = (K + 1) * n[K] / n[0]
    return ((r + 1) * n[1:] / n[:-1] / r - most) / (1 - most) if most != 1 else np.zeros(K)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Good-Turing discounts d[0..K] from the numbers n_1..n_{K+1} of types seen so often; d[0] is unused.

    Katz's formula on the numbers as they are if it gives values in (0, 1], else on the smoothed numbers, where it
    always does. Only where no falling line can be fitted (fewer than two numbers above zero, or n_r falls no
    faster than 1/r, when Good-Turing would not discount at all) one absolute discount n1 / (n1 + 2 n2) is taken
    from each count up to K.
    """
    n = np.asarray(counts, dtype=np.float64)
    out = np.ones(K + 1)
    for tried in (n if (n > 0).all() else None, smoothed(n)):
        if tried is not None:
            d = katz_formula(tried)
            if ((d > 0) & (d <= 1)).all():
                out[1:] = d
                return out
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    out[1:] = 1 - min(cut, 0.99) / np.arange(1, K + 1)
    return out


class Unigrams:
    """Exactly normalised unigram model: known words and one unknown word."""

    def __init__(self, tokens: int, counts: np.ndarray):
        self.tokens, self.d = tokens, discounts(counts)
        taken = sum((1 - self.d[r]) * r * counts[r - 1] for r in range(1, K + 1))
        self.weight = tokens - taken
        self.unknown = max(taken / tokens, 1 / (tokens + 1)) if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        w = self.d[np.where(c <= K, c, 0)] * c
        return np.where(c > 0, (1 - self.unknown) * w / self.weight, self.unknown)


def chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit key of a context and the word after it."""
    with np.errstate(over="ignore"):
        return mix(context.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + mix(word.astype(np.uint64) + np.uint64(7)))


class Level:
    """The distinct n-grams of a block: a context of n - 1 words and the word that follows."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, follower: np.ndarray, shorter: np.ndarray, keys: np.ndarray):
        self.gram, self.context, self.follower = gram, context, follower  # n-gram of each token; context and last word of each n-gram
        self.shorter = shorter  # each n-gram without its first word, as an n-gram of the level below
        self.keys = keys  # of the contexts, the same in every block

    def deal(self, n: int, counts: np.ndarray, tokens: int, numbers: np.ndarray) -> None:
        """Deals contexts to buckets. One that is seen often goes to several, its n-grams by their last word;
        each of them is asked about the context, as the sums over its n-grams lie there in parts."""
        some = np.minimum(n, 1 + counts * SPLIT * n // max(1, tokens))
        base = np.cumsum(some) - some
        self.head = np.repeat(np.arange(len(some)), some)
        turn = np.arange(len(self.head)) - base[self.head]
        bucket = ((mix(self.keys) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)[self.head]
        bucket = (bucket + turn) % n  # never the same bucket twice
        order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        part = (mix(numbers[self.follower]) >> np.uint64(3)) % some[self.context].astype(np.uint64)
        of = rank[base[self.context] + part.astype(np.int64)]
        self.head = self.head[order]
        self.order = np.argsort(of, kind="stable")
        self.runs = np.bincount(of, minlength=len(order))
        self.ends = np.r_[0, np.cumsum(self.runs)][self.cuts]

    def asked(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts that bucket b is asked about, how many n-grams of each, and these n-grams."""
        heads = slice(self.cuts[b], self.cuts[b + 1])
        return self.head[heads], self.runs[heads], self.order[self.ends[b] : self.ends[b + 1]]


class Block:
    """Tokens of a block of documents, by distinct word, and their n-grams level by level."""

    def __init__(self, pdf, n: int):
        self.n, self.depth = n, 1
        _, null = ids_of(pdf)
        names = ["" if gone else str(int(i)) for i, gone in zip(pdf["doc_id"], null, strict=True)]
        self.held = np.array([zlib.crc32(x.encode()) % HELD_OUT_MOD == HELD_OUT for x in names], dtype=bool)
        h, self.bounds = words_of(pdf["text"].tolist())
        self.sizes = np.diff(self.bounds)
        self.train = np.repeat(~self.held, self.sizes)
        self.words, self.word = np.unique(h, return_inverse=True)
        self.order, self.cuts = by_bucket(mix(self.words), n)

    def ask(self):
        seen = np.bincount(self.word, weights=self.train, minlength=len(self.words)).astype(np.uint32)
        for b in range(self.n):
            o = self.order[self.cuts[b] : self.cuts[b + 1]]
            yield b, (self.words[o], seen[o])

    def read_words(self, told: dict[int, tuple]) -> None:
        """Counts and numbers of the block's words, and what all buckets together know."""
        count, number = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.uint64)
        tokens, types, small = 0, 0, np.zeros(K + 1, dtype=np.int64)
        for b, (c, t, v, s, steps) in told.items():
            o = self.order[self.cuts[b] : self.cuts[b + 1]]
            count[o] = c
            number[o] = np.cumsum(steps, dtype=np.uint64) * np.uint64(self.n) + np.uint64(b + 1)
            tokens, types, small = tokens + t, types + v, small + s
        self.count, self.tokens, self.types, self.unigrams = count, tokens, types, Unigrams(tokens, small)
        self.small = small
        self.numbers = np.r_[number, np.uint64(0)]  # 0: the place before a text's first word
        self.texts = int(count[np.searchsorted(self.words, END)]) if len(self.words) else 0  # training texts: as many as ends
        # of the level reached: n-gram of each token, its key, its count in the training texts, its probability
        self.gram, self.keys, self.totals, self.p = self.word, number, count, self.unigrams.p(count)

    def descend(self) -> Level:
        """The next level; a text's first words follow places before it, which are all alike."""
        before = np.empty_like(self.gram)
        before[1:] = self.gram[:-1]
        before[self.bounds[:-1]] = len(self.keys)
        wide = len(self.words) + 1
        codes, first, gram = np.unique(before * wide + self.word, return_index=True, return_inverse=True)
        context = codes // wide
        keys = np.r_[self.keys, self.opening()]
        level = Level(gram, context, codes % wide, self.gram[first], keys)
        level.deal(self.n, np.r_[self.totals, self.texts], self.tokens, self.numbers)
        return level

    def opening(self) -> np.uint64:
        """Key of the context of a text's first word, at this level."""
        key = np.zeros(1, dtype=np.uint64)
        for _ in range(self.depth - 1):
            key = chained(key, np.zeros(1, dtype=np.uint64))
        return key[0]

    def ask_grams(self, level: Level):
        seen = np.bincount(level.gram, weights=self.train, minlength=len(level.context)).astype(np.uint32)
        for b in range(self.n):
            heads, runs, grams = level.asked(b)
            lower = self.count[level.follower[grams]].astype(np.uint32) if self.depth == 1 else self.p[level.shorter[grams]]
            yield b, (narrow(level.keys[heads]), runs.astype(np.uint32), narrow(self.numbers[level.follower[grams]]), seen[grams], lower, self.tokens, self.small)

    def read_grams(self, level: Level, told: dict[int, tuple]) -> None:
        """P(last word | context) of each n-gram: the discounted count, else the context's weight times P of the n-gram below."""
        d = discounts(sum((t[3] for t in told.values()), np.zeros(K + 1, dtype=np.int64)))
        total = np.zeros(len(level.context), dtype=np.int64)
        sums, mass = np.zeros((len(level.keys), K + 1)), np.zeros(len(level.keys))
        for b, (of_gram, of_context, part, _) in told.items():
            heads, _, grams = level.asked(b)
            total[grams] = of_gram
            np.add.at(sums, heads, of_context)
            np.add.at(mass, heads, part)
        seen = sums[:, 0]
        left = sums[:, 1:] @ ((1 - d[1:]) * np.arange(1, K + 1))
        bare = left <= 0
        whole, left = np.where(bare, seen + 1, seen), np.where(bare, 1.0, left)
        alpha = np.where(seen > 0, left / whole / (1 - mass), 1.0)
        p = np.where(total > 0, d[np.where(total <= K, total, 0)] * total / whole[level.context], alpha[level.context] * self.p[level.shorter])
        self.gram, self.keys, self.totals, self.p = level.gram, chained(level.keys[level.context], self.numbers[level.follower]), total, p
        self.depth += 1

    def climb(self, told: dict[int, dict[int, tuple]], upto: int) -> None:
        """Reads the answers of the levels up to `upto`."""
        self.read_words(told.get(1, {}))
        for n in range(2, upto + 1):
            self.read_grams(self.descend(), told.get(n, {}))

    def summed(self, of_token: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_token, self.bounds[:-1]) if len(self.sizes) else of_token[:0]


def _merge_words(pdf):
    """A bucket's words: how often each occurs in the training texts, told to every block that asked, with the
    words' numbers in the bucket (as steps, since a block asks in the order of the hashes)."""
    parts = [unpack(b) for b in pdf["blob"]]
    keys, seen = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, inverse = np.unique(keys, return_inverse=True)
    count = np.bincount(inverse, weights=seen).astype(np.int64) if len(keys) else np.zeros(0, dtype=np.int64)
    small = np.array([(count == r).sum() for r in range(1, K + 2)], dtype=np.int64)
    at, rows = 0, []
    for block, p in zip(pdf["block"], parts, strict=True):
        mine = inverse[at : at + len(p[0])]
        steps = np.diff(mine, prepend=0).astype(np.uint32)
        rows.append((int(block), 1, int(pdf["bucket"].iloc[0]), pack(count[mine].astype(np.uint32), int(count.sum()), int((count > 0).sum()), small, steps)))
        at += len(p[0])
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "blob"])


def _merge_grams(pdf, n: int):
    """A bucket's n-grams: counts, and per context its total, its small counts and the mass that the level below
    gives the words seen after it; of a context in several buckets each has a part of these sums."""
    parts = [unpack(b) for b in pdf["blob"]]
    context = np.concatenate([np.repeat(p[0], p[1]) for p in parts]).astype(np.uint64)
    word, seen, lower = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    key = chained(context, word)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=seen, minlength=len(first)).astype(np.int64) if len(key) else np.zeros(0, dtype=np.int64)
    small = np.array([(total == r).sum() for r in range(1, K + 2)], dtype=np.int64)
    known = total > 0
    contexts, of = np.unique(context[first[known]], return_inverse=True)
    t = total[known]
    lower = lower[first[known]]
    if n == 2:  # the level below is that of words, which travel by count
        lower = Unigrams(parts[0][5], parts[0][6]).p(lower.astype(np.int64))
    table = np.stack([np.bincount(of, weights=w, minlength=len(contexts)) for w in [t, *[t == r for r in range(1, K + 1)]]], axis=1).astype(np.int64) if len(t) else np.zeros((0, K + 1), dtype=np.int64)
    sums = np.bincount(of, weights=lower, minlength=len(contexts)) if len(t) else np.zeros(0)
    at, rows = 0, []
    for block, p in zip(pdf["block"], parts, strict=True):
        mine = inverse[at : at + len(p[2])]
        at += len(p[2])
        pos = np.searchsorted(contexts, p[0])
        has = pos < len(contexts)
        has[has] = contexts[pos[has]] == p[0][has]
        of_context, mass = np.zeros((len(p[0]), K + 1), dtype=np.uint32), np.zeros(len(p[0]))
        of_context[has], mass[has] = table[pos[has]], sums[pos[has]]
        rows.append((int(block), n, int(pdf["bucket"].iloc[0]), pack(total[mine].astype(np.uint32), of_context, mass, small)))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "blob"])


def katz_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_mb: float = 12.0) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A Katz model of n-grams up to `order` words, learnt from the documents that are not held out: P(word | context)
    is the Good-Turing discounted relative frequency of an n-gram that was seen, else the context's backoff weight
    times the probability of the word after the context without its first word, down to single words. The weight
    is the mass that discounting left, over the mass that the level below gives the words not seen after the
    context, so each context sums to one; a context without small counts gives one count's mass away.

    The count tables are partitioned by hash: words by word, n-grams by context, those of a context with many
    tokens by context and last word. Blocks of documents send each bucket their distinct keys with counts, merged
    in the block, and get back counts and the sums for the weights; level by level, a token's probability is put
    together from those answers. Every document and token counts; words are told apart by 64-bit hashes.

    Null text is empty (one token, the end); a null id hashes as empty text (and so is learnt from). Rows that
    repeat an id are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    base, n = in_blocks(docs, id_col, text_col, block_mb)
    blob = "bucket int, block int, blob binary"
    reply = "block int, kind int, bucket int, blob binary"

    def rows_of(pdf, asked):
        return pd.DataFrame([(b, int(pdf["block"].iloc[0]), pack(*a)) for b, a in asked], columns=["bucket", "block", "blob"])

    def by_kind(told):
        out: dict[int, dict[int, tuple]] = {}
        for k, b, x in zip(told["kind"], told["bucket"], told["blob"], strict=True):
            out.setdefault(int(k), {})[int(b)] = unpack(x)
        return out

    def ask(pdf):
        return rows_of(pdf, Block(pdf, n).ask())

    def asker(level: int):
        def ask_grams(pdf, told):
            block = Block(pdf, n)
            block.climb(by_kind(told), level - 1)
            return rows_of(pdf, block.ask_grams(block.descend()))

        return ask_grams

    def score(pdf, told):
        block = Block(pdf, n)
        block.climb(by_kind(told), order)
        known = block.summed((block.count > 0)[block.word].astype(np.int64))
        base_p = np.log10((block.count + 1.0) / (block.tokens + (block.types + 1.0)))
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "held_out": block.held, "n_tokens": block.sizes, "n_known": known, "train_tokens": block.tokens, "base_score": block.summed(base_p[block.word]), "score": block.summed(np.log10(block.p)[block.gram])})

    def merger(level: int):
        return lambda pdf: _merge_grams(pdf, level)

    told = base.groupBy("block").applyInPandas(ask, blob).groupBy("bucket").applyInPandas(_merge_words, reply)
    for level in range(2, order + 1):
        asked = base.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(asker(level), blob)
        told = told.unionByName(asked.groupBy("bucket").applyInPandas(merger(level), reply))
    out = base.groupBy("block").cogroup(told.groupBy("block"))
    return out.applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
