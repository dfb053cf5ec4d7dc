"""Repeated passages by suffix arrays built with linear grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.blocks import NO_ID, by_bucket, chunks, give_back, ids_of, in_blocks, mix, pack, unpack

#: Length of the strings that count as repeated, and of the anchors by which their places are found.
LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR  # bytes that a string can have on either side of an anchor
WINDOW = SIDE + 1  # anchors positions in a string, and strings around an anchor
CONTEXT = LENGTH + SIDE
#: Bits that hold a byte's place when strings choose their anchors; longer texts are looked at in parts of that length.
PLACE_BITS = 28
#: Suffix arrays are built over groups of contexts of about so many bytes.
ARRAY_BYTES = 120_000
#: Anchors are found in about so many bytes of documents at a time, and about so many kinds of context are resolved at a time.
CHUNK_BYTES, SLICE_ROWS = 250_000, 20_000


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by grouping suffixes by their Lyndon prefixes; `text` ends with its least symbol, once.

    Phase 1 starts with a group per first symbol and takes the groups from the greatest down. Each member's
    pointer goes to the nearest earlier suffix of a smaller group; that suffix is then known to be followed by
    the group's prefix as often as pointers meet there, and moves to a new group right above its old one,
    higher for more repeats. For members in ascending order the suffixes pointed to never go back, so groups stay in
    ascending order without a sort; only the kinds of move (repeats, old group) of one step are sorted. Phase 2 runs up the array: whenever a suffix is placed, the suffixes before it
    along the pointers have it as their next smaller one, so each takes the next free place of its group.
    """
    n = len(text)
    ranks = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [ranks[c] for c in text]
    members: list[list[int]] = [[] for _ in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    above, below = list(range(1, len(ranks) + 1)), list(range(-1, len(ranks) - 1))
    above[-1] = -1
    final, previous = bytearray(n), [-1] * n
    current = len(ranks) - 1
    while current >= 0:
        mine = [i for i in members[current] if group[i] == current]  # in ascending order: see below
        members[current] = mine
        for i in mine:
            final[i] = 1
        meet: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and final[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                meet[j] = meet.get(j, 0) + 1
        if meet:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, repeats in meet.items():
                moved.setdefault((-repeats, group[j]), []).append(j)
            for key in sorted(moved) if len(moved) > 1 else moved:
                old, new = key[1], len(members)
                members.append(moved[key])
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for j in moved[key]:
                    group[j] = new
        current = below[current]
    free, at, g = [0] * len(members), 0, 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    order, placed = [0] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    free[group[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive items."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:]) if step < len(x) else x[:0]
        done += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of every 50-byte string that one document holds: position, hash, first and last string it stands for.

    The anchor of a string is the first of its least hashed 20-byte strings: equal strings have the same anchor
    at the same place, whatever surrounds them, and each string has one. Where a text is longer than PLACE_BITS can
    number, the strings of each part of it are looked at with the bytes that they reach beyond it.
    """
    ends = np.r_[starts[1:], len(data)]
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    whole = np.cumsum(inside)[: len(data)] > 0  # whether a string of one document starts here
    step = (1 << PLACE_BITS) - LENGTH
    parts = []
    for a in range(0, max(1, len(data)), step):
        at, z, first, last = _anchors(data[a : a + step + LENGTH - 1], whole[a : a + step])
        parts.append((at + a, z, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, np.zeros(0, dtype=np.uint64), none, none
    with np.errstate(over="ignore"):
        base, h, size, square = np.uint64(0x5851F42D4C957F2D), data.astype(np.uint64) + np.uint64(1), 1, None
        h4 = None
        while size < 16:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
            if size == 4:
                h4, square = h, base
        z = mix(h[: len(data) - ANCHOR + 1] * square + h4[16:])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = _slide(z & ~place | np.arange(len(z), dtype=np.uint64), WINDOW, np.minimum)  # by the first byte of each string
    string = np.flatnonzero(inside[: len(least)])
    if not len(string):
        return none, np.zeros(0, dtype=np.uint64), none, none
    owner = (least[string] & place).astype(np.int64)
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[head], z[owner[head]], string[head], string[np.r_[head[1:], len(string)] - 1]


def _parts(texts: list[bytes]):
    """For each chunk of documents: first document, bytes, starts of the documents, anchors."""
    for a, b in chunks(texts, CHUNK_BYTES):
        data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        starts = np.cumsum([0, *map(len, texts[a : b - 1])]).astype(np.int64)
        yield a, data, starts, *anchors(data, starts)


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])


def _bounds(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end, in the context of each anchor, of the strings it stands for."""
    return (SIDE - (at - first)).astype(np.uint8), (SIDE + LENGTH + last - at).astype(np.uint8)


def _around(padded: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Around each anchor, at byte 30, the bytes of the strings it stands for, else zeros; their first and end."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at] if len(at) else np.zeros((0, CONTEXT), np.uint8)
    col = np.arange(CONTEXT, dtype=np.uint8)
    rows = rows * ((col >= low[:, None]) & (col < high[:, None]))
    return np.concatenate([rows, low[:, None], high[:, None]], axis=1)


def _contexts(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Contexts of the anchors of `data`, without padding."""
    return _around(_padded(data), at, *_bounds(at, first, last))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct row of bytes, and the number of each row's kind."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(np.uint64)
    h = np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k + 1))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    if not (words == words[first[inverse]]).all():  # two kinds under one hash
        _, first, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _group_windows(key: np.ndarray, ctx: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context and each of its strings: the least document that has the string, by a suffix array.

    All contexts of an anchor have its 20 bytes in the same place: there they are one symbol of its own.
    """
    n = len(ctx)
    out = np.full((n, WINDOW), NO_ID, dtype=np.int64)
    kind = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    symbols = ctx[:, :CONTEXT].astype(np.int64) + 2
    symbols = np.concatenate([symbols[:, :SIDE], (kind + 258)[:, None], symbols[:, SIDE + ANCHOR :], np.ones((n, 1), np.int64)], axis=1)
    column = np.r_[np.arange(SIDE + 1), np.arange(SIDE + ANCHOR, CONTEXT + 1)]
    keep = ((column >= ctx[:, CONTEXT, None]) & (column < ctx[:, CONTEXT + 1, None])) | (column == CONTEXT)
    row, col = np.nonzero(keep)
    order = np.array(suffix_array(symbols[row, col].tolist() + [0]), dtype=np.int64)
    order = order[order < len(row)]
    owner, offset = row[order], column[col[order]]
    ok = (offset < WINDOW) & (offset + LENGTH <= ctx[owner, CONTEXT + 1])
    owner, offset = owner[ok], offset[ok]
    if not len(owner):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(ctx[:, :CONTEXT]), LENGTH, axis=1)[owner, offset]
    first = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]  # neighbours that agree over 50 bytes are one string
    heads = np.flatnonzero(first)
    out[owner, offset] = np.minimum.reduceat(least[owner], heads)[np.cumsum(first) - 1]
    return out


def _resolve(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each string of each row; rows are anchors of one bucket, `ctx` with bounds."""
    of_key = _bytes(key)
    some, inverse = _distinct(np.concatenate([ctx, of_key], axis=1))
    m, kind_key, kind_ctx = len(some), key[some], ctx[some]
    least = np.full(m, NO_ID, dtype=np.int64)
    np.minimum.at(least, inverse, doc)
    offsets = np.arange(WINDOW)
    valid = (offsets >= kind_ctx[:, CONTEXT, None]) & (offsets + LENGTH <= kind_ctx[:, CONTEXT + 1, None])
    lows = np.where(valid, least[:, None], NO_ID)
    # a string that two contexts share reaches 15 bytes or more beyond the anchor on one side
    shared, half = np.zeros(m, dtype=bool), SIDE // 2
    for side, a, b in ((kind_ctx[:, CONTEXT] <= SIDE - half, SIDE - half, SIDE), (kind_ctx[:, CONTEXT + 1] >= SIDE + ANCHOR + half, SIDE + ANCHOR, SIDE + ANCHOR + half)):
        at = np.flatnonzero(side)
        _, inv = _distinct(np.concatenate([kind_ctx[at, a:b], of_key[some[at]]], axis=1))
        shared[at] |= np.bincount(inv)[inv] > 1 if len(at) else False
    _settle(lows, kind_key, kind_ctx, least, np.flatnonzero(shared), 0, SIDE)
    return lows[inverse]


def _settle(lows: np.ndarray, key: np.ndarray, ctx: np.ndarray, least: np.ndarray, rows: np.ndarray, low: int, high: int) -> None:
    """Sets `lows` for the strings at the offsets low..high of the contexts `rows`.

    Contexts that share such a string agree in their anchor, the `low` bytes after it and the last SIDE - `high` before
    it, so they are put together by those. Groups go to suffix arrays, about ARRAY_BYTES at a time; a larger group, that
    of a common anchor, is parted by the halves of its offsets, which have more bytes in common, down to one offset,
    where a group is one string.
    """
    rows = rows[(ctx[rows, CONTEXT] <= high) & (ctx[rows, CONTEXT + 1] >= low + LENGTH)]
    if not len(rows):
        return
    of_key = _bytes(key[rows])
    _, group = _distinct(np.concatenate([of_key, ctx[rows, high:SIDE], ctx[rows, SIDE + ANCHOR : SIDE + ANCHOR + low]], axis=1))
    size = np.bincount(group)
    several = size[group] > 1
    rows, group = rows[several], group[several]
    large = size[group] * CONTEXT > ARRAY_BYTES
    if large.any():
        some, of = rows[large], group[large]
        if low == high:
            first = np.full(len(size), NO_ID, dtype=np.int64)
            np.minimum.at(first, of, least[some])
            lows[some, low] = first[of]
        else:
            middle = (low + high) // 2
            _settle(lows, key, ctx, least, some, low, middle)
            _settle(lows, key, ctx, least, some, middle + 1, high)
        rows, group = rows[~large], group[~large]
    order = np.argsort(group, kind="stable")
    rows, group = rows[order], group[order]
    start = 0
    for end in (np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1).tolist() if len(rows) else []:
        if (end - start) * CONTEXT >= ARRAY_BYTES or end == len(rows):
            part = rows[start:end]
            lows[part, low : high + 1] = _group_windows(key[part], ctx[part], least[part])[:, low : high + 1]
            start = end


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each maximal run of true cells."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, a, b - 1


def _begin(texts: list[bytes]) -> np.ndarray:
    """Where each text begins in all of them together."""
    return np.cumsum([0, *map(len, texts[:-1])]).astype(np.int64)


def _bytes(key: np.ndarray) -> np.ndarray:
    return key.astype(">u8").view(np.uint8).reshape(-1, 8)


def _resolve_blobs(blobs: list[bytes]) -> list[bytes]:
    """For the packed contexts that each block sent to one bucket: starts and ends of its strings that a smaller document has.

    A blob holds kinds of context and their keys, in the order of the keys, and each row's kind, document and place, in that order too.
    Keys have nothing to do with one another, so about SLICE_ROWS kinds are resolved at a time, with all that have their keys.
    """
    parts = [unpack(b) for b in blobs]
    every = np.sort(np.concatenate([p[1] for p in parts]))
    marks = np.unique(every[SLICE_ROWS::SLICE_ROWS])
    marks = marks[marks > every[0]]
    del every
    kinds = [[0, *np.searchsorted(p[1], marks).tolist(), len(p[1])] for p in parts]
    rows = [np.r_[0, np.cumsum(np.bincount(p[2], minlength=len(p[1])))][k].tolist() for p, k in zip(parts, kinds, strict=True)]
    found = [([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for _ in parts]
    for k in range(len(marks) + 1):
        least = []
        for p, c, r in zip(parts, kinds, rows, strict=True):
            least.append(np.full(c[k + 1] - c[k], NO_ID, dtype=np.int64))
            np.minimum.at(least[-1], p[2][r[k] : r[k + 1]] - c[k], p[3][r[k] : r[k + 1]])
        key, ctx = (np.concatenate([p[i][c[k] : c[k + 1]] for p, c in zip(parts, kinds, strict=True)]) for i in (1, 0))
        lows, at = _resolve(key, ctx, np.concatenate(least)), 0
        for p, c, r, (starts, ends) in zip(parts, kinds, rows, found, strict=True):
            for x in range(r[k], r[k + 1], SLICE_ROWS):
                y = min(x + SLICE_ROWS, r[k + 1])
                row, a, b = _runs(lows[p[2][x:y] + (at - c[k])] < p[3][x:y, None])
                place = p[4][x:y][row] - SIDE
                starts.append(place + a), ends.append(place + b + LENGTH)
            at += c[k + 1] - c[k]
    return [pack(np.concatenate(starts), np.concatenate(ends)) for starts, ends in found]


def _passages(docs: DataFrame, id_col: str, text_col: str, block_mb: float, finish, schema: str) -> DataFrame:
    """The steps of `passage_spans`; `finish` makes the rows of a block from ids, texts, starts and ends."""
    base, n = in_blocks(docs, id_col, text_col, block_mb)
    none = finish(np.zeros(0, dtype=np.int64), [], [], [])

    def ask(pdf):
        texts, (ids, _) = pdf["text"].tolist(), ids_of(pdf)
        keys, owners = [], []
        for a, _, starts, at, z, _, _ in _parts(texts):
            keys.append(z)
            owners.append(ids[a + np.searchsorted(starts, at, side="right") - 1])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        several = np.maximum.reduceat(owners, heads) != np.minimum.reduceat(owners, heads) if len(heads) else np.zeros(0, dtype=bool)
        keys = keys[heads]
        order, bounds = by_bucket(keys, n)
        return pd.DataFrame([(b, int(pdf["block"].iloc[0]), pack(keys[order[s:e]], several[order[s:e]])) for b, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)) if e > s], columns=["bucket", "block", "blob"])

    def answer(pdf):
        parts = [unpack(b) for b in pdf["blob"]]
        keys, several = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        yes = count > 1
        yes[inverse[several]] = True
        flags, at, rows = yes[inverse], 0, []
        for block, p in zip(pdf["block"], parts, strict=True):
            rows.append((int(block), pack(p[0][flags[at : at + len(p[0])]])))
            at += len(p[0])
        return pd.DataFrame(rows, columns=["block", "blob"])

    def send(pdf, answers):
        if not len(pdf) or not len(answers):
            return pd.DataFrame({"bucket": [], "block": [], "blob": []})
        wanted = np.sort(np.concatenate([unpack(b)[0] for b in answers["blob"]]))
        texts, (ids, _) = pdf["text"].tolist(), ids_of(pdf)
        begin, padded = _begin(texts), _padded(np.frombuffer(b"".join(texts), dtype=np.uint8))
        keys, places, lows, highs = [], [], [], []
        for a, _, _, at, z, first, last in _parts(texts):
            pos = np.searchsorted(wanted, z)
            pos[pos == len(wanted)] = 0
            yes = wanted[pos] == z if len(wanted) else np.zeros(len(z), dtype=bool)
            low, high = _bounds(at[yes], first[yes], last[yes])
            keys.append(z[yes]), places.append(begin[a] + at[yes]), lows.append(low), highs.append(high)
        keys, places, lows, highs = (np.concatenate(v) for v in (keys, places, lows, highs))
        order, bounds = by_bucket(keys, n)
        out = []
        for b, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if e > s:
                o = order[s:e]
                o = o[np.argsort(keys[o], kind="stable")]
                wide = _around(padded, places[o], lows[o], highs[o])
                some, inverse = _distinct(np.concatenate([wide, _bytes(keys[o])], axis=1))
                rank = np.argsort(some)  # as the keys are in order, so are the first of each kind
                back = np.empty(len(some), dtype=np.int32)
                back[rank] = np.arange(len(some))
                some, doc = some[rank], np.searchsorted(begin, places[o], side="right") - 1
                out.append((b, int(pdf["block"].iloc[0]), pack(wide[some], keys[o][some], back[inverse], ids[doc], places[o])))
        return pd.DataFrame(out, columns=["bucket", "block", "blob"])

    def resolve(pdf):
        return pd.DataFrame({"block": pdf["block"].astype("int32"), "blob": _resolve_blobs(pdf["blob"].tolist())})

    def join(pdf, spans):
        if not len(pdf):
            return none
        texts = pdf["text"].tolist()
        a, b = (np.concatenate(v) for v in zip(*map(unpack, spans["blob"]), strict=True)) if len(spans) else (np.zeros(0, np.int64),) * 2
        order = np.argsort(a, kind="stable")
        a, b, begin = a[order], b[order], _begin(texts)
        cut = np.searchsorted(a, [*begin, begin[-1] + len(texts[-1])])
        starts, ends = [], []
        for i in range(len(texts)):
            s, e = a[cut[i] : cut[i + 1]] - begin[i], b[cut[i] : cut[i + 1]] - begin[i]
            if len(s):
                reach = np.maximum.accumulate(e)
                head = np.r_[True, s[1:] > reach[:-1]]
                s, e = s[head], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(reach) - 1]]
            starts.append(s.tolist())
            ends.append(e.tolist())
        return finish(pdf["doc_id"].to_numpy(), texts, starts, ends)

    asked = base.groupBy("block").applyInPandas(_ordered(ask), "bucket int, block int, blob binary")
    told = asked.groupBy("bucket").applyInPandas(_frugal(answer), "block int, blob binary")
    sent = base.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_ordered(send), "bucket int, block int, blob binary")
    found = sent.groupBy("bucket").applyInPandas(_frugal(resolve), "block int, blob binary")
    return base.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_ordered(join), schema)


def _frugal(f):
    """`f`, after which freed memory goes back to the system: workers stay, and the next steps run in others beside them."""

    def done(*frames):
        try:
            return f(*frames)
        finally:
            give_back()

    return (lambda pdf: done(pdf)) if f.__code__.co_argcount == 1 else (lambda pdf, other: done(pdf, other))


def _ordered(f):
    """Rows of a block in one order at every step, as steps speak of them by their places."""
    return _frugal((lambda pdf: f(_sorted(pdf))) if f.__code__.co_argcount == 1 else (lambda pdf, other: f(_sorted(pdf), other)))


def _sorted(pdf):
    if not len(pdf):
        return pdf
    keys = [(i is None or i != i, 0 if i is None or i != i else int(i), t) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
    return pdf.iloc[sorted(range(len(keys)), key=keys.__getitem__)].reset_index(drop=True)


def passage_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 10.0) -> DataFrame:
    """Per document: doc_id, text (UTF-8), starts and ends of the maximal byte spans to remove.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Documents lie
    in blocks; four steps in one plan, all of them shuffles of packed arrays:
    1. each block asks for its anchors; buckets answer which ones lie in two documents or more;
    2. each block sends the strings around those anchors, as contexts of up to 80 bytes, to the anchor's bucket. Equal contexts count
       once; contexts that may share a string are put together and a suffix array by linear grouping sorts
       them: neighbours that agree over 50 bytes are one string, whose least document is then known;
    3. spans whose string has a smaller document go back to the block, 4. where they are joined.
    Nothing is capped; the anchors of a group of copies collapse to one context.

    Null text is empty; texts under 50 bytes lose nothing. A null id counts as larger than all. Rows that
    repeat an id do not remove each other, both lose what a smaller id has. An empty table gives no rows;
    other columns are ignored.
    """

    def finish(ids, texts, starts, ends):
        return pd.DataFrame({"doc_id": ids, "text": texts, "starts": starts, "ends": ends})

    return _passages(docs, id_col, text_col, block_mb, finish, "doc_id long, text binary, starts array<long>, ends array<long>")


def passage_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 10.0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `passage_spans`, made where the spans are: no text leaves that task."""

    def finish(ids, texts, starts, ends):
        rows = []
        for t, s, e in zip(texts, starts, ends, strict=True):
            h, at = hashlib.sha256(), 0
            for x, y in zip(s, e, strict=True):
                h.update(t[at:x])
                at = y
            h.update(t[at:])
            rows.append((len(t), sum(e) - sum(s), len(s), h.hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "doc_id", ids)
        return out

    return _passages(docs, id_col, text_col, block_mb, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
