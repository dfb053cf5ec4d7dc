"""BPE encoding and decoding that encodes content-defined chunks once."""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.llm.blocks import SPACES, chunks, give_back, in_blocks, mix, pack, unpack

#: A chunk ends where the rolling hash of 16 bytes has so many zero bits: every 1024 bytes on average.
CUT_BITS, REACH = 10, 16
#: What a piece or text encodes to: its ids as decimal text and the ids' names, both with spaces between.
Entry = tuple[bytes, bytes]
NOTHING: Entry = (b"", b"")
#: When a worker remembers so many words, it goes on with those it meets again; the others are forgotten the next time.
REMEMBER = 200_000


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(texts: list[bytes]):
    """Per text: pieces (bytes, is a chunk's core) that together are the text.

    Cuts follow the content alone, so a passage gets the same chunks wherever it stands. A chunk's core, from its
    first to its last white space, is what is encoded once; what lies between two cores is the join, which is
    encoded anew together with the words beside it (`Encoder.repair`).
    """
    for a, b in chunks(texts):
        whole = b"".join(texts[a:b])
        data = np.frombuffer(whole, dtype=np.uint8)
        starts = np.cumsum([0, *map(len, texts[a:b])]).astype(np.int64)
        marks = [starts]
        core = np.zeros(0, dtype=np.int64)
        if len(data) > REACH:
            with np.errstate(over="ignore"):
                h, base, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x2545F4914F6CDD1D), 1
                while size < REACH:
                    h, base, size = h[:-size] * base + h[size:], base * base, size * 2
            cuts = np.flatnonzero(mix(h) >> np.uint64(64 - CUT_BITS) == 0) + REACH
            cuts = cuts[cuts - REACH >= starts[np.searchsorted(starts, cuts, side="left") - 1]]  # of one text alone
            edges = np.unique(np.concatenate([starts, cuts]))
            space = np.flatnonzero(SPACES[data])
            at = np.searchsorted(space, edges)
            some = at[:-1] < at[1:]
            first, last = space[at[:-1][some]], space[at[1:][some] - 1]
            core = first[first < last]
            marks += [first, last]
        bounds = np.unique(np.concatenate(marks))
        is_core = np.isin(bounds, core).tolist()
        bounds = bounds.tolist()
        k = 0
        for doc in range(b - a):
            out, end = [], int(starts[doc + 1])
            while bounds[k] < end:
                out.append((whole[bounds[k] : bounds[k + 1]], is_core[k]))
                k += 1
            yield out


def parts_at_space(t) -> bool:
    """Whether no id of the tokenizer spans white space and ids decode to their names with spaces between.

    It holds for a normaliser that changes characters one by one or folds white space, a first pre-tokenizer that
    drops white space, and neither a post-processor nor a decoder; some words are tried as well.
    """
    spec = json.loads(t.to_str())
    flat = lambda x, key: [y for z in x[key] for y in flat(z, key)] if x and x["type"] == "Sequence" else [x] if x else []
    normal, parts = flat(spec["normalizer"], "normalizers"), flat(spec["pre_tokenizer"], "pretokenizers")
    known = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}) for x in normal)
    drops = bool(parts) and (parts[0]["type"] == "WhitespaceSplit" or (parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]))
    special = any(any(c.isspace() for c in x["content"]) or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
    if not known or not drops or special or spec["post_processor"] or spec["decoder"]:
        return False
    ids = lambda text: t.encode(text, add_special_tokens=False).ids
    words = ["a", "it's", "Ärger", "1", "x" * 40, "漢字", "--", "…!", "\u0308", "İΣ", "<|", "\a"]
    for k, w in enumerate(words):
        other = words[k - 1]
        if any(ids(other + space + w) != ids(other) + ids(w) for space in " \t\n\r\x0b\x0c"):
            return False
        both = ids(f"{other} {w}")
        if t.decode(both, skip_special_tokens=False) != " ".join(map(t.id_to_token, both)):
            return False
    return True


def without_normaliser(t):
    """For a tokenizer of which `parts_at_space` holds: one that leaves out the normaliser, for ASCII words in the case
    it expects; whether that is lower case; the suffix of a word's last id. (None, False, b"") where it can't be made."""
    from tokenizers import Tokenizer

    spec = json.loads(t.to_str())
    lower = "Lowercase" in json.dumps(spec["normalizer"] or {})
    suffix = (spec["model"].get("end_of_word_suffix") or "").encode()
    bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
    for words in ("It's A TEST, x1-y2 (ok) <a|b> \x00\x7f", "The quick Brown fox", "".join(map(chr, range(33, 127)))):
        if bare.encode(words.lower() if lower else words, add_special_tokens=False).ids != t.encode(words, add_special_tokens=False).ids:
            return None, False, b""
    return bare, lower, suffix


class Encoder:
    """Entries of pieces.

    Where white space parts words exactly (`by_words`, checked when the file is read), a piece is put together from
    its words, and words that were met before are not encoded again.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        size = range(self.tokenizer.get_vocab_size())
        self.names = [(t or "").encode() for t in map(self.tokenizer.id_to_token, size)]
        self.decimals = [b"%d" % i for i in size]
        self.words: dict[bytes, Entry] = {}
        self.older: dict[bytes, Entry] = {}
        self.by_words = parts_at_space(self.tokenizer)
        self.bare, self.lower, self.suffix = without_normaliser(self.tokenizer) if self.by_words else (None, False, b"")
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.bell = ids("\a")[0] if ids("a \a b") == ids("a") + ids("\a") + ids("b") and len(ids("\a")) == 1 else None

    def entry(self, ids: list[int]) -> Entry:
        return b" ".join([self.decimals[i] for i in ids]), b" ".join([self.names[i] for i in ids])

    def learn(self, words: list[bytes]) -> None:
        """Remembers each word's entry. A call costs more than a word, so words go in lines.

        The normaliser leaves ASCII words as they are but for their case, so these go to a tokenizer without it. Words
        of letters are parted by the suffix that ends a word's last id. Others are parted by a bell: a word of its own
        with one id that no other byte makes. Words that hold a bell or may hold a special token go alone.
        """
        letters = [w for w in words if w.isalpha()] if self.suffix else []
        others = [w for w in words if not w.isalpha()] if self.suffix else words
        for line, e in self.lines(letters, b" ", self.bare):
            own, decoded = [self.decimals[i] for i in e.ids], b" ".join([self.names[i] for i in e.ids])
            parts = decoded.split(self.suffix + b" ")
            if len(parts) != len(line):  # some word is no single run of letters to the tokenizer
                others += line
                continue
            parts = [x + self.suffix for x in parts[:-1]] + parts[-1:]
            ids = iter(own)
            self.words.update(zip(line, [(b" ".join(islice(ids, x.count(b" ") + 1)), x) for x in parts], strict=True))
        whole = b"\n".join(others)
        alone = [w for w in others if b"\a" in w or b"<|" in w] if b"\a" in whole or b"<|" in whole else []
        rest = [w for w in others if not (b"\a" in w or b"<|" in w)] if alone else others
        alone, rest = (others, []) if self.bell is None else (alone, rest)
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
            self.words[w] = self.entry(e.ids)
        ascii_, wide = ([w for w in rest if w.isascii()], [w for w in rest if not w.isascii()]) if self.bare else ([], rest)
        for some, tokenizer in ((ascii_, self.bare), (wide, self.tokenizer)):
            for line, e in self.lines(some, b" \a ", tokenizer):
                own, decoded = self.entry(e.ids)
                own, decoded = own.split(b" %d " % self.bell), decoded.split(b" " + self.names[self.bell] + b" ")
                if len(own) == len(decoded) == len(line):
                    self.words.update(zip(line, zip(own, decoded, strict=True), strict=True))
                    continue
                ids, at = [*e.ids, self.bell], 0  # a word without ids is among them
                for w in line:
                    end = ids.index(self.bell, at)
                    self.words[w] = self.entry(ids[at:end])
                    at = end + 1

    def lines(self, words: list[bytes], between: bytes, tokenizer):
        """Lines of 64 words with their encodings."""
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        texts = [between.join(x) for x in lines]
        if tokenizer is self.bare and self.lower:
            texts = [x.lower() for x in texts]
        return zip(lines, tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False), strict=True) if lines else ()

    def encode(self, wanted: list[bytes]) -> list[Entry]:
        """Entries of pieces that begin and end at the ends of words."""
        if len(self.words) > REMEMBER:
            self.older, self.words = self.words, {}
        known, older, parts = self.words, self.older, [p.split() for p in wanted]
        new = set().union(*parts).difference(known)
        known.update([(w, older[w]) for w in new if w in older])
        missing = [w for w in new if w not in known]
        for i in range(0, len(missing), 4096):
            self.learn(missing[i : i + 4096])
        return [joined([known[w] for w in words]) for words in parts]

    def whole(self, text: bytes) -> Entry:
        """Entry of a whole text as the library encodes and decodes it."""
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return b" ".join([self.decimals[i] for i in ids]), self.tokenizer.decode(ids, skip_special_tokens=False).encode()

    def repair(self, texts: list[list[tuple[bytes, Entry | None]]]) -> list[Entry]:
        """Entries of whole texts from cores (bytes, entry) and joins (bytes, None), which alternate.

        A join is encoded anew in a window with the last word of the core before it and the first word of the core
        after it. It agrees with the cores when the window's ids begin with that word's ids as they end the core's
        ids, and end with the other's as they begin the next core's; what lies between is the join's. A window that
        doesn't agree takes twice as many words, up to both cores; if it then still doesn't, the text is encoded whole.
        """
        ends = (b"", NOTHING)
        beside = [[(doc[k - 1] if k else ends, p, doc[k + 1] if k + 1 < len(doc) else ends) for k, (p, e) in enumerate(doc) if e is None] for doc in texts]
        made: dict[tuple, Entry | None] = {}
        left, n = list(dict.fromkeys(x for doc in beside for x in doc)), 1
        while left:
            tries = [(x, *window_edges(x[0][0], x[2][0], n)) for x in left]
            edges = list(dict.fromkeys(e for _, a, b, _ in tries for e in (a, b)))
            entries = dict(zip(edges, self.encode(edges), strict=True))
            windows = list(dict.fromkeys(a + x[1] + b for x, a, b, _ in tries))
            ids: dict[bytes, list[int]] = {}
            for i in range(0, len(windows), 4096):
                part = windows[i : i + 4096]
                ids |= zip(part, (e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)), strict=True)
            left = []
            for x, a, b, last in tries:
                (_, before), join, (_, after) = x
                found = self.between(ids[a + join + b], entries[a][0], entries[b][0])
                if found is not None and ends_with(before[0], entries[a][0]) and starts_with(after[0], entries[b][0]):
                    made[x] = found
                elif not last:
                    left.append(x)
            n *= 2
        out = []
        for doc, joins in zip(texts, beside, strict=True):
            if any(x not in made for x in joins):
                out.append(self.whole(b"".join(p for p, _ in doc)))
                continue
            fixed = iter([made[x] for x in joins])
            out.append(joined([e or next(fixed) for _, e in doc]))
        return out

    def between(self, ids: list[int], first: bytes, last: bytes) -> Entry | None:
        """The ids of a window without those it begins and ends with; None if it doesn't begin and end so."""
        a, b = n_ids(first), n_ids(last)
        if len(ids) < a + b:
            return None
        own = [self.decimals[i] for i in ids]
        if b" ".join(own[:a]) != first or b" ".join(own[len(ids) - b :]) != last:
            return None
        return b" ".join(own[a : len(ids) - b]), b" ".join([self.names[i] for i in ids[a : len(ids) - b]])


def n_ids(own: bytes) -> int:
    return own.count(b" ") + 1 if own else 0


def window_edges(left: bytes, right: bytes, n: int) -> tuple[bytes, bytes, bool]:
    """The end of `left` that holds its last n words, the beginning of `right` that holds its first n, and whether that is all."""
    a, b = left.rsplit(None, n), right.split(None, n)
    start, end = (len(a[0]) if len(a) > n else 0), (len(right) - len(b[n]) if len(b) > n else len(right))
    return left[start:], right[:end], start == 0 and end == len(right)


def starts_with(ids: bytes, part: bytes) -> bool:
    """Whether ids, as decimal text, begin with those of `part`."""
    return not part or ids == part or ids.startswith(part + b" ")


def ends_with(ids: bytes, part: bytes) -> bool:
    return not part or ids == part or ids.endswith(b" " + part)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: its words serve block after block."""
    encoder = Encoder(path)
    give_back()
    return encoder


def joined(parts: list[Entry]) -> Entry:
    if not parts:
        return NOTHING
    own, decoded = zip(*parts, strict=True)
    if b"" in own:  # parts without ids leave no space
        own, decoded = filter(None, own), filter(None, decoded)
    return b" ".join(own), b" ".join(decoded)


def alternating(doc: list[tuple[bytes, bool]]) -> list[tuple[bytes, bool]]:
    """The pieces of a text with neighbours that are no cores put together: every join has cores or the text's ends beside it."""
    out: list[tuple[bytes, bool]] = []
    for p, core in doc:
        if not core and out and not out[-1][1]:
            out[-1] = (out[-1][0] + p, False)
        else:
            out.append((p, core))
    return out


def ids_of_text(text: bytes) -> np.ndarray:
    return np.array(text.split(), dtype=np.uint32)


def _key(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_mb: float = 12.0, ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids, if asked for).

    Equal to the tokenizers library on the whole text, without special tokens added. Documents lie in blocks.
    Each block tells buckets the digests of its chunks' cores; for a core that several blocks hold, the bucket
    names one block, which encodes it and sends the ids to the others. A task then encodes the cores that only its
    block holds, once each, and repairs the joins between cores by encoding them anew until they agree with the
    cores' ids on both sides. Whole texts, nothing is cut off. Cores begin and end at white space, which is right for
    tokenizers that part words there (see `parts_at_space`); with any other one every text is encoded whole.

    `path` names the vocabulary file on every machine. Null text is empty: no ids, and the digests of nothing.
    Rows with a null or repeated id are documents of their own; an empty table gives no rows; other columns
    are ignored.
    """
    base, n = in_blocks(docs, id_col, text_col, block_mb)

    def cores(pdf):
        if not encoder_of(path).by_words:
            return {}
        return dict.fromkeys(p for doc in pieces(pdf["text"].tolist()) for p, core in doc if core)

    def ask(pdf):
        keys = np.frombuffer(b"".join(sorted(map(_key, cores(pdf)))), dtype="V16")
        bucket = keys.view("<u8").reshape(-1, 2)[:, 0] % np.uint64(n)
        return pd.DataFrame([(int(b), int(pdf["block"].iloc[0]), keys[bucket == b].tobytes()) for b in np.unique(bucket)], columns=["bucket", "block", "blob"])

    def name(pdf):
        """Which block encodes a shared core, and for whom."""
        keys = np.concatenate([np.frombuffer(b, dtype="V16") for b in pdf["blob"]])
        block = np.repeat(pdf["block"].to_numpy(), [len(b) // 16 for b in pdf["blob"]])
        kinds, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        first = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, block)
        shared = count[inverse] > 1
        keys, to, owner = keys[shared], block[shared], first[inverse[shared]]
        order = np.lexsort((to, owner))
        keys, to, owner = keys[order], to[order], owner[order]
        return pd.DataFrame([(int(o), pack(keys[owner == o].tobytes(), to[owner == o].astype(np.int32))) for o in np.unique(owner)], columns=["block", "blob"])

    def lend(pdf, asked):
        """The ids of the shared cores that this block was named for, to each block that holds them."""
        if not len(pdf) or not len(asked):
            return pd.DataFrame({"block": [], "blob": []})
        by_key = {_key(p): p for p in cores(pdf)}
        keys, to = [], []
        for blob in asked["blob"]:
            k, t = unpack(blob)
            keys += [k[i : i + 16] for i in range(0, len(k), 16)]
            to.append(t)
        to = np.concatenate(to)
        kinds = list(dict.fromkeys(keys))
        made = dict(zip(kinds, (ids_of_text(e[0]) for e in encoder_of(path).encode([by_key[k] for k in kinds])), strict=True))
        rows = []
        for block in np.unique(to).tolist():
            mine = [keys[i] for i in np.flatnonzero(to == block).tolist()]
            rows.append((block, pack(b"".join(mine), np.array([len(made[k]) for k in mine], dtype=np.uint32), np.concatenate([made[k] for k in mine]))))
        return pd.DataFrame(rows, columns=["block", "blob"])

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def assemble(pdf, lent):
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        given: dict[bytes, Entry] = {}
        encoder = encoder_of(path)
        for blob in lent["blob"]:
            keys, sizes, flat = unpack(blob)
            flat = flat.tolist()
            at = 0
            for i, size in enumerate(sizes.tolist()):
                given[keys[16 * i : 16 * i + 16]] = encoder.entry(flat[at : at + size])
                at += size
        rows, texts = [], pdf["text"].tolist()
        size, group = 0, []

        def add(own, decoded):
            row = [n_ids(own), hashlib.sha256(own).hexdigest(), hashlib.sha256(decoded).hexdigest()]
            rows.append(row + ([ids_of_text(own).tolist()] if ids else []))

        def flush():
            fresh = [p for p in dict.fromkeys(p for doc in group for p, core in doc if core) if not given or _key(p) not in given]
            known = dict(zip(fresh, encoder.encode(fresh), strict=True))
            entry = lambda p: known[p] if p in known else given[_key(p)]
            for done in encoder.repair([[(p, entry(p) if core else None) for p, core in doc] for doc in group]):
                add(*done)
            group.clear()

        if not encoder.by_words:
            for text in texts:
                add(*encoder.whole(text))
            texts = []
        for doc in pieces(texts):
            group.append(alternating(doc))
            size += sum(len(p) for p, _ in doc)
            if size > 500_000:
                flush()
                size = 0
        flush()
        given.clear()
        give_back()
        out = pd.DataFrame(rows, columns=columns[1:])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out

    asked = base.groupBy("block").applyInPandas(ask, "bucket int, block int, blob binary")
    named = asked.groupBy("bucket").applyInPandas(name, "block int, blob binary")
    lent = base.groupBy("block").cogroup(named.groupBy("block")).applyInPandas(lend, "block int, blob binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return base.groupBy("block").cogroup(lent.groupBy("block")).applyInPandas(assemble, schema)
