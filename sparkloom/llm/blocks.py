"""Documents in blocks of bounded size, and packed arrays that travel between blocks and buckets.

Some operators ask the corpus about millions of small keys (n-grams, anchors). A row per key would cost
dozens of bytes and microseconds; here a block of documents asks each bucket once, with an array. Blocks hold
about 16 MB of text whatever the input's size, buckets are as many as blocks.
"""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import blocks_for

NO_ID = np.iinfo(np.int64).max


def give_back() -> None:
    """Returns freed memory to the system: a worker process outlives its task and would keep it from the other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_mb: float) -> tuple[DataFrame, int]:
    """(block, doc_id, has_id, text as UTF-8 bytes) and the number of blocks; null text is empty."""
    n = blocks_for(docs, text_col, block_mb)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    block = F.pmod(F.xxhash64(doc_id, F.octet_length(text), F.when(doc_id.isNull(), F.xxhash64(text))), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), doc_id.alias("doc_id"), text.cast("binary").alias("text")), n


def ids_of(pdf) -> tuple[np.ndarray, np.ndarray]:
    """Ids with NO_ID for null, and which are null."""
    null = pdf["doc_id"].isna().to_numpy()
    return pdf["doc_id"].fillna(NO_ID).astype("int64").to_numpy() if not null.any() else np.array([NO_ID if b else int(v) for v, b in zip(pdf["doc_id"], null, strict=True)], dtype=np.int64), null


def chunks(texts: list[bytes], most: int = 1_000_000):
    """Ranges of documents of about `most` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of `keys` by bucket, and the bounds of the n buckets in it."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, between: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """First byte, end and 64-bit hash (over 1) of each run of bytes that `between` (256 flags) doesn't name.

    With `prefixes`, a hash of each longer run's first bytes follows for each of those lengths (0: run not longer).

    `data` ends with such a byte. Hashes are differences of prefix sums, so the cost is per byte, not per word.
    """
    values = mix(np.arange(1, 257, dtype=np.uint64))
    power, back = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 2**64), len(data))
    edge = np.flatnonzero(np.diff(np.r_[True, between[data]].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(values[data] * power)]
        h = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(2)
        starts = [np.where(last - first > k, mix((sums[np.minimum(last, first + k)] - sums[first]) * back[first] + np.uint64(k)) | np.uint64(2), np.uint64(0)) for k in prefixes]
    return first, last, h, *starts
