"""Encoding a corpus with a public byte-level BPE tokenizer, by reuse of content-defined chunks.

A gear hash rolled over the UTF-8 bytes cuts each text into chunks whose ends depend on their content alone, so documents
that share passages share chunks; within a task each distinct chunk is encoded once. A cut is moved to the next place
where the tokenizer parts in any context (a safe place: before white space that follows other text, or between letters,
digits and signs). Where none is near, the cut stays and the join is repaired afterwards: the stretch between the safe
places around it is encoded anew, once for all joins in it, and wider until both of its ends are ends of tokens beside it.

No shuffle: texts are read, encoded and written where they lie. The memory of chunks is bounded by MEMO_BYTES a task and
only saves work: what falls out of it is encoded again.

Defined results: null and empty texts have no ids (an empty list); one row out per row in; extra columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardloom.tables import spread

#: A chunk ends where the low bits of the hash are all set: about one byte in 2 ** BITS.
BITS, WINDOW = 8, 16
#: A cut is moved by at most so many bytes.
NEAR = 64
MEMO_BYTES = 64_000_000

_GEAR = np.random.default_rng(20_240_517).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
# byte classes: 0 letters (any byte of a character beyond ASCII counts as neither safe nor white), 1 digits, 2 white space, 3 signs, 4 beyond ASCII
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 0
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[128:] = 4


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoder(path: str):
    """(tiktoken encoding, byte length of each token) of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def safe_places(data: np.ndarray) -> np.ndarray:
    """For each byte, whether the tokenizer parts before it in any context. Only places between ASCII bytes are decided."""
    kind = _CLASS[data]
    before, after = kind[:-1], kind[1:]
    plain = (before != 4) & (after != 4)
    out = np.zeros(len(data), bool)
    # white space after other text; letters, digits and signs beside each other, but for what follows an apostrophe
    out[1:] = plain & (before != after) & (before != 2) & ((after == 2) | (data[:-1] != 39))
    return out


def cuts(data: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Content-defined ends of chunks, without 0 and the end of the text."""
    n = len(data)
    if n <= 2 * WINDOW:
        return np.zeros(0, np.int64)
    gear, h = _GEAR[data], np.zeros(n, np.uint32)
    for j in range(WINDOW):
        h[j:] += gear[: n - j] << np.uint32(j)
    raw = np.flatnonzero((h >> np.uint32(WINDOW)) & np.uint32(2**BITS - 1) == 0)
    raw = raw[(raw >= WINDOW) & (raw < n - 1)] + 1
    if not len(raw):
        return raw
    places = np.flatnonzero(safe)
    at = np.searchsorted(places, raw)
    to = np.where(at < len(places), places[np.minimum(at, len(places) - 1)] if len(places) else 0, n)
    near = to - raw <= NEAR
    # a cut that stays where it is must not part a character
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    stay = starts[np.minimum(np.searchsorted(starts, raw), len(starts) - 1)]
    got = np.unique(np.where(near & (to < n), to, stay))
    return got[(got > 0) & (got < n)]


class Reuse:
    """Encodes texts by the chunks they share; `encoded` and `reused` count bytes."""

    def __init__(self, path: str):
        self.encoding, self.lengths = encoder(path)
        self.memo: dict[bytes, list[int]] = {}
        self.held = self.encoded = self.reused = self.repairs = 0

    def _chunk(self, b: bytes) -> list[int]:
        got = self.memo.get(b)
        if got is None:
            got = self.encoding.encode_ordinary(b.decode("utf-8"))
            self.encoded += len(b)
            cost = len(b) + 8 * len(got) + 200
            if self.held + cost > MEMO_BYTES:
                self.memo, self.held = {}, 0
            self.memo[b] = got
            self.held += cost
        else:
            self.reused += len(b)
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        safe = safe_places(data)
        ends = cuts(data, safe)
        if not len(ends):
            return list(self._chunk(raw))
        bounds = [0, *ends.tolist(), len(raw)]
        ids: list[int] = []
        for a, b in zip(bounds, bounds[1:]):
            ids += self._chunk(raw[a:b])
        unsafe = ends[~safe[ends]]
        return self._repair(ids, raw, unsafe, np.flatnonzero(safe)) if len(unsafe) else ids

    def _repair(self, ids: list[int], raw: bytes, joins: np.ndarray, places: np.ndarray) -> list[int]:
        """Encodes each stretch between safe places that holds a join anew, once; further if its ends are no ends of tokens beside it."""
        offsets = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        out: list[int] = []
        done = 0  # bytes that `out` stands for
        for k in np.unique(np.searchsorted(places, joins)).tolist():
            low, high = k - 1, k
            while True:
                a, b = int(places[low]) if low >= 0 else 0, int(places[high]) if high < len(places) else len(raw)
                i, j = int(np.searchsorted(offsets, a)), int(np.searchsorted(offsets, b))
                if offsets[i] == a and offsets[j] == b:
                    break
                low, high = low - 1, high + 1
            if b <= done:
                continue
            start = int(np.searchsorted(offsets, done))
            a = max(a, done)
            self.repairs += 1
            out += ids[start : int(np.searchsorted(offsets, a))]
            out += self.encoding.encode_ordinary(raw[a:b].decode("utf-8"))
            done = b
        return out + ids[int(np.searchsorted(offsets, done)) :]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    reuse = Reuse(path)
    for b in batches:
        ids = [reuse.encode(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])


def encode(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(row_id, ids: array<int>) of each row, without special tokens."""
    path = path or default_path()
    kind = df.schema[row_id].dataType.simpleString()
    got = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    got = spread(got, "_id").mapInArrow(lambda it: encode_batches(it, path), f"_id {kind}, ids array<int>")
    return got.withColumnRenamed("_id", row_id)


def lengths(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(row_id, tokens: int) of each row."""
    path = path or default_path()
    kind = df.schema[row_id].dataType.simpleString()

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse = Reuse(path)
        for b in it:
            n = [len(reuse.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["_id", "tokens"])

    got = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    got = spread(got, "_id").mapInArrow(count, f"_id {kind}, tokens int")
    return got.withColumnRenamed("_id", row_id)
