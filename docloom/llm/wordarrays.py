"""The words of an Arrow text column as numpy arrays: places, documents and 64-bit hashes.

A column's texts lie end to end in one buffer. Words are found with byte tables
and hashed with prefix sums of a polynomial modulo 2**64, a few nanoseconds a
byte and no Python object for a word. Equal words have equal hashes; different
words share one with a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

MASK = (1 << 64) - 1
RADIX = 0xD1342543DE82EF95
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHIFT_1, SHIFT_2, SHIFT_3 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> SHIFT_1)) * MIX_1
    h = (h ^ (h >> SHIFT_2)) * MIX_2
    return h ^ (h >> SHIFT_3)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and the places where its texts begin (one more at the end); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a column. start, end: byte places; doc: row; hash; first: for each row its first word, and their number at the end."""

    def __init__(self, data, at, start, end, doc, hashes):
        self.data, self.at, self.start, self.end, self.doc, self.hash = data, at, start, end, doc, hashes
        self.n_docs = len(at) - 1
        self.first = np.searchsorted(doc, np.arange(self.n_docs + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of n words within one document starts, and its hash."""
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:total].copy()
        for k in range(1, n):
            h *= np.uint64(RADIX)
            h += self.hash[k : total + k]
        at = np.flatnonzero(self.doc[:total] == self.doc[n - 1 :])
        return at, mixed(h[at])


class WordHasher:
    """separators: ASCII bytes between words; fold: A-Z count as a-z."""

    CHUNK = 1 << 17

    def __init__(self, separators: bytes, fold: bool = True):
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        code = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            code[65:91] = code[97:123]
        self.code = code
        power = np.ones(self.CHUNK + 1, np.uint64)
        power[1:] = np.uint64(RADIX)
        self.up = np.cumprod(power)
        power[1:] = np.uint64(pow(RADIX, -1, 1 << 64))
        self.down = np.cumprod(power)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of disjoint, ascending byte spans."""
        out = np.zeros(len(start), np.uint64)
        i = 0
        while i < len(start):
            base = start[i]
            j = int(np.searchsorted(end, base + self.CHUNK, side="right"))
            if j <= i:
                out[i] = self.long(data[base : end[i]])
                i += 1
                continue
            sums = np.zeros(end[j - 1] - base + 1, np.uint64)
            np.cumsum(self.code[data[base : end[j - 1]]] * self.up[: len(sums) - 1], out=sums[1:])
            s = start[i:j] - base
            out[i:j] = (sums[end[i:j] - base] - sums[s]) * self.down[s]
            i = j
        return mixed(out + (end - start).astype(np.uint64))

    def long(self, data: np.ndarray) -> np.uint64:
        """Of a span longer than a chunk, before mixing."""
        total = 0
        for k in range(0, len(data), self.CHUNK):
            part = data[k : k + self.CHUNK]
            total += int(np.sum(self.code[part] * self.up[: len(part)], dtype=np.uint64)) * pow(RADIX, k, 1 << 64)
        return np.uint64(total & MASK)

    def __call__(self, texts: pa.Array) -> Words:
        data, at = buffers(texts)
        return self.of(data, at)

    def of(self, data: np.ndarray, at: np.ndarray) -> Words:
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not(self.apart[data], out=inside[:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside[:-1] & (~before[:-1] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(before & (~inside | edge))
        doc = np.searchsorted(at, start, side="right") - 1
        return Words(data, at, start, end, doc, self.spans(data, start, end))


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte (or word) over each row's span."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, hash) pairs: which occur twice or more, and which equal an earlier one."""
    key = mixed(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(RADIX))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    again = np.zeros(len(key), bool)
    if len(key) > 1:
        k = key[order]
        eq = k[1:] == k[:-1]
        again[order[1:]] = eq
        same[order[1:]] = eq
        same[order[:-1]] |= eq
    return same, again


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Parts of a batch of at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
    i = 0
    while i < batch.num_rows:
        base = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
