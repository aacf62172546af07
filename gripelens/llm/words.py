"""Columnar text helpers for operators that run numpy inside Spark tasks.

Texts arrive as Arrow record batches.  ``sliced`` cuts a batch into pieces of a
few megabytes of text, so that the arrays of one step stay small whatever the
batch size; a longer text is a piece of its own.  Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
#: A-Z to a-z, every other byte as it is.
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Lower case; all but a-z, 0-9 and the bytes of non-ASCII characters is a blank.
PLAIN = np.where(_ALNUM[LOWER] | (_BYTES >= 0x80), LOWER, 0x20).astype(np.uint8)


class Words(NamedTuple):
    """The words of some texts: text i has ``flat[offsets[i]:offsets[i + 1]]``."""

    flat: pa.Array
    offsets: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_text)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words in that order."""
        made = pc.dictionary_encode(self.flat)
        if isinstance(made, pa.ChunkedArray):
            made = made.combine_chunks()
        return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def text_array(values: pa.Array) -> pa.Array:
    """Plain string array from offset 0, nulls as empty texts."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.concat_arrays([pc.fill_null(values.cast(pa.large_string()), "")])


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by its entry in a 256-byte table."""
    raw, at = raw_bytes(texts)
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(table[raw].tobytes())
    )


def _without_blanks(flat: pa.Array, offsets: np.ndarray) -> Words:
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    counts = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return Words(flat.filter(full), counts[offsets])


def space_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    if len(texts) == 0:
        return Words(pa.array([], pa.large_string()), np.zeros(1, np.int64))
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return _without_blanks(lists.flatten(), offsets - offsets[0])


def plain_words(texts: pa.Array) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z."""
    return space_words(mapped(texts, PLAIN))


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string."""
    one = xxhash.xxh3_64_intdigest
    found = [one(w, seed) for w in distinct.cast(pa.large_binary()).to_pylist()]
    return np.array(found, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sliced(
    batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``limit`` text bytes and ``rows`` rows, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            stop = min(stop, start + (rows or stop))
            yield batch.slice(start, stop - start)
            start = stop


class KeyTable:
    """Values by 64-bit keys in a flat hash table, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(10, (4 * len(keys)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.missing = missing
        self.full = np.zeros(1 << bits, bool)
        self.keys = np.zeros(1 << bits, np.int64)
        self.values = np.full(1 << bits, missing, np.int64)
        keys, values = keys.astype(np.int64), values.astype(np.int64)
        slot = self._slot(keys)
        while keys.size:
            free = np.flatnonzero(~self.full[slot])
            taken, first = np.unique(slot[free], return_index=True)
            done = free[first]
            self.keys[taken], self.values[taken], self.full[taken] = keys[done], values[done], True
            rest = np.ones(keys.size, bool)
            rest[done] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        same = self.keys[slot] == key
        out = np.where(same, self.values[slot], self.missing)
        open_ = np.flatnonzero(~same & self.full[slot])
        while open_.size:
            slot[open_] = at = (slot[open_] + 1) & self.mask
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & self.full[at]]
        return out
