"""Word arrays and rolling hashes over a batch of texts, for use inside tasks (NumPy and Arrow)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """The words of many texts, one after another.

    ``words``: Arrow strings; ``codes``: the number of each word's kind in ``kinds``; ``ends``: for each text the end of
    its words in that order."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = _lower_ascii(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        keep = pc.greater(pc.binary_length(flat), 0)
        self.words = flat.filter(keep)
        self.owner = owner.filter(keep).to_numpy().astype(np.int64)
        coded = self.words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.kinds = coded.dictionary
        self.counts = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self._hashed: np.ndarray | None = None

    def left(self) -> np.ndarray:
        """How many words of the same text begin at each word, itself included."""
        return self.ends[self.owner] - np.arange(len(self.owner))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per word; texts of kinds are hashed once, other seeds mix that hash again."""
        if self._hashed is None:
            self._hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, self.kinds.to_pylist()), dtype=np.uint64, count=len(self.kinds))
        kinds = mixed(self._hashed, np.full(len(self._hashed), seed, np.uint64)) if seed else self._hashed
        return kinds[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def _lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z to a-z and nothing else; bytes of other characters are never in that range in UTF-8."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]].copy()
    data[(data >= 65) & (data <= 90)] += 32
    moved = (offsets - offsets[0]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(moved.tobytes()), pa.py_buffer(data.tobytes())])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order counts."""
    x = a * _M1 + b
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each place on, by doubling; places without k values after them are left out."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    powers, step = [(hashes, 1)], 1
    while step * 2 <= k:
        h = powers[-1][0]
        powers.append((mixed(h[:len(h) - step], h[step:]), step * 2))
        step *= 2
    out, at = powers[-1]
    for h, step in reversed(powers[:-1]):
        if at + step <= k:
            n = len(hashes) - at - step + 1
            out = mixed(out[:n], h[at:at + n])
            at += step
    return out


def sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) of the ``width`` values from each place on; ends are folded over what is there."""
    out, step = values, 1
    while step * 2 <= width:
        out = _folded(out, step, fold)
        step *= 2
    return _folded(out, width - step, fold) if width > step else out


def _folded(values: np.ndarray, step: int, fold) -> np.ndarray:
    if step >= len(values):
        return values.copy()
    out = values.copy()
    fold(values[:-step], values[step:], out=out[:-step])
    return out
