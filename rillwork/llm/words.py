"""Words of a batch of texts as arrays: where they lie and a 64-bit hash of each.

All work is done on the bytes of an Arrow string array, without a Python
object for each word. A word's hash is a sum of random values, one for each
byte at each place; words longer than the table are hashed by BLAKE2. Two given
words that differ have the same hash with odds of 1 to 2**64, whatever they are
made of. ``second`` is another such hash from tables of its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATORS = (0x20, *range(0x09, 0x0E))
_RANDOM = np.random.Generator(np.random.PCG64(20))
#: Bytes of a word that have a place in the tables.
_PLACES = 48
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SEPARATORS)] = False
_IS_LOOSE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Odd factors of the words of a run; a run has its words' hashes, each times the factor of its place.
_FACTORS = np.random.Generator(np.random.PCG64(21)).integers(0, 2**64, 1 << 12, dtype=np.uint64) | np.uint64(1)


def _table(is_word: np.ndarray, lower: bool, own: np.ndarray) -> np.ndarray:
    """Value of each byte at each place: 0 for bytes of no word, that of the small letter for A to Z if ``lower``."""
    out = own.copy()
    if lower:
        out[:, 0x41:0x5B] = own[:, 0x61:0x7B]
    out[:, ~is_word] = 0
    return out.reshape(-1)


_FIRST, _SECOND = _RANDOM.integers(0, 2**64, (2, _PLACES, 256), dtype=np.uint64)
_EXACT, _LOWER, _LOOSE = _table(_IS_WORD, False, _FIRST), _table(_IS_WORD, True, _FIRST), _table(_IS_LOOSE, True, _FIRST)
_AGAIN = _table(_IS_WORD, False, _SECOND)


@dataclass
class Words:
    """data: bytes of all texts; word k is data[starts[k]:ends[k]]; text i has words first[i] to first[i + 1].

    ``second`` is there only if it was asked for.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    second: np.ndarray | None = None

    def word(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, second: bool = False) -> Words:
    """Words between white space; ``lower``: A to Z count as a to z in the hashes; ``second``: the other hashes too."""
    data, offsets = string_bytes(texts)
    return _split(data, offsets, _IS_WORD, _LOWER if lower else _EXACT, lower, _AGAIN if second else None)


def split_loose(texts: pa.Array) -> Words:
    """Runs of letters and digits, ASCII and Latin-1 capitals as small letters."""
    data, offsets = string_bytes(texts)
    capital = np.zeros(len(data), dtype=bool)
    # U+00C0 to U+00DE but for U+00D7 are the bytes C3 80 to C3 9E
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return _split(np.where(capital, data + np.uint8(0x20), data), offsets, _IS_LOOSE, _LOOSE, True)


def _split(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, table: np.ndarray, lower: bool, again: np.ndarray | None = None
) -> Words:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    own, before, after = inside[1:-1], inside[:-2], inside[2:]
    starts = np.flatnonzero(own & (~before | cut[:-1]))
    ends = np.flatnonzero(own & (~after | cut[1:])) + 1
    first = np.searchsorted(starts, offsets)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return Words(data, starts, ends, first, none, none)
    sizes = ends - starts
    place = np.arange(starts[0], len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(data))))
    np.minimum(place, _PLACES - 1, out=place)
    place *= 256
    place += data[starts[0] :]
    long = [(k, data[starts[k] : ends[k]].tobytes()) for k in np.flatnonzero(sizes > _PLACES).tolist()]
    long = [(k, hashlib.blake2b(w.lower() if lower else w, digest_size=16).digest()) for k, w in long]
    found = []
    for half, values in enumerate((table, again)):
        if values is None:
            continue
        sums = np.add.reduceat(values[place], starts - starts[0])
        for k, digest in long:
            sums[k] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
        found.append(mix(sums ^ sizes.astype(np.uint64)))
    return Words(data, starts, ends, first, *found)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one text.

    Returns the hashes, the index of each run's first word, and where each
    text's runs begin.
    """
    n = np.diff(first)
    runs = np.maximum(n - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], runs)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += hashes[at + j] * _FACTORS[j]
    return mix(h), at, begin


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all slices offsets[i]:offsets[i] + lengths[i], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets - (ends - lengths), lengths)
