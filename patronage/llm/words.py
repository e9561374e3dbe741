"""Words of many texts at once as arrays, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the rolling hashes.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = np.uint64(0xFF51AFD7ED558CCD)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's words begin (one entry more than texts).

    Words are what stands between space, tab, line feed, vertical tab, form feed and carriage
    return. A null text has none.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, begins = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return flat.filter(filled), upto[begins].astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = words.dictionary_encode()
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return of[coded.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.uint64)


def run_hashes(values: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive values; empty if there are fewer."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(len(values), base, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * powers, dtype=np.uint64)))
    found = (sums[length:] - sums[:n]) * back
    found ^= found >> np.uint64(33)
    found *= MIX
    return found ^ (found >> np.uint64(29))


def whole_runs(begins: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` words begins that stays within its text, as positions among all words."""
    total = int(begins[-1])
    room = np.repeat(begins[1:], np.diff(begins)) - np.arange(total)
    return np.flatnonzero(room >= length)
