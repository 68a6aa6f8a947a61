"""Vectorized work on the bytes of many texts at once: joined buffers, rolling hashes, words."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2 ** 64: both directions of the rolling hash.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i (or its inverse's power) for i below n, modulo 2 ** 64; kept for the next call."""
    k = int(inverse)
    have = _powers[k]
    if len(have) < n:
        grown = np.full(max(n, 2 * len(have)), INVERSE if inverse else BASE, dtype=np.uint64)
        grown[0] = 1
        _powers[k] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text begins (with the end as last)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts


#: What stands for each byte in rolling hashes, so that they do not follow byte values.
_symbol = mix(np.arange(1, 257, dtype=np.uint64))
#: For second hashes that are independent of the first ones.
_other_symbol = mix(np.arange(1001, 1257, dtype=np.uint64))


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """H with H[j] - H[i] = the hash of data[i:j] times BASE ** i; see ``span_hash``."""
    return prefix_of((_other_symbol if second else _symbol)[data])


def prefix_of(symbols: np.ndarray) -> np.ndarray:
    """The same over numbers that already stand for the symbols."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(len(symbols)), out=out[1:])
    return out


def gram_hashes(prefix: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q symbols."""
    return mix((prefix[q:] - prefix[:-q]) * powers(len(prefix) - q, inverse=True))


def span_hash(prefix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [i, j), equal for equal bytes wherever they stand."""
    return mix((prefix[j] - prefix[i]) * powers(len(prefix), inverse=True)[i] + (j - i).astype(np.uint64))


_blank = np.zeros(256, dtype=bool)
_blank[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and where each text's words begin."""
    # A blank closes every text, so that no word crosses from one to the next.
    data, starts = joined([t + b" " for t in texts])
    data = _lower[data]
    blank = _blank[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1 if len(data) else np.empty(0, dtype=np.int64)
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    return span_hash(prefix_hash(data), begin, end), np.searchsorted(begin, starts)


def word_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text by text, and where each text's runs begin.

    Words are runs of bytes other than space and 9 to 13, with A-Z lowered. A text with fewer
    words than ``width`` has its whole sequence as one run; one without words has none.
    """
    words, first = word_hashes(texts)
    n_words = np.diff(first)
    n_runs = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(n_runs, out=out_starts[1:])
    at = np.arange(out_starts[-1]) - np.repeat(out_starts[:-1], n_runs) + np.repeat(first[:-1], n_runs)
    last = np.repeat(first[1:], n_runs)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        inside = at + k < last
        h = np.where(inside, mix(h * np.uint64(BASE) + words[np.minimum(at + k, max(len(words) - 1, 0))] + np.uint64(k + 1)), h) if len(words) else h
    return h, out_starts
