"""Word shingles as 64-bit hashes, shared by the near-duplicate operators.

Words are the runs of bytes other than ASCII white space, A-Z lower-cased.
A text of at least ``width`` words gives the set of its ``width``-word
sequences; a shorter one gives its whole word sequence as the only shingle;
a text without words gives the empty set.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _factors(width: int) -> np.ndarray:
    seeds = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(seeds) | np.uint64(1)


_FACTORS = [_factors(n) for n in range(9)]


#: Bytes of a text that are hashed at once, and of a word that is hashed by itself.
_BLOCK, _LONG = 1 << 14, 64
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + _LONG, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = np.arange(256, dtype=np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] += np.uint64(32)
_BYTES = mix((_LETTERS + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of every word, in order: a polynomial of its bytes, all words of a block at once.

    Words of more than ``_LONG`` bytes, where a polynomial is easy to defeat, are hashed one by one.
    """
    return _hashed(text or b"")[0]


def texts_hashes(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of several texts, one text after the other, and where each text's begin (and the last ones end)."""
    texts = [t or b"" for t in texts]
    out, start = _hashed(b" ".join(texts))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return out, np.searchsorted(start, begin)


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the bytes where they start."""
    raw = np.frombuffer(text, dtype=np.uint8)
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(start, base + _BLOCK))
        piece = raw[base : base + _BLOCK + _LONG]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[piece] * _UP[: len(piece)], out=total[1:])
        a, b = start[at:to] - base, np.minimum(end[at:to] - base, len(piece))
        # Divided by the power of the word's place, so that a word's hash is the same anywhere.
        out[at:to] = mix((total[b] - total[a]) * _DOWN[a])
        at = to
    for k in np.flatnonzero(end - start > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]].lower())
    return out, start


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every shingle of a sequence of word hashes, in order."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    span = min(n, width)
    with np.errstate(over="ignore"):
        # The span is part of the hash: a short text never equals a window.
        h = np.full(n - span + 1, span * 0xD6E8FEB86659FD93 & _MASK, dtype=np.uint64)
        for k, factor in enumerate(_FACTORS[span] if span < len(_FACTORS) else _factors(span)):
            h += words[k : k + len(h)] * factor
    return mix(h)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    return np.unique(shingle_hashes(words, width))
