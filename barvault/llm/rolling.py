"""Hashes of substrings of a byte string, for all of its words or windows at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
PIECE = 1 << 20

_SPACE = re.compile(rb"\s")
_OTHER, _WORD, _MARK = 0, 1, 2
_KIND = np.array(
    [
        _OTHER if bytes([b]).isspace() else _WORD if bytes([b]).isalnum() or b >= 0x80 else _MARK
        for b in range(256)
    ],
    dtype=np.uint8,
)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``size`` bytes (one without white space is not cut)."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[at:end]
        at = end


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    """base**0 … base**(2**bits - 1) modulo 2**64."""
    out = np.ones(1 << bits, np.uint64)
    for i in range(bits):
        out[1 << i : 2 << i] = out[: 1 << i] * np.uint64(pow(base, 1 << i, 1 << 64))
    return out


def _table(base: int, count: int) -> np.ndarray:
    return _powers(base, max(12, (count - 1).bit_length()))


def prefixes(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` gets the hash of any substring."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= _table(pow(BASE, -1, 1 << 64), len(data) + 1)[: len(data)]
    np.cumsum(values, out=sums[1:])
    return sums


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread a polynomial's bits; the upper ones are the best."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings start … end, wherever these lie."""
    return mix((sums[end] - sums[start]) * _table(BASE, len(sums))[start])


def window_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes, by their start."""
    return mix((sums[size:] - sums[:-size]) * _table(BASE, len(sums))[: len(sums) - size])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling the width reached so far."""
    reached, least = 1, values
    while reached < width:
        step = min(reached, width - reached)
        least = np.minimum(least[: len(least) - step], least[step:])
        reached += step
    return least


def tokens(data: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of letters, digits and bytes beyond ASCII, and, with ``marks``, of other signs."""
    kind = _KIND[data]
    if not marks:
        kind = (kind == _WORD).astype(np.uint8)
    edges = np.flatnonzero(np.diff(kind, prepend=np.uint8(_OTHER), append=np.uint8(_OTHER)))
    # between two edges lies a run of one kind; the first run starts at the first edge
    inside = kind[edges[:-1]] != _OTHER
    return edges[:-1][inside], edges[1:][inside]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]
