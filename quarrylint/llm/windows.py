"""Rolling hashes and content-chosen anchors of byte strings, whole arrays at a time."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 21
MOST = 1 << PLACE_BITS


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_POWER, _INVERSE = _powers(BASE, MOST + 1), _powers(INVERSE, MOST + 1)


def scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: A random 64-bit number for each byte.
_LETTERS = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Rolling:
    """Hashes of any stretch of ``data``, equal for equal content wherever it stands."""

    def __init__(self, data: np.ndarray):
        self.upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * _POWER[: len(data)], out=self.upto[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scrambled((self.upto[stop] - self.upto[start]) * _INVERSE[start])

    def all(self, size: int) -> np.ndarray:
        count = len(self.upto) - size
        return scrambled((self.upto[size:] - self.upto[:count]) * _INVERSE[:count])


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Per window of ``width`` neighbours the place of its smallest hash, the first of equal ones."""
    low = np.uint64(MOST - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    count = len(keys) - width + 1
    blocks = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & low).astype(np.int64)
