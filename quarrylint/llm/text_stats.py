"""Counts that describe a text, taken from its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, dtype=np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Numbered(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


def numbers_of(words: Sequence[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0."""
    return np.fromiter(map(Numbered().__getitem__, words), dtype=np.int64, count=len(words))


def window_numbers(ids: np.ndarray, size: int) -> np.ndarray:
    """Equal windows of ``size`` neighbours get equal numbers; ``ids`` are numbers from 0."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    span = int(ids.max()) + 1
    windows, reach = ids[:count], span
    for place in range(1, size):
        if reach > (1 << 62) // span:
            windows = np.unique(windows, return_inverse=True)[1]
            reach = int(windows.max()) + 1
        windows = windows * span + ids[place : place + count]
        reach *= span
    return windows


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` words that the text has twice or more, the first included."""
    windows = window_numbers(ids, size)
    if not len(windows):
        return 0
    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[inverse] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def text_counts(content: bytes) -> tuple[int, int, int, int, int]:
    """The values of COUNTS. Words are runs of bytes outside 0x20 and 0x09 to 0x0D."""
    words = content.split()
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    lines = [line for line in content.split(b"\n") if line.strip()]
    return (
        len(words),
        int(np.count_nonzero((joined & 0xC0) != 0x80)),
        int(np.count_nonzero(_SYMBOL[joined])),
        len(lines) - len(set(lines)),
        repeated_words(numbers_of(words)),
    )
