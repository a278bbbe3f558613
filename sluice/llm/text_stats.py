"""Vectorised statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sluice.llm.common import SPACES

#: Words in a window that counts as repeated.
WINDOW = 8
#: Base of the polynomial that hashes words, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers.clear()
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of texts, end to end: a 64-bit hash of each, and where each text's words start and end."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray


@dataclass
class Stats:
    """Counts of each text that need one pass over its bytes, words and lines."""

    n_bytes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    words: Words


def split_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """All bytes with a space after each text, where each text starts in them, which bytes are in words, and the words."""
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])[:-1]]).astype(np.int64)
    inside = ~_IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    power, inverse = powers(len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)])
    hashes = mix((total[end] - total[begin]) * inverse[begin])
    first = np.searchsorted(begin, starts)
    return buf, starts, inside, Words(hashes, first, np.concatenate([first[1:], [len(begin)]]))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in the same text, the first included."""
    n, counts = len(words.hashes), words.last - words.first
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(np.arange(n) + window <= words.last[text]) if n else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(len(counts), np.int64)
    key = mix(text[start].astype(np.uint64) + np.uint64(_BASE))
    for k in range(window):
        key = key * np.uint64(0x100000001B3) + words.hashes[start + k]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    edge = np.zeros(n + 1, np.int64)
    hit = np.unique(start[order[np.concatenate([same, same + 1])]])
    edge[hit] += 1
    edge[hit + window] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[words.last] - covered[words.first]


def byte_counts(buf: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in words, and symbols, of each text of split_words."""

    def total(marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks, starts, dtype=np.int64)

    return total(inside & ((buf & 0xC0) != 0x80)), total(_IS_SYMBOL[buf])


def stats(raw: list[bytes]) -> Stats:
    """Statistics of whole texts given as UTF-8 bytes."""
    buf, starts, inside, words = split_words(raw)
    word_chars, n_symbols = byte_counts(buf, starts, inside)
    lines, repeats = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    spaces = SPACES.encode()
    for i, x in enumerate(raw):
        own = [line for line in x.split(b"\n") if line.strip(spaces)]
        lines[i], repeats[i] = len(own), len(own) - len(set(own))
    return Stats(
        np.array([len(x) for x in raw], np.int64),
        words.last - words.first,
        word_chars,
        n_symbols,
        lines,
        repeats,
        repeated_words(words),
        words,
    )
