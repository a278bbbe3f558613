"""Cutting texts into the runs of windows that share a minimizer.

A window is a string of `length` bytes. Its minimizer is the least hash of its k-byte strings.
Neighbouring windows with the same minimizer form a run; equal windows, wherever they are,
have the same minimizer, so runs of different minimizers hold no equal windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sluice.llm.text_stats import mix, powers

#: Bytes of the strings whose hashes are minimized.
GRAM = 96


@dataclass
class Runs:
    """Per run: the text it lies in, its first byte in the text, its windows, the minimizer, a hash of its bytes, and whether the minimizer stands in it twice."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    content: np.ndarray
    double: np.ndarray


def _sliding(x: np.ndarray, width: int, fold: np.ufunc, fill: int) -> np.ndarray:
    """fold over x[i : i + width] for each i; what lies beyond the end is `fill`."""
    n = len(x)
    padded = np.full(-(-(n + width) // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    behind = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[:n], ahead[width - 1 : n + width - 1])


def runs(raw: list[bytes], length: int, gram: int = GRAM) -> Runs:
    """The runs of all texts that have a window."""
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n, width = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length or (sizes < length).all():
        return Runs(none, none, none, none, none, np.zeros(0, bool))
    power, inverse = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    h = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    least = _sliding(h, width, np.minimum, 2**64 - 1)[: n - length + 1]
    text = np.repeat(np.arange(len(raw)), sizes)[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= ends[text]
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | change[1:]
    last = np.flatnonzero(stop)
    key = least[first]
    a, b = first, last + length
    content = mix(mix((total[b] - total[a]) * inverse[a]) + (b - a).astype(np.uint64))
    # Where a minimizer stands: the k-byte string whose hash some window's minimum equals.
    seen = np.zeros(len(h), np.uint64)
    seen[: len(least)] = np.where(valid, least, 0)
    back = _sliding(seen[::-1], width, np.maximum, 0)[::-1]
    at = np.flatnonzero(back == h)
    values, number = np.unique(np.concatenate([h[at], key]), return_inverse=True)
    place = np.sort(number[: len(at)] * np.int64(n) + at)
    own = number[len(at) :] * np.int64(n)
    twice = np.searchsorted(place, own + b - gram, "right") - np.searchsorted(place, own + a) > 1
    return Runs(text[first], first - begins[text[first]], last - first + 1, key.view(np.int64), content.view(np.int64), twice)
