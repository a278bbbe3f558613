"""Suffix and LCP arrays by induced sorting with disk-backed priority queues.

The scheme of induced sorting: suffixes are of type S (smaller than the one behind them) or L.
Sorted leftmost-S suffixes induce all L suffixes in one ascending pass, and these all S
suffixes in one descending pass. The leftmost-S suffixes themselves are sorted by recursion on
the string of the ranks of the pieces between them. Both passes are driven by a monotone
priority queue: a tuple (character, arrival, position, common prefix) waits for its character's
turn. The queue is a row of buckets of neighbouring characters; whenever the waiting tuples exceed the memory
budget, all of them are written to one run file in the scratch folder, bucket by bucket, and a
bucket's part of each run is read back when the bucket's turn comes.
Tuples are taken in blocks: the longest prefix of the waiting tuples that no tuple induced by
them can come before is handled in one array step.

Common-prefix values travel with the tuples: two neighbours in a character's order were
induced by two suffixes seen before, and share one character more than the least common prefix
in between. The minimum since the last tuple of each character is kept, so values need no look
at the text; only neighbouring leftmost-S suffixes are compared directly. Values are cut off at
`cap`.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs

from sluice.llm.text_stats import mix, powers

#: Bytes of waiting tuples held in memory by one queue (12 a tuple), and tuples in one step.
BUDGET, STEP = 4 << 20, 1 << 15
#: Alphabets up to this size have a bucket for each character.
SMALL = 512
#: Symbols of a piece that are compared as packed words; longer pieces are sorted by induction.
PACKED = 24
SHORT = 1 << 10
#: Strings of ranks up to this length are sorted in memory, longer ones by recursion.
BASE = 1 << 18
#: Waiting tuples in one bucket of a queue over a large alphabet: at least so many, else the root of all.
BUCKET = 64
_FAR = np.int32(2**31 - 1)


@dataclass
class Scratch:
    """Where queues write their runs (a URI of a folder that all executors share; None: they hold all in memory), the memory budget of each, and counts of what was done."""

    uri: str | None = None
    budget: int = BUDGET
    done: Counter = field(default_factory=Counter)

    def open(self) -> tuple[fs.FileSystem, str] | None:
        """The file system and folder, or None where this process cannot write there: shards are of bounded size, so that holding their tuples is safe."""
        if self.uri is None:
            return None
        try:
            return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri.removeprefix('file:')}")
        except (OSError, ValueError, ImportError):
            return None


class Queue:
    """A monotone priority queue of tuples (key, position, value); equal keys leave in order of arrival."""

    def __init__(self, keys: int, width: int, scratch: Scratch):
        self.width = width
        self.held: list[list[np.ndarray]] = [[] for _ in range(-(-keys // width))]
        self.scratch, self.bytes, self.place = scratch, 0, scratch.open()
        # Of each run its file and where each bucket begins in it.
        self.runs: list[tuple[str, fs.NativeFile, np.ndarray]] = []

    def push(self, key: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        if not len(key):
            return
        bucket = (key // self.width if self.width > 1 else key).astype(np.uint16 if len(self.held) < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = np.empty((3, len(key)), np.int32)
        for row, column in zip(rows, (key, pos, value), strict=True):
            row[:] = column[order]
        bucket = bucket[order]
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self.held[bucket[a]].append(rows[:, a:b])
        self.bytes += rows.nbytes
        if self.place and self.bytes > self.scratch.budget:
            self._spill()

    def _spill(self) -> None:
        system, folder = self.place
        path = f"{folder}/run-{uuid.uuid4().hex}"
        ends = np.zeros(len(self.held) + 1, np.int64)
        with system.open_output_stream(path) as f:
            for i, parts in enumerate(self.held):
                ends[i + 1] = ends[i]
                if parts:
                    data = np.ascontiguousarray(np.concatenate(parts, 1).T)
                    f.write(data.data)
                    ends[i + 1] += data.nbytes
                    parts.clear()
        self.runs.append((path, system.open_input_file(path), ends))
        self.scratch.done["spills"] += 1
        self.scratch.done["spilled"] += int(ends[-1])
        self.bytes = 0

    def take(self, bucket: int) -> np.ndarray:
        """All tuples of a bucket, by key."""
        parts = self.held[bucket]
        self.held[bucket] = []
        self.bytes -= sum(p.nbytes for p in parts)
        spilled = []
        for _, f, ends in self.runs:
            if size := int(ends[bucket + 1] - ends[bucket]):
                f.seek(int(ends[bucket]))
                spilled.append(np.frombuffer(f.read(size), np.int32).reshape(-1, 3).T)
        parts = [*spilled, *parts]
        rows = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int32)
        return rows if self.width == 1 else rows[:, np.argsort(rows[0], kind="stable")]

    def close(self) -> None:
        for path, f, _ in self.runs:
            f.close()
            self.place[0].delete_file(path)
        self.runs = []


class _Minima:
    """For each character the least value since its last tuple."""

    def __init__(self, keys: int):
        self.since = np.full(keys, _FAR, np.int32)

    def step(self, value: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Values of the items of a step; at and target: the items that induce, and for which character. The least value since that character's last tuple."""
        table = [value]
        while (1 << len(table)) <= len(value):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        order = np.argsort(target, kind="stable")
        t, q = target[order], at[order]
        first = np.diff(t, prepend=-1) != 0
        start = np.where(first, 0, np.append(0, q[:-1] + 1))
        size = q - start + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        least = np.empty(len(q), np.int32)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            least[i] = np.minimum(table[k][start[i]], table[k][q[i] + 1 - (1 << k)])
        least[first] = np.minimum(least[first], self.since[t[first]])
        self.since = np.minimum(self.since, value.min())
        last = np.flatnonzero(np.diff(t, append=-1) != 0)
        tail = np.append(np.minimum.accumulate(value[::-1])[::-1], _FAR)
        self.since[t[last]] = tail[q[last] + 1]
        out = np.empty(len(q), np.int32)
        out[order] = least
        return out


class _Text:
    """A string of integers with the types of its suffixes."""

    def __init__(self, text: np.ndarray):
        if 2 * max(len(text), int(text.max(initial=0)) + 1) >= 2**31:
            raise ValueError("a string to sort has fewer than 2**30 characters")
        self.text, n = text.astype(np.int32), len(text)
        text = self.text
        differs = np.append(text[:-1] != text[1:], True)
        following = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
        self.turn = np.minimum.accumulate(following[::-1])[::-1]
        smaller = np.append(text[:-1] < text[1:], False)
        self.is_s = smaller[self.turn]
        self.lms = (np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1).astype(np.int32)
        self.sigma = int(text.max(initial=0)) + 1

    def run(self, pos: np.ndarray) -> np.ndarray:
        """Equal characters from a position on."""
        return self.turn[pos] - pos + 1


def _induce(t: _Text, seeds: np.ndarray, seed_values: np.ndarray | None, up: bool, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the induced suffixes in order of the pass, and each one's common prefix with the one before it.

    Ascending passes induce L suffixes from leftmost-S seeds, descending ones S suffixes from L
    seeds; seeds are given in order of the pass and follow the induced suffixes of their
    character. Without seed_values, common prefixes are not carried.
    """
    text, n, carry = t.text, len(t.text), seed_values is not None
    sigma, goal = t.sigma, not up
    keys = text if up else sigma - 1 - text
    # Key and type of each position in one word; the last entry, which position -1 reads, is of neither type.
    packed = np.append(4 * keys + np.where(t.is_s == goal, 1, 0).astype(np.int32), np.int32(0))
    if sigma <= SMALL:
        return _induce_small(t, keys, packed, seeds, seed_values, up, cap, scratch)

    width = max(1, -(-sigma * max(BUCKET, math.isqrt(n)) // max(n, 1)))
    queue = Queue(sigma, width, scratch)
    minima = _Minima(sigma) if carry else None
    seed_keys = keys[seeds]
    edges = np.searchsorted(seed_keys, np.arange(len(queue.held) + 1) * width)
    out_pos, out_value = [], []
    if up and n:
        queue.push(keys[n - 1 :], np.array([n - 1]), np.zeros(1, np.int32))
    before = (-1, -1)  # key and position of the item before
    try:
        for bucket in range(len(queue.held)):
            rows = queue.take(bucket)
            a, b = edges[bucket], edges[bucket + 1]
            rows[0] *= 2
            if b > a:
                mine = np.zeros((3, b - a), np.int32)
                mine[0], mine[1] = 2 * seed_keys[a:b] + 1, seeds[a:b]
                if carry:
                    mine[2] = seed_values[a:b]
                rows = np.concatenate([rows, mine], 1)
                if width > 1:
                    rows = rows[:, np.argsort(rows[0], kind="stable")]
            while rows.shape[1]:
                head = rows[:, :STEP]
                prior = head[1] - 1
                both = packed[prior]
                good, target = both & 1 == 1, both >> 2
                near = good & ((target // width if width > 1 else target) == bucket)
                some = near.any()
                if some:
                    # No tuple may be taken before one that is induced here and belongs in front of it.
                    limit = np.minimum.accumulate(np.where(near, 2 * target, _FAR))
                    over = np.flatnonzero(head[0][1:] > limit[:-1])
                    if len(over):
                        cut = int(over[0]) + 1
                        head, prior, good, target, near = head[:, :cut], prior[:cut], good[:cut], target[:cut], near[:cut]
                        some = near.any()
                cut = head.shape[1]
                value = head[2]
                if carry:
                    value = value.copy()
                    ahead_key = np.append(before[0], head[0][:-1])
                    ahead_pos = np.append(before[1], head[1][:-1])
                    fresh = ahead_key >> 1 != head[0] >> 1
                    value[fresh] = 0
                    # The first seed of a character after induced suffixes: they share the shorter run of that character.
                    joint = np.flatnonzero(~fresh & (head[0] & 1 == 1) & (ahead_key & 1 == 0))
                    value[joint] = np.minimum(t.run(head[1][joint]), t.run(ahead_pos[joint]))
                    value = np.minimum(value, cap)
                    before = (head[0][-1], head[1][-1])
                at = np.flatnonzero(good)
                if carry:
                    shared = minima.step(value, at, target[at]) if len(at) else np.zeros(0, np.int64)
                    if not len(at):
                        minima.since = np.minimum(minima.since, value.min())
                    fill = np.minimum(shared + 1, cap)
                else:
                    fill = np.zeros(len(at), np.int32)
                induced = head[0] & 1 == 0
                out_pos.append(head[1][induced])
                if carry:
                    out_value.append(value[induced])
                rows = rows[:, cut:]
                target, prior = target[at], prior[at]
                if not some:
                    queue.push(target, prior, fill)
                    continue
                inside = near[at]
                queue.push(target[~inside], prior[~inside], fill[~inside])
                more = np.empty((3, int(inside.sum())), np.int32)
                more[0], more[1], more[2] = 2 * target[inside], prior[inside], fill[inside]
                rows = np.concatenate([rows, more], 1)
                rows = rows[:, np.argsort(rows[0], kind="stable")]
    finally:
        queue.close()
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *out_pos]), np.concatenate([empty, *out_value])


def _induce_small(t: _Text, keys: np.ndarray, packed: np.ndarray, seeds: np.ndarray, seed_values: np.ndarray | None, up: bool, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The pass over a small alphabet: within a character, suffixes are taken in order of arrival, then its seeds."""
    n, sigma, carry = len(t.text), t.sigma, seed_values is not None
    queue, minima = Queue(sigma, 1, scratch), _Minima(sigma)
    edges = np.searchsorted(keys[seeds], np.arange(sigma + 1))
    out_pos, out_value = [], []
    zero = np.zeros(0, np.int32)
    if up and n:
        queue.push(keys[n - 1 :], np.array([n - 1]), np.zeros(1, np.int32))

    def take(pos: np.ndarray, value: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Induce from suffixes of one character; what falls into the same character comes back."""
        prior = pos - 1
        both = packed[prior]
        at = np.flatnonzero(both & 1)
        target, prior = both[at] >> 2, prior[at]
        if not carry:
            fill = np.zeros(len(at), np.int32)
        elif len(at):
            fill = np.minimum(minima.step(value, at, target) + 1, cap)
        else:
            minima.since = np.minimum(minima.since, value.min())
            fill = zero
        near = target == bucket
        if not near.any():
            queue.push(target, prior, fill)
            return zero, zero
        queue.push(target[~near], prior[~near], fill[~near])
        return prior[near], fill[near]

    try:
        for bucket in range(sigma):
            rows = queue.take(bucket)
            pos, value = rows[1], rows[2]
            last = -1
            while len(pos):
                more = []
                for at in range(0, len(pos), STEP):
                    p, v = pos[at : at + STEP], value[at : at + STEP]
                    if last < 0:
                        v = v.copy()
                        v[0] = 0  # the first suffix of its character
                    out_pos.append(p)
                    out_value.append(v)
                    last = p[-1]
                    more.append(take(p, v, bucket))
                pos, value = (np.concatenate(x) for x in zip(*more, strict=True))
            a, b = edges[bucket], edges[bucket + 1]
            for at in range(a, b, STEP):
                p = seeds[at : min(at + STEP, b)]
                v = zero
                if carry:
                    v = seed_values[at : at + len(p)].astype(np.int32)
                    if at == a:
                        # Behind induced suffixes: they share the shorter run of the character.
                        v[0] = 0 if last < 0 else min(t.run(p[0]), t.run(last), cap)
                take(p, v, bucket)
    finally:
        queue.close()
    return np.concatenate([zero, *out_pos]), np.concatenate([zero, *out_value])


def _merged(t: _Text, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Order of the L suffixes (ascending), then of the S suffixes (ascending), within each character."""
    key = np.concatenate([2 * t.text[low], 2 * t.text[high] + 1])
    return np.argsort(key, kind="stable")


def _ranked_packed(t: _Text, size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces (from one leftmost-S position to the next, included) in order, and each one's rank: tuples of packed symbols are sorted.

    A symbol is a character and its type, L before S, so that no piece is the beginning of another.
    """
    bits = max(1, int(2 * t.sigma + 2).bit_length())
    per = 63 // bits
    symbol = np.append(2 * t.text.astype(np.int64) + t.is_s + 2, np.zeros(longest + per, np.int64))
    words = []
    for first in range(0, longest, per):
        word = np.zeros(len(t.lms), np.int64)
        for k in range(first, first + per):
            word = (word << bits) | np.where(k < size, symbol[t.lms + k], 0)
        words.append(word)
    piece = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0], kind="stable")
    fresh = np.zeros(len(piece), bool)
    fresh[0] = True
    for word in words:
        w = word[piece]
        fresh[1:] |= w[1:] != w[:-1]
    return piece, np.cumsum(fresh) - 1


def _ranked_induced(t: _Text, stop: np.ndarray, size: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The same by induction from the unsorted pieces; pieces are compared by a hash of their characters."""
    lms = t.lms
    by_first = lms[np.argsort(t.text[lms], kind="stable")]
    low, _ = _induce(t, by_first, None, True, 0, scratch)
    high, _ = _induce(t, low[::-1], None, False, 0, scratch)
    number = np.full(len(t.text), -1, np.int64)
    number[lms] = np.arange(len(lms))
    piece = number[high[::-1]]
    piece = piece[piece >= 0]
    power, inverse = powers(len(t.text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t.text.astype(np.uint64) + np.uint64(1)) * power[: len(t.text)], dtype=np.uint64)])
    content = mix((total[np.minimum(stop, len(t.text))] - total[lms]) * inverse[lms])
    fresh = np.append(True, (content[piece[1:]] != content[piece[:-1]]) | (size[piece[1:]] != size[piece[:-1]]))
    return piece, np.cumsum(fresh) - 1


def _sorted_lms(t: _Text, scratch: Scratch) -> np.ndarray:
    """The leftmost-S suffixes in order: by recursion on the ranks of the pieces between them."""
    lms = t.lms
    if len(lms) < 2:
        return lms
    stop = np.append(lms[1:] + 1, len(t.text) + 1).astype(np.int64)
    size = stop - lms
    if (long := size.max()) <= PACKED or len(lms) < SHORT:
        piece, rank = _ranked_packed(t, size, int(long))
    else:
        piece, rank = _ranked_induced(t, stop, size, scratch)
    order = lms[piece]
    if rank[-1] == len(lms) - 1:
        return order
    names = np.empty(len(lms), np.int64)
    names[piece] = rank
    if len(names) <= BASE:
        return lms[_doubled(names)]
    scratch.done["recursions"] += 1
    return lms[suffix_array(names, scratch)]


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Suffixes of a short string in order, by doubling the compared length: the recursion's base, in memory."""
    n, size = len(rank), 1
    while True:
        key = rank * np.int64(n + 1)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key)
        fresh = np.append(False, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        size *= 2


def suffix_array(text: np.ndarray, scratch: Scratch | None = None) -> np.ndarray:
    """Positions of all suffixes in order; the end of the text is smaller than any character."""
    scratch = scratch or Scratch()
    t = _Text(text)
    low, _ = _induce(t, _sorted_lms(t, scratch), None, True, 0, scratch)
    high, _ = _induce(t, low[::-1], None, False, 0, scratch)
    both = np.concatenate([low, high[::-1]])
    return both[_merged(t, low, high[::-1])]


def _compared(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of different suffixes, by comparison of words of several characters, up to cap."""
    n, out = len(text), np.zeros(len(a), np.int64)
    bits = max(1, int(text.max(initial=0)).bit_length())
    per = 63 // bits
    padded = np.append(text.astype(np.int64), np.zeros(per, np.int64))
    word = np.zeros(n, np.int64)
    for k in range(per):
        word |= padded[k : k + n] << (bits * k)
    # What the longer suffix has beyond the other's end, where words are padded, does not count.
    most = np.minimum(n - np.maximum(a, b).astype(np.int64), cap)
    alive = np.flatnonzero(most > 0)
    for k in range(0, cap, per):
        differ = word[a[alive] + k] ^ word[b[alive] + k]
        apart = np.flatnonzero(differ)
        lowest = differ[apart] & -differ[apart]
        out[alive[apart]] = k + (np.frexp(lowest.astype(np.float64))[1] - 1) // bits
        alive = alive[differ == 0]
        out[alive] = k + per
        alive = alive[most[alive] > k + per]
        if not len(alive):
            break
    return np.minimum(out, most)


def suffix_and_lcp(text: np.ndarray, cap: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and each suffix's common prefix with the one before it, up to cap."""
    scratch = scratch or Scratch()
    t = _Text(text)
    lms = _sorted_lms(t, scratch)
    values = np.append(0, _compared(text, lms[:-1], lms[1:], cap)) if len(lms) else np.zeros(0, np.int64)
    low, low_lcp = _induce(t, lms, values, True, cap, scratch)
    # Descending, an L suffix follows the next greater one.
    down = np.append(low_lcp[1:], 0)[::-1] if len(low) else low_lcp
    high, high_lcp = _induce(t, low[::-1], down, False, cap, scratch)
    # Ascending again: each S suffix has the value of the next smaller one.
    s, s_lcp = high[::-1], np.append(0, high_lcp[::-1][:-1]) if len(high) else high_lcp
    both, lcp = np.concatenate([low, s]), np.concatenate([low_lcp, s_lcp])
    order = _merged(t, low, s)
    both, lcp = both[order], lcp[order]
    # Where a character's S suffixes follow its L suffixes, they share the shorter run; a new character shares nothing.
    c = text[both]
    change = np.append(True, c[1:] != c[:-1])
    joint = np.flatnonzero(~change & t.is_s[both] & np.append(False, ~t.is_s[both][:-1]))
    lcp[joint] = np.minimum(np.minimum(t.run(both[joint]), t.run(both[joint - 1])), cap)
    lcp[change] = 0
    return both, lcp


def repeated_windows(text: np.ndarray, left: np.ndarray, length: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows (positions with at least `length` characters of their string left) in suffix order, a class number each, and whether the class has another member.

    Strings are separated by a character that no window holds, so a common prefix of `length` is inside both strings.
    """
    sa, lcp = suffix_and_lcp(text, length, scratch)
    group = np.cumsum(lcp < length)
    window = left[sa] >= length
    sa, group = sa[window], group[window]
    if not len(sa):
        return sa, group, np.zeros(0, bool)
    size = np.bincount(group)
    return sa, group, size[group] > 1


def blocks(pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pieces end to end, each followed by 0, as integers from 1 on, and how many characters of its piece each position has left."""
    sizes = np.array([len(p) + 1 for p in pieces])
    joined = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    joined[ends - 1] = 0
    left = np.repeat(ends - 1, sizes) - np.arange(len(joined))
    yield joined, left
