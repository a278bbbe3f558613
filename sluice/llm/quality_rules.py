"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a pure predicate of one text, so the verdict (all rules hold) does not depend on
their order; the order only decides how much work rejected texts cost. Costs and selectivities are
estimated on a bounded sample of whole texts, chosen by hash over all rows: the cost of a rule is
the work that it does on a text (bytes, words and lines visited, weighed by what a visit takes), not
a clock's reading, so every run gives the same order. Rules are picked one by one, each time the one
with the most rejections per cost among the sample's texts that passed the rules before it.

Statistics are made when a rule first asks for them, only of the texts that are still in play: a
text that a cheap rule rejects costs no windows, lines or compression. `judge` reports the base
counts of every text, so there only the further rules are short-circuited.

Defined results: a null or empty text has no words and fails the base rules; very long texts are
judged whole; repeated rows each get their own row; a null doc_id is kept; ties in the order of
rules go by name; an empty table gives an empty result; extra columns are ignored by `judge` and
kept by `keep`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import SPACES, chunks, map_arrow, sample_texts
from sluice.llm.text_stats import Words, byte_counts, repeated_words, split_words

#: Texts of the sample that orders the rules, and their bytes together.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 16_000_000


class View:
    """The texts of a chunk as bytes, with statistics that are made for the texts that are asked for."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.size = np.array([len(x) for x in raw], np.int64)
        self.buf, self.starts, self.inside, self.words = split_words(raw)
        self.n_words = self.words.last - self.words.first
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _lines(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lines, repeats = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        spaces = SPACES.encode()
        for k, i in enumerate(at.tolist()):
            own = [line for line in self.raw[i].split(b"\n") if line.strip(spaces)]
            lines[k], repeats[k] = len(own), len(own) - len(set(own))
        return lines, repeats

    def _repeats(self, at: np.ndarray) -> tuple[np.ndarray]:
        n = self.n_words[at]
        last = np.cumsum(n)
        hashes = np.concatenate([np.zeros(0, np.uint64), *[self.words.hashes[self.words.first[i] : self.words.last[i]] for i in at]])
        return (repeated_words(Words(hashes, last - n, last)),)

    def count(self, name: str, at: np.ndarray) -> np.ndarray:
        """n_lines, n_dup_lines, n_repeat_words, word_chars or n_symbols of the texts at the given positions."""
        made = {"n_lines": ("n_lines", "n_dup_lines"), "n_dup_lines": ("n_lines", "n_dup_lines"), "n_repeat_words": ("n_repeat_words",)}.get(name, ("word_chars", "n_symbols"))
        for each in made:
            self._known.setdefault(each, (np.zeros(len(self.raw), np.int64), np.zeros(len(self.raw), bool)))
        new = at[~self._known[name][1][at]]
        if len(new):
            if name in ("word_chars", "n_symbols"):
                new = np.arange(len(self.raw))
                found = byte_counts(self.buf, self.starts, self.inside)
            else:
                found = self._repeats(new) if name == "n_repeat_words" else self._lines(new)
            for each, values in zip(made, found, strict=True):
                self._known[each][0][new] = values
                self._known[each][1][new] = True
        return self._known[name][0][at]


@dataclass(frozen=True)
class Rule:
    """A name, a predicate (which of the texts at the given positions pass), and the work that it does on each."""

    name: str
    passes: Callable[[View, np.ndarray], np.ndarray]
    work: Callable[[View, np.ndarray], np.ndarray]


_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _each(view: View, at: np.ndarray, count: Callable[[bytes, np.ndarray], float]) -> np.ndarray:
    words = view.words
    return np.fromiter((count(view.raw[i], words.hashes[words.first[i] : words.last[i]]) for i in at), np.float64, len(at))


def _upper(raw: bytes, _: np.ndarray) -> float:
    return len(raw) - len(raw.translate(None, _UPPER))


def _most_common(_: bytes, words: np.ndarray) -> float:
    return np.unique(words, return_counts=True)[1].max(initial=0)


def _stutter(_: bytes, words: np.ndarray) -> float:
    return np.count_nonzero(words[1:] == words[:-1])


def _compressed(raw: bytes, _: np.ndarray) -> float:
    return len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 512 else 1


def _mean_word(view: View, at: np.ndarray) -> np.ndarray:
    mean = view.count("word_chars", at) / np.maximum(view.n_words[at], 1)
    return (mean >= 2) & (mean <= 16)


def _bytes(each: float) -> Callable[[View, np.ndarray], np.ndarray]:
    return lambda v, at: 20 + each * v.size[at]


def _words(each: float) -> Callable[[View, np.ndarray], np.ndarray]:
    return lambda v, at: 20 + each * v.n_words[at]


#: Fewer than 20 words, and over 30 % of the words in repeated windows of 8: fixed by the contract.
BASE = (
    Rule("few_words", lambda v, at: v.n_words[at] >= 20, lambda v, at: np.ones(len(at))),
    Rule("repeated_words", lambda v, at: 100 * v.count("n_repeat_words", at) <= 30 * v.n_words[at], _words(40)),
)
#: The further rules, in no particular order.
RULES = (
    Rule("symbol_density", lambda v, at: v.count("n_symbols", at) <= 0.2 * v.n_words[at], _bytes(0.5)),
    Rule("duplicate_lines", lambda v, at: v.count("n_dup_lines", at) <= 0.6 * np.maximum(v.count("n_lines", at), 1), _bytes(1)),
    Rule("mean_word_length", _mean_word, _bytes(0.5)),
    Rule("upper_case", lambda v, at: _each(v, at, _upper) <= 0.4 * v.count("word_chars", at), _bytes(0.5)),
    Rule("exclamation_marks", lambda v, at: _each(v, at, lambda raw, _: raw.count(b"!")) <= 0.3 * v.n_words[at], _bytes(0.2)),
    Rule("one_word", lambda v, at: _each(v, at, _most_common) <= 0.35 * v.n_words[at], _words(30)),
    Rule("stutter", lambda v, at: _each(v, at, _stutter) <= 0.3 * v.n_words[at], _words(2)),
    Rule("compressibility", lambda v, at: _each(v, at, _compressed) >= 0.12, _bytes(20)),
)


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES, first: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejections per work on the sample's texts that passed `first` and the rules before them; ties by name."""
    view = View([t.encode("utf-8", "surrogatepass") for t in texts]) if texts else None
    at = np.arange(len(texts))
    for rule in first:
        at = at[rule.passes(view, at)] if len(at) else at
    left, out = sorted(rules, key=lambda r: r.name), []
    while left and len(at):
        gain = [np.count_nonzero(~r.passes(view, at)) / math.fsum(r.work(view, at)) for r in left]
        best = left.pop(int(np.argmax(gain)))
        out.append(best)
        at = at[best.passes(view, at)]
    return (*out, *left)


def cascade(view: View, at: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text the number of rules it passed before one rejected it (all: it passes)."""
    passed = np.zeros(len(view.raw), np.int64)
    for rule in rules:
        if not len(at):
            break
        at = at[rule.passes(view, at)]
        passed[at] += 1
    return passed


def _look(texts: list[str | None]) -> View:
    return View([(t or "").encode("utf-8", "surrogatepass") for t in texts])


def _sample(docs: DataFrame, text: str) -> list[str]:
    return sample_texts(docs, text, SAMPLE_ROWS, SAMPLE_BYTES)


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the rule that rejected it (null: none)."""
    ordered = order_rules(_sample(docs, text), RULES, BASE) if rules is None else rules
    counts = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"doc_id long, n_words long, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, rejected_by string"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, every = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(every):
            view, at = _look(every[a:b]), np.arange(b - a)
            base = [view.count(c, at) for c in counts]
            failed = cascade(view, at, BASE) < len(BASE)
            passed = cascade(view, np.flatnonzero(~failed), ordered)
            names = np.array([r.name for r in ordered] + [None], object)[passed]
            names[failed] = "base"
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), *(pa.array(x) for x in (view.n_words, *base, failed, ~failed & (passed == len(ordered)))), pa.array(names, pa.string())],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return map_arrow(docs.select(docs[doc_id].cast("long").alias("doc_id"), text), run, schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
    """The rows whose text passes the base rules and all others, with all their columns."""
    ordered = order_rules(_sample(docs, text), (*BASE, *RULES)) if rules is None else (*BASE, *rules)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = batch.column(at).to_pylist()
        for a, b in chunks(every):
            view = _look(every[a:b])
            good = cascade(view, np.arange(b - a), ordered) == len(ordered)
            yield batch.slice(a, b - a).filter(pa.array(good))

    return map_arrow(docs, run, docs.schema)
