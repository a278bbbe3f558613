"""Secret scans: fixed patterns, and a character Markov model for strings that look random.

Two order-2 character models are trained on labelled samples. Random strings: the secrets that the
fixed patterns mark in a bounded sample of the table's texts, and keys drawn over the usual
alphabets. Ordinary strings: all other words of those texts, and compound identifiers made of
them. The sample is of whole texts, chosen by hash over all rows, so no layout changes it. A token
of 20 or more key characters is a secret if its mean log-likelihood ratio a character is above a
threshold, which is set on held-out samples, made of words that the models have not seen, so that
none of the ordinary ones passes; tokens without digits have a threshold of their own. `measure` gives precision and recall on samples that the model has not seen.

Spans are code points of the text, end exclusive. A token that overlaps a span of a fixed
pattern is not reported again.

Defined results: null and empty texts have no spans (the digest is that of the empty string); very
long texts are scanned whole, in time in proportion to their length; spans of different kinds may
overlap, and all are given; repeated rows each get their own row; a null doc_id is kept; an empty
table gives an empty result; extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import map_arrow, sample_texts, slices

#: Patterns and least lengths: fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: What the Markov model judges.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Distinct texts of the table, read whole, and their bytes together, that train the models, and strings of either class.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_STRINGS = 300, 16_000_000, 4000
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
#: Common words that every table's sample is completed with, so that tiny tables train too.
_COMMON = (
    "get set user name value index list config service request response handler client server data model update create delete page item file path test build version time date number count total order event status message "
    "default public private static return import export string object array information application configuration international document documents organization management development environment authentication "
    "description available different government education experience university community technology performance relationship understanding transaction notification implementation registration generation "
    "first second third which there about would their other after between because through another without against during something everything language question picture system program process project product "
    "customer account payment address country history library science quality security network storage memory worker thread window button screen column table record schema source target output input filter search"
).split()
_CODE = np.full(128, 64, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _CODE[ord(_c)] = _i
_SYMBOLS = 65


def _pairs(token: str) -> tuple[np.ndarray, np.ndarray]:
    c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return c[:-2] * _SYMBOLS + c[1:-1], c[2:]


@dataclass
class Markov:
    """Log-likelihood ratio, random over ordinary, of each character after the two before it."""

    ratio: np.ndarray
    threshold: float = 0.0
    letters: float = 0.0

    def score(self, token: str) -> float:
        return float(self.ratio[_pairs(token)].mean())

    def is_secret(self, token: str) -> bool:
        return self.score(token) > (self.threshold if any(map(str.isdigit, token)) else self.letters)


def _log_model(strings: list[str]) -> np.ndarray:
    """log P(character | two before), smoothed by the probability after one, and that by 1 / symbols."""
    three = np.zeros((_SYMBOLS * _SYMBOLS, _SYMBOLS))
    for s in strings:
        if len(s) > 2:
            np.add.at(three, _pairs(s), 1)
    two = three.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).sum(0)
    p2 = (two + 1 / _SYMBOLS * 8) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 4 * np.tile(p2, (_SYMBOLS, 1))) / (three.sum(1, keepdims=True) + 4)
    return np.log(p3)


def samples(words: list[str], secrets: list[str] | None = None, seed: int = 11, n: int = SAMPLE_STRINGS) -> tuple[list[str], list[str]]:
    """Labelled strings: random ones with the given secrets, and identifiers made of ordinary words, with the long words themselves."""
    rng = random.Random(seed)
    positive = ["".join(rng.choices(_ALPHABETS[i % len(_ALPHABETS)], k=rng.randint(20, 64))) for i in range(n)] + (secrets or [])
    pool = sorted(set(words))
    negative = []
    for i in range(n):
        parts = [rng.choice(pool) for _ in range(rng.randint(3, 7))]
        style = i % 5
        if style == 0:
            made = "".join(p.capitalize() for p in parts)
        elif style == 1:
            made = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        else:
            made = ("_", "-", "/")[style - 2].join(p.upper() if style == 2 and i % 2 else p.lower() for p in parts)
        if i % 3 == 0:
            made += ("_", "-", "")[i % 9 // 3] + str(rng.randint(0, 2100))
        negative.append(made if len(made) >= 20 else made + "_" + "_".join(rng.choice(pool) for _ in range(4)))
    rng.shuffle(positive)
    return positive, negative


def train(words: list[str], secrets: list[str] | None = None) -> Markov:
    """Fit on the samples of four fifths of the words; the thresholds are above every ordinary string of the others."""
    own = sorted({w for w in words if w.isascii() and w.isalpha()} | set(_COMMON))
    seen, unseen = ([w for w in own if (zlib.crc32(w.lower().encode()) % 5 == 0) == held] for held in (False, True))
    positive, negative = samples(seen, secrets)
    # Single words too: what is ordinary within a word is so anywhere.
    model = Markov(_log_model(positive) - _log_model(negative + seen))
    _, fresh = samples(unseen, seed=12)
    numbered = [any(map(str.isdigit, x)) for x in fresh]
    model.threshold, model.letters = (max(0.3, max(model.score(x) for x, n in zip(fresh, numbered, strict=True) if n == digits) + 0.1) for digits in (True, False))
    return model


def measure(model: Markov, positive: list[str], negative: list[str]) -> tuple[float, float]:
    """Precision and recall of the model on labelled strings; both 1 where nothing is asked for."""
    hit, false = sum(map(model.is_secret, positive)), sum(map(model.is_secret, negative))
    return (hit / (hit + false) if hit + false else 1.0), (hit / len(positive) if positive else 1.0)


def labelled_words(texts: list[str]) -> tuple[list[str], list[str]]:
    """(ordinary words, secrets) of texts: key characters within the fixed patterns' spans, and words outside of them."""
    ordinary: set[str] = set()
    secrets: set[str] = set()
    for text in texts:
        done = 0
        for a, kind, b in base_spans(text):
            value = ASSIGN.search(text, a).group(2) if kind == 0 else text[a:b]
            if len(value) >= 16:
                secrets.add(value.replace(".", "-"))
            ordinary.update(re.findall(r"\b[A-Za-z]{2,}\b", text[done:a]))
            done = max(done, b)
        ordinary.update(re.findall(r"\b[A-Za-z]{2,}\b", text[done:]))
    return sorted(ordinary), sorted(secrets)


def fitted(docs: DataFrame, text: str = "text") -> Markov:
    """The model of a table."""
    return train(*labelled_words(sample_texts(docs, text, SAMPLE_ROWS, SAMPLE_BYTES)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]], model: Markov) -> list[tuple[int, int, int]]:
    """The base spans and those of random tokens that overlap none of them."""
    more, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        # Spans that begin before the token's end reach into it, or end before it.
        if reach <= a and model.is_secret(m.group()):
            more.append((a, 3, b))
    return sorted(base + more)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: Markov | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, spans of each fixed kind, the digest of the base spans, and all spans."""
    found = model or fitted(docs, text)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for t in batch.column(1).to_pylist():
            base = base_spans(t) if t else []
            every = all_spans(t, base, found) if t else []
            n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(docs.select(docs[doc_id].cast("long").alias("doc_id"), text), run, schema)


def redact(docs: DataFrame, model: Markov | None = None, text: str = "text") -> DataFrame:
    """The rows with every span of their text replaced by its kind in angle brackets; nothing else changes."""
    found = model or fitted(docs, text)
    names = docs.columns
    at = names.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        spans = all_spans(t, base_spans(t), found)
        if not spans:
            return t
        out, done = [], 0
        for a, k, b in spans:
            if a >= done:
                out += [t[done:a], f"<{KINDS[k]}>"]
            done = max(done, b)
        return "".join([*out, t[done:]])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, at):
            columns = list(part.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, run, docs.schema)
