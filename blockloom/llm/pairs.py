"""Defective question and answer pairs: empty, refused, copied, in another language or truncated answers.

A multi-label linear classifier (one logistic regression a label) works on hashed character n-grams and words of the
answer, on its end, and on features of the pair: predicted against real length, sentences and lines on both sides, how
much of the answer stands in the source, scripts, and the language by profiles of character n-grams.  It is trained on a
bounded sample of the corpus and on synthetically refused, swapped, copied and truncated answers to it, and on sound
English of other wording and garbled answers as examples of none; a threshold for each label is calibrated on held-out
rows.  The first defect in the order of DEFECTS counts.

Defined results: null and invisible answers are 'empty'; rows whose source holds no Japanese or is null have no defect;
where more than 5 % of the source's characters are garbled or rare (class 'odd') it can't tell what the answer must cover,
and only an answer that breaks off by itself is 'truncated'; repeated rows get a row each; texts of any length are read
whole; an empty table, or one without a usable sample, gives only empty answers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import pair_synthesis as synthesis
from blockloom.llm.arrow_text import code_points, hash_runs, pieces, row_numbers, row_sums
from blockloom.llm.ngrams import gram_keys
from blockloom.llm.scan_noise import line_kinds
from blockloom.llm.unify import INVISIBLE, LATIN_LOOKS, SPACES

DEFECTS = ("empty", "refusal", "copied", "other_language", "truncated")
LABELS = DEFECTS[1:]
#: Rows of the corpus the classifier may be fitted on, at most.
SAMPLE = 8000
#: Times the sample that the bound on the hash leaves; rows without Japanese or answer go after it.
SPARE = 3
#: How far below the calibrated threshold a score may lie where an exact check follows.
LENIENT = {"refusal": 0.3, "copied": 0.0, "other_language": 0.5, "truncated": 0.0}
#: Share of the sample, the most suspicious by each label, that is no example of sound rows when it is fitted anew.
DOUBT = 0.03
#: Weight of a sound example against a synthetic defect.
SOUND = 4.0
#: Price of a false defect against that of a missed one when thresholds are calibrated: about sound rows per defect.
COST = {"refusal": 60.0, "copied": 60.0, "other_language": 60.0, "truncated": 300.0}
#: Mean log ratio from which an answer is clearly English, and below which it isn't English.
CLEAR, FOREIGN = 0.4, 0.15
#: How far below its threshold an answer may lie that is plainly foreign.
PLAINLY = 4.0
#: Least score at which a label may be calibrated.
LEAST = {"refusal": 0.0, "copied": -1.5, "other_language": -1.0, "truncated": -1.5}
EPOCHS, BATCH, RATE, DECAY = (2, 6), 256, 0.3, 1e-6
_WORD, _GRAM, _TAIL, _BINS, _LENGTH = 16, 16, 17, 12, 16
LENGTH_ORDERS = (1, 3, 5)
_AT_GRAM = 1 << _WORD
_AT_TAIL = _AT_GRAM + (1 << _GRAM)
_AT_BINS = _AT_TAIL + (1 << _TAIL)
SIZE = _AT_BINS + (1 << _BINS)

_ranges = {
    "kana": ((0x3041, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)),
    "han": ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x3005, 0x3008)),
    "hangul": ((0xAC00, 0xD7B0), (0x1100, 0x1200)),
    "cyrillic": ((0x0400, 0x0530),),
    "latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)),
    "accent": ((0xC0, 0x250),),
    "digit": ((0x30, 0x3A),),
    "sign": ((0x80, 0xA0), (0x2C6, 0x2DD), (0x201A, 0x201B), (0x201E, 0x2020), (0x20AC, 0x20AD), (0xFF61, 0xFFA0), (0xFFFD, 0xFFFE)),
    "odd": ((0x80, 0xA0), (0xA1, 0xA9), (0xAA, 0xAE), (0xB4, 0xD7), (0xD8, 0x250), (0x370, 0x530), (0x2013, 0x2018), (0x201A, 0x201C), (0x201E, 0x203B), (0xE000, 0xF900), (0xFF61, 0xFFA0), (0xFFFD, 0xFFFE)),
}


DIVIDED_LINE = re.compile("(?<=[A-Za-z])[-‐‑¬\xad][ 　]*\n")


def _tables() -> dict[str, np.ndarray]:
    out = {}
    for name, spans in _ranges.items():
        flag = np.zeros(0x10001, dtype=bool)
        for lo, hi in spans:
            flag[lo:hi] = True
        out[name] = flag
    fold = np.arange(0x10001, dtype=np.uint32)
    fold[0xFF01:0xFF5F] -= 0xFEE0
    for ch, latin in LATIN_LOOKS.items():
        fold[ord(ch)] = ord(latin)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "a" for c in range(0x10000))
    for m in re.finditer(f"[{SPACES}]", every):
        fold[m.start()] = 0x20
    out["fold"] = fold
    gone = np.zeros(0x10001, dtype=bool)
    gone[[m.start() for m in re.finditer(f"[{INVISIBLE}]", every)]] = True
    out["gone"] = gone
    out["letter"] = np.array([c.isalpha() for c in every] + [False])
    return out


TABLES = _tables()


@dataclass
class Side:
    """One side of pairs: folded code points, offsets, row of each, and the kinds of characters."""

    points: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        self.kept: dict[str, object] = {}  # what several features and checks ask for
        self.low = np.minimum(self.points, 0x10000)
        self.size = np.diff(self.offsets)
        self.rows = row_numbers(self.offsets)

    def once(self, name: str, make: Callable[[], object]):
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def share(self, kind: str) -> np.ndarray:
        return self.once(kind, lambda: row_sums(TABLES[kind][self.low].astype(np.int64), self.offsets))


def fold(column: pa.Array) -> Side:
    """Width, spaces and look-alikes unified (a value with Cyrillic only keeps it), invisible characters dropped, trimmed."""
    points, offsets = code_points(column)
    low = np.minimum(points, 0x10000)
    own = TABLES["cyrillic"][low] & (TABLES["fold"][low] == low)  # letters without a look-alike
    foreign = row_sums(own.astype(np.int64), offsets) > 0
    looks = (low >= 0x370) & (low < 0x590)
    rows = row_numbers(offsets)
    out = np.where((points < 0x10000) & ~(looks & foreign[rows]), TABLES["fold"][low], points)
    keep = ~TABLES["gone"][low]
    blank = (out == 0x20) | (out == 0x0A) | (out == 0x0D)
    solid = keep & ~blank
    # trim: between the first and the last solid character of each row
    at = np.arange(len(out))
    first = np.full(len(offsets) - 1, len(out))
    last = np.full(len(offsets) - 1, -1)
    np.minimum.at(first, rows[solid], at[solid])
    np.maximum.at(last, rows[solid], at[solid])
    keep &= (at >= first[rows]) & (at <= last[rows])
    size = row_sums(keep.astype(np.int64), offsets)
    return Side(out[keep], np.concatenate([[0], np.cumsum(size)]))


def _grams(side: Side, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram within a row; digits are one, letters lower case."""
    p = side.points.copy()
    p[TABLES["digit"][side.low]] = 0x30
    upper = (p >= 0x41) & (p <= 0x5A)
    p[upper] += 0x20
    keys = gram_keys(p, order, bits)
    inside = np.arange(len(p)) <= side.offsets[1:][side.rows] - order
    return side.rows[inside], keys[inside]


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values)


_RATIO = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.84, 0.87, 0.9, 0.92, 0.94, 0.96, 0.98, 1.02, 1.06, 1.1, 1.2, 1.4, 1.8, 2.5])
_SHARE = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
_ENGLISH = np.array([-2.0, -1.5, -1.0, -0.7, -0.5, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0])
_COUNT = np.array([-3.5, -2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 3.5])


def _ends(side: Side) -> np.ndarray:
    """Kind of the last character of each row."""
    last = np.where(side.size > 0, side.points[np.maximum(side.offsets[1:] - 1, 0)] if len(side.points) else 0, 0)
    low = np.minimum(last, 0x10000)
    out = np.zeros(len(last), dtype=np.int64)
    for k, flag in enumerate((np.isin(low, [0x2E, 0x3002]), np.isin(low, [0x21, 0x3F]), np.isin(low, [0x29, 0x5D, 0x300D, 0x22, 0x201D]), TABLES["digit"][low], TABLES["latin"][low], TABLES["kana"][low], TABLES["han"][low], np.isin(low, [0x2026]), np.isin(low, [0x2C, 0x3B, 0x3A, 0x2D, 0x3001, 0x28, 0x201C, 0x2019, 0x2014])), 1):
        out[flag] = k
    dots = (side.size > 2) & (low == 0x2E)
    at = np.maximum(side.offsets[1:] - 3, 0)
    if len(side.points):
        dots &= (side.points[np.minimum(at, len(side.points) - 1)] == 0x2E) & (side.points[np.minimum(at + 1, len(side.points) - 1)] == 0x2E)
        out[dots] = 10
    return out


def _sentences(side: Side, japanese: bool) -> np.ndarray:
    p = side.points
    if japanese:
        return row_sums(np.isin(p, [0x3002, 0x21, 0x3F]).astype(np.int64), side.offsets)
    stop = np.isin(p, [0x2E, 0x21, 0x3F])
    after = np.zeros(len(p), dtype=bool)
    after[:-1] = np.isin(p[1:], [0x20, 0x0A, 0x22, 0x201D, 0x29])
    if len(p):
        after[side.offsets[1:][side.size > 0] - 1] = True
    dotted = np.zeros(len(p), dtype=bool)
    dotted[1:] = p[:-1] == 0x2E  # dots in a row
    versus = np.zeros(len(p), dtype=bool)
    versus[2:] = (p[1:-1] == 0x73) & (p[:-2] == 0x76)
    return row_sums((stop & after & ~dotted & ~versus).astype(np.int64), side.offsets)


class Features:
    """Sparse features of a batch of pairs: (row, feature, value) arrays."""

    def __init__(self, source: Side, answer: Side, model: "Classifier"):
        n = len(answer.size)
        rows: list[np.ndarray] = []
        feats: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def add(r: np.ndarray, f: np.ndarray, v: np.ndarray | None = None) -> None:
            rows.append(r.astype(np.int32))
            feats.append(f.astype(np.int32))
            values.append(np.ones(len(r), dtype=np.float32) if v is None else v.astype(np.float32))

        size = np.maximum(answer.size, 1)
        r, f = _grams(answer, 4, _GRAM)
        add(r, f + _AT_GRAM, 1.0 / np.sqrt(size)[r])
        words, word_rows = model.words(answer)
        n_words = np.maximum(np.bincount(word_rows, minlength=n), 1)
        add(word_rows, words, 1.0 / np.sqrt(n_words)[word_rows])
        for k in (2, 3, 5):
            r = np.flatnonzero(answer.size >= k)
            at = answer.offsets[1:][r][:, None] - np.arange(k, 0, -1)[None, :]
            p = answer.points[at].copy()
            p[(p >= 0x30) & (p < 0x3A)] = 0x30
            add(r, _AT_TAIL + (hash_runs(p.reshape(-1), np.arange(len(r) + 1) * k, k).view(np.uint64) >> np.uint64(64 - _TAIL)).astype(np.int64))
        for k, own in ((2, 3), (4, 4), (3, 5)):  # how both sides end
            r = np.flatnonzero((answer.size >= own) & (source.size >= k))
            at = source.offsets[1:][r][:, None] - np.arange(k, 0, -1)[None, :]
            to = answer.offsets[1:][r][:, None] - np.arange(own, 0, -1)[None, :]
            p = np.concatenate([source.points[at], answer.points[to]], axis=1)
            p[(p >= 0x30) & (p < 0x3A)] = 0x30
            add(r, _AT_TAIL + (hash_runs(p.reshape(-1), np.arange(len(r) + 1) * (k + own), 20 + k).view(np.uint64) >> np.uint64(64 - _TAIL)).astype(np.int64))
        every = np.arange(n)
        ratio = answer.size / model.expected(source)
        known = np.bincount(word_rows, weights=model.known[words].astype(np.float64), minlength=n) / n_words
        kinds = {k: answer.share(k) / size for k in ("kana", "han", "hangul", "cyrillic", "latin", "accent")}
        japanese = kinds["kana"] + kinds["han"]
        copy = self._copied(source, answer, japanese)
        one, two = _sentences(source, True), _sentences(answer, False)
        lines = row_sums((source.points == 0x0A).astype(np.int64), source.offsets) - row_sums((answer.points == 0x0A).astype(np.int64), answer.offsets)
        listed = (one == 0) & (row_sums((source.points == 0x0A).astype(np.int64), source.offsets) > 0)
        parts = [
            _binned(ratio, _RATIO),
            np.minimum(one, 3) * 32 + _binned(ratio, _RATIO),
            _binned(known, _SHARE),
            _binned(model.languages.english(answer) if model.languages else np.zeros(n), _ENGLISH),
            *(_binned(kinds[k], _SHARE) for k in ("kana", "hangul", "cyrillic", "accent")),
            _binned(japanese, _SHARE),
            _binned(kinds["han"] * (kinds["kana"] == 0), _SHARE),
            _binned(copy, _SHARE) * (japanese > 0.05),
            np.where(japanese > 0.3, _binned(copy, _SHARE), 20),
            np.minimum(one, 3) * 10 + _binned(one - two, _COUNT),
            _ends(source) * 11 + _ends(answer),
            np.where(listed, _binned(lines, _COUNT), 15),
            (_ends(source) * 11 + _ends(answer)) * 2 + (ratio < 0.85),
        ]
        at = _AT_BINS
        for part in parts:
            add(every, at + part.astype(np.int64))
            at += 256
        self.rows, self.feats, self.values, self.n = np.concatenate(rows), np.concatenate(feats), np.concatenate(values), n

    @staticmethod
    def _copied(source: Side, answer: Side, japanese: np.ndarray) -> np.ndarray:
        """Share of the answer's bigrams that stand in the source, for answers with Japanese."""
        out = np.zeros(len(answer.size))
        marked = japanese > 0.05
        if not marked.any():
            return out
        keys = []
        for side in (source, answer):
            r, k = _grams(side, 2, 24)
            sel = marked[r]
            keys.append((r[sel].astype(np.int64) << 24) | k[sel])
        hit = np.isin(keys[1], keys[0])
        r = keys[1] >> 24
        total = np.bincount(r, minlength=len(out))
        return np.bincount(r, weights=hit, minlength=len(out)) / np.maximum(total, 1)


class Languages:
    """Profiles of character n-grams: how much likelier text is English than any other language written in Latin letters."""

    ORDERS, BITS = (1, 2, 3, 4), 15

    def __init__(self, english: list[str], others: list[str]):
        self.tables = []
        counts = [self._count(pa.array(texts, pa.string())) for texts in (english, others)]
        for one, two in zip(*counts):
            share = [np.log((c + 0.3) / (c.sum() + 0.3 * len(c))) for c in (one, two)]
            self.tables.append(np.clip(share[0] - share[1], -4.0, 4.0).astype(np.float32))

    def _keys(self, side: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        letter = TABLES["latin"][side.low]
        p = np.where((side.points >= 0x41) & (side.points <= 0x5A), side.points + 0x20, side.points)
        p = np.where(letter, p, 0x20).astype(np.uint32)
        for order in self.ORDERS:
            keys = gram_keys(p, order, self.BITS)
            some = letter.copy()
            for k in range(1, order):
                some[: len(some) - k] |= letter[k:]
            inside = (np.arange(len(p)) <= side.offsets[1:][side.rows] - order) & some
            yield side.rows[inside], keys[inside]

    def _count(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.bincount(keys, minlength=1 << self.BITS).astype(np.float64) for _, keys in self._keys(fold(texts))]

    def english(self, side: Side) -> np.ndarray:
        """Mean log ratio of a row's n-grams; positive where English is likelier."""
        return side.once(f"english {id(self)}", lambda: self._english(side))

    def without_names(self, side: Side) -> np.ndarray:
        """The same of the words without a capital: names of things are no evidence of a language."""
        return side.once(f"lower {id(self)}", lambda: self.english(Side(np.where(_capitalised(side), 0x20, side.points), side.offsets)))

    def _english(self, side: Side) -> np.ndarray:
        total, n = np.zeros(len(side.size)), np.zeros(len(side.size))
        for (rows, keys), table in zip(self._keys(side), self.tables):
            total += np.bincount(rows, weights=table[keys], minlength=len(total))
            n += np.bincount(rows, minlength=len(total))
        return total / np.maximum(n, 1)


def _capitalised(side: Side) -> np.ndarray:
    """Letters of words that begin with a capital."""
    letter = TABLES["latin"][side.low]
    start = letter.copy()
    start[1:] &= ~letter[:-1] | (side.rows[1:] != side.rows[:-1])
    word = np.cumsum(start)
    capital = np.append(False, ((side.points >= 0x41) & (side.points <= 0x5A) | (side.points >= 0xC0) & (side.points < 0xDF))[start])
    return letter & capital[word]


class Classifier:
    """Weights for each label, what lengths and words are expected, and thresholds."""

    def __init__(self) -> None:
        self.weights = np.zeros((SIZE, len(LABELS)), dtype=np.float32)
        self.bias = np.full(len(LABELS), -2.0, dtype=np.float32)
        self.thresholds = np.full(len(LABELS), 1e9, dtype=np.float32)
        self.length = np.zeros(1 << _LENGTH, dtype=np.float32)
        self.known = np.zeros(1 << _WORD, dtype=bool)
        self.languages: Languages | None = None

    def words(self, side: Side) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and row of each word."""
        return side.once("words", lambda: self._words(side))

    @staticmethod
    def _words(side: Side) -> tuple[np.ndarray, np.ndarray]:
        p = side.points.copy()
        upper = (p >= 0x41) & (p <= 0x5A)
        p[upper] += 0x20
        letter = TABLES["latin"][side.low] | TABLES["cyrillic"][side.low] | (p == 0x27) | (p == 0x2019)
        if not len(p):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start = np.ones(len(p), dtype=bool)
        start[1:] = (letter[1:] != letter[:-1]) | (side.rows[1:] != side.rows[:-1])
        begin = np.flatnonzero(start)
        hashes = hash_runs(p, np.append(begin, len(p)))
        sel = letter[begin]
        return (hashes[sel].view(np.uint64) >> np.uint64(64 - _WORD)).astype(np.int64), side.rows[begin[sel]]

    def expected(self, source: Side) -> np.ndarray:
        """Length of the answer that the source makes one expect."""
        total = np.zeros(len(source.size))
        for order in LENGTH_ORDERS:
            r, k = _grams(source, order, _LENGTH)
            total += np.bincount(r, weights=self.length[k], minlength=len(source.size))
        return np.maximum(total, 2.0)

    def scores(self, features: Features) -> np.ndarray:
        out = np.empty((features.n, len(LABELS)), dtype=np.float32)
        for k in range(len(LABELS)):
            out[:, k] = np.bincount(features.rows, weights=np.ascontiguousarray(self.weights[:, k])[features.feats] * features.values, minlength=features.n) + self.bias[k]
        return out

    def fit_length(self, source: Side, answer: Side) -> None:
        """Ridge regression of the answer's length on hashed n-grams of the source, by conjugate gradients."""
        r, k = (np.concatenate(x) for x in zip(*(_grams(source, order, _LENGTH) for order in LENGTH_ORDERS)))
        n, y = len(source.size), answer.size.astype(np.float64)
        scale = 1.0 / np.sqrt(np.maximum(y, 5.0))  # the error grows with the length
        forward = lambda w: np.bincount(r, weights=w[k], minlength=n) * scale
        back = lambda e: np.bincount(k, weights=(e * scale)[r], minlength=1 << _LENGTH)
        w = np.zeros(1 << _LENGTH)
        res = back(y * scale)
        d, norm = res.copy(), res @ res
        for _ in range(60):
            if norm < 1e-9:
                break
            ad = back(forward(d)) + 0.05 * d
            step = norm / (d @ ad)
            w += step * d
            res -= step * ad
            new = res @ res
            d = res + new / norm * d
            norm = new
        self.length = w.astype(np.float32)

    def fit(self, features: Features, labels: np.ndarray, seed: int, epochs: int) -> None:
        """Adagrad on shuffled batches."""
        order = np.argsort(features.rows, kind="stable")
        feats, values = features.feats[order], features.values[order]
        edges = np.searchsorted(features.rows[order], np.arange(features.n + 1))
        rng = np.random.default_rng(seed)
        weight = np.where(np.nansum(labels, axis=1) == 0, SOUND, 1.0)
        grown = np.full(SIZE, 0.1, dtype=np.float64)
        grown = np.repeat(grown[:, None], len(LABELS), axis=1)
        for _ in range(epochs):
            rows = rng.permutation(features.n)
            for a in range(0, len(rows), BATCH):
                part = rows[a : a + BATCH]
                size = edges[part + 1] - edges[part]
                own = np.repeat(np.arange(len(part)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[part], size)
                f, v = feats[at], values[at]
                uniq, inv = np.unique(f, return_inverse=True)
                for k in range(len(LABELS)):
                    z = np.bincount(own, weights=self.weights[f, k] * v, minlength=len(part)) + self.bias[k]
                    g = np.nan_to_num((1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[part, k]) * weight[part])  # an unknown label teaches nothing
                    grad = np.bincount(inv, weights=g[own] * v, minlength=len(uniq)) / len(part) * 8 + DECAY * self.weights[uniq, k]
                    grown[uniq, k] += grad * grad
                    self.weights[uniq, k] -= (RATE * grad / np.sqrt(grown[uniq, k])).astype(np.float32)
                    self.bias[k] -= RATE * 0.1 * g.mean()


def _columns(pairs: list[tuple[str, str]]) -> tuple[Side, Side]:
    return fold(pa.array([a for a, _ in pairs], pa.string())), fold(pa.array([b for _, b in pairs], pa.string()))


def _languages(answers: list[str]) -> Languages:
    """Profiles from sentences of known language, then with those answers of the sample that are clearly English by them."""
    english, others = [*synthesis.ENGLISH, *synthesis.ENGLISH_WORDS], [t for t in synthesis.FOREIGN if max(t) < "\u0370" or max(c for c in t if c.isalpha()) < "\u0370" or "\u1e00" <= max(t) < "\u1f00"]
    first = Languages(english, others)
    clear = first.english(fold(pa.array(answers, pa.string()))) > CLEAR
    return Languages(english * 3 + [a for a, c in zip(answers, clear.tolist()) if c][: 20 * len(english)], others * 5)


def train(sample: list[tuple[str, str]], seed: int = 7) -> Classifier:
    """Fit on sound rows of the sample and synthetic defects of them; suspicious rows are left out and it is fitted anew."""
    rng = random.Random(seed)
    model = Classifier()
    if len(sample) < 50:
        return model
    unknown = float("nan")  # whether an answer of other wording covers the text isn't known
    languages = _languages([b for _, b in sample])
    # answers that aren't English by their letters or profile are no examples of sound ones
    answer = fold(pa.array([b for _, b in sample], pa.string()))
    letters = row_sums(TABLES["letter"][answer.low].astype(np.int64), answer.offsets)
    other = (answer.share("latin") < 0.8 * letters) | ((languages.english(answer) < FOREIGN / 2) & (letters >= 10))
    sound = [p for p, o in zip(sample, other.tolist()) if not o]
    for turn in range(2):
        model = Classifier()
        model.languages = languages
        source, answer = _columns(sound)
        model.fit_length(source, answer)
        words, _ = model.words(answer)
        model.known = np.bincount(words, minlength=1 << _WORD) >= 3
        if turn == 0:  # rows that the lengths don't fit are no examples of sound ones
            ratio = answer.size / model.expected(source)
            sound = [p for p, q in zip(sound, ratio.tolist()) if 0.75 < q < 1.35]
            source, answer = _columns(sound)
            model.fit_length(source, answer)
        texts, labels = [], []
        for i, (src, ans) in enumerate(sound):
            texts.append((src, ans))
            labels.append([0, 0, 0, 0])
            made = synthesis.truncated(rng, ans)
            if made and made != ans.strip():
                texts.append((src, made))
                labels.append([0, 0, 0, 1])
            if i % 2:
                texts.append((src, synthesis.refusal(rng)))
                labels.append([1, 0, 0, 0])
            if i % 3 == 0:
                texts.append((src, synthesis.copied(rng, src)))
                labels.append([0, 1, 0, 0])
            else:
                other = sound[rng.randrange(len(sound))][0]
                texts.append((src, synthesis.foreign(rng, src, other)))
                labels.append([0, int(other == src), int(other != src), 0])
            if i % 4 == 1:  # the answer to another question, English of any kind, and garbled words: none of them refuses
                kind = i // 4 % 3
                made = sound[rng.randrange(len(sound))][1] if kind == 0 else synthesis.english(rng, src) if kind == 1 else synthesis.garbled(rng, ans)
                texts.append((src, made))
                labels.append([0, 0, 0, unknown])
        y = np.array(labels, dtype=np.float32)
        held = np.random.default_rng(seed).random(len(texts)) < 0.2
        train_rows = [t for t, h in zip(texts, held) if not h]
        features = Features(*_columns(train_rows), model)
        model.fit(features, y[~held], seed, EPOCHS[turn])
        scores = model.scores(Features(*_columns([t for t, h in zip(texts, held) if h]), model))
        sane = scores[np.nansum(y[held], axis=1) == 0]
        told = ~np.isnan(y[held]).any(axis=1)[np.nansum(y[held], axis=1) == 0]
        for k in range(len(LABELS)):
            # the threshold that serves held-out rows best, sound ones outnumbering defects as in a corpus
            bad = np.sort(scores[y[held][:, k] == 1, k])
            steps = np.linspace(LEAST[LABELS[k]], 6, 76)
            good = sane[told, k] if LABELS[k] == "truncated" else sane[:, k]
            wrong = np.array([(good > s).mean() for s in steps])
            missed = np.array([(bad <= s).mean() for s in steps])
            price = wrong * COST[LABELS[k]] + missed
            model.thresholds[k] = np.median(steps[price <= price.min() + 0.002]) - LENIENT[LABELS[k]]
        if turn == 0:
            own = model.scores(Features(*_columns(sound), model))
            bad = (own > np.quantile(own, 1.0 - DOUBT, axis=0)).any(axis=1)
            sound = [p for p, b in zip(sound, bad.tolist()) if not b]
    return model


def _sample(translations: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE rows with Japanese text and an answer, chosen by a hash of the row.

    A bound on the hash, from the number of rows, leaves a few times the sample before the smallest hashes are taken,
    so that no task sends more than its share.
    """
    count = translations.count()
    share = min(1.0, SPARE * SAMPLE / max(count, 1))
    own = F.xxhash64("row_id", "text")
    rows = translations.where(own <= int(-(2**63) + share * (2**64 - 1)) if share < 1.0 else F.lit(True))
    rows = rows.where(F.col("text").rlike("[\u3041-\u30FF\u4E00-\u9FFF]") & F.col("translation").rlike(r"\S"))
    rows = rows.select(F.col("text").cast("string"), F.col("translation").cast("string"), own.alias("h"))
    return [(r[0], r[1]) for r in rows.orderBy("h").limit(SAMPLE).collect()]


def _stops_early(model: Classifier, source: Side, answer: Side) -> np.ndarray:
    """The exact check of truncated answers: fewer sentences or lines than the source, or an end that is none."""
    one, two = _sentences(source, True), _sentences(answer, False)
    end = _ends(answer)
    closed = (end == 1) | (end == 2) | (end == 3)
    lines = row_sums((source.points == 0x0A).astype(np.int64), source.offsets) - row_sums((answer.points == 0x0A).astype(np.int64), answer.offsets)
    words, rows = model.words(answer)
    last = np.zeros(len(answer.size), dtype=bool)  # the last word is a known one
    if len(rows):
        at = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))
        last[rows[at]] = model.known[words[at]]
    ratio = answer.size / model.expected(source)
    prose = one > 0
    broken = ~last & (end == 5) | (end == 8) | (end == 9) | (end == 10)
    return np.where(prose, (two < one) | ~closed, broken | (ratio < 0.8) | (lines > 0))


def _foreign(model: Classifier, answer: Side) -> np.ndarray:
    """The exact check of answers in another language: by their profile none in English, or few Latin letters."""
    words, rows = model.words(answer)
    n = len(answer.size)
    known = np.bincount(rows, weights=model.known[words].astype(np.float64), minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)
    letters = answer.share("letter")
    foreign = model.languages.english(answer) < FOREIGN if model.languages else known < 0.6
    strong = model.languages.english(answer) < -FOREIGN if model.languages else foreign
    return strong | ((known < 0.6) & foreign) | (answer.share("latin") < 0.8 * letters)


def _plainly_foreign(model: Classifier, answer: Side) -> np.ndarray:
    """Answers whose profile speaks against English, and such in Chinese characters without kana or in letters of other scripts."""
    latin, han = answer.share("latin"), answer.share("han")
    letters = answer.share("letter")
    others = letters - latin - han - answer.share("kana")
    profile = model.languages.english(answer) < -FOREIGN if model.languages else np.zeros(len(latin), dtype=bool)
    if model.languages:
        small = row_sums((TABLES["latin"][answer.low] & ~_capitalised(answer)).astype(np.int64), answer.offsets)
        profile |= (model.languages.without_names(answer) < -FOREIGN) & (small >= 7)
    chinese = (answer.share("kana") == 0) & (han >= 4) & (han > 0.25 * letters)
    return (profile & (latin >= 10)) | chinese | ((others >= 4) & (others > 0.25 * letters) & (answer.share("accent") + answer.share("sign") == 0))


def _other_script(answer: Side) -> np.ndarray:
    """Answers in a script that is neither Latin nor that of the source: no weights are needed to tell these."""
    letters = answer.share("letter")
    own = sum(answer.share(k) for k in ("latin", "kana", "han"))
    hangul = answer.share("hangul")
    return (letters >= 3) & (own < 0.2 * letters) | (hangul >= 4) & (hangul > 0.25 * letters)


def _cleaned(value: str | None) -> str:
    """The value without page numbers and running headers, words divided at line ends put together."""
    lines = (value or "").split("\n")
    lines = [line for line, kind in zip(lines, line_kinds(lines)) if not kind]
    return DIVIDED_LINE.sub("", "\n".join(lines))


def _look_again(model: Classifier, part: pa.RecordBatch, found: np.ndarray, source: Side, answer: Side) -> None:
    """Lines of the scanned page change lengths and ends: truncated rows with several lines are judged without them."""
    breaks = row_sums((source.points == 0x0A).astype(np.int64), source.offsets) + row_sums((answer.points == 0x0A).astype(np.int64), answer.offsets)
    at = np.flatnonzero((found == DEFECTS.index("truncated")) & (breaks > 0))
    if not len(at):
        return
    sides = [fold(pa.array([_cleaned(v) for v in part.column(c).take(pa.array(at)).to_pylist()], pa.string())) for c in (1, 2)]
    k = LABELS.index("truncated")
    sound = (model.scores(Features(*sides, model))[:, k] <= model.thresholds[k]) | ~_stops_early(model, *sides)
    found[at[sound]] = -1


def defective_pairs(translations: DataFrame) -> DataFrame:
    """(row_id, defect) of each row with a defective answer."""
    shared = translations.sparkSession.sparkContext.broadcast(train(_sample(translations)))
    src = translations.select("row_id", F.col("text").cast("string"), F.col("translation").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, 1, 2):
                source, answer = fold(part.column(1)), fold(part.column(2))
                asked = (source.share("kana") + source.share("han")) > 0
                garbled = source.share("odd") * 20 > source.size
                empty = answer.size == 0
                found = np.full(len(asked), -1, dtype=np.int64)
                scores = model.scores(Features(source, answer, model))
                over = scores > model.thresholds
                k = LABELS.index("other_language")
                over[:, k] &= _foreign(model, answer)
                over[:, k] |= _plainly_foreign(model, answer) & (scores[:, k] > model.thresholds[k] - PLAINLY)
                over[:, LABELS.index("other_language")] |= _other_script(answer)
                end = _ends(answer)
                over[:, LABELS.index("truncated")] &= _stops_early(model, source, answer) & (~garbled | (end >= 8))
                for k in range(len(LABELS) - 1, -1, -1):
                    found[over[:, k]] = k + 1
                _look_again(model, part, found, source, answer)
                found[empty] = 0
                at = np.flatnonzero(asked & (found >= 0))
                names = pa.array(DEFECTS).take(pa.array(found[at]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), names], names=["row_id", "defect"])

    return src.mapInArrow(run, f"row_id {dict(src.dtypes)['row_id']}, defect string")
