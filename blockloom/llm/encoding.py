"""Text that was read with the wrong character encoding, found and restored by noisy-channel decoding.

A value is taken back to bytes under each suspected wrong encoding and read again under the true ones.  The bytes form
a lattice: a character that was lost in reading (U+FFFD, or dropped without trace) is a wildcard byte, and a character
that does not fit stays as it is.  Viterbi search over the lattice under character bigrams counted over the whole corpus
finds the likeliest text; it is taken if it is likelier than the value as it stands.  Frequencies of whole words, counted
over the corpus too, decide between the readings of several encodings and choose the characters in place of lost bytes.

Defined results: null, blank and correctly written values are no cases; where bytes are lost the likeliest text is given
and marked as not certain; where garbling is left that no encoding of the list explains the value is found but not
restored; values of any length are decoded whole; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow_text import code_points, hash_runs, pieces, row_sums
from blockloom.llm.ngrams import gram_key, tables

SINGLE = ("latin-1", "cp1252", "mac_roman", "cp1251", "koi8_r", "cp437", "cp850", "iso8859_15", "iso8859_2", "cp1250")
MULTI = ("cp932", "gbk", "big5", "cp949", "euc_jp")
TRUE_OF_SINGLE = ("utf-8", "cp932", "euc_jp")
#: Nats by which the restored text must be likelier, and the price of a byte that was lost.
GAIN, LOST = 1.5, 1.0
BITS = 18
ORDERS = {1: 16, 2: BITS, 0: BITS}
#: Weight of word frequencies against those of characters.
WORDS = 0.4
#: Least share of the corpus of a character that is put in.
RARE = 3e-7
#: Share of the corpus from which a character is usual.
USUAL = 2e-5
#: Share of the most signs of a true encoding that a wrong encoding must show.
NEAR = 0.7
LOSS = "�"
_ALLOWED = set("©®°±×²³¹·’“”—…※™①②③④⑤⑥⑦⑧⑨★")


@cache
def single_bytes(name: str) -> dict[str, int]:
    """Byte of each character of a single-byte encoding; undefined bytes are the control characters of that number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if name != "latin-1":
        for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D):
            out.setdefault(chr(b), b)
    return out


@cache
def multi_bytes(name: str, ch: str) -> bytes | None:
    """Bytes of a character of a multi-byte encoding; None if it has none."""
    if name == "cp932" and ch in "\x80":
        return {"\x80": b"\x80", "": b"\xa0", "": b"\xfd", "": b"\xfe", "": b"\xff"}[ch]
    if name in ("gbk", "cp949", "big5") and ch in "\x80\xff€":
        return b"\xff" if ch == "\xff" else b"\x80"
    try:
        return ch.encode(name)
    except UnicodeEncodeError:
        return None


@cache
def hints() -> np.ndarray:
    """Code points that show in garbled text and hardly elsewhere: only values with one are decoded."""
    out = np.zeros(0x110000, dtype=bool)
    for lo, hi in ((0x80, 0x250), (0x2B0, 0x300), (0x370, 0x530), (0x2010, 0x2040), (0x20A0, 0x20D0), (0x2200, 0x2300), (0x2500, 0x25A0), (0x3100, 0x3130), (0xE000, 0xF900), (0xFE30, 0xFE50), (0xFF61, 0xFFA0), (0xFFE0, 0xFFE7), (0xFFFD, 0xFFFE)):
        out[lo:hi] = True
    for name in MULTI:
        for lead in (b"\xe2\x80", b"\xe3\x80", b"\xe3\x81", b"\xe3\x82", b"\xe3\x83", b"\xef\xbc", *(bytes([a, b]) for a in (0xC2, 0xC3) for b in range(0x80, 0xC0))):
            try:
                text = lead.decode(name)
            except UnicodeDecodeError:
                continue
            if len(text) == 1:
                out[ord(text)] = True
    for a, b in _KANJI_BYTES[: 6 * 64]:
        for ch in bytes((a, b)).decode("gbk", "ignore"):
            out[ord(ch)] = True
    for ch, _ in _kana_read_as():
        out[ord(ch)] = True
    for ch in _ALLOWED:
        out[ord(ch)] = False
    return out


_WORD = re.compile("[A-Za-zÀ-ɏ]{2,}|[ァ-ヺー]{2,}|[ぁ-ん]{2,}|[一-鿿々]+")
_letter = re.compile("[A-Za-zÀ-ɏァ-ヺーぁ-ん一-鿿々]")


def word_buckets(points: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each run of letters of one kind, ASCII letters in lower case."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    kind = _word_kinds()[np.minimum(points, 0x10000)]
    low = np.where((points >= 0x41) & (points <= 0x5A), points + 0x20, points).astype(np.uint32)
    start = np.ones(len(points), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    begin = np.flatnonzero(start)
    hashes = hash_runs(low, np.append(begin, len(points)))
    return (hashes[kind[begin] > 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


@cache
def _word_kinds() -> np.ndarray:
    out = np.zeros(0x10001, dtype=np.uint8)
    for k, (lo, hi) in enumerate(((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x30A1, 0x30FB), (0x30FC, 0x30FD), (0x3041, 0x3094), (0x4E00, 0xA000), (0x3005, 0x3006))):
        out[lo:hi] = (1, 1, 1, 2, 2, 3, 4, 4)[k]
    return out


class Model:
    """Character bigrams of the corpus, and the characters it holds by their UTF-8 bytes."""

    def __init__(self, counts: dict[int, np.ndarray]):
        self.one, self.two = counts[1].astype(np.float64), counts[2].astype(np.float64)
        self.words = counts.get(0, np.zeros(1 << BITS))
        self.kept_words: dict[str, float] = {}
        self.total = self.one.sum() + 1.0
        self.share = (self.one + 0.01) / self.total
        self.kept: dict[str, float] = {}
        #: The most that two characters before it can make the same character differ in.
        self.range = math.log((self.one.max(initial=0.0) + 2.0) / (2.0 * self.share.min()))
        at = np.flatnonzero(self.one >= max(2.0, RARE * self.total))
        garbage = {ch for ch in multi_signs(False) if "一" <= ch <= "鿿"}
        self.common = {chr(c) for c in at.tolist() if c >= 0x80 and not 0xD800 <= c < 0xE000 and not (0x80 <= c < 0xA0) and chr(c) != LOSS and not 0xE000 <= c < 0xF900 and chr(c) not in garbage}
        # what a first layer of wrong reading holds may come out of the second
        self.readable = self.common | {ch for name in SINGLE for ch in single_bytes(name) if ch >= "\x80"}
        usual = {ch for ch in self.common if self.one[min(ord(ch), 0xFFFF)] > USUAL * self.total}
        self.signs = Signs(self.common, self.readable, usual)
        self.by_length: dict[int, dict[bytes, str]] = {2: {}, 3: {}}
        for ch in self.common:
            raw = ch.encode("utf-8")
            if len(raw) in self.by_length:
                self.by_length[len(raw)][raw] = ch
        self.filled: dict[tuple, list[str]] = {}

    def log(self, a: str, b: str) -> float:
        got = self.kept.get(a + b)
        if got is None:
            key = (min(ord(a), 0xFFFF), min(ord(b), 0xFFFF))
            both = min(self.two[gram_key(key, BITS)], self.one[key[0]], self.one[key[1]])
            got = math.log((both + 2.0 * self.share[key[1]]) / (self.one[key[0]] + 2.0))
            if len(self.kept) > 500_000:
                self.kept.clear()
            self.kept[a + b] = got
        return got

    def score(self, text: str) -> float:
        return sum(map(self.log, "\n" + text, text))

    def word(self, word: str) -> float:
        """Log of how often a word stands in the corpus."""
        got = self.kept_words.get(word)
        if got is None:
            if len(self.kept_words) > 200_000:
                self.kept_words.clear()
            key = word_buckets(np.array(list(map(ord, word)), dtype=np.uint32), BITS)
            got = self.kept_words[word] = math.log(float(self.words[key[0]]) + 0.5) if len(key) else 0.0
        return got

    def word_score(self, text: str) -> float:
        """Mean log frequency of the words of a text."""
        found = [self.word(w) for w in _WORD.findall(text)]
        return sum(found) / len(found) if found else 0.0

    def matching(self, pattern: tuple[int | None, ...]) -> list[str]:
        """Common characters whose UTF-8 bytes fit a pattern with wildcards, the commonest first."""
        got = self.filled.get(pattern)
        if got is None:
            fits = [ch for raw, ch in self.by_length.get(len(pattern), {}).items() if all(p is None or p == b for p, b in zip(pattern, raw))]
            got = self.filled[pattern] = sorted(fits, key=lambda c: -self.one[ord(c)])
        return got


def to_bytes(text: str, wrong: str) -> tuple[list[int | None], list[int]]:
    """Bytes under the wrong encoding and the character each comes from; -1 is a character without bytes, None lost."""
    out: list[int | None] = []
    source: list[int] = []
    single = single_bytes(wrong) if wrong in SINGLE else None
    for i, ch in enumerate(text):
        if ch == LOSS:
            raw: tuple | bytes = (None,)
        elif single is not None:
            b = single.get(ch)
            raw = (-1,) if b is None else (b,)
        else:
            got = multi_bytes(wrong, ch)
            raw = (-1,) if got is None else got
        out.extend(raw)
        source.extend([i] * len(raw))
    return out, source


def _pairs(data: list, true: str, i: int) -> str | None:
    """Character of a two-byte encoding at i."""
    a = data[i]
    b = data[i + 1] if i + 1 < len(data) else None
    if a is None or b is None or a < 0x80 or b < 0x40:
        return None
    try:
        ch = bytes((a, b)).decode(true)
    except UnicodeDecodeError:
        return None
    return ch if len(ch) == 1 else None


def _utf8_steps(model: Model, data: list, i: int, lossy: bool) -> list[tuple[str, int, float]]:
    """(character, bytes used, price) of each way to read UTF-8 at i."""
    first = data[i]
    cont = lambda k: k < len(data) and (data[k] is None or 0x80 <= (data[k] or 0) < 0xC0)
    steps: list[tuple[str, int, float]] = []
    length = 0 if first is None or first < 0xC2 else 2 if first < 0xE0 else 3 if first < 0xF0 else 0
    if length:
        have = 1
        while have < length and cont(i + have):
            have += 1
        got = tuple(data[i : i + have])
        if have == length and None not in got:
            ch = bytes(got).decode("utf-8", "ignore")
            return [(ch, length, 0.0)] if ch in model.readable else []
    if not lossy:
        return steps
    if length:
        got = tuple(data[i : i + have])
        if have == length:
            steps += [(ch, length, LOST * got.count(None)) for ch in model.matching(got)]
        elif length == 3 and have == 2:  # one byte is gone: the last, or that between
            steps += [(ch, 2, LOST + 1) for p in ((got[0], got[1], None), (got[0], None, got[1])) for ch in model.matching(p)]
        elif length == 2 and have == 1 or length == 3 and have == 1 and i + 1 < len(data):
            steps += [(ch, 1, LOST * (length - 1) + 1) for ch in model.matching((first, *[None] * (length - 1)))] if length == 2 else []
    elif first is None:
        for n in (3, 2):
            if i + n <= len(data) and all(cont(k) for k in range(i + 1, i + n)) and any(data[k] is not None for k in range(i + 1, i + n)):
                steps += [(ch, n, LOST * data[i : i + n].count(None)) for ch in model.matching(tuple(data[i : i + n]))]
    elif 0x80 <= first < 0xC0 and cont(i + 1) and data[i + 1] is not None:  # the first byte is gone
        steps += [(ch, 2, LOST + 1) for ch in model.matching((None, first, data[i + 1]))]
    return steps


def read_again(model: Model, text: str, wrong: str, true: str, lossy: bool = False) -> tuple[float, str, bool, int]:
    """Viterbi search: log-likelihood and text of the best reading, whether bytes were lost, characters restored."""
    data, source = to_bytes(text, wrong)
    n = len(data)
    single, kept = wrong in SINGLE, model.kept
    # states: position -> last character -> (score, back pointer)
    best: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(n + 1)]
    best[0]["\n"] = (0.0, ())
    whole = [i == 0 or source[i] != source[i - 1] for i in range(n)]  # a character of the value begins here
    for i in range(n):
        states = best[i]
        if not states:
            continue
        if len(states) > 1:
            # exact: what comes next is the same for all states, and what it is worth differs by the model's range at most
            least = max(s[0] for s in states.values()) - model.range
            states = {last: s for last, s in states.items() if s[0] >= least}
        steps: list[tuple[str, int, float, int]] = []
        b = data[i]
        if b is not None and 0 <= b < 0x80:
            steps.append((chr(b), 1, 0.0, 0))
        else:
            if true == "utf-8":
                if b != -1:
                    steps += [(ch, k, price, 1) for ch, k, price in _utf8_steps(model, data, i, lossy)]
            elif b is not None and b >= 0x80:
                ch = _pairs(data, true, i)
                if ch and ch in model.common:
                    steps.append((ch, 2, 0.0, 1))
            # without lost bytes, three bytes of one-byte characters that make a common character leave no choice
            if not lossy and single and len(steps) == 1 and steps[0][1] == 3 and steps[0][0] in model.common:
                pass
            elif whole[i]:
                k = 1
                while i + k < n and source[i + k] == source[i]:
                    k += 1
                steps.append((text[source[i]], k, 0.0, 0))
            elif lossy and not any(p == 0.0 for _, _, p, _ in steps):
                steps.append(("", 1, LOST + 3, 0))  # the rest of a character whose first byte was used
        for ch, k, price, made in steps:
            if i + k > n:
                continue
            target = best[i + k]
            for last, (score, back) in states.items():
                now = ch or last
                value = score - price
                if ch:
                    log = kept.get(last + ch)
                    value += model.log(last, ch) if log is None else log
                if now not in target or target[now][0] < value:
                    target[now] = (value, (back, ch, made, i if price > 0 else -1))
    if not best[n]:
        return -math.inf, text, False, 0
    score, back = max(best[n].values(), key=lambda s: s[0])
    out, lost, made = [], False, 0
    while back:
        back, ch, new, at = back
        out.append((ch, at))
        lost |= at >= 0
        made += new
    out.reverse()
    chars = [ch for ch, _ in out]
    for k, (ch, at) in enumerate(out):
        if at >= 0 and ch:
            chars[k] = _by_words(model, chars, k, data, at)
    return score, "".join(chars), lost, made


def _by_words(model: Model, chars: list[str], k: int, data: list, at: int) -> str:
    """Of the characters that lost bytes may have been, the one that characters and the word around it speak for."""
    steps = _utf8_steps(model, data, at, True)
    used = next(n for ch, n, _ in steps if ch == chars[k])
    lo, hi = k, k + 1
    while lo and _letter.match(chars[lo - 1]):
        lo -= 1
    while hi < len(chars) and _letter.match(chars[hi]):
        hi += 1
    left, right = "".join(chars[lo:k]), "".join(chars[k + 1 : hi])
    before = next((c for c in reversed(chars[:k]) if c), "\n")[-1]
    after = next((c for c in chars[k + 1 :] if c), "")[:1]

    def worth(ch: str) -> float:
        word = next((m[0] for m in _WORD.finditer(left + ch + right) if m.start() <= len(left) < m.end()), "")
        return model.log(before, ch) + (model.log(ch, after) if after else 0.0) + (WORDS * model.word(word) if word else 0.0)

    return max((ch for ch, n, _ in steps if n == used and ch), key=worth)


#: First two bytes of kana, full-width forms and punctuation in UTF-8, and of Latin letters.
_KANA_BYTES = [(0xE2, 0x80), (0xE3, 0x80), (0xE3, 0x81), (0xE3, 0x82), (0xE3, 0x83)]
_JAPANESE_BYTES = [*_KANA_BYTES, (0xEF, 0xBC), (0xEF, 0xBD)]
#: First two bytes of kanji, and the last byte of any character with the first of kana.
_KANJI_BYTES = [*((a, b) for a in range(0xE4, 0xEA) for b in range(0x80, 0xC0)), *((a, 0xE3) for a in range(0x81, 0xC0))]
_LATIN_BYTES = [(a, b) for a in (0xC2, 0xC3) for b in range(0x80, 0xC0)]


@cache
def _kana_read_as() -> tuple[tuple[str, str], ...]:
    """Characters that kana in cp932 become in other two-byte encodings."""
    out = []
    for wrong in ("gbk", "big5", "cp949"):
        for c in range(0x3041, 0x30F7):
            try:
                read = chr(c).encode("cp932").decode(wrong)
            except UnicodeError:
                continue
            if len(read) == 1 and read > "\x7f" and not "ぁ" <= read <= "ヿ":
                out.append((read, wrong))
    return tuple(out)


@cache
def multi_signs(latin: bool = True) -> dict[str, set[tuple[str, str]]]:
    """Characters of multi-byte encodings that begin with the first two bytes of common UTF-8 characters.

    Those of kana always show wrong reading; those of Latin letters and kanji (``latin``) may stand in correct text.
    """
    out: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for wrong in MULTI:
        # the others turn these pairs into characters that correct text holds, or into none
        wide = wrong in ("cp932", "gbk")
        for a, b in (_JAPANESE_BYTES if wide else _KANA_BYTES) + (_LATIN_BYTES + _KANJI_BYTES if latin and wide else []):
            for ch in bytes((a, b)).decode(wrong, "ignore"):
                if ch > "\x7f" and not "ぁ" <= ch <= "ヿ":
                    out[ch].add((wrong, "utf-8"))
    for c in range(0xFF61, 0xFFA0):
        out[chr(c)].add(("cp932", "euc_jp"))
    if latin:
        for ch, wrong in _kana_read_as():
            out[ch].add((wrong, "cp932"))
    return dict(out)


class Signs:
    """What shows that a value was read wrongly: the first two characters that common characters become."""

    def __init__(self, common: set[str], readable: set[str], usual: set[str]):
        self.two: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for wrong in SINGLE:
            back = {b: ch for ch, b in single_bytes(wrong).items()}
            for true in TRUE_OF_SINGLE:
                for ch in readable if true == "utf-8" else common:
                    try:
                        raw = ch.encode(true)
                    except UnicodeEncodeError:
                        continue
                    if len(raw) >= 2 and raw[0] in back and raw[1] in back:
                        self.two[back[raw[0]] + back[raw[1]]].add((wrong, true))
                        if true == "utf-8":
                            self.two[back[raw[0]] + LOSS].add((wrong, true))
        # a kanji that Latin letters turn into shows nothing where correct text often holds it
        own = multi_signs(False)
        self.one = {ch: configs for ch, configs in multi_signs().items() if ch in own or ch not in usual}

    def suspects(self, text: str) -> list[tuple[str, str]]:
        """Pairs of wrong and true encoding that the value speaks for, the likeliest first."""
        hits: dict[tuple[str, str], int] = defaultdict(int)
        for pair in {text[i : i + 2] for i in range(len(text) - 1)}:
            for config in self.two.get(pair, ()):
                hits[config] += 1
        for ch in set(text):
            for config in self.one.get(ch, ()):
                hits[config] += 1
        least = {"utf-8": 1, "cp932": 2, "euc_jp": 2}
        found = {c: n for c, n in hits.items() if n >= least[c[1]]}
        most = {true: max(n for c, n in found.items() if c[1] == true) for true in {c[1] for c in found}}
        # a wrong encoding that explains much less than another of the same true one isn't it
        near = [c for c, n in found.items() if n >= NEAR * most[c[1]]]
        return sorted(near, key=lambda c: (-found[c] * (3 if c[1] == "utf-8" else 1), c))


def peeled(text: str, wrong: str) -> str:
    """The value with every whole UTF-8 character read, without regard to likelihood: one layer of wrong reading."""
    back = single_bytes(wrong)
    out, i, n = [], 0, len(text)
    raw = [back.get(ch, -1) for ch in text]
    while i < n:
        first = raw[i]
        size = 0 if first < 0xC2 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4 if first < 0xF5 else 0
        if size and i + size <= n and all(0x80 <= b < 0xC0 for b in raw[i + 1 : i + size]):
            out.append(bytes(raw[i : i + size]).decode("utf-8", "ignore"))
            i += size
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def layers(model: Model, text: str) -> str | None:
    """The text under two or more layers of one wrong reading, peeled until nothing is left to read; else None."""
    for wrong, true in model.signs.suspects(text):
        if wrong not in SINGLE or true != "utf-8":
            continue
        once = peeled(text, wrong)
        twice = peeled(once, wrong)
        if twice != once and twice != text:
            thrice = peeled(twice, wrong)
            final = thrice if thrice != twice and model.score(thrice) > model.score(twice) else twice
            if not any(w in SINGLE and t == "utf-8" for w, t in model.signs.suspects(final)):
                return final
    return None


def restore(model: Model, text: str) -> tuple[str, bool] | None:
    """The text as written and whether bytes were lost; None if the value isn't garbled."""
    found, lost = text, False
    deep = layers(model, text)
    if deep is not None and model.score(deep) > model.score(text) + GAIN:
        found = deep
    while True:  # however often it was garbled: each turn makes the text likelier
        suspects = model.signs.suspects(found)
        if not suspects:
            break
        own = model.score(found)
        best: tuple[float, str, bool] | None = None
        rank = -math.inf
        for wrong, true in suspects:
            lossy = False
            while True:
                score, again, gone, made = read_again(model, found, wrong, true, lossy)
                if made and again != found and score > own + GAIN:
                    worth = score + WORDS * len(again) ** 0.5 * model.word_score(again)
                    if best is None or worth > rank:
                        best, rank = (score, again, gone), worth
                # bytes are taken as lost only where the strict reading leaves garbled text of the same kind
                if lossy or true != "utf-8" or not (wrong in MULTI or LOSS in found) or (best and not (wrong, true) in model.signs.suspects(best[1]) and LOSS not in best[1]):
                    break
                lossy = True
            if best and not best[2] and best[0] > own + 4 * GAIN and not model.signs.suspects(best[1]):
                break  # nothing is left to restore
        if best is None:
            break
        found, lost = best[1], lost | best[2]
    return (found, lost) if found != text else None


def explained(model: Model, text: str) -> bool:
    """Whether a restored text shows no more signs of a wrong reading."""
    return LOSS not in text and not any("\x80" <= c < "\xa0" for c in text) and not model.signs.suspects(text)


def char_model(translations: DataFrame) -> Model:
    return Model(tables(translations.select(F.col("text").cast("string"), F.col("translation").cast("string")), ORDERS, words=word_buckets))


def garbled_values(translations: DataFrame) -> DataFrame:
    """(row_id, field, value, restored, certain) of each garbled value."""
    src = translations.select("row_id", F.col("text").cast("string"), F.col("translation").cast("string"))
    shared = src.sparkSession.sparkContext.broadcast(char_model(translations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, 1, 2):
                for field in ("text", "translation"):
                    column = part.column(field)
                    points, offsets = code_points(column)
                    at = np.flatnonzero(row_sums(hints()[points].astype(np.int64), offsets))
                    rows = []
                    for i, value in zip(at.tolist(), column.take(pa.array(at)).to_pylist()):
                        got = restore(model, value)
                        if got:
                            text, lost = got
                            known = explained(model, text)
                            rows.append((i, value, text if lost or known else None, lost or not known))
                    take = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_id").take(take), pa.array([field] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([not r[3] for r in rows], pa.bool_())],
                        names=["row_id", "field", "value", "restored", "certain"],
                    )

    kind = dict(src.dtypes)["row_id"]
    return src.mapInArrow(run, f"row_id {kind}, field string, value string, restored string, certain boolean")
