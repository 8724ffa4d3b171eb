"""Traces of the scanned page in longer text, found and repaired by noisy-channel correction.

Kinds of noise: words divided at a line end, wrongly recognised characters, running headers or footers with a title, and
lines that only give the page number.  Lines are classed by their form; whether a word is divided and which characters
are wrong is decided by character n-grams counted over the whole corpus: a confusable character is a candidate where
its surroundings are rarer than those of what it may stand for.  The candidates of all values give the probability of
each confusion, and a Viterbi search over the candidates of a word, confusion probability times n-gram likelihood,
chooses the text.

Values are searched for candidates once; the few that have some, or a form of noise, are kept as a table, from which
the probabilities, the traces and the repaired texts are made.

Defined results: null, blank and one-line values have no line noise; lines repeated in their source, blocks of one mark
or number and numbers of a parts list are none; values of any length are treated whole; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow_text import pieces
from blockloom.llm.ngrams import gram_key, gram_keys, separated, tables
from blockloom.llm.repeated import repeated_lines
from blockloom.session import cut

# What a recogniser reads -> what may stand there.
CONFUSIONS = {
    "c": "e", "0": "o", "l": "i", "1": "l", "li": "h", "ii": "u", "rn": "m", "vv": "w", "d": "cl", "|": "l",
    "ほ": "ま", "ざ": "さ", "|": "ー", "o": "。", "ち": "ら", "ツ": "ッ", "ポ": "ボ", "ユ": "ュ", "ヤ": "ャ", "ヨ": "ョ",
    "エ": "ェ", "ソ": "ン", "ば": "ぱ", "め": "ぬ", "ろ": "る", "ね": "れ", "わ": "れ", "バ": "パ", "プ": "ブ", "ベ": "ペ",
    "一": "ー", "末": "未", "士": "土", "ハ": "八", "ク": "タ",
}
ALTERNATIVES: list[tuple[str, str]] = [*CONFUSIONS.items(), ("|", "l"), ("1", "i"), ("I", "l"), ("ン", "ソ"), ("シ", "ツ")]
#: Weight of the channel against the n-grams, the bounds of a price in nats, the price where nothing is known, and how
#: much likelier the repaired word must be beyond it.
CHANNEL, CHEAPEST, DEAREST, PRICE, GAIN = 0.07, 0.3, 0.75, 0.7, 0.3
#: Bits of the tables of n-grams by order, at up to BASE_ROWS rows; more rows have larger tables, up to MOST_BITS.
ORDERS = {5: 21, 4: 20, 3: 18, 2: 18, 1: 16}
BASE_ROWS, MOST_BITS = 500_000, 24
END = 0x01

# Forms of lines that only give a page number.
PAGE_NO = re.compile(
    r"^\s*(?:[-‐–—―－~〜・]\s*\d{1,4}\s*[-‐–—―－~〜・]|[\[(（［〔<〈]\s*\d{1,4}\s*[\])）］〕>〉]|\d{1,4}\s*[/／]\s*\d{1,4}|(?i:p(?:age|g)?\.?)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*(?:ページ|頁)|(\d{1,4}))\s*$"
)
# Forms of running headers.
HEADER = re.compile(
    r"^\s*(?:第\s*\d+\s*[章部編節][\s　]+\S.*|Chapter \d+(?:\s{2,}|\s*[:：.]\s+)\S.*|[~〜～]\s+\S.*\s+[~〜～]|\S.*[\s　_](?:取扱説明書|説明書|マニュアル)|\S.{2,}\s[|｜]\s*\d{1,4}|\d{1,4}\s*[|｜]\s\S.{2,})\s*$"
)
CAPITALS = re.compile(r"^\s*(?=(?:[^A-Z]*[A-Z]){6})[A-Z0-9][A-Z0-9 .&'’()\[\]_/:-]+\s*$")
SENTENCE = re.compile(r"[。．.!?！？]")
LOWER = re.compile(r"[a-zぁ-ヿ]")
DIVIDED = re.compile(r"(?<=[A-Za-zÀ-ɏ])([-‐‑¬\xad])[ 　]*$")
#: What a value with any noise of lines holds, at least.
HINT = re.compile(
    r"(?m)(?<=[A-Za-zÀ-ɏ])[-‐‑¬\xad][ 　]*$|^[^\w\n]*\d{1,4}[^\w\n]*$|^\s*\d{1,4}\s*(?:[/／]\s*\d{1,4}|ページ|頁)\s*$|^\s*[Pp](?:age|AGE|g|G)?\.?\s*\d"
    r"|^\s*第\s*\d+\s*[章部編節][\s　]|^\s*Chapter \d+(?:\s{2}|\s*[:：.])|^\s*[~〜～]\s|(?:説明書|マニュアル)\s*$|\s[|｜]\s|^[^a-zぁ-ヿ一-鿿\n]*[A-Z][^a-zぁ-ヿ一-鿿\n]*$"
)
WORD_END, WORD_BEGIN = re.compile(r"[^\s]*$"), re.compile(r"^[^\s]*")


def unbroken(points: np.ndarray) -> np.ndarray:
    """Line breaks that go: those after a Japanese character, also if one other character (a misread one, maybe) stands between and the next line is Japanese."""
    japanese = points >= 0x2E80
    gone = points == 0x0A
    within = np.zeros(len(points), dtype=bool)
    within[1:] = japanese[:-1]
    within[2:-1] |= japanese[:-3] & (points[1:-2] > 0x20) & japanese[3:]
    return gone & within


def flow(points: np.ndarray) -> np.ndarray:
    """Text as it runs on: line breaks go within Japanese and are spaces elsewhere; ASCII letters in lower case."""
    out = points.copy()
    upper = (out >= 0x41) & (out <= 0x5A)
    out[upper] += 0x20
    out[points == 0x0A] = 0x20
    return out[~unbroken(points)]


class Model:
    """Probability of a character after those before it, from hashed n-gram counts."""

    def __init__(self, counts: dict[int, np.ndarray], prices: dict[tuple[str, str], float] | None = None):
        self.counts = counts
        self.bits = {order: int(len(table)).bit_length() - 1 for order, table in counts.items()}
        self.prices = prices or {}
        self.kept: dict[str, float] = {}
        self.total = float(counts[2].sum()) + 1.0
        self.reads = sorted({a for a, _ in ALTERNATIVES}, key=lambda a: -len(a))
        self.readings: dict[str, list[tuple[str, str]]] = {}
        for a, b in ALTERNATIVES:
            self.readings.setdefault(a[0], []).append((a, b))
        self.known = np.zeros(0x110000, dtype=bool)
        for a in self.reads:
            self.known[ord(a[0])] = True

    def log(self, text: str) -> float:
        """Log probability of the last character of up to five."""
        got = self.kept.get(text)
        if got is None:
            c = tuple(map(ord, text))
            count = lambda chars: float(self.counts[len(chars)][gram_key(chars, self.bits[len(chars)])])
            if len(c) < 5:
                got = -4.0
            else:
                three = (count(c[2:]) + 0.02) / (count(c[2:4]) + 20.0)
                five, four = count(c), count(c[:4])
                five = min(five, four, count(c[1:]))
                got = math.log((five + 3.0 * three) / (four + 3.0))
            if len(self.kept) > 400_000:
                self.kept.clear()
            self.kept[text] = got
        return got

    def score(self, left: str, middle: str, right: str) -> float:
        """Log likelihood of middle and the four characters after it, after left."""
        text = left[-4:].rjust(4, "\x01") + middle + right[:4]
        return sum(self.log(text[i - 4 : i + 1]) for i in range(4, len(text)))

    def repair(self, left: str, word: str, right: str) -> str:
        """The likeliest reading of a word; the word itself if nothing is likelier."""
        for i, used, put in reversed(self.changes(left, word, right)):
            word = word[:i] + put + word[i + used :]
        return word

    def changes(self, left: str, word: str, right: str) -> tuple[tuple[int, int, str], ...]:
        """Viterbi search over the candidates of a word: place, characters read and what stands there, of each misreading."""
        start = left[-4:].rjust(4, "\x01")
        states: list[dict[str, tuple[float, str, tuple]]] = [{} for _ in range(len(word) + 1)]
        states[0][start] = (0.0, "", ())
        for i in range(len(word)):
            steps = [(word[i], 1, 0.0)] + [(b, len(a), self.prices.get((a, b), PRICE)) for a, b in self.readings.get(word[i], ()) if word.startswith(a, i)]
            for last, (score, made, done) in states[i].items():  # all: there are no more than ways to read four characters
                for put, used, price in steps:
                    now, value = last, score - price
                    for ch in put:
                        value += self.log(now + ch)
                        now = (now + ch)[1:]
                    target = states[i + used]
                    if now not in target or target[now][0] < value:
                        target[now] = (value, made + put, (*done, (i, used, put)) if price else done)
        best, same = None, None
        for last, (score, made, done) in states[-1].items():
            now, value = last, score
            for ch in right[:4]:
                value += self.log(now + ch)
                now = (now + ch)[1:]
            if made == word:
                same = value
            if best is None or value > best[0]:
                best = value, made, done
        if same is None:
            same = self.score(left, word, right)
        return best[2] if best and best[1] != word and best[0] > same + GAIN else ()

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """For each character the alternative in whose place its surroundings are rarer, by its number; -1 for none."""
        n = len(points)
        out = np.full(n, -1, dtype=np.int64)
        if n < 10:
            return out
        five = self.counts[5][gram_keys(points, 5, self.bits[5])]
        rare = five.copy()  # the rarest of the windows that cover a character
        for k in range(1, 5):
            rare[k:] = np.minimum(rare[k:], five[:-k])
        most = max(8.0, 2e-6 * self.total)
        at = np.flatnonzero(self.known[points] & (rare <= most))
        at = at[(at >= 4) & (at < n - 6)]
        best = np.zeros(n)
        for number, (read, real) in enumerate(ALTERNATIVES):
            sel = at[points[at] == ord(read[0])]
            if len(read) == 2:
                sel = sel[points[sel + 1] == ord(read[1])]
            if not len(sel):
                continue
            wide = np.stack([points[sel + k] for k in range(-4, 0)] + [np.full(len(sel), ord(ch), dtype=np.uint32) for ch in real] + [points[sel + len(read) + k] for k in range(4)])
            size = len(wide)
            new = np.stack([self.counts[5][gram_keys(wide[k : k + 5].T.reshape(-1), 5, self.bits[5])[::5]] for k in range(size - 4)])
            old = np.stack([five[sel - 4 + k] for k in range(4 + len(read))])
            gain = np.log(new + 0.5).mean(axis=0) - np.log(old + 0.5).mean(axis=0)
            better = (gain > 0.7) & (gain > best[sel])
            out[sel[better]] = number
            best[sel[better]] = gain[better]
        return out

    def occurrences(self, text: str) -> float:
        """How often one or two characters stand in the corpus."""
        return float(self.counts[1][min(ord(text), 0xFFFF)] if len(text) == 1 else self.counts[2][gram_key(tuple(map(ord, text)), self.bits[2])])


def line_kinds(lines: list[str], beside: str = "") -> list[str]:
    """'' , 'header' or 'page_no' for each line of a value.

    A line in capitals that the other side of the pair holds too is a title of its own, no running header.
    """
    out = [""] * len(lines)
    if len(lines) < 2:
        return out
    bare = 0
    for i, line in enumerate(lines):
        m = PAGE_NO.match(line)
        if m:
            out[i] = "page_no" if m[1] is None else "bare"
            bare += m[1] is not None
        elif HEADER.match(line) or CAPITALS.match(line) and line.strip().lower() not in {x.strip().lower() for x in beside.split("\n")}:
            out[i] = "header"
    body = [line for line, kind in zip(lines, out) if not kind]
    text = "\n".join(body)
    prose = bool(SENTENCE.search(re.sub(r"\.{3,}", "", text))) and bool(LOWER.search(text))
    for i, kind in enumerate(out):
        if not kind:
            continue
        if not prose or kind == "bare" and bare > 1:
            out[i] = ""
        elif kind == "bare":
            out[i] = "page_no"
    return out


def _words(line: str, at: list[int]) -> list[tuple[int, int]]:
    """Spans to search around candidate characters: the word in spaced text, some characters in Japanese."""
    spans: list[tuple[int, int]] = []
    for p in at:
        lo, hi = p, p + 1
        while lo > 0 and line[lo - 1] < "⺀" and not line[lo - 1].isspace():
            lo -= 1
        while hi < len(line) and line[hi] < "⺀" and not line[hi].isspace():
            hi += 1
        if line[p] >= "⺀" or lo and line[lo - 1] >= "⺀" or hi < len(line) and line[hi] >= "⺀":
            lo, hi = min(lo, max(0, p - 2)), max(hi, min(len(line), p + 3))
        if spans and p < spans[-1][1]:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return spans


def running(lines: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The text as it runs on, in lower case, and line and column of each of its characters."""
    out: list[str] = []
    where: list[tuple[int, int]] = []
    for k, line in enumerate(lines):
        inside = len(out) > 1 and out[-2] >= "⺀" and out[-1] > " " and line[:1] >= "⺀"
        if k and out and out[-1] < "⺀" and not inside:
            out.append(" ")
            where.append((k, -1))
        for c, ch in enumerate(line):
            out.append(ch.lower() if "A" <= ch <= "Z" else ch)
            where.append((k, c))
    return "".join(out), where


def divided(model: Model, before: str, after: str) -> bool:
    """Whether the word at the end of one line goes on in the next.

    Characters more than four before the division weigh the same either way, so of a long word its end is enough.
    """
    m = DIVIDED.search(before)
    if not m or not after[:1].isalpha():
        return False
    left, mark, right = before[: m.start()].lower(), m[1], after.lower()
    tail, head = WORD_END.search(left)[0][-12:], WORD_BEGIN.match(right)[0][:12]
    ctx = left[: len(left) - len(tail)]
    end = right[len(head) : len(head) + 4]
    joined = model.score(ctx, tail + head, end)
    fixed = model.repair(ctx[-4:], tail + head, end)
    if fixed != tail + head:
        joined = max(joined, model.score(ctx, fixed, end) - PRICE)
    rivals = [model.score(ctx, tail + " " + head, end)]
    if mark in "-‑":
        rivals.append(model.score(ctx, tail + "-" + head, end))
        rivals.append(model.score(ctx, tail + "- " + head, end) - 6.0)
    return joined > max(rivals)


class Draft:
    """A value on its way: lines classed, divided words put together, ready to be searched for misread characters."""

    def __init__(self, model: Model, value: str, beside: str):
        lines = value.split("\n")
        kinds = line_kinds(lines, beside)
        self.found = [(kind, k) for k, kind in enumerate(kinds) if kind]
        kept = [k for k, kind in enumerate(kinds) if not kind]
        joins = set()
        for a, b in zip(kept, kept[1:]):
            if divided(model, lines[a], lines[b].lstrip()):
                self.found.append(("hyphen", a))
                joins.add(a)
        self.glued: list[str] = []  # lines joined over divided words
        self.first: list[list[int]] = []
        for k in kept:
            line = DIVIDED.sub("", lines[k]) if k in joins else lines[k]
            if self.glued and self.first[-1][-1] in joins:
                self.glued[-1] += line.lstrip()
                self.first[-1].append(k)
            else:
                self.glued.append(line)
                self.first.append([k])

    def repair(self, model: Model, text: str, where: list[tuple[int, int]], at: list[int]) -> None:
        """Decode the words around candidate characters; what is misread is replaced in the line where it stands."""
        for lo, hi in reversed(_words(text, at)):
            changes = model.changes(text[max(0, lo - 4) : lo], text[lo:hi], text[hi : hi + 4] + "\x01" * max(0, 4 - len(text) + hi))
            old = "".join(self.glued[k][c] if c >= 0 else " " for k, c in where[lo:hi])
            for i, used, put in reversed(changes):
                k, c = where[lo + i]
                self.glued[k] = self.glued[k][:c] + _cased(old, old[i], put) + self.glued[k][c + used :]
            for k in sorted({where[lo + i][0] for i, _, _ in changes}):
                self.found.append(("misread", self.first[k][0]))

    def paragraph(self) -> str:
        out = ""
        for line in self.glued:
            wrapped = out and not out.endswith(("。", "\n"))
            out = line if not out else out + ("" if wrapped and out[-1] >= "⺀" else " " if wrapped else "") + line
        return out


def drafts(model: Model, values: list[tuple[str, str, bool]]) -> list[Draft]:
    """Finished drafts of (value, other side, search for misread characters) triples; all are searched in one go."""
    done = [Draft(model, value, beside) for value, beside, _ in values]
    # some misread words only show when the lines or marks between their parts are gone
    sought = [(draft, *running(draft.glued)) for draft, (_, _, marked) in zip(done, values) if marked or draft.found]
    if sought:
        gap = np.full(10, END, dtype=np.uint32)
        pieces_, begin, size = [gap], [], 10
        for _, text, _ in sought:
            begin.append(size)
            pieces_ += [np.array(list(map(ord, text)), dtype=np.uint32), gap]
            size += len(text) + 10
        hits = np.flatnonzero(model.candidates(np.concatenate(pieces_)) >= 0)
        cuts = np.searchsorted(hits, begin)
        ends = np.searchsorted(hits, [b + len(text) for b, (_, text, _) in zip(begin, sought)])
        for (draft, text, where), b, lo, hi in zip(sought, begin, cuts, ends):
            if lo < hi:
                draft.repair(model, text, where, (hits[lo:hi] - b).tolist())
    return done


def _cased(word: str, read: str, put: str) -> str:
    """What stands in place of characters read, with the capitals of the word or of the first of them."""
    if word.isupper() and any(c.isalpha() for c in word):
        return put.upper()
    return put[:1].upper() + put[1:] if read.isupper() else put


def sized(rows: int) -> dict[int, int]:
    """Bits of the tables for so many rows: distinct n-grams grow with about the root of the rows, tables with them up to a bound."""
    more = max(0, math.ceil(0.57 * math.log2(max(rows, 1) / BASE_ROWS)))
    return {order: min(bits + more, max(bits, MOST_BITS - (order != 5))) if order > 1 else bits for order, bits in ORDERS.items()}


def char_model(translations: DataFrame) -> dict[int, np.ndarray]:
    return tables(translations.select(F.col("text").cast("string"), F.col("translation").cast("string")), sized(translations.count()), flow, END)


class Scan:
    """Values of a corpus that may be noisy, and all that is made of them; the corpus is read twice, once to count n-grams."""

    def __init__(self, translations: DataFrame):
        src = translations.select(F.col("row_id").cast("long"), F.col("text").cast("string"), F.col("translation").cast("string"))
        counts = char_model(translations)
        self.shared = src.sparkSession.sparkContext.broadcast(counts)
        self.suspects = cut(src.mapInArrow(_suspicious(self.shared), _SUSPECT))
        self.prices = confusion_prices(Model(counts), self.suspects)

    def drafts(self, repair: bool) -> DataFrame:
        """(row_id, field, found, repaired) of each suspect: its traces (noise, line_no), and if asked for the repaired text."""
        shared, prices = self.shared, self.prices

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(shared.value, prices)
            for batch in batches:
                for part in pieces(batch, 2, 3):
                    own = zip(part.column("value").to_pylist(), part.column("beside").to_pylist(), part.column("reads").to_pylist())
                    done = drafts(model, [(value, beside or "", bool(reads)) for value, beside, reads in own])
                    found = [[{"noise": noise, "line_no": line} for noise, line in d.found] for d in done]
                    text = pa.array([d.paragraph() if repair and d.found else None for d in done], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("field"), pa.array(found, _FOUND), text], names=["row_id", "field", "found", "repaired"])

        return self.suspects.mapInArrow(run, "row_id long, field string, found array<struct<noise:string,line_no:long>>, repaired string")


_FOUND = pa.list_(pa.struct([("noise", pa.string()), ("line_no", pa.int64())]))
_SUSPECT = "row_id long, field string, value string, beside string, reads array<int>"


def confusion_prices(model: Model, suspects: DataFrame) -> dict[tuple[str, str], float]:
    """Price of each confusion, from how many candidates of it all values have and how often what it stands for occurs."""
    seen = {r[0]: r[1] for r in suspects.select(F.explode("reads").alias("k")).groupBy("k").count().collect()}  # a number an alternative
    out = {}
    for k, (read, real) in enumerate(ALTERNATIVES):
        n = seen.get(k, 0)
        p = (n + 0.5) / (model.occurrences(real) + n + 1.0)
        out[read, real] = min(DEAREST, max(CHEAPEST, -CHANNEL * math.log(min(p, 0.5))))
    return out


def _suspicious(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            for part in pieces(batch, 1, 2):
                for field in ("text", "translation"):
                    column, other = part.column(field), part.column("translation" if field == "text" else "text")
                    own = list(_suspects(model, column))
                    take = pa.array([o[0] for o in own], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_id").take(take), pa.array([field] * len(own), pa.string()), pa.array([o[1] for o in own], pa.string()), other.take(take), pa.array([o[2] for o in own], pa.list_(pa.int32()))],
                        names=["row_id", "field", "value", "beside", "reads"],
                    )

    return run


def _suspects(model: Model, column: pa.Array) -> Iterator[tuple[int, str, list[int]]]:
    """Row, value and the confusions of its candidate characters, of the values that may be noisy."""
    points, offsets = separated(column, END)
    rows = np.repeat(np.arange(len(column) + 1), np.diff(np.append(offsets, len(points))))
    gap = np.full(10, END, dtype=np.uint32)  # no value stands at the edge of the array
    which = model.candidates(np.concatenate([gap, flow(points), gap]))[10:-10]
    hits = np.flatnonzero(which >= 0)
    reads: dict[int, list[int]] = {}
    for row, number in zip(rows[~unbroken(points)][hits].tolist(), which[hits].tolist()):
        reads.setdefault(row, []).append(number)
    at = np.union1d(np.array(sorted(reads), dtype=np.int64), np.unique(rows[points == 0x0A]))
    at = at[at < len(column)]
    for i, value in zip(at.tolist(), column.take(pa.array(at, pa.int64())).to_pylist()):
        if value is not None and (i in reads or HINT.search(value)):
            yield i, value, reads.get(i, [])


def _traces(done: DataFrame, translations: DataFrame, meta: DataFrame) -> DataFrame:
    """(row_id, field, noise, line_no) of each trace outside the lines that are repeated in their source."""
    each = done.select("row_id", "field", F.explode("found").alias("f")).select("row_id", "field", "f.noise", "f.line_no")
    repeated = repeated_lines(translations, meta).withColumn("field", F.lit("text"))
    return each.join(repeated, ["row_id", "line_no", "field"], "left_anti").select("row_id", "field", "noise", "line_no")


def noisy_values(translations: DataFrame, meta: DataFrame) -> DataFrame:
    """(row_id, field, noise, line_no) of each trace of the scanned page outside the lines that are repeated in their source."""
    return _traces(Scan(translations).drafts(False), translations, meta)


def repaired_values(translations: DataFrame, meta: DataFrame) -> DataFrame:
    """(row_id, field, repaired) of each noisy value, as continuous paragraphs; row_id must be unique."""
    done = cut(Scan(translations).drafts(True).where("size(found) > 0"))
    noisy = _traces(done.select("row_id", "field", "found"), translations, meta).select("row_id", "field").distinct()
    return done.select("row_id", "field", "repaired").join(noisy, ["row_id", "field"], "left_semi")
