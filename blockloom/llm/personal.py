"""Personal information in free text, found by a semi-Markov conditional random field.

Candidate segments come from shapes: runs of digit groups and all their parts, at signs, components of addresses, and all
spans of up to four words in a run of capitalised ones or of a few characters in a run of kanji; beside words that tell of
a name also lower-case and kana spans.  Whole-span features score each candidate: its shape, length and parts, common
names among them, and the words on both sides.  What a span itself contributes is kept, and the words beside it are only
looked at where the best of them could make it a mention.  Dynamic programming over segments that do not overlap chooses
boundaries and types jointly; weights are fitted by conditional likelihood on synthetic sentences.
Mentions are given exactly as they stand in the text.

Defined results: null and empty texts have no mention and stay as they are; texts of any length are read whole;
repeated mentions of a document count once in the list and are each replaced; empty tables give empty results.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import person_names, personal_synthesis as synthesis
from blockloom.llm.arrow_text import pieces

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
EPOCHS, RATE, SHRINK = 6, 0.25, 1e-4
SENTENCES = 7000
#: Score a segment must reach to be chosen.
LEAST = 0.0

_fold = {**{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, "\u3000": " ", "\xa0": " ", **dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-")}
_folded = re.compile("[！-～\u3000\xa0\u2010-\u2013\u2212]")

LETTER = r"A-Za-zÀ-ÖØ-öø-ɏ"
_label = rf"[{LETTER}0-9](?:[{LETTER}0-9\-]*[{LETTER}0-9])?"
_local = rf"(?<![{LETTER}0-9._+\-@])[{LETTER}0-9](?:[{LETTER}0-9._%+'\-]*[{LETTER}0-9])?"
_at, _dot = r"(?: ?[\[(<{] ?at ?[\])>}] ?| at |_at_)", r"(?: ?[\[(<{] ?(?:dot|point) ?[\])>}] ?| dot |_dot_)"
EMAILS = (
    re.compile(rf"{_local} ?@ ?{_label}(?:\.{_label})+", re.IGNORECASE),
    re.compile(rf"{_local}(?: ?[\[(<{{] ?at ?[\])>}}] ?|_at_){_label}(?:(?:{_dot}|\.){_label})+", re.IGNORECASE),
    re.compile(rf"{_local} at {_label}(?: dot {_label})+", re.IGNORECASE),
    re.compile(rf"{_local}@{_label}(?:{_dot}{_label})+", re.IGNORECASE),
)
_ext = r"(?:,? ?(?:ext\.?|extension|x|内線|#) ?\d{1,5}(?!\d))?"
_edge, _end = r"(?<![A-Za-z0-9_#/.,\-])", r"(?![A-Za-z0-9_])"
NUMBERS = (
    re.compile(rf"{_edge}(?:\+\d{{1,3}}[ .\-]?)?(?:\(\d{{1,5}}\)[ .\-]?)?\d{{1,13}}(?:[ .\-/](?:\(\d{{1,5}}\)|\d{{1,7}})){{0,5}}{_ext}(?!\d)"),
    re.compile(rf"{_edge}[A-Z]{{1,3}}[ \-]?\d{{2,12}}(?:[ \-]\d{{2,8}}){{0,3}}[A-Z]?{_end}"),
    re.compile(rf"{_edge}\d{{3,8}}[ \-]?\d{{3,8}}[A-Z]{_end}"),
)
_cap = rf"[A-ZÀ-ÖØ-Þ][{LETTER}'’.\-]*"
_place = rf"[A-ZÀ-ÖØ-Þ][{LETTER}'’\-]*"
_town = rf"{_place}(?: {_place}){{0,2}}"
_code = r"(?:[A-Z]{2} \d{4,6}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|\d{3}-\d{4}|\d{4,6})"
_sep = r"(?:, ?|,?\n)"
#: Forms of addresses, each with a pattern of what a text must hold for it to match anywhere.
ADDRESSES = tuple(
    (re.compile(sign), re.compile(form))
    for sign, form in (
        (r"[0-9] ", rf"(?<![A-Za-z0-9_])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) ?\w{{1,5}}{_sep})?\d{{1,5}}[A-Za-z]? {_cap}(?: {_cap}){{0,3}}{_sep}{_town}(?:,? ?\n?{_code})?(?![A-Za-z0-9_])"),
        ("Box ", rf"(?<![A-Za-z0-9_])P\.? ?O\.? ?Box \d{{1,6}}{_sep}{_town}(?:,? {_code})?(?![A-Za-z0-9_])"),
        ("gasse|str(?:aße|asse|[.])|weg|platz|allee|ring|damm|ufer", rf"(?<![A-Za-z0-9_]){_cap}(?:gasse|str(?:aße|asse|\.)|weg|platz|allee|ring|damm|ufer) \d{{1,4}} ?[a-z]?{_sep}\d{{4,5}} {_town}(?![A-Za-z0-9_])"),
        (r"[0-9]-[0-9]", rf"(?<![A-Za-z0-9_\-])\d{{1,3}}-\d{{1,3}}(?:-\d{{1,4}})? {_town}{_sep}{_town}(?:{_sep}{_town})?(?: \d{{3}}-\d{{4}})?(?![A-Za-z0-9_])"),
        ("rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours", rf"(?<![A-Za-z0-9_])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours) [{LETTER}'’\- ]{{2,40}}{_sep}\d{{5}} {_town}(?![A-Za-z0-9_])"),
        ("Calle|Avenida|Avda|Plaza|Paseo|Camino|Via|Piazza|Corso|Rua|Travessa", rf"(?<![A-Za-z0-9_])(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Rua|Travessa) [{LETTER}'’\- ]{{2,40}},? (?:n[.º°]? ?)?\d{{1,4}}{_sep}\d{{4,5}}(?:-\d{{3}})? {_town}(?![A-Za-z0-9_])"),
        ("[市区町村郡]", r"(?:〒 ?\d{3}-?\d{4}[ \n]?)?(?:[一-鿿]{2,3}[都道府県][一-鿿ヶノケ]{1,5}|(?<![一-鿿])[一-鿿ヶノケ]{1,4})[市区町村郡][一-鿿ヶノケのぁ-ん]{0,8}?\d{1,3}(?:-\d{1,4}){0,3}(?:丁目\d{1,3}(?:番地?|-)?(?:\d{1,3}号?)?)?(?: ?[一-鿿ァ-ヴーぁ-ん]{2,10}\d{1,4}(?:号室|号)?)?"),
    )
)
_w = rf"[{LETTER}][{LETTER}'’\-]*+(?![\u0300-\u036F])\.?"
_word_cap = rf"(?:[A-ZÀ-ÖØ-Þ]\.|[A-ZÀ-ÖØ-Þ][{LETTER}'’\-]*+(?![\u0300-\u036F]))"
PARTICLES = frozenset("de da di du del della der den van von la le bin al zu ter dos das".split())
#: Runs of capitalised words and initials, particles between, on one line.
CAPITALS = re.compile(rf"(?<![{LETTER}0-9_'’\-@#/.°]){_word_cap}(?:,? (?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}{_word_cap})+(?![0-9_@])")
MOST_WORDS = 4
AFTER = re.compile(  # words before a name
    r"(?:\b(?:name is|name's|i am|i'm|this is|bought it from|got it from|it from|from|ask for|contact|the seller,|seller|the buyer,|buyer|owner|collector|mr\.?|mrs\.?|ms\.?|miss|dr\.?|prof\.?|dear|hi|hello|signed by|signed|sold by|written by|thanks to|thank you,|attn:?|c/o|sender:|recipient:|(?:signed|name|from|by|sender|seller|buyer|owner|author|attn|contact|recipient):|regards,|wishes,|sincerely,|cheers,|yours,|thanks,|greetings,|best,))[ \n]"
)
AFTER_ANY = re.compile(f"(?i:{AFTER.pattern})")
BEFORE = re.compile(r"(?= (?:translated|answered|packed|wrote|sent|sold|bought|signed|called|told|asked|collects|lives|repaired|shipped|gave|and I)\b|, (?:packed|wrote|sent|sold|who|my)\b)")
NAME = re.compile(rf"{_w}(?:,? {_w}){{0,3}}")
_kanji = r"一-鿿々〆ヶノケ"
JP_BEFORE = re.compile("さん|さま|ちゃん|様|氏|と申します|と言います|といいます")
JP_AFTER = re.compile(r"(?:差出人[：:]|担当の|担当[：:]|氏名[：:]|名前は|名前[：:]|宛名[：:]|発送者[：:]|私は|署名[：:]|依頼者[：:])\s?")
KANJI_RUN = re.compile(r"(?<![一-鿿々〆ヶ])[一-鿿々〆ヶ]{2,6}(?![一-鿿々〆ヶ])")
JP_COMMON = re.compile(rf"(?:{'|'.join(sorted(person_names.JP_FAMILY, key=lambda x: -len(x)))})(?=( ?[一-鿿々]{{1,3}}| ?[ぁ-ん]{{2,3}}|[ァ-ヴー]{{2,3}}))")
JP_NAME = re.compile(rf"[{_kanji}]{{1,4}}[ ]?[{_kanji}ぁ-んァ-ヴー]{{0,5}}|[ぁ-ん]{{2,7}} [ぁ-ん]{{1,6}}|[ァ-ヴー]{{2,7}}[ ・][ァ-ヴー]{{1,6}}")


def fold(text: str) -> str:
    """Width and hyphens unified, each character at its place."""
    return _folded.sub(lambda m: _fold[m[0]], text)


def _shape(span: str) -> str:
    out = re.sub(r"\d+", lambda m: str(len(m[0])) + "d", span)
    return re.sub(r"[A-Z]+", lambda m: str(len(m[0])) + "A", out)


def _case(word: str) -> str:
    bare = word.rstrip(".")
    if len(bare) == 1:
        return "I." if word.endswith(".") and bare.isupper() else "I" if bare.isupper() else "i"
    return ("AA" if bare.isupper() else "Aa" if bare[0].isupper() else "aa") + ("." if word.endswith(".") else "")


def _script(text: str) -> str:
    return "".join("K" if "一" <= c <= "鿿" or c in "々ヶノ" else "h" if "ぁ" <= c <= "ん" else "k" if "ァ" <= c <= "ー" else " " if c == " " else "x" for c in text)


_word = re.compile(rf"[{LETTER}]+|[一-鿿ァ-ヴー]+|[ぁ-ん]|[0-9]+|[^\s]|\n")


def _left(text: str, start: int) -> list[str]:
    """Features of the words before a place."""
    left = _word.findall(text[max(0, start - 32) : start].lower())[-3:] if start else ["^"]
    return [f"l1={left[-1] if left else ''}", f"l2={' '.join(left[-2:])}", f"l3={' '.join(left)}", *(f"lw={w}" for w in left)]


def _right(text: str, end: int) -> list[str]:
    """Features of the words after a place."""
    right = _word.findall(text[end : end + 32].lower())[:3] if text[end : end + 1] else ["$"]
    return [f"r1={right[0] if right else ''}", f"r2={' '.join(right[:2])}", f"r3={' '.join(right)}", *(f"rw={w}" for w in right)]


def _inner(span: str, kind: str) -> list[str]:
    """Features of a span as it stands."""
    out = ["bias"]
    if kind in ("phone", "id_number"):
        shape = _shape(span)
        digits = re.sub(r"\D", "", span)
        out += [f"shape={shape}", f"digits={len(digits)}", f"form={re.sub(r'[0-9]+d', 'd', shape)}", f"first={digits[:1]}", f"two={digits[:2]}", f"plus={span[0] == '+'}", f"paren={'(' in span}", f"letters={bool(re.search('[A-Z]', span))}",
                f"letters={bool(re.search('[A-Z]', span))} digits={len(digits)}", f"ext={bool(re.search('(?i)ext|x|内線|#', span))}", f"zero={digits[:1] == '0'} {shape}", f"dot={'.' in span}", f"slash={'/' in span}"]
    elif kind == "email":
        out += [f"at={'@' in span}", f"dots={span.count('.') + span.lower().count('dot')}", f"long={len(span) > 60}", f"spaces={span.count(' ')}"]
    elif kind == "address":
        out += [f"lines={span.count(chr(10))}", f"commas={span.count(',')}", f"code={bool(re.search(_code + '$', span))}", f"mark={'〒' in span}", f"jp={bool(re.search('[一-鿿]', span))}", f"end={_shape(span[-9:])}",
                f"street={bool(re.search(r'(?i)\b(?:st|street|road|rd|lane|ln|ave|avenue|walk|way|drive|court|close|box|square|hill|row|terrace|boulevard|blvd|rue|quai|place|allée|calle|avenida|plaza|paseo|via|viale|piazza|corso|rua)\b|gasse|stra(?:ss|ß)e|weg|platz|allee', span))}",
                f"digits={min(4, len(re.findall('[0-9]+', span)))}", f"tail={(re.findall(r'[^0-9\s]+', span) or [''])[-1][-3:]}", f"region={bool(re.match('(?:〒[ 0-9-]+[ \\n]?)?[一-鿿]{2,3}[都道府県]', span))}"]
    elif re.search("[぀-鿿]", span):
        script = _script(span)
        common = person_names.japanese_kind(span)
        out += [f"script={script}", f"size={len(span)}", f"runs={re.sub(r'(.)\1+', r'\1', script)}", f"word={span}", f"tail={span[-1]}", f"head={span[0]}", f"common={common}", f"common={common} {len(span)}"]
    else:
        words = re.findall(rf"[{LETTER}'’\-]+\.?", span)
        cases = _cases(span)
        common = "".join(map(person_names.latin_kind, words)) + ("," if "," in span else "")
        out += [f"cases={cases}", f"n={len(words)}{',' in span}", f"stop={any(w.lower() in synthesis.STOPWORDS for w in words)}", f"stopend={words[-1].lower() in synthesis.STOPWORDS}", f"line={chr(10) in span}",
                f"common={common}", f"common={common} {cases}", f"named={any(c != '-' for c in common)}"]
        out += [f"tok={w.lower()}" for w in words]
    return [f"{kind}:{f}" for f in out]


@lru_cache(maxsize=50_000)
def _cases(span: str) -> str:
    words = re.findall(rf"[{LETTER}'’\-]+\.?", span)
    return " ".join("p" if w in PARTICLES else _case(w) for w in words) + ("," if "," in span else "")


def _near(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of what touches a name."""
    if kind != "name":
        return []
    if "\u3040" <= max(text[start:end]):
        return [f"join={_script(text[start - 1 : start]) or '^'}{_script(text[start])}", f"ends={_script(text[end - 1])}{_script(text[end : end + 1]) or '$'}", f"after={text[end : end + 2]}"]
    return [f"next={text[end : end + 1].isspace() or not text[end : end + 1]}", f"more={bool(_more.match(text, end))}", f"prior={bool(_prior.search(text[max(0, start - 20) : start]))}"]


_more, _prior = re.compile("[ ,]+[A-ZÀ-Þ]"), re.compile("[A-ZÀ-Þ][^ ,.]*,? $")


def _crossed(span: str, kind: str, left: list[str], right: list[str]) -> list[str]:
    """Features of the words beside a name together with its capitals."""
    if kind != "name" or "\u3040" <= max(span):
        return []
    cases = _cases(span)
    return [f"{left[0]} {cases}", f"{right[0]} {cases}"]


def _features(text: str, start: int, end: int, kind: str) -> list[str]:
    left, right = ([], []) if kind == "email" else (_left(text, start), _right(text, end))
    if kind in ("address", "name"):  # the words beside these count by their place only
        left, right = left[:3], right[:3]
    return _inner(text[start:end], kind) + [f"{kind}:{f}" for f in [*_near(text, start, end, kind), *left, *right, *_crossed(text[start:end], kind, left, right)]]


def _number_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """All runs of neighbouring digit groups of a match, six to eighteen digits long; the first with its sign and bracket."""
    groups = list(re.finditer(r"[+(]*\w+\)?", text[start:end]))
    for i, first in enumerate(groups):
        size = 0
        for last in groups[i:]:
            size += sum(map(str.isdigit, last[0]))
            if size > 18:
                break
            if size >= 6:
                yield start + first.start(), start + last.end()


#: What a disguised at sign looks like, in lower case.
_at_sign = re.compile("[(<{[] ?at|_at_")
_japanese = re.compile("[぀-鿿]")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Segments that may be mentions, by start."""
    found: set[tuple[int, int, str]] = set()
    at, low = "@" in text, text.lower()
    signs = at, _at_sign.search(low) is not None, " dot " in low, at
    for m in (m for sign, pattern in zip(signs, EMAILS) if sign for m in pattern.finditer(text)):
        found.add((m.start(), m.end(), "email"))
    for m in (m for pattern in NUMBERS for m in pattern.finditer(text)):
        size = sum(c.isdigit() for c in m[0])
        if size < 6:
            continue
        spans = {(m.start(), m.end())} if size <= 18 else set()
        core = re.sub(rf"{_ext}$", "", m[0])
        if core != m[0] and len(core) > 5:
            found.add((m.start(), m.start() + len(core), "phone"))
        if len(core) < len(m[0]) or re.search(r"[ ./(+]", core):
            spans.update(_number_parts(text, m.start(), m.start() + len(core)))
        if len(core) < len(m[0]):
            spans.update((a, m.end()) for a, b in list(spans) if b == m.start() + len(core))
        for a, b in spans:
            found.add((a, b, "phone"))
            found.add((a, b, "id_number"))
    for m in (m for sign, form in ADDRESSES if sign.search(text) for m in form.finditer(text)):
        found.add((m.start(), m.end(), "address"))
        for cut in re.finditer(rf"{_code}|{_sep}| ", m[0]):  # shorter ones that end at a component
            if cut.start() > 8:
                found.add((m.start(), m.start() + (cut.end() if cut[0][-1].isalnum() else cut.start()), "address"))
    japanese = _japanese.search(text) is not None
    for m in CAPITALS.finditer(text):
        words = list(re.finditer(rf"[{LETTER}'’\-]+\.?", m[0]))
        for i, first in enumerate(words):
            for last in words[i + 1 : i + MOST_WORDS]:
                span = m[0][first.start() : last.end()]
                if span.count(",") < 2 and first[0] not in PARTICLES and last[0] not in PARTICLES:
                    found.add((m.start() + first.start(), m.start() + last.end(), "name"))
    # capitals don't matter here: lower-case text is searched, unless lower case moves its characters
    for m in AFTER.finditer(low) if len(low) == len(text) else AFTER_ANY.finditer(text):
        n = NAME.match(text, m.end())
        if n:
            for w in re.finditer(_w, n[0]):
                found.add((n.start(), n.start() + w.end(), "name"))
                if w[0].endswith("."):
                    found.add((n.start(), n.start() + w.end() - 1, "name"))
    for m in BEFORE.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        head = text[max(line, m.start() - 48) : m.start()]
        words = list(re.finditer(_w, head))[-4:]
        for w in words:
            span = head[w.start() :]
            if re.fullmatch(rf"{_w}(?:,? {_w}){{0,3}}", span):
                found.add((m.start() - len(span), m.start(), "name"))
    if not japanese:
        return sorted(found)
    for m in KANJI_RUN.finditer(text):
        found.add((m.start(), m.end(), "name"))
    for m in JP_COMMON.finditer(text):
        for k in range(m.end(1) - m.start(1) + 1):
            found.add((m.start(), m.start(1) + k, "name"))
    for m in JP_BEFORE.finditer(text):
        head = text[max(0, m.start() - 12) : m.start()]
        for k in range(1, len(head) + 1):
            if JP_NAME.fullmatch(head[-k:]):
                found.add((m.start() - k, m.start(), "name"))
    for m in JP_AFTER.finditer(text):
        for k in range(1, 13):
            span = text[m.end() : m.end() + k]
            if len(span) == k and JP_NAME.fullmatch(span):
                found.add((m.end(), m.end() + k, "name"))
    return sorted(found)


_crossing = re.compile(r" (?:[AaIip]+\.?)(?: [AaIip]+\.?)*,?$")


class Field:
    """Weights of features, and inference over the candidates of a text."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self.kept: dict[tuple[str, str], float] = {}
        self.most: dict[str, tuple[dict[str, float], dict[str, float]]] = {}
        self.touch: dict[tuple[str, ...], float] = {}

    def bounds(self, kind: str) -> tuple[dict[str, float], dict[str, float]]:
        """What the words before and after a span can add at most, by the nearest character; under "" where no feature has it.

        Of each template the largest weight counts, as often as the template may occur.
        """
        got = self.most.get(kind)
        if got is not None:
            return got
        out = []
        for side, near in (("l", -1), ("r", 0)):
            top: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            for f, w in self.weights.items():
                own, _, rest = f.partition(":")
                name, _, words = rest.partition("=")
                if own == kind and w > 0 and name in (f"{side}1", f"{side}2", f"{side}3", f"{side}w") and words:
                    m = _crossing.search(words) if name[1] == "1" else None
                    key = words[: m.start()] if m else words
                    group = top[name + (" " if m else "")]
                    group[key[near : near + 1 or None]] = max(group[key[near : near + 1 or None]], w)
            rest = 2.0 * max(top[f"{side}w"].values(), default=0.0)  # the other words, wherever they stand
            chars = {c for group in top.values() for c in group}
            bound = {c: rest + sum(group.get(c, 0.0) for group in top.values()) for c in chars}
            bound[""] = rest
            out.append(bound)
        self.most[kind] = got = tuple(out)
        return got

    def touching(self, text: str, a: int, b: int, kind: str) -> float:
        """Score of what touches a name."""
        if kind != "name":
            return 0.0
        if text[a] < "\u3040" and max(text[a:b]) < "\u3040":
            return sum(self.weights.get(f"name:{f}", 0.0) for f in _near(text, a, b, kind))
        key = text[a - 1 : a], text[a], text[b - 1], text[b : b + 2]
        got = self.touch.get(key)
        if got is None:
            if len(self.touch) > 200_000:
                self.touch.clear()
            got = self.touch[key] = sum(self.weights.get(f"name:{f}", 0.0) for f in _near(text, a, b, kind))
        return got

    def scored(self, text: str) -> list[tuple[int, int, str, float]]:
        """Candidates that may be mentions, with their scores; those that no surroundings could make one are left out.

        The words beside a span are only looked at if the best ones that end or begin with its neighbours could make it one.
        """
        get, kept, out = self.weights.get, self.kept, []
        for a, b, kind in candidates(text):
            span = text[a:b]
            score = kept.get((kind, span))
            if score is None:
                if len(kept) > 200_000:
                    kept.clear()
                score = kept[kind, span] = sum(get(f, 0.0) for f in _inner(span, kind))
            if kind != "email":
                score += self.touching(text, a, b, kind)
                before, after = self.bounds(kind)
                i, j = a - 1, b
                while i >= 0 and text[i] != "\n" and text[i].isspace():
                    i -= 1
                while j < len(text) and text[j] != "\n" and text[j].isspace():
                    j += 1
                most = before.get(text[i].lower() if i >= 0 else "^", before[""]) + after.get(text[j].lower() if j < len(text) else "$", after[""])
                if i < 0 <= a - 1 or j == len(text) > b:  # only white space stands there
                    most += max(before.values()) + max(after.values())
                if score + most <= LEAST:
                    continue
                left, right = _left(text, a), _right(text, b)
                few = 3 if kind in ("address", "name") else 6
                score += sum(get(f"{kind}:{f}", 0.0) for f in left[:few]) + sum(get(f"{kind}:{f}", 0.0) for f in right[:few])
                score += sum(get(f"{kind}:{f}", 0.0) for f in _crossed(span, kind, left, right))
            out.append((a, b, kind, score))
        return out

    def best(self, text: str) -> list[tuple[int, int, str]]:
        """Segments that don't overlap with the highest sum of scores (text outside of segments counts 0)."""
        items = sorted((s for s in self.scored(text) if s[3] > LEAST), key=lambda s: (s[1], s[0]))
        if not items:
            return []
        ends = [s[1] for s in items]
        top: list[float] = [0.0] * (len(items) + 1)
        back: list[int | None] = [None] * (len(items) + 1)
        for i, (a, _, _, score) in enumerate(items, 1):
            before = bisect_right(ends, a, 0, i - 1)
            if top[before] + score > top[i - 1]:
                top[i], back[i] = top[before] + score, before
            else:
                top[i] = top[i - 1]
        out, i = [], len(items)
        while i > 0:
            if back[i] is None:
                i -= 1
            else:
                a, b, kind, _ = items[i - 1]
                out.append((a, b, kind))
                i = back[i]
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int, str]]]], seed: int) -> None:
        """Stochastic gradient ascent of the conditional log-likelihood of the segments."""
        prepared = []
        for text, gold in examples:
            items = sorted(candidates(text), key=lambda s: (s[1], s[0]))
            feats = [_features(text, *s) for s in items]
            truth = set(gold)
            prepared.append((items, feats, [s in truth for s in items]))
        rng = random.Random(seed)
        w = self.weights
        for epoch in range(EPOCHS):
            rng.shuffle(prepared)
            rate = RATE / (1 + epoch)
            for items, feats, gold in prepared:
                if not items:
                    continue
                scores = [sum(w[f] for f in fs) for fs in feats]
                for fs, target, p in zip(feats, gold, _marginals(items, scores)):
                    g = target - p
                    if abs(g) > 1e-3:
                        for f in fs:
                            w[f] += rate * (g - SHRINK * w[f])


def _marginals(items: list[tuple[int, int, str]], scores: list[float]) -> list[float]:
    """Probability of each segment, by forward and backward sums over segmentations."""
    n = len(items)
    if n == 1:
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, scores[0]))))]
    points = sorted({p for a, b, _ in items for p in (a, b)})
    at = {p: i for i, p in enumerate(points)}
    m = len(points)
    by_end, by_start = defaultdict(list), defaultdict(list)
    for i, (a, b, _) in enumerate(items):
        by_end[at[b]].append(i)
        by_start[at[a]].append(i)
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    forward = [0.0] * m
    for p in range(1, m):
        forward[p] = forward[p - 1]
        for i in by_end[p]:
            forward[p] = add(forward[p], forward[at[items[i][0]]] + scores[i])
    backward = [0.0] * m
    for p in range(m - 2, -1, -1):
        backward[p] = backward[p + 1]
        for i in by_start[p]:
            backward[p] = add(backward[p], backward[at[items[i][1]]] + scores[i])
    total = forward[m - 1]
    return [math.exp(min(0.0, forward[at[a]] + scores[i] + backward[at[b]] - total)) for i, (a, b, _) in enumerate(items)]


@cache
def trained(seed: int = 11) -> Field:
    """The field fitted on synthetic sentences; the same in every process."""
    field = Field()
    field.learn([(fold(text), gold) for text, gold in synthesis.sentences(SENTENCES, seed)], seed)
    field.weights = {f: w for f, w in field.weights.items() if abs(w) > 0.01}
    field.kept, field.most, field.touch = {}, {}, {}
    return field


def mentions(field: Field, text: str) -> list[tuple[int, int, str]]:
    return field.best(fold(text))


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = weights.value
        for batch in batches:
            for part in pieces(batch, 1):
                ids, kinds, found = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        for kind, mention in dict.fromkeys((kind, text[a:b]) for a, b, kind in mentions(field, text)):
                            ids.append(i)
                            kinds.append(kind)
                            found.append(mention)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["doc_id", "kind", "mention"])

    return run


def personal_mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, mention), each triple once."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())
    src = documents.select("doc_id", F.col("text").cast("string"))
    return src.mapInArrow(_find(shared), f"doc_id {dict(src.dtypes)['doc_id']}, kind string, mention string").distinct()


def without_personal(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a typed placeholder for each mention, the rest unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                for a, b, kind in reversed(mentions(field, text) if text else []):
                    text = text[:a] + PLACEHOLDERS[kind] + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    src = documents.select("doc_id", F.col("text").cast("string"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, text string")
