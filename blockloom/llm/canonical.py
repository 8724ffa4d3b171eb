"""Mapping of freely typed values to a canonical list.

Values are deduplicated and normalised (width, case, punctuation, wrappers), candidates come from an inverted index of
character n-grams, are scored by IDF-weighted cosine, and the best is accepted above a threshold and with a margin to the
next entry.  An exact check follows: equal digits, and few edits to some order of the entry's words.  A name that other
words of the list explain with fewer edits, put together as no entry has them, is that of a product that the list lacks
and is unmatched; tags are no combinations of words.

Defined results: null and blank values and exact entries are no cases; an empty or null array has none; ties between
entries are 'unmatched'; repeated rows each get their result; empty tables give empty tables.  The list is fixed and
small: its size is checked, and the index is made of it once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"
THRESHOLD = 0.28
MARGIN = 0.02
#: Edits allowed for each started number of characters, and at most.
CHARS_PER_EDIT, MAX_EDITS = 6, 3
#: Largest list that is sent to all tasks.
MAX_LIST = 20_000

# Words around a name or a tag that are not part of it.
WRAPPERS = {
    "name": (
        "取扱説明書", "説明書", "マニュアル", "instruction booklet", "instruction manual", "instructions", "booklet",
        "manual", "scanned", "scan", "(jp)", "(en)", "jp", "the", "取説", "ガイド", "handbook", "leaflet", "guide", "pdf",
    ),
    "tags": ("tag:", "#"),
}


def _around(word: str) -> str:
    return rf"(?<![^\W_]){re.escape(word)}(?![^\W_])" if word.isascii() and word.isalpha() else re.escape(word)


_wrapper = {field: re.compile("|".join(map(_around, wrappers))) for field, wrappers in WRAPPERS.items()}
_numbered = re.compile(r"(?<=[^\W\d_])\.(?=\d)|(?<=\bver)[ .]+(?=\d)")
_word = re.compile(r"[^\W_]+", re.UNICODE)
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


def plain(value: str) -> str:
    return unicodedata.normalize("NFKC", value)


def _spaced(value: str) -> str:
    """Lower case, with a space where a capital begins a word and numbers joined to their word."""
    text = plain(value)
    return _numbered.sub("", (text if text.isupper() else _camel.sub(" ", text)).lower())


def words(value: str, field: str) -> list[str]:
    """Normalised words of a value, without wrappers."""
    text = _spaced(value)
    return _word.findall(_wrapper[field].sub(" ", text)) or _word.findall(text)


def grams(parts: list[str]) -> Counter:
    """Character bigrams and trigrams of the words, and short words themselves."""
    out: Counter = Counter()
    for w in parts:
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2))
        out["^" + w[:2]] += 1
        if len(w) <= 3:
            out["=" + w] += 1
    return out


def _rows(word: str, typed: str, row: list[int], most: int) -> list[int] | None:
    """Edits (with transpositions) of each beginning of typed after one more word, from those before it; None if all are too many."""
    before: list[int] | None = None
    for i, x in enumerate(word):
        new = [row[0] + 1]
        for j, y in enumerate(typed, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == typed[j - 2] and word[i - 1] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return None
        before, row = row, new
    return row


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions; most + 1 if it is more."""
    row = _rows(a, b, list(range(len(b) + 1)), most) if abs(len(a) - len(b)) <= most else None
    return most + 1 if row is None else min(row[-1], most + 1)


def edits_of_words(form: tuple[str, ...], typed: str, most: int) -> int:
    """Least edits between typed and the words of a form in any order, spaces aside; most + 1 if it is more.

    Exact for any number of words: a state is a set of words that are used, and the edits of each beginning of typed.
    """
    if abs(sum(map(len, form)) - len(typed)) > most:
        return most + 1
    states: dict[int, list[int]] = {0: list(range(len(typed) + 1))}
    for _ in form:
        new: dict[int, list[int]] = {}
        for used, row in states.items():
            for k, word in enumerate(form):
                if not used >> k & 1:
                    got = _rows(word, typed, row, most)
                    if got is not None:
                        key = used | 1 << k
                        new[key] = list(map(min, new[key], got)) if key in new else got
        states = new
        if not states:
            return most + 1
    return min(states[(1 << len(form)) - 1][-1], most + 1)


class Index:
    """Inverted n-gram index over the forms of a list's entries.

    A form is a tuple of words with the entry it stands for, or None for a shortened form that several entries share.
    """

    def __init__(self, entries: list[tuple[str, list[list[str]]]], field: str):
        optional_first = field == "name"  # the line of a product
        self.field = field
        forms: dict[tuple[str, ...], str | None] = {}

        def put(form: tuple[str, ...], ref: str | None) -> None:
            forms[form] = ref if form not in forms or forms[form] == ref else None

        short: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for ref, ways in entries:
            for form in (tuple(w) for w in ways if w):
                put(form, ref)
                if optional_first and len(form) > 2:
                    short[form[1:]].add(ref)
        for form, refs in short.items():
            if form not in forms:
                forms[form] = next(iter(refs)) if len(refs) == 1 else None
        self.forms = list(forms)
        self.refs = [forms[f] for f in self.forms]
        counts = [grams(list(f)) for f in self.forms]
        seen: Counter = Counter(g for c in counts for g in c)
        n = len(self.forms)
        self.idf = {g: math.log(1 + n / k) for g, k in seen.items()}
        self.rare = math.log(1 + n)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((t * self.idf[g]) ** 2 for g, t in c.items())) or 1.0
            for g, t in c.items():
                postings[g].append((i, t * self.idf[g] / norm))
        self.postings = {g: (np.array([i for i, _ in p]), np.array([w for _, w in p])) for g, p in postings.items()}
        self.letters = [Counter("".join(f)) for f in self.forms]
        self.known = sorted({w for f in self.forms for w in f})
        self.vocabulary = set(self.known)

    def candidates(self, parts: list[str]) -> list[tuple[int, float]]:
        """Forms that share n-grams with the words, with their cosine, the best first; those below the threshold are none."""
        vector = {g: t * self.idf.get(g, self.rare) for g, t in grams(parts).items()}
        norm = math.sqrt(sum(w * w for w in vector.values())) or 1.0
        lists = [(self.postings[g], w / norm) for g, w in vector.items() if g in self.postings]
        if not lists:
            return []
        which, at = np.unique(np.concatenate([ids for (ids, _), _ in lists]), return_inverse=True)
        score = np.bincount(at, weights=np.concatenate([weights * w for (_, weights), w in lists]))
        keep = np.flatnonzero(score >= THRESHOLD)
        return [(int(which[i]), float(score[i])) for i in keep[np.argsort(-score[keep], kind="stable")]]

    def match(self, value: str) -> tuple[str, float]:
        """The entry meant, or 'unmatched', and the cosine of the best candidate."""
        parts = words(value, self.field)
        if not parts:
            return UNMATCHED, 0.0
        # a word written with a full stop may be cut short: it stands for any word of the candidate that begins so
        cut = [w for w in parts if len(w) >= 3 and w not in self.vocabulary and re.search(rf"(?<![^\W_]){re.escape(w)}[.]", _spaced(value))]
        found = self.candidates(parts)
        typed = "".join(parts)
        best: list[tuple[int, float, str | None, tuple[str, ...]]] = []
        for i, score in found:
            whole = self._completed(parts, cut, self.forms[i]) if cut else typed
            most = min(MAX_EDITS, 1 + (len(whole) - 1) // CHARS_PER_EDIT) if len(whole) > 2 else 0
            own, letters = Counter(whole), self.letters[i]
            # letters that only one side has need an edit each, in whatever order the words stand
            if max((own - letters).total(), (letters - own).total()) > most or re.findall(r"\d", whole) != re.findall(r"\d", "".join(self.forms[i])):
                continue
            away = edits_of_words(self.forms[i], whole, most)
            if away <= most:
                best.append((away, -score, self.refs[i], self.forms[i]))
        if not best:
            return UNMATCHED, found[0][1] if found else 0.0
        best.sort(key=lambda b: b[:2])
        away, cosine, ref, form = best[0]
        # cut words leave ties undecided, whatever the cosine
        if ref is None or any(o[2] != ref and o[0] == away and (cut or cosine > o[1] - MARGIN) for o in best[1:]):
            return UNMATCHED, -cosine
        if away and not cut and self.field == "name" and self._explained(parts, form, away):
            return UNMATCHED, -cosine
        return ref, -cosine

    @staticmethod
    def _completed(parts: list[str], cut: list[str], form: tuple[str, ...]) -> str:
        """The words joined, those cut short completed by a word of the form that begins so and isn't typed otherwise."""
        left = [w for w in form if w not in parts]
        out = []
        for w in parts:
            ends = [k for k in left if w in cut and k.startswith(w)]
            if ends:
                left.remove(ends[0])
            out.append(ends[0] if ends else w)
        return "".join(out)

    def _explained(self, parts: list[str], form: tuple[str, ...], away: int) -> bool:
        """Whether words of the list, not those of the form, explain the typed words with fewer edits than the form does."""
        if len(parts) != len(form):
            return False
        total, words_ = 0, []
        for w in parts:
            best = (0, w) if w in self.vocabulary else min((edits(k, w, away), k) for k in self.known)
            total += best[0]
            words_.append(best[1])
            if total >= away:
                return False
        return sorted(words_) != sorted(form)


def _japanese_words(rows: list[dict]) -> dict[str, list[str]]:
    """The words of unspaced names: what entries of one first or last word share at the begin or end."""
    first, last = defaultdict(list), defaultdict(list)
    for r in rows:
        first[r["words"][0]].append(r["ja"])
        last[r["words"][2]].append(r["ja"][::-1])
    out = {}
    for r in rows:
        a = commonprefix(first[r["words"][0]]) if len(first[r["words"][0]]) > 1 else ""
        b = commonprefix(last[r["words"][2]])[::-1] if len(last[r["words"][2]]) > 1 else ""
        middle = r["ja"][len(a) : len(r["ja"]) - len(b)] if b else r["ja"][len(a) :]
        out[r["ref"]] = [w for w in (a, middle, b) if w]
    return out


def product_entries(products: list[dict]) -> list[tuple[str, list[list[str]]]]:
    """Forms of product_list: line, hero, device (and version) in both languages."""
    rows = []
    for p in products:
        own = words(p["name"], "name")
        tail = [w for w in own[3:]]
        ja = "".join(_word.findall(plain(p["name_ja"] or "").lower()))
        end = "".join(tail)
        rows.append({"ref": p["ref_id"], "words": own[:3] if len(own) >= 3 else own + [""] * (3 - len(own)), "tail": tail, "ja": ja[: len(ja) - len(end)] if end and ja.endswith(end) else ja})
    ja = _japanese_words(rows)
    return [(r["ref"], [[w for w in r["words"] if w] + r["tail"], ja[r["ref"]] + r["tail"] if r["ja"] else []]) for r in rows]


def tag_entries(tags: list[dict]) -> list[tuple[str, list[list[str]]]]:
    return [(t["tag_id"], [words(t[c] or "", "tags") for c in ("label", "tag_id", "label_ja")]) for t in tags]


def _bounded(rows: DataFrame, *columns: str) -> list[dict]:
    got = [r.asDict() for r in rows.select(*columns).orderBy(*columns).limit(MAX_LIST + 1).collect()]
    if len(got) > MAX_LIST:
        raise ValueError(f"a canonical list may have {MAX_LIST} entries at most")
    return got


def match_values(meta: DataFrame, product_list: DataFrame, tag_list: DataFrame) -> DataFrame:
    """(meta_id, field, pos, ref_id) of each typed value of meta.name and meta.tags."""
    products = _bounded(product_list, "ref_id", "name", "name_ja")
    tags = _bounded(tag_list, "tag_id", "label", "label_ja")
    names = meta.select("meta_id", F.lit("name").alias("field"), F.lit(-1).cast("long").alias("pos"), F.col("name").alias("value"))
    typed = meta.select("meta_id", F.lit("tags").alias("field"), F.posexplode("tags").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    cases = names.unionByName(typed).where(F.col("value").rlike(r"(?U)\S"))
    exact = {"name": {p["name"] for p in products}, "tags": {t["tag_id"] for t in tags}}
    made = {"name": Index(product_entries(products), "name"), "tags": Index(tag_entries(tags), "tags")}
    shared = meta.sparkSession.sparkContext.broadcast((made, exact))  # a few forms an entry of lists of checked size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, listed = shared.value
        for batch in batches:
            fields, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [None if v in listed[f] else index[f].match(v)[0] for f, v in zip(fields, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["field", "value", "ref_id"])

    spread = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = cases.select("field", "value").distinct().repartition(spread, F.xxhash64("field", "value")).mapInArrow(score, "field string, value string, ref_id string")
    return cases.join(distinct.where("ref_id IS NOT NULL"), ["field", "value"]).select("meta_id", "field", "pos", "ref_id")
