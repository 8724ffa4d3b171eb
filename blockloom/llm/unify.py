"""One form for text that looks the same in different characters.

Two stages.  A character stage removes invisible characters and unifies width, composition, radicals, spaces and
hyphens; it leaves everything that can be seen: case, accents, voicing marks, circled and raised digits, line breaks.
A token stage repairs look-alike letters script-aware: the dominant script of a token is that of its letters without a
look-alike; only tokens of mixed scripts (or tokens made of look-alikes wholly, in a value of another script) are
substituted, each where it stands, and only if the result is a word of the corpus vocabulary.  The vocabulary holds the
words of all values; of a suspicious value those outside its tokens of mixed scripts, after the character stage.

One vectorised pass over code points hashes every value and every word and finds the values with a suspicious character;
only those are worked on as strings.  Defined results: null stays null; blank values become blank
values; empty tables give empty tables; repeated rows are each repaired; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow_text import code_points, hash_runs, pieces, row_sums
from blockloom.session import cut

# Letters of other scripts that look like Latin ones.
LATIN_LOOKS = {
    **dict(zip("аеорсухіјѕһԁԛԝӏ", "aeopcyxijshdqwl")),
    **dict(zip("АВЕКМНОРСТУХІЈЅԌЗ", "ABEKMHOPCTYXIJSG3")),
    **dict(zip("οναρυικχγτ", "ovapuikxyt")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("օոսզհց", "onuqhg")),
    **dict(zip("ɑɡı", "agi")),
}
# Kanji, katakana and hiragana that look the same, as (katakana, other).
KATAKANA_LOOKS = tuple(zip("カロタトエニハミチーヘベペリ", "力口夕卜工二八三千一へべぺり"))
TO_KATAKANA = {other: kata for kata, other in KATAKANA_LOOKS}
TO_KANJI = {kata: other for kata, other in KATAKANA_LOOKS if "一" <= other <= "鿿"}
TO_HIRAGANA = {kata: other for kata, other in KATAKANA_LOOKS if "ぁ" <= other <= "ん"}

# Character classes, as the inside of a regular expression class.
INVISIBLE = r"\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\u3164\uFE00-\uFE0F\uFEFF\uFFA0\uFFF9-\uFFFB"
SPACES = r"\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
HYPHENS = r"\u2010\u2011\u2212\uFE63"
COMPATIBLE = r"\u2126\u212A\u212B\u2160-\u217F\u2E80-\u2FDF\uF900-\uFAFF\uFB00-\uFB06\uFE10-\uFE19\uFE30-\uFE6F\uFF5F-\uFF9F\uFFE0-\uFFEE\u301C"
COMBINING = r"\u0300-\u036F\u20D0-\u20FF\u3099\u309A"
FOREIGN = r"\u0251\u0261\u0131\u0370-\u03FF\u0400-\u058F"
KATAKANA = "ァ-ヺー"
_OTHERS = "".join(TO_KATAKANA)
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: Kinds of letters that make words: runs of one kind.
WORD_KINDS = ("A-Za-zÀ-ɏ", KATAKANA, "ぁ-ん", "一-鿿々")

_invisible = re.compile(f"[{INVISIBLE}\U000e0000-\U000e0fff]")
_compatible = re.compile(f"[{COMPATIBLE}]+")
_table = {**dict(zip(map(ord, _FULL), _HALF)), **{ord(c): "~" for c in "〜"}, **{c: "-" for c in (0x2010, 0x2011, 0x2212, 0xFE63)}}
_foreign = re.compile(f"[{FOREIGN}]")
_ascii_letter = re.compile("[A-Za-z]")
_spaces = re.compile(f"[{SPACES}]")
_foreign_token = re.compile(f"[A-Za-zÀ-ɏ{FOREIGN}]*[{FOREIGN}][A-Za-zÀ-ɏ{FOREIGN}]*")
_kata_token = re.compile(f"[{KATAKANA}{_OTHERS}]*(?:[{KATAKANA}][{_OTHERS}]|[{_OTHERS}][{KATAKANA}])[{KATAKANA}{_OTHERS}]*")
_kanji_token = re.compile(f"[一-鿿々]*(?:[一-鿿][{''.join(TO_KANJI)}]|[{''.join(TO_KANJI)}][一-鿿])(?:[一-鿿々{''.join(TO_KANJI)}]*)(?![{KATAKANA}])")
_hira_token = re.compile(f"(?<![{KATAKANA}])[ぁ-ん]*[{''.join(TO_HIRAGANA)}][ぁ-ん{''.join(TO_HIRAGANA)}]*(?![{KATAKANA}])")


#: For each kind of token its pattern, the run of characters it lies in, and what a run must hold: patterns are only tried
#: on runs that may match, as trying them at each place of a long run takes quadratic time.
_runs = {
    p: (re.compile(f"[{run}]+"), re.compile(f"[{need}]"))
    for p, run, need in (
        (_foreign_token, f"A-Za-zÀ-ɏ{FOREIGN}", FOREIGN),
        (_kata_token, KATAKANA + _OTHERS, _OTHERS),
        (_kanji_token, "一-鿿々" + "".join(TO_KANJI), "".join(TO_KANJI)),
        (_hira_token, "ぁ-ん" + "".join(TO_HIRAGANA), "".join(TO_HIRAGANA)),
    )
}


def _tokens(pattern: re.Pattern, s: str) -> Iterator[re.Match]:
    run, need = _runs[pattern]
    for r in run.finditer(s):
        if need.search(r[0]):
            yield from pattern.finditer(s, r.start(), min(len(s), r.end() + 1))


def unify_characters(s: str) -> str:
    """The character stage."""
    s = _invisible.sub("", s)
    s = _spaces.sub(" ", s)
    s = _compatible.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s)
    return unicodedata.normalize("NFC", s.translate(_table))


def _latin(token: str, context: str) -> str | None:
    """The token in Latin letters or, if it is of another script, with that script's letters; None if it stays."""
    foreign = [c for c in token if not ("A" <= c <= "z" or "À" <= c <= "ɏ")]
    if not foreign or any(c not in LATIN_LOOKS for c in foreign):
        return None  # a letter that only the other script has: that script is dominant
    if len(foreign) == len(token) and context != "latin":
        return None
    return "".join(LATIN_LOOKS.get(c, c) for c in token)


@lru_cache(maxsize=50_000)
def candidate_tokens(s: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, what it becomes) of each token of mixed scripts; its repair counts if that is a word."""
    own = any(c.isalpha() and c not in LATIN_LOOKS for c in _foreign.findall(s))
    context = "latin" if not own and _ascii_letter.search(s) else "other"
    out: list[tuple[int, int, str]] = []
    for m in _tokens(_foreign_token, s):
        fixed = _latin(m[0], context)
        if fixed and fixed != m[0]:
            out.append((*m.span(), fixed))
    for pattern, table in ((_kata_token, TO_KATAKANA), (_kanji_token, TO_KANJI), (_hira_token, TO_HIRAGANA)):
        for m in _tokens(pattern, s):
            fixed = "".join(table.get(c, c) for c in m[0])
            if fixed != m[0]:
                out.append((*m.span(), fixed))
    return tuple(out)


def apply_repairs(s: str, words: set[str]) -> str:
    """The value with the tokens repaired whose repair is one of the words, each in its place; the first of overlapping ones."""
    out, end = [], 0
    for a, b, fixed in sorted((t for t in candidate_tokens(s) if t[2] in words), key=lambda t: t[0]):
        if a >= end:
            out += [s[end:a], fixed]
            end = b
    return "".join([*out, s[end:]])


def clean_part(s: str) -> str:
    """The value without its tokens of mixed scripts: what it says about the vocabulary."""
    spans = [m.span() for m in _tokens(_foreign_token, s)] + [(a, b) for a, b, _ in candidate_tokens(s)]
    out, end = [], 0
    for a, b in sorted(spans):
        out += [s[end:a], "\0"]
        end = max(end, b)
    return "".join([*out, s[end:]])


@cache
def _tables() -> dict[str, np.ndarray]:
    """Properties of each code point of the basic plane; those beyond it have none but may be suspicious."""
    every = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x10000)]
    text = "".join(every)

    def having(inside: str) -> np.ndarray:
        out = np.zeros(0x10001, dtype=bool)
        out[[m.start() for m in re.finditer(f"[{inside}]", text)]] = True
        return out

    odd = having(INVISIBLE + SPACES + HYPHENS + COMPATIBLE + COMBINING + FOREIGN)
    word = np.zeros(0x10001, dtype=np.uint8)
    for k, inside in enumerate(WORD_KINDS, 1):
        word[having(inside)] = k
    half = np.arange(0x10001, dtype=np.uint32)
    half[0xFF01:0xFF5F] -= 0xFEE0
    lower = half.copy()
    for c in range(0x10000):
        low = every[c].lower()
        if len(low) == 1 and low != every[c]:
            lower[c] = ord(low)
    return {
        "odd": odd,
        "word": word,
        "half": half,
        "lower": lower,
        "kata": having(KATAKANA),
        "other": having(_OTHERS),
        "alone": having("".join(TO_KANJI) + "".join(TO_HIRAGANA)),
        "blank": having(r" \n\r\t"),
    }


def _suspicious(points: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitmap of the rows that hold a suspicious character, or look-alikes of Japanese scripts side by side."""
    t = _tables()
    n = len(points)
    flag = t["odd"][low] | ((points >= 0xE0000) & (points < 0xE1000))
    inner = np.ones(n + 1, dtype=bool)
    inner[offsets] = False  # no neighbour before
    kata, other = t["kata"][low], t["other"][low]
    before = np.zeros(n, dtype=bool)
    before[1:] = kata[:-1] & inner[1:n]
    after = np.zeros(n, dtype=bool)
    after[:-1] = kata[1:] & inner[1:n]
    flag |= other & (before | after)
    flag |= t["alone"][low] & ~before & ~after
    return row_sums(flag.astype(np.int64), offsets) > 0


def word_hashes(points: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct hashes of the lower-case words of the marked rows."""
    t = _tables()
    low = t["lower"][np.minimum(points, 0x10000)]
    kind = t["word"][np.minimum(points, 0x10000)]
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(start)
    of_row = np.searchsorted(offsets, begin, side="right") - 1
    hashes = hash_runs(low, np.append(begin, n))
    return np.unique(hashes[(kind[begin] > 0) & rows[of_row]])


def text_hash(texts: list[str]) -> np.ndarray:
    return hash_runs(*code_points(pa.array(texts, pa.string())))


_PAIRS = pa.list_(pa.struct([("sub", pa.string()), ("word", pa.int64())]))
_SEEN = "row_id long, page long, is_text boolean, canon long, canon2 int, value long, base string, pairs array<struct<sub:string,word:long>>, word long"
_SCHEMA = pa.schema(
    [("row_id", pa.int64()), ("page", pa.int64()), ("is_text", pa.bool_()), ("canon", pa.int64()), ("canon2", pa.int32()), ("value", pa.int64()), ("base", pa.string()), ("pairs", _PAIRS), ("word", pa.int64())]
)


def _scan_field(part: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    column = part.column(name)
    present = np.asarray(column.is_valid())
    points, offsets = code_points(column)
    t = _tables()
    low = np.minimum(points, 0x10000).astype(np.uint32)
    odd = _suspicious(points, low, offsets) & present
    half = np.where(points < 0x10000, t["half"][low], points)
    visible = row_sums((~t["blank"][low]).astype(np.int64), offsets) > 0
    canon, second, value = hash_runs(half, offsets), hash_runs(half, offsets, 7), hash_runs(points, offsets)
    base: list[str | None] = [None] * len(present)
    pairs: list[list[dict] | None] = [None] * len(present)
    at = np.flatnonzero(odd)
    clean = np.zeros(0, dtype=np.int64)
    if len(at):
        bases = [unify_characters(v) for v in column.take(pa.array(at)).to_pylist()]
        subs = [dict.fromkeys(fixed for _, _, fixed in candidate_tokens(b)) for b in bases]
        lower = [sub.lower() for found in subs for sub in found]
        word = iter(text_hash(lower).tolist() if lower else [])
        for i, b, found in zip(at.tolist(), bases, subs):
            base[i] = b
            pairs[i] = [{"sub": sub, "word": next(word)} for sub in found]
            visible[i] = bool(b.strip(" \n\r\t"))
        canon[at], second[at] = text_hash(bases), hash_runs(*code_points(pa.array(bases, pa.string())), 7)
        points_, offsets_ = code_points(pa.array([clean_part(b) for b in bases], pa.string()))
        clean = word_hashes(points_, offsets_, np.ones(len(bases), dtype=bool))
    keep = pa.array(present & visible)
    n = len(present)
    yield pa.RecordBatch.from_arrays(
        [
            part.column("row_id"), part.column("page"), pa.array(np.full(n, name == "text")), pa.array(canon), pa.array((second >> 32).astype(np.int32)),
            pa.array(value), pa.array(base, pa.string()), pa.array(pairs, _PAIRS), pa.nulls(n, pa.int64()),
        ],
        schema=_SCHEMA,
    ).filter(keep)
    words = np.union1d(word_hashes(points, offsets, present & ~odd), clean)
    nulls = [pa.nulls(len(words), f.type) for f in _SCHEMA]
    yield pa.RecordBatch.from_arrays([*nulls[:-1], pa.array(words)], schema=_SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2, 3):
            yield from _scan_field(part, "text")
            yield from _scan_field(part, "translation")


def scan(translations: DataFrame) -> DataFrame:
    """One pass: a row with hashes per visible value, for suspicious ones also their form; and rows of distinct words."""
    src = translations.select(
        F.col("row_id").cast("long"),
        F.when(F.col("manual").isNotNull() & F.col("page_idx").isNotNull(), F.xxhash64("manual", "page_idx")).alias("page"),
        F.col("text").cast("string"),
        F.col("translation").cast("string"),
    )
    return cut(src.mapInArrow(_scan, _SEEN))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [base if not words else apply_repairs(base, set(words)) for base, words in zip(batch.column("base").to_pylist(), batch.column("words").to_pylist())]
        form = pa.array(forms, pa.string())
        points, offsets = code_points(form)
        second = (hash_runs(points, offsets, 7) >> 32).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row_id", "page", "is_text", "value")), form, pa.array(hash_runs(points, offsets)), pa.array(second)],
            names=["row_id", "page", "is_text", "value", "form", "canon", "canon2"],
        )


def repaired_values(seen: DataFrame) -> DataFrame:
    """The suspicious values in their one form, with their hashes."""
    odd = seen.where("base IS NOT NULL")
    pairs = odd.where("size(pairs) > 0").select("row_id", "is_text", F.explode("pairs").alias("p")).select("row_id", "is_text", "p.*")
    words = seen.where("word IS NOT NULL").select("word").distinct()
    accepted = pairs.join(words, "word", "left_semi").groupBy("row_id", "is_text").agg(F.collect_set("sub").alias("words"))
    joined = odd.join(accepted, ["row_id", "is_text"], "left").select("row_id", "page", "is_text", "value", "base", "words")
    return joined.mapInArrow(_repair, "row_id long, page long, is_text boolean, value long, form string, canon long, canon2 int")


def _several(translations: DataFrame) -> DataFrame:
    """(page, is_text, canon, canon2, value, row_id) of the values of groups with more than one form."""
    seen = scan(translations)
    key = ["page", "is_text", "canon", "canon2"]
    plainly = seen.where("value IS NOT NULL AND base IS NULL").select(*key, "value", "row_id")
    values = plainly.unionByName(repaired_values(seen).select(*key, "value", "row_id")).where("page IS NOT NULL")
    groups = values.groupBy(*key).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*key)
    return cut(values.join(groups, key, "left_semi"))


def look_alike_classes(translations: DataFrame) -> DataFrame:
    """(row_id, field, class_id, form_id): a row per value of a class that has more than one form on its page.

    Values of one class look the same, values of one form are equal; linear in the rows however often a page repeats them.
    """
    several = _several(translations)
    field = F.when(F.col("is_text"), "text").otherwise("translation").alias("field")
    return several.select("row_id", field, F.xxhash64("page", "is_text", "canon", "canon2").alias("class_id"), F.col("value").alias("form_id"))


def look_alike_pairs(translations: DataFrame) -> DataFrame:
    """(row_a, row_b, field): rows of one page whose values differ as strings and have one canonical form.

    The pairs are the result asked for; groups are found by hashed keys with partial aggregation, and only rows of
    groups with more than one form are joined.  Rows without manual or page are on no page.
    """
    several, key = _several(translations), ["page", "is_text", "canon", "canon2"]
    a, b = several.alias("a"), several.alias("b")
    same = " AND ".join(f"a.{c} = b.{c}" for c in key)
    met = a.join(b, F.expr(f"{same} AND a.value <> b.value AND a.row_id < b.row_id"))
    return met.select(
        F.col("a.row_id").alias("row_a"), F.col("b.row_id").alias("row_b"), F.when(F.col("a.is_text"), "text").otherwise("translation").alias("field")
    )


def unified_translations(translations: DataFrame) -> DataFrame:
    """(row_id, text, translation) with both values in their one form.  row_id must be unique."""
    forms = repaired_values(scan(translations)).groupBy("row_id").agg(
        F.max(F.when(F.col("is_text"), F.col("form"))).alias("new_text"), F.max(F.when(~F.col("is_text"), F.col("form"))).alias("new_translation")
    )
    unified = [F.coalesce(F.col(f"new_{c}"), F.translate(c, _FULL, _HALF)).alias(c) for c in ("text", "translation")]
    return translations.select("row_id", "text", "translation").join(forms, "row_id", "left").select("row_id", *unified)
