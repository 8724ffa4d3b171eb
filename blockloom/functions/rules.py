"""Rules as data: noise of recognition, clean-up of translations, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions.text import HOUSE, SPACE, strip

# Whole texts that are noise of recognition.
NOISE = {
    "number": r"[\p{Nd}①-⑳]+",
    "symbol": r"[・•\-●○■□★☆※→←↑↓↔▲▼◆◇]+",
    "numbered": r"[\p{Nd}①-⑩]+[.)）:：]?",
    "mark": r"[©®™]+",
    "letter": r"[A-Za-z]",
    "capitals": r"[A-Z]{1,4}",
}
# Whole translations that are dropped in clean-up.
DROPPED = {
    "page_number": r"\(\p{Nd}+\)",
    "punctuation": r"[.!?,;:]+",
    "single": r"[a-zA-Z0-9]",
    "mark": r"[©®™]+",
    "maker": r"BANDAI",
    "blank": rf"{SPACE}*",
}
# Tags and what the lower-case name and description must hold.
TAG_RULES = {
    "csm": r"\bcsm\b|complete selection modification",
    "dx": r"\bdx\b",
    "memorial": r"\bmemorial\b",
    "premium": r"\bpremium\b",
    "kamen-rider": r"\bkamen rider\b|仮面ライダー|rider|ridewatch|driver|dengasher|faiz|零ワン|zero.*one|zein|memory|progrise",
    "sentai": r"\bsentai\b|ranger.*key|abaranger|戦隊|スーパー戦隊",
    "ultraman": r"ultraman|ウルトラマン|ultra.*replica|beta.*capsule|shin.*ultra",
}
# Colour and label of each tag.
TAGS = {
    "csm": ("#FF6B6B", "CSM"),
    "dx": ("#4ECDC4", "DX"),
    "memorial": ("#95E1D3", "Memorial"),
    "premium": ("#F38181", "Premium"),
    "kamen-rider": ("#AA96DA", "Kamen Rider"),
    "sentai": ("#FCBAD3", "Sentai"),
    "ultraman": ("#A8D8EA", "Ultraman"),
}


def matched(c: Column, rules: dict[str, str]) -> Column:
    """Name of the first rule that fits the whole text, null if none."""
    return reduce(lambda out, rule: out.when(c.rlike(f"{HOUSE}^(?:{rule[1]})$"), rule[0]), rules.items(), F.when(F.lit(False), F.lit("")))


def is_noise(text: Column) -> Column:
    """Whether a recognised text is empty or noise; null counts as noise."""
    own = strip(text)
    return text.isNull() | (own == "") | matched(own, NOISE).isNotNull()


def dropped_by(translation: Column) -> Column:
    """Rule that drops a translation in clean-up, null if it stays."""
    return matched(strip(translation), DROPPED)


def tags_of(name: Column, description: Column) -> Column:
    """Sorted tags by rule."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(f"{HOUSE}{rule}"), F.lit(tag)) for tag, rule in TAG_RULES.items()))))
