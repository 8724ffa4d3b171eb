"""Clean-up of translated blocks in three stages, and its figures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.rules import DROPPED, dropped_by
from blockloom.functions.text import block_key, embedded_json
from blockloom.operators.blocks import rekeyed

#: Answer of the language model: keys to remove, corrections by key, name and tags.
ANSWER = "remove array<string>, corrections map<string,string>, product_name string, tags array<string>"
TAG_ANSWER = "tags array<string>, confidence string, reasoning string"


def repair_encoding(blocks: DataFrame, fix) -> tuple[DataFrame, DataFrame]:
    """Stage 1: blocks with the translation repaired by a provider (column -> column), and how many changed."""
    fixed = fix(F.col("translation"))
    return blocks.withColumn("translation", fixed), blocks.agg(F.count_if(~fixed.eqNullSafe(F.col("translation"))).alias("fixed"))


def drop_by_rule(blocks: DataFrame) -> DataFrame:
    """Stage 2: blocks whose translation no rule drops; a null translation stays."""
    return blocks.where(dropped_by(F.col("translation")).isNull())


def rule_counts(blocks: DataFrame) -> DataFrame:
    """(rule, n) of the rules that drop blocks."""
    return blocks.select(dropped_by(F.col("translation")).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


def stage_counts(blocks: DataFrame) -> DataFrame:
    """Blocks before, after and removed by stage 2."""
    gone = dropped_by(F.col("translation")).isNotNull()
    return blocks.agg(F.count("*").alias("before"), F.count_if(~gone).alias("after"), F.count_if(gone).alias("removed"))


def parse_answer(answers: DataFrame, column: str = "answer") -> DataFrame:
    """With remove, corrections, product_name and tags of the JSON in a free answer; ok is false where there is none."""
    parsed = F.from_json(embedded_json(F.col(column)), ANSWER)
    return answers.select(
        "*",
        parsed.isNotNull().alias("ok"),
        F.coalesce(parsed["remove"], F.array().cast("array<string>")).alias("remove"),
        F.coalesce(parsed["corrections"], F.create_map().cast("map<string,string>")).alias("corrections"),
        F.coalesce(parsed["product_name"], F.lit("")).alias("product_name"),
        F.coalesce(parsed["tags"], F.array().cast("array<string>")).alias("tags"),
    )


def accept_tags(tags, confidence, known: list[str] | None = None):
    """Tags of an answer if it is sure enough, known ones only if a list is given; empty otherwise."""
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(tags, none), lambda t: F.coalesce(t.isin(known), F.lit(False))) if known is not None else F.coalesce(tags, none)
    sure = confidence.isin("high", "medium") & (F.size(kept) > 0)
    return F.when(sure, F.array_sort(kept)).otherwise(none)


def remove_keys(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks without those of the keys (manual, page_idx, block_idx)."""
    return blocks.join(keys.dropDuplicates(["manual", "page_idx", "block_idx"]), ["manual", "page_idx", "block_idx"], "left_anti")


def correct(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Blocks with the translation of a correction (manual, page_idx, block_idx, new_translation) of the same key."""
    joined = blocks.join(corrections, ["manual", "page_idx", "block_idx"], "left")
    return joined.withColumn("translation", F.coalesce("new_translation", "translation")).drop("new_translation")


def rekey(blocks: DataFrame) -> DataFrame:
    """Blocks numbered from 0 within their page, in their order."""
    return rekeyed(blocks)


def correct_and_remove(blocks: DataFrame, removals: DataFrame, corrections: DataFrame, compat: bool = False) -> DataFrame:
    """Stage 3.  Keys of both are those before any removal; compat resolves corrections after it, on shifted places."""
    if compat:
        return correct(rekey(remove_keys(blocks, removals)), corrections)
    return rekey(remove_keys(correct(blocks, corrections), removals))


def keyed_answer(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removals, corrections and rejected keys of parsed answers with a manual."""
    gone = parsed.select("manual", F.explode("remove").alias("key"), F.lit(None).cast("string").alias("new_translation"), F.lit("remove").alias("kind"))
    new = parsed.select("manual", F.explode("corrections").alias("key", "new_translation"), F.lit("correct").alias("kind"))
    keyed = gone.unionByName(new).withColumn("place", block_key(F.col("key")))
    good = keyed.where("place.page_idx IS NOT NULL").select("manual", "place.page_idx", "place.block_idx", "new_translation", "kind")
    return (
        good.where("kind = 'remove'").select("manual", "page_idx", "block_idx"),
        good.where("kind = 'correct'").select("manual", "page_idx", "block_idx", "new_translation"),
        keyed.where("place.page_idx IS NULL").select("manual", "key", "kind"),
    )


@dataclass
class CleanupResult:
    """What a clean-up did to a corpus."""

    success: bool
    original: int = 0
    cleaned: int = 0
    fixed: int = 0
    removed_by_rule: int = 0
    removed_by_model: int = 0
    corrected: int = 0
    rejected: int = 0
    error: str | None = None


def clean(blocks: DataFrame, answers: DataFrame, fix) -> tuple[DataFrame, DataFrame]:
    """All three stages: the cleaned blocks, and one row of figures as CleanupResult names them.

    answers are those of a model, (manual, answer); their keys are those after stage 2.  Corrections count if they meet a
    block that stays, removals if they meet a block, rejected are malformed keys.
    """
    flagged = fix(F.col("translation"))
    own = blocks.withColumn("_fixed", ~flagged.eqNullSafe(F.col("translation"))).withColumn("translation", flagged)
    gone = dropped_by(F.col("translation")).isNotNull()
    kept = rekey(own.where(~gone).drop("_fixed"))
    removals, corrections, rejected = keyed_answer(parse_answer(answers))
    removals = removals.distinct()
    out = correct_and_remove(kept, removals, corrections)
    one = own.agg(F.count("*").alias("original"), F.count_if("_fixed").alias("fixed"), F.count_if(gone).alias("removed_by_rule"))
    place = ["manual", "page_idx", "block_idx"]
    hit = kept.select(*place).join(removals.withColumn("_r", F.lit(True)), place, "left").join(corrections.select(*place).distinct().withColumn("_c", F.lit(True)), place, "left")
    removed = F.coalesce("_r", F.lit(False))
    two = hit.agg(F.count_if(~removed).alias("cleaned"), F.count_if(removed).alias("removed_by_model"), F.count_if(F.coalesce("_c", F.lit(False)) & ~removed).alias("corrected"))
    parts = [one, two, rejected.agg(F.count("*").alias("rejected"))]
    figures = reduce(lambda a, b: a.join(b, "_one"), [p.withColumn("_one", F.lit(1)) for p in parts]).drop("_one")
    return out, figures


def result_of(figures: DataFrame) -> CleanupResult:
    """The figures of a clean-up run; a failure of the run is told, not raised."""
    try:
        return CleanupResult(True, **figures.first().asDict())
    except Exception as e:
        return CleanupResult(False, error=str(e)[:100])


__all__ = ["ANSWER", "DROPPED", "TAG_ANSWER", "CleanupResult"]
