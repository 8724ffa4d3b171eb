"""The log of edits of a manual folded into its blocks.

Operations are update_text, update_bbox, add, delete and undo, in the order of seq.  Undo takes back the last text or
box edit, once: only an edit whose next such operation is an undo is taken back.  Keys are those of the blocks before
any removal; at the end blocks are numbered anew.

An added block may itself be edited, moved or deleted by the key that its add names, by operations after it.  A key that
is null, or that a block or an earlier add of the page has, names none: that block is put after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.geometry import NEW_BOX, clamp, is_box
from blockloom.functions.text import strip
from blockloom.operators.cleanup import rekey
from blockloom.operators.events import before
from blockloom.session import cut

KEY = ["manual", "page_idx", "block_idx"]
#: Source text of a block that is added; its translation is empty unless the edit has one.
NEW_TEXT = "New text block"
#: Numbers of the log that are ordered together.
CHUNK = 1024


def standing(edits: DataFrame) -> DataFrame:
    """Edits that count: without undos and what they take back.

    The operation after each is found from behind, in chunks of a manual's log, so that no log is sorted in one task.
    """
    kinds = edits.where(F.col("op").isin("update_text", "update_bbox", "undo"))
    behind = kinds.withColumn("_s", -F.col("seq")).withColumn("_e", -F.col("edit_id"))
    met = before(behind, "manual", -F.floor(F.col("seq") / CHUNK), ["_s", "_e"], "op", "_after")
    after = met.where("op <> 'undo' AND NOT (_after <=> 'undo')").select(*edits.columns)
    return after.unionByName(edits.where(F.col("op").isin("add", "delete")))


def _last(value: Column, when: Column) -> Column:
    """The value of the last operation that has one, as an aggregate."""
    told = when & value.isNotNull()
    return F.max_by(F.when(told, value), F.when(told, F.struct("seq", "edit_id")))


def _folded(log: DataFrame) -> DataFrame:
    """Last text and box of each key and whether it was deleted, in one aggregation."""
    op = F.col("op")
    return log.groupBy(*KEY).agg(
        _last(strip(F.col("translation")), op == "update_text").alias("new_text"),
        _last(clamp(F.col("bbox")), op == "update_bbox").alias("new_box"),
        F.coalesce(F.bool_or(op == "delete"), F.lit(False)).alias("gone"),
    )


def fold(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """(manual, page_idx, block_idx, text, translation, bbox) after all edits.

    The log is small beside the blocks: what concerns adds (their page's last block, keys that are taken, operations
    after them) is found on the log's own keys and pages.
    """
    kept = cut(standing(edits))  # read several times
    place = F.struct("seq", "edit_id")
    own = blocks.select(*KEY, "text", "translation", "bbox")
    changes = _folded(kept.where("op <> 'add'"))
    met = own.join(changes, KEY, "left").where("NOT coalesce(gone, false)")
    changed = met.select(*KEY, "text", F.coalesce("new_text", "translation").alias("translation"), F.coalesce("new_box", "bbox").alias("bbox"))
    # the first add of a free key has that key; operations after it are its own
    adds = kept.where("op = 'add' AND page_idx IS NOT NULL AND manual IS NOT NULL")
    pages = ["manual", "page_idx"]
    there = cut(own.select(*KEY).join(adds.select(*pages).distinct(), pages, "left_semi"))  # what stands on the pages that blocks are added to
    free = adds.where("block_idx IS NOT NULL").join(there, KEY, "left_anti")
    named = free.groupBy(*KEY).agg(F.min(place).alias("_added"))
    later = kept.where("op IN ('update_text', 'update_bbox', 'delete')").join(named, KEY).where(place > F.col("_added"))
    edited = named.join(_folded(later), KEY, "left").select(F.col("_added.edit_id").alias("edit_id"), "new_text", "new_box", "gone")
    box = F.coalesce(F.when(is_box(F.col("bbox")), clamp(F.col("bbox"))), F.array(*map(F.lit, NEW_BOX)))
    new = adds.join(edited, "edit_id", "left").where("NOT coalesce(gone, false)")
    new = new.select(
        "manual",
        "page_idx",
        F.row_number().over(Window.partitionBy("manual", "page_idx").orderBy("seq", "edit_id")).alias("_n"),
        F.lit(NEW_TEXT).alias("text"),
        F.coalesce("new_text", "translation", F.lit("")).alias("translation"),
        F.coalesce("new_box", box).alias("bbox"),
    )
    # added blocks stand after the others of their page, in the order of the log
    last = there.groupBy(*pages).agg(F.max("block_idx").alias("_top"))
    placed = new.join(last, pages, "left").withColumn("block_idx", (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("int"))
    return rekey(changed.unionByName(placed.select(*KEY, "text", "translation", "bbox")))


def shifted(keys: DataFrame, page_idx: int, block_idx: int) -> DataFrame:
    """Keys of edited blocks after a block was deleted: its own goes, later ones of its page move up."""
    here = F.col("page_idx") == page_idx
    kept = keys.where(~(here & (F.col("block_idx") == block_idx)))
    return kept.withColumn("block_idx", F.when(here & (F.col("block_idx") > block_idx), F.col("block_idx") - 1).otherwise(F.col("block_idx")))


def edited_keys(edits: DataFrame) -> DataFrame:
    """(manual, n_keys) of the distinct blocks that standing edits touch."""
    return standing(edits).select(*KEY).distinct().groupBy("manual").agg(F.count("*").alias("n_keys"))
