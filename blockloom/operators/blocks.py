"""Blocks of pages: delivery, order, batches, assembly and look-up by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.rules import is_noise
from blockloom.functions.text import strip

PLACE = ["manual", "page_idx", "block_idx"]


#: Types whose values an aggregation keeps in place: with these alone it hashes and never sorts.
FIXED_WIDTH = {"bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz"}
#: Positions numbered together; longer pages and manuals are put together from such units.
UNIT = 1024


def moment(stamp: str, tie: str) -> Column:
    """Time and tie breaker as one fixed-width number, nulls first."""
    us = F.coalesce(F.unix_micros(F.col(stamp).cast("timestamp")), F.lit(-(1 << 62)))
    return us.cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.coalesce(F.col(tie), F.lit(-(1 << 63)))


def latest(rows: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """One row a key, the last by stamp, then by tie, which must be unique.

    Fixed-width columns come out of one hash aggregation with partial sums, without a sort.  Others never go through
    it: the aggregation picks the last tie of each key, and the rows are met with those by a semi-join, so that only
    columns that are asked for are shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    at = moment(stamp, tie)
    if all(kinds[c] in FIXED_WIDTH for c in rest):
        return rows.groupBy(*keys).agg(*(F.max_by(c, at).alias(c) for c in rest)).select(*rows.columns)
    last = rows.groupBy(*keys).agg(F.max_by(tie, at).alias(tie)).select(tie)
    return rows.join(last, tie, "left_semi").select(*rows.columns)


def latest_blocks(translations: DataFrame, *columns: str) -> DataFrame:
    """Translations without blocks that were delivered again later: their place and the columns asked for, or all."""
    if not columns:
        return latest(translations, PLACE, "loaded_at", "row_id")
    wanted = list(dict.fromkeys([*PLACE, *columns]))
    needed = list(dict.fromkeys([*wanted, "loaded_at", "row_id"]))
    return latest(translations.select(*needed), PLACE, "loaded_at", "row_id").select(*wanted)


def explode_pages(manuals: DataFrame) -> DataFrame:
    """Rows of (manual, page_idx, image, block_idx, text, translation, bbox) of nested manuals; pages without blocks stay."""
    pages = manuals.select("manual", F.posexplode("pages").alias("page_idx", "page"))
    blocks = pages.select("manual", "page_idx", F.col("page.image").alias("image"), F.posexplode_outer("page.blocks").alias("block_idx", "block"))
    return blocks.select("manual", "page_idx", "image", "block_idx", "block.text", "block.translation", "block.bbox")


def lines_as_blocks(documents: DataFrame) -> DataFrame:
    """Each line of a document as a block."""
    return documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))


def keep_readable(rows: DataFrame) -> DataFrame:
    """Rows whose text isn't noise of recognition, with the text stripped."""
    return rows.where(~is_noise(F.col("text"))).withColumn("text", strip(F.col("text")))


def unit_offsets(rows: DataFrame) -> DataFrame:
    """(manual, page_idx, _u, _before): blocks of the manual before each unit of a page.

    Sums are taken over stretches of UNIT pages first, and those of earlier stretches carried, so that the pages of a
    manual with a large share of all rows are never summed up in one task.
    """
    units = rows.groupBy("manual", "page_idx", "_u").agg(F.count("*").alias("_here")).withColumn("_s", F.floor(F.col("page_idx") / UNIT))
    earlier = lambda w: F.coalesce(F.sum("_here").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    stretches = units.groupBy("manual", "_s").agg(F.sum("_here").alias("_here")).select("manual", "_s", earlier(Window.partitionBy("manual").orderBy("_s")).alias("_carry"))
    within = units.select("manual", "_s", "page_idx", "_u", earlier(Window.partitionBy("manual", "_s").orderBy("page_idx", "_u")).alias("_in"))
    return within.join(stretches, ["manual", "_s"]).select("manual", "page_idx", "_u", (F.col("_in") + F.col("_carry")).alias("_before"))


def numbered(rows: DataFrame, name: str = "n", most: int | None = None) -> DataFrame:
    """With a running number from 0 in each manual, in the order of pages and blocks; only numbers below most.

    Blocks are numbered within units of their page and units are offset by the sizes of those before, so that a
    manual with a large share of all rows is never sorted in one task.  Units beyond most are dropped before any sort.
    Rows without a manual or place are left out.
    """
    own = rows.withColumn("_u", F.floor(F.col("block_idx") / UNIT))
    offsets = unit_offsets(own)
    met = own.join(offsets if most is None else offsets.where(F.col("_before") < most), ["manual", "page_idx", "_u"])
    here = F.row_number().over(Window.partitionBy("manual", "page_idx", "_u").orderBy("block_idx")) - 1
    out = met.withColumn(name, (here + F.col("_before")).cast("long")).select(*rows.columns, name)
    return out if most is None else out.where(F.col(name) < most)


def rekeyed(rows: DataFrame) -> DataFrame:
    """Blocks numbered from 0 within their page, in their order; a page of any size is numbered in units."""
    own = rows.withColumn("_u", F.floor(F.col("block_idx") / UNIT))
    units = own.groupBy("manual", "page_idx", "_u").agg(F.count("*").alias("_here"))
    before = Window.partitionBy("manual", "page_idx").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select("manual", "page_idx", "_u", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("manual", "page_idx", "_u").orderBy("block_idx")) - 1
    met = own.join(units, ["manual", "page_idx", "_u"])
    return met.withColumn("block_idx", (here + F.col("_before")).cast("int")).select(*rows.columns)


def sample_blocks(rows: DataFrame, most: int = 100) -> DataFrame:
    """The first blocks of each manual in the order of pages."""
    return numbered(rows, most=most)


def batches(rows: DataFrame, size: int = 100) -> DataFrame:
    """Blocks of each manual in batches of a fixed size, with the position in the batch."""
    return numbered(rows).withColumn("batch", F.floor(F.col("n") / size).cast("long")).withColumn("pos", (F.col("n") % size).cast("long"))


def zip_by_position(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables at the same place; what the shorter side lacks is left out."""
    return a.join(b, keys)


def block_list(text: str = "text") -> Column:
    """Ordered list of the blocks of a page, as an aggregate."""
    return F.array_sort(F.collect_list(F.struct("block_idx", F.coalesce(F.col(text), F.lit("")).alias("text"))))


def assemble_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each page with its ordered blocks, empty where it has none; blocks of pages that are missing are left out."""
    grouped = blocks.groupBy("manual", "page_idx").agg(block_list().alias("blocks"))
    empty = F.array().cast("array<struct<block_idx:int,text:string>>")
    return pages.join(grouped, ["manual", "page_idx"], "left").withColumn("blocks", F.coalesce("blocks", empty))


def page_at(probes: DataFrame, pages: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """First page whose interval (both ends included) holds the point of a probe; pages don't overlap but may touch.

    Intervals are spread over whole-number buckets, so the look-up is an equi-join with a check.
    """
    spread = pages.withColumn("bucket", F.explode(F.sequence(F.floor(low), F.floor(high))))
    met = probes.withColumn("bucket", F.floor(point)).join(spread, ["manual", "bucket"])
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).groupBy(*probes.columns).agg(F.min("page_no").alias("page_no"))


def blocks_at(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks at (manual, page_idx, block_idx), each once however often its key is asked for."""
    return blocks.join(keys.select(*PLACE).distinct(), PLACE, "left_semi")


def union_pages(pages: DataFrame) -> DataFrame:
    """(manual, n, page_idx, pos, block) of all blocks of pages (manual, page_idx, blocks): one list a manual, in the order of pages."""
    each = pages.select("manual", "page_idx", F.posexplode("blocks").alias("block_idx", "block"))
    return numbered(each).select("manual", "n", "page_idx", F.col("block_idx").alias("pos"), "block")
