"""Manuals as nested JSON: reading folders, writing manuals and the catalog.

A manual is the folder ``<name>/translations.json``.  Writing streams: each manual is a sequence of lines (its header,
then each page and block in order) that one task writes as they come from an external sort, so neither a manual nor a
page is ever collected, however large.  What is written is what is read again: ``read_manuals`` gives a nested row a
manual, ``read_summaries`` what a catalog needs of each and ``read_blocks`` the blocks, in streams too.
"""

from __future__ import annotations

import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from blockloom.session import cut
from blockloom.sources import folders

BLOCK = "struct<text:string,translation:string,bbox:array<double>>"
PAGE = f"struct<image:string,blocks:array<{BLOCK}>>"
META = (
    "struct<manual_name:string,source:string,source_lang:string,target_lang:string,source_url:string,blog_url:string,"
    "pages:bigint,blocks:bigint,thumbnail:string,tags:array<string>,blog_links:array<struct<title:string,url:string,translated_url:string>>>"
)
SCHEMA = f"meta {META}, pages array<{PAGE}>, _corrupt_record string"
FILE = folders.FILE
#: Thumbnail of a manual without pages.
NO_THUMBNAIL = "pages/page-0.webp"
KEEP_NULLS = {"ignoreNullFields": "false"}


def folder_name(path: Column) -> Column:
    """Name of the folder that holds a file; file paths are percent-encoded, a plus sign stands for itself."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B")))


def read_manuals(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(manual, meta, pages, broken) of each folder under root that holds a manual; unreadable files are marked.

    ``strict`` fails on an unreadable file instead.
    """
    reader = spark.read.schema(T._parse_datatype_string(SCHEMA)).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.json(f"{root.rstrip('/')}/*/{FILE}").withColumn("manual", folder_name(F.col("_metadata.file_path")))
    # the second condition never holds; a query may not read the column of bad records alone
    broken = F.col("_corrupt_record").isNotNull() | (F.size("pages") < -1)
    return rows.select("manual", "meta", "pages", F.coalesce(broken, F.lit(False)).alias("broken"))


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _each_folder(spark: SparkSession, root: str, read, schema: pa.Schema) -> DataFrame:
    """What read gives of the folders under root, which are listed by one task and dealt to as many as a shuffle has."""
    uri = _uri(spark, root)
    names = spark.range(0, 1, 1, 1).mapInArrow(partial(folders.folders, uri=uri), "manual string")
    names = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.mapInArrow(partial(read, uri=uri), from_arrow_schema(schema))


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """(manual, meta, n_pages, n_blocks, image, broken) as summaries gives them of read_manuals, but no manual is ever a row."""
    rows = _each_folder(spark, root, folders.heads, folders.HEADS)
    odd = summaries(rows.where("raw IS NOT NULL").select("manual", F.from_json("raw", SCHEMA).alias("m")).select("manual", "m.meta", "m.pages", F.col("m._corrupt_record").isNotNull().alias("broken")))
    sound = rows.where("raw IS NULL").select("manual", F.from_json("head", META).alias("meta"), "n_pages", "n_blocks", "image", "broken")
    return sound.unionAll(odd)


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks, as unnest gives them, of the valid manuals under root; a manual comes in pieces, however large it is."""
    rows = _each_folder(spark, root, folders.blocks, folders.BLOCKS)
    read = F.from_json("raw", SCHEMA)
    block = lambda p, b, v: F.struct(p.cast("long").alias("page_idx"), b.cast("long").alias("block_idx"), v["text"].alias("text"), v["translation"].alias("translation"), v["bbox"].alias("bbox"))
    own = F.array(F.struct("page_idx", "block_idx", "text", "translation", "bbox"))
    none = F.slice(own, 1, 0)
    page = lambda v, p: F.coalesce(F.transform(v["blocks"], lambda x, b: block(p, b, x)), none)
    odd = F.when(read["meta"].isNotNull(), F.flatten(F.transform(read["pages"], page)))
    return rows.select("manual", F.inline(F.when(F.col("raw").isNull(), own).otherwise(odd)))


def summaries(manuals: DataFrame) -> DataFrame:
    """(manual, meta, n_pages, n_blocks, image, broken) of nested manuals; counts are null without pages, the image is the first page's."""
    blocks = F.aggregate("pages", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(F.size(p["blocks"]), F.lit(0)))
    return manuals.select("manual", "meta", F.size("pages").cast("long").alias("n_pages"), blocks.alias("n_blocks"), F.get("pages", F.lit(0))["image"].alias("image"), "broken")


def unnest(manuals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, pages and headers of nested manuals, as manual_lines takes them."""
    pages = manuals.select("manual", F.posexplode("pages").alias("page_idx", "page"))
    blocks = pages.select("manual", "page_idx", F.posexplode("page.blocks").alias("block_idx", "block")).select("manual", "page_idx", "block_idx", "block.*")
    return blocks, pages.select("manual", "page_idx", "page.image"), manuals.select("manual", "meta")


def _json_string(c: Column) -> Column:
    """A string as a JSON value, null as null."""
    listed = F.to_json(F.array(c), KEEP_NULLS)
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _nil() -> Column:
    """Which positions of a block are null."""
    return F.when(F.col("page_idx").isNull(), F.lit(2)).otherwise(F.lit(0)) + F.when(F.col("block_idx").isNull(), F.lit(1)).otherwise(F.lit(0))


def manual_lines(blocks: DataFrame, pages: DataFrame, meta: DataFrame) -> DataFrame:
    """(manual, page, part, block, value, line): the lines of each manual's JSON, to be put in the order of the first five.

    Manuals are those of meta; counts in their headers are those of the pages and blocks written.  Blocks of pages that
    are missing are left out; of pages that come twice one counts, repeated blocks stand each; null positions count as
    the first.  Parts are 0 for the opening of a page, 1 for its blocks, 2 for its end; -1 for the header, before all pages.
    Text is shuffled once, by manual: whether its page is there is told by the lines before it.  Where blocks have a number
    ``delivered``, only that with the highest stands of those at one place, so text isn't shuffled for that either.
    """
    at = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    nulls = lambda s: F.to_json(s, KEEP_NULLS)
    own = pages.select("manual", at("page_idx").alias("page"), "image").groupBy("manual", "page").agg(F.min("image").alias("image"))
    own = own.join(meta.select("manual").distinct(), "manual", "left_semi")
    again = "delivered" in blocks.columns
    once = blocks.select("manual", "page_idx", "block_idx").distinct() if again else blocks
    here = once.groupBy("manual", at("page_idx").alias("page")).agg(F.count("*").alias("n"))
    own = cut(own.join(here, ["manual", "page"], "left"))
    body = blocks.select("manual", at("page_idx").alias("page"), at("block_idx").alias("block"), nulls(F.struct("text", "translation", F.col("bbox").cast("array<double>").alias("bbox"))).alias("value"), *([_nil().alias("nil"), "delivered"] if again else []))
    totals = own.groupBy("manual").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_blocks"))
    zero, first, last = F.lit(0).cast("long"), F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    counts = F.col("meta").withField("pages", F.coalesce("n_pages", zero)).withField("blocks", F.coalesce("n_blocks", zero))
    head = meta.join(totals, "manual", "left").withColumn("meta", counts)

    def lines(rows: DataFrame, page: Column, part: int, block: Column, *value: Column) -> DataFrame:
        place = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("nil", "int"), ("delivered", "decimal(38,0)"))] if again else []
        return rows.select("manual", page.alias("page"), F.lit(part).alias("part"), block.alias("block"), *place, F.concat(*value).alias("value"))

    rows = (
        lines(head, first, -1, zero, F.lit('{"meta": '), nulls(F.col("meta")), F.lit(', "pages": ['))
        .unionAll(lines(own, F.col("page"), 0, zero, F.lit('{"image": '), _json_string(F.col("image")), F.lit(', "blocks": [')))
        .unionAll(lines(body, F.col("page"), 1, F.col("block"), F.col("value")))
        .unionAll(lines(own, F.col("page"), 2, zero, F.lit("]}")))
        .unionAll(lines(head, last, 2, zero, F.lit("]}")))
    )
    order = Window.partitionBy("manual").orderBy("page", "part", "block", *(["nil", "delivered"] if again else []), "value")
    if again:
        place = ["page", "part", "block", "nil"]
        after = F.lead(F.struct(*place)).over(order)
        rows = rows.withColumn("_after", after).where((F.col("part") != 1) | F.coalesce(F.col("_after") != F.struct(*place), F.lit(True)))
    opened = F.max(F.when(F.col("part") == 0, F.col("page")))
    rows = rows.withColumns({"_before": F.lag("part").over(order), "_open": opened.over(order.rowsBetween(Window.unboundedPreceding, 0)), "_earlier": opened.over(order.rowsBetween(Window.unboundedPreceding, -1))})
    comma = ((F.col("part") == 1) & (F.col("_before") == 1)) | ((F.col("part") == 0) & F.col("_earlier").isNotNull())
    whole = rows.where((F.col("part") != 1) | F.coalesce(F.col("_open") == F.col("page"), F.lit(False)))
    return whole.select("manual", "page", "part", "block", *(["nil", "delivered"] if again else []), "value", F.concat(F.when(comma, F.lit(",")).otherwise(F.lit("")), F.col("value")).alias("line"))


def write_manuals(blocks: DataFrame, pages: DataFrame, meta: DataFrame, path: str) -> None:
    """A folder a manual with its JSON, in a new version of the corpus; never over what is being read.

    Rows without a manual are left out.  Names must be names of folders: '/', ':' or dots alone are an error.
    """
    spark = meta.sparkSession
    named = meta.where("manual IS NOT NULL")
    wrong = named.where(F.col("manual").rlike(r"[/:\x00]|^[.]*$")).select("manual").first()
    if wrong is not None:
        raise ValueError(f"no name of a folder: {wrong[0]!r}")
    jvm, conf = spark.sparkContext._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if files.exists(root):
        raise FileExistsError(path)
    lines = manual_lines(blocks, pages, named)
    lines = lines.sortWithinPartitions(*(c for c in lines.columns if c != "line"))
    staged = jvm.org.apache.hadoop.fs.Path(root.getParent(), f"_{root.getName()}-{uuid.uuid4().hex}")
    files.mkdirs(staged)
    try:
        written = lines.select("manual", F.concat("line", F.lit("\n")).alias("line")).mapInArrow(partial(folders.write, uri=_uri(spark, staged.toString())), "n long")
        written.write.format("noop").mode("overwrite").save()
        files.rename(staged, root)  # as a committer does: no data is moved
    finally:
        files.delete(staged, True)


def catalog_entries(manuals: DataFrame) -> DataFrame:
    """As entries_of, of nested manuals."""
    return entries_of(summaries(manuals))


def entries_of(found: DataFrame) -> DataFrame:
    """(name, source, pages, blocks, thumbnail, source_url, blog_url, tags) of summaries of manuals, unreadable ones left out.

    Name is that of the folder; tags are null where the header has none.
    """
    has = found.where("NOT coalesce(broken, false)")
    return has.select(
        F.col("manual").alias("name"),
        F.coalesce("meta.source", "manual").alias("source"),
        F.coalesce("n_pages", F.lit(0).cast("long")).alias("pages"),
        F.coalesce("n_blocks", F.lit(0).cast("long")).alias("blocks"),
        F.concat("manual", F.lit("/"), F.coalesce("image", F.lit(NO_THUMBNAIL))).alias("thumbnail"),
        F.coalesce("meta.source_url", F.lit("")).alias("source_url"),
        F.coalesce("meta.blog_url", F.lit("")).alias("blog_url"),
        F.col("meta.tags").alias("tags"),
    )


def catalog_lines(entries: DataFrame, tags: dict[str, tuple[str, str]]) -> DataFrame:
    """(part, name, value): the lines of the catalog document in their order: manuals by name, then tags and totals.

    Entries are one line each and only their totals are aggregated, so the document isn't held anywhere as a whole.
    """
    entries = cut(entries)  # one short row a manual; else all manuals would be read for the first name, the rows and the totals
    known = F.create_map(*(x for t, (color, label) in tags.items() for x in (F.lit(t), F.struct(F.lit(color).alias("color"), F.lit(label).alias("label")))))
    one = entries.select(F.lit(1).alias("part"), "name", F.to_json(F.struct(*entries.columns)).alias("value"))
    first = one.groupBy("part").agg(F.min("name").alias("first"))  # names are those of folders, so no two are equal
    marked = one.join(F.broadcast(first), "part").withColumn("comma", F.when(F.col("name") == F.col("first"), F.lit("")).otherwise(F.lit(",")))
    totals = entries.agg(F.count("*").alias("total_manuals"), F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("total_blocks"))
    tail = totals.select(F.lit(2).alias("part"), F.lit("").alias("name"), F.concat(F.lit('], "tags": '), F.to_json(known), F.lit(', "stats": '), F.to_json(F.struct(*totals.columns)), F.lit("}")).alias("value"))
    head = entries.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("name"), F.lit('{"manuals": [').alias("value"))
    return head.unionAll(marked.select("part", "name", F.concat("comma", "value").alias("value"))).unionAll(tail)


def write_catalog(entries: DataFrame, tags: dict[str, tuple[str, str]], path: str) -> None:
    """The catalog document, as one text file written as a stream."""
    lines = catalog_lines(entries, tags).repartition(1).sortWithinPartitions("part", "name", "value")
    lines.select("value").write.mode("overwrite").text(path)


def export_edited(blocks: DataFrame, pages: DataFrame, meta: DataFrame, edited: DataFrame, path: str) -> None:
    """JSON of the manuals that have an edit (of any kind)."""
    write_manuals(blocks, pages, meta.join(edited.select("manual").distinct(), "manual", "left_semi"), path)


def editor_link(manual, base: str):
    """Address of a manual's file in an editor, as a column; nothing is called."""
    return F.concat(F.lit(base.rstrip("/") + "/"), manual, F.lit(f"/{FILE}"))
