"""The catalog of manuals: counts, search, facets, links and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import first_non_empty, strip
from blockloom.operators.blocks import latest


def latest_meta(meta: DataFrame) -> DataFrame:
    """One header a manual, the last delivered."""
    return latest(meta.where("manual IS NOT NULL"), ["manual"], "loaded_at", "meta_id")


def block_counts(blocks: DataFrame) -> DataFrame:
    """Pages and blocks of each manual."""
    per_page = blocks.groupBy("manual", "page_idx").agg(F.count("*").alias("b"))
    return per_page.groupBy("manual").agg(F.count("*").alias("pages"), F.sum("b").alias("blocks"))


def corpus_index(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """The catalog: a row a manual that has a header, counts taken from its blocks."""
    head = latest_meta(meta).select(
        "manual",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("thumbnail", F.lit("pages/page-0.webp")).alias("thumbnail"),
        (F.coalesce("source_url", F.lit("")) != "").alias("has_url"),
        F.array_join(F.array_sort(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())), ",").alias("tags"),
    )
    counts = block_counts(blocks)
    zero = F.lit(0).cast("long")
    return head.join(counts, "manual", "left").withColumn("pages", F.coalesce("pages", zero)).withColumn("blocks", F.coalesce("blocks", zero))


def corpus_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("manuals"), F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"))


def search(index: DataFrame, term: str) -> DataFrame:
    """Rows whose name (hyphens as spaces) or source holds the term, case and outer white space aside; all if it is empty."""
    own = term.strip().lower()
    if not own:
        return index
    return index.where(F.lower(F.replace("name", F.lit("-"), F.lit(" "))).contains(own) | F.lower("source").contains(own))


def legacy_search(index: DataFrame, term: str) -> DataFrame:
    """Rows whose name or source, as they are, holds the term as it is, case aside."""
    return index.where(F.lower("name").contains(term.lower()) | F.lower("source").contains(term.lower()))


def with_all_tags(rows: DataFrame, selected: list[str]) -> DataFrame:
    """Rows that have every selected tag; all rows if none is selected."""
    if not selected:
        return rows
    wanted = F.array(*map(F.lit, selected))
    return rows.where(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def toggle(selected: Column, tag: Column) -> Column:
    """The selection with the tag taken out, or put in."""
    return F.when(F.coalesce(F.array_contains(selected, tag), F.lit(False)), F.array_except(selected, F.array(tag))).otherwise(F.array_union(selected, F.array(tag)))


def tag_labels(rows: DataFrame, tag_list: DataFrame, key: str) -> DataFrame:
    """(key, pos, tag_id, label, color) of the tags that the dictionary knows."""
    typed = rows.select(key, F.posexplode("tags").alias("pos", "tag_id"))
    return typed.join(tag_list.select("tag_id", "label", "color"), "tag_id").select(key, "pos", "tag_id", "label", "color")


def count_label(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" manual")).otherwise(F.lit(" manuals")))


def display_name(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))


def display_title(name: Column, source: Column) -> Column:
    return first_non_empty(name, source)


def shown_text(original: bool) -> Column:
    return F.col("text") if original else F.col("translation")


def links(blog_links: Column, blog_url: Column) -> Column:
    """The links as they are, even none; else one of the address; else none."""
    own = "struct<title:string,url:string,translated_url:string>"
    one = F.array(F.struct(F.lit("").alias("title"), blog_url.alias("url"), blog_url.alias("translated_url")).cast(own))
    return F.coalesce(blog_links, F.when(F.coalesce(blog_url, F.lit("")) != "", one), F.array().cast(f"array<{own}>"))


def first_link(blog_links: Column) -> Column:
    return F.coalesce(F.get(blog_links, F.lit(0))["translated_url"], F.lit(""))


def link_line(parts: Column) -> Column:
    """The parts that aren't empty, with spaces between."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def navigation(pages: DataFrame) -> DataFrame:
    """Previous and next page of each page of a manual, held at the ends, and whether it is loaded late."""
    last = pages.groupBy("manual").agg(F.max("page_idx").alias("last"))
    return pages.join(last, "manual").select(
        "manual",
        "page_idx",
        F.greatest(F.lit(0), F.col("page_idx") - 1).alias("previous"),
        F.least(F.col("last"), F.col("page_idx") + 1).alias("next"),
        (F.col("page_idx") >= 2).alias("late"),
    )


def set_source_url(meta: DataFrame, manual: str, url: str) -> DataFrame:
    """Headers with the address of one manual set."""
    return meta.withColumn("source_url", F.when(F.col("manual") == manual, F.lit(url)).otherwise(F.col("source_url")))


def valid_manuals(manuals: DataFrame) -> DataFrame:
    """Nested manuals with a header and pages."""
    return manuals.where("meta IS NOT NULL AND pages IS NOT NULL")


def image_paths(manual: Column, page_idx: Column) -> Column:
    return F.concat(F.lit("manuals/"), manual, F.lit("/pages/page-"), page_idx.cast("string"), F.lit(".webp"))


def workflow_id(stem: Column, at: Column) -> Column:
    """Name of a job: stem with hyphens for white space, and the time."""
    return F.concat(F.lit("translate-"), F.regexp_replace(strip(stem), " ", "-"), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"))
