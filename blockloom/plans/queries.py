"""Queries of the core operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import geometry, rules, text
from blockloom.functions.fix import fix_text
from blockloom.functions.wrap import fit_text
from blockloom.operators import blocks as B
from blockloom.operators import catalog, cleanup, edits, events, nested, web
from blockloom.plans.oracles import ORACLES
from blockloom.session import cuts_dir, table
from blockloom.sources import manuals, providers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LARGE_MANUAL = "grand-compendium"
SITE, BLOG, SEARCH_TERM, SELECTED = "Depot", "blog.example/posts", "driver", ["jubilee", "mecha"]
DEBOUNCE_S, THROTTLE_S = 7200, 7200


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def _blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Blocks as last delivered: row, place and the columns asked for."""
    return B.latest_blocks(table(spark, d, "translations"), "row_id", *columns)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return catalog.corpus_index(_blocks(spark, d), table(spark, d, "meta"))


@query
def corpus_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.corpus_stats(_index(spark, d))


@query
def latest_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("row_id", "manual", "page_idx", "block_idx")


@query
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.lines_as_blocks(table(spark, d, "documents")).select("doc_id", F.col("block_idx").cast("long"), "text")


@query
def block_explode(spark: SparkSession, d: str) -> DataFrame:
    """Nested pages, each with its blocks and some with none, flattened with both positions."""
    pages = _nested_pages(spark, d)
    flat = B.explode_pages(pages.groupBy("manual", "page_idx").agg(F.array(F.first(F.struct("image", "blocks"))).alias("pages")))
    return flat.select("manual", F.col("block_idx").cast("long"), "image", "text", "translation")


@query
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_readable(table(spark, d, "translations").select("row_id", "text"))


@query
def rule_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.drop_by_rule(table(spark, d, "translations").select("row_id", "translation"))


@query
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.rule_counts(table(spark, d, "translations"))


@query
def cleanup_stats(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.stage_counts(table(spark, d, "translations"))


@query
def sample_first_100(spark: SparkSession, d: str) -> DataFrame:
    return B.sample_blocks(_blocks(spark, d).select("row_id", "manual", "page_idx", "block_idx")).select("row_id", F.col("n").cast("long"))


@query
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    return B.batches(_blocks(spark, d).select("row_id", "manual", "page_idx", "block_idx")).select("row_id", "batch", "pos")


@query
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    own = B.numbered(_blocks(spark, d).select("row_id", "manual", "page_idx", "block_idx"))
    return own.select("row_id", F.concat(F.lit("b"), F.col("n").cast("string")).alias("block_id"))


@query
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages").where("page_num IS NOT NULL").select("manual", F.col("page_num").alias("page_idx")).distinct()
    whole = B.assemble_pages(pages, _blocks(spark, d, "text").select("manual", "page_idx", "block_idx", "text"))
    return whole.select("manual", F.col("page_idx").cast("long"), F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("texts"))


@query
def zip_by_position(spark: SparkSession, d: str) -> DataFrame:
    t = _blocks(spark, d, "translation")
    a = B.batches(t.select("manual", "page_idx", "block_idx", "row_id"))
    b = B.batches(t.where("translation IS NOT NULL").select("manual", "page_idx", "block_idx", F.col("row_id").alias("answer_id")))
    keys = ["manual", "batch", "pos"]
    return B.zip_by_position(a.select(*keys, "row_id"), b.select(*keys, "answer_id"), keys).select("row_id", "answer_id")


def _removals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edits").where("op = 'delete'").select("manual", "page_idx", "block_idx")


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "edits").where("op = 'update_text' AND translation IS NOT NULL")
    return own.groupBy("manual", "page_idx", "block_idx").agg(F.max_by("translation", "edit_id").alias("new_translation"))


def _small(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d, "translation")


@query
def remove_keys(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.remove_keys(_small(spark, d), _removals(spark, d)).select("row_id")


@query
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.correct(_small(spark, d), _corrections(spark, d)).select("row_id", "translation")


@query
def rekey_after_delete(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.rekey(cleanup.remove_keys(_small(spark, d), _removals(spark, d))).select("row_id", F.col("block_idx").cast("long"))


@query
def correct_and_remove(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.correct_and_remove(_small(spark, d), _removals(spark, d), _corrections(spark, d)).select("row_id", F.col("block_idx").cast("long"), "translation")


@query
def edit_fold(spark: SparkSession, d: str) -> DataFrame:
    out = edits.fold(_blocks(spark, d, "text", "translation", "bbox"), table(spark, d, "edits"))
    x = F.get("bbox", F.lit(0)), F.get("bbox", F.lit(2))
    return out.select("manual", F.col("page_idx").cast("long"), F.col("block_idx").cast("long"), "text", "translation", x[0].alias("x"), x[1].alias("w"))


@query
def edited_keys(spark: SparkSession, d: str) -> DataFrame:
    return edits.edited_keys(table(spark, d, "edits"))


@query
def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").select("meta_id", F.array_join(rules.tags_of(F.col("name"), F.col("source")), ",").alias("tags"))


@query
def tag_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tag_labels(table(spark, d, "meta"), table(spark, d, "tag_list"), "meta_id").withColumn("pos", F.col("pos").cast("long"))


@query
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    used = catalog.latest_meta(table(spark, d, "meta")).select("manual", F.explode(F.array_distinct("tags")).alias("tag_id")).groupBy("tag_id").agg(F.count("*").alias("k"))
    own = table(spark, d, "tag_list").join(used, "tag_id", "left").withColumn("n", F.coalesce("k", F.lit(0).cast("long")))
    return own.select("tag_id", "n", catalog.count_label(F.col("n")).alias("shown"))


@query
def tag_filter_all(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_all_tags(table(spark, d, "meta"), SELECTED).select("meta_id")


@query
def tag_toggle(spark: SparkSession, d: str) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return table(spark, d, "meta").select("meta_id", F.coalesce(F.array_contains(catalog.toggle(tags, F.lit("jubilee")), "jubilee"), F.lit(False)).alias("on"))


@query
def search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(_index(spark, d), f" {SEARCH_TERM.upper()} ").select("manual")


@query
def legacy_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.legacy_search(_index(spark, d), SEARCH_TERM).select("manual")


@query
def display_titles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta")
    return m.select("meta_id", catalog.display_title(F.col("name"), F.col("source")).alias("title"), catalog.display_name(F.col("manual")).alias("shown"), (F.coalesce("source_url", F.lit("")) != "").alias("has_url"))


@query
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").select("meta_id", text.slug(F.col("name")).alias("handle"))


@query
def slug_variants(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "meta").select("meta_id", F.concat("name", F.lit(" Memorial Next Set Set-v2")).alias("name"))
    return named.select("meta_id", F.array_join(text.slug_variants(text.slug(F.col("name"))), ",").alias("handles"))


@query
def first_match(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "product_list").select(text.slug(F.col("name")).alias("handle"), F.col("ref_id").alias("product"))
    return web.first_match(table(spark, d, "meta").where("name IS NOT NULL"), products, "meta_id", "name")


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the headers: with a title, a description in one of two places and links."""
    m = table(spark, d, "meta").withColumn("n", F.coalesce("name", F.lit("")))
    blog = F.concat(F.lit(f"https://{BLOG}/"), "manual")
    parts = [
        F.lit("<html><head><title>"), F.col("n"), F.lit(f" | {SITE}</title>"),
        F.when(F.col("meta_id") % 2 == 0, F.concat(F.lit('<meta property="og:description" content="A &quot;'), "manual", F.lit('&quot; &amp; more"></head>'))).otherwise(F.lit("</head>")),
        F.lit('<div class="product-description">The <b>'), F.col("manual"), F.lit("</b>\n  toy</div>"),
        F.lit('<a href="'), blog, F.lit('-one"> <a href="'), blog, F.lit('-two"> <a href="'), blog, F.lit(f'-one"> <a href="https://{BLOG}/"></html>'),
    ]
    return m.select("meta_id", "name", F.concat(*parts).alias("html"))


@query
def title_extract(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("meta_id", web.product_name(F.col("html"), SITE).alias("title"))


@query
def description_extract(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("meta_id", web.product_description(F.col("html")).alias("description"))


@query
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("meta_id", text.collapse(text.strip_tags(F.col("html"))).alias("plain"))


@query
def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", text.escape_html(F.col("translation")).alias("escaped"), text.decode_entities(text.escape_html(F.col("translation"))).alias("decoded"))


@query
def links_distinct_3(spark: SparkSession, d: str) -> DataFrame:
    found = web.post_links(F.col("html"), BLOG)
    return _html(spark, d).select("meta_id", F.array_join(found, " ").alias("links"), F.array_join(F.transform(found, text.url_title), "|").alias("titles"))


@query
def search_link(spark: SparkSession, d: str) -> DataFrame:
    links = web.blog_links(F.lit(""), F.concat("name", F.lit(" Clear Set")), BLOG)
    return table(spark, d, "meta").where("name IS NOT NULL").select("meta_id", F.get(links, F.lit(0))["title"].alias("title"), F.size(links).cast("long").alias("n"))


@query
def url_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").where("source_url IS NOT NULL").select("meta_id", F.concat(F.lit(web.TRANSLATE), text.quote(F.concat("source_url", F.lit("?q=a b*~é+/")))).alias("address"))


@query
def strip_and_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", text.strip(F.col("text")).alias("stripped"), text.collapse(F.col("translation")).alias("collapsed"))


@query
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").where("name IS NOT NULL").select("meta_id", text.title_case(F.col("name")).alias("title"))


@query
def list_marks(spark: SparkSession, d: str) -> DataFrame:
    mark = text.list_mark(F.col("translation"))
    return table(spark, d, "translations").select("row_id", mark["mark"].alias("mark"), mark["rest"].alias("rest"))


@query
def list_split(spark: SparkSession, d: str) -> DataFrame:
    items = text.split_list(F.col("translation"))
    return table(spark, d, "translations").where("translation IS NOT NULL").select("row_id", F.size(items).cast("long").alias("n"), F.get(items, F.lit(0)).alias("first"))


@query
def wrapped_text(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.pixels(F.col("bbox"), 1000, 1400)
    fit = fit_text(text.split_list(F.col("translation")), F.get(box, F.lit(2)), F.get(box, F.lit(3)))
    rows = table(spark, d, "translations").where("translation IS NOT NULL").select("row_id", fit.alias("fit"))
    return rows.select("row_id", "fit.size", F.size("fit.lines").alias("n_lines"), F.coalesce(F.array_max("fit.lines.indent"), F.lit(0)).alias("indent"))


@query
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Sure! "), "props", F.lit(" Hope it helps."))
    return table(spark, d, "events").select("event_id", F.from_json(text.embedded_json(answer), "k long")["k"].alias("k"))


@query
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model gives them, made of the log of edits, parsed and applied."""
    e = table(spark, d, "edits").where("op = 'update_text' AND translation IS NOT NULL")
    body = F.to_json(F.struct(F.map_from_entries(F.array(F.struct(F.concat_ws("-", "page_idx", "block_idx"), F.col("translation")))).alias("corrections"), F.array(F.lit("x-1")).alias("remove")))
    parsed = cleanup.parse_answer(e.select("edit_id", "manual", F.concat(F.lit("Here: "), body, F.lit(" .")).alias("answer")))
    key = F.get(F.map_keys("corrections"), F.lit(0))
    return parsed.select("edit_id", text.block_key(key)["page_idx"].cast("long").alias("page_idx"), text.block_key(key)["block_idx"].cast("long").alias("block_idx"), F.get(F.map_values("corrections"), F.lit(0)).alias("translation"), text.block_key(F.get("remove", F.lit(0)))["page_idx"].isNull().alias("rejected"))


@query
def bbox_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", geometry.is_box(F.col("bbox")).alias("ok"))


def _quad(box, names=("x", "y", "w", "h")):
    return [F.get(box, F.lit(i)).alias(n) for i, n in enumerate(names)]


@query
def bbox_clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", *_quad(geometry.clamp(F.col("bbox"))))


@query
def bbox_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.pixels(F.col("bbox"), 1000, 1400)
    rows = table(spark, d, "translations").select("row_id", p.alias("p")).where(geometry.large_enough(F.col("p")))
    return rows.select("row_id", *(c.cast("long").alias(n) for c, n in zip(_quad(F.col("p")), ("x", "y", "w", "h"))), geometry.font_size(F.get("p", F.lit(3))).cast("long").alias("size"))


@query
def bbox_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", *_quad(geometry.round4(F.col("bbox"))))


@query
def render_zoom(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_pages").select("page_id", geometry.render_zoom(F.col("n_blocks") * 300.0, F.lit(595.0)).alias("zoom"))


@query
def interval_hit(spark: SparkSession, d: str) -> DataFrame:
    t = _blocks(spark, d, "bbox")
    pages = table(spark, d, "translations").select("manual", F.col("page_idx").alias("page_no")).distinct().withColumn("top", F.col("page_no").cast("double")).withColumn("bottom", F.col("page_no") + 1.0)
    centre = F.col("page_idx") + F.get("bbox", F.lit(1)) + F.get("bbox", F.lit(3)) / 2
    probes = t.where(geometry.is_box(F.col("bbox"))).select("row_id", "manual", centre.alias("c"))
    return B.page_at(probes, pages, "c", "top", "bottom").select("row_id", F.col("page_no").cast("long"))


@query
def page_navigation(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "translations").select("manual", "page_idx").distinct()
    return catalog.navigation(pages).select("manual", *(F.col(c).cast("long") for c in ("page_idx", "previous", "next")), "late")


@query
def ocr_quarantine(spark: SparkSession, d: str) -> DataFrame:
    good, bad = providers.split_results(table(spark, d, "ocr_pages"))
    return good.select("page_id", F.lit(True).alias("good"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("page_id", F.lit(False).alias("good"), "error"))


@query
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ocr_pages").withColumn("status", F.when(F.col("success"), "ok").when(~F.col("success"), F.coalesce("error", F.lit("failed"))))
    return events.changes(rows, "manual", "status", ["page_num", "page_id"], F.floor(F.col("page_num") / 64)).select("page_id", "status")


@query
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return events.latest_state(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return events.debounce(table(spark, d, "events"), "user_id", "ts", "event_id", DEBOUNCE_S)


@query
def throttle(spark: SparkSession, d: str) -> DataFrame:
    return events.throttle(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", THROTTLE_S).select("user_id", "event_id")


@query
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_pages").where(events.every(F.col("page_num"))).select("page_id", "page_num")


@query
def fixed_text(spark: SparkSession, d: str) -> DataFrame:
    out, _ = cleanup.repair_encoding(table(spark, d, "translations").select("row_id", "translation"), fix_text)
    return out


@query
def fix_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.repair_encoding(table(spark, d, "translations"), fix_text)[1]


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Instructions with product, tags and the first blocks of each manual, as they go to a language model."""
    sampled = B.sample_blocks(_blocks(spark, d, "text", "translation"))
    head = catalog.latest_meta(table(spark, d, "meta")).select("manual", "name", "source_url", F.lit("").alias("description"))
    return providers.prompt(sampled, head, rules.TAGS)


@query
def model_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Stage 3 from end to end: answers made of the log of edits, parsed, keyed, checked and applied."""
    removals, corrections, _ = cleanup.keyed_answer(cleanup.parse_answer(_answers(spark, d)))
    return cleanup.correct_and_remove(_small(spark, d), removals, corrections).select("row_id", F.col("block_idx").cast("long"), "translation")


@query
def cleanup_result(spark: SparkSession, d: str) -> DataFrame:
    """Figures of all three stages."""
    _, figures = cleanup.clean(_small(spark, d), _answers(spark, d), fix_text)
    return figures


@query
def rejected_keys(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.keyed_answer(cleanup.parse_answer(_answers(spark, d)))[2]


@query
def accepted_tags(spark: SparkSession, d: str) -> DataFrame:
    sure = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("meta_id") % 3 + 1).cast("int"))
    known, free = (cleanup.accept_tags(F.col("tags"), sure, k) for k in (SELECTED, None))
    return table(spark, d, "meta").select("meta_id", F.array_join(known, ",").alias("known"), F.array_join(F.array_compact(free), ",").alias("every"), F.array_join("tags", ",").alias("unsorted"))


@query
def anchored_text(spark: SparkSession, d: str) -> DataFrame:
    """Pieces at segments: from the start, after a gap, and an empty one."""
    none = F.lit(None).cast("long")
    one = lambda a, b: F.struct((F.lit(a) if a is not None else none).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    return table(spark, d, "translations").select("row_id", geometry.anchored(F.col("text"), F.array(one(None, 2), one(4, 9), one(5, 5))).alias("piece"))


@query
def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of four corners, the first without coordinates that are 0; three corners make none."""
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    corner = lambda a, b: F.struct(F.nullif(a, F.lit(0.0)).alias("x"), F.nullif(b, F.lit(0.0)).alias("y"))
    corners = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    rows = table(spark, d, "translations").where(geometry.is_box(F.col("bbox")))
    box = geometry.from_polygon(F.when(F.col("row_id") % 5 == 0, F.slice(corners, 1, 3)).otherwise(corners))
    return rows.select("row_id", *_quad(box))


@query
def bbox_shown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").where(geometry.is_box(F.col("bbox")))
    return rows.select("row_id", F.array_join(geometry.shown(F.col("bbox")), " ").alias("shown"), *_quad(geometry.percent(F.col("bbox"))))


@query
def manual_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of a header: as they are, of its one address, or none."""
    own = F.array(F.struct(F.lit("t").alias("title"), F.col("source_url").alias("url"), F.col("blog_url").alias("translated_url")))
    given = F.when(F.col("meta_id") % 3 == 0, own).when(F.col("meta_id") % 3 == 1, F.slice(own, 1, 0))
    rows = table(spark, d, "meta").select("meta_id", catalog.links(given, F.col("blog_url")).alias("l"))
    return rows.select("meta_id", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0))["url"].alias("url"), catalog.first_link(F.col("l")).alias("first"))


@query
def link_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").select("meta_id", catalog.link_line(F.array("source_url", "blog_url", "thumbnail")).alias("line"))


@query
def image_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_pages").select("page_id", catalog.image_paths(F.col("manual"), F.col("page_num")).alias("path"))


@query
def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("row_id", catalog.shown_text(True).alias("original"), catalog.shown_text(False).alias("shown"))


@query
def url_set(spark: SparkSession, d: str) -> DataFrame:
    return catalog.set_source_url(table(spark, d, "meta"), LARGE_MANUAL, "https://shop.example/1").select("meta_id", "source_url")


@query
def shifted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of edited blocks of all manuals after block 2 of page 1 is deleted."""
    keys = table(spark, d, "edits").where("op <> 'add'").select("manual", "page_idx", "block_idx").distinct()
    return edits.shifted(keys, 1, 2).select("manual", *(F.col(c).cast("long") for c in ("page_idx", "block_idx")))


@query
def block_at(spark: SparkSession, d: str) -> DataFrame:
    return B.blocks_at(_small(spark, d), table(spark, d, "edits")).select("row_id")


@query
def union_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all pages of a manual as one list, from nested pages."""
    t = _blocks(spark, d).groupBy("manual", "page_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "row_id"))), lambda b: b["row_id"]).alias("blocks"))
    return B.union_pages(t).select(F.col("block").alias("row_id"), "n", F.col("pos").cast("long"))


@query
def known_addresses(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "meta").where("blog_url IS NOT NULL").select(F.col("source_url").alias("url")).distinct()
    return web.existing(table(spark, d, "meta").select("meta_id", F.col("source_url").alias("url")), known).select("meta_id")


@query
def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recognition answered from records: pages asked for and what was recorded of them."""
    asked = table(spark, d, "translations").select("manual", "page_idx").distinct()
    own = table(spark, d, "ocr_pages").where("page_num IS NOT NULL").select("manual", F.col("page_num").alias("page_idx"), "page_id", "ocr_at", "n_blocks")
    answers = B.latest(own, ["manual", "page_idx"], "ocr_at", "page_id")
    return providers.recorded(asked, answers, ["manual", "page_idx"]).select("manual", F.col("page_idx").cast("long"), "page_id", "n_blocks")


@query
def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """A live provider's part played by a function: upper case of each translation, asked in batches."""

    def shout(requests: list[dict]) -> list[dict]:
        return [{"row_id": r["row_id"], "answer": r["translation"].upper()} for r in requests]

    asked = table(spark, d, "translations").where("translation IS NOT NULL").select("row_id", F.regexp_replace("translation", r"[^ -~]", "").alias("translation"))
    return providers.call(asked, shout, "row_id long, answer string")


@query
def page_requests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "meta").select(F.col("meta_id").cast("string").alias("doc"), F.col("pages").cast("int").alias("n_pages"))
    return providers.page_requests(docs).select("doc", F.col("page_num").cast("long"))


@query
def image_forms(spark: SparkSession, d: str) -> DataFrame:
    """Kind and quality in which a page's picture is sent, by its size."""
    size = F.col("n_blocks") * 700_000
    form = geometry.image_form(size)
    return table(spark, d, "ocr_pages").select("page_id", form["mime"].alias("mime"), form["quality"].cast("long").alias("quality"))


@query
def address_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta").select("meta_id", F.coalesce(text.is_address(F.col("source_url")), F.lit(False)).alias("remote"), F.coalesce(text.is_address(F.col("source")), F.lit(False)).alias("local"))


@query
def folder_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of folders from percent-encoded paths."""
    path = F.concat(F.lit("file:/corpus/"), F.replace(F.url_encode(F.concat("manual", F.lit(" 取扱+1"))), F.lit("+"), F.lit("%20")), F.lit("/translations.json"))
    return table(spark, d, "meta").where("manual IS NOT NULL").select("meta_id", manuals.folder_name(path).alias("folder"), manuals.editor_link(F.col("manual"), "https://edit.example/x/").alias("editor"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """(manual, answer): answers as a model gives them, of the last text and of the deletes of the log, and a malformed key."""
    log = table(spark, d, "edits")
    key = F.concat_ws("-", "page_idx", "block_idx")
    new = _corrections(spark, d).select("manual", F.map_from_entries(F.array(F.struct(key, F.col("new_translation")))).alias("corrections"), F.array().cast("array<string>").alias("remove"))
    gone = log.where("op = 'delete'").select("manual", F.lit(None).cast("map<string,string>").alias("corrections"), F.array(key, F.concat(F.lit("x-"), "block_idx")).alias("remove"))
    return new.unionByName(gone).select("manual", F.concat(F.lit("Here: "), F.to_json(F.struct("corrections", "remove")), F.lit(" .")).alias("answer"))


def _nested_pages(spark: SparkSession, d: str) -> DataFrame:
    """(manual, page_idx, image, blocks) of the recognised pages, some without blocks."""
    pages = table(spark, d, "ocr_pages").where("page_num IS NOT NULL").select("manual", F.col("page_num").alias("page_idx")).distinct()
    block = F.struct("block_idx", F.struct("text", "translation", "bbox").alias("block"))
    own = _blocks(spark, d, "text", "translation", "bbox").groupBy("manual", "page_idx").agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]).alias("blocks"))
    return pages.withColumn("image", catalog.image_paths(F.col("manual"), F.col("page_idx"))).join(own, ["manual", "page_idx"], "left")


@query
def job_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta").where("source IS NOT NULL AND loaded_at IS NOT NULL")
    return m.select("meta_id", catalog.workflow_id(F.regexp_replace("source", r"[.]pdf$", ""), F.col("loaded_at")).alias("job"))


@query
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of the recognition of each manual: pages that succeeded of all."""
    pages = table(spark, d, "ocr_pages").groupBy("manual").agg(F.count_if(F.coalesce("success", F.lit(False))).alias("done"), F.count("*").alias("total"))
    return pages.select("manual", "done", "total", events.progress(F.lit("ocr"), F.col("done"), F.col("total")).alias("steps"), (F.col("done") > 0).alias("success"))


def _written(spark: SparkSession, d: str) -> str:
    """Where all manuals are written as JSON in the shared folder."""
    t = table(spark, d, "translations").withColumn("delivered", B.moment("loaded_at", "row_id"))
    pages = t.select("manual", "page_idx").distinct().withColumn("image", catalog.image_paths(F.col("manual"), F.col("page_idx")))
    m = catalog.latest_meta(table(spark, d, "meta"))
    none = F.lit(None).cast("array<struct<title:string,url:string,translated_url:string>>")
    head = m.select("manual", F.struct(F.col("name").alias("manual_name"), "source", "source_lang", "target_lang", "source_url", "blog_url", "pages", "blocks", "thumbnail", "tags", none.alias("blog_links")).alias("meta"))
    where = f"{cuts_dir(spark)}/manuals-{uuid.uuid4().hex}"
    manuals.write_manuals(t, pages, head, where)
    return where


@query
def manual_documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus after a round trip through a folder a manual."""
    blocks = manuals.read_blocks(spark, _written(spark, d))
    return blocks.select("manual", F.col("page_idx").cast("long"), F.col("block_idx").cast("long"), "text", "translation", F.get("bbox", F.lit(0)).alias("x"), F.size("bbox").cast("long").alias("n"))


@query
def manual_headers(spark: SparkSession, d: str) -> DataFrame:
    return manuals.read_summaries(spark, _written(spark, d)).select("manual", "meta.manual_name", "meta.source", "meta.blog_url", "meta.pages", "meta.blocks", F.size("meta.tags").cast("long").alias("n_tags"), "broken")


@query
def catalog_document(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the catalog document made of a folder of manuals, read back from its lines."""
    lines = manuals.catalog_lines(manuals.entries_of(manuals.read_summaries(spark, _written(spark, d))), rules.TAGS).where("part = 1")
    entry = F.from_json(F.regexp_replace("value", "^,", ""), "name string, source string, pages bigint, blocks bigint, thumbnail string, source_url string, blog_url string, tags array<string>")
    return lines.select(entry.alias("e")).select("e.name", "e.source", "e.pages", "e.blocks", "e.thumbnail", "e.source_url", "e.blog_url", F.array_join("e.tags", ",").alias("tags"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_manuals(table(spark, d, "manual_raw"), values=False)


@query
def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """All related tables in one frame, told apart by kind."""
    return nested.flatten_manuals(table(spark, d, "manual_raw"))


def _related(name: str) -> Query:
    return lambda spark, d: nested.manual_table(table(spark, d, "manual_raw"), name)


for _name in nested.TABLES:
    QUERIES[f"p6_{_name}"] = _related(_name)


__all__ = ["ORACLES", "QUERIES"]
