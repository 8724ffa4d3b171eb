"""Command line: translate, add-url, reindex and list over folders of manuals.

Recognition, translation and language models are providers (module:function) that turn request dictionaries into answers.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import rules
from blockloom.functions.geometry import round4
from blockloom.operators import blocks as B
from blockloom.operators import catalog, cleanup
from blockloom.session import get_spark
from blockloom.sources import manuals, providers

OCR = "doc string, page_num int, success boolean, error string, blocks array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double>>"
TRANSLATED = "doc string, page_num int, block_idx int, text string, x double, y double, width double, height double, translation string"


def is_address(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def load(provider: str):
    module, _, name = provider.partition(":")
    return getattr(importlib.import_module(module), name)


def catalog_rows(spark: SparkSession, root: str) -> DataFrame:
    """Catalog of a folder of manuals, unreadable ones left out, in the order of their names."""
    return manuals.catalog_entries(manuals.read_manuals(spark, root)).orderBy("name")


def translate(spark: SparkSession, doc: str, n_pages: int, ocr, mt, source_lang: str = "ja", target_lang: str = "en", skip_cleanup: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks and failed pages of a document: recognise, drop noise, translate, clean.

    Recognition answers a page with its blocks; their order is kept.
    """
    name = Path(doc).stem
    pages = providers.page_requests(spark.createDataFrame([(name, n_pages)], "doc string, n_pages int"))
    good, bad = providers.split_results(providers.call(pages, ocr, OCR, retry=providers.API))
    found = good.select("doc", "page_num", F.posexplode("blocks").alias("pos", "b")).select("doc", "page_num", "pos", "b.*")
    kept = B.keep_readable(found).withColumn("block_idx", F.row_number().over(B.Window.partitionBy("doc", "page_num").orderBy("pos")) - 1)
    requests = kept.select("doc", "page_num", "block_idx", "text", "x", "y", "width", "height", F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"))
    done = providers.call(requests, mt, TRANSLATED, retry=providers.API)
    out = done.select(F.col("doc").alias("manual"), F.col("page_num").alias("page_idx"), "block_idx", "text", "translation", round4(F.array("x", "y", "width", "height")).alias("bbox"))
    return (out if skip_cleanup else cleanup.rekey(cleanup.drop_by_rule(out))), bad.select("doc", "page_num", "error")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="blockloom")
    parser.add_argument("--root", default="manuals")
    commands = parser.add_subparsers(dest="command", required=True)
    t = commands.add_parser("translate")
    t.add_argument("document")
    t.add_argument("--pages", type=int, required=True)
    t.add_argument("--source-lang", default="ja")
    t.add_argument("--target-lang", default="en")
    t.add_argument("--workers", "-w", type=int, default=3)
    t.add_argument("--skip-cleanup", action="store_true")
    t.add_argument("--product-url", default="")
    t.add_argument("--ocr", required=True)
    t.add_argument("--mt", required=True)
    t.add_argument("--out", required=True)
    a = commands.add_parser("add-url")
    a.add_argument("manual_name")
    a.add_argument("source_url")
    a.add_argument("--out", required=True)
    r = commands.add_parser("reindex")
    r.add_argument("--out", required=True)
    commands.add_parser("list")
    args = parser.parse_args(argv)
    spark = get_spark(master=f"local[{getattr(args, 'workers', 3)}]")
    if args.command == "translate":
        if is_address(args.document):
            print("fetch the document first; the engine reads local paths", file=sys.stderr)
            return 2
        blocks, failed = translate(spark, args.document, args.pages, load(args.ocr), load(args.mt), args.source_lang, args.target_lang, args.skip_cleanup)
        blocks = blocks.persist()
        if not providers.succeeded(blocks):
            print("no block was recognised", file=sys.stderr)
            return 1
        name = Path(args.document).stem
        pages = spark.createDataFrame([(name, i) for i in range(args.pages)], "manual string, page_idx int").withColumn("image", F.concat(F.lit("pages/page-"), F.col("page_idx").cast("string"), F.lit(".webp")))
        empty = spark.createDataFrame([(name,)], "manual string")
        values = {"manual_name": name, "source": Path(args.document).name, "source_lang": args.source_lang, "target_lang": args.target_lang, "source_url": args.product_url, "blog_url": "", "thumbnail": "pages/page-0.webp"}
        fields = [F.lit(v).alias(k) for k, v in values.items()] + [F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("blocks"), F.array().cast("array<string>").alias("tags")]
        manuals.write_manuals(blocks, pages, empty.withColumn("meta", F.struct(*fields)), args.out)
        failed.show(truncate=False)
    elif args.command == "add-url":
        read = manuals.read_manuals(spark, args.root).where(F.col("manual") == args.manual_name)
        new = read.withColumn("meta", F.col("meta").withField("source_url", F.lit(args.source_url)))
        manuals.write_manuals(*manuals.unnest(new), args.out)
    elif args.command == "reindex":
        manuals.write_catalog(catalog_rows(spark, args.root), rules.TAGS, args.out)
    else:
        rows = catalog_rows(spark, args.root)
        for r in rows.toLocalIterator():  # a partition at a time: the list may be long
            print(f"{r.name}\t{r.pages}\t{r.blocks}\t{'yes' if r.source_url else 'no'}")
        print(rows.agg(catalog.count_label(F.count("*")).alias("n")).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
