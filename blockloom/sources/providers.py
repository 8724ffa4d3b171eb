"""Replaceable providers of what lies outside of the engine, and recorded ones that make jobs repeatable.

A provider turns a batch of request dictionaries into as many answer dictionaries.  Recorded providers look answers up;
live ones are given by the caller.  Calls are retried with growing pauses.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockloom.functions.geometry import image_form, render_zoom


class Provider(Protocol):
    """Answers to a batch of requests, in their order."""

    def __call__(self, requests: list[dict]) -> list[dict]: ...


@dataclass(frozen=True)
class Retry:
    """Attempts and pauses in seconds: first, most, growth."""

    attempts: int
    first: float
    most: float
    growth: float = 2.0

    def run(self, call: Callable[[], list[dict]], sleep: Callable[[float], None] = time.sleep) -> list[dict]:
        pause = self.first
        for k in range(self.attempts):
            try:
                return call()
            except Exception:
                if k + 1 == self.attempts:
                    raise
                sleep(min(pause, self.most))
                pause *= self.growth
        return []


QUICK, API, MODEL = Retry(3, 1, 10), Retry(5, 2, 30), Retry(3, 5, 120)


def call(rows: DataFrame, provider: Provider, schema: str | StructType, batch: int = 100, retry: Retry = API) -> DataFrame:
    """Answers of a provider for all rows, in batches within each partition.  Rows and answers must be equally many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                requests = frame.iloc[a : a + batch].to_dict("records")
                answers = retry.run(lambda r=requests: provider(r))
                if len(answers) != len(requests):
                    raise ValueError(f"{len(requests)} requests, {len(answers)} answers")
                yield pd.DataFrame(answers)

    return rows.mapInPandas(run, schema)


def recorded(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded answers to rows, null where there is none."""
    return rows.join(answers, keys, "left")


def split_results(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recognised pages, and failed ones with their error cut to 100 characters."""
    good = F.coalesce("success", F.lit(False))
    return pages.where(good), pages.where(~good).withColumn("error", F.left("error", F.lit(100)))


def page_requests(documents: DataFrame) -> DataFrame:
    """(doc, page_num) of each page of documents (doc, n_pages), spread over the cluster."""
    pages = documents.where("n_pages > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_num"))
    return pages.repartition("doc", "page_num")


def succeeded(blocks: DataFrame) -> bool:
    """A job has succeeded if any block came out."""
    return not blocks.isEmpty()


PAGE_COUNT = "doc string, n_pages int"
PICTURE = "doc string, page_num int, mime string, image binary"


def page_counts(documents: DataFrame, counter: Provider) -> DataFrame:
    """(doc, n_pages) of documents (doc, ...), counted by a provider."""
    return call(documents, counter, PAGE_COUNT, batch=1, retry=QUICK)


def pictures(pages: DataFrame, painter: Provider, width: str = "width", height: str = "height") -> DataFrame:
    """(doc, page_num, mime, image) of pages (doc, page_num, width, height in points), drawn by a provider.

    The provider gets the zoom, draws PNG and, if that is too large, is asked for JPEG of a given quality.
    """
    asked = pages.withColumn("zoom", render_zoom(F.col(width), F.col(height))).withColumn("quality", F.lit(None).cast("int"))
    drawn = call(asked, painter, PICTURE, batch=1).select("doc", "page_num", "image", image_form(F.length("image")).alias("form"))
    fine = drawn.where("form.quality IS NULL").select("doc", "page_num", "form.mime", "image")
    again = asked.drop("quality").join(drawn.where("form.quality IS NOT NULL").select("doc", "page_num", "form.quality"), ["doc", "page_num"])
    return fine.unionByName(call(again, painter, PICTURE, batch=1))


TASK = (
    "These blocks were recognised on the pages of a Japanese toy manual and translated. "
    'Answer with JSON only, of the form {"remove": ["0-5"], "corrections": {"0-1": "better text"}, "product_name": "official name", "tags": ["csm"]}: '
    "keys of blocks that are noise, better translations by key, the product's official name, and tags of the list that apply. "
    "Keep instructions, warnings, features, part names and assembly steps; mend misread words and clumsy English; leave proper names as they are."
)


def prompt(blocks: DataFrame, products: DataFrame, tags: dict[str, tuple[str, str]], task: str = TASK) -> DataFrame:
    """(manual, prompt): task, product, tags with their labels, and the sampled blocks (numbered n) of each manual as JSON.

    products: (manual, name, source_url, description); a missing name is 'Unknown', an empty description isn't told.
    A manual's blocks are a sample of fixed size.
    """
    one = F.struct("n", F.struct(F.concat_ws("-", "page_idx", "block_idx").alias("index"), F.col("text").alias("original"), "translation").alias("b"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["b"])
    sampled = blocks.groupBy("manual").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("blocks"))
    known = "\n".join(f"- {tag}: {label}" for tag, (_, label) in tags.items())
    described = F.coalesce("description", F.lit(""))
    parts = [
        F.lit(task),
        F.concat(F.lit("Product: "), F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown"))),
        F.concat(F.lit("Address: "), F.coalesce("source_url", F.lit(""))),
        F.when(described != "", F.concat(F.lit("Description: "), described)),
        F.lit(f"Tags:\n{known}"),
        F.concat(F.lit("Blocks:\n"), F.col("blocks")),
    ]
    return sampled.join(products, "manual", "left").select("manual", F.concat_ws("\n", *parts).alias("prompt"))
