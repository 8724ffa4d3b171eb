"""Queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import canonical, encoding, packing, pairs, personal, repeated, scan_noise, tokens, unify
from blockloom.plans.oracles import SP
from blockloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.look_alike_pairs(table(spark, sf_dir, "translations"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.look_alike_classes(table(spark, sf_dir, "translations"))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unified_translations(table(spark, sf_dir, "translations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "translations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_values(table(spark, sf_dir, "translations")).select("row_id", "field")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_values(table(spark, sf_dir, "translations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.match_values(*(table(spark, sf_dir, t) for t in ("meta", "product_list", "tag_list")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, sf_dir, "translations"), table(spark, sf_dir, "meta"))


def p5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.near_repeated_lines(table(spark, sf_dir, "translations"), table(spark, sf_dir, "meta"))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.without_repeated_lines(table(spark, sf_dir, "translations"), table(spark, sf_dir, "meta"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = scan_noise.noisy_values(table(spark, sf_dir, "translations"), table(spark, sf_dir, "meta"))
    return noisy.select("row_id", "field", "noise").distinct()


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired_values(table(spark, sf_dir, "translations"), table(spark, sf_dir, "meta"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_mentions(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.without_personal(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_unified": p1_unified,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_near": p5_near,
    "p5_texts": p5_texts,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _width_sql(line: str) -> str:
    """Full-width ASCII narrowed and half-width kana widened, voiced pairs first."""
    kana = [chr(c) for c in range(0xFF61, 0xFFA0)]
    wide = [unicodedata.normalize("NFKC", c) for c in kana]
    for c in kana:
        for mark in "\uff9e\uff9f":
            pair = unicodedata.normalize("NFKC", c + mark)
            if len(pair) == 1:
                line = f"replace({line}, '{c}{mark}', '{pair}')"
    single = [(a, b) for a, b in zip(kana, wide) if len(b) == 1]
    line = f"translate({line}, '{''.join(a for a, _ in single)}', '{''.join(b for _, b in single)}')"
    quoted = _FULL.replace("'", "''"), _HALF.replace("'", "''")
    return f"translate({line}, '{quoted[0]}', '{quoted[1]}')"


_KEY = f"regexp_replace(lower(regexp_replace({_width_sql('line')}, '\\p{{Nd}}+', '0', 'g')), '{SP}', '', 'g')"
#: SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {
    "p5_found": f"""
WITH s AS (SELECT DISTINCT manual, source FROM meta WHERE manual IS NOT NULL AND source IS NOT NULL),
l AS (SELECT row_id, manual, page_idx, unnest(generate_series(0, len(p) - 1)) AS line_no, unnest(p) AS line FROM (SELECT row_id, manual, page_idx, string_split(text, chr(10)) AS p FROM translations WHERE text IS NOT NULL)),
k AS (SELECT row_id, line_no, source, manual, page_idx, {_KEY} AS key FROM l JOIN s USING (manual) WHERE regexp_matches(line, '\\p{{L}}')),
t AS (SELECT source, count(*) AS total FROM (SELECT DISTINCT source, manual, page_idx FROM translations JOIN s USING (manual)) GROUP BY source),
f AS (SELECT source, key FROM (SELECT DISTINCT source, key, manual, page_idx FROM k) JOIN t USING (source) GROUP BY source, key, total HAVING count(*) >= 5 AND count(*) >= 0.3 * total)
SELECT DISTINCT row_id, line_no FROM k JOIN f USING (source, key)
""",
}
