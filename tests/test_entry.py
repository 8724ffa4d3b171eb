"""The driver's contract on the smallest data, queries against their SQL."""

import os
from pathlib import Path

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
#: One query at least of each module of operators.
COMPARED = (
    "corpus_index", "edit_fold", "sample_first_100", "rekey_after_delete", "model_cleanup", "manual_documents", "catalog_document", "prompts", "throttle", "debounce", "status_changes",
    "interval_hit", "recorded_answers", "block_explode", "union_of_pages", "list_split", "polygon_boxes", "first_match",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_query_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(relation.select(*(f'"{c}"' for c in columns)).fetchall())
