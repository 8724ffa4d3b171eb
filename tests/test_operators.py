"""Operators on small tables, with nulls, ties, repeated and empty rows."""

import json
import os
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom import session
from blockloom.functions.fix import fix_text
from blockloom.operators import blocks as B
from blockloom.operators import catalog, cleanup, edits, events, nested, web
from blockloom.sources import folders, manuals, providers

BLOCK = "manual string, page_idx int, block_idx int, text string, translation string, bbox array<double>"
EDIT = "edit_id long, manual string, seq long, op string, page_idx int, block_idx int, translation string, bbox array<double>"
BOX = [0.1, 0.1, 0.2, 0.2]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def three(spark):
    return spark.createDataFrame([("m", 0, i, f"t{i}", f"e{i}", BOX) for i in range(3)] + [("m", 1, 0, "u", "f", BOX)], BLOCK)


def test_rekey_after_delete(spark, three):
    for gone, left in ((0, ["t1", "t2"]), (1, ["t0", "t2"]), (2, ["t0", "t1"])):
        keys = spark.createDataFrame([("m", 0, gone), ("m", 0, gone), ("m", 9, 0)], "manual string, page_idx int, block_idx int")
        got = rows(cleanup.rekey(cleanup.remove_keys(three, keys)).select("page_idx", "block_idx", "text"), "page_idx", "block_idx")
        assert got == [(0, 0, left[0]), (0, 1, left[1]), (1, 0, "u")]


def test_correction_and_removal_on_one_page(spark, three):
    gone = spark.createDataFrame([("m", 0, 0)], "manual string, page_idx int, block_idx int")
    new = spark.createDataFrame([("m", 0, 1, "X")], "manual string, page_idx int, block_idx int, new_translation string")
    texts = lambda df: [r[0] for r in rows(df.where("page_idx = 0").select("translation", "block_idx"), "block_idx")]
    assert texts(cleanup.correct_and_remove(three, gone, new)) == ["X", "e2"]
    assert texts(cleanup.correct_and_remove(three, gone, new, compat=True)) == ["e1", "X"]


def test_parse_answer(spark):
    answers = [("m", 'Sure {"remove": ["0-1", "bad"], "corrections": {"0-0": "X", "1-2-3": "Y"}} bye'), ("n", "no json"), ("o", None)]
    parsed = cleanup.parse_answer(spark.createDataFrame(answers, "manual string, answer string"))
    assert [r.ok for r in parsed.orderBy("manual").collect()] == [True, False, False]
    gone, new, rejected = cleanup.keyed_answer(parsed)
    assert rows(gone) == [("m", 0, 1)] and rows(new) == [("m", 0, 0, "X")]
    assert rows(rejected, "key") == [("m", "1-2-3", "correct"), ("m", "bad", "remove")]


def test_accept_tags(spark):
    df = spark.createDataFrame([(["b", "a", "zz"], "high"), (["a"], "low"), ([], "high")], "tags array<string>, confidence string")
    got = [r[0] for r in df.select(cleanup.accept_tags(F.col("tags"), F.col("confidence"), ["a", "b"])).collect()]
    assert got == [["a", "b"], [], []]


def test_edit_fold(spark, three):
    log = [
        (1, "m", 1, "update_text", 0, 0, " new ", None), (2, "m", 2, "update_text", 0, 1, "gone", None), (3, "m", 3, "undo", None, None, None, None), (4, "m", 4, "undo", None, None, None, None),
        (5, "m", 5, "update_bbox", 0, 2, None, [2.0, 0.0, 1.0, 1.0]), (6, "m", 6, "update_bbox", 0, 2, None, [0.5]), (7, "m", 7, "delete", 0, 1, None, None), (8, "m", 8, "add", 0, 99, "  ", None), (9, "m", 9, "add", 7, 0, "x", None),
    ]
    got = rows(edits.fold(three, spark.createDataFrame(log, EDIT)).select("page_idx", "block_idx", "text", "translation", "bbox"), "page_idx", "block_idx")
    assert got == [(0, 0, "t0", "new", BOX), (0, 1, "t2", "e2", [1.0, 0.0, 0.01, 1.0]), (0, 2, "New text block", "  ", [0.4, 0.45, 0.2, 0.1]), (1, 0, "u", "f", BOX), (7, 0, "New text block", "x", [0.4, 0.45, 0.2, 0.1])]


def test_edits_of_added_blocks(spark, three):
    """Operations after an add are its own; a second add of its key, or one of a block's key, has none."""
    log = [
        (1, "m", 1, "update_text", 0, 50, "too early", None), (2, "m", 2, "add", 0, 50, "a", None), (3, "m", 3, "update_text", 0, 50, " b ", None), (4, "m", 4, "update_bbox", 0, 50, None, [0.0, 0.0, 0.5, 0.5]),
        (5, "m", 5, "add", 0, 50, "second", None), (6, "m", 6, "add", 0, 40, "c", None), (7, "m", 7, "delete", 0, 40, None, None), (8, "m", 8, "add", 0, 0, None, [0.1, 0.1, 0.1, 0.1]), (9, "m", 9, "update_text", 0, 0, "of the block", None),
        (10, "m", 10, "update_text", 0, 50, "taken back", None), (11, "m", 11, "undo", None, None, None, None), (12, "m", 12, "add", 3, None, "alone", None),
    ]
    got = rows(edits.fold(three, spark.createDataFrame(log, EDIT)).where("page_idx <> 1").select("page_idx", "block_idx", "translation", "bbox"), "page_idx", "block_idx")
    box = [0.4, 0.45, 0.2, 0.1]
    assert [r[2] for r in got] == ["of the block", "e1", "e2", "b", "second", "", "alone"]
    assert [r[3] for r in got[3:]] == [[0.0, 0.0, 0.5, 0.5], box, [0.1] * 4, box] and [r[:2] for r in got] == [(0, i) for i in range(6)] + [(3, 0)]


def test_edit_fold_of_nothing(spark, three):
    assert edits.fold(three, spark.createDataFrame([], EDIT)).count() == 4
    assert edits.fold(three.limit(0), spark.createDataFrame([(1, "m", 1, "delete", 0, 0, None, None)], EDIT)).count() == 0


def test_shifted(spark):
    keys = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2)], "page_idx int, block_idx int")
    assert rows(edits.shifted(keys, 0, 1), "page_idx", "block_idx") == [(0, 0), (0, 1), (1, 2)]


def test_numbering_and_batches(spark):
    df = spark.createDataFrame([("m", p, b) for p in range(3) for b in range(90)] + [("n", 0, 0)], "manual string, page_idx int, block_idx int")
    got = rows(B.batches(df).where("manual = 'm'").select("page_idx", "block_idx", "n", "batch", "pos"), "n")
    assert [r[2] for r in got] == list(range(270))
    assert got[100] == (1, 10, 100, 1, 0)
    assert B.sample_blocks(df).count() == 101


def test_assembly(spark, three):
    pages = spark.createDataFrame([("m", 0), ("m", 5)], "manual string, page_idx int")
    got = {r.page_idx: [b.text for b in r.blocks] for r in B.assemble_pages(pages, three).collect()}
    assert got == {0: ["t0", "t1", "t2"], 5: []}


def test_page_look_up(spark):
    pages = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, 1.0, 2.0), ("m", 2, 2.5, 3.5)], "manual string, page_no int, top double, bottom double")
    probes = spark.createDataFrame([(1, "m", 1.0), (2, "m", 2.2), (3, "m", -1.0), (4, "m", 3.5), (5, "m", 9.0)], "id int, manual string, c double")
    assert rows(B.page_at(probes, pages, "c", "top", "bottom").select("id", "page_no"), "id") == [(1, 0), (4, 2)]


def test_latest_takes_the_last_delivery(spark):
    df = spark.createDataFrame([("m", 0, 0, 1, 5, "old"), ("m", 0, 0, 2, 5, "new"), ("m", None, 0, 3, 1, "x")], "manual string, page_idx int, block_idx int, row_id long, loaded_at int, text string")
    assert rows(B.latest_blocks(df).select("text"), "text") == [("new",), ("x",)]


def test_search_and_facets(spark):
    index = spark.createDataFrame([("a-b", "Neo-Belt", "One.pdf", ["x", "y"]), ("c", "Sword", "belt.pdf", ["x"]), ("d", "Cap", "two.pdf", None)], "manual string, name string, source string, tags array<string>")
    assert [r[0] for r in rows(catalog.search(index, " NEO BELT ").select("manual"))] == ["a-b"]
    assert catalog.search(index, "belt").count() == 2 and catalog.search(index, "  ").count() == 3
    assert catalog.legacy_search(index, "neo belt").count() == 0
    assert catalog.with_all_tags(index, ["x", "y"]).count() == 1 and catalog.with_all_tags(index, []).count() == 3
    assert [r[0] for r in index.select(catalog.toggle(F.coalesce("tags", F.array().cast("array<string>")), F.lit("x"))).collect()] == [["y"], [], ["x"]]


def test_links(spark):
    own = "array<struct<title:string,url:string,translated_url:string>>"
    df = spark.createDataFrame([([("t", "u", "v")], "b"), ([], "b"), (None, "b"), (None, "")], f"l {own}, b string")
    assert [[x.url for x in r[0]] for r in df.select(catalog.links(F.col("l"), F.col("b"))).collect()] == [["u"], [], ["b"], []]
    assert [r[0] for r in df.select(catalog.first_link(F.col("l"))).collect()] == ["v", "", "", ""]


HTML = {
    '<h1 class="a product-main title"> A <b>B</b></h1><title>T | Shop</title>': "A B",
    "<title>T | Shop</title>": "T",
    '<meta property="og:title" content=" O ">': "O",
    '<h1 class="product title"></h1><title>T | Shop</title>': "",
    "<p>nothing</p>": None,
}


def test_names_and_descriptions(spark):
    df = spark.createDataFrame([(h,) for h in HTML], "h string")
    assert [r[0] for r in df.select(web.product_name(F.col("h"), "Shop")).collect()] == list(HTML.values())
    pages = {
        '<meta property="og:description" content="a &quot;b&quot; &amp; c"><meta name="description" content="d">': 'a "b" & c',
        '<meta name="description" content="d">': "d",
        '<div class="x product y description">\n a <i>b</i>\n\n c </div>': "a b c",
        '<meta property="og:description" content=" ">': None,
        "x": None,
    }
    df = spark.createDataFrame([(h,) for h in pages], "h string")
    assert [r[0] for r in df.select(web.product_description(F.col("h"))).collect()] == list(pages.values())


def test_posts(spark):
    page = " ".join(f"https://b.test/blog/{p}" for p in ("", "x-one", "x-one", "blog/", "two", "three", "four"))
    df = spark.createDataFrame([(page,), ("none",)], "h string")
    got = [r[0] for r in df.select(web.blog_links(F.col("h"), F.lit("Belt Clear Set"), "b.test/blog")).collect()]
    assert [x.title for x in got[0]] == ["X One", "Two", "Three"]
    assert [x.title for x in got[1]] == ["Search: Belt"]


def test_first_match(spark):
    q = spark.createDataFrame([(1, "Belt v2"), (2, "Memorial Key Set"), (3, "None"), (4, None)], "id int, name string")
    p = spark.createDataFrame([("belt", "P1"), ("memorial-key", "P2"), ("memorial-key", "P0")], "handle string, product string")
    assert rows(web.first_match(q, p, "id", "name"), "id") == [(1, "belt", "P1"), (2, "memorial-key", "P0")]


def test_status_changes(spark):
    log = [("a", i, s) for i, s in enumerate(["x", "x", "", "y", None, "y", "x"])] + [("b", 0, "x")]
    df = spark.createDataFrame(log, "k string, n int, s string")
    for size in (1, 3, 100):  # chunks don't matter
        assert rows(events.changes(df, "k", "s", ["n"], F.floor(F.col("n") / size)).select("k", "n"), "k", "n") == [("a", 0), ("a", 3), ("a", 6), ("b", 0)]


def plain_throttle(times, gap):
    out, last = [], None
    for t in times:
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


def test_throttle(spark):
    import random

    rng = random.Random(3)
    times = sorted(rng.randrange(0, 5_000) for _ in range(400))
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, t int, i int").select("k", F.timestamp_seconds("t").alias("ts"), "t", "i")
    got = [r[0] for r in events.throttle(df, "k", "ts", "i", 17).orderBy("i").select("t").collect()]
    assert got == plain_throttle(times, 17)
    assert events.throttle(df.limit(0), "k", "ts", "i", 17).count() == 0


def test_throttle_of_many_keys(spark):
    """Chunks that begin and end anywhere, ties, null keys and times, bursts beyond a chunk."""
    import random

    rng = random.Random(9)
    data = [(rng.choice("abc") if rng.random() < 0.9 else None, rng.choice((rng.randrange(0, 90), rng.randrange(0, 20_000))), i) for i in range(900)]
    schema = "k string, t int, i int"
    df = spark.createDataFrame([*data, ("a", None, 901)], schema).select("k", F.timestamp_seconds("t").alias("ts"), "i").repartition(3)
    expected = set()
    for k in ("a", "b", "c", None):
        last = None
        for t, i in sorted((t, i) for key, t, i in data if key == k):
            if last is None or t - last >= 7:
                expected.add(i)
                last = t
    assert {r.i for r in events.throttle(df, "k", "ts", "i", 7).collect()} == expected


def test_debounce_over_chunks(spark):
    times = [i * 9 for i in range(200)] + [5_000, 5_011]
    df = spark.createDataFrame([(k, t, t) for t in times for k in ("a", None)] + [("b", None, 1)], "k string, t int, v int").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    got = events.debounce(df, "k", "ts", "v", 10).select("k", "v", "n").collect()
    assert sorted((str(r.k), r.v, r.n) for r in got) == sorted((k, v, n) for k in ("a", "None") for v, n in ((1791, 200), (5_000, 1), (5_011, 1)))


def test_debounce_joins_at_the_exact_gap(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 21, 3)], "k string, t int, v int").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    assert rows(events.debounce(df, "k", "ts", "v", 10).select("v", "n"), "v") == [(2, 2), (3, 1)]


BODIES = {
    1: {"meta": {"tags": ["a", None, "b"], "blog_links": {"title": "t", "url": "u"}}, "pages": [{"image": "i", "blocks": [{"text": 'q"[{\\', "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "children": [{"text": "c"}], "layout": {"segments": {"start": 0, "end": 2}}}, None, {"text": None}]}, None]},
    2: {"data": {"meta": {"tags": []}, "pages": {"image": "lone", "blocks": {"text": "x"}}}},
    3: {"export": {"version": 1, "manual": {"meta": None, "pages": [{"blocks": None}]}}},
}


def test_nested_manuals(spark):
    bodies = [(k, json.dumps(v, ensure_ascii=k == 1)) for k, v in BODIES.items()] + [(4, json.dumps(json.dumps(BODIES[2]))), (5, None), (6, ""), (7, '{"pages": [{"image": '), (8, "[]"), (9, "3"), (10, '{"meta": {"tags": "solo"}}')]
    df = spark.createDataFrame([(*b, "clash") for b in bodies], "raw_id long, body string, kind string")
    got = set(rows(nested.flatten_manuals(df, values=False)))
    lone = {("page", 0, -1, -1), ("block", 0, 0, -1)}
    expected = {(1, "page", 0, -1, -1), (1, "block", 0, 0, -1), (1, "block", 0, 2, -1), (1, "child", 0, 0, 0), (1, "segment", 0, 0, 0), (1, "link", -1, -1, 0), (1, "tag", -1, -1, 0), (1, "tag", -1, -1, 2)}
    expected |= {(k, *x) for k in (2, 4) for x in lone} | {(3, "page", 0, -1, -1), (10, "tag", -1, -1, 0)}
    assert got == expected
    values = {(r.raw_id, r.kind, r.block_pos): r for r in nested.flatten_manuals(df).collect()}
    assert values[1, "block", 0].text == 'q"[{\\' and values[1, "block", 0].bbox == [1.0, 2.0, 3.0, 4.0]
    assert values[1, "block", 2].text is None and values[1, "segment", 0].end == 2 and values[1, "link", -1].url == "u"
    assert nested.flatten_manuals(df.limit(0)).count() == 0 and nested.manual_table(df.limit(0), "blocks").count() == 0


def brute_tables(value):
    """Tables of one body by walking parsed JSON."""
    out = {name: [] for name in nested.TABLES}
    level = [value]
    manual = None
    while level and manual is None:
        manual = next((x for x in level if isinstance(x, dict) and ("pages" in x or "meta" in x)), None)
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
    if manual is None:
        return out
    listed = lambda x: [(0, x)] if isinstance(x, dict) else [(i, v) for i, v in enumerate(x) if isinstance(v, dict)] if isinstance(x, list) else []
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    metas = listed(manual.get("meta"))
    meta = metas[-1][1] if metas else {}
    out["manuals"].append(tuple(text(meta.get(k)) for k in nested.TABLES["manuals"][2]))
    for _, m in metas:
        tags = m.get("tags")
        out["tags"] += [(i, text(t)) for i, t in (enumerate(tags) if isinstance(tags, list) else [(0, tags)]) if t is not None]
        out["links"] += [(i, *(text(x.get(k)) for k in ("title", "url", "translated_url"))) for i, x in listed(m.get("blog_links"))]
    for p, page in listed(manual.get("pages")):
        out["pages"].append((p, text(page.get("image"))))
        for b, block in listed(page.get("blocks")):
            box = block.get("bbox")
            box = [box.get(k) for k in nested.BOX] if isinstance(box, dict) else box
            out["blocks"].append((p, b, text(block.get("text")), text(block.get("translation")), [number(v) for v in box] if isinstance(box, list) else None))
            for _, layout in listed(block.get("layout")):
                out["segments"] += [(p, b, i, *(None if number(x.get(k)) is None else int(x[k]) for k in ("start", "end"))) for i, x in listed(layout.get("segments"))]
                out["vertices"] += [(p, b, i, number(x.get("x")), number(x.get("y"))) for i, x in listed(layout.get("vertices"))]
            out["children"] += [(p, b, i, text(x.get("text")), text(x.get("translation"))) for i, x in listed(block.get("children"))]
    return out


def random_body(rng):
    scalar = lambda: rng.choice([None, True, 3, -2.5e-3, "", 'a "q" \\\\ {[,:]}', "é\n鍵", [], [1, None], {"z": 1}])
    some = lambda make: rng.choice([lambda: make(), lambda: [make() for _ in range(rng.randint(0, 3))], lambda: [make(), None, make()], lambda: None, scalar])()
    pick = lambda d: {k: v for k, v in d.items() if rng.random() < 0.8}
    vertex = lambda: pick({"x": rng.choice([0.5, 1, None, "7", 1e300]), "y": scalar()})
    segment = lambda: pick({"start": rng.choice([0, 1.9, "2", None]), "end": rng.choice([7, 12345678901])})
    child = lambda: pick({"text": scalar(), "translation": scalar()})
    box = lambda: rng.choice([[0.1, 2, None, "x"], [], {"x": 1, "y": 2.5, "width": None}, None, "0.1"])
    block = lambda: pick({"text": scalar(), "translation": scalar(), "bbox": box(), "layout": some(lambda: pick({"segments": some(segment), "vertices": some(vertex)})), "children": some(child)})
    page = lambda: pick({"image": scalar(), "blocks": some(block)})
    meta = lambda: pick({"manual_name": scalar(), "source": scalar(), "source_lang": "ja", "tags": rng.choice([["a", None, 1], [], "t", None]), "blog_links": some(lambda: pick({"title": scalar(), "url": "u", "translated_url": scalar()}))})
    manual = {"meta": meta(), "pages": some(page)}
    return rng.choice([lambda: manual, lambda: {"data": [None, manual]}, lambda: [{"x": {"manual": manual}}]])()


def test_related_tables_against_brute_force(spark):
    import random

    rng = random.Random(4)
    values = [random_body(rng) for _ in range(150)]
    bodies = [json.dumps(v, ensure_ascii=False).replace('"blocks": ', rng.choice(['"blocks": ', ' \n"blocks"\t:\n '])) for v in values]
    deep = json.dumps(values[0])
    for _ in range(7):  # however many layers of strings
        deep = json.dumps(deep)
    df = spark.createDataFrame([*enumerate(bodies), (999, deep), (1000, '{"pages": [{"image": "\\ud800"}]}')], "raw_id long, body string").repartition(3)
    wide = nested.flatten_manuals(df).cache()
    for name, (kind, keys, fields) in nested.TABLES.items():
        expected = [(i, *r) for i, v in [*enumerate(values), (999, values[0])] for r in brute_tables(v)[name]]
        got = [tuple(r) for r in nested.manual_table(df, name).where("raw_id < 1000").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected)), name
        same = wide.where((F.col("kind") == kind) & (F.col("raw_id") < 1000)).select("raw_id", *keys, *fields)
        assert sorted(repr(tuple(r)) for r in same.collect()) == sorted(map(repr, got))


def test_manual_round_trip(spark, tmp_path):
    """What write_manuals writes read_manuals reads, of any name and size."""
    names = ["CSM Den Gasher", "取扱 説明書+1", "100% (a)=b"]
    text = 'q"[{\\\n, \u2028 鍵'
    body = [(m, p, b, text if b % 7 == 0 else None, f"t{b}", [0.1, 0.2, 0.3, float(b)] if b % 2 else None) for m in names[:2] for p in range(3) for b in range(12)]
    blocks = spark.createDataFrame(body, "manual string, page_idx int, block_idx int, text string, translation string, bbox array<double>")
    pages = spark.createDataFrame([(m, p, f"p{p}" if p else None) for m in names[:2] for p in range(4)], "manual string, page_idx int, image string")
    meta = spark.createDataFrame([(m, ("M", "s.pdf", ["x", "y"], 9, 9)) for m in names], "manual string, meta struct<manual_name:string,source:string,tags:array<string>,pages:bigint,blocks:bigint>")
    manuals.write_manuals(blocks, pages, meta, str(tmp_path / "v1"))
    assert sorted(p.parent.name for p in (tmp_path / "v1").glob("*/translations.json")) == sorted(names)
    for f in (tmp_path / "v1").glob("*/translations.json"):
        assert json.loads(f.read_text())["meta"]["tags"] == ["x", "y"]
    read = manuals.read_manuals(spark, str(tmp_path / "v1")).cache()
    assert {(r.manual, r.meta.pages, r.meta.blocks, r.broken, len(r.pages)) for r in read.collect()} == {(names[0], 4, 36, False, 4), (names[1], 4, 36, False, 4), (names[2], 0, 0, False, 0)}
    again, images, _ = manuals.unnest(read)
    assert rows(again, "manual", "page_idx", "block_idx") == sorted(body, key=lambda r: r[:3])
    assert [r.image for r in images.where(F.col("manual") == names[0]).orderBy("page_idx").collect()] == [None, "p1", "p2", "p3"]
    manuals.write_manuals(*manuals.unnest(read), str(tmp_path / "v2"))
    assert all((tmp_path / "v2" / n / "translations.json").exists() for n in names)
    with pytest.raises(FileExistsError):
        manuals.write_manuals(blocks, pages, meta, str(tmp_path / "v1"))
    with pytest.raises(ValueError):
        manuals.write_manuals(blocks, pages, meta.withColumn("manual", F.lit("..")), str(tmp_path / "v3"))
    edited = spark.createDataFrame([(names[1],)], "manual string")
    manuals.export_edited(blocks, pages, meta, edited, str(tmp_path / "v4"))
    assert [p.name for p in (tmp_path / "v4").iterdir() if p.is_dir()] == [names[1]]


def test_unreadable_manuals(spark, tmp_path):
    for name, content in (("broken", "{"), ("empty", '{"meta": {"tags": []}, "pages": []}'), ("m", '{"meta": {}, "pages": [{"blocks": [{"text": "a"}]}, {"image": "x", "blocks": []}]}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "translations.json").write_text(content)
    read = {r.manual: r for r in manuals.read_manuals(spark, str(tmp_path)).collect()}
    assert read["broken"].broken and not read["m"].broken and read["empty"].pages == []
    good = manuals.read_manuals(spark, str(tmp_path)).where("NOT broken")
    assert B.explode_pages(good).where("manual = 'm'").count() == 2  # the page without blocks stays


def test_numbering_over_units(spark, monkeypatch):
    """Units of pages and stretches of manuals are carried."""
    monkeypatch.setattr(B, "UNIT", 3)
    data = [("m", p, b) for p in range(11) for b in range(0, 20, 1 + p % 4)] + [("n", 0, 5)]
    df = spark.createDataFrame(data, "manual string, page_idx int, block_idx int").repartition(4)
    got = rows(B.numbered(df), "manual", "n")
    assert got == [("m", *x[1:], i) for i, x in enumerate(data[:-1])] + [("n", 0, 5, 0)]
    assert rows(B.sample_blocks(df, 7), "manual", "n") == got[:7] + got[-1:]
    seen = {}
    for m, p, b in data:
        seen.setdefault((m, p), []).append(b)
    assert rows(B.rekeyed(df), "manual", "page_idx", "block_idx") == [(m, p, i) for (m, p), bs in seen.items() for i in range(len(bs))]


def test_latest_plan(spark, tmp_path):
    """Narrow columns come out of hash aggregates alone, and no others are read."""
    spark.createDataFrame([("m", 0, 0, 1, "t", "e", [0.1], datetime(2024, 1, 1)), ("m", 0, 0, 2, "u", None, None, None)], "manual string, page_idx int, block_idx int, row_id long, text string, translation string, bbox array<double>, loaded_at timestamp").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    narrow, wide = B.latest_blocks(t, "row_id"), B.latest_blocks(t, "translation")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "text" not in plan and "bbox" not in plan
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "bbox" not in plan and "text:string" not in plan
    assert rows(narrow) == [("m", 0, 0, 1)] and rows(wide) == [("m", 0, 0, "e")]


def test_all_stages(spark):
    blocks = spark.createDataFrame([("m", 0, 0, "plain"), ("m", 0, 1, "(1)"), ("m", 0, 2, "Ã©t"), ("m", 1, 0, None), ("m", 1, 1, "gone")], "manual string, page_idx int, block_idx int, translation string")
    answers = spark.createDataFrame([("m", 'x {"remove": ["1-1", "bad", "9-9"], "corrections": {"0-0": "Better", "1-1": "never", "7-7": "no block"}}'), ("m", None)], "manual string, answer string")
    out, figures = cleanup.clean(blocks, answers, fix_text)
    assert rows(out, "page_idx", "block_idx") == [("m", 0, 0, "Better"), ("m", 0, 1, "ét"), ("m", 1, 0, None)]
    assert cleanup.result_of(figures) == cleanup.CleanupResult(True, 5, 3, 1, 1, 1, 1, 1)
    assert not cleanup.result_of(figures.selectExpr("raise_error('no') AS original")).success


def test_pictures_and_counts(spark):
    def painter(requests):
        return [{"doc": r["doc"], "page_num": r["page_num"], "mime": "x", "image": b"j" * 5 if r.get("quality") == 95 else b"p" * (11_000_000 if r["page_num"] else 3)} for r in requests]

    pages = spark.createDataFrame([("d", 0, 500.0, 700.0), ("d", 1, 500.0, 700.0)], "doc string, page_num int, width double, height double")
    got = providers.pictures(pages, painter).select("page_num", F.length("image").alias("n")).collect()
    assert sorted((r.page_num, r.n) for r in got) == [(0, 3), (1, 5)]
    docs = spark.createDataFrame([("a",), ("bcd",)], "doc string")
    assert rows(providers.page_counts(docs, lambda rs: [{"doc": r["doc"], "n_pages": len(r["doc"])} for r in rs]), "doc") == [("a", 1), ("bcd", 3)]


def test_cuts_are_deleted_and_shared(spark, tmp_path):
    cut = session.cut(spark.range(3))
    assert cut.count() == 3
    folder = session.cuts_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    session.drop_cuts(spark)
    assert not os.path.isdir(folder)


def test_providers(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, text string")
    got = providers.call(df, lambda requests: [{"id": r["id"], "out": r["text"].upper()} for r in requests], "id int, out string", batch=3)
    assert rows(got, "id") == [(i, f"T{i}") for i in range(7)]
    tries, pauses = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return [{}]

    assert providers.API.run(flaky, pauses.append) == [{}] and pauses == [2, 4]
    with pytest.raises(OSError):
        providers.QUICK.run(lambda: (_ for _ in ()).throw(OSError()), lambda _: None)
    pages = spark.createDataFrame([(1, True, None), (2, False, "x" * 300), (3, None, None)], "page_num int, success boolean, error string")
    good, bad = providers.split_results(pages)
    assert good.count() == 1 and max(len(r.error or "") for r in bad.collect()) == 100


def _many(root, n):
    """n sound manuals, and some that are not as they should be."""
    block = {"text": "字\n\"", "translation": None, "bbox": [0, 0.5, "NaN", None], "more": [1]}
    whole = {f"m {k}": json.dumps({"meta": {"manual_name": f"n{k}", "tags": ["a", None], "pages": 7}, "x": {}, "pages": [{"image": f"p{k}", "blocks": [block] * k}, None, {"blocks": [None]}]}, ensure_ascii=k % 2 > 0) for k in range(n)}
    whole |= {"cut": '{"meta": {}, "pages": [', "number": '{"meta": {"source": 5}, "pages": [{"blocks": [{"text": 1.50}]}]}', "box": '{"meta": {}, "pages": [{"image": "i", "blocks": [{"text": "t", "bbox": ["x"]}]}]}'}
    whole |= {"emoji": '{"meta": {}, "pages": [{"blocks": [{"text": "\\ud83d\\ude00"}]}]}', "none": '{"meta": null, "pages": [{"blocks": [{"text": "t"}]}]}', "bare": '{"meta": {}}', "late": ' {"pages": [{"blocks": [{"text": "t"}], "image": "i"}] , "meta": {"tags": []}}\n'}
    for name, text in whole.items():
        (root / name).mkdir()
        (root / name / "translations.json").write_text(text, encoding="utf-8")
    (root / "bytes").mkdir()
    (root / "bytes" / "translations.json").write_bytes(b'{"meta": {}, "pages": [{"image": "\xff"}]}')
    (root / "other").mkdir()


@pytest.mark.parametrize("whole", [1 << 20, 8])
def test_summaries_are_streamed(spark, tmp_path, monkeypatch, whole):
    """As the nested rows give them, in no more tasks than a shuffle has, be files parsed at once or in pieces."""
    _many(tmp_path, 30)
    if whole == 8:  # the executors' Python has its own modules; so the reader is called here
        monkeypatch.setattr(folders, "WHOLE", 8)
        monkeypatch.setattr(folders, "CHUNK", 5)
        names = pa.RecordBatch.from_pydict({"manual": sorted(p.name for p in tmp_path.iterdir())})
        found = {r["manual"]: r for b in folders.heads(iter([names]), f"file://{tmp_path}") for r in b.to_pylist()}
        assert [found[f"m {k}"]["n_blocks"] for k in range(30)] == [k + 1 for k in range(30)] and found["late"]["image"] == "i"
        assert {k for k, r in found.items() if r["raw"]} == {"cut", "box", "emoji"} and [k for k, r in found.items() if r["broken"]] == ["bytes"]
        return
    got = manuals.read_summaries(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = lambda df: sorted((r.manual, r.broken) if r.broken and r.manual == "bytes" else tuple(map(str, r)) for r in df.collect())
    assert flat(got) == flat(manuals.summaries(manuals.read_manuals(spark, str(tmp_path))).select(*got.columns)) and got.count() == 38


def test_negative_pages_and_orphans(spark, tmp_path):
    """The header comes before any page; blocks of missing pages leave no comma."""
    at = [(-3, 0), (-1, 0), (-1, 1), (0, 0), (1, 0), (1, 1), (2, 0)]
    blocks = spark.createDataFrame([("m", p, b, f"{p}.{b}", None, None) for p, b in at], "manual string, page_idx int, block_idx int, text string, translation string, bbox array<double>")
    pages = spark.createDataFrame([("m", p, None) for p in (-1, 2, 3)] + [("x", 0, None)], "manual string, page_idx int, image string")
    meta = spark.createDataFrame([("m", ("M", 0, 0))], "manual string, meta struct<manual_name:string,pages:bigint,blocks:bigint>")
    manuals.write_manuals(blocks, pages, meta, str(tmp_path / "v"))
    whole = json.loads((tmp_path / "v" / "m" / "translations.json").read_text())
    assert [[b["text"] for b in p["blocks"]] for p in whole["pages"]] == [["-1.0", "-1.1"], ["2.0"], []]
    assert whole["meta"] == {"manual_name": "M", "pages": 3, "blocks": 3} and [p.name for p in tmp_path.iterdir()] == ["v"]


@pytest.mark.parametrize("whole", [1 << 20, 8])
def test_blocks_are_streamed(spark, tmp_path, monkeypatch, whole):
    """As the nested rows give them; a manual comes in several batches."""
    _many(tmp_path, 30)
    nested = manuals.unnest(catalog.valid_manuals(manuals.read_manuals(spark, str(tmp_path))))[0]
    if whole == 8:
        for name, value in (("WHOLE", 8), ("CHUNK", 5), ("ROWS", 10)):
            monkeypatch.setattr(folders, name, value)
        names = pa.RecordBatch.from_pydict({"manual": sorted(p.name for p in tmp_path.iterdir())})
        batches = list(folders.blocks(iter([names]), f"file://{tmp_path}"))
        assert max(b.num_rows for b in batches) <= 10 and sum(b.num_rows for b in batches) == sum(range(30)) + 30 + 1 + 4
        return
    got = manuals.read_blocks(spark, str(tmp_path))
    assert got.columns == nested.columns and rows(got.withColumn("bbox", F.col("bbox").cast("string")), *got.columns) == rows(nested.withColumn("bbox", F.col("bbox").cast("string")), *got.columns)


def test_catalog_reads_entries_once(spark, tmp_path):
    """The first name, the rows and the totals come from entries made once."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x).asNondeterministic()
    entries = spark.createDataFrame([(n, 1, 2) for n in "cab"], "name string, pages long, blocks long").withColumn("name", seen("name"))
    manuals.write_catalog(entries, {"t": ("#1", "T")}, str(tmp_path / "c"))
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "c").glob("part*")))
    assert [m["name"] for m in whole["manuals"]] == ["a", "b", "c"] and whole["stats"] == {"total_manuals": 3, "total_pages": 3, "total_blocks": 6} and made.value == 3


def test_written_blocks_are_the_last_delivered(spark, tmp_path):
    """Of blocks at one place the last counts, null and first positions aside."""
    at = [(0, 0, 2, "b"), (0, 0, 3, "c"), (0, 0, 1, "a"), (0, None, 9, "n"), (0, 1, 5, "e"), (1, 0, 8, "h"), (1, 0, 7, "g"), (None, 0, 6, "f")]
    blocks = spark.createDataFrame([("m", p, b, t, None, None, d) for p, b, d, t in at], "manual string, page_idx int, block_idx int, text string, translation string, bbox array<double>, delivered long").withColumn("delivered", F.col("delivered").cast("decimal(38,0)"))
    pages = blocks.select("manual", "page_idx").distinct().withColumn("image", F.lit(None).cast("string"))
    meta = spark.createDataFrame([("m", ("M", 0, 0))], "manual string, meta struct<manual_name:string,pages:bigint,blocks:bigint>")
    manuals.write_manuals(blocks, pages, meta, str(tmp_path / "v"))
    whole = json.loads((tmp_path / "v" / "m" / "translations.json").read_text())
    assert [[b["text"] for b in p["blocks"]] for p in whole["pages"]] == [["c", "n", "f", "e"], ["h"]] and whole["meta"]["blocks"] == 5
