"""The command line's parts with made providers."""

import json

from blockloom import cli


def makers():
    """Recognition (a page a request, the first of its lines; page 1 fails) and translation; local, so that they travel."""
    lines = {0: ["押す", "12", "ボタンを押す"], 1: [], 2: ["(1)", "鍵"]}

    def ocr(requests):
        box = {"x": 0.1, "y": 0.2, "width": 0.33333, "height": 0.1, "confidence": 0.9}
        return [{"doc": r["doc"], "page_num": r["page_num"], "success": r["page_num"] != 1, "error": "no page" if r["page_num"] == 1 else None, "blocks": [{"text": t, **box} for t in lines[r["page_num"]]]} for r in requests]

    def mt(requests):
        return [{k: r[k] for k in ("doc", "page_num", "block_idx", "text", "x", "y", "width", "height")} | {"translation": "press" if "押" in r["text"] else "(1)"} for r in requests]

    return ocr, mt


def test_translate(spark):
    ocr, mt = makers()
    blocks, failed = cli.translate(spark, "/x/toy.pdf", 3, ocr, mt)
    assert [(r.page_idx, r.block_idx, r.translation, r.bbox) for r in blocks.orderBy("block_idx").collect()] == [(0, 0, "press", [0.1, 0.2, 0.3333, 0.1]), (0, 1, "press", [0.1, 0.2, 0.3333, 0.1])]
    assert [(r.page_num, r.error) for r in failed.collect()] == [(1, "no page")]
    every, _ = cli.translate(spark, "/x/toy.pdf", 3, ocr, mt, skip_cleanup=True)
    assert every.count() == 4  # with those that clean-up drops


def test_catalog_of_a_folder(spark, tmp_path):
    body = {"meta": {"manual_name": "B", "source": "b.pdf", "source_url": "", "tags": ["x"]}, "pages": [{"image": "p", "blocks": [{"text": "t"}, {"text": "u"}]}, {"image": "q", "blocks": []}]}
    for name, content in (("b", json.dumps(body)), ("a b", json.dumps(body | {"pages": []})), ("broken", "{"), ("none", '{"meta": null, "pages": []}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "translations.json").write_text(content)
    rows = cli.catalog_rows(spark, str(tmp_path)).collect()
    assert [(r.name, r.source, r.pages, r.blocks, r.thumbnail, r.tags) for r in rows] == [("a b", "b.pdf", 0, 0, "a b/pages/page-0.webp", ["x"]), ("b", "b.pdf", 2, 2, "b/p", ["x"]), ("none", "none", 0, 0, "none/pages/page-0.webp", None)]
    cli.main(["--root", str(tmp_path), "reindex", "--out", str(tmp_path / "catalog")])
    (written,) = (tmp_path / "catalog").glob("part-*")
    document = json.loads(written.read_text())
    assert document["stats"] == {"total_manuals": 3, "total_pages": 2, "total_blocks": 2} and document["tags"]["csm"]["label"] == "CSM"
    assert [m["name"] for m in document["manuals"]] == ["a b", "b", "none"] and document["manuals"][1]["tags"] == ["x"] and "tags" not in document["manuals"][2]
    assert document["manuals"][1]["source_url"] == "" and document["manuals"][1]["blog_url"] == ""


def test_list_and_add_url(spark, tmp_path, capsys):
    body = {"meta": {"manual_name": "B", "source": "b.pdf", "blog_links": [{"title": "t", "url": "u"}]}, "pages": [{"image": "p", "blocks": [{"text": "t", "bbox": [0.1, 0.2, 0.3, 0.4]}]}]}
    (tmp_path / "in" / "a+b c").mkdir(parents=True)
    (tmp_path / "in" / "a+b c" / "translations.json").write_text(json.dumps(body))
    cli.main(["--root", str(tmp_path / "in"), "add-url", "a+b c", "https://x.example/1", "--out", str(tmp_path / "out")])
    got = json.loads((tmp_path / "out" / "a+b c" / "translations.json").read_text())
    assert got["meta"]["source_url"] == "https://x.example/1" and got["meta"]["blog_links"][0]["url"] == "u" and got["pages"][0]["blocks"][0]["bbox"] == [0.1, 0.2, 0.3, 0.4]
    capsys.readouterr()
    cli.main(["--root", str(tmp_path / "out"), "list"])
    assert capsys.readouterr().out.splitlines() == ["a+b c\t1\t1\tyes", "1 manual"]
