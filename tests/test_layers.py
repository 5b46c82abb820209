"""Garbled tables, look-alike characters, and content lists as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from layoutlint.operators import confusion, garbled
from layoutlint.sources import content_lists
from layoutlint.streaming import refine_stream

WORDS = ["质量", "管理", "质量管理", "检验", "记录", "部门", "负责", "组织", "实施", "产品"]


def make(spark, *blocks):
    return content_lists.items_from_rows(spark, [{"doc_id": "d", "ord": k, "type": "text", "page_idx": 0} | b for k, b in enumerate(blocks)])


def table(*cells):
    return "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def brute_coverage(texts):
    total = covered = 0
    for text in texts:
        run = ""
        for c in text + " ":
            if "一" <= c <= "鿿":
                run += c
                continue
            if len(run) >= 2:
                total += len(run)
                i = 0
                while i < len(run):
                    n = next((n for n in (4, 3, 2) if i + n <= len(run) and run[i : i + n] in WORDS), 0)
                    covered += n
                    i += max(n, 1)
            run = ""
    return total, covered


def test_coverage(spark, words):
    texts = ["质量管理检验x记录", "质质量", "管", "产产品品部门负", "", "质量管理质量管理", "质量管理质量管理"]
    rows = spark.createDataFrame([(1, x) for x in texts], "k int, text string")
    got = garbled.word_coverage(rows, words, ["k"]).first()
    assert (got["total"], got["covered"]) == brute_coverage(texts)


def test_garbled_tables_become_pictures(spark, words):
    clean = table("质量管理部门负责组织实施", "产品检验记录产品检验记录")
    broken = table("质里官埋邡门贠责纽织实旆", "户品佥验己录产品佥脸己录")
    items = make(spark, {"type": "table", "table_body": clean, "img_path": "a"}, {"type": "table", "table_body": broken, "img_path": "b", "table_caption": ["c"]}, {"type": "table", "table_body": broken})
    assert sorted(r["ord"] for r in garbled.garbled_tables(items, words).collect()) == [1, 2]
    out, spans = garbled.degrade(items, words)
    got = {r["ord"]: r for r in out.collect()}
    assert [got[k]["type"] for k in range(3)] == ["table", "image", "table"]
    assert got[1]["table_body"] is None and got[1]["image_caption"] == ["c"] and got[1]["table_caption"] is None
    assert [r["ord"] for r in spans.collect()] == [1]


def test_proposals(spark, words):
    body = table("质里官埋", "12,5", "部门", "ok", "户品佥验")
    items = make(spark, {"type": "table", "table_body": body})
    rows = [(0, "质量管理"), (1, "13"), (2, "部间"), (3, "yes"), (9, "x"), (0, "质量官理"), (4, "<b>"), (4, "产品检验")]
    proposals = spark.createDataFrame([("d", 0, 0, c, x, k) for k, (c, x) in enumerate(rows)], "doc_id string, ord long, row int, col int, new string, seq long")
    got = [(r["col"], r["new"], r["verdict"]) for r in garbled.judge_proposals(items, proposals, words).collect()]
    assert sorted(got) == sorted([(0, "质量管理", "ok"), (1, "13", "not_rewritable"), (2, "部间", "not_rewritable"), (3, "yes", "not_rewritable"), (9, "x", "no_cell"), (0, "质量官理", "duplicate"), (4, "<b>", "invalid"), (4, "产品检验", "ok")])
    worse = proposals.where("seq = 5").withColumn("new", F.lit("质星官理"))
    assert garbled.judge_proposals(items, worse, words).first()["verdict"] == "no_gain"


def test_confusion_candidates(spark):
    items = make(spark, *[{"text": "船在周末靠岸"}] * 5, {"text": "船在周未靠岸"}, {"text": "&nbsp;O"}, {"type": "list", "list_items": ["土地"] * 5})
    got = {(r["ord"], r["field"], r["part"], r["offset"]): (r["ch"], r["alternatives"], r["rival"]) for r in confusion.candidates(items, confusion.pairs(spark)).collect()}
    assert got[5, "text", 0, 3] == ("未", "末", "末")
    assert got[0, "text", 0, 3] == ("末", "未", None)
    assert (6, "text", 0, 1) in got and not [k for k in got if k[1] == "list_items"]
    only = confusion.candidates(items, confusion.pairs(spark), rivals_only=True).collect()
    assert [(r["ord"], r["offset"], r["ch"], r["alternatives"], r["rival"]) for r in only] == [(5, 3, "未", "末", "末")]
    with pytest.raises(ValueError):
        confusion.pairs(spark, ["aa"])


def test_latin_votes(spark):
    items = make(spark, {"text": "MODEL " * 12 + "MODLE MODLE MADEL MXXEL LEDOM"})
    got = {(r["token"], r["fixed"]) for r in confusion.token_votes(items).collect()}
    assert got == {("MODLE", "MODEL"), ("MADEL", "MODEL")}


def test_density_and_application(spark):
    items = make(spark, {"text": "0123456789"}, {"text": "OOOO"}, {"type": "table", "table_body": table(*["O0"] * 6)})
    rows = [(0, "text", 0, 0, "O")] + [(1, "text", 0, k, "0") for k in range(3)] + [(2, "table_body", k, 0, "0") for k in range(5)]
    fixes = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, ord long, field string, part int, offset int, after string")
    judged = confusion.density_gate(fixes, items)
    assert {(r["ord"], r["ok"]) for r in judged.collect()} == {(0, True), (1, False), (2, False)}
    out = confusion.apply_texts(items, judged.where("ok"))
    assert [r["text"] for r in out.orderBy("ord").collect()] == ["O123456789", "OOOO", None]


def test_fixes_reach_all_fields(spark):
    body = "<table>\n<tr><td>a</td><td><b>&amp;x</b>O<i>0</i>y<br></td></tr></table>"
    items = make(
        spark, {"text": "&nbsp;O0"}, {"type": "list", "list_items": ["O", None, "0O"]}, {"type": "table", "table_body": body, "table_caption": ["T", "B0O"]}, {"type": "table", "table_body": "<table>O</table>"}
    )
    rows = [(0, "text", 0, 1, "0"), (1, "list_items", 2, 0, "O"), (2, "table_caption", 1, 1, "O"), (2, "table_body", 1, 2, "0"), (2, "table_body", 1, 3, "O")]
    fixes = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, ord long, field string, part int, offset int, after string")
    chars = {(r["ord"], r["field"], r["part"], r["offset"]): r["ch"] for r in confusion.characters(confusion.units(items)).collect()}
    assert [chars[r[:4]] for r in rows] == ["O", "0", "0", "O", "0"]
    out = confusion.apply_texts(items, fixes).orderBy("ord").collect()
    assert out[0]["text"] == "&nbsp;00" and out[1]["list_items"] == ["O", None, "OO"] and out[2]["table_caption"] == ["T", "BOO"]
    assert out[2]["table_body"] == "<table>\n<tr><td>a</td><td><b>&amp;x</b>0<i>O</i>y<br></td></tr></table>" and out[3]["table_body"] == "<table>O</table>"
    assert confusion.apply_texts(items, fixes.limit(0)).orderBy("ord").collect() == items.orderBy("ord").collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    blocks = [{"type": "text", "text": "half a sentence that", "page_idx": 0}, {"type": "text", "text": "ends here.", "page_idx": 1}]
    (tmp_path / "in" / "a.json").write_text(json.dumps(blocks))
    query = refine_stream.refine_stream(refine_stream.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), mechanics=False, max_rounds=2)
    query.awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out" / "items")).collect()] == ["half a sentence that ends here."]
    report = spark.read.parquet(str(tmp_path / "out" / "report")).select("op", F.col("n")).collect()
    assert [tuple(r) for r in report] == [("merge", 1)]


def test_targets_and_rewritten_cells(spark):
    words = spark.createDataFrame([("船舶",), ("登记",)], "word string")
    noise = "丂丄丅丆丏丒丗丟丠両丣" * 3
    body = f"<table>\n<tr><td>{noise}</td><td>x</td></tr>\n<tr><td a='1'>old</td></tr>\n</table>"
    items = content_lists.items_from_rows(spark, [
        {"doc_id": "d", "ord": k, "type": "table", "table_body": body, "img_path": path} for k, path in enumerate(["a.png", None])
    ] + [{"doc_id": "d", "ord": 2, "type": "table", "table_body": body.replace("old", "o" * 8000), "img_path": "b.png"}])
    assert [(r["ord"], r["img_path"]) for r in garbled.targets(items, words).collect()] == [(0, "a.png")]
    judged = spark.createDataFrame([("d", 0, 1, 0, "old", "R&D", "ok"), ("d", 0, 0, 1, "x", "y", "numeric")], "doc_id string, ord long, row int, col int, text string, new string, verdict string")
    out, done = garbled.apply_proposals(items, judged)
    assert {r["ord"]: r["table_body"] for r in out.collect()} == {0: body.replace("old", "R&amp;D"), 1: body, 2: body.replace("old", "o" * 8000)}
    assert [tuple(r) for r in done.collect()] == [("d", 0, 1, 0, "old", "R&D")]
