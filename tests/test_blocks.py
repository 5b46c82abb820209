"""Detectors, rewrites, gates and the loop on small content lists."""

import json
import re
import time

from pyspark.sql import functions as F

from layoutlint.functions import numbering, text as t
from layoutlint.operators import detect, gates, markdown, mechanical, ops, windows
from layoutlint.plans import policy, refine
from layoutlint.sources import content_lists


def make(spark, *blocks, doc="d"):
    rows = []
    for k, b in enumerate(blocks):
        page = b.get("page_idx", 0)
        rows.append({"doc_id": b.get("doc_id", doc), "ord": k, "type": "text", "page_idx": page, "bbox": [50.0, float(k), 550.0, float(k + 20)]} | b)
    return content_lists.items_from_rows(spark, rows)


def kinds(items):
    return sorted((r["ord"], r["kind"]) for r in detect.detect(items).collect())


def texts(items):
    return [r["text"] for r in items.orderBy("ord").collect()]


def decide(spark, *rows):
    names = "doc_id string, ord long, op string, ord_b long, offset long, level int, pattern string, caption_index int, position string, join_seam boolean, ords array<long>"
    cols = [c.strip().split(" ")[0] for c in names.split(", ")]
    return spark.createDataFrame([tuple({"doc_id": "d"} .get(c, None) if c == "doc_id" else r.get(c) for c in cols) for r in rows], names)


TABLE = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"


def report_of_visit(spark):
    """A document with one thing wrong on most of its blocks; what each should become is in the test."""
    return make(
        spark,
        {"text": "Visit of 12 May", "text_level": 1},
        {"text": "We came early; nobody was there", "text_level": 3},
        {"text": "After an hour the gate was opened by a man who"},
        {"text": "had the keys with him.", "page_idx": 1},
        {"text": "7 / 9", "page_idx": 1},
        {"text": "His <em>name</em> is [here](list.html).", "page_idx": 1},
        {"type": "table", "table_body": TABLE, "table_caption": ["Who was there"], "page_idx": 1},
        {"type": "table", "table_body": TABLE, "table_caption": ["Who was not"], "page_idx": 2},
    )


def test_suspects_of_a_document(spark):
    assert kinds(report_of_visit(spark)) == [(1, "pseudo_heading"), (2, "cross_page_break"), (4, "page_artifact"), (5, "residual_markup"), (6, "split_table")]


def test_refine(spark):
    items = report_of_visit(spark)
    done = refine.refine(items)
    out, last = done.items, "His name is here."
    assert texts(out) == ["Visit of 12 May", "We came early; nobody was there", "After an hour the gate was opened by a man who had the keys with him.", last, None, None]
    # two kinds of markup take two rounds; tables wait for somebody who sees them
    assert {r["op"]: r["n"] for r in done.report.collect()} == {"demote": 1, "merge": 1, "drop": 1, "strip": 2}
    assert [p["remaining"] for p in done.progress] == [4, 1, 0] and done.dismissed.isEmpty()
    merged = out.where("ord = 2").first()
    assert merged["bbox"] == [50.0, 2.0, 550.0, 23.0] and merged["page_idx"] == 0
    assert [r["item_id"] for r in out.orderBy("ord").collect()] == ["it_0001", "it_0002", "it_0003", "it_0006", "it_0007", "it_0008"]
    assert sorted(r["text"] for r in done.spans.collect()) == ["7 / 9", "</em>", "<em>", "[here](list.html)"]
    assert gates.failures(items, out).isEmpty()
    again = refine.refine(refine.strip_ids(out))
    assert texts(again.items) == texts(out) and again.report.isEmpty()
    joined = refine.refine(items, rules=policy.VISION_RULES)
    assert joined.items.count() == 5 and {r["op"]: r["n"] for r in joined.report.collect()}["mergeTable"] == 1


def test_rejected_decisions_are_dismissed_and_not_counted(spark):
    # nothing would be left of the first, and a formula that is none of a dollar's cannot be unwrapped
    items = make(spark, {"text": "<b>"}, {"text": "take \\frac{2}{7} of it"}, {"text": "an <i>open</i> tag"})
    done = refine.refine(items)
    assert {r["op"]: r["n"] for r in done.report.collect()} == {"strip": 1, "dismissed": 2}
    assert texts(done.items) == ["<b>", "take \\frac{2}{7} of it", "an open tag"]
    assert {(r["item_id"], r["reason"]) for r in done.dismissed.collect()} == {("it_0001", "rejected"), ("it_0002", "rejected")}
    assert len(done.progress) == 2
    quiet = refine.refine(items, judge=lambda todo, _: policy.decide(todo.limit(0)))
    assert {r["reason"] for r in quiet.dismissed.collect()} == {"no_rule"} and texts(quiet.items) == texts(items)


def test_item_ids(spark):
    rows = spark.createDataFrame([("a", 0, "it_0004"), ("a", 1, None), ("a", 2, "it_0004"), ("a", 3, "x"), ("b", 0, None)], "doc_id string, ord long, item_id string")
    got = [(r["doc_id"], r["item_id"]) for r in refine.assign_ids(rows).orderBy("doc_id", "ord").collect()]
    assert got == [("a", "it_0004"), ("a", "it_0005"), ("a", "it_0006"), ("a", "x"), ("b", "it_0001")]


def test_documents_with_more_suspects_come_back(spark):
    items = make(spark, {"text": "8.1 Wine"}, {"text": "8.2 Beer", "text_level": 2})
    # a judge that makes one heading of a text, and so a sentence-like heading of it
    bad = lambda todo, now: policy.decide(todo, {"missed_heading": "strip"}).withColumn("pattern", F.lit("md_link"))
    assert texts(refine.refine(items, judge=bad).items) == texts(items)
    before = spark.createDataFrame([("d", 0, "giant_block", True)], "doc_id string, ord long, kind string, has_op boolean")
    after = before.unionByName(before.withColumn("ord", F.lit(1).cast("long")))
    assert refine._more_suspects(before, after, False).first()["reason"] == "suspects: 1 to 2"
    assert refine._more_suspects(after, before, False).isEmpty()


def _cases():
    """Small documents with the suspects that the rules ask for, made from the rules' own parts."""
    plain = lambda s, **k: {"text": s} | k
    head = lambda s, level=2: {"text": s, "text_level": level}
    table = lambda page=0, **k: {"type": "table", "table_body": TABLE, "table_caption": ["t"], "page_idx": page} | k
    # a break: open end, next page, plain continuation; every condition taken away in turn
    for first, second, page, hit in [
        ("rain fell on", "the old roof", 1, True), ("rain fell on", "the old roof", 2, False), ("rain fell on", "the old roof", 0, False), ("rain fell.", "the old roof", 1, False),
        ("• rain fell on", "the old roof", 1, False), ("rain fell on", "* the old roof", 1, False), ("rain fell on", "7. the old roof", 1, False), ("rain fell；", "the old roof", 1, False),
    ]:
        yield [plain(first), {"type": "footer", "text": "ftr"}, plain(second, page_idx=page)], [(0, "cross_page_break")] * hit
    # numbers: neighbours among siblings, on either side, and a parent before its child
    for chapter in (2, 31):
        for n, other, hit in [(5, 4, True), (5, 6, True), (5, 3, False), (5, 7, False)]:
            blocks = [plain(f"{chapter}.{n} Harbour"), head(f"{chapter}.{other} Quay")]
            yield (blocks if other > n else blocks[::-1]), [(int(other < n), "missed_heading")] * hit
        yield [plain(f"{chapter}.9 Ships"), plain(f"{chapter}.9.3 Sails of them were mended here.")], [(0, "missed_heading")]
        yield [plain(f"{chapter}.9 Ships"), plain(f"{chapter + 1}.9.3 Sails of them were mended here.")], []
        yield [plain(f"{chapter}.9 Ships, boats"), plain(f"{chapter}.9.3 Sails of them were mended here.")], []
    for body, hit in [("Harbour, quay", True), ("Harbour.", True), ("H" * 41, True), ("H" * 40, False)]:
        yield [head(f"6 {body}")], [(0, "pseudo_heading")] * hit
    for markup, hit in [("[a](b)", True), ("$q$", True), ("\\beta", True), ("\\foo{q}", True), ("\\foo", False), ("\\$9", True), ("<sup>2</sup>", True), ("<HR/>", True), ("<abc>", False), ("1 < 2 > 0", False)]:
        yield [plain(f"it says {markup} there.")], [(0, "residual_markup")] * hit
    for k, hit in [(1, False), (2, True)]:
        yield [plain(("5.1 Rope\n" * k) + "w" * 1300)], [(0, "giant_block")] * hit
    yield [plain("5.1 Rope\n5.2 Cord\n" + "w" * 900)], []
    for page, hit in [(1, True), (4, True), (0, False)]:
        yield [table(), {"type": "header", "text": "hdr"}, table(page)], [(0, "split_table")] * hit
        yield [{"type": "list", "list_items": ["p"]}, {"type": "list", "list_items": ["q"], "page_idx": page}], [(0, "split_list")] * hit
    yield [{"type": "table", "table_body": "<table></table>"}], [(0, "caption_issue"), (0, "empty_table")]
    yield [{"type": "table", "table_footnote": ["n"]}], [(0, "caption_issue")]
    yield [{"type": "image", "image_caption": ["", "\t"]}, {"type": "image", "image_caption": ["p"]}, {"type": "chart"}], [(0, "caption_issue")]
    for text, hit in [("船舶检修情况一览，见附表。【相关表格】", True), ("短句【相关】", False), ("船舶检修情况一览，见附表。【参见】", False)]:
        yield [plain(text)], [(0, "trailing_marker")] * hit
    for text, hit in [("船长的的命令。", True), ("船长的命令。", False), ("是是非非。", False), ("到了了岸边。", True), ("一个氵在此。", True)]:
        yield [plain(text)], [(0, "extra_char")] * hit
    for text, hit in [("船舶登记表", True), ("船舶登记表。", False), ("船舶登记", False)]:
        yield [plain(text), head("登记", 1), table()], [(0, "separated_caption")] * hit
    for entry, hit in [("12.4 Crew", True), ("12.2 Crew", True), ("12.6 Crew", False), ("13.4 Crew", False), ("12.4 Crew; mates", False)]:
        yield [head("12.3 Captain"), table(table_caption=["crew", entry])], [(1, "caption_heading")] * hit
    yield [plain(None), {"type": "", "text": "q"}, plain(""), plain("40% of it"), plain("1999 was wet")], []


CASES = list(_cases())


def test_detectors(spark):
    """All cases at once, each a document of its own."""
    rows = [{"doc_id": f"case {n}", "ord": k, "type": "text", "page_idx": 0} | b for n, (blocks, _) in enumerate(CASES) for k, b in enumerate(blocks)]
    found = {f"case {n}": [] for n in range(len(CASES))}
    for r in detect.detect(content_lists.items_from_rows(spark, rows)).collect():
        found[r["doc_id"]].append((r["ord"], r["kind"]))
    assert {k: sorted(v) for k, v in found.items()} == {f"case {n}": wanted for n, (_, wanted) in enumerate(CASES)}


def test_artifacts(spark):
    run = [{"text": "Short title", "page_idx": p} for p in range(3)] + [{"text": "Body goes.", "page_idx": p} for p in range(2)]
    assert [o for o, k in kinds(make(spark, *run)) if k == "page_artifact"] == [0, 1, 2]
    heads = [{"type": "header", "text": "Firm X"}, {"type": "header", "text": "Firm X", "page_idx": 1}, {"type": "footer", "text": "No 5"}, {"type": "footer", "text": "No 5", "page_idx": 1}]
    found = detect.detect(make(spark, *heads, {"text": "Firm X No 5"}, {"text": "Firm X and more."}, {"type": "table", "table_body": TABLE, "table_caption": ["Firm  X", "No 5"]})).collect()
    assert sorted((r["ord"], r["kind"], r["detail"], r["value"]) for r in found) == [(4, "page_artifact", "furniture", None), (6, "caption_artifact", "furniture", 0)]


def test_numbering(spark):
    cases = {"第三章 总则": ("chapter", [3], 3), "第12条": ("chapter", [12], 4), "二十一、范围": ("chinese", [21], 4), "4.6核心": ("arabic", [4, 6], 3), "4．6 x": ("arabic", [4, 6], 3), "50% of": None, "2023.1": None, "第百章": None, "x": None, "007 b": ("arabic", [7], 3)}
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", numbering.parse(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] and (r["n"]["style"], r["n"]["path"], r["n"]["end"]) for r in rows} == cases


def test_rewrites(spark):
    items = make(spark, {"text": "one", "text_level": 3}, {"text": "two parts here"}, {"text": "a $\\mathsf { A }$ b \\$5 <b>c</b>"}, {"text": "的的"}, {"type": "list", "list_items": ["x", "half"]}, {"type": "list", "list_items": ["other", "y"]})
    assert ops.demote(items, decide(spark, {"ord": 0})).items.where("text_level is not null").isEmpty()
    assert ops.demote(items, decide(spark, {"ord": 1})).rejected.count() == 1
    assert ops.promote(items, decide(spark, {"ord": 1, "level": 7})).rejected.count() == 1
    assert ops.promote(items, decide(spark, {"ord": 1, "level": 2})).items.where("ord = 1").first()["text_level"] == 2
    assert texts(ops.split(items, decide(spark, {"ord": 1, "offset": 4})).items)[1:3] == ["two ", "parts here"]
    assert ops.split(items, decide(spark, {"ord": 1, "offset": 0})).rejected.count() == 1
    for pattern, text in {"latex_dollar": "a A b \\$5 <b>c</b>", "latex_block": "a  b \\$5 <b>c</b>", "html_tag": "a $\\mathsf { A }$ b \\$5 c", "latex_command": "a $  A $ b \\$5 <b>c</b>", "escaped_dollar": "a $\\mathsf { A }$ b $5 <b>c</b>"}.items():
        done = ops.strip(items, decide(spark, {"ord": 2, "pattern": pattern}))
        assert texts(done.items)[2] == text and not done.spans.isEmpty()
    assert ops.strip(items, decide(spark, {"ord": 1, "pattern": "html_tag"})).rejected.count() == 1
    assert texts(ops.delete_char(items, decide(spark, {"ord": 3, "offset": 1})).items)[3] == "的"
    assert ops.delete_char(items, decide(spark, {"ord": 1, "offset": 1})).rejected.count() == 1
    seam = ops.merge_list(items, decide(spark, {"ord": 4, "ord_b": 5, "join_seam": True})).items
    assert seam.where("ord = 4").first()["list_items"] == ["x", "half other", "y"] and seam.count() == 5
    assert texts(ops.reorder(items, decide(spark, {"ord": 0, "ords": [2, 0, 1]})).items)[:3] == ["a $\\mathsf { A }$ b \\$5 <b>c</b>", "one", "two parts here"]
    assert ops.reorder(items, decide(spark, {"ord": 0, "ords": [0, 2]})).rejected.count() == 1


def test_table_rewrites(spark):
    rows = "<tr><td>a</td><td>b</td></tr>", "<tr><td>e</td></tr>"
    items = make(spark, {"type": "table", "table_body": TABLE, "table_caption": ["A"]}, {"type": "footer", "text": "f"}, {"type": "table", "table_body": f"<table>{''.join(rows)}</table>", "table_caption": ["1.2 Head", "B"], "page_idx": 1})
    done = ops.merge_table(items, decide(spark, {"ord": 0, "ord_b": 2}))
    table = done.items.where("ord = 0").first()
    assert table["table_body"] == TABLE.replace("</table>", rows[1] + "</table>") and table["table_caption"] == ["A", "1.2 Head", "B"]
    assert [(r["text"], r["reason"]) for r in done.spans.collect()] == [(rows[0], "mergeTable:dup_header")]
    assert gates.table_bodies(items, done.items).isEmpty() and gates.char_subset(items, done.items).isEmpty()
    out = ops.extract_caption(items, decide(spark, {"ord": 2, "caption_index": 0, "position": "before", "level": 2})).items
    assert [(r["type"], r["text"], r["text_level"], r["table_caption"]) for r in out.orderBy("ord").collect()][2:] == [("text", "1.2 Head", 2, None), ("table", None, None, ["B"])]
    allowed = decide(spark, {"ord": 2})
    kept = ops.drop_caption(items, decide(spark, {"ord": 2, "caption_index": 1}), allowed)
    assert kept.items.where("ord = 2").first()["table_caption"] == ["1.2 Head"] and kept.spans.first()["text"] == "B"
    assert ops.drop_caption(items, decide(spark, {"ord": 0, "caption_index": 0}), allowed).rejected.count() == 1
    assert ops.drop(items, decide(spark, {"ord": 0}), decide(spark, {"ord": 0})).rejected.count() == 1


def test_chains_merge_every_other_link(spark):
    items = make(spark, *[{"text": f"part {k} of", "page_idx": k} for k in range(4)])
    done = ops.merge(items, decide(spark, *[{"ord": k, "ord_b": k + 1} for k in range(3)]))
    assert texts(done.items) == ["part 0 of part 1 of", "part 2 of part 3 of"] and done.rejected.count() == 1


def test_gates(spark):
    before = make(spark, {"text": "ab", "list_items": ["c"]}, {"type": "table", "table_body": TABLE, "table_caption": ["d"]})
    after = before.withColumn("text", F.concat("text", F.lit("b")))
    assert gates.char_subset(before, after).first()["reason"] == "more of b"
    twice = before.withColumn("table_body", F.replace("table_body", F.lit("<tr><td>c</td><td>d</td></tr>"), F.lit("<tr><td>a</td><td>b</td></tr>")))
    assert not gates.table_bodies(before, twice).isEmpty()
    assert gates.table_bodies(before, before.where("type = 'text'")).isEmpty()
    assert not gates.geometry(before, before.withColumn("page_idx", F.lit(7).cast("long"))).isEmpty()
    assert gates.geometry(before.withColumn("bbox", F.lit(None).cast("array<double>")), before.withColumn("page_idx", F.lit(7).cast("long"))).isEmpty()


def test_cells(spark):
    cases = {
        mechanical.clean_cell: {"  a  b ": "a b ", "中  文": "中文", "a　b": "a b", " x": " x", "http://a.b/ c. d e": "http://a.b/c.d e", "\\$5 \\* 6": "$5 * 6",
                                "$\\lambda_{ 1 }$ x": "λ_1 x", "$100$": "$100$", "$\\frac{1}{2}$": "$\\frac{1}{2}$", "\\$\\alpha$": "$\\alpha$", "$\\mathrm { k g }$": "kg"},
    }
    for f, pairs in cases.items():
        rows = spark.createDataFrame([(x,) for x in pairs], "s string").select("s", f(F.col("s")).alias("r")).collect()
        assert {r["s"]: r["r"] for r in rows} == pairs


def test_tables_are_cleaned(spark):
    head = "<tr><td>1</td><td>a description of more than twenty characters that</td></tr>"
    body = f"<table>{head}<tr><td></td><td>goes on</td></tr><tr><td>2</td><td>x  y</td></tr><tr><td> </td><td></td></tr></table>"
    items = make(spark, {"type": "table", "table_body": body}, {"type": "table", "table_body": TABLE})
    got = mechanical.clean_tables(items).collect()
    assert len(got) == 1
    assert got[0]["new_body"] == "<table><tr><td>1</td><td>a description of more than twenty characters that goes on</td></tr><tr><td>2</td><td>x y</td></tr></table>"
    assert (got[0]["n_merged"], got[0]["n_dropped"], got[0]["n_cells"]) == (1, 1, 1)
    spanning = "<table><tr><td rowspan='2'>a</td><td> </td></tr><tr><td></td></tr><tr><td>b</td></tr><tr><td></td></tr></table>"
    assert mechanical.clean_tables(make(spark, {"type": "table", "table_body": spanning})).first()["n_dropped"] == 1


def test_table_cleaning_keeps_the_text_between_rows(spark):
    head = "<tr><td>1</td><td>a description of more than twenty characters that</td></tr>"
    gaps = ["<table>\n<thead>", "</thead>\n<tbody>\n", "\n", "<!-- \x03 -->\n", "\n\n", "\n</tbody>\n</table>\n"]
    rows = [head, "<tr><td></td><td>goes on</td></tr>", "<tr><td> </td><td></td></tr>", "<tr><td>2</td><td>x  y</td></tr>", "<tr><td></td></tr>"]
    whole = "".join(g + r for g, r in zip(gaps, [*rows, ""], strict=True))
    empty = "<table>\n<tr><td></td></tr>\n<tr><td> </td></tr></table>"
    spanning = "<table>\n<tr><td rowspan='2'>a  b</td><td> </td></tr>\n<tr><td></td></tr>\n<tr><td>b</td></tr>\n<tr><td></td></tr>\n</table>"
    items = make(spark, *[{"type": "table", "table_body": b} for b in (whole, empty, spanning)])
    got = {r["ord"]: r for r in mechanical.clean_tables(items).collect()}
    kept = [rows[0].replace("that", "that goes on"), "", "", rows[3].replace("x  y", "x y"), "", ""]
    assert got[0]["new_body"] == "".join(g + r for g, r in zip(gaps, kept, strict=True))
    assert (got[0]["n_merged"], got[0]["n_dropped"], got[0]["n_cells"]) == (1, 2, 1)
    assert got[1]["new_body"] == "<table>\n\n</table>" and got[1]["n_dropped"] == 2
    assert got[2]["new_body"] == "<table>\n<tr><td rowspan='2'>a b</td><td> </td></tr>\n<tr><td></td></tr>\n<tr><td>b</td></tr>\n\n</table>"
    assert (got[2]["n_dropped"], got[2]["n_cells"]) == (1, 1)


def test_token_votes(spark):
    items = make(spark, {"text": "MODEL " * 6 + "M0DEL M0DEL &M0DEL M0D3L"}, {"type": "table", "table_body": "<table><tr><td>M0DEL x</td></tr></table>"})
    votes = mechanical.vote(mechanical.token_frequency(items))
    assert [(r["token"], r["fixed"], r["n"], r["m"]) for r in votes.collect()] == []
    more = items.unionByName(make(spark, {"text": "MODEL MODEL MODEL"}, doc="d").withColumn("ord", F.lit(9).cast("long")))
    votes = mechanical.vote(mechanical.token_frequency(more))
    assert [(r["token"], r["fixed"], r["n"], r["m"]) for r in votes.collect()] == [("M0DEL", "MODEL", 3, 9)]
    fixed = mechanical.apply_votes(more, votes).orderBy("ord").collect()
    assert fixed[0]["text"] == "MODEL " * 6 + "MODEL MODEL &M0DEL M0D3L" and fixed[1]["table_body"] == "<table><tr><td>MODEL x</td></tr></table>"


def test_markdown(spark):
    items = make(
        spark, {"text": "Head", "text_level": 9}, {"text": " plain "}, {"type": "header", "text": "h"}, {"type": "table", "table_caption": ["c"], "table_body": TABLE, "table_footnote": ["f", " "]},
        {"type": "image", "img_path": "a.jpg", "image_caption": ["i"]}, {"type": "equation", "text": "$x$"}, {"type": "list", "list_items": ["l1", "l2"]}, {"type": "odd", "text": "o", "img_path": "p"}, {"text": " "},
    )
    assert markdown.render(items).first()["markdown"] == "\n\n".join(["###### Head", "plain", "c", TABLE, "f", "![](a.jpg)", "i", "$x$", "l1", "l2", "o", "![](p)"]) + "\n"
    assert markdown.render(make(spark, {"text": None})).first()["markdown"] == "\n"


def test_content_lists(spark, tmp_path):
    blocks = [{"type": "text", "text": "a", "page_idx": 0, "odd": {"b": 1, "a": 2}}, {"type": "list", "list_items": ["x"], "bbox": [1, 2, 3]}, {"text": "no type"}]
    (tmp_path / "one.json").write_text(json.dumps(blocks))
    (tmp_path / "two.json").write_text(json.dumps({"items": blocks[:1], "sha256": "s"}))
    (tmp_path / "bad.json").write_text("not json")
    rows = {(r["doc_id"].rsplit("/", 1)[1], r["ord"]): r for r in content_lists.read_content_lists(spark, f"{tmp_path}/*.json").collect()}
    assert set(rows) == {("one.json", 0), ("one.json", 1), ("one.json", 2), ("two.json", 0), ("bad.json", -1)}
    assert json.loads(rows["one.json", 0]["raw"]) == blocks[0] and rows["one.json", 1]["bbox"] is None and rows["one.json", 2]["type"] == ""


def test_windows(spark):
    items = make(spark, *[{"text": f"1.{k} A", "page_idx": k} for k in range(1, 13)], {"text": "1.3 B", "page_idx": 13})
    groups = windows.sibling_groups(detect.annotate(items)).orderBy("first_ord").collect()
    assert [(g["first_ord"], g["n"]) for g in groups] == [(0, 10), (10, 2), (12, 1)]
    near = windows.around(items, 1, 1).orderBy("ord").collect()
    assert [len(r["near"]) for r in near] == [2] + [3] * 11 + [2]
    assert windows.page_neighbourhood(items).orderBy("page_idx").first()["n"] == 2


def test_documents_that_fail_a_gate_stay(spark, monkeypatch):
    monkeypatch.setattr(gates, "failures", lambda before, after: before.select("doc_id").distinct().withColumn("reason", F.lit("told so")))
    items = report_of_visit(spark)
    done = refine.refine(items)
    assert texts(done.items) == texts(items) and [(r["op"], r["fail_open"]) for r in done.report.collect()] == [("failOpen", "told so")]


def test_policy(spark):
    items = make(spark, {"text": "11.1 Oars", "text_level": 4}, {"text": "11.2 Masts"}, {"text": "a \\$3 <u>x</u>"})
    assert [(r["ord"], r["op"], r["level"], r["pattern"]) for r in policy.decide(detect.detect(items)).orderBy("ord").collect()] == [(1, "promote", 4, None), (2, "strip", None, "escaped_dollar")]
    assert t.DROP_CHARS == 120


def test_votes_long_text(spark):
    """A text of many words is cut up once, not once for each word (F3, F4)."""
    words = [f"word{chr(97 + k % 26)}" for k in range(20_000)]
    text = " ".join([*words, "modu1e", "&modu1e", "#modu1e", "xmodu1e", "modu1e."])
    items = spark.createDataFrame([("d", 0, text, None), ("d", 1, None, "<table><tr><td>modu1e 7</td><td>other</td></tr></table>"), ("e", 0, "modu1e", None)], "doc_id string, ord long, text string, table_body string")
    items = items.selectExpr("*", *[f"array('modu1e', null) as {c}" for c in ("list_items", "table_caption", "table_footnote")])
    few = [("d", "modu1e", "module")]
    many = few + [("d", f"rare{k}x", f"rare{k}y") for k in range(mechanical.LOOKED_FOR)]
    for votes in (few, many):
        began = time.time()
        got = mechanical.apply_votes(items, spark.createDataFrame(votes, "doc_id string, token string, fixed string")).orderBy("doc_id", "ord").collect()
        assert time.time() - began < 60
        assert got[0]["text"] == " ".join([*words, "module", "&modu1e", "#modu1e", "xmodu1e", "module."])
        assert got[1]["table_body"] == "<table><tr><td>module 7</td><td>other</td></tr></table>"
        assert got[0]["list_items"] == ["module", None] and got[2]["text"] == "modu1e" and got[2]["table_caption"] == ["modu1e", None]


def test_text_rules_without_patterns(spark):
    """Trims, ends and lengths are those of the patterns on all kinds of white space."""
    spaces = " \t\n\x0b\x0c\r\x85\xa0    ​    　﻿\x1c"
    rows = ["", "a", "。", "表", "😀" * 3, "ab　c", *[f"{x}a{x}b.{x}{x}" for x in spaces], *[x * 4 for x in spaces], "12345", "1234 5", "123456", "😀 2 3 4﻿5", "a!\n b", None]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    s = F.col("s")
    pairs = [
        (t.trim(s), F.regexp_replace(s, rf"^{t.S}+|{t.S}+\z", "")), (t.sentence_end(s), s.rlike(t.SENTENCE_END)), (t.non_ws(s), F.regexp_replace(s, f"[{t.CONTENT_SPACE}]", "")),
        *[(t.at_most(s, n), F.length(F.regexp_replace(s, f"[{t.CONTENT_SPACE}]", "")) <= n) for n in (0, 2, 5, 10)],
    ]
    for k, (new, old) in enumerate(pairs):
        assert df.where(~new.eqNullSafe(old)).collect() == [], k


def test_refine_detects_once_a_round(spark, monkeypatch):
    """Documents that leave the loop are not searched again at its end."""
    calls = []
    found = detect.detect
    monkeypatch.setattr(detect, "detect", lambda items, **k: calls.append(1) or found(items, **k))
    done = refine.refine(make(spark, {"text": "<b>one</b>"}, {"text": "two", "doc_id": "e"}))
    assert len(calls) == len(done.progress)


def test_rounds_touch_only_named_blocks(spark):
    """New blocks of several rounds find their place, numbers and ids between blocks that no rewrite touches (F1, F2)."""
    marked = "a text that is long enough to be cut[相关文件]"
    filler = [{"text": f"A sentence of its own, number {k}."} for k in range(3)]
    items = make(spark, {"text": "2.1 Oars", "text_level": 3}, filler[0], {"text": marked}, filler[1], {"type": "table", "table_body": TABLE, "table_caption": ["Note", "2.2 Masts"]}, filler[2])
    done = refine.refine(items)
    got = [(r["ord"], r["text"], r["item_id"]) for r in done.items.orderBy("ord").collect()]
    assert [g[0] for g in got] == list(range(8))
    assert [g[1] for g in got] == ["2.1 Oars", filler[0]["text"], marked[:-6], "[相关文件]", filler[1]["text"], None, "2.2 Masts", filler[2]["text"]]
    assert len({g[2] for g in got}) == 8 and [got[k][2] for k in (0, 1, 2, 4, 5, 7)] == [f"it_000{k}" for k in range(1, 7)]


def test_detectors_need_no_texts(spark):
    """Suspects are told from narrow rows: no text is sorted by document (F1, F2)."""
    items = make(spark, {"text": "<b>one</b>"}, {"text": "第2页"}, {"text": "half a sentence that"}, {"text": "goes on", "page_idx": 1})
    rows = detect.neighbours(detect.slim(items))
    assert not {"text", "table_body", "list_items"} & set(rows.columns)
    assert sorted((r["ord"], r["kind"]) for r in detect.detect(items, annotated=rows).collect()) == sorted((r["ord"], r["kind"]) for r in detect.detect(items).collect())


def test_tokens_are_whole_runs(spark):
    old = lambda s: [r for r in re.findall(r"[&#]?[A-Za-z0-9]+", s) if r[0] not in "&#" and len(r) >= 4 and sum(c.isdigit() for c in r) <= 1]
    rows = ["abcd ab1d a1b2 abc 1abc abc1 12ab &abcd #abcd &&abcd x&abcd é abcdé abcd1efgh abcd12", "", "a-bcde_fghi"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", mechanical.tokens(F.col("s")).alias("r")).collect()
    assert {r["s"]: r["r"] for r in got} == {s: old(s) for s in rows}
