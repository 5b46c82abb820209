import json

from layoutlint.sources import content_lists, sinks


def test_results(spark, tmp_path):
    rows = [{"doc_id": "d", "ord": k, "type": "text", "text": x, "page_idx": 0} for k, x in enumerate(["b", "a"])]
    items = content_lists.items_from_rows(spark, rows)
    report = spark.createDataFrame([("d", "drop", 2, None)], "doc_id string, op string, n long, fail_open string")
    sinks.write_results(items, report, str(tmp_path / "out"))
    value = json.loads(spark.read.text(str(tmp_path / "out" / "results")).first()["value"])
    assert [b["text"] for b in value["items"]] == ["b", "a"] and value["report"]["opCounts"] == {"drop": 2}
    assert spark.read.parquet(str(tmp_path / "out" / "markdown")).first()["markdown"] == "b\n\na\n"


def test_cache_key():
    a = sinks.cache_key("s", "1", {"pairs": ["ab", "cd"], "garbled": True})
    assert a == sinks.cache_key("s", "1", {"garbled": True, "pairs": ["cd", "ab"]}) != sinks.cache_key("s", "1", {"garbled": False, "pairs": ["ab", "cd"]})
