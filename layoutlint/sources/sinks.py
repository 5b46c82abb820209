"""Writers of repaired content lists."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutlint.operators import markdown
from layoutlint.schema import NAMES


def result_json(items: DataFrame, report: DataFrame) -> DataFrame:
    """``doc_id`` and ``value``: one JSON object with a document's blocks in order and its counts by rewrite. Null fields are left out."""
    blocks = F.array_sort(F.collect_list(F.struct("ord", F.struct(*NAMES).alias("b"))))
    listed = items.groupBy("doc_id").agg(F.transform(blocks, lambda x: x["b"]).alias("items"))
    counts = report.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias("opCounts"))
    joined = listed.join(counts, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct("items", F.struct("opCounts").alias("report"))).alias("value"))


def write_results(items: DataFrame, report: DataFrame, path: str) -> None:
    """Three tables under ``path``: ``items`` as Parquet, ``results`` as lines of JSON, and ``markdown``."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    result_json(items, report).select("value").write.mode("overwrite").text(f"{path}/results")
    markdown.render(items).write.mode("overwrite").parquet(f"{path}/markdown")


def cache_key(sha256: str, logic_version: str, options: dict) -> str:
    """A name for the result of one input under one version and one set of options, whatever the order of their entries."""
    ordered = {k: sorted(v) if isinstance(v, (list, tuple, set)) else v for k, v in sorted(options.items())}
    return f"{sha256}:{logic_version}:{hashlib.sha256(json.dumps(ordered, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]}"
