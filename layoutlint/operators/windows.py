"""Neighbourhoods, groups and outlines of content lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutlint.functions import text as t
from layoutlint.operators.detect import numbered

#: Blocks that are judged together at most.
GROUP_SIZE = 10


def outline(items: DataFrame) -> DataFrame:
    """All headings of a document with their place among them."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    heads = items.where("type = 'text' and text_level is not null")
    return heads.select("doc_id", "ord", "text_level", t.trim(F.col("text")).alias("text"), F.row_number().over(w).cast("long").alias("place"))


def around(items: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each block with its neighbours, itself included, as ``near``; 0 to 5 on each side."""
    before, after = (min(5, max(0, k)) for k in (before, after))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-before, after)
    return items.withColumn("near", F.collect_list(F.struct("ord", "type", "text")).over(w))


def page_neighbourhood(items: DataFrame) -> DataFrame:
    """For each page the number of blocks on it and the pages next to it, and the first and last of them."""
    pages = items.groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    w = Window.partitionBy("doc_id").orderBy("page_idx").rangeBetween(-1, 1)
    return pages.select("doc_id", "page_idx", F.sum("c").over(w).alias("n"), F.min("lo").over(w).alias("first_ord"), F.max("hi").over(w).alias("last_ord"))


def sibling_groups(annotated: DataFrame) -> DataFrame:
    """Runs of heading-like blocks with the same style, depth and parent and rising numbers, at most ``GROUP_SIZE`` in one."""
    w = Window.partitionBy("doc_id", "style", "depth", "parent").orderBy("ord")
    rows = numbered(annotated).where("candidate").withColumn("cut", F.when(F.lag("last").over(w) < F.col("last"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("cut").over(w))
    inside = Window.partitionBy("doc_id", "style", "depth", "parent", "run").orderBy("ord")
    rows = rows.withColumn("part", F.floor((F.row_number().over(inside) - 1) / GROUP_SIZE))
    listed = F.array_sort(F.collect_list(F.struct("ord", "last")))
    return rows.groupBy("doc_id", "style", "depth", "parent", "run", "part").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["last"].cast("string")), ",").alias("numbers")
    ).select("doc_id", "style", F.col("depth").cast("long").alias("depth"), "parent", "first_ord", "n", "numbers")


def same_text_groups(items: DataFrame) -> DataFrame:
    """Texts that several blocks of a document have."""
    keys = items.where("type = 'text'").select("doc_id", t.trim(F.col("text")).alias("key"), "ord").where("key <> ''")
    return keys.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).where("n >= 2")


def level_mode(annotated: DataFrame) -> DataFrame:
    """The most frequent level of a document's headings by style and depth of their numbers; the smaller of equally frequent ones."""
    levels = numbered(annotated).where("text_level is not null").groupBy("doc_id", "style", "depth", F.col("text_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    best = levels.groupBy("doc_id", "style", "depth").agg(F.max(F.struct("n", (-F.col("level")).alias("l"))).alias("b"))
    return best.select("doc_id", "style", F.col("depth").cast("long").alias("depth"), (-F.col("b.l")).alias("level"), F.col("b.n").alias("n"))
