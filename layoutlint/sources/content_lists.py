"""Readers of content-list files: a JSON array of blocks, or an object with the array as ``items``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutlint.schema import FIELDS, ITEMS, NAMES

_ARRAYS = [f.name for f in FIELDS if isinstance(f.dataType, T.ArrayType) and f.dataType.elementType == T.StringType()]


def blocks(content: Column) -> Column:
    """The blocks of one file as an array of JSON texts; null if it is neither an array nor an object with one."""
    raw = "array<string>"
    return F.coalesce(F.from_json(content, raw), F.from_json(F.get_json_object(content, "$.items"), raw))


def parse_items(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """A row per block in reading order, with its original JSON text in ``raw``.

    Files that cannot be read give a single row with null ``raw`` and ``ord`` -1, so that nothing is lost silently.
    """
    listed = files.select(F.col(id_col).cast("string").alias("doc_id"), blocks(F.col(content_col)).alias("b"))
    rows = listed.select("doc_id", F.posexplode_outer("b").alias("ord", "raw"))
    # strings among other members of a list are kept, the others are not
    loose = T.StructType([f if f.name not in _ARRAYS else T.StructField(f.name, T.ArrayType(T.StringType())) for f in FIELDS])
    rows = rows.withColumn("v", F.from_json("raw", loose))
    bbox = F.when((F.size("v.bbox") == 4) & F.forall("v.bbox", lambda x: x.isNotNull()), F.col("v.bbox"))
    fields = {n: F.col(f"v.{n}") for n in NAMES} | {"type": F.coalesce("v.type", F.lit("")), "bbox": bbox}
    return rows.select("doc_id", F.coalesce(F.col("ord").cast("long"), F.lit(-1).cast("long")).alias("ord"), *[fields[n].alias(n) for n in NAMES], "raw")


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Items of all files that match ``path``; the file name is the document's id."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))
    return parse_items(files)


def items_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Items from Python dictionaries with ``doc_id``, ``ord`` and any of the fields."""
    names = [f.name for f in ITEMS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ITEMS)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``img_path`` below ``folder`` and the bytes of each picture."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("img_path"), "content")
