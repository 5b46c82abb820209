"""Tables whose text is no language: dictionary coverage of their cells, proposals for single cells, and degradation to pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlint.functions import text as t
from layoutlint.operators.mechanical import CELL, build_row, parse_row

# --- fixed values ---
HANZI = "[一-鿿]"
WORD_LENGTHS = (4, 3, 2)
COVERAGE, SAMPLE_CHARS = 0.55, 24
CELL_CHARS, RENDER_CHARS, CELL_OVERHEAD, REWRITABLE = 256, 8000, 8, 0.75
NUMERIC = r"^[0-9 .,，%‰/:：~±+\-()（）]+\z"


def cell_texts(tables: DataFrame) -> DataFrame:
    """Cells of tables: ``row``, ``col`` and the text without tags."""
    rows = tables.select("doc_id", "ord", F.posexplode(t.table_rows(F.col("table_body"))).alias("row", "html"))
    cells = rows.select("doc_id", "ord", "row", F.posexplode(F.regexp_extract_all("html", F.lit(CELL), F.lit(2))).alias("col", "inner"))
    return cells.select("doc_id", "ord", "row", "col", F.regexp_replace("inner", "<[^>]*>", "").alias("text"))


def word_coverage(texts: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """``total`` characters in runs of two or more ideographs, and how many of them forward maximal matching covers with ``words``.

    The dictionary is a table of any size: the substrings of all runs are joined with it, and a fold walks over the longest word at each
    place. Runs end with their text.
    """
    runs = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(f"{HANZI}{{2,}}"), F.lit(0))).alias("run"))
    runs = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("times"))
    distinct = runs.select("run").distinct()
    parts = distinct.select("run", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("at")).select(
        "run", "at", F.explode(F.array(*[F.lit(n) for n in WORD_LENGTHS])).alias("n")
    )
    parts = parts.where(F.expr("at + n - 1 <= length(run)")).withColumn("word", F.substring("run", F.col("at"), F.col("n")))
    best = parts.join(words.select("word").distinct(), "word", "left_semi").groupBy("run", "at").agg(F.max("n").alias("n"))
    maps = best.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("best"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("covered"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.length("run")),
        start,
        lambda s, i: F.when(i < s["next"], s).otherwise(
            F.struct((i + F.greatest(F.coalesce(F.try_element_at(F.col("best"), i), F.lit(0)), F.lit(1))).alias("next"), (s["covered"] + F.coalesce(F.try_element_at(F.col("best"), i), F.lit(0))).alias("covered"))
        ),
        lambda s: s["covered"],
    )
    covered = distinct.join(maps, "run", "left").select("run", F.when(F.col("best").isNull(), 0).otherwise(walk).cast("long").alias("covered"))
    return runs.join(covered, "run").groupBy(*keys).agg(F.sum(F.length("run") * F.col("times")).cast("long").alias("total"), F.sum(F.col("covered") * F.col("times")).alias("covered"))


def garbled_tables(items: DataFrame, words: DataFrame) -> DataFrame:
    """Tables with ``SAMPLE_CHARS`` or more ideographs in runs of which words cover less than ``COVERAGE``."""
    tables = items.where("table_body is not null")
    found = word_coverage(cell_texts(tables), words, ["doc_id", "ord"]).withColumn("coverage", F.col("covered") / F.col("total"))
    return found.where((F.col("total") >= SAMPLE_CHARS) & (F.col("coverage") < COVERAGE))


def degrade(items: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Garbled tables with a picture become images; captions and footnotes go with them. Items and spans."""
    bad = garbled_tables(items, words).select("doc_id", "ord", "coverage")
    joined = items.join(bad, ["doc_id", "ord"], "left").withColumn("hit", F.col("coverage").isNotNull() & (F.length(F.coalesce("img_path", F.lit(""))) > 0))
    change = {
        "type": F.lit("image"), "table_body": F.lit(None).cast("string"), "table_caption": F.lit(None).cast("array<string>"), "table_footnote": F.lit(None).cast("array<string>"),
        "image_caption": F.coalesce("table_caption", "image_caption"), "image_footnote": F.coalesce("table_footnote", "image_footnote"),
    }
    out = joined.select(*[F.when(F.col("hit"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in items.columns])
    reason = F.concat(F.lit("garbled:degrade_to_image(coverage="), F.format_string("%.2f", "coverage"), F.lit(")"))
    return out, joined.where("hit").select("doc_id", "ord", F.lit("[table]").alias("text"), reason.alias("reason"))


def is_numeric(s: Column) -> Column:
    return s.rlike(NUMERIC)


def structurally_valid(s: Column) -> Column:
    """At most ``CELL_CHARS``, without angle brackets and control characters but tabs."""
    return (F.length(s) <= CELL_CHARS) & ~s.rlike(r"[<>\x00-\x08\x0a-\x1f\x7f-\x9f]")


def length_fits(old: Column, new: Column) -> Column:
    return (F.length(new) <= 2 * F.length(old) + 2) & (F.length(old) <= 2 * F.length(new) + 2)


def rewritable(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Cells that may be rewritten: ideographs that words cover by less than ``REWRITABLE``, or else three Latin letters in a row."""
    keys = ["doc_id", "ord", "row", "col"]
    bare = cells.withColumn("text", t.trim(F.col("text"))).where((F.col("text") != "") & ~is_numeric(F.col("text")))
    scored = bare.join(word_coverage(bare, words, keys), keys, "left")
    low = F.col("total").isNull() | (F.col("covered") < REWRITABLE * F.col("total"))
    return scored.where((F.col("text").rlike(HANZI) & low) | (~F.col("text").rlike(HANZI) & F.col("text").rlike("[A-Za-z]{3}"))).select(*keys, "text")


def judge_proposals(items: DataFrame, proposals: DataFrame, words: DataFrame) -> DataFrame:
    """Verdicts on proposed cell texts (``doc_id, ord, row, col, new``): the first gate that fails, ``ok``, or null for no change.

    In order: the cell must exist and be rewritable, the text be valid and no number, the lengths fit, and the cell not be
    proposed before. At the end all of a table's proposals fall unless they raise its coverage.
    """
    keys = ["doc_id", "ord", "row", "col"]
    cells = cell_texts(items.where("table_body is not null"))
    can = rewritable(cells, words).select(*keys, F.lit(True).alias("can"))
    p = proposals.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in proposals.columns else proposals
    p = p.withColumn("new", t.trim(F.regexp_replace("new", "\n", " "))).join(cells, keys, "left").join(can, keys, "left")
    verdict = (
        F.when(F.col("text").isNull(), "no_cell").when(F.col("can").isNull(), "not_rewritable").when(~structurally_valid(F.col("new")), "invalid")
        .when(is_numeric(F.col("new")), "numeric").when(~length_fits(F.col("text"), F.col("new")), "length")
    )
    p = p.withColumn("verdict", verdict)
    first = F.row_number().over(Window.partitionBy(*keys, F.col("verdict").isNull()).orderBy("seq"))
    p = p.withColumn("verdict", F.when(F.col("verdict").isNull() & (first > 1), "duplicate").otherwise(F.col("verdict")))
    p = p.withColumn("verdict", F.when(F.col("verdict").isNull() & (F.col("new") != F.col("text")), "ok").otherwise(F.col("verdict")))
    taken = p.where("verdict = 'ok'").select(*keys, "new")
    after = cells.join(taken, keys, "left").withColumn("text", F.coalesce("new", "text"))
    table = ["doc_id", "ord"]
    old = word_coverage(cells, words, table).select(*table, (F.col("covered") / F.col("total")).alias("was"))
    new = word_coverage(after, words, table).select(*table, (F.col("covered") / F.col("total")).alias("now"))
    better = old.join(new, table).where("now > was").select(*table, F.lit(True).alias("better"))
    p = p.join(better, table, "left")
    return p.select(*keys, "text", "new", F.when((F.col("verdict") == "ok") & F.col("better").isNull(), "no_gain").otherwise(F.col("verdict")).alias("verdict"))


def targets(items: DataFrame, words: DataFrame) -> DataFrame:
    """Garbled tables that can be read again from their picture: ``doc_id, ord, img_path, coverage``. Their cells, with ``CELL_OVERHEAD`` characters for each, must
    fit into ``RENDER_CHARS``."""
    bad = garbled_tables(items, words).select("doc_id", "ord", "coverage")
    tables = items.join(bad, ["doc_id", "ord"]).where(F.length(F.coalesce("img_path", F.lit(""))) > 0)
    size = cell_texts(tables).groupBy("doc_id", "ord").agg(F.sum(F.length("text") + CELL_OVERHEAD).alias("size")).where(F.col("size") <= RENDER_CHARS)
    return tables.join(size.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").select("doc_id", "ord", "img_path", "coverage")


def escape_cell_text(s: Column) -> Column:
    return F.replace(s, F.lit("&"), F.lit("&amp;"))


def apply_proposals(items: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the cells that :func:`judge_proposals` found ``ok`` rewritten, and the rewrites (``doc_id, ord, row, col, before, after``). All other bytes of a table stay."""
    ok = judged.where("verdict = 'ok'").select("doc_id", "ord", "row", "col", F.col("text").alias("before"), F.col("new").alias("after"))
    entry = F.struct(F.concat_ws(":", "row", "col").alias("k"), escape_cell_text(F.col("after")).alias("v"))
    maps = ok.groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(entry)).alias("new_cells"))
    joined = items.join(maps, ["doc_id", "ord"], "left")
    put = lambda row, i: row.withField("cells", F.transform(row["cells"], lambda c, k: F.coalesce(F.try_element_at("new_cells", F.concat_ws(":", i, k)), c)))
    rows = F.transform(F.transform(t.table_rows(F.col("table_body")), parse_row), put)
    gaps = F.split("table_body", t.TABLE_ROW)
    body = t.let(F.transform(rows, build_row), lambda built: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(built, i), F.lit("")))), ""))
    out = joined.withColumn("table_body", F.when(F.col("new_cells").isNull(), F.col("table_body")).otherwise(body))
    return out.select(items.columns), ok
