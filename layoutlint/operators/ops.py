"""Rewrites of blocks, for all documents at once: each takes items and decisions and returns items, removed spans and rejected decisions.

A decision is a row with ``doc_id``, ``ord`` and what its rewrite needs (see ``schema.DECISIONS``); of several for one block and rewrite the
one that sorts first counts. Orders are renumbered from 0 where blocks come or go.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlint.functions import text as t
from layoutlint.schema import NAMES

STRIP_PATTERNS = {
    "md_link": t.MD_LINK,
    "latex_dollar": r"\$([^$\n]+)\$",
    "latex_block": t.LATEX_BLOCK,
    "latex_command": t.LATEX_COMMAND,
    "escaped_dollar": t.ESCAPED_DOLLAR,
    "html_tag": t.HTML_TAG,
}


class Applied(NamedTuple):
    items: DataFrame
    spans: DataFrame
    rejected: DataFrame


def _columns(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c not in ("doc_id", "ord")]


def renumber(items: DataFrame, *order: str) -> DataFrame:
    """``ord`` from 0 by the given columns."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return items.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))


def _spans(rows: DataFrame, text: Column, reason: Column) -> DataFrame:
    return rows.select("doc_id", "ord", text.alias("text"), reason.alias("reason"))


def _none(items: DataFrame) -> DataFrame:
    return items.where("false").select("doc_id", "ord", F.lit("").alias("text"), F.lit("").alias("reason"))


def _rejected(decisions: DataFrame, accepted: DataFrame) -> DataFrame:
    return decisions.join(accepted.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").select("doc_id", "ord")


def _one(decisions: DataFrame) -> DataFrame:
    """One decision for each block."""
    rest = [c for c in decisions.columns if c not in ("doc_id", "ord")]
    if not rest:
        return decisions.distinct()
    return decisions.groupBy("doc_id", "ord").agg(F.min(F.struct(*rest)).alias("d")).select("doc_id", "ord", "d.*")


def _rewrite(items: DataFrame, decisions: DataFrame, ok: Column, changes: dict[str, Column], text: Column, reason: Column) -> Applied:
    """Change columns of decided rows where ``ok`` holds."""
    d = _one(decisions)
    args = [c for c in d.columns if c not in ("doc_id", "ord")]
    renamed = d.select("doc_id", "ord", *[F.col(c).alias(f"d_{c}") for c in args], F.lit(True).alias("decided"))
    joined = items.join(renamed, ["doc_id", "ord"], "left").withColumn("ok", F.col("decided").isNotNull() & F.coalesce(ok, F.lit(False)))
    out = joined.select("doc_id", "ord", *[F.when(F.col("ok"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in _columns(items)])
    hit = joined.where("ok")
    return Applied(out, _spans(hit, text, reason).where("text is not null"), _rejected(d, hit))


def demote(items: DataFrame, decisions: DataFrame) -> Applied:
    """Headings become plain text."""
    null = F.lit(None)
    return _rewrite(items, decisions.select("doc_id", "ord"), F.col("text_level").isNotNull(), {"text_level": null.cast("int")}, null.cast("string"), F.lit(""))


def promote(items: DataFrame, decisions: DataFrame) -> Applied:
    """Texts become headings of ``level`` 1 to 6."""
    ok = (F.col("type") == "text") & F.col("text").isNotNull() & F.col("d_level").between(1, 6)
    return _rewrite(items, decisions.select("doc_id", "ord", "level"), ok, {"text_level": F.col("d_level").cast("int")}, F.lit(None).cast("string"), F.lit(""))


def drop(items: DataFrame, decisions: DataFrame, allowed: DataFrame) -> Applied:
    """Remove blocks that are both decided and ``allowed`` (suspects of artifacts and husks): page numbers, short texts and headers, husks."""
    husk = t.is_husk(F.col("type"), F.col("table_body"), F.col("img_path"), F.col("table_caption"), F.col("table_footnote"))
    short = F.col("type").isin("text", "header") & (F.length(F.coalesce("text", F.lit(""))) <= t.DROP_CHARS)
    keys = _one(decisions.select("doc_id", "ord")).join(allowed.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi")
    hit = items.join(keys, ["doc_id", "ord"], "left_semi").where((F.col("type") == "page_number") | short | husk)
    left = items.join(hit.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    text = F.coalesce("text", F.concat(F.lit("["), F.col("type"), F.lit("]")))
    return Applied(renumber(left, "ord"), _spans(hit, text, F.lit("drop")), _rejected(decisions, hit))


def _unlatex(s: Column) -> Column:
    """The content of formulas without dollars, commands, braces and white space; the text between stays."""
    # cut at each formula: odd pieces are formulas, marked by an unused character
    marked = F.regexp_replace(s, STRIP_PATTERNS["latex_dollar"], "\x01$1\x01")
    bare = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\[a-zA-Z]+|[{}]", " "), f"[{t.CONTENT_SPACE}]", "")
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda p, i: F.when(i % 2 == 1, bare(p)).otherwise(p)), "")


def stripped(s: Column, pattern: str) -> Column:
    """The text without a pattern's markup."""
    if pattern == "latex_dollar":
        return _unlatex(s)
    put = {"md_link": "$1", "escaped_dollar": r"\$"}.get(pattern, "")
    return F.regexp_replace(s, STRIP_PATTERNS[pattern], put)


def strip(items: DataFrame, decisions: DataFrame) -> Applied:
    """Remove the markup of ``pattern``; not if there is none or if nothing would be left. Each match is a span."""
    d = _one(decisions.select("doc_id", "ord", "pattern")).withColumnRenamed("pattern", "d_pattern")
    joined = items.join(d, ["doc_id", "ord"], "left")
    choose = lambda f: F.coalesce(*[F.when(F.col("d_pattern") == p, f(p)) for p in STRIP_PATTERNS])
    new = choose(lambda p: stripped(F.col("text"), p))
    found = choose(lambda p: F.regexp_extract_all("text", F.lit(STRIP_PATTERNS[p]), F.lit(0)))
    joined = joined.withColumns({"found": found, "new": new}).withColumn("ok", F.coalesce((F.size("found") > 0) & (t.non_ws_len(F.col("new")) > 0), F.lit(False)))
    out = joined.select("doc_id", "ord", *[F.when(F.col("ok"), F.col("new")).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in _columns(items)])
    hit = joined.where("ok")
    spans = hit.select("doc_id", "ord", F.explode("found").alias("text"), F.concat(F.lit("strip:"), F.col("d_pattern")).alias("reason"))
    return Applied(out, spans, _rejected(d, hit))


def delete_char(items: DataFrame, decisions: DataFrame) -> Applied:
    """Remove the character at ``offset`` if it is a lone radical or a doubled function word."""
    s, at = F.col("text"), F.col("d_offset").cast("int")
    new = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 2, F.length(s)))
    why = t.may_delete(s, at)
    ok = (F.col("type") == "text") & why.isNotNull() & (t.non_ws_len(new) > 0)
    return _rewrite(items, decisions.select("doc_id", "ord", "offset"), ok, {"text": new}, F.substring(s, at + 1, F.lit(1)), F.concat(F.lit("deleteChar:"), why))


def split(items: DataFrame, decisions: DataFrame) -> Applied:
    """Cut texts in two at ``offset``; the second part is no heading. Neither part may be blank."""
    d = _one(decisions.select("doc_id", "ord", "offset")).withColumnRenamed("offset", "d_offset")
    s, at = F.col("text"), F.col("d_offset").cast("int")
    joined = items.join(d, ["doc_id", "ord"], "left").withColumns({"head": F.substring(s, F.lit(1), at), "tail": F.substring(s, at + 1, F.length(s))})
    ok = (F.col("type") == "text") & (at > 0) & (at < F.length(s)) & (t.non_ws_len(F.col("head")) > 0) & (t.non_ws_len(F.col("tail")) > 0)
    joined = joined.withColumn("ok", F.coalesce(ok, F.lit(False)))
    parts = F.when(F.col("ok"), F.array(F.struct(F.col("head").alias("s"), F.col("text_level").alias("l")), F.struct(F.col("tail").alias("s"), F.lit(None).cast("int").alias("l"))))
    parts = F.coalesce(parts, F.array(F.struct(s.alias("s"), F.col("text_level").alias("l"))))
    rows = joined.select("*", F.posexplode(parts).alias("part", "piece")).withColumns({"text": F.col("piece.s"), "text_level": F.col("piece.l")})
    out = renumber(rows, "ord", "part").select("doc_id", "ord", *_columns(items))
    return Applied(out, _none(items), _rejected(d, joined.where("ok")))


def reorder(items: DataFrame, decisions: DataFrame) -> Applied:
    """Permute blocks: the ones in ``ords`` take its order. They must be different and next to each other; overlapping decisions lose to the earlier."""
    d = _one(decisions.select("doc_id", "ord", "ords"))
    fine = (F.size("ords") >= 2) & (F.size(F.array_distinct("ords")) == F.size("ords")) & (F.array_max("ords") - F.array_min("ords") == F.size("ords") - 1)
    d = d.withColumns({"lo": F.array_min("ords"), "hi": F.array_max("ords")})
    # a range that begins before an earlier one ends is left out
    reach = F.max("hi").over(Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    good = d.where(fine).withColumn("reach", reach).where("reach is null or lo > reach")
    moves = good.select("doc_id", "ord", "lo", F.posexplode("ords").alias("k", "from_ord"))
    known = moves.join(items.select("doc_id", F.col("ord").alias("from_ord")), ["doc_id", "from_ord"], "left_semi")
    whole = known.groupBy("doc_id", "ord").agg(F.count(F.lit(1)).alias("n")).join(good.select("doc_id", "ord", F.size("ords").alias("size")), ["doc_id", "ord"]).where("n = size")
    moves = moves.join(whole.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").select("doc_id", F.col("from_ord").alias("ord"), (F.col("lo") + F.col("k")).alias("to_ord"))
    out = items.join(moves, ["doc_id", "ord"], "left").withColumn("ord", F.coalesce("to_ord", "ord")).select("doc_id", "ord", *_columns(items))
    return Applied(out, _none(items), _rejected(d, whole))


def unchained(pairs: DataFrame) -> DataFrame:
    """Of links a-b, b-c, c-d… in one chain the first, third…: their blocks do not overlap, and the rest waits for the next round."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    starts = F.coalesce((F.lag("ord_b").over(w) != F.col("ord")).cast("int"), F.lit(1))
    chained = pairs.withColumn("chain", F.sum(starts).over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("ord"))
    return chained.withColumn("place", place).where("place % 2 = 1").drop("chain", "place")


def _pairs(items: DataFrame, decisions: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Decisions and the two blocks of each, where only furniture lies between them."""
    content = F.when(~t.is_furniture(F.coalesce(F.col("type"), F.lit(""))), F.struct("ord", *NAMES))
    back = Window.partitionBy("doc_id").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    d = _one(decisions.select("doc_id", "ord", "ord_b", *extra))
    rows = items.withColumn("b", F.last(content, ignorenulls=True).over(back)).join(d, ["doc_id", "ord"])
    return d, rows.where(F.col("b.ord") == F.col("ord_b"))


def _merged(items: DataFrame, decisions: DataFrame, rows: DataFrame, changes: dict[str, Column], spans: DataFrame) -> Applied:
    changed = rows.select("doc_id", "ord", *[v.alias(f"new_{c}") for c, v in changes.items()], F.lit(True).alias("hit"))
    gone = rows.select("doc_id", F.col("ord_b").alias("ord"))
    left = items.join(gone, ["doc_id", "ord"], "left_anti").join(changed, ["doc_id", "ord"], "left")
    out = left.select("doc_id", "ord", *[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in _columns(items)])
    return Applied(renumber(out, "ord"), spans, _rejected(decisions, rows))


def merge(items: DataFrame, decisions: DataFrame) -> Applied:
    """Join two texts with only furniture between; the first keeps its page and other fields, furniture stays behind it."""
    d, rows = _pairs(items, decisions)
    rows = unchained(rows.where("type = 'text' and b.type = 'text' and text <> '' and b.text <> ''"))
    return _merged(items, d, rows, {"text": t.join_text(F.col("text"), F.col("b.text")), "bbox": t.union_bbox(F.col("bbox"), F.col("b.bbox"))}, _none(items))


def merge_list(items: DataFrame, decisions: DataFrame) -> Applied:
    """Join two lists; with ``join_seam`` the last entry and the first one are parts of one sentence."""
    d, rows = _pairs(items, decisions, ("join_seam",))
    rows = unchained(rows.where("type = 'list' and b.type = 'list' and size(list_items) > 0 and size(b.list_items) > 0"))
    a, b = F.col("list_items"), F.col("b.list_items")
    seam = F.concat(
        F.slice(a, F.lit(1), F.size(a) - 1), F.array(t.join_text(F.element_at(a, -1), F.element_at(b, 1))), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))
    )
    joined = F.when(F.coalesce("join_seam", F.lit(False)), seam).otherwise(F.concat(a, b))
    return _merged(items, d, rows, {"list_items": joined, "bbox": t.union_bbox(F.col("bbox"), F.col("b.bbox"))}, _none(items))


def merge_table(items: DataFrame, decisions: DataFrame) -> Applied:
    """Put a table's rows behind the last row of the one before; a first row equal to the other's first is dropped, unless it is all there is."""
    d, rows = _pairs(items, decisions)
    ra, rb = t.table_rows(F.col("table_body")), t.table_rows(F.col("b.table_body"))
    rows = rows.where("type = 'table' and b.type = 'table'").withColumns({"ra": ra, "rb": rb}).where("size(ra) > 0 and size(rb) > 0")
    rows = rows.withColumn("dup", F.col("ra")[0] == F.col("rb")[0]).where("not dup or size(rb) > 1")
    rows = unchained(rows)
    add = F.array_join(F.when(F.col("dup"), F.slice("rb", F.lit(2), F.size("rb") - 1)).otherwise(F.col("rb")), "")
    # behind the last end of a row: everything up to it is greedy
    head = F.regexp_extract("table_body", r"(?is)\A[\s\S]*</tr>", 0)
    body = F.concat(head, add, F.substring(F.col("table_body"), F.length(head) + 1, F.length("table_body")))
    join = lambda c: F.when(F.col(c).isNull() & F.col(f"b.{c}").isNull(), F.col(c)).otherwise(
        F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"b.{c}"), F.array().cast("array<string>")))
    )
    changes = {"table_body": body, "table_caption": join("table_caption"), "table_footnote": join("table_footnote"), "bbox": t.union_bbox(F.col("bbox"), F.col("b.bbox"))}
    return _merged(items, d, rows, changes, _spans(rows.where("dup"), F.col("rb")[0], F.lit("mergeTable:dup_header")))


def _without_entry(caption: Column, index: Column) -> Column:
    return F.filter(caption, lambda x, i: i != index)


def extract_caption(items: DataFrame, decisions: DataFrame) -> Applied:
    """Make an entry of a table's caption a text of its own, ``before`` or ``after`` the table, with the table's page and box."""
    d = _one(decisions.select("doc_id", "ord", "caption_index", "position", "level"))
    named = d.select("doc_id", "ord", F.col("caption_index").alias("d_index"), F.col("position").alias("d_position"), F.col("level").alias("d_level"))
    entry = F.get("table_caption", F.col("d_index"))
    joined = items.join(named, ["doc_id", "ord"], "left").withColumn("entry", entry)
    ok = (F.col("type") == "table") & (t.non_ws_len(F.col("entry")) > 0) & F.col("d_position").isin("before", "after") & (F.col("d_level").isNull() | F.col("d_level").between(1, 6))
    joined = joined.withColumns({"ok": F.coalesce(ok, F.lit(False)), "place": F.lit(1)})
    hit = joined.where("ok")
    keep = {"doc_id", "ord", "page_idx", "bbox"}
    kinds = dict(items.dtypes)
    new = hit.select(
        *[F.col(c) if c in keep else {"type": F.lit("text"), "text": F.col("entry"), "text_level": F.col("d_level").cast("int")}.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in items.columns],
        F.when(F.col("d_position") == "before", 0).otherwise(2).alias("place"),
    )
    left = joined.withColumn("table_caption", F.when(F.col("ok"), _without_entry(F.col("table_caption"), F.col("d_index"))).otherwise(F.col("table_caption")))
    out = renumber(left.select(*items.columns, "place").unionByName(new), "ord", "place").select("doc_id", "ord", *_columns(items))
    return Applied(out, _none(items), _rejected(d, hit))


def drop_caption(items: DataFrame, decisions: DataFrame, allowed: DataFrame) -> Applied:
    """Remove a caption entry of a table that is ``allowed`` (suspects of caption artifacts)."""
    keys = decisions.select("doc_id", "ord", "caption_index").join(allowed.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi")
    index = F.col("d_caption_index")
    ok = (F.col("type") == "table") & (index >= 0) & (index < F.size("table_caption"))
    done = _rewrite(items, keys, ok, {"table_caption": _without_entry(F.col("table_caption"), index)}, F.get("table_caption", index), F.lit("dropCaption:page_artifact"))
    return done._replace(rejected=_rejected(decisions, _rejected(decisions, done.rejected).join(keys, ["doc_id", "ord"], "left_semi")))
