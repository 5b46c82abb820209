"""Detectors: suspects of a document's blocks. One row per suspect, several per block at most one of each kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layoutlint import storage
from layoutlint.functions import numbering, text as t

#: All kinds in the order of their detection; the last has no repair.
KINDS = (
    "pseudo_heading", "cross_page_break", "giant_block", "page_artifact", "residual_markup", "missed_heading", "extra_char", "trailing_marker",
    "caption_heading", "caption_artifact", "separated_caption", "empty_table", "split_table", "split_list", "caption_issue",
)
COLUMNS = ("doc_id", "ord", "kind", "has_op", "next_ord", "value", "detail")


def features(items: DataFrame) -> DataFrame:
    """Items with what is told from each block alone and its neighbours or detectors ask for: its parsed number, whether it reads like a heading
    (``candidate``), goes on over a page (``opens``), can be gone on with (``follows``), or labels a table (``label``)."""
    s = F.col("text")
    base = items.withColumns({"husk": t.is_husk(F.col("type"), F.col("table_body"), F.col("img_path"), F.col("table_caption"), F.col("table_footnote"))})
    base = base.withColumn("num", F.when(F.col("type") == "text", numbering.parse(s)))
    base = base.withColumn("candidate", numbering.is_candidate(F.col("type"), s, F.col("text_level"), F.col("num")))
    return base.withColumns(
        {
            "opens": _text(plain=True) & ~t.sentence_end(s) & ~s.rlike(t.BULLET_START),
            "follows": _text(plain=True) & ~s.rlike(t.HEADING_START) & ~s.rlike(t.BULLET_START),
            "label": _text(plain=True) & t.caption_like(s),
        }
    )


def neighbours(base: DataFrame) -> DataFrame:
    """Blocks with their features and what stands next to them; one shuffle by document that all detectors share.

    ``n1`` and ``n2`` are the next two blocks that are not page furniture and ``p1`` the one before.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    content = ~t.is_furniture(F.coalesce(F.col("type"), F.lit("")))
    ahead = F.when(content, F.struct("ord", "type", "text_level", "page_idx", "husk", "num", "candidate", "follows"))
    # read backwards, the last value so far is that of the nearest content block behind; growing frames take one pass
    back = Window.partitionBy("doc_id").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("n1", F.last(ahead, ignorenulls=True).over(back))
    after = F.when(content, F.struct(F.col("n1").alias("x")))
    before = F.when(content, F.struct("ord", "type", "page_idx"))
    return base.withColumns(
        {
            "n2": F.last(after, ignorenulls=True).over(back)["x"],
            "p1": F.last(before, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )


def annotate(items: DataFrame) -> DataFrame:
    """Items with their features and neighbours."""
    return neighbours(features(items))


def slim(items: DataFrame, *more: str) -> DataFrame:
    """Blocks without their texts: features, the suspects that show in the block alone (``own``) and the short keys that detectors compare; and columns ``more``.

    Documents are long and few, so what is sorted by document should be narrow; texts are looked at once, wherever their block lies.
    """
    own = F.array_compact(F.array(*[rule() for rule in OWN_RULES]))
    table = F.col("type") == "table"
    rows = _keyed(features(items)).withColumns({"own": own, "columns": F.when(table, t.first_row_columns(F.col("table_body"))), "captions": F.when(table, F.col("table_caption"))})
    return rows.select("doc_id", "ord", *more, *SLIM).withColumnRenamed("captions", "table_caption")


def _keyed(items: DataFrame) -> DataFrame:
    """Blocks with ``short``, the trimmed text if it is short; ``bare``, the text without white space of furniture and texts that can be made of it; and whether they are
    page ``numbered``."""
    if "bare" in items.columns:
        return items
    s, kind, trimmed = F.col("text"), F.col("type"), t.trim(F.col("text"))
    # only short texts can be furniture or numbers
    bare = F.when((kind == "text") & t.at_most(s, t.LEAK_CHARS) | t.is_furniture(kind), t.non_ws(s))
    number = (kind == "text") & F.col("text_level").isNull() & (trimmed != "") & t.at_most(s, 10) & trimmed.rlike(t.PAGE_NUMBER)
    return items.withColumns({"short": F.when((kind == "text") & (trimmed != "") & t.at_most(trimmed, t.ARTIFACT_CHARS), trimmed), "bare": bare, "page_number": number})


def _found(kind: str, *, next_ord: Column | None = None, value: Column | None = None, detail: Column | None = None, has_op: bool = True) -> Column:
    null = lambda c, k: (F.lit(None) if c is None else c).cast(k)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(has_op).alias("has_op"), null(next_ord, "long").alias("next_ord"), null(value, "long").alias("value"), null(detail, "string").alias("detail")
    )


def _suspect(rows: DataFrame, kind: str, **what) -> DataFrame:
    return rows.select("doc_id", "ord", _found(kind, **what).alias("s")).select("doc_id", "ord", "s.*")


def _text(plain: bool = False) -> Column:
    """A text block that is not empty; with ``plain`` no heading."""
    some = (F.col("type") == "text") & (F.col("text") != "")
    return some & F.col("text_level").isNull() if plain else some


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def pseudo_heading() -> Column:
    """Headings that read like sentences."""
    s = F.col("text")
    long = t.non_ws_len(F.regexp_replace(s, t.LEADING_NUMBERING, "")) > t.HEADING_BODY_CHARS
    why = F.array_join(_reasons((s.rlike(t.COMMA_SEMI), "comma"), (t.sentence_end(s), "sentence_end"), (long, "long")), ",")
    return F.when(_text() & F.col("text_level").isNotNull() & (why != ""), _found("pseudo_heading", detail=why))


def cross_page_break() -> Column:
    """A plain text without a sentence end, continued by a plain text on the next page."""
    n = F.col("n1")
    return F.when(F.col("opens") & (n["page_idx"] == F.col("page_idx") + 1) & n["follows"], _found("cross_page_break", next_ord=n["ord"]))


def giant_block() -> Column:
    """Long texts with several numbered lines."""
    hits = F.regexp_count("text", F.lit(t.GIANT_HEADING_HIT))
    return F.when((F.col("type") == "text") & (F.length("text") > t.GIANT_CHARS) & (t.non_ws_len(F.col("text")) > t.GIANT_CHARS) & (hits >= 2), _found("giant_block", value=hits))


def repeated_texts(items: DataFrame) -> DataFrame:
    """Short texts on three or more pages of a document: ``doc_id``, ``key`` and ``pages``."""
    short = _keyed(items).where("short is not null").select("doc_id", F.col("short").alias("key"), "page_idx")
    return short.groupBy("doc_id", "key").agg(F.countDistinct("page_idx").alias("pages")).where(F.col("pages") >= t.ARTIFACT_PAGES)


def furniture_texts(items: DataFrame) -> DataFrame:
    """Texts, without white space, of two or more headers, footers or page numbers of a document: ``doc_id``, ``key``, ``n``."""
    keys = _keyed(items).where(t.is_furniture(F.col("type"))).select("doc_id", F.col("bare").alias("key")).where("key <> ''")
    return keys.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def _furniture_lists(items: DataFrame) -> DataFrame:
    """Each document's furniture texts, the longest first; equal lengths by text."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("l"), "key")))
    return furniture_texts(items).groupBy("doc_id").agg(F.transform(ranked, lambda x: x["key"]).alias("furniture"))


def page_artifact(a: DataFrame) -> DataFrame:
    """Texts that are page furniture: made of known furniture, repeated over pages, or bare page numbers. The first that holds counts."""
    rows = _keyed(a).where("type = 'text'").select("doc_id", "ord", F.col("short").alias("key"), "bare", "page_number")
    rows = rows.where("key is not null or bare <> '' or page_number")
    rows = rows.join(_furniture_lists(a), "doc_id", "left")
    left = F.aggregate(F.coalesce("furniture", F.array().cast("array<string>")), F.col("bare"), lambda s, f: F.replace(s, f, F.lit("")))
    leak = (F.col("bare") != "") & (left == "")
    rows = rows.select("doc_id", "ord", "key", "page_number", F.coalesce(leak, F.lit(False)).alias("leak")).where("leak or key is not null or page_number")
    rows = rows.join(repeated_texts(a).withColumnRenamed("pages", "seen"), ["doc_id", "key"], "left")
    rows = rows.withColumn("why", F.when(F.col("leak"), "furniture").when(F.col("seen").isNotNull(), "repeated").when(F.col("page_number"), "page_number"))
    return _suspect(rows.where("why is not null"), "page_artifact", value=F.when(F.col("why") == "repeated", F.col("seen")), detail=F.col("why"))


def residual_markup() -> Column:
    """Markdown links, LaTeX, escaped dollars and HTML tags in texts."""
    s = F.col("text")
    has = lambda c: F.contains(s, F.lit(c))
    latex = (has("$") | has("\\")) & s.rlike(t.LATEX)
    why = _reasons(
        (has("](") & s.rlike(t.MD_LINK), "md_link"), (latex, "latex"), (has("\\$") & ~latex, "escaped_dollar"), (has("<") & s.rlike(t.HTML_TAG), "html_tag")
    )
    why = F.array_join(why, ",")
    return F.when(_text() & (why != ""), _found("residual_markup", detail=why))


def _group(num: Column) -> list[Column]:
    """Style, depth and parent of a number: what siblings share."""
    path = num["path"]
    return [num["style"].alias("style"), F.size(path).alias("depth"), F.array_join(F.slice(path, 1, F.size(path) - 1), ".").alias("parent")]


def numbered(a: DataFrame) -> DataFrame:
    """All numbered texts with their group and last number."""
    return a.where("type = 'text' and num is not null").select(
        "doc_id", "ord", "text_level", "candidate", "num", "n1", *_group(F.col("num")), F.element_at(F.col("num.path"), -1).alias("last")
    )


def missed_heading(a: DataFrame) -> DataFrame:
    """Heading-like numbered texts next to a heading sibling, or in front of their own first child."""
    w = Window.partitionBy("doc_id", "style", "depth", "parent").orderBy("ord")
    near = F.struct("ord", "last", "text_level")
    rows = numbered(a).withColumns({"before": F.lag(near).over(w), "behind": F.lead(near).over(w)}).where("candidate")
    fits = lambda c, by: c["text_level"].isNotNull() & (c["last"] + F.lit(by) == F.col("last"))
    sibling = F.when(fits(F.col("before"), 1), F.col("before")).when(fits(F.col("behind"), -1), F.col("behind"))
    path, child = F.col("num.path"), F.col("n1.num.path")
    is_child = (F.col("n1.num.style") == F.col("style")) & (F.size(child) > F.size(path)) & (F.slice(child, F.lit(1), F.size(path)) == path)
    rows = rows.withColumns({"sibling": sibling, "child": F.coalesce(is_child, F.lit(False))}).where("sibling is not null or child")
    return _suspect(
        rows, "missed_heading", next_ord=F.coalesce("sibling.ord", "n1.ord"), value=F.col("sibling.text_level"),
        detail=F.when(F.col("sibling").isNotNull(), "sibling").otherwise("child"),
    )


def extra_char() -> Column:
    """Lone radicals and doubled function words; ``value`` is the first offset and ``detail`` has all."""
    # all of them are ideographs
    guard = F.col("text").rlike("[\u4e00-\u9fff]") & F.col("text").rlike(f"[{t.RADICALS}]|" + "|".join(c + c for c in t.DOUBLED))
    at = t.extra_chars(F.col("text"))
    return F.when(_text() & guard & (F.size(at) > 0), _found("extra_char", value=F.get(at, F.lit(0)), detail=F.array_join(at.cast("array<string>"), ",")))


def trailing_marker() -> Column:
    """A section marker stuck to the end of a text; ``value`` is where to split."""
    s = F.col("text")
    at = F.length(s) - F.length(F.regexp_extract(s, t.TRAILING_MARKER, 0))
    head = t.non_ws_len(F.substring(s, F.lit(1), at)) >= t.MARKER_HEAD_CHARS
    return F.when(_text(plain=True) & t.last_char(s).isin("]", "】") & s.rlike(t.TRAILING_MARKER) & head, _found("trailing_marker", value=at))


def _captions(a: DataFrame) -> DataFrame:
    return a.where("type = 'table'").select("doc_id", "ord", F.posexplode("table_caption").alias("entry", "cap")).where("cap is not null")


def _first_entry(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "ord").orderBy("entry", "at")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")


def caption_heading(a: DataFrame) -> DataFrame:
    """Caption entries that are numbered headings: a heading has the number before or behind. The first entry of a table counts."""
    cap = F.col("cap")
    entries = _captions(a).withColumn("num", numbering.parse(cap)).where("num is not null")
    entries = entries.where(numbering.surface(cap, t.non_ws_len(numbering.body(cap, F.col("num.end")))))
    entries = entries.select("doc_id", "ord", "entry", *_group(F.col("num")), F.element_at(F.col("num.path"), -1).alias("last"))
    heads = numbered(a).where("text_level is not null").select("doc_id", "style", "depth", "parent", F.col("last").alias("hlast"), F.col("ord").alias("at"), "text_level")
    # a heading is the neighbour of the numbers one below and one above: an equi-join with those two
    heads = heads.withColumn("last", F.explode(F.array(F.col("hlast") - 1, F.col("hlast") + 1)))
    rows = _first_entry(entries.join(heads, ["doc_id", "style", "depth", "parent", "last"]))
    return _suspect(rows, "caption_heading", next_ord=F.col("at"), value=F.col("entry"), detail=F.col("text_level").cast("string"))


def caption_artifact(a: DataFrame) -> DataFrame:
    """Caption entries that are page furniture or a repeated text. The first entry of a table counts."""
    entries = _captions(a).withColumns({"bare": t.non_ws(F.col("cap")), "key": t.trim(F.col("cap"))}).where("bare <> ''")
    known = furniture_texts(a).select("doc_id", F.col("key").alias("bare"), "n")
    rows = entries.join(known, ["doc_id", "bare"], "left").join(repeated_texts(a), ["doc_id", "key"], "left")
    rows = _first_entry(rows.where("n is not null or pages is not null").withColumn("at", F.lit(0)))
    return _suspect(rows, "caption_artifact", value=F.col("entry"), detail=F.when(F.col("n").isNotNull(), "furniture").otherwise("repeated"))


def separated_caption() -> Column:
    """A caption-like text that a heading parts from its table."""
    h, b = F.col("n1"), F.col("n2")
    behind = (h["type"] == "text") & (h["text_level"].isNotNull() | h["candidate"]) & (b["type"] == "table") & ~b["husk"]
    return F.when(F.col("label") & behind, _found("separated_caption", next_ord=h["ord"], value=b["ord"]))


def empty_table() -> Column:
    return F.when(F.col("husk"), _found("empty_table", next_ord=F.col("p1.ord"), detail=F.col("p1.type")))


def split_table(columns: Column | None = None) -> Column:
    """Two tables with content on different pages and only furniture between."""
    n = F.col("n1")
    columns = t.first_row_columns(F.col("table_body")) if columns is None else columns
    ok = (F.col("type") == "table") & ~F.col("husk") & (n["type"] == "table") & (n["page_idx"] > F.col("page_idx")) & ~n["husk"]
    return F.when(ok, _found("split_table", next_ord=n["ord"], value=columns))


def split_list() -> Column:
    n = F.col("n1")
    return F.when((F.col("type") == "list") & (n["type"] == "list") & (n["page_idx"] > F.col("page_idx")), _found("split_list", next_ord=n["ord"]))


def caption_issue() -> Column:
    """Tables and images without a caption; nothing repairs them."""
    caption = F.when(F.col("type") == "table", F.col("table_caption")).otherwise(F.col("image_caption"))
    return F.when(F.col("type").isin("table", "image") & t.blank_all(caption), _found("caption_issue", has_op=False))


#: Kinds that show in a block, kinds that show in its features and those of its neighbours, and kinds that need counts or joins over the document.
OWN_RULES = (pseudo_heading, giant_block, residual_markup, extra_char, trailing_marker, caption_issue)
NEAR_RULES = (cross_page_break, separated_caption, empty_table, split_table, split_list)
ROW_RULES = OWN_RULES + NEAR_RULES
JOINED = (page_artifact, missed_heading, caption_heading, caption_artifact)
#: Columns of :func:`slim`.
SLIM = ("type", "page_idx", "text_level", "husk", "num", "candidate", "opens", "follows", "label", "own", "short", "bare", "page_number", "columns", "captions")


def by_rules(a: DataFrame, rules) -> DataFrame:
    """All suspects of some row rules in one pass over the blocks."""
    hits = F.array_compact(F.array(*[rule() for rule in rules]))
    return a.select("doc_id", "ord", F.explode(hits).alias("s")).select("doc_id", "ord", "s.*")


DETECTORS = {rule.__name__: (lambda a, rule=rule: by_rules(a, [rule])) for rule in ROW_RULES} | {f.__name__: f for f in JOINED}


def near(a: DataFrame) -> DataFrame:
    """The suspects of all row rules in blocks of :func:`slim` with their neighbours."""
    found = [split_table(F.col("columns")) if rule is split_table else rule() for rule in NEAR_RULES]
    hits = F.concat("own", F.array_compact(F.array(*found)))
    return a.select("doc_id", "ord", F.explode(hits).alias("s")).select("doc_id", "ord", "s.*")


def detect(items: DataFrame, *, annotated: DataFrame | None = None) -> DataFrame:
    """The suspects of all kinds. ``items`` has the columns of a content list, keyed by ``doc_id`` and ``ord``; ``annotated``, the blocks of :func:`slim` with their
    neighbours, may be given instead."""
    # written once: the detectors that count or join would each work it out again from the source
    a = storage.saved(neighbours(slim(items)), dealt=True) if annotated is None else annotated
    return reduce(DataFrame.unionByName, [near(a), *[f(a) for f in JOINED]])


def suspects_by_kind(items: DataFrame) -> DataFrame:
    return detect(items).groupBy("kind", "has_op").agg(F.count(F.lit(1)).alias("n"))
