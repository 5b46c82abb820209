"""Quotation linking: who replies to whom by what is quoted, and messages without their quotes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import fresh, materialize

#: Positions in a chunk of a conversation; no task needs more of one conversation at a time.
CHUNK = 1024
#: Shorter passages and lines ("Yes.", "Thank you!") only decide where a message quotes nothing longer that is known.
MIN_CHARS = 16
#: One or more ``>``, each with blanks before it, and one blank after the last.
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: A line that introduces the quote below it.
ATTRIBUTION = r"(?i)^\s*(on\b.{0,200}\bwrote|.{1,100}\b(wrote|said|writes))\s*:\s*$"


def parse(text: Column) -> Column:
    """The lines of a text with their quote level and their content without the marks, all characters kept."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    marked = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, MARKS, 0).alias("m"), x.alias("x")))
    return F.transform(
        marked,
        lambda s: F.struct(
            (F.length(s["m"]) - F.length(F.replace(s["m"], F.lit(">"), F.lit("")))).cast("int").alias("level"),
            F.substring(s["x"], F.length(s["m"]) + 1, F.length(s["x"])).alias("line"),
        ),
    )


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; for comparison only."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def body(parsed: Column) -> Column:
    """The unquoted lines, without the lines that introduce a quote, and without blank lines at the ends."""
    own = F.filter(
        F.transform(
            parsed,
            lambda p, i: F.struct(
                ((p["level"] > 0) | (p["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(parsed, i + 1)["level"], F.lit(0)) > 0))).alias("out"),
                p["line"].alias("line"),
            ),
        ),
        lambda p: ~p["out"],
    )
    joined = F.array_join(F.transform(own, lambda p: p["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\A(?:[ \t\r]*\n)+", ""), r"\s+\z", "")


def units(parsed: Column, scope: list[str], min_chars: int) -> Column:
    """Level and two hashes of each passage and each line that is not blank, in normal form, and whether it has ``min_chars`` characters.

    A passage is a run of lines of the same level without a blank one between; so a quote that was wrapped anew is still the same passage.
    """
    # two control characters part the pieces here, and ends of lines may have a carriage return
    parsed = F.transform(parsed, lambda p: F.struct(p["level"].alias("level"), F.translate(p["line"], "\x01\x02\r", "  ").alias("line")))
    pieces = F.transform(
        parsed,
        lambda p, i: F.concat(
            F.when(
                (i > 0) & (F.get(parsed, i - 1)["level"] == p["level"]) & (F.trim(F.get(parsed, i - 1)["line"]) != "") & (F.trim(p["line"]) != ""),
                F.lit(" "),
            ).otherwise(F.concat(F.lit("\x01"), p["level"].cast("string"), F.lit("\x02"))),
            p["line"],
        ),
    )
    passages = F.transform(F.split(F.array_join(pieces, ""), "\x01"), lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("level"), normal(F.substring_index(x, "\x02", -1)).alias("t")))
    lines = F.transform(parsed, lambda p: F.struct(p["level"].cast("string").alias("level"), normal(p["line"]).alias("t")))
    filled = F.filter(F.concat(passages, lines), lambda u: u["t"] != "")
    keys = [F.col(c) for c in scope]
    hashed = F.transform(
        filled,
        lambda u: F.struct(
            u["level"].cast("int").alias("level"), F.xxhash64(*keys, u["t"]).alias("a"), F.xxhash64(F.lit(1), *keys, u["t"]).alias("b"),
            (F.length(u["t"]) >= min_chars).alias("long"),
        ),
    )
    return F.array_distinct(hashed)


def _latest_before(marks: DataFrame, by: list[str], pos: str, source: Column, name: str) -> DataFrame:
    """``marks`` with the largest ``pos`` of an earlier row of the same ``by`` where ``source`` holds.

    Within chunks of positions by a window, and across them by one over a row for each chunk.
    """
    chunked = marks.withColumn("__chunk", F.floor(F.col(pos) / CHUNK)).withColumn("__src", F.when(source, F.col(pos)))
    keys = ", ".join(by)
    inside = chunked.withColumn(
        "__in", F.expr(f"max(__src) over (partition by {keys}, __chunk order by {pos} range between unbounded preceding and 1 preceding)")
    )
    last = chunked.groupBy(*by, "__chunk").agg(F.max("__src").alias("__last"))
    last = last.withColumn("__before", F.expr(f"max(__last) over (partition by {keys} order by __chunk rows between unbounded preceding and 1 preceding)"))
    last = last.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__chunk").alias("__kc"), "__before")
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] + [F.col("__chunk") == F.col("__kc")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return inside.join(last, condition, "left").select(*marks.columns, F.coalesce("__in", "__before").alias(name))


def link_replies(
    messages: DataFrame, scope: str = "conv_id", pos: str = "turn", text_col: str = "text", *, min_chars: int = MIN_CHARS, follow: bool = True
) -> DataFrame:
    """For each message, known by ``scope`` and ``pos``: ``parent_pos``, ``by`` ('quote', 'order' or null), ``root_pos``, ``depth``, ``seq``,
    ``body``, ``quoted_lines``, ``quote_depth`` and ``linked`` (quoted units found in earlier messages).

    Nested quote levels are parsed line by line. Quoted passages and lines are hashed in normal form and joined
    to the latest earlier message of the same scope that has the same unit unquoted. The parent is the message
    with most of the units of level 1, the latest of equal ones; deeper levels quote the parent's own
    ancestors and only count as linked. Units of fewer than ``min_chars`` characters only decide where no longer one of the message is
    found at level 1. A message that quotes nothing known follows, with ``follow``, the message before it.
    ``root_pos`` is the first message of its tree, and ``seq`` numbers a tree's messages by position; parents are always
    earlier, so that is an order of replies. ``body`` has neither quotes nor the lines that introduce them, and is otherwise as it was written, but
    for blank lines at its start and white space at its end.

    Several messages at one position share everything but their body. Null scope is a scope; messages without a position
    keep their body, have no parent and are no parent. Null text has an empty body. Other columns pass through, but for those named like the
    added ones, which are replaced. An empty table gives an empty result. Trees are resolved by pointer
    doubling in joins; nothing is collected.
    """
    added = ("parent_pos", "by", "root_pos", "depth", "seq", "body", "quoted_lines", "quote_depth", "linked")
    rest = messages.drop(*[c for c in messages.columns if c.lower() in added])
    read = messages.select(F.col(scope).alias("s"), F.col(pos).cast("long").alias("p"), parse(F.col(text_col)).alias("lines"))
    unit = read.select("s", "p", F.explode(units(F.col("lines"), ["s"], min_chars)).alias("u")).select("s", "p", "u.*").where("p is not null")
    unit = materialize(unit, "units")
    quoted = unit.where("level > 0").distinct()
    own = unit.where("level = 0").select("s", "p", "a", "b").distinct().join(quoted.select("a", "b").distinct(), ["a", "b"], "left_semi")
    marks = own.withColumns({"level": F.lit(0), "long": F.lit(False)}).unionByName(quoted)
    found = _latest_before(marks, ["a", "b"], "p", F.col("level") == 0, "src").where("level > 0 and src is not null")
    votes = found.where("level = 1").groupBy("s", "p", "src").agg(F.count(F.when(F.col("long"), 1)).alias("n"), F.count(F.lit(1)).alias("short"))
    # where any source has longer units, those with none of them are out of question, and short units count for nothing
    votes = votes.withColumn("short", F.when(F.col("n") == 0, F.col("short")).otherwise(0))
    best = votes.groupBy("s", "p").agg(F.max(F.struct("n", "short", "src")).alias("v")).select("s", "p", F.col("v.src").alias("parent"))
    linked = found.select("s", "p", "level", "a", "b").distinct().groupBy("s", "p").agg(F.count(F.lit(1)).alias("linked"))

    nodes = read.where("p is not null").select("s", "p").distinct()
    if follow:
        nodes = _latest_before(nodes, ["s"], "p", F.lit(True), "prev")
    else:
        nodes = nodes.withColumn("prev", F.lit(None).cast("long"))
    same = lambda x, y: F.expr(f"{x}.s <=> {y}.s and {x}.p = {y}.p")
    nodes = nodes.alias("n").join(best.alias("b"), same("n", "b"), "left").join(linked.alias("l"), same("n", "l"), "left")
    nodes = materialize(
        nodes.select(
            "n.s", "n.p", F.coalesce("b.parent", "n.prev").alias("parent"),
            F.expr("case when b.parent is not null then 'quote' when n.prev is not null then 'order' end").alias("by"), F.coalesce("l.linked", F.lit(0).cast("long")).alias("linked"),
        ),
        "replies",
    )
    # pointers: at is an ancestor, steps the way to it, and done tells that it is the root
    first = nodes.where("parent is null").select("s", "p")
    jump = nodes.alias("n").join(first.alias("f"), F.expr("n.s <=> f.s and n.parent = f.p"), "left")
    jump = materialize(
        jump.selectExpr("n.s as s", "n.p as p", "coalesce(n.parent, n.p) as at", "if(n.parent is null, 0L, 1L) as steps", "n.parent is null or f.p is not null as done"), "pointers"
    )
    while not jump.where("not done").isEmpty():
        further = jump.where("not done").alias("x").join(jump.alias("y"), F.expr("x.s <=> y.s and x.at = y.p"))
        moved = further.selectExpr("x.s as s", "x.p as p", "y.at as at", "x.steps + y.steps as steps", "y.done as done")
        jump = materialize(jump.where("done").unionByName(moved), "pointers")
    chunked = jump.withColumn("c", F.floor(F.col("p") / CHUNK))
    offsets = chunked.groupBy("s", "at", "c").agg(F.count(F.lit(1)).alias("n")).selectExpr("s as os", "at as oat", "c as oc", f"sum(n) over (partition by s, at order by c) - n as before")
    ranked = chunked.withColumn("r", F.expr("row_number() over (partition by s, at, c order by p)"))
    ranked = ranked.join(offsets, F.expr("s <=> os and at = oat and c = oc")).selectExpr("s", "p", "at", "steps", "r - 1 + before as seq")
    lines, ts, tp = fresh(rest, "parsed_lines", "tree_scope", "tree_pos")
    found = fresh(rest, "tree_parent", "tree_by", "tree_linked", "tree_root", "tree_steps", "tree_seq")
    values = ("n.parent", "n.by", "n.linked", "r.at", "r.steps", "r.seq")
    tree = nodes.alias("n").join(ranked.alias("r"), same("n", "r"))
    tree = materialize(tree.selectExpr(f"n.s as {ts}", f"n.p as {tp}", *[f"{v} as {c}" for v, c in zip(values, found, strict=True)]), "trees")
    out = rest.withColumn(lines, parse(F.col(text_col))).join(tree, F.col(scope).eqNullSafe(F.col(ts)) & (F.col(pos).cast("long") == F.col(tp)), "left")
    parent, by, linked, root, steps, seq = (F.col(c) for c in found)
    levels = F.transform(lines, lambda x: x["level"])
    return out.select(
        *rest.columns, parent.alias("parent_pos"), by.alias("by"), root.alias("root_pos"), steps.alias("depth"), seq.alias("seq"), body(F.col(lines)).alias("body"),
        F.size(F.filter(levels, lambda x: x > 0)).cast("long").alias("quoted_lines"), F.array_max(levels).alias("quote_depth"), F.coalesce(linked, F.lit(0).cast("long")).alias("linked"),
    )
