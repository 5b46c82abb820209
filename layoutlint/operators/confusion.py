"""Look-alike characters: candidates by class, by bigram frequency and by token votes, and the gates for their replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layoutlint.functions import text as t
from layoutlint.operators.garbled import HANZI
from layoutlint.operators.mechanical import CELL, build_row

# --- fixed values: classes of characters that are taken for one another ---
CLASSES = ("0O", "1lI|", "5S", "8B", "2Z", "6G", "9gq", "入人λ", "竟竞", "末未", "己已巳", "土士", "日曰", "戊戌戍", "扞杆", "亭亨", "校较", "酒源", "军率")
WHITELIST_COUNT, RIVAL_COUNT, RIVAL_FACTOR = 5, 3, 3
VOTE_COUNT, VOTE_FACTOR = 4, 3
ENTITY = r"&[^;&\s]{1,12};"
#: What counts as one character, and with any tags before it in a cell, whose offsets leave tags out.
UNIT = rf"(?s){ENTITY}|."
TAGS = "(?:<[^>]*>)*+"
CELL_UNIT = rf"(?s){TAGS}(?:&(?:{TAGS}[^;&\s]){{1,12}}{TAGS};|.)|<[^>]*>"


def pairs(spark: SparkSession, extra: list[str] = ()) -> DataFrame:
    """``before`` and ``after`` for all replacements that are allowed: within a class, and both ways for each extra pair."""
    for p in extra:
        if len(p) != 2 or p[0] == p[1]:
            raise ValueError(f"not a pair of different characters: {p!r}")
    found = {(a, b) for c in (*CLASSES, *extra) for a in c for b in c if a != b}
    return spark.createDataFrame(sorted(found), "before string, after string")


def units(items: DataFrame) -> DataFrame:
    """The texts that may hold misread characters, each with its place: text, list entries, captions and cells."""
    one = items.select("doc_id", "ord", F.lit("text").alias("field"), F.lit(0).alias("part"), F.col("text").alias("s")).where("s is not null")
    many = [items.select("doc_id", "ord", F.lit(c).alias("field"), F.posexplode(c).alias("part", "s")) for c in ("list_items", "table_caption")]
    cells = F.transform(F.regexp_extract_all("table_body", F.lit(CELL), F.lit(2)), lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    table = items.where("table_body is not null").select("doc_id", "ord", F.lit("table_body").alias("field"), F.posexplode(cells).alias("part", "s"))
    return one.unionByName(many[0]).unionByName(many[1]).unionByName(table)


def characters(u: DataFrame) -> DataFrame:
    """Each character with its offset and its neighbours where these are ideographs; characters of entities are marked."""
    hidden = F.regexp_replace("s", ENTITY, "\x01")
    masked = F.when(F.contains("s", F.lit("&")), hidden).otherwise(F.col("s"))
    rows = u.select("doc_id", "ord", "field", "part", F.split(masked, "").alias("cs"))
    ideograph = lambda c: F.when(c.rlike(HANZI), c)
    each = F.transform("cs", lambda c, i: F.struct(i.alias("offset"), c.alias("ch"), ideograph(F.get("cs", i - 1)).alias("prev"), ideograph(F.get("cs", i + 1)).alias("next")))
    return rows.select("doc_id", "ord", "field", "part", F.inline(each))


def bigrams(chars: DataFrame) -> DataFrame:
    """Counts of pairs of neighbouring ideographs by document."""
    both = chars.where(F.col("ch").rlike(HANZI) & F.col("next").isNotNull()).select("doc_id", F.concat("ch", "next").alias("bigram"))
    return both.groupBy("doc_id", "bigram").agg(F.count(F.lit(1)).alias("n"))


def candidates(items: DataFrame, allowed: DataFrame, *, rivals_only: bool = False) -> DataFrame:
    """Characters with look-alikes that the document's own bigrams do not confirm, with the rival that they speak for.

    A character is confirmed if a bigram of its has ``WHITELIST_COUNT`` occurrences and no look-alike occurs beside the same neighbours. A rival
    has ``RIVAL_COUNT`` occurrences and ``RIVAL_FACTOR`` times those of the character itself; the side before comes first.

    With ``rivals_only`` the rows without a rival are left out. A rival and a bigram need an ideograph beside the character, so that only
    characters that have one are looked at, and texts without any are not cut up.
    """
    texts = units(items)
    chars = characters(texts.where(F.col("s").rlike(HANZI))).where("prev is not null or next is not null") if rivals_only else characters(texts)
    grams = bigrams(chars)
    place = ["doc_id", "ord", "field", "part", "offset"]
    near = chars.join(F.broadcast(allowed.select(F.col("before").alias("ch")).distinct()), "ch")
    count = lambda df, key, name: df.join(grams.select("doc_id", F.col("bigram").alias(key), F.col("n").alias(name)), ["doc_id", key], "left").fillna(0, [name])
    own = near.withColumns({"l": F.concat("prev", "ch"), "r": F.concat("ch", "next")})
    own = count(count(own, "l", "own_l"), "r", "own_r").drop("l", "r")
    alt = own.join(F.broadcast(allowed.select(F.col("before").alias("ch"), "after")), "ch").withColumns({"l": F.concat("prev", "after"), "r": F.concat("after", "next")})
    alt = count(count(alt, "l", "alt_l"), "r", "alt_r")
    rival = lambda side: (F.col(f"alt_{side}") >= RIVAL_COUNT) & (F.col(f"alt_{side}") >= RIVAL_FACTOR * F.greatest(f"own_{side}", F.lit(1)))
    best = F.min(F.when(rival("l"), F.struct(F.lit(0).alias("side"), "after")).when(rival("r"), F.struct(F.lit(1).alias("side"), "after")))
    seen = F.max(F.greatest("alt_l", "alt_r"))
    found = alt.groupBy(*place, "ch", "own_l", "own_r").agg(seen.alias("seen"), best.alias("best"), F.array_join(F.array_sort(F.collect_set("after")), "").alias("alternatives"))
    confirmed = (F.greatest("own_l", "own_r") >= WHITELIST_COUNT) & (F.col("seen") == 0)
    found = found.where(~confirmed).select(*place, "ch", "alternatives", F.col("best.after").alias("rival"))
    return found.where("rival is not null") if rivals_only else found


def latin_tokens(s: Column) -> Column:
    """Runs of four or more Latin letters and digits with at most one digit."""
    runs = F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.filter(runs, lambda r: (F.length(r) >= 4) & (F.length(F.regexp_replace(r, "[0-9]", "")) >= F.length(r) - 1))


def token_votes(items: DataFrame) -> DataFrame:
    """Rare tokens that differ from a frequent one in one character or in two neighbours that changed places.

    Joined on keys that such pairs share: the token with one character masked, and the sorted characters.
    """
    tokens = units(items).select("doc_id", F.explode(latin_tokens(F.col("s"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    chars = F.split("token", "")
    masks = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.lit("?"), F.substring(F.col("token"), i + 1, F.length("token"))))
    keyed = tokens.withColumn("key", F.explode(F.concat(masks, F.array(F.concat(F.lit("="), F.array_join(F.array_sort(chars), ""))))))
    u = keyed.where(F.col("n") >= VOTE_COUNT).select("doc_id", "key", F.col("token").alias("fixed"), F.col("n").alias("m"))
    differing = F.filter(F.transform(F.split("fixed", ""), lambda c, i: F.when(c != F.get(F.split("token", ""), i), i)), lambda i: i.isNotNull())
    both = keyed.join(u, ["doc_id", "key"]).where("token <> fixed").where((F.length("token") == F.length("fixed")) & (F.col("m") >= VOTE_FACTOR * F.col("n"))).withColumn("at", differing)
    swapped = (F.size("at") == 2) & (F.get("at", F.lit(1)) == F.get("at", F.lit(0)) + 1) & F.col("key").startswith("=")
    fine = both.where((F.size("at") == 1) | swapped).select("doc_id", "token", "fixed", "n", "m").distinct()
    w = Window.partitionBy("doc_id", "token").orderBy(F.col("m").desc(), "fixed")
    return fine.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def density_gate(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """Proposals (``doc_id, ord, field, part, offset, after``) with ``ok``: too many for a unit, or for a table, and all of them fall.

    A unit takes two, or 3 % of its characters if that is more, and a table four, or 2 %.
    """
    items = items.join(proposals.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi")
    size = units(items).withColumn("size", t.non_ws_len(F.col("s"))).select("doc_id", "ord", "field", "part", "size")
    unit = proposals.groupBy("doc_id", "ord", "field", "part").agg(F.count(F.lit(1)).alias("n")).join(size, ["doc_id", "ord", "field", "part"])
    unit = unit.select("doc_id", "ord", "field", "part", (F.col("n") <= F.greatest(F.lit(2), F.floor(F.col("size") * 3 / 100))).alias("unit_ok"))
    rest = proposals.join(unit, ["doc_id", "ord", "field", "part"], "left").withColumn("unit_ok", F.coalesce("unit_ok", F.lit(False)))
    whole = size.where("field = 'table_body'").groupBy("doc_id", "ord").agg(F.sum("size").alias("size"))
    table = rest.where("field = 'table_body' and unit_ok").groupBy("doc_id", "ord").agg(F.count(F.lit(1)).alias("n")).join(whole, ["doc_id", "ord"])
    table = table.select("doc_id", "ord", F.lit("table_body").alias("field"), (F.col("n") <= F.greatest(F.lit(4), F.floor(F.col("size") * 2 / 100))).alias("table_ok"))
    return rest.join(table, ["doc_id", "ord", "field"], "left").select(*proposals.columns, (F.col("unit_ok") & F.coalesce("table_ok", F.lit(True))).alias("ok"))


def apply_texts(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """Items with the characters at the fixes' places replaced, in all fields of :func:`units`; tags and all other characters stay."""
    fields = ("text", "list_items", "table_caption", "table_body")
    place = F.struct(F.concat_ws(":", F.col("part").cast("int"), F.col("offset").cast("int")), "after")
    maps = fixes.groupBy("doc_id", "ord").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("field") == c, place))).alias(f"__{c}") for c in fields])

    def put(field: str, s: Column, part: Column, unit: str = UNIT) -> Column:
        def one(c: Column, i: Column) -> Column:
            after = F.try_element_at(F.col(f"__{field}"), F.concat_ws(":", part, i))
            tags = F.regexp_extract(c, f"^{TAGS}", 0) if unit == CELL_UNIT else F.lit("")
            return F.coalesce(F.concat(tags, after), c)

        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(unit), F.lit(0)), one), "")

    many = lambda c: F.transform(c, lambda s, k: put(c, s, k))
    group = lambda k: F.regexp_extract_all("table_body", F.lit(CELL), F.lit(k))
    cells = F.transform(group(2), lambda s, k: put("table_body", s, k, CELL_UNIT))
    body = build_row(F.struct(F.split("table_body", CELL).alias("between"), group(1).alias("open"), cells.alias("cells"), group(3).alias("close")))
    new = {"text": put("text", F.col("text"), F.lit(0)), "list_items": many("list_items"), "table_caption": many("table_caption"), "table_body": body}
    out = items.join(maps, ["doc_id", "ord"], "left")
    return out.withColumns({c: F.when(F.size(f"__{c}") > 0, new[c]).otherwise(F.col(c)) for c in fields}).select(items.columns)
