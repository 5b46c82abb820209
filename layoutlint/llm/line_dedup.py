"""Corpus-wide removal of repeated lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import fresh, materialize

#: Characters stripped at both ends of a line: space and the control blanks 09-0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A line is heavy from this many holders on, or from the share of all holders that leaves at most so many heavy lines; its holders go to so many places.
HEAVY_HOLDERS, HEAVY_LINES, SALTS = 10_000, 10_000, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() touches only A-Z where every character is a single byte
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Drop lines that ``min_docs`` or more documents share, except in the largest document id that holds them.

    Lines are split at ``\\n``; a line's key is :func:`line_key`; only keys of at least ``min_chars``
    code points can repeat. Returns the input columns with the kept text, plus ``n_lines``, ``n_dropped``
    and ``changed``. Lines that stay keep their order and are joined by ``\\n``.

    Keys are compared by 128 bits of two independent hashes, so lines of any length shuffle as 16 bytes.
    Each document counts a key once, before the shuffle, and counts are summed per task first, so a
    line that a third of all rows hold is no heavier to count than another. Where the holders of a line are joined with its count, those of the
    most common lines, which are a few by count, are dealt to ``SALTS`` places.

    Null or empty text is one empty line, which is never dropped; null stays null. Rows that share an id are counted as separate documents and the
    line stays in all of them if theirs is the largest id. A null id is smaller than any other. If all ids
    that hold a line are null, it stays in them. An empty table gives an empty result. Extra columns
    pass through, but for columns named like the added ones, which are replaced; helper columns take names that the input does not use.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "changed")])
    drop, lines, left, loser = fresh(docs, "drop_hashes", "all_lines", "left_lines", "loser_id")
    of_lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    long_keys = F.array_distinct(
        F.transform(F.filter(F.transform(of_lines, line_key), lambda k: F.length(k) >= min_chars), _key_hash)
    )
    held = docs.select(F.col(id_col).alias("id"), F.explode(long_keys).alias("key")).select("id", "key.a", "key.b")
    repeated = held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where(F.col("n") >= min_docs)
    repeated = materialize(repeated, "repeated")
    # lines with this many holders are at most HEAVY_LINES, so that a list of them is small
    bound = max(HEAVY_HOLDERS, (repeated.agg(F.sum("n")).first()[0] or 0) // HEAVY_LINES + 1)
    heavy = repeated.where(F.col("n") >= bound).select("a", "b", F.lit(SALTS).alias("salts"))
    salted = lambda rows, salt: rows.join(F.broadcast(heavy), ["a", "b"], "left").withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(salt))
    places = repeated.join(F.broadcast(heavy), ["a", "b"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    # per document the hashes it must drop: those whose largest holder is another document
    losing = (
        salted(held, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).drop("salts")
        .join(places.drop("salts"), ["a", "b", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("top")))
        .groupBy(F.col("id").alias(loser))
        .agg(F.collect_set(F.struct("a", "b")).alias(drop))
    )
    split = docs.join(losing, F.col(id_col).eqNullSafe(F.col(loser)), "left").withColumn(lines, of_lines)
    kept = F.when(F.col(drop).isNull(), F.col(lines)).otherwise(
        F.filter(
            lines,
            lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col(drop), _key_hash(line_key(x))),
        )
    )
    split = split.withColumn(left, kept)
    return split.select(
        *[F.when(F.size(left) < F.size(lines), F.concat_ws("\n", left)).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(left)).cast("long").alias("n_dropped"),
        F.col(drop).isNotNull().alias("changed"),
    )
