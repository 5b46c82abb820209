"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import fresh

#: Half rounds of the permutation; an even number.
ROUNDS = 8
#: Parts in which rows are numbered; a few thousand rows of counts are summed in one place.
NUMBER_PARTS = 4096


def row_numbers(df: DataFrame, keys: list[str], number: str, total: str, *, parts: int = NUMBER_PARTS) -> DataFrame:
    """``df`` with a gapless row number from 0 and the count of rows, the same at each run over the same rows.

    Rows go to parts by a hash of ``keys`` and are ordered there by that hash and by the keys. Offsets of the parts come from their
    counts, so nothing is sorted as a whole and no task sees more than a part. Rows equal in all keys
    are interchangeable.
    """
    h, part, offset, same = fresh(df, "key_hash", "number_part", "part_offset", "part_again")
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    spread = F.pmod(hashed, F.lit(parts)).cast("int")
    counts = df.select(spread.alias(same)).groupBy(same).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.selectExpr(same, f"sum(n) over (order by {same}) - n as {offset}", f"sum(n) over () as {total}")
    numbered = df.withColumns({h: hashed, part: spread})
    order = ", ".join([h, *[f"`{k}`" for k in keys]])
    numbered = numbered.withColumn(number, F.expr(f"row_number() over (partition by {part} order by {order})"))
    joined = numbered.join(offsets, F.col(part) == F.col(same))
    return joined.select(*df.columns, (F.col(number) - 1 + F.col(offset)).cast("long").alias(number), total)


def _sides(n: Column) -> tuple[Column, Column]:
    """``a * b >= n`` with ``a * b - n < a``, both about the square root of ``n``."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    return a, F.floor((n + a - 1) / a).cast("long")


def _once(x: Column, a: Column, b: Column, seed: int, forward: bool) -> Column:
    """One pass of the Feistel network over ``[0, a * b)``."""
    rounds = range(ROUNDS) if forward else range(ROUNDS - 1, -1, -1)
    start = F.struct((x % a).alias("u"), F.floor(x / a).cast("long").alias("v"), a.alias("m"), b.alias("k"))

    def step(s: Column, r: Column) -> Column:
        if forward:  # the left half takes in the right one, and they change places
            mixed = F.pmod(s["u"] + F.pmod(F.xxhash64(F.lit(seed), r, s["v"]), s["m"]), s["m"])
            return F.struct(s["v"].alias("u"), mixed.alias("v"), s["k"].alias("m"), s["m"].alias("k"))
        plain = F.pmod(s["v"] - F.pmod(F.xxhash64(F.lit(seed), r, s["u"]), s["k"]), s["k"])
        return F.struct(plain.alias("u"), s["u"].alias("v"), s["k"].alias("m"), s["m"].alias("k"))

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), start, step, lambda s: s["v"] * a + s["u"])


def permuted(x: Column, n: Column, seed: int, *, forward: bool = True) -> Column:
    """A permutation of ``[0, n)`` at ``x``, or its inverse.

    The network permutes ``[0, a * b)``, which has fewer than ``a`` values beyond ``n``. Values that land
    there walk on along their cycle until they are back below ``n``; that takes at most as many steps as
    there are values beyond, which bounds the walk exactly. Fewer than ``a`` rows walk at all.
    """
    a, b = _sides(n)
    first = _once(x, a, b, seed, forward)
    walk = lambda y: F.aggregate(
        F.sequence(F.lit(1).cast("long"), a * b - n), y, lambda z, _: F.when(z < n, z).otherwise(_once(z, a, b, seed, forward))
    )
    return F.element_at(F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(walk(y))), 1)


def place(row: Column, n: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    p = permuted(row, n, seed)
    return (p % shards).cast("int"), F.floor(p / shards).cast("long")


def row_at(shard: Column, slot: Column, n: Column, shards: int, seed: int) -> Column:
    """The row number at a shard's slot."""
    return permuted(slot * shards + shard, n, seed, forward=False)


def shard(df: DataFrame, keys: list[str], shards: int, *, seed: int = 0, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with the shard and the slot of each row after a reproducible shuffle.

    The law is ``rows``: shards differ by one row at most, and slots have no gaps. A row's place follows from its number,
    the count of rows, the number of shards and the seed (:func:`place`), and back (:func:`row_at`).

    Keys may be null and may repeat; rows equal in all keys share their places in some order. Rows
    are moved once, by a hash, with the columns that are asked of the result. An empty table gives an empty result; columns named
    like the added ones are replaced, other names cannot clash.
    """
    base = df.drop(*[c for c in df.columns if c.lower() in (shard_col.lower(), slot_col.lower())])
    number, total, at = fresh(base, "row_number_", "row_total_", "place_")
    numbered = row_numbers(base, keys, number, total).withColumn(at, permuted(F.col(number), F.col(total), seed))
    return numbered.select(*base.columns, (F.col(at) % shards).cast("int").alias(shard_col), F.floor(F.col(at) / shards).cast("long").alias(slot_col))


def write_shards(df: DataFrame, path: str, *, shard_col: str = "shard", slot_col: str = "slot", rows_per_file: int = 100_000) -> None:
    """Write Parquet files under ``shard=k``, each a run of ``rows_per_file`` slots in order; no task holds a whole shard."""
    (chunk,) = fresh(df, "slot_chunk")
    total = df.count()
    chunked = df.withColumn(chunk, F.floor(F.col(slot_col) / rows_per_file))
    dealt = chunked.repartition(max(1, math.ceil(total / rows_per_file)), shard_col, chunk).sortWithinPartitions(shard_col, slot_col)
    dealt.drop(chunk).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)
