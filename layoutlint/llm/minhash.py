"""Near-duplicate groups: MinHash with tensored banding, and links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layoutlint.llm.common import fresh, materialize
from layoutlint.llm.components import components
from layoutlint.llm.vec import mix, shingle_sets

#: Hashes in a half key, and half keys on each side. A table joins one left and one right half, so there
#: are HALVES**2 tables of 2 * HALF_SIZE hashes each from only 2 * HALVES * HALF_SIZE minhashes. Texts of similarity s
#: share a table with probability (1 - (1 - s**HALF_SIZE)**HALVES)**2: 0.99998 at 0.8, above 0.9999999 at 0.9.
HALF_SIZE = 3
HALVES = 16


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def half_keys(values: np.ndarray, counts: np.ndarray, half_size: int, halves: int) -> np.ndarray:
    """For each row with shingles its ``2 * halves`` keys; even keys are of the left side, odd ones of the right."""
    counts = counts[counts > 0]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out = np.zeros((len(counts), 2 * halves), np.uint64)
    if not len(counts):
        return out.view(np.int64)
    factors = _multipliers(2 * halves * half_size)
    for k in range(2 * halves):
        for q in range(half_size):
            low = np.minimum.reduceat(values * factors[k * half_size + q], first)
            out[:, k] = mix(out[:, k] * np.uint64(31) + low + np.uint64(k))
        out[:, k] = (out[:, k] << np.uint64(1)) | np.uint64(k % 2)
    return out.view(np.int64)


def _signer(k: int, half_size: int, halves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, counts in shingle_sets(batch.column("text"), k):
                rows = batch.slice(i, len(counts))
                keys = half_keys(values, counts, half_size, halves)
                full = np.flatnonzero(counts)
                ends = np.cumsum(counts)
                node: list[bytes | None] = [None] * len(counts)
                for r in full:
                    node[r] = hashlib.blake2b(values[ends[r] - counts[r] : ends[r]].tobytes(), digest_size=16).digest()
                places = np.zeros(len(counts) + 1, np.int32)
                places[1:] = np.cumsum((counts > 0) * (2 * halves))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("th"), pa.array(node, pa.binary()), pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(keys.ravel())),
                    ],
                    ["id", "th", "node", "n", "keys"],
                )

    return run


def _set_writer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, counts in shingle_sets(batch.column("text"), k):
                places = np.zeros(len(counts) + 1, np.int32)
                places[1:] = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, len(counts)), pa.array(counts), pa.ListArray.from_arrays(pa.array(places), pa.array(values.view(np.int64)))],
                    ["node", "n", "shingles"],
                )

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    percent: int = 80,
    half_size: int = HALF_SIZE,
    halves: int = HALVES,
) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    A document's set has the distinct runs of ``words`` consecutive words (between ASCII blanks, A-Z lower-cased) of its whole text, or its
    whole word sequence if that is shorter. Two documents are linked if ``100 * |intersection| >=
    percent * |union|``; ``component_id`` is the least id of a document's component, and ``kept`` tells
    whether it is that one.

    1. Each set gives a 128-bit node, so equal sets are one node whatever their number, and its half keys.
    2. Half keys that only one node has go. The others are combined, left with right, into table keys.
       Of tables with the same nodes one is enough.
    3. Nodes that cannot have a link go: of a node with ``n`` shingles, ``c`` of which another candidate has,
       a link needs ``100 * c >= percent * n``, and one with a node of ``m`` shingles needs
       ``(100 + percent) * c >= percent * (n + m)``. This is exact and takes the place of comparing all of a group.
    4. In each table all nodes are compared with its hub, the one that has the largest share of common shingles, and those outside of the
       hub's component with the best among them.
    5. Where a table still holds several components, :func:`_left_over` finds the pairs that can have a link.

    So no pair within a component is needed, and no link that a table shows is lost. Shingles are compared by
    64-bit hashes. Nulls in the text and texts without words have no set and no link: their component is their own id. Null ids are
    larger than all others; rows that share an id share its fate: ``kept`` holds for each of them that
    has the component's id. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    share = percent
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = materialize(
        rows.mapInArrow(_signer(words, half_size, halves), f"id {id_type}, th long, node binary, n long, keys array<long>"), "signatures"
    )
    nodes = materialize(
        signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min_by(F.struct("id", "th"), "th").alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "nodes",
    )
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    halves_of = exploded.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"))
    tables = (
        halves_of.select("node", F.explode(F.filter("keys", lambda x: F.pmod(x, F.lit(2)) == 0)).alias("l"), "keys")
        .select("node", "l", F.explode(F.filter("keys", lambda x: F.pmod(x, F.lit(2)) == 1)).alias("r"))
        .select("node", F.xxhash64("l", "r").alias("tkey"))
    )
    tables = materialize(tables, "tables")
    groups = tables.groupBy("tkey").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x")).where("c > 1")
    groups = groups.groupBy("c", "x").agg(F.min("tkey").alias("tkey")).select("tkey")
    member = materialize(tables.join(groups, "tkey"), "members")

    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "at.id", "at.th")
    texts = rows.alias("d").join(wanted.alias("w"), F.expr("d.th = w.th and d.id <=> w.id")).select("w.node", "d.text")
    sets = materialize(texts.mapInArrow(_set_writer(words), "node binary, n long, shingles array<long>"), "sets")
    # the nodes' own shingles; a node is told by two longs here, which aggregate without objects
    parts = sets.select(F.explode("shingles").alias("s"), F.xxhash64("node").alias("a"), F.xxhash64(F.lit(1), "node").alias("b"))
    own = (
        parts.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.max("a").alias("a"), F.max("b").alias("b"))
        .where("c = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("own"))
    )
    sizes = sets.groupBy("node").agg(F.first("n").alias("n")).withColumns({"a": F.xxhash64("node"), "b": F.xxhash64(F.lit(1), "node")})
    sizes = sizes.join(own, ["a", "b"], "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    sizes = sizes.where(f"100 * c >= {share} * n")
    member = member.join(sizes, "node")
    hubs = member.groupBy("tkey").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("s"), "node")).alias("hub")).select("tkey", F.col("hub.node").alias("hub"))
    member = materialize(member.join(hubs, "tkey"), "members")
    near_hub = materialize(_common(member.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), sets), "stars")
    links = materialize(_similar(near_hub, share), "links")
    label = components(links)
    # the nodes outside of the hub's component try one of their own
    outside = _placed(member, label).where("root <> main")
    second = outside.groupBy("tkey").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("s"), "node", "n", "c", "root")).alias("h"))
    second = outside.join(second, "tkey").where("root <> h.root" + _fits("", "h.", share)).select(F.col("node").alias("u"), F.col("h.node").alias("v")).distinct()
    more = materialize(_similar(_common(second, sets), share), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        label = components(links)
    more = materialize(_similar(_common(_left_over(_placed(member, label), near_hub, sets, share), sets), share), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    by_node = nodes.select("node", "least").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_node.groupBy("root").agg(F.min("least").alias("component"))
    by_node = materialize(by_node.join(least, "root").select("node", "component"), "components")
    of_row = signed.select("id", "th", "node", "n").distinct().join(by_node, "node", "left")
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("n_shingles", "component_id", "kept")])
    rid, rth, n, node, comp = fresh(out, "row_id", "row_th", "row_n", "row_node", "row_component")
    found = of_row.select(F.col("id").alias(rid), F.col("th").alias(rth), F.col("n").alias(n), F.col("node").alias(node), F.col("component").alias(comp))
    component = F.when(F.col(node).isNull(), F.col(id_col)).otherwise(F.col(comp))
    return (
        out.join(found, F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64(text_col) == F.col(rth)))
        .select(*[out[c] for c in out.columns], F.col(n).alias("n_shingles"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))
    )


def _placed(member: DataFrame, label: DataFrame) -> DataFrame:
    """Members of tables that hold several components, with their root and the root of the table's hub."""
    rows = member.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hub = rows.where("node = hub").select("tkey", F.col("root").alias("main"))
    open_tables = rows.groupBy("tkey").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tkey")
    return materialize(rows.join(hub, "tkey").join(open_tables, "tkey", "left_semi"), "open")


def _left_over(rows: DataFrame, near_hub: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs of different components that can still be linked, exactly and without those of a whole group.

    With ``a`` and ``b`` shingles in common with the hub, two nodes share at most ``min(a, b)`` of the hub's and, besides, what they
    share of others. So either ``min(a, b)`` alone is enough for a link, which is rare since one of the two is not linked to the hub,
    or they have a shingle in common that the hub has not, and an equi-join finds them on those of :func:`_prefixes`.
    """
    to_hub = near_hub.select(F.col("u").alias("node"), F.col("v").alias("hub"), "i")
    rows = rows.join(to_hub, ["node", "hub"], "left").withColumn("a", F.coalesce("i", "n")).drop("i")
    rows = materialize(rows, "open")
    sized = f"x.root <> y.root and x.node < y.node{_fits('x.', 'y.', share)}"
    enough = f"{100 + share} * least(x.a, y.a) >= {share} * (x.n + y.n)"
    close = rows.alias("x").join(rows.alias("y"), F.expr(f"x.tkey = y.tkey and {sized} and {enough}")).selectExpr("x.node as u", "y.node as v")
    at_hub = rows.select("hub", "node", "n", "c", "root", "a").distinct()
    own = at_hub.join(sets.select("node", "shingles"), "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hs")), "hub")
    own = own.select("hub", "node", "n", "c", "root", "a", F.explode(F.array_except("shingles", "hs")).alias("s"))
    own = materialize(own.join(own.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), ["hub", "s"]), "rare")
    own = _prefixes(own, at_hub.groupBy("hub").agg(F.min("n").alias("lo")), share)
    # at the first shingle in common, each has at most those from there on in common with the other
    at_most = f"{100 + share} * (least(x.a, y.a) + least(x.r - x.p, y.r - y.p) + 1) >= {share} * (x.n + y.n)"
    both = own.alias("x").join(own.alias("y"), F.expr(f"x.hub = y.hub and x.s = y.s and {sized} and {at_most}")).selectExpr("x.node as u", "y.node as v")
    return close.unionByName(both).distinct()


def _prefixes(own: DataFrame, least: DataFrame, share: int) -> DataFrame:
    """Of each node's ``r`` shingles ``s`` that its hub has not, those, by their place ``p``, of which a linked node has one, at least.

    A node with ``n`` shingles, of which the hub has ``a``, needs ``q`` of the others in common even with the smallest partner. Ordered
    by the number ``k`` of nodes that have them, rarest first, and then by value, the first that two linked nodes share is followed by
    ``q - 1`` others in both. So the last ``q - 1`` of a node can go, and these are the frequent ones, which many nodes would meet at.
    """
    rarest = Window.partitionBy("hub", "node").orderBy("k", "s")
    own = own.withColumns({"p": F.row_number().over(rarest).cast("long"), "r": F.count(F.lit(1)).over(Window.partitionBy("hub", "node"))})
    partner = f"greatest(lo, (n * {share} + 99) div 100)"
    q = F.expr(f"greatest(1L, (({share} * (n + {partner}) + {99 + share}) div {100 + share}) - a)")
    return own.join(least, "hub").where(F.col("p") + q <= F.col("r") + 1).drop("lo", "k")


def _fits(x: str, y: str, share: int) -> str:
    """That two nodes' sizes and common shingles allow a link."""
    return (
        f" and 100 * least({x}n, {y}n) >= {share} * greatest({x}n, {y}n)"
        f" and {100 + share} * least({x}c, {y}c) >= {share} * ({x}n + {y}n)"
    )


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the sizes of their sets and of what these have in common."""
    u = sets.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("shingles").alias("us"))
    v = sets.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("shingles").alias("vs"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "un", "vn", F.size(F.array_intersect("us", "vs")).cast("long").alias("i"))


def _similar(pairs: DataFrame, share: int) -> DataFrame:
    return pairs.where(f"100 * i >= {share} * (un + vn - i)").select("u", "v")
