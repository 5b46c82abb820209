"""Document fingerprints by winnowing character k-grams, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutlint.llm.common import fresh, order_bounds, range_bucket

#: Characters in a gram, and grams in a window: any passage of GRAM + WINDOW - 1 characters that two texts share gives a common fingerprint.
GRAM = 6
WINDOW = 4
#: Text for a range of keys, about, and the most ranges, whose bounds are part of the plan.
RANGE_BYTES, MOST_RANGES = 64 << 20, 10_000
_POSITIONS = (1 << 31) - 1
_HASH_BITS = ((1 << 32) - 1) << 31
#: Grams of a stretch of text.
STRETCH = 32


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _grams(text: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` characters, 32 bits, each above its position counted down from the last possible one.

    The text is cut into stretches, each with ``k - 1`` characters of the next, and each run is taken out of its stretch and hashed: one
    step of a loop for a position, where the stretch bounds the way to it. A rolling hash would carry a value from step to step, which
    SQL functions cannot do while they fill an array.

    So the least of several is the one of the least hash and, among equal hashes, of the rightmost position.
    """
    places = F.array(*[F.lit(i) for i in range(1, STRETCH + 1)])

    def of(normal: Column) -> Column:
        # a text of fewer than k characters is one gram, also if it has none
        whole = F.array(_packed(F.xxhash64(normal), F.lit(_POSITIONS)))
        stretches = F.regexp_extract_all(normal, F.lit(rf"(?s)(?=(.{{{k},{STRETCH + k - 1}}})).{{1,{STRETCH}}}"), F.lit(1))

        def grams(s: Column, j: Column) -> Column:
            n = F.length(s) - (k - 1)
            some = F.when(n == STRETCH, places).otherwise(F.slice(places, 1, n))
            return _let(F.lit(_POSITIONS + 1) - j * STRETCH, lambda last: F.transform(some, lambda i: _packed(F.xxhash64(F.substring(s, i, F.lit(k))), last - i)))

        return F.when(F.length(normal) >= k, F.flatten(F.transform(stretches, grams))).otherwise(whole)

    return _let(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), of)


def _packed(value: Column, place: Column) -> Column:
    """32 bits of a hash above a place of 31 bits."""
    return value.bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR(place)


def _minima(grams: Column, w: int) -> Column:
    """The least value of each window of ``w`` grams; fewer grams are one window."""
    least = lambda v, i: F.least(v, *[F.get(grams, i + q) for q in range(1, w)]) if w > 1 else v
    return F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - (w - 1), F.lit(1))), least)


def selected(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The selected grams of a text, each once, in order of position; see :func:`hashes` and :func:`positions`."""
    # not within the loops, where it would be interpreted
    return F.array_distinct(_let(_grams(F.coalesce(text, F.lit("")), k), lambda g: _minima(g, w)))


def hashes(chosen: Column) -> Column:
    """Distinct 32-bit hashes of selected grams."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 31)))


def positions(chosen: Column) -> Column:
    """Positions of selected grams in the normalised text."""
    return F.transform(chosen, lambda v: (F.lit(_POSITIONS) - v.bitwiseAND(F.lit(_POSITIONS))).cast("int"))


def fingerprint_text(found: Column) -> Column:
    """Hexadecimal hashes, joined by commas."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of two fingerprints, from 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def fingerprints(docs: DataFrame, text_col: str = "text", *, k: int = GRAM, w: int = WINDOW, hashes_col: str = "fingerprint", positions_col: str = "positions") -> DataFrame:
    """``docs`` with the distinct hashes of the selected grams and the positions of all selected grams.

    Texts are lower-cased, with one blank for each run of white space and none at the ends; so text without blanks, in any script, is
    treated like other text. Each window of ``w`` successive grams of ``k`` characters selects its least hash, the rightmost of equal
    ones; so texts that share ``w + k - 1`` characters in a row share a hash. The fingerprint is never empty: a text of fewer than ``k``
    characters, none included, is one gram, and one of fewer than ``w + k`` keeps one hash. Null text counts as empty. Equal texts have
    equal fingerprints. Columns named like the added ones are replaced; an empty table gives an empty result; nothing shuffles.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in (hashes_col.lower(), positions_col.lower())])
    (chosen,) = fresh(base, "chosen_grams")
    out = base.withColumn(chosen, selected(F.col(text_col), k, w))
    return out.select(*base.columns, hashes(F.col(chosen)).alias(hashes_col), positions(F.col(chosen)).alias(positions_col))


def with_next(
    docs: DataFrame, key_col: str, columns: list[str], *, derive=None, parts: int | None = None, prefix: str = "next_"
) -> DataFrame:
    """``docs`` with the values of ``columns`` from the row of the next larger key; the last row has those of the first.

    ``derive`` adds columns to a frame, whose next values are given too; it is applied once to each row.

    Rows are dealt to ranges of keys, one for each ``RANGE_BYTES`` of their strings but at most ``MOST_RANGES``, and ordered there. The first row of each range is small and goes, as a
    sentinel, behind the last row of the range before. The key is a column of integers. Equal keys follow one another by a hash of the columns. Null keys come
    first. A table of one row is its own next, an empty one gives an empty result. Columns named like the added ones are replaced.
    """
    if not isinstance(docs.schema[key_col].dataType, T.IntegralType):
        raise TypeError(f"{key_col} must be a column of integers")
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {(prefix + x).lower() for x in columns}])
    if parts is None:
        strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns if isinstance(docs.schema[c].dataType, T.StringType)]
        total = docs.agg(F.sum(sum(strings, F.lit(8)))).first()[0] or 0
        parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-total // RANGE_BYTES)))
    part, end, tie, to, first, key, hashed = fresh(docs, "key_range", "is_sentinel", "tie_hash", "range_to", "range_first", "range_key", "range_hash")
    ranged = docs.withColumns(
        {part: range_bucket(F.col(key_col), order_bounds(docs, key_col, parts)), end: F.lit(0), tie: F.xxhash64(*[F.col(c) for c in columns])}
    )
    # the first row of each range: its key and tie hash by a narrow aggregate, its columns by a join with those few
    narrow = ranged.groupBy(part).agg(F.min(F.struct(F.col(key_col).isNotNull().alias("n"), F.col(key_col).alias("k"), F.col(tie).alias("t"))).alias("f"))
    ring = narrow.selectExpr(f"coalesce(lag({part}) over (order by {part}), max({part}) over ()) as {to}", f"{part} as {first}", f"f.k as {key}", f"f.t as {hashed}")
    sentinel = (
        ranged.join(F.broadcast(ring), F.expr(f"{part} = {first} and {tie} = {hashed} and `{key_col}` <=> {key}"))
        .drop(part, end).withColumnsRenamed({to: part}).withColumn(end, F.lit(1))
        .select(part, end, tie, *dict.fromkeys([key_col, *columns]))
    )
    rows = ranged.unionByName(sentinel, allowMissingColumns=True)
    added: list[str] = []
    if derive:
        # dealt out before, so that derived columns do not go through the shuffle; by number, since hashes put several ranges into one task
        rows = rows.repartitionById(parts, part)
        before, rows = rows.columns, derive(rows)
        added = [c for c in rows.columns if c not in before]
    order = f"over (partition by {part} order by {end}, `{key_col}` nulls first, {tie})"
    out = rows.select("*", *[F.expr(f"lead(`{c}`) {order}").alias(prefix + c) for c in [*columns, *added]])
    return out.where(F.col(end) == 0).select(*docs.columns, *added, *[prefix + c for c in [*columns, *added]])
