"""Benchmark decontamination: a Wu-Manber search for word windows of test items in whole documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutlint.llm.common import materialize, release, row_slices

#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Test text searched at a time; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16 << 20


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of ``text``; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Search for many equally long word sequences at once.

    A block is the last ``B`` words under the search window. ``shift`` tells how far the window may move
    when that block stands at its end; blocks that no pattern holds allow ``m - B + 1``. Where the shift
    is 0, the bucket of the block lists the patterns that end with it, and those whose first word agrees are
    compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m = len(next(iter(patterns)))
        self.b = min(2, self.m)
        self.far = self.m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = self._block(pattern, end)
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.bucket[self._block(pattern, self.m), pattern[0]].append((pattern, items))

    def _block(self, seq, end: int):
        return seq[end - 1] if self.b == 1 else (seq[end - 2], seq[end - 1])

    def search(self, seq: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """Begin, end and items of every occurrence, by position."""
        m, far, n, shift, bucket = self.m, self.far, len(seq), self.shift, self.bucket
        pos = m
        while pos <= n:
            block = self._block(seq, pos)
            move = shift.get(block, far)
            if move:
                pos += move
                continue
            for pattern, items in bucket.get((block, seq[pos - m]), ()):
                if tuple(seq[pos - m : pos]) == pattern:
                    yield pos - m, pos, items
            pos += 1


def windows(item_words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if item_words and len(item_words) < size:
        yield tuple(item_words)
    for i in range(len(item_words) - size + 1):
        yield tuple(item_words[i : i + size])


def matchers(items: list[tuple[str, str | None]], size: int) -> list[WuManber]:
    """One table for each pattern length among the items' windows."""
    by_len: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        for w in set(windows(words(text), size)):
            by_len[len(w)][w].append(item)
    return [WuManber(dict(p)) for _, p in sorted(by_len.items())]


def scan(seq: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit ranges and the items that occur."""
    spans, found = [], set()
    for table in tables:
        for begin, end, items in table.search(seq):
            spans.append((begin, end))
            found.update(items)
    return _union(spans), found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``limit`` bytes, dealt by a hash; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        block = [(r["i"], r["t"]) for r in part.collect()]
        if block:
            yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges, merged) and ``items`` (ids found, as sorted strings).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. The benchmark is
    the stated set of patterns: it goes to the tasks in blocks of about ``block_bytes`` of text (a single longer item is a block of its own
    size), each with its own tables. Driver and tasks hold one block at a time; with several, documents pass through once for each, and
    what was found so far is written in between.

    Null or wordless text has no words and no hits; items with null text or null id are ignored, and so
    are wordless ones; items with equal texts are all reported. An empty benchmark gives documents
    without hits, an empty table an empty result. Extra columns pass through unless they have the names of the added ones, which are replaced.
    """
    added = ("n_words", "hit_spans", "items")
    out = docs.drop(*[c for c in docs.columns if c.lower() in added])
    spans_type = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    base = out.schema
    schema = T.StructType([*base.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans_type), T.StructField("items", T.ArrayType(T.StringType()))])
    again = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if again is not None:
            out = materialize(out, "scanned")
            again.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_scanner(shared, text_col, window, again=again is not None), schema)
        again = shared
    return out if again is not None else out.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast([]), text_col, window, again=False), schema)


def _scanner(shared, text_col: str, window: int, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = matchers(shared.value, window)
        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in row_slices(whole, text_col, 4 << 20):
                counts, spans, items = [], [], []
                before = batch.select(["hit_spans", "items"]).to_pylist() if again else None
                for r, text in enumerate(batch.column(text_col).to_pylist()):
                    seq = words(text)
                    hit, found = scan(seq, tables)
                    if again:
                        found |= set(before[r]["items"])
                        hit = _union([*hit, *((s["begin"], s["end"]) for s in before[r]["hit_spans"])])
                    counts.append(len(seq))
                    spans.append([{"begin": a, "end": b} for a, b in hit])
                    items.append(sorted(found))
                columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("n_words", "hit_spans", "items")]
                names = [n for n in batch.schema.names if n not in ("n_words", "hit_spans", "items")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                    [*names, "n_words", "hit_spans", "items"],
                )

    return release(run, shared)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out
