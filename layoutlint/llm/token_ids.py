"""Token-id files: raw id payloads, and a minimal perfect hash index from document key to place."""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlint.llm.bpe import CACHE_BYTES, Encoder
from layoutlint.llm.common import kept, materialize, new_path, release, row_slices, utf8_views
from layoutlint.llm.vec import mix

#: Text for a shard, about. A shard is a file; readers hold one at a time.
SHARD_TEXT_BYTES = 8 << 20
#: Keys in a part of the index, about.
INDEX_KEYS = 50_000
#: At most so many shards are opened by name and so many places told to the readers; a request for more reads all files.
NAMED_SHARDS, NAMED_PLACES = 1_000, 100_000
#: Texts of more bytes are cut into parts, one after the other.
LONG_BYTES = 4 << 20
#: Punctuation after a letter is looked up by itself, if it has at most so many characters; at most so many are kept.
_TAIL_CHARS, _MOST_TAILS = 16, 10_000
_PUNCTUATION = string.punctuation
#: Letters in any version of Unicode: a word ends between one of them and punctuation.
_LETTERS = frozenset(string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)])))
#: All that may count as white space, but the line feed.
_SPACE = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that cannot be cut before every blank, or before every blank and line feed.
_BLANKS = rf" (?:[{_SPACE}\n]|\z)"
_BLANKS_AND_LINES = rf"{_BLANKS}|[{_SPACE}]\n|\n(?:[{_SPACE}]|\n(?:\n|\z))"
_MAGIC = b"idshard2"
#: Documents, bytes of keys and bytes of an id, most significant byte first, so that SQL reads them too.
_TRAILER = ">QQB"
_TAIL = struct.calcsize(_TRAILER) + len(_MAGIC)


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, the same as those of a call for each text.

    Text is cut into pieces (:func:`bpe.pieces`), which a byte-level model keeps apart, and only new pieces go to the library: those that begin with
    a single space as one text, told apart by their lengths in bytes. A text that holds the string of an added token, which the library takes
    for that token unless ``plain`` says that it is ordinary text, goes there as a whole.

    Most texts have only single blanks within; Arrow cuts all of them at once, and the table is asked once for each distinct piece of a batch. If the library
    cuts words by the byte-level pattern, a line feed begins a piece too, and punctuation after a letter is a word of its own, so a piece is its core and that tail.
    """

    def __init__(self, vocabulary: bytes, width: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.width = width
        self.model = Tokenizer.from_buffer(vocabulary)
        self.model.encode_special_tokens = plain
        self.added = [] if plain else [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in self.model.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.pieces = Encoder(self._ids_of_pieces, max_bytes=4 * CACHE_BYTES)
        spec = json.loads(vocabulary)
        cut = spec.get("pre_tokenizer") or {}
        self.words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        self.tails: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.width) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        apart = [k for k, w in enumerate(words) if not (len(w) > 1 and (w[0] == " " or self.words and w[0] == "\n") and not w[1].isspace())]
        for k, ids in zip(apart, self._library([words[k] for k in apart]), strict=True):
            out[k] = ids.tobytes()
        joint = [k for k, w in enumerate(words) if out[k] is None]
        for at in range(0, len(joint), 4096):
            some = joint[at : at + 4096]
            (ids,) = self._library(["".join([words[k] for k in some])])
            ends = (np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(words[k].encode()) for k in some])) + 1) * ids.itemsize
            raw, start = ids.tobytes(), 0
            for k, end in zip(some, ends.tolist(), strict=True):
                out[k] = raw[start:end]
                start = end
        return out

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            if len(self.tails) >= _MOST_TAILS:
                self.tails.clear()
            ids = self.tails[tail] = self._library([tail])[0].tobytes()
        return ids

    def _ids_of_found(self, found: pa.Array) -> pa.Array:
        """The ids of distinct pieces, each with the blank in front that is not written here, or with its own line feed."""
        known = self.pieces.of_piece
        if not self.words:
            words = found.to_pylist()
            self.pieces._learn(set(words))
            ids = pa.array(list(map(known.__getitem__, words)), pa.binary())
        else:
            cores = pc.utf8_rtrim(found, characters=_PUNCTUATION)
            size, rest = pc.binary_length(cores).to_numpy(), pc.binary_length(found).to_numpy()
            ends = pc.is_in(pc.utf8_slice_codeunits(cores, -1), value_set=pa.array(sorted(_LETTERS))).to_numpy(zero_copy_only=False)
            _, at = utf8_views(found)
            # core and tail of each piece in turn, over the same bytes
            cuts = np.repeat(at, 2)[:-1]
            cuts[1::2] += np.where(ends & (rest - size <= _TAIL_CHARS), size, rest)
            both = pa.Array.from_buffers(pa.string(), 2 * len(found), [None, pa.py_buffer(cuts.astype(np.int32)), found.buffers()[2]])
            cores, tails = (both.take(pa.array(np.arange(k, len(both), 2))).dictionary_encode() for k in (0, 1))
            words = cores.dictionary.to_pylist()
            self.pieces._learn(set(words))
            ids = pa.array(list(map(known.__getitem__, words)), pa.binary()).take(cores.indices)
            after = pa.array(list(map(self._tail, tails.dictionary.to_pylist())), pa.binary()).take(tails.indices)
            ids = pc.binary_join_element_wise(ids, after, b"")
        self.pieces._forget()
        return ids

    def _plain(self, texts: pa.Array) -> pa.Array:
        """The ids of texts that can be cut at every blank."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if self.words else texts, " ")
        coded = cut.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        begins = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        inner = np.ones(len(at), bool)
        inner[begins[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[at[inner]] = True
        ids = self._ids_of_found(coded.dictionary.filter(pa.array(used)))
        # the first piece of a text has no blank in front
        firsts = self._ids_of_pieces(coded.dictionary.take(pa.array(at[begins[:-1]])).to_pylist())
        place = (np.cumsum(used) - 1)[at]
        place[begins[:-1]] = len(ids) + np.arange(len(firsts))
        out = pa.concat_arrays([ids, pa.array(firsts, pa.binary())]).take(pa.array(place))
        _, offsets, data = out.buffers()
        ends = np.frombuffer(offsets, np.int32, len(out) + 1, 4 * out.offset)[begins]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), data])

    def _each(self, texts: list[str]) -> list[bytes]:
        apart = {k for k, x in enumerate(texts) if any(y in x for y in self.added)}
        ids = iter(self.pieces.encode([x for k, x in enumerate(texts) if k not in apart]))
        return [self._library([x])[0].tobytes() if k in apart else next(ids) for k, x in enumerate(texts)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Binary values; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        other = pc.or_(pc.match_substring_regex(texts, _BLANKS_AND_LINES if self.words else _BLANKS), pc.greater(pc.binary_length(texts), LONG_BYTES))
        for x in self.added:
            other = pc.or_(other, pc.match_substring(texts, x))
        aside = other.to_numpy(zero_copy_only=False)
        parts, order = [], np.empty(len(texts), np.int64)
        if not aside.all():
            parts.append(self._plain(texts.filter(pc.invert(other))))
        if aside.any():
            parts.append(pa.array(self._each(texts.filter(other).to_pylist()), pa.binary()))
        if len(parts) < 2:
            return parts[0] if parts else pa.array([], pa.binary())
        order[~aside], order[aside] = np.arange(len(parts[0])), len(parts[0]) + np.arange(len(parts[1]))
        return pa.concat_arrays(parts).take(pa.array(order))


@dataclass(frozen=True)
class IdFiles:
    """Where the payload files, the index and the shards' first id numbers lie, and how wide an id is."""

    path: str
    index_path: str
    base_path: str
    width: int
    parts: int
    shards: int


def write_ids(
    docs: DataFrame, vocabulary: bytes, key_col: str = "doc_id", text_col: str = "text", *, end_id: int = 0, shard_bytes: int = SHARD_TEXT_BYTES, plain: bool = False
) -> IdFiles:
    """Encode the whole texts, append ``end_id`` to each, and write ids in ascending key order, with an index.

    A file is a shard: the ids of its documents, little-endian, 16 bits wide if the vocabulary allows it and else 32, followed by a
    footer with the documents' keys and lengths. Spark's own committer writes the files into the shared folder, so a lost
    executor only repeats its tasks. The separator that the writer puts after each record is the end id.

    The index maps a key to shard, offset and length in constant time: keys are dealt to parts by a hash;
    in a part a minimal perfect hash (levels of bit arrays; a key is at the first level where nobody
    else has its bit) numbers them without gaps, and the slot stores a 32-bit fingerprint with the place. It is built from the footers alone.

    Strings of added tokens in a text become those tokens, as in the library's plain call; with ``plain`` they are ordinary text.
    Null text is empty and has the end id only. Null keys come first and form one key. Rows that share a key
    follow one another, by the hash of their text; the index gives the first of them and their number. An empty table has files without
    documents and an empty index. Extra columns are not stored.
    """
    if not 0 <= end_id < 128:
        raise ValueError("the end id must be below 128, as it is written as a separator")
    spark = docs.sparkSession
    spec = json.loads(vocabulary)
    size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))], default=0)
    width = 2 if size <= 1 << 16 else 4
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    # a document without text has its key and length to store
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = rows.repartitionByRange(shards, F.col("key"), F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    path = new_path(spark, "ids")
    shared, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    records = dealt.withColumn("key", F.col("key").cast("string")).mapInArrow(_recorder(shared, token, width, plain), "record binary")
    separator = chr(end_id) + "\0" * (width - 1)
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "none").text(path)
    listed = materialize(footers(spark, path, width), "footers")
    places = (
        listed.groupBy("key")
        .agg(F.min(F.struct("shard", "offset", "n")).alias("at"), F.count(F.lit(1)).alias("copies"), F.max("shard").alias("last"))
        .selectExpr("key", "at.shard", "at.offset", "at.n", "copies", "last")
    )
    parts = max(1, -(-listed.count() // INDEX_KEYS))
    index_path, base_path = new_path(spark, "index"), new_path(spark, "bases")
    _hashed(places, parts).drop("key").groupBy("part").applyInArrow(_build, _PART).write.parquet(index_path)
    # a row for each shard: few, so that one task sums them up
    bases = listed.groupBy("shard").agg(F.sum("n").alias("ids")).selectExpr("shard", "sum(ids) over (order by shard) - ids as base")
    bases.write.parquet(base_path)
    return IdFiles(path, index_path, base_path, width, parts, shards)


def _recorder(shared, token: str, width: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(token, lambda: LibraryEncoder(shared.value, f"<u{width}", plain))
        keys: list[str | None] = []
        lengths: list[int] = []
        for whole in batches:
            for batch in row_slices(whole, "text", 4 << 20):
                ids = encoder.encode(batch.column("text"))
                keys += batch.column("key").to_pylist()
                lengths += (pc.binary_length(ids).to_numpy() // width + 1).tolist()
                yield pa.RecordBatch.from_arrays([ids], ["record"])
        coded = [b"\0" if k is None else b"\1" + k.encode() for k in keys]
        footer = np.array([len(k) for k in coded], "<u4").tobytes() + b"".join(coded) + np.array(lengths, "<u8").tobytes()
        footer += struct.pack(_TRAILER, len(keys), sum(map(len, coded)), width) + _MAGIC
        yield pa.RecordBatch.from_arrays([pa.array([footer], pa.binary())], ["record"])

    return release(run, shared, keep=token)


def read_footer(content: memoryview, width: int) -> tuple[list[str | None], np.ndarray, int]:
    """Keys and lengths in ids of a shard file, or of its end from the footer on, and where the footer begins."""
    tail = len(content) - width - _TAIL
    if tail < 0 or bytes(content[tail + _TAIL - len(_MAGIC) : tail + _TAIL]) != _MAGIC:
        raise ValueError("not a shard of ids, or cut short")
    docs, key_bytes, own_width = struct.unpack(_TRAILER, content[tail : tail + _TAIL - len(_MAGIC)])
    if own_width != width:
        raise ValueError("ids of another width")
    at = tail - 8 * docs
    lengths = np.frombuffer(content[at:tail], "<u8").astype(np.int64)
    at -= key_bytes
    coded = bytes(content[at : at + key_bytes])
    sizes = np.frombuffer(content[at - 4 * docs : at], "<u4")
    ends = np.cumsum(sizes, dtype=np.int64)
    keys = [None if coded[e - s] == 0 else coded[e - s + 1 : e].decode() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return keys, lengths, at - 4 * docs


def _files(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    files = reader.load(path if shards is None else [f"{path}/part-{k:05d}-*" for k in shards])
    return files.select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "content")


def footers(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A row for each document in the files: ``shard``, ``key``, ``offset`` and ``n`` in ids. Ids do not leave the JVM."""
    number = lambda at: F.conv(F.hex(F.substring("content", F.length("content") - (width + _TAIL - at) + 1, F.lit(8))), 16, 10).cast("long")
    size = F.least(12 * number(0) + number(8) + width + _TAIL, F.length("content"))
    ends = _files(spark, path).select("shard", F.substring("content", (F.length("content") - size + 1).cast("int"), size.cast("int")).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, lengths, _ = read_footer(memoryview(batch.column("end")[r].as_buffer()), width)
                shard = np.full(len(keys), batch.column("shard")[r].as_py(), np.int32)
                columns = [pa.array(shard), pa.array(keys, pa.string()), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "offset", "n"])

    return ends.mapInArrow(release(run), "shard int, key string, offset long, n long")


def payloads(spark: SparkSession, path: str, width: int, shards: list[int] | None = None, wanted: dict[int, list[int] | None] | None = None) -> DataFrame:
    """Documents in the files, or in the named ``shards``: ``shard``, ``key``, ``offset`` and ``n`` in ids, and the ids' ``crc`` as 32-bit integers.

    ``wanted`` has the offsets to be cut out of each shard (null: all).
    """
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, content = batch.column("shard")[r].as_py(), memoryview(batch.column("content")[r].as_buffer())
                keys, lengths, end = read_footer(content, width)
                ids = np.frombuffer(content[:end], f"<u{width}")
                starts = np.cumsum(lengths) - lengths
                only = None if shared.value is None else shared.value.get(shard, [])
                at = np.arange(len(keys)) if only is None else np.flatnonzero(np.isin(starts, only))
                starts, lengths = starts[at], lengths[at]
                sums = [zlib.crc32(ids[s : s + n].astype("<u4")) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(np.full(len(at), shard, np.int32)), pa.array([keys[k] for k in at.tolist()], pa.string()), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "offset", "n", "crc"])

    return _files(spark, path, shards).mapInArrow(release(run, shared), "shard int, key string, offset long, n long, crc long")


_STORED = ("shard", "offset", "n", "copies", "last")
_PART = "part int, sizes array<int>, bits binary, ranks binary, marks binary, shard binary, offset binary, n binary, copies binary, last binary"


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumns(
        {"part": F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"), "h1": F.xxhash64(F.lit(1), "key"), "h2": F.xxhash64(F.lit(2), "key")}
    )


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits, as 64-bit words; different 128-bit hashes always come to an end."""
    sizes, levels, left = [], [], np.arange(len(h1))
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _bit(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[at]]
        if len(sizes) > 200:
            raise ValueError("keys with equal hashes")
    return sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8")


def slots(h1: np.ndarray, h2: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 for one that no level has; strangers can get any slot."""
    out = np.full(len(h1), -1, np.int64)
    base, left = 0, np.arange(len(h1))
    for level, size in enumerate(sizes):
        at = base + _bit(h1[left], h2[left], level, size)
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        there = (bits[word] >> inside) & np.uint64(1) == 1
        below = np.bitwise_count(bits[word] & ((np.uint64(1) << inside) - np.uint64(1)))
        out[left[there]] = (ranks[word] + below)[there]
        left, base = left[~there], base + size
    return out


def _marks(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1 ^ (h2 << np.uint64(1))) >> np.uint64(32)).astype("<u4")


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))


def _build(table: pa.Table) -> pa.Table:
    h1, h2 = _hashes(table)
    sizes, bits = perfect_hash(h1, h2)
    counts = np.bitwise_count(bits).astype(np.int64)
    ranks = np.cumsum(counts) - counts
    at = slots(h1, h2, sizes, bits, ranks)
    stored = {"marks": _marks(h1, h2)}
    stored |= {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8") for c in _STORED}
    row = {"part": [table.column("part")[0].as_py()], "sizes": [sizes], "bits": [bits.tobytes()], "ranks": [ranks.astype("<i8").tobytes()]}
    for c, values in stored.items():
        placed = np.zeros_like(values)
        placed[at] = values
        row[c] = [placed.tobytes()]
    return pa.table(row, pa.schema([("part", pa.int32()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in row if c not in ("part", "sizes"))]))


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in _STORED)])
    if not index.num_rows or not keys.num_rows:
        return schema.empty_table()
    part = index.slice(0, 1).to_pylist()[0]
    h1, h2 = _hashes(keys)
    at = slots(h1, h2, part["sizes"], np.frombuffer(part["bits"], "<u8"), np.frombuffer(part["ranks"], "<i8"))
    found = at >= 0
    found[found] = np.frombuffer(part["marks"], "<u4")[at[found]] == _marks(h1, h2)[found]
    columns = [keys.column("key").combine_chunks().filter(pa.array(found)).cast(pa.string())]
    columns += [pa.array(np.frombuffer(part[c], "<i8")[at[found]]) for c in _STORED]
    return pa.Table.from_arrays(columns, schema=schema)


def lookup(keys: DataFrame, files: IdFiles, key_col: str = "doc_id") -> DataFrame:
    """Place of each distinct key that the files hold: ``key``, ``shard``, ``offset``, ``n``, ``copies``, and the ``last`` shard with a copy.

    Keys that are not in the index are left out, but for one in four thousand million, which only the footer's key tells apart. Other
    columns of ``keys`` do not matter; an empty table gives an empty result.
    """
    spark = keys.sparkSession
    wanted = _hashed(keys.select(F.col(key_col).cast("string").alias("key")).distinct(), files.parts)
    index = spark.read.parquet(files.index_path)
    types = ", ".join(f"{c} long" for c in _STORED)
    return wanted.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(_find, f"key string, {types}")


def read_ids(keys: DataFrame, files: IdFiles, key_col: str = "doc_id") -> DataFrame:
    """For each document with one of ``keys``: ``key``, ``start`` (ids before it in all files), ``n`` and ``crc``.

    The index gives the places. Only the files that hold one are opened, and the ids are cut out at their offset; where that would be
    more than ``NAMED_SHARDS`` files or ``NAMED_PLACES`` places, all files are read once and joined with the places by shard and
    offset. The key in the file's footer is compared in both cases. Keys that the files do not hold give no row.
    """
    spark = keys.sparkSession
    found = materialize(lookup(keys, files, key_col), "found")
    few = found.count() <= NAMED_PLACES
    named = None
    if few:
        rows = found.select(F.explode(F.sequence("shard", "last")).alias("shard"), F.when(F.col("copies") == 1, F.col("offset")).alias("offset"))
        named = rows.distinct().groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("at"), F.bool_or(F.col("offset").isNull()).alias("all"))
        named = {r["shard"]: None if r["all"] else r["at"] for r in named.limit(NAMED_SHARDS + 1).collect()}
    if few and not named:
        return found.selectExpr("key", "offset as start", "n", "0L as crc").limit(0)
    if few and len(named) <= NAMED_SHARDS:
        stored = payloads(spark, files.path, files.width, sorted(named), named)
    else:
        stored = payloads(spark, files.path, files.width)
    once = found.where("copies = 1").selectExpr("key as k", "shard as at_shard", "offset as at_offset")
    place = (F.col("shard") == F.col("at_shard")) & (F.col("offset") == F.col("at_offset")) & F.col("key").eqNullSafe(F.col("k"))
    columns = ["key", "shard", "offset", "n", "crc"]
    bases = spark.read.parquet(files.base_path).select(F.col("shard").alias("s"), "base")
    many = found.where("copies > 1").selectExpr("key as k")
    hits = stored.join(once, place).select(columns)
    if not many.isEmpty():
        hits = hits.unionByName(stored.join(many, F.col("key").eqNullSafe(F.col("k"))).select(columns))
    return hits.join(bases, F.col("shard") == F.col("s")).select("key", (F.col("base") + F.col("offset")).alias("start"), "n", "crc")
