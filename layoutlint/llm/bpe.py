"""Byte-level BPE: encoding by merge replay over the distinct words of the corpus, and decoding."""

from __future__ import annotations

import base64
import heapq
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import kept, release, row_slices

#: The words that all tasks share: at most so many, each of at most so many bytes, so 8 MB of words and 32 MB of ids at the very most.
HEAD_WORDS = 200_000
HEAD_WORD_BYTES = 40
#: Bytes of the table of text pieces that a task keeps, with about 150 for each entry's objects.
CACHE_BYTES = 24 << 20
_ENTRY_BYTES = 150
#: Distinct pieces of text whose words a task reports at a time, when words are counted.
_REPORT_PIECES = 200_000
#: Texts are cut into parts of about this many characters.
_PART_CHARS = 1 << 20
#: Words of more bytes than this are replayed by a list and a heap; at most so many others at once.
_SHORT = 200
_TOGETHER = 50_000
_NEVER, _PLACE = np.int64(1 << 30), np.int64((1 << 32) - 1)
_AMBIGUOUS = re.compile(r" (?:\s|\Z)")
_PIECES = re.compile(r"(?= \S)")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def _distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places, kind="stable")
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


class MergeTable:
    """For pairs of token ids the id that they merge into: that of their joint bytes, which is also the merge's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the ranks lack single bytes")
        self.whole = ranks.get
        merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    merged[a << 32 | b] = rank
        self._merged: dict[int, int] | None = None
        keys = np.fromiter(merged, np.int64, len(merged))
        ranks_of = np.fromiter(merged.values(), np.int64, len(merged))
        # a hash table with linear probing, at most a quarter full
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.pair_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.pairs[at] < 0
            self.pairs[at[free]] = keys[free]
            stays = self.pairs[at] == keys
            self.pair_ranks[at[stays]] = ranks_of[stays]
            keys, ranks_of, at = keys[~stays], ranks_of[~stays], (at[~stays] + 1) & self.mask

    @property
    def merged(self) -> dict[int, int]:
        """The same pairs as a dictionary, which only long words need."""
        if self._merged is None:
            full = self.pairs >= 0
            self._merged = dict(zip(self.pairs[full].tolist(), self.pair_ranks[full].tolist(), strict=True))
        return self._merged

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or ``_NEVER``."""
        pairs = a << 32 | b
        at = self._slot(pairs)
        met = self.pairs[at]
        out = np.where(met == pairs, self.pair_ranks[at], _NEVER)
        left = np.flatnonzero((met != pairs) & (met >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            met = self.pairs[at[left]]
            same = met == pairs[left]
            out[left[same]] = self.pair_ranks[at[left[same]]]
            left = left[~same & (met >= 0)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers. Words of up to ``_SHORT`` bytes are replayed together, longer ones by :meth:`replay`."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.whole(w) for w in coded]
        out = [b"" if k is None else k.to_bytes(4, "little") for k in whole]
        left = [k for k, w in enumerate(coded) if whole[k] is None and w]
        short = [k for k in left if len(coded[k]) <= _SHORT]
        long = [k for k in left if len(coded[k]) > _SHORT]
        for k, ids in zip(long, self.replay([coded[k] for k in long]) if long else [], strict=True):
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(short), _TOGETHER):
            some = short[at : at + _TOGETHER]
            for k, ids in zip(some, self._replay_together([coded[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _replay_together(self, words: list[bytes]) -> list[bytes]:
        """The merges in rank order over all words at once.

        The symbols of all words are linked to their neighbours in arrays. The inverted index has, for each pair that can merge, the
        positions where it stands, in blocks of ranks; blocks come in order. In a block each word that has pairs of it applies its merge of the
        lowest rank, the leftmost of equal ones, all words in one array operation, until none is left. A merge changes
        its two neighbours only, whose new pairs go to the index, or into the block at hand if their rank is not behind it.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        symbol = np.array(self.single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        word = np.repeat(np.arange(len(words)), sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[first + sizes - 1] = -1
        left[first] = -1
        rank = np.full(n, _NEVER)
        some = np.flatnonzero(right >= 0)
        rank[some] = self._ranks_of(symbol[some], symbol[some + 1])
        index: dict[int, list[np.ndarray]] = {}

        def enter(places: np.ndarray) -> None:
            block = np.sqrt(rank[places]).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block, places = block[order], places[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for b, part in zip(block[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if b not in index:
                    index[b] = []
                    heapq.heappush(heap, b)
                index[b].append(part)

        heap: list[int] = []
        some = some[rank[some] < _NEVER]
        if len(some):
            enter(some)
        while heap:
            block = heapq.heappop(heap)
            end = (block + 1) ** 2
            places = _distinct(np.concatenate(index.pop(block)))
            while True:
                places = places[rank[places] < end]
                if not len(places):
                    break
                own = word[places]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                # of each word the lowest rank, and of equal ones the leftmost
                at = np.minimum.reduceat(rank[places] << 32 | places, starts) & _PLACE
                gone = right[at]
                behind = right[gone]
                before = left[at]
                symbol[at] = rank[at]
                symbol[gone] = -1
                rank[gone] = _NEVER
                right[at] = behind
                has, had = behind >= 0, before >= 0
                at_has, behind, before, at_had = at[has], behind[has], before[had], at[had]
                left[behind] = at_has
                rank[at] = _NEVER
                found = self._ranks_of(np.concatenate([symbol[at_has], symbol[before]]), np.concatenate([symbol[behind], symbol[at_had]]))
                rank[at_has] = found[: len(at_has)]
                rank[before] = found[len(at_has) :]
                changed = np.concatenate([at_has, before])
                late = changed[(found >= end) & (found < _NEVER)]
                if len(late):
                    enter(late)
                early = before[found[len(at_has) :] < end]
                if len(early):
                    places = _distinct(np.concatenate([places, early]))
        alive = symbol >= 0
        ends = (np.cumsum(np.add.reduceat(alive.astype(np.int64), first)) * 4).tolist()
        raw = symbol[alive].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word. A word that is a token is done.

        All other words lie in one symbol list, linked to their neighbours. An inverted index holds, for each merge that is possible
        now, the positions where it is; a heap gives the merges by rank. Applying one touches only its positions and their
        neighbours, whose new pairs enter the index. Positions go from left to right. When a merge opens one of lower
        rank, that one comes first and the rest of the positions wait.
        """
        single, merged = self.single, self.merged.get
        symbols: list[int] = []
        right: list[int] = []
        left: list[int] = []
        firsts = []
        for word in words:
            at, known = len(symbols), self.whole(word)
            if known is not None:
                firsts.append(-1 - known)
                continue
            firsts.append(at)
            n = len(word)
            symbols.extend([single[b] for b in word])
            left.extend(range(at - 1, at + n - 1))
            right.extend(range(at + 1, at + n + 1))
            if n:
                left[at] = -1
                right[-1] = -1
        index: dict[int, list[int]] = {}
        for i, j in enumerate(right):
            if j >= 0:
                m = merged(symbols[i] << 32 | symbols[j])
                if m is not None:
                    if m in index:
                        index[m].append(i)
                    else:
                        index[m] = [i]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j = right[i]
                if j < 0 or symbols[i] < 0 or merged(symbols[i] << 32 | symbols[j]) != rank:
                    continue
                symbols[i] = rank
                symbols[j] = -1
                after = right[i] = right[j]
                before = left[i]
                lower = False
                if after >= 0:
                    left[after] = i
                    m = merged(rank << 32 | symbols[after])
                    if m is not None:
                        if m in index:
                            index[m].append(i)
                        else:
                            index[m] = [i]
                            heapq.heappush(heap, m)
                        lower = m <= rank
                if before >= 0:
                    m = merged(symbols[before] << 32 | rank)
                    if m is not None:
                        if m in index:
                            index[m].append(before)
                        else:
                            index[m] = [before]
                            heapq.heappush(heap, m)
                        lower |= m <= rank
                if lower:
                    rest = places[k + 1 :]
                    if rest:
                        if rank in index:
                            index[rank].extend(rest)
                        else:
                            index[rank] = rest
                            heapq.heappush(heap, rank)
                    break
        out = []
        for at, word in zip(firsts, words, strict=True):
            if at < 0:
                out.append([-1 - at])
                continue
            ids, i = [], at if word else -1
            while i >= 0:
                ids.append(symbols[i])
                i = right[i]
            out.append(ids)
        return out


def pieces(text: str) -> tuple[str, list[str]]:
    """The text up to its first inner blank, and what follows each blank at which it can be cut.

    A single space before a non-blank always begins a match of the word pattern, so the parts can be
    encoded by themselves: the first as it is, the others with the space in front.
    """
    if _AMBIGUOUS.search(text):
        first, *rest = _PIECES.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


def parts(text: str) -> Iterator[str]:
    """A very long text in parts that can be encoded by themselves, cut where :func:`pieces` can cut."""
    at = 0
    while len(text) - at > 2 * _PART_CHARS:
        cut = _PIECES.search(text, at + _PART_CHARS)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Whole texts to little-endian ids; ``encode_words`` gives the bytes of each word's ids, ``split_words`` the words of a piece.

    ``head`` has the ids of the words that the whole corpus shares. Other pieces of text stay in the table when they come
    again before it is full, and go otherwise, so that the table has what is frequent and its bytes are bounded.
    """

    def __init__(self, encode_words, split_words=None, head: dict[str, bytes] | None = None, max_bytes: int = CACHE_BYTES):
        self.encode_words, self.split_words, self.max_bytes = encode_words, split_words, max_bytes
        head = head or {}
        self.of_word = {w: ids for w, ids in head.items() if w[:1] != " "}
        self.of_piece = {w[1:]: ids for w, ids in head.items() if w[:1] == " "}
        self.young: set[str] = set()
        self.used = 0

    def _ids(self, new: list[str]) -> list[bytes]:
        """The ids of pieces of text that are not in the table."""
        if not new:
            return []
        if self.split_words is None:
            return self.encode_words(new)
        split = [self.split_words(x) for x in new]
        ids: dict[str, bytes] = {}
        tail = []
        for w in set(chain.from_iterable(split)):
            known = self.of_piece.get(w[1:]) if w[0] == " " else self.of_word.get(w)
            if known is None:
                tail.append(w)
            else:
                ids[w] = known
        ids.update(zip(tail, self.encode_words(tail), strict=True))
        get = ids.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, found: set[str]) -> None:
        """Adds the pieces that are not known; those met before while young are no longer so."""
        known = self.of_piece
        new = list(found.difference(known))
        self.young -= found
        if new:
            # no blank is in front where a line feed begins a piece, which is so in token_ids only
            known.update(zip(new, self._ids([x if x[:1] == "\n" else " " + x for x in new]), strict=True))
            self.young.update(new)
            self.used += sum(map(len, new)) + _ENTRY_BYTES * len(new)

    def _forget(self) -> None:
        """Once the table is full, what came only once goes."""
        if self.used > self.max_bytes:
            known = self.of_piece
            for x in self.young:
                del known[x]
            self.used -= sum(map(len, self.young)) + _ENTRY_BYTES * len(self.young)
            self.young = set()

    def encode(self, texts: list[str]) -> list[bytes]:
        long = {k: list(parts(x)) for k, x in enumerate(texts) if len(x) > 2 * _PART_CHARS}
        if long:
            return [b"".join(self._short([y])[0] for y in long[k]) if k in long else self._short([x])[0] for k, x in enumerate(texts)]
        return self._short(texts)

    def _short(self, texts: list[str]) -> list[bytes]:
        split = [pieces(x) for x in texts]
        self._learn(set().union(*[rest for _, rest in split]))
        get = self.of_piece.__getitem__
        firsts = self._ids([first for first, _ in split])
        out = [first + b"".join(map(get, rest)) for first, (_, rest) in zip(firsts, split, strict=True)]
        self._forget()
        return out


def shared_words(docs: DataFrame, ranks, pattern: str, text_col: str = "text", *, most: int = HEAD_WORDS) -> dict[str, bytes]:
    """Ids of the words that most stretches of the corpus have, at most ``most`` of them and none of a single stretch.

    Every text is read. A task reports the distinct words of each of its stretches, and their numbers are summed by word. The words
    taken are dealt by a hash, and the merges are replayed over all words of a part at once. ``ranks`` is a broadcast rank file.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        found: set[str] = set()
        firsts: set[str] = set()

        def words() -> pa.RecordBatch:
            own = set(chain.from_iterable(map(find, firsts))).union(chain.from_iterable(find(" " + x) for x in found))
            found.clear()
            firsts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w in own if len(w) <= HEAD_WORD_BYTES], pa.string())], ["word"])

        for whole in batches:
            for batch in row_slices(whole, "text"):
                for x in batch.column("text").to_pylist():
                    for y in parts(x or ""):
                        first, rest = pieces(y)
                        firsts.add(first)
                        found.update(rest)
                if len(found) + len(firsts) > _REPORT_PIECES:
                    yield words()
        yield words()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column("word").to_pylist()]
        if words:
            ids = MergeTable(read_ranks(ranks.value)).encode(words)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.binary())], ["word", "ids"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(release(report), "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    head = found.where((F.col("n") > 1) & (F.octet_length("word") <= HEAD_WORD_BYTES)).orderBy(F.desc("n"), "word").limit(most)
    got = head.repartition(4, "word").select("word").mapInArrow(release(replay, ranks), "word string, ids binary").toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True))


def _vocabulary(ranks: bytes) -> list[bytes | None]:
    by_id = {i: b for b, i in read_ranks(ranks).items()}
    return [by_id.get(i) for i in range(max(by_id, default=-1) + 1)]


def _bytes_of(vocabulary: list[bytes | None], ids: bytes) -> bytes:
    try:
        return b"".join([vocabulary[i] for i in np.frombuffer(ids, "<u4").tolist()])
    except (IndexError, TypeError):
        raise ValueError("an id that the ranks do not have") from None


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", *, decoded_col: str | None = None, slice_bytes: int = 2 << 20, head_words: int = HEAD_WORDS
) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is the content of a rank file (a vocabulary, a few MB at most) and is broadcast. Each match of ``pattern`` is
    encoded by itself. :func:`shared_words` replays the merges once over the most widespread words of the corpus, for all tasks; a task
    replays them over the distinct other words of each slice of its documents (:meth:`MergeTable.replay`). Joining ids back to every
    occurrence of a rare word would shuffle the corpus. With ``decoded_col`` the ids are decoded again in the same pass
    (:func:`decode`). A task's tables are bounded in bytes and go when it ends.

    Null and empty text have no ids (an empty binary). Columns named ``ids_col`` or ``decoded_col`` are replaced, other
    columns pass through; repeated rows are encoded alike; an empty table gives an empty result. ``head_words`` of 0 shares nothing.
    """
    own = [ids_col, *([decoded_col] if decoded_col else [])]
    out = docs.drop(*[c for c in docs.columns if c.lower() in [x.lower() for x in own]])
    passed, schema, key = out.columns, out.withColumns({c: F.lit(b"") for c in own}).schema, uuid.uuid4().hex
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(ranks)
    words = context.broadcast(shared_words(docs, shared, pattern, text_col, most=head_words) if head_words else {})

    def tables() -> tuple[Encoder, list[bytes | None]]:
        encoder = Encoder(MergeTable(read_ranks(shared.value)).encode, regex.compile(pattern).findall, words.value)
        words.__dict__.pop("_value", None)
        return encoder, _vocabulary(shared.value) if decoded_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = kept(key, tables)
        for whole in batches:
            for batch in row_slices(whole, text_col, slice_bytes):
                ids = encoder.encode([x or "" for x in batch.column(text_col).to_pylist()])
                done = [pa.array(ids, pa.binary())]
                if decoded_col:
                    done.append(pa.array([_bytes_of(vocabulary, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *done], [*passed, *own])

    return out.mapInArrow(release(run, shared, words, keep=key), schema)


def decode(docs: DataFrame, ranks: bytes, ids_col: str = "ids", bytes_col: str = "decoded", *, slice_ids: int = 1 << 18) -> DataFrame:
    """``docs`` with ``bytes_col``: the bytes that the ids stand for. Null ids give no bytes; an id that the ranks do not have is an error.

    A column named ``bytes_col`` is replaced, other columns pass through; an empty table gives an empty result.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() == bytes_col.lower()])
    passed, schema = out.columns, out.withColumn(bytes_col, F.lit(b"")).schema
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for r0, r1 in _id_slices(batch.column(ids_col), slice_ids):
                part = batch.slice(r0, r1 - r0)
                texts = [_bytes_of(vocabulary, x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], pa.array(texts, pa.binary())], [*passed, bytes_col])

    return out.mapInArrow(release(run, shared), schema)


def _id_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    start = used = 0
    for r, x in enumerate(column):
        n = len(x.as_buffer() or b"") // 4 if x.is_valid else 0
        if r > start and used + n > limit:
            yield start, r
            start, used = r, 0
        used += n
    if start < len(column):
        yield start, len(column)
