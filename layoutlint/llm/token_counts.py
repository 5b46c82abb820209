"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layoutlint.llm.bpe import read_ranks
from layoutlint.llm.common import kept, release, row_slices

#: An edit replaces the code points from ``start`` up to ``stop`` by ``put``; later edits see the text that earlier ones left.
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("put", T.StringType())]))

#: Bytes of the table of pre-tokens that a task keeps, with about 120 for each entry's objects.
KNOWN_BYTES = 32 << 20
_ENTRY_BYTES = 120


class Counter:
    """Token counts of pre-tokens by the tiktoken library, with a bounded table of those met."""

    def __init__(self, ranks: bytes, pattern: str, limit: int = KNOWN_BYTES):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        self.encode, self.pattern, self.limit = encoding.encode_ordinary, regex.compile(pattern), limit
        self.known: dict[str, int] = {}
        self.used = 0

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = [w for w in set(words) if w not in known]
        encode = self.encode
        for w in new:
            known[w] = len(encode(w))
        out = [known[w] for w in words]
        size = sum(map(len, new)) + _ENTRY_BYTES * len(new)
        if self.used + size > self.limit:
            for w in new:
                del known[w]
        else:
            self.used += size
        return out


_NONE = np.zeros(0, np.int32)


class Tree:
    """A segment tree over pre-tokens: each node has the characters and the tokens below it.

    Leaves lie in chunks; the inner nodes above them are kept between edits. An edit reads and rewrites the chunks that it touches and
    renews the sums on the paths from those to the root. Chunks may become empty, and grow up to ``4 * CHUNK``; only an edit that puts more into one
    builds the tree anew. The place of a character is found from the root in logarithmic time.
    """

    CHUNK = 64

    def __init__(self, chars=_NONE, tokens=_NONE, sizes=None, node_chars=None, node_tokens=None):
        self._set(np.asarray(chars, np.int32), np.asarray(tokens, np.int32), sizes)
        if node_chars is None:
            self._build()
        else:
            self.size, self.chars, self.tokens = len(node_chars) // 2, np.array(node_chars, np.int64), np.array(node_tokens, np.int64)

    def _set(self, chars: np.ndarray, tokens: np.ndarray, sizes) -> None:
        self.old = chars, tokens
        if sizes is None:
            n = max(1, -(-len(chars) // self.CHUNK))
            sizes = np.full(n, self.CHUNK, np.int32)
            sizes[-1] = len(chars) - (n - 1) * self.CHUNK
        self.sizes = np.array(sizes, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        self.changed: dict[int, tuple[list[int], list[int]]] = {}

    def _build(self) -> None:
        """All sums, level by level."""
        n, size = len(self.sizes), 1
        while size < n:
            size *= 2
        self.size = size
        for name, values in zip(("chars", "tokens"), self.old, strict=True):
            nodes = np.zeros(2 * size, np.int64)
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            nodes[size : size + n] = np.diff(total[self.starts])
            while size > 1:
                nodes[size // 2 : size] = nodes[size : 2 * size : 2] + nodes[size + 1 : 2 * size : 2]
                size //= 2
            size = self.size
            setattr(self, name, nodes)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def chunk(self, k: int) -> tuple[list[int], list[int]]:
        if k in self.changed:
            return self.changed[k]
        a, b = self.starts[k], self.starts[k + 1]
        return self.old[0][a:b].tolist(), self.old[1][a:b].tolist()

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all leaves; what no edit touched is copied as it is."""
        parts: tuple[list, list] = ([], [])
        at = 0
        for k in sorted(self.changed):
            for out, old, new in zip(parts, self.old, self.changed[k], strict=True):
                out += [old[at : self.starts[k]], np.array(new, np.int32)]
            at = self.starts[k + 1]
        return tuple(np.concatenate([*out, old[at:]]) for out, old in zip(parts, self.old, strict=True))

    def find(self, char: int) -> tuple[int, int, int]:
        """Chunk, leaf and first character of the leaf that holds ``char``; past the end, the place after the last leaf."""
        if char >= self.chars[1]:
            last = len(self.sizes) - 1
            return last, int(self.sizes[last]), int(self.chars[1])
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if char >= begin + self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        leaf = 0
        for n in self.chunk(node - self.size)[0]:
            if char < begin + n:
                break
            begin += n
            leaf += 1
        return node - self.size, leaf, begin

    def next_leaf(self, chunk: int, leaf: int) -> tuple[int, int]:
        leaf += 1
        while chunk < len(self.sizes) - 1 and leaf >= self.sizes[chunk]:
            chunk, leaf = chunk + 1, 0
        return chunk, leaf

    def replace(self, first: tuple[int, int], stop: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in the place of those from ``first`` up to ``stop``, and renew the sums above them."""
        (c0, l0), (c1, l1) = first, stop
        head, tail = self.chunk(c0), self.chunk(c1)
        new = [*head[0][:l0], *chars, *tail[0][l1:]], [*head[1][:l0], *tokens, *tail[1][l1:]]
        for k in range(c0, c1 + 1):
            self._put(k, new if k == c0 else ([], []))
        if len(new[0]) > 4 * self.CHUNK:
            self._set(*self.arrays(), None)
            self._build()

    def _put(self, k: int, leaves: tuple[list[int], list[int]]) -> None:
        self.changed[k], self.sizes[k] = leaves, len(leaves[0])
        for nodes, own in zip((self.chars, self.tokens), leaves, strict=True):
            node = self.size + k
            nodes[node] = sum(own)
            while node > 1:
                node //= 2
                nodes[node] = nodes[2 * node] + nodes[2 * node + 1]


class Document:
    """A text with its tree; ``edit`` keeps both."""

    def __init__(self, text: str, counter: Counter, tree: Tree | None = None):
        self.text, self.counter = text, counter
        if tree is None:
            words = counter.pattern.findall(text)
            tree = Tree([len(w) for w in words], counter.counts(words))
        self.tree = tree

    def edit(self, start: int, stop: int, put: str) -> int:
        """Replace a range and return how many pre-tokens were encoded for it.

        A match of the pattern depends on the text from its start to one character past its end, or two after blanks. So
        matching begins at the first pre-token that reaches to within two characters of the edit, and ends as soon as it comes, behind the edit,
        to where an old pre-token began: from there on all is as before.
        """
        tree, old = self.tree, len(self.text)
        start = min(max(start, 0), old)
        stop = min(max(stop, start), old)
        self.text = text = self.text[:start] + put + self.text[stop:]
        shift = len(text) - old
        chunk, leaf, begin = tree.find(max(0, start - 2))
        # the old leaf at or behind the edit's end, walked along with the new matches
        c1, l1, old_begin = tree.find(stop)
        if old_begin < stop:
            old_begin += tree.chunk(c1)[0][l1]
            c1, l1 = tree.next_leaf(c1, l1)
        words, at = [], begin
        match = self.counter.pattern.match
        while at < len(text):
            while old_begin + shift < at and old_begin < old:
                old_begin += tree.chunk(c1)[0][l1]
                c1, l1 = tree.next_leaf(c1, l1)
            if at == old_begin + shift and at >= start + len(put):
                break
            end = match(text, at).end()
            words.append(text[at:end])
            at = end
        if at >= len(text):
            c1 = len(tree.sizes) - 1
            l1 = int(tree.sizes[c1])
        tree.replace((chunk, leaf), (c1, l1), [len(w) for w in words], self.counter.counts(words))
        return len(words)


#: Leaves, leaves in each chunk, and the sums of the inner nodes, the root at place 1.
STATE = {"seg_chars": np.int32, "seg_tokens": np.int32, "chunk_sizes": np.int32, "node_chars": np.int64, "node_tokens": np.int64}
COUNTS = ("n_tokens", "n_encoded")


def _schema(docs: DataFrame) -> tuple[list[str], T.StructType]:
    own = {*STATE, *COUNTS}
    passed = [f for f in docs.schema.fields if f.name.lower() not in own]
    state = [T.StructField(c, T.ArrayType(T.IntegerType() if kind is np.int32 else T.LongType())) for c, kind in STATE.items()]
    return [f.name for f in passed], T.StructType([*passed, *state, *[T.StructField(c, T.LongType()) for c in COUNTS]])


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with each text's tree (``STATE``: leaves, chunks and inner sums), ``n_tokens`` and ``n_encoded``, the number of its pre-tokens.

    A pre-token is a match of ``pattern`` in the whole text. Null and empty text have no leaves and no tokens. Columns
    named like the added ones are replaced; an empty table gives an empty result.
    """
    return _run(docs, ranks, pattern, text_col, None)


def apply_edits(state: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """The state after each document's edits (a column of type ``EDITS``, in order): its text, tree, ``n_tokens``, and in ``n_encoded`` the
    pre-tokens that were encoded, which are those near the edits, whatever the length of the text. The tree's untouched chunks and sums are
    copied, not worked out again.

    Ranges are cut to the text; a null range or replacement counts as 0 or empty, and a null list of edits changes nothing.
    Null text is edited as if empty and stays null without edits. Nothing shuffles.
    """
    return _run(state, ranks, pattern, text_col, edits_col)


def _run(docs: DataFrame, ranks: bytes, pattern: str, text_col: str, edits_col: str | None) -> DataFrame:
    passed, schema = _schema(docs)
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), f"{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(key, lambda: Counter(shared.value, pattern))
        for whole in batches:
            for batch in row_slices(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                encoded = []
                if edits_col is None:
                    found = [counter.pattern.findall(x or "") for x in texts]
                    tokens = np.array(counter.counts([w for words in found for w in words]), np.int32)
                    chars = np.fromiter((len(w) for words in found for w in words), np.int32, len(tokens))
                    encoded = [len(words) for words in found]
                    ends = np.concatenate([[0], np.cumsum(encoded)]).astype(np.int64)
                    trees = [Tree(chars[a:b], tokens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield _batch(batch, passed, None, None, trees, encoded)
                    continue
                trees = []
                state = [batch.column(c) for c in STATE]
                for r, edits in enumerate(batch.column(edits_col).to_pylist()):
                    known = [c[r].values.to_numpy() for c in state] if all(c[r].is_valid for c in state) else []
                    doc = Document(texts[r] or "", counter, Tree(*known))
                    n = sum(doc.edit(e["start"] or 0, e["stop"] or 0, e["put"] or "") for e in edits or ())
                    if edits:
                        texts[r] = doc.text
                    trees.append(doc.tree)
                    encoded.append(n)
                yield _batch(batch, passed, text_col, texts, trees, encoded)

    return docs.mapInArrow(release(run, shared, keep=key), schema)


def _batch(batch: pa.RecordBatch, passed: list[str], text_col: str | None, texts, trees: list[Tree], encoded: list[int]) -> pa.RecordBatch:
    columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in passed]
    rows = [(*t.arrays(), t.sizes, t.chars, t.tokens) for t in trees]
    lists = []
    for k, kind in enumerate(STATE.values()):
        ends = np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int32)
        values = np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
    counts = [pa.array([t.n_tokens for t in trees], pa.int64()), pa.array(encoded, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *lists, *counts], [*passed, *STATE, *COUNTS])
