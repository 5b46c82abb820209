"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layoutlint.llm.common import fresh, release, row_slices

UNKNOWN = "und"
BITS = 16
ORDERS = (1, 2, 3)
#: Languages in a block of the model: a block has ``2**BITS`` values for each, and is collected, broadcast and scored by itself.
BLOCK_LANGUAGES = 64
#: Blocks that a task holds at a time.
HELD_BLOCKS = 4
#: About how many different texts of each language are learned from; more do not change a model of this size noticeably.
MAX_TRAIN_DOCS = 20_000
_CHARS = 1 << 18
#: Bytes of text whose sparse counts are made at once; they take some thirty times as much.
_BATCH = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_ids(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the lower-cased text's n-grams, a stretch of text at a time.

    Every run of other characters counts as one blank, and the text has one at both ends. Stretches
    overlap, so that the n-grams are those of the whole text.
    """
    low = text.lower()
    longest = max(ORDERS)
    tail = np.full(1, 32, np.uint64)
    done = 0
    for at in range(0, len(low) + 1, _CHARS):
        part = np.frombuffer(low[at : at + _CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_is_letter()[part], part, 32).astype(np.uint64)
        if at + _CHARS > len(low):
            points = np.append(points, np.uint64(32))
        seq = np.concatenate([tail, points])
        new = len(seq) - len(points)
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] != 32) | (seq[:-1] != 32)
        keep[:new] = True
        seq = seq[keep]
        out = []
        for n in ORDERS:
            h = np.full(max(0, len(seq) - n + 1), n, np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += seq[k : k + len(h)]
            # n-grams that end in the part before are counted there
            h = h[max(0, new - n + 1) if done else 0 :]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        done = 1
        tail = seq[-(longest - 1) :] if longest > 1 else seq[:0]
        yield np.concatenate(out)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse counts of a batch: row, bucket and count of each bucket that a text has, by row and bucket."""
    parts = [ids | r << BITS for r, text in enumerate(texts) for ids in gram_ids(text)]
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] >> BITS, keys[first] & (1 << BITS) - 1, np.diff(np.append(first, len(keys)))


@dataclass(frozen=True)
class Model:
    """Languages in order, the logarithms of their shares, and a matrix of log probabilities (bucket, language) for each block of languages."""

    languages: tuple[str, ...]
    prior: np.ndarray
    blocks: tuple[np.ndarray, ...]

    def scores(self, texts: list[str], blocks=None) -> np.ndarray:
        """Log joint probability of each text (rows) and language (columns): the batch's sparse counts times each block's matrix."""
        row, bucket, n = gram_counts(texts)
        out = np.tile(self.prior, (len(texts), 1))
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            at = 0
            for block in self.blocks if blocks is None else blocks:
                for c in range(0, block.shape[1], 8):  # a few columns at a time, since each is as long as the counts
                    columns = block[:, c : c + 8]
                    out[row[first], at + c : at + c + columns.shape[1]] += np.add.reduceat(n[:, None] * columns[bucket], first)
                at += block.shape[1]
        return out

    def predict(self, texts: list[str], blocks=None) -> tuple[list[str], np.ndarray]:
        joint = self.scores(texts, blocks)
        best = joint.argmax(1)
        # log posterior of the best one
        score = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
        return [self.languages[b] for b in best], score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_docs: int = MAX_TRAIN_DOCS, alpha: float = 0.1) -> Model:
    """Fit on about ``max_docs`` different texts of each language, taken by a hash of the text; a language with fewer is learned whole.

    Copies of a text within a language count once, but all rows count for the prior. Rows with null text or language or without a letter
    are left out, and so are languages that have no other rows. Counts are summed per task, then by (language, bucket). Any number of
    languages is learned, in blocks of ``BLOCK_LANGUAGES``, so that at most ``BLOCK_LANGUAGES * 2**BITS`` sums reach the driver
    at a time; it keeps 256 KB for each language. No usable row gives a model that answers ``und``.
    """
    rows = labelled.where(has_letter(F.col(text_col)) & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash")
    )
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("texts")).collect()
    sizes = {r["lang"]: r["n"] for r in found}
    if not sizes:
        return Model((), np.zeros(0), ())
    total = sum(sizes.values())
    shares = [(r["lang"], int(1_000_000 * max_docs / r["texts"])) for r in found if r["texts"] > max_docs]
    if shares:
        # a row for each language, as in the model itself
        share = labelled.sparkSession.createDataFrame(shares, "lang string, share int")
        rows = rows.join(F.broadcast(share) if len(shares) <= 10_000 else share, "lang", "left")
        rows = rows.where(F.col("share").isNull() | (F.pmod("hash", F.lit(1_000_000)) < F.col("share"))).drop("share")
    rows = rows.dropDuplicates(["lang", "hash"]).select("text", "lang")
    languages = sorted(sizes)
    blocks = []
    for first in range(0, len(languages), BLOCK_LANGUAGES):
        own = languages[first : first + BLOCK_LANGUAGES]
        some = rows.where(F.col("lang").isin(own)) if len(languages) > BLOCK_LANGUAGES else rows
        sums = some.mapInArrow(_counter(own), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((2**BITS, len(own)))
        if sums.num_rows:
            counts[sums.column("bucket").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
        blocks.append((np.log(counts + alpha) - np.log(counts.sum(0) + alpha * 2**BITS)).astype(np.float32))
    prior = np.log(np.array([sizes[x] for x in languages]) / total)
    return Model(tuple(languages), prior, tuple(blocks))


def _counter(languages: list[str]):
    """Sums of a task's buckets by the number of the language."""
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) << BITS, np.int64)
        for whole in batches:
            for batch in row_slices(whole, "text", _BATCH):
                row, bucket, n = gram_counts(batch.column("text").to_pylist())
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                np.add.at(counts, lang[row] << BITS | bucket, n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at >> BITS).astype(np.int32)), pa.array((at & (1 << BITS) - 1).astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    return release(run)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language.

    The matrix of log probabilities is broadcast in blocks of languages (``BLOCK_LANGUAGES * 2**BITS`` floats each), of which a task holds
    ``HELD_BLOCKS`` or all if there are no more; each slice of whole texts is scored as its sparse counts times those. Text that is null or has no
    letter, and any text under a model without languages, gets ``und`` and score 0. Ties go to the alphabetically first
    language. Extra columns pass through, but for columns named like the added ones, which are replaced.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    (letter,) = fresh(out, "has_letter")
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in model.blocks]
    names = Model(model.languages, model.prior, ())
    passed = out.columns
    schema = out.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for x in shared:
                yield x.value
                if len(shared) > HELD_BLOCKS:
                    x.__dict__.pop("_value", None)

        for whole in batches:
            for batch in row_slices(whole, text_col, _BATCH):
                usable = np.array(batch.column(letter).to_pylist(), bool)
                if not names.languages:
                    usable[:] = False
                texts = batch.column(text_col).to_pylist()
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rows = np.flatnonzero(usable)
                if len(rows):
                    best, values = names.predict([texts[r] for r in rows], blocks())
                    score[rows] = values
                    for r, name in zip(rows, best, strict=True):
                        lang[r] = name
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], pa.array(lang, pa.string()), pa.array(score)], [*passed, "lang_pred", "score"])

    return out.withColumn(letter, has_letter(F.col(text_col))).mapInArrow(release(run, *shared), schema)
