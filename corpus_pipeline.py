"""A cleaning pipeline over ``documents``: language, repeated lines, near duplicates, test passages, tokens.

Each stage takes what the one before kept and wrote, and acts on it; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlint.llm import bpe, decontam, langid, line_dedup, minhash
from layoutlint.llm.common import materialize
from layoutlint.llm.queries import table, tokenizer_file

#: A document goes if its language is not known at all (no letter) or no language has this probability; without any labelled document to
#: learn from, only if it has no letter.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; their ``lang`` stays as it is, since it may be a better source than the prediction."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.train(docs.where(fold != 0))
    if not model.languages:
        return docs.where(langid.has_letter(F.col("text")))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters that 5 or more documents share stay in the last of them only."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (five words, similarity 0.8)."""
    return minhash.near_duplicates(docs).where("kept").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words, or a whole shorter item, of the benchmark."""
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Token ids of each document left, as 32-bit integers, with the digest of the text that they decode to."""
    ranks = tokenizer_file(spark, path)
    done = bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return done.select("doc_id", "source", "lang", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Language prediction and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
