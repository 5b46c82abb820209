import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from layoutlint.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("sf")
    syllables = {"en": ["the", "ing", "tion", "er", "sh"], "fr": ["eau", "que", "oi", "è", "le"]}
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, say(x, 60), x) for i, x in enumerate(["en", "fr"] * 30)]
    shared = say("en", 12)
    rows += [(100 + i, say("en", 50) + "\n" + shared + "\n" + say("en", 5), "en") for i in range(6)]
    base = say("fr", 300).split()
    rows += [(200, " ".join(base), "fr"), (201, " ".join([*base[:-1], "other"]), "fr"), (202, " ".join(base), "fr")]
    item = say("en", 15)
    rows += [(300, say("en", 40) + " " + item + " " + say("en", 9), "en"), (400, None, "en"), (401, "%%% ### 123", "en"), (402, "", None)]
    spark.createDataFrame([(d, t, x, "s", len(t or "")) for d, t, x in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, shared


def test_stages_act(spark, corpus):
    folder, rows, shared = corpus
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {d for d, _, _ in rows} - {201, 202, 300, 400, 401, 402}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    for d, text, _ in rows:
        if d in out:
            kept = "\n".join(x for x in text.split("\n") if x != shared or d == 105)
            ids = [int.from_bytes(out[d]["ids"][k : k + 4], "little") for k in range(0, len(out[d]["ids"]), 4)]
            assert library.decode(ids) == kept and ids == library.encode_ordinary(kept) and out[d]["n_tokens"] == len(ids)


def test_every_stage_but_the_last_keeps_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus[0])
        assert docs.dtypes == [tuple(c.split()) for c in COLUMNS.replace("long", "bigint").split(", ")]


def test_unlabelled_documents_stay(spark):
    rows = [(1, "some text", None, "s", 9), (2, "12 %", None, "s", 4), (3, None, None, "s", 0), (4, "里", None, "s", 1)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
