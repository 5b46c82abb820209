import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from layoutlint.llm import bpe, token_counts, token_ids

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
PARTS = [" ", "  ", "\n", "a", "b", "the", "ing", "é", "中", "　", "\xa0", "\x1c", "\x85", "'s", "'", "12", "!", "\t", "\r", "😀", "x" * 9, "!!"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts(n, seed=1, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(n)] + ["a" * 500, " " * 30, "\n" * 9, "", " a", " ", "a "]


def test_replay_is_the_librarys_encoding(library):
    table = bpe.MergeTable(bpe.read_ranks(RANKS))
    split = regex.compile(public_tokenizers.PATTERN).findall
    some = texts(3000)
    words = sorted({w for x in some[:1500] for w in split(x)})
    encoder = bpe.Encoder(table.encode, split, dict(zip(words, table.encode(words), strict=True)))
    for text, ids in zip(some, encoder.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_small_tables_change_nothing(library):
    encoder = bpe.Encoder(bpe.MergeTable(bpe.read_ranks(RANKS)).encode, regex.compile(public_tokenizers.PATTERN).findall, max_bytes=2000)
    for text in texts(300, 2) + texts(300, 2):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert len(encoder.of_piece) <= 2000 / 150 + 40


def test_long_texts_are_cut_where_nothing_changes(library, monkeypatch):
    monkeypatch.setattr(bpe, "_PART_CHARS", 7)
    encoder = bpe.Encoder(bpe.MergeTable(bpe.read_ranks(RANKS)).encode, regex.compile(public_tokenizers.PATTERN).findall)
    for text in texts(300, 12):
        assert "".join(bpe.parts(text)) == text
        assert np.frombuffer(encoder.encode([text, "b"])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_a_merge_that_opens_one_of_lower_rank_waits():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 301, b"ab": 302, b"xa": 303}
    table = bpe.MergeTable(ranks)
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choices("abcx", k=rng.randint(1, 12))) for _ in range(500)]
    assert table.replay([w.encode() for w in words]) == [encoding.encode_ordinary(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in table.encode(words)] == [encoding.encode_ordinary(w) for w in words]


@given(st.lists(st.text(alphabet="abcx", max_size=14), max_size=30), st.permutations(["ab", "bc", "abc", "xa", "ca", "aa", "aaa", "bca", "abx"]))
@settings(max_examples=60, deadline=None)
def test_array_replay_under_any_order_of_merges(words, tokens):
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + k for k, t in enumerate(tokens)}
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.MergeTable(ranks).encode(words)]
    assert got == [encoding.encode_ordinary(w) for w in words]


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "Hello  there\n", 1), (2, None, 2), (3, "", 3), (1, "Hello  there\n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, bytes_col="raw").collect()
    assert {r["decoded"]: bytes(r["raw"]).decode() for r in out} == {1: "Hello  there\n", 2: "", 3: "", 4: "Hello  there\n"}
    both = bpe.encode(docs.withColumnRenamed("decoded", "Raw"), RANKS, public_tokenizers.PATTERN, decoded_col="raw").collect()
    assert sorted((r["doc_id"], bytes(r["raw"]).decode()) for r in both) == [(1, "Hello  there\n"), (1, "Hello  there\n"), (2, ""), (3, "")]
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN, decoded_col="raw").count() == 0
    with pytest.raises(Exception, match="an id that the ranks do not have"):
        bpe.decode(spark.sql("select unhex('ffffff00') as ids"), RANKS).collect()


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_id_files_come_back(spark, shard_bytes):
    model = Tokenizer.from_buffer(VOCABULARY)
    special = ["x <|endoftext|> y", "<|endoftext|>", "a <|endoftext|><|endoftext|>b <|endof", " <|endoftext|> the end"]
    rows = [(i * 7 % 101, t, i) for i, t in enumerate(texts(80, 4) + special)] + [(None, "nobody", 0), (500, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    files = token_ids.write_ids(docs, VOCABULARY, shard_bytes=shard_bytes)
    found = {r["key"]: (r["start"], r["n"], r["crc"]) for r in token_ids.read_ids(docs, files).collect()}
    start = 0
    for key, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        assert found[None if key is None else str(key)] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # one key is found in one file, at its place
    few = spark.createDataFrame([(14,), (7777,)], "doc_id long")
    (one,) = token_ids.read_ids(few, files).collect()
    assert (one["start"], one["n"], one["crc"]) == found["14"]
    strangers = spark.createDataFrame([(k,) for k in range(1000, 3000)], "doc_id long")
    assert token_ids.lookup(strangers, files).count() == token_ids.read_ids(strangers, files).count() == 0


def test_shards_stay_small(spark):
    # a file is one value of a row in the reader, so that its size is held several times over
    docs = spark.range(6).selectExpr("id as doc_id", "repeat('one two ', 250000) as text")
    files = token_ids.write_ids(docs, VOCABULARY)
    assert files.shards == 2 and token_ids.read_ids(docs, files).count() == 6


def test_repeated_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    files = token_ids.write_ids(docs, VOCABULARY)
    assert sorted((r["key"], r["start"]) for r in token_ids.read_ids(docs, files).collect()) == [("1", 0), ("1", 2), ("1", 4), ("2", 6)]
    small = token_ids.write_ids(docs, VOCABULARY, shard_bytes=1)
    assert sorted((r["key"], r["start"]) for r in token_ids.read_ids(docs, small).collect()) == [("1", 0), ("1", 2), ("1", 4), ("2", 6)]
    assert {r["key"]: r["copies"] for r in token_ids.lookup(docs, files).collect()} == {"1": 3, "2": 1}
    nothing = token_ids.write_ids(docs.limit(0), VOCABULARY)
    assert token_ids.read_ids(docs, nothing).count() == 0


def test_many_places_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    files = token_ids.write_ids(docs, VOCABULARY, shard_bytes=200)
    wanted = sorted(token_ids.read_ids(docs, files).collect())
    assert len(wanted) == 60
    monkeypatch.setattr(token_ids, "NAMED_PLACES", 10)
    assert sorted(token_ids.read_ids(docs, files).collect()) == wanted


def test_library_ids_of_whole_batches():
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() and c != 10]
    known = re.sub(r"x\{(.*?)\}", lambda m: "u" + m[1].zfill(4), token_ids._SPACE)
    assert re.fullmatch(f"[{known}]+", "".join(spaces))
    rng = random.Random(5)
    bits = [*"ab .,'!\n\t", " ", "\n", "\n\n", "  ", "\u00a0", "\u2003", "\x1c", "\u180e", "don't", "l\u2019\u00e9t\u00e9", "\u00e9.", "\u6587", "\u00bd", "12,", "\u0378.", "!" * 20, "\U0001f600", "\u0301", "_", "<|endoftext|>"]
    texts = [None, "", " ", "\n", "\n\n", "a\n", "a\n\n", "a\n\n\nb", "\na", " a", "a \nb", "a\n b", "a\t\nb", *("".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(4000))]
    for plain in (False, True):
        encoder = token_ids.LibraryEncoder(VOCABULARY, "<u2", plain)
        for some in (texts[:7], texts, texts[2000:]):
            want = [np.array(x.ids, "<u2").tobytes() for x in encoder.model.encode_batch_fast([x or "" for x in some], add_special_tokens=False)]
            assert encoder.encode(pa.array([None, *some], pa.string()).slice(1)).to_pylist() == want
    assert encoder.encode(pa.array([], pa.string())).to_pylist() == []


def test_words_go_to_the_library_once(monkeypatch):
    encoder = token_ids.LibraryEncoder(VOCABULARY, "<u2")
    sent, library = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: sent.extend(texts) or library(texts))
    encoder.encode(pa.array(["so Wort, Wort. Wort!!\nZeile Wort\nZeile; Wort"]))
    encoder.encode(pa.array(["so Wort.\nZeile, Wort"]))
    assert "".join(sent).count("Wort") == 1 and "".join(sent).count("Zeile") == 1


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 20_000):
        h1, h2 = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        sizes, bits = token_ids.perfect_hash(h1, h2)
        counts = np.bitwise_count(bits).astype(np.int64)
        at = token_ids.slots(h1, h2, sizes, bits, np.cumsum(counts) - counts)
        assert sorted(at.tolist()) == list(range(n))


def test_edits_count_as_a_full_count(library):
    counter = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for text in texts(300, 7, 60):
        doc = token_counts.Document(text, counter)
        for _ in range(8):
            a = rng.randint(0, len(doc.text) + 1)
            b = a + rng.choice([0, 0, 1, 2, 9, 60])
            put = "".join(rng.choices(PARTS, k=rng.choice([0, 0, 1, 3])))
            wanted = doc.text[:a] + put + doc.text[b:]
            doc.edit(a, b, put)
            assert doc.text == wanted
            assert doc.tree.arrays()[0].tolist() == [len(w) for w in counter.pattern.findall(wanted)]
            assert doc.tree.n_tokens == len(library.encode_ordinary(wanted)) == doc.tree.tokens[1]


def test_edit_of_a_long_text_is_local():
    counter = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    doc = token_counts.Document("some words and more of them, " * 5000, counter)
    assert doc.edit(70_000, 70_003, "other") < 12
    assert len(doc.tree.changed) <= 2  # all other chunks stay as they were


def test_count_frames(spark, library):
    edits = [(0, 2, "X"), (5, 9, None)]
    rows = [(1, "Hello out there", edits, "kept"), (2, None, None, None), (3, "", [(0, 0, "new text")], "k"), (4, None, [(None, None, "a b")], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,put:string>>, other string")
    state = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["n_tokens"] for r in state.collect()} == {1: len(library.encode_ordinary("Hello out there")), 2: 0, 3: 0, 4: 0}
    after = {r["doc_id"]: r for r in token_counts.apply_edits(state, RANKS, public_tokenizers.PATTERN).collect()}
    assert [after[k]["text"] for k in (1, 2, 3, 4)] == ["Xllo there"[:5] + "Xllo out there"[9:], None, "new text", "a b"]
    for r in after.values():
        assert r["n_tokens"] == len(library.encode_ordinary(r["text"] or ""))
    assert token_counts.count_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
