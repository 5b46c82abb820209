import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layoutlint.llm import components, decontam, langid, line_dedup, minhash, quotes, sharding, winnowing


def long_line(k):
    return f"This is the line number {k}, and it is long enough to count."


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lines = [rng.choice([long_line(rng.randint(0, 9)), " " + long_line(3).upper() + "\t", "short", "", "Élan " + long_line(2)]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines), i))
    rows += [(None, long_line(1), 0), (100, None, 0), (101, "", 0), (101, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for i, text, _ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    top = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    want = []
    for i, text, n in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        want.append((i, "\n".join(kept) if len(kept) < len(lines) else text, n, len(lines), len(lines) - len(kept)))
    got = [(r["doc_id"], r["text"], r["n"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[4] for w in want)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_scan(seq, items, size):
    hit, found = set(), set()
    for item, text in items:
        for w in decontam.windows(decontam.words(text), size):
            for i in range(len(seq) - len(w) + 1):
                if tuple(seq[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return hit, found


def test_wu_manber_against_brute_force():
    rng = random.Random(2)
    for size in (1, 2, 3, 5, 10):
        items = [(str(k), " ".join(rng.choices("ab", k=rng.randint(0, 12)))) for k in range(12)]
        tables = decontam.matchers(items, size)
        for _ in range(40):
            seq = decontam.words(" ".join(rng.choices("AbC", k=rng.randint(0, 60))))
            spans, found = decontam.scan(seq, tables)
            assert ({p for a, b in spans for p in range(a, b)}, found) == brute_scan(seq, items, size)
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_contamination_in_blocks(spark, block_bytes):
    items = [(1, "one two three four"), (2, "One, two; three FOUR!"), (3, None), (4, "..."), (10, "nine"), (None, "one two")]
    docs = spark.createDataFrame([(1, "say one two three four five nine", 7), (2, None, 7), (3, "", 7), (1, "nothing é", 7)], "doc_id long, text string, items int")
    out = decontam.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), window=3, block_bytes=block_bytes)
    got = sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["hit_spans"]], r["items"]) for r in out.collect())
    assert got == [(1, 2, [], []), (1, 7, [(1, 5), (6, 7)], ["1", "10", "2"]), (2, 0, [], []), (3, 0, [], [])]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in decontam.find_contamination(docs, empty).collect()] == [[]] * 4


def brute_grams(text):
    z = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    out = Counter()
    for n in langid.ORDERS:
        for i in range(len(z) - n + 1):
            h = n
            for c in z[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            h ^= h >> 29
            out[(h * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - langid.BITS)] += 1
    return out


@pytest.mark.parametrize("stretch", [1 << 18, 7, 3])
def test_grams_are_those_of_the_whole_text(monkeypatch, stretch):
    monkeypatch.setattr(langid, "_CHARS", stretch)
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choices(["a", "B", "é", " ", "  ", "!", "ß", "1", "\n"], k=rng.randint(0, 30)))
        assert Counter(np.concatenate(list(langid.gram_ids(text))).tolist()) == brute_grams(text)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    model = langid.train(train.unionByName(spark.createDataFrame([(1, None, "en"), (2, "text", None)], docs.schema)))
    out = langid.identify(held.withColumn("score", F.lit("x")), model).where(langid.has_letter(F.col("text")))
    total, right = out.count(), out.where("lang = lang_pred").count()
    assert right / total > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%%"), (4, "the of and")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert [found[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and found[4][0] == "en" and 0 < found[4][1] <= 1
    nobody = langid.identify(odd, langid.train(docs.limit(0)))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


def test_each_language_has_its_own_training_sample(spark):
    rng = random.Random(8)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))
    rows = [(say("abcde", 9), "aa") for _ in range(600)] + [("edcba " * 50, "aa")] * 300 + [(say("vwxyz", 9), "zz") for _ in range(4)] + [("12 %", "none")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string")
    whole, part = langid.train(docs), langid.train(docs, max_docs=100)
    assert whole.languages == part.languages == ("aa", "zz")
    assert np.allclose(np.exp(part.prior), [900 / 904, 4 / 904])
    counts = lambda texts: sum(np.bincount(ids, minlength=2**langid.BITS) for t in texts for ids in langid.gram_ids(t))
    for k, x in enumerate(whole.languages):
        want = counts({t for t, lang in rows if lang == x}) + 0.1
        assert np.allclose(whole.blocks[0][:, k], np.log(want / want.sum()), atol=1e-5)
    a, b = whole.blocks[0], part.blocks[0]
    assert np.array_equal(a[:, 1], b[:, 1]) and not np.array_equal(a[:, 0], b[:, 0])
    assert part.predict([say("vwxyz", 5), say("abcde", 5), "edcba"])[0] == ["zz", "aa", "aa"]


def test_languages_in_blocks_and_posterior_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    langs = {f"l{k}": [chr(97 + (3 * k + j) % 26) for j in range(4)] for k in range(7)}
    say = lambda x, n: " ".join("".join(rng.choices(langs[x], k=rng.randint(1, 5))) for _ in range(n))
    rows = [(say(x, 8), x) for x in langs for _ in range(rng.randint(3, 9))]
    docs = spark.createDataFrame(rows, "text string, lang string")
    tests = [say(x, rng.randint(1, 9)) for x in langs for _ in range(4)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(tests)], "doc_id long, text string")
    # the definition: shares of languages times the probabilities of all n-grams of the text
    counts, seen = {}, Counter(x for _, x in rows)
    for x in langs:
        counts[x] = Counter()
        for t in {t for t, y in rows if y == x}:
            counts[x].update(brute_grams(t))
    want = []
    for t in tests:
        joint = {}
        for x, c in counts.items():
            total = sum(c.values()) + 0.1 * 2**langid.BITS
            joint[x] = np.log(seen[x] / len(rows)) + sum(n * np.log((c[g] + 0.1) / total) for g, n in brute_grams(t).items())
        best = max(sorted(joint), key=joint.get)
        want.append((best, 1 / sum(np.exp(v - joint[best]) for v in joint.values())))
    for block, held in ((64, 4), (2, 4), (2, 1)):
        monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
        monkeypatch.setattr(langid, "HELD_BLOCKS", held)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame, langid.train(docs)).collect()}
        assert [got[k][0] for k in range(len(tests))] == [x for x, _ in want]
        assert np.allclose([got[k][1] for k in range(len(tests))], [v for _, v in want], atol=1e-3)


def test_clashing_names(spark):
    line = long_line(1)
    names = ["n_lines", "Changed", "__id", "drop_hashes", "all_lines", "id", "a", "b", "n", "salt", "top"]
    lines = spark.createDataFrame([(i, line, *[7] * len(names)) for i in range(6)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = line_dedup.dedup_lines(lines)
    assert len(set(out.columns)) == len(out.columns) and "Changed" not in out.columns
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["salt"], r["id"]) for r in out.collect()) == [(i, 1, int(i < 5), 7, 7) for i in range(6)]
    names = ["next_text", "__part", "key_range", "range_to", "range_first", "__to", "__k"]
    rows = spark.createDataFrame([(i, f"text {i}", *["x"] * len(names)) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r["doc_id"]: (r["next_text"], r["key_range"], r["__k"]) for r in winnowing.with_next(rows, "doc_id", ["text"], parts=3).collect()}
    assert got == {i: (f"text {(i + 1) % 5}", "x", "x") for i in range(5)}
    with pytest.raises(TypeError):
        winnowing.with_next(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", ["text"])
    names = ["__s", "__p", "__lines", "__at", "parsed_lines", "tree_scope", "tree_pos", "tree_root", "s", "p", "seq"]
    talk = spark.createDataFrame([(1, i, t, *["x"] * len(names)) for i, t in enumerate(["one\rtwo \x01 end\r\nlast", "> one\rtwo   end\n> last\nyes"])], "conv_id long, turn long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r["turn"]: r for r in quotes.link_replies(talk).collect()}
    assert got[0]["body"] == "one\rtwo \x01 end\r\nlast" and got[1]["body"] == "yes" and got[1]["__s"] == got[1]["tree_root"] == got[1]["__lines"] == "x"
    assert [got[k]["seq"] for k in (0, 1)] == [0, 1] and got[1]["parent_pos"] == 0


def test_heavy_lines_are_dealt_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{long_line(1)}\n{long_line(2 + i % 3)}\nown {i}") for i in range(60)] + [(None, long_line(1))], "doc_id long, text string")
    want = sorted(line_dedup.dedup_lines(docs).collect(), key=repr)
    monkeypatch.setattr(line_dedup, "HEAVY_HOLDERS", 15)
    monkeypatch.setattr(line_dedup, "HEAVY_LINES", 100)
    assert sorted(line_dedup.dedup_lines(docs).collect(), key=repr) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = lambda f, xs: sorted(sorted(g) for g in _by(f, xs).values())
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert groups(got.get, linked) == groups(find, linked)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _by(f, xs):
    out = defaultdict(list)
    for x in xs:
        out[f(x)].append(x)
    return out


def brute_near(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), d) if x is not None) if d is not None or find(i) in least else None
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.choice([6, 40, 150]))] + passage * (base % 2)
        for _ in range(rng.randint(1, 25)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Ab  c"), (904, "ab\tC"), (905, "c ab"), (None, "ab c"), (903, "ab c"), (906, "é ü " * 40), (906, "é ü " * 40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("kept", F.lit("clash"))
    got = minhash.near_duplicates(docs, words=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(rows, k, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_left_over_pairs_meet_at_rare_shingles_only(spark):
    rng = random.Random(12)
    hub, common = list(range(100)), list(range(1000, 1018))
    sets = {"hub": hub}
    for i in range(60):
        # 70 shingles of the hub, 18 that all have and 12 that few have; some are alike in all of these
        pool = random.Random(i // 3 if i < 12 else i)
        sets[f"n{i}"] = sorted([*pool.sample(hub, 70), *common, *pool.sample(range(2000, 2300), 12)])
    for i in range(0, 12, 3):
        sets[f"n{i}"] = sorted({*sets[f"n{i}"], *rng.sample(range(5000, 6000), 5)})
    frame = spark.createDataFrame([(k, len(v), v) for k, v in sets.items()], "node string, n long, shingles array<long>")
    rows = frame.selectExpr("1L as tkey", "node", "'hub' as hub", "n", "n as c", "node as root", "'hub' as main")
    near_hub = minhash._common(frame.where("node <> 'hub'").selectExpr("node as u", "'hub' as v"), frame)
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    found = {(r["u"], r["v"]) for r in minhash._left_over(rows, near_hub, frame, 80).collect()}
    assert len(alike) == 12 and alike <= found
    # what all have in common is left out, where the rest decides: else each of the 1,770 pairs meets there 18 times
    own = [("hub", k, len(v), len(v), k, sum(s in hub for s in v), s) for k, v in sets.items() if k != "hub" for s in v if s not in hub]
    count = Counter(s for *_, s in own)
    own = spark.createDataFrame([(*x, count[x[-1]]) for x in own if count[x[-1]] > 1], "hub string, node string, n long, c long, root string, a long, s long, k long")
    kept = minhash._prefixes(own, spark.createDataFrame([("hub", 100)], "hub string, lo long"), 80).collect()
    assert kept and not {r["s"] for r in kept} & {*common}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n"))
    both = rows.select("x", sharding.permuted(F.col("x"), F.col("n"), 3).alias("y"), "n").select("x", "y", sharding.permuted(F.col("y"), F.col("n"), 3, forward=False).alias("z"))
    got = both.collect()
    assert sorted(r["y"] for r in got) == list(range(n)) and all(r["x"] == r["z"] for r in got)
    assert n < 1000 or sum(r["x"] == r["y"] for r in got) < 20


def test_shards(spark):
    rows = [(i if i % 10 else None, f"t{i % 50}", "s") for i in range(333)] + [(5, "t5", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(docs, ["doc_id", "text"], 7).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 336 and set(slots) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(5), ["doc_id", "text"], 7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert sharding.shard(docs.limit(0), ["doc_id"], 7).count() == 0


def test_write_shards(spark, tmp_path):
    docs = sharding.shard(spark.range(1000).toDF("doc_id"), ["doc_id"], 3)
    sharding.write_shards(docs, str(tmp_path / "s"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 1000 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def brute_winnow(grams, w):
    out = {}
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        least = min(window)
        out[i + max(j for j, g in enumerate(window) if g == least)] = least
    return sorted(out.items())


def test_winnowing(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", " \n ", "One", "one", "A b", "x " * 100]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, chosen_grams int")
    grams = docs.withColumn("g", winnowing._grams(F.coalesce("text", F.lit("")), winnowing.GRAM))
    got = winnowing.fingerprints(grams).collect()
    for r in got:
        hashes = [g >> 31 for g in r["g"]]
        want = brute_winnow(hashes, winnowing.WINDOW)
        assert r["positions"] == [p for p, _ in want]
        assert r["fingerprint"] == list(dict.fromkeys(h for _, h in want))
    by = {r["doc_id"]: r for r in got}
    assert by[63]["fingerprint"] == by[64]["fingerprint"] and by[60]["fingerprint"] == by[61]["fingerprint"]
    assert winnowing.fingerprints(docs.limit(0)).count() == 0


def test_grams_of_stretches(spark):
    rng = random.Random(10)
    k, one = winnowing.GRAM, winnowing.STRETCH
    sizes = [0, 1, k - 1, k, k + 1, *(m + d for m in (one, 2 * one, 40 * one) for d in range(-1, k + 2))]
    texts = ["".join(rng.choices("abé中😀", k=n)) for n in sizes]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select("text", winnowing._grams(F.col("text"), k).alias("g"))
    seen = {}
    for text, got in docs.collect():
        runs = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
        assert [winnowing._POSITIONS - (g & winnowing._POSITIONS) for g in got] == list(range(len(runs)))
        assert all(seen.setdefault(run, g >> 31) == g >> 31 >= 0 for run, g in zip(runs, got, strict=True))
    assert len({*seen.values()}) == len(seen)


def test_shared_passages_share_a_fingerprint(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows = []
    for i in range(40):
        passage = [word() for _ in range(winnowing.GRAM + winnowing.WINDOW - 1)]
        rows += [(i, " ".join([word() for _ in range(rng.randint(0, 30))] + passage + [word() for _ in range(rng.randint(0, 30))])) for _ in range(2)]
    out = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    for i in range(40):
        a, b = [set(r["fingerprint"]) for r in out if r["doc_id"] == i]
        assert a & b


def test_fingerprints_of_unspaced_and_short_texts(spark):
    rng = random.Random(9)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200))
    texts = [chinese, "กขคงจฉชซฌญฎฏฐฑฒณดต", "".join(rng.choices("0123456789abcdef", k=500)), "four words are enough", "Use port 8080"]
    rows = [(t, t[: len(t) - len(t) // 4] + "#" * (len(t) // 4)) for t in texts]
    docs = winnowing.fingerprints(spark.createDataFrame(rows, "a string, b string"), "a", hashes_col="x", positions_col="p")
    out = winnowing.fingerprints(docs, "b", hashes_col="y", positions_col="q").withColumn("near", winnowing.likeness(F.col("x"), F.col("y"))).collect()
    assert all(len(r["x"]) > 1 and r["near"] > 0 for r in out)
    assert out[0]["near"] > 0.5 and len(out[0]["x"]) > 30
    # grams are told apart by all of their characters
    text = "abcdefg abcdefg abcdefh"
    grams = [text[i : i + winnowing.GRAM] for i in range(len(text) - winnowing.GRAM + 1)]
    hashes = [g >> 31 for g in spark.range(1).select(winnowing._grams(F.lit(text), winnowing.GRAM).alias("g")).first()["g"]]
    assert [hashes.index(h) for h in hashes] == [grams.index(g) for g in grams]


@pytest.mark.parametrize("parts", [2, 5, 50])
def test_next_row(spark, parts):
    keys = [*range(0, 90, 3), None]
    docs = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(4)
    out = winnowing.with_next(docs, "doc_id", ["text"], parts=parts).collect()
    order = [None, *sorted(k for k in keys if k is not None)]
    want = {f"t{a}": f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r["text"]: r["next_text"] for r in out} == want
    one = docs.limit(1)
    assert [r["text"] == r["next_text"] for r in winnowing.with_next(one, "doc_id", ["text"], parts=parts).collect()] == [True]
    assert winnowing.with_next(docs.limit(0), "doc_id", ["text"], parts=parts).count() == 0


def test_each_range_of_keys_is_a_task(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "string(id) as text")
    out = winnowing.with_next(docs, "doc_id", ["text"], derive=lambda d: d.withColumn("task", F.spark_partition_id()), parts=8)
    assert {r["task"] for r in out.select("task").distinct().collect()} == {*range(8)}
    assert out.where("next_text <> string((doc_id + 1) % 400)").count() == 0


def test_quotes(spark):
    ask = "How do I sort a very large file on disk?\n\nIt has many lines, more than memory holds."
    reply = "On Monday Ann wrote:\n> How do I sort a very\n> large file on disk?\nUse an external merge sort, in two passes.\n\n> It has many lines, more than memory holds.\nThat is fine for it."
    nested = "Ben wrote:\n> On Monday Ann wrote:\n>> How do I sort a very large file on disk?\n> Use an external merge sort, in two passes.\nThank you, that worked at once."
    other = "I would not do it at all, by the way."
    late = "> How do I sort a very large file on disk?\nThere is a tool for that in every system."
    rows = [("a", 0, ask), ("a", 1, reply), ("a", 2, other), ("a", 3, nested), ("a", 4, late), ("b", 0, ask), ("b", 1, None), (None, 0, "> unknown words of someone\nhi"), ("a", None, late), ("a", 4, late)]
    out = quotes.link_replies(spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, text string, depth int")).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    parent = {k: (r["parent_pos"], r["by"]) for k, r in got.items()}
    assert parent == {
        ("a", 0): (None, None), ("a", 1): (0, "quote"), ("a", 2): (1, "order"), ("a", 3): (1, "quote"), ("a", 4): (0, "quote"),
        ("b", 0): (None, None), ("b", 1): (0, "order"), (None, 0): (None, None), ("a", None): (None, None),
    }
    assert got["a", 3]["body"] == "Thank you, that worked at once." and got["a", 3]["quote_depth"] == 2 and got["a", 3]["quoted_lines"] == 3
    assert got["a", 1]["body"] == "Use an external merge sort, in two passes.\n\nThat is fine for it."
    assert [got["a", k]["depth"] for k in range(5)] == [0, 1, 2, 2, 1] and [got["a", k]["seq"] for k in range(5)] == list(range(5))
    assert got["b", 1]["body"] == "" and got[None, 0]["linked"] == 0 and got[None, 0]["body"] == "hi"
    assert quotes.link_replies(spark.createDataFrame([], "conv_id string, turn int, text string")).count() == 0


def test_short_quotes_decide_where_nothing_longer_does(spark):
    long = "A question that is longer than the least length."
    rows = [
        "Use port 8080", "端口应该是八零八零", long, "Anything else?", "> Use port 8080\nThat works.", "> 端口应该是八零八零\n好的", f"> {long}\n> Use port 8080\n\n> Anything else?\nNo.", "> \n>\nempty", "> unknown\nhm",
    ]
    out = {r["turn"]: r for r in quotes.link_replies(spark.createDataFrame([(1, k, t) for k, t in enumerate(rows)], "conv_id long, turn long, text string")).collect()}
    assert [(out[k]["parent_pos"], out[k]["by"]) for k in range(4, 9)] == [(0, "quote"), (1, "quote"), (2, "quote"), (6, "order"), (7, "order")]
    assert [out[k]["linked"] for k in range(4, 9)] == [1, 1, 3, 0, 0]


def test_long_reply_chain_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 4)
    rows = [(1, k, f"> This is the message number {k - 1}, long enough.\nThis is the message number {k}, long enough.") for k in range(40)]
    out = {r["turn"]: r for r in quotes.link_replies(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert all(out[k]["parent_pos"] == k - 1 and out[k]["by"] == "quote" and out[k]["depth"] == k and out[k]["seq"] == k and out[k]["root_pos"] == 0 for k in range(1, 40))
