"""Queries of the corpus operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layoutlint.llm import bpe, decontam, langid, line_dedup, minhash, quotes, sharding, token_counts, token_ids, winnowing


#: Bytes of an Arrow batch in the sessions of these queries: JVM and Python worker hold one or two each.
ARROW_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's content, read on the driver; tasks get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    return sharding.shard(docs, ["doc_id", "text_crc32", "size"], 16, seed=1).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_token_ids(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_ids.write_ids(docs, tokenizer_file(spark, path), end_id=0)
    kind = docs.schema["doc_id"].dataType
    return token_ids.read_ids(docs, files).select(
        F.col("key").cast(kind).alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.train(docs.where(fold != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Counts of every whole text before and after three edits: a cut at a third, a word doubled in the middle, a sentence added at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = tokenizer_file(spark, path)
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda a, b, put: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), put.alias("put"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = F.array(
        edit(third, third + F.least(F.lit(20), n), F.lit("")),
        edit(half, half, F.substring(F.coalesce("text", F.lit("")), half.cast("int") + 1, F.lit(12))),
        edit(n, n, F.lit(" It ends here.")),
    )
    state = token_counts.count_tokens(docs.withColumn("edits", edits), ranks, public_tokenizers.PATTERN)
    before = state.withColumns({"n_before": F.col("n_tokens"), "n_pretokens": F.col("n_encoded")})
    after = token_counts.apply_edits(before, ranks, public_tokenizers.PATTERN)
    return after.select(
        "doc_id", F.col("n_before").alias("n_tokens"), "n_pretokens", F.col("n_tokens").alias("n_tokens_edited"), F.size("seg_tokens").cast("long").alias("n_pretokens_edited"), "n_encoded"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


OP5_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), r as (
  select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), m as (
  select k.doc_id, k.pos, k.line, r.top is not null and r.top <> k.doc_id as gone from k left join r on k.key = r.key
)
select doc_id, count(*) as n_lines, sum(case when gone then 1 else 0 end)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tail = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    own = lambda df: winnowing.fingerprints(df, hashes_col="own", positions_col="own_at")
    docs = winnowing.with_next(docs, "doc_id", ["text"], derive=own).withColumn("edited", edited)
    docs = winnowing.fingerprints(docs, "edited", hashes_col="new", positions_col="new_at")
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sha256(F.col("edited")).alias("edited_sha256"),
        winnowing.fingerprint_text(F.col("own")).alias("fingerprint"), winnowing.fingerprint_text(F.col("new")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), F.col("new")).alias("near_edited"), winnowing.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.size("own_at").alias("n_positions"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_WORDS = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
OP7_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
p as (
  select item, array_to_string(w, ' ') as g, len(w) as n from b where len(w) between 1 and 9
  union all
  select item, array_to_string(w[i:i+9], ' '), 10 from (select item, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
), lens as (select distinct n from p),
g as (
  select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)
), h as (select distinct g.doc_id, g.i, g.n, p.item from g join p on g.g = p.g and g.n = p.n),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hit.n_hit, 0)::bigint as n_hit, coalesce(items.n_items, 0)::bigint as n_items,
  sha256(coalesce(items.items, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join items on d.doc_id = items.doc_id
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return quotes.link_replies(messages).select(
        "conv_id", "turn", "role", "parent_pos", "by", "root_pos", "depth", "seq", "quoted_lines", "quote_depth", "linked", "body"
    )


def op9_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = tokenizer_file(spark, path)
    done = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as s
  from w
), n as (select doc_id, len(s)::bigint as n from s),
e as (select doc_id, unnest(s) as g from s),
i as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from i join n a on u = a.doc_id join n b on v = b.doc_id where 100 * c >= 80 * (a.n + b.n - c)),
reach(id, r) as (select doc_id, doc_id from n union select links.v, reach.r from reach join links on links.u = reach.id)
select n.doc_id, n.n as n_shingles, min(r) as component_id, n.doc_id = min(r) as kept from n join reach on n.doc_id = reach.id group by n.doc_id, n.n
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_token_ids": op2_token_ids,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_winnowing": op6_winnowing,
    "op7_decontamination": op7_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_bpe": op9_bpe,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
}
