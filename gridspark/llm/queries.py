"""The registered queries opN_<name> and their SQL.  Each derives its columns from its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.topk import threshold_topk

    return threshold_topk(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op2_licence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its digest and licence, if it is one, and how many of its lines are known notices."""
    from gridspark.llm.licences import notices, scanned

    docs = table(spark, sf_dir, "documents")
    lines = notices(docs).groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.min("licence_id").alias("notice_id"))
    return scanned(docs).join(lines, "doc_id", "left").select("doc_id", "digest", "licence_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "notice_id")


def op3_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.gif import media_columns, stored

    media = media_columns(stored(table(spark, sf_dir, "documents")))
    sums = F.aggregate("colour_histograms", F.array_repeat(F.lit(0), 16), lambda a, h: F.zip_with(a, F.slice(h, 1, 16), lambda x, y: x + y))  # red: the files are grey
    return media.select(
        "doc_id", "n_bytes", F.octet_length("red").cast("long").alias("payload_bytes"), F.sha2("red", 256).alias("payload_sha256"), F.crc32(F.substring("red", -32, 32)).alias("tail_crc32"),
        F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"), F.array_join(F.transform(sums, lambda x: x.cast("string")), ":").alias("feature"),
    )


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.langid import held_out, language_id

    docs = table(spark, sf_dir, "documents")
    return language_id(docs, ["doc_id"]).select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


def op7_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without 400-byte strings that stand elsewhere too; beside it the words of passages of over 50 words that do."""
    from gridspark.llm.repeats import WORDS, deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), counted=(WORDS,))


def op8_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents shuffled and written as shards; size and digest are those of the rows read back."""
    from gridspark.llm.sharding import free_name, sharded, stored_shards

    docs = table(spark, sf_dir, "documents")
    shard, slot = (free_name(x, docs.columns) for x in ("shard", "slot"))
    back = stored_shards(sharded(docs, 40), shard, slot)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return back.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.llm.quality import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_licence_digest, op3_gif_columns, op4_minhash_neardup, op5_config_lp_packing, op6_bitmask_langid, op7_run_index_dedup, op8_two_pass_shuffle, op9_source_mix, op10_importance_resampling)}



def _licence_sql() -> str:
    import csv

    from gridspark.llm.licences import DIGESTS, SPELLINGS

    holder = r"^[^a-z0-9]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by |<|\[)|(?:\(c\)|©)[ \t]*[0-9]{4}|all rights reserved\.?[ \t]*$)"

    def canon(x: str) -> str:
        lines = f"array_to_string(list_transform(string_split(lower({x}), chr(10)), lambda l: case when regexp_matches(l, '{holder}') then '' else l end), chr(10))"
        out = f"' ' || regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    with DIGESTS.open() as f:
        known = ", ".join(f"('{r['digest']}', '{r['licence_id']}')" for r in csv.DictReader(f))
    return f"""
with known(digest, licence_id) as (values {known}),
lines as (select doc_id, unnest(string_split(text, chr(10))) as l from documents),
hits as (select doc_id, count(*) as n_notices, min(licence_id) as notice_id from
         (select doc_id, sha256({canon("l")}) as digest from lines) x join known using (digest) group by 1),
docs as (select doc_id, sha256({canon("text")}) as digest from documents)
select doc_id, digest, licence_id, coalesce(n_notices, 0) as n_notices, notice_id from docs left join known using (digest) left join hits using (doc_id)"""


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Every shingle of every document, every pair that shares one, and the least id that links reach.
_NEAR_SQL = f"""
with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a.doc_id as a, b.doc_id as b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
          where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join least using (doc_id)"""

#: Every string of 400 bytes (as hexadecimal digits) and every passage of 51 words.
_REPEATS_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select doc_id, unnest(range(0, len(x) // 2 - 399)) as pos, x from d where len(x) >= 800),
k as (select doc_id, pos, md5(substr(x, 2 * pos + 1, 800)) as h from b),
r as (select doc_id, pos from k where h in (select h from k group by h having count(*) > 1)),
e as (select doc_id, pos, coalesce(pos > lag(pos) over (partition by doc_id order by pos) + 400, true) as fresh from r),
g as (select doc_id, pos, sum(fresh::int) over (partition by doc_id order by pos) as span from e),
spans as (select doc_id, min(pos) as lo, max(pos) + 400 as hi from g group by doc_id, span),
gaps as (select doc_id, hi as lo, lead(lo) over (partition by doc_id order by lo) as hi from spans
         union all select doc_id, 0, min(lo) from spans group by 1),
left_ as (select doc_id, coalesce(string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(hi, len(x) // 2) - lo)), '' order by lo), '') as x from gaps join d using (doc_id) group by 1),
cut as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from spans group by 1),
v as (select doc_id, unnest(range(0, len(w) - 50)) as pos, w from d where len(w) >= 51),
p as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 51], ' ')) as h from v),
q as (select doc_id, pos from p where h in (select h from p group by h having count(*) > 1)),
words as (select doc_id, sum(least(coalesce(nxt - pos, 51), 51)) as n from (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as nxt from q) group by 1)
select doc_id, (len(d.x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(left_.x, d.x))) as kept_sha256, coalesce(words.n, 0)::bigint as n_repeated_words
from d left join cut using (doc_id) left join left_ using (doc_id) left join words using (doc_id)"""

ORACLES = {
    "op2_licence_digest": _licence_sql(),
    "op4_minhash_neardup": _NEAR_SQL,
    "op7_run_index_dedup": _REPEATS_SQL,
    "op1_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rk, vec_id, score from s)
select query_id, rk::int as "rank", vec_id, score from r where rk <= 5""",
}
