"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases are those of the operators.  A row without id is kept by every stage that can't decide about it; rows that
repeat with id and text count once from near-duplicate removal on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.common import as_struct, discard, settled, table
from gridspark.llm.langid import UNKNOWN, language_id
from gridspark.llm.mixing import remixed
from gridspark.llm.neardup import near_duplicates
from gridspark.llm.packing import pack_documents
from gridspark.llm.repeats import cleaned

#: A text of which the best language explains less than this share of n-grams is in none of the learnt languages.  Of 10,000
#: documents in learnt languages (with secrets, junk and capitals among them) the least score was 0.55; texts in other scripts,
#: keyboard noise and base64 came to 0.06 at most.
LEAST_SCORE = 0.3


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    told = language_id(docs, docs.columns)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near-duplicates.  A row without id stays unless a row with an id, or an
    earlier one without, has the same text."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    rows = as_struct(docs, doc_id=F.col("doc_id").cast("long"), digest=F.md5(F.encode("text", "UTF-8")))
    named = rows.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "digest"])
    nameless = rows.where("doc_id is null").join(rows.where("doc_id is not null").select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    return named.select("doc").unionByName(nameless.select("doc")).select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of over 50 words that stand elsewhere too."""
    return _counted(cleaned(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at its target weights."""
    return _counted(remixed(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequences and offsets; copy (from 1) tells apart the rows of one doc_id, such as epochs."""
    text = F.xxhash64("text")
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text)).orderBy(text)
    return pack_documents(docs.withColumn("copy", F.row_number().over(same)), keep_ids=True, copy_col="copy")


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs


STAGES = [
    ("language_id", keep_identified),
    ("minhash_neardup", keep_one_of_each_group),
    ("run_index_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("config_lp_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, before, sf_dir), name)  # noqa: B023
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
