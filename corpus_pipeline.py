"""Corpus pipeline: five stages over documents, each an operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run()
writes as Parquet in the shared folder and reads again for the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshmill.llm.bpe import bpe_round_trip
from threshmill.llm.common import cut, table
from threshmill.llm.ngram_jaccard import ngram_jaccard_join
from threshmill.llm.repeat_spans import remove_repeats
from threshmill.llm.source_mix import mix_sources, passes
from threshmill.llm.toxicity import toxicity
from threshmill.operators.select import numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic. Null and empty texts stay unless most examples without a known word are toxic; equal rows share their fate, and without labels all stay."""
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies. Rows without a doc_id stay, as nothing tells them apart.

    Where doc_ids repeat, rows alike in doc_id and text are one, and the others
    stand in order of doc_id under numbers of their own: unlike texts of one
    doc_id both stay, and each goes only if it is a near copy itself.
    """
    known, unknown = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL").select(*COLUMNS)
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = _least_of_components(docs, docs)
    else:
        one = known.groupBy("doc_id", "text").agg(F.min_by(F.struct("lang", "source", "n_chars"), F.xxhash64("lang", "source", "n_chars")).alias("d")).select("doc_id", "text", "d.*")
        rows = cut(numbered(one, [F.col("doc_id"), F.xxhash64("text"), F.col("text")], "row")).select(F.col("doc_id").alias("own_id"), F.col("row").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
        every = rows.select("doc_id", "text").unionByName(docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text"))
        kept = _least_of_components(every, rows).withColumn("doc_id", F.col("own_id"))
    return kept.select(*COLUMNS).unionByName(unknown)


def _least_of_components(every: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose doc_id is the smallest of its component among every document."""
    keep = ngram_jaccard_join(every).where("doc_id = component_id").select("doc_id").distinct()
    return rows.join(keep.hint("shuffle_hash"), "doc_id", "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under any 35-word window that starts at two places or more; n_chars follows the text.

    A null text stays null, a short one as it is. Equal rows are places of their
    own, so such windows go from both. Nulls in other columns stay.
    """
    out = remove_repeats(docs, k=35, carry=("lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's demand takes it, range-sorted by training position.

    The plan is made on narrow rows; texts are shuffled to it once and once more
    for the order. Of equal rows one text travels, and the plan has a row for
    each read of each of them. Nulls in any column are values like others; a
    document whose source has no words is read at no time. Ties in position go
    by doc_id, then by the read's number.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    every = passes(mix_sources(keyed, carry=("row_key",))).select("row_key", "pass", "position")
    joined = keyed.dropDuplicates(["row_key"]).join(every.hint("shuffle_hash"), "row_key")
    return joined.orderBy("position", "doc_id", "pass").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each read of a document. A null text has no token; equal rows give equal rows, an empty table none."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_by_weight),
    ("bpe", encode),
]

#: SQL can't express the toxicity stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
