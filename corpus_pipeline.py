"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

In every stage a null text counts as empty, columns other than doc_id and text are carried and may hold
anything, rows that repeat are rows of their own unless the stage drops copies, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontaminate, exact_dedup, quality, simhash
from tidewright.llm.common import cut, drop_cut, keep, read, scratch
from tidewright.llm.queries import byte_bpe


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, doesn't reject. Empty texts score by
    the share of label 1; without labels nothing is rejected. Null ids and labels teach nothing."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the document with the largest doc_id; a null doc_id is the
    smallest. Rows that repeat id and text collapse to one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest doc_id:
    SimHash fingerprints, buckets of covering masks, minima for pairs beyond their radius, exact
    similarity. Texts without words, and rows without doc_id, stay."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, within its error budget. Empty items occur nowhere;
    an empty benchmark leaves all."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text that they decode to. Empty
    texts have no tokens and stay."""
    out = bpe.round_trip(docs, *byte_bpe())
    digests = F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_le", *digests)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("tokenize", tokenize),
]

#: Neither the classifier nor the fingerprints nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents: one row per document that stays."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):  # what a stage wrote on its way goes with it
            docs = keep(cut(stage(spark, docs, sf_dir), name))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids_le")
