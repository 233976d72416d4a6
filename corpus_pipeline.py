"""The corpus pipeline: stages applied in order to `documents`, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
docs. Rows without doc_id go through all stages: exact dedup treats them as any others, near dedup keeps them, the mix draws
them. Rows that repeat a doc_id are documents of their own until near dedup, which keeps or drops all rows of a doc_id alike.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.bpe import bpe_documents
from lattica.llm.common import discard, documents, stage_path, staged, without_ids
from lattica.llm.exact import without_duplicates
from lattica.llm.langid import UNDETERMINED, learned, predicted
from lattica.llm.mix import mixed_shards
from lattica.llm.near import near_duplicates

#: A language that is less likely than this is not accepted.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; texts without a letter, null ones and undecided ones go."""
    told = docs.withColumn("_told", predicted(F.col("text"), learned(docs)))
    return told.where((F.col("_told.lang_pred") != UNDETERMINED) & (F.col("_told.score") >= LEAST_SCORE)).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return without_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five words a shingle, similarity 0.8. Rows without doc_id stay."""
    told = near_duplicates(docs, words=5, percent=80).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without_ids(docs, staged(told.where("NOT kept").select("doc_id"), "near-dropped")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, the last ones of a source cut to the words taken; n_chars is of the text as it is then."""
    return mixed_shards(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bpe_documents(docs)


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mix", mix),
    ("BPE", encode),
]

#: SQL can't express the language model and the merges of the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir; what a stage wrote goes when the next one has read it."""
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        at = stage_path(spark, "pipeline-" + name.replace(" ", "-"))
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        if before:
            discard(spark, before)
        before = at
    return docs
