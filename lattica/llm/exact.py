"""Exact duplicates by skew-safe combining, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, staged, without_ids

#: Copies of a text meet in so many parts before the parts meet; groups whose decisions are broadcast: the largest ones.
SALTS, LARGEST = 32, 10_000
_TOP = "36893488147419103232"  # 2 ** 65


def exact_duplicates(docs: DataFrame, salts: int = SALTS, largest: int = LARGEST) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. The row with the most code points in its original text stays,
    then the smallest doc_id (a null doc_id loses ties). A null text counts as empty; all empty and blank texts are one group.
    Rows that repeat a doc_id are rows of their own in group_size and all carry the same decision. An empty table gives an
    empty result; other columns are not read.

    Three stages, each grouping by the whole normalised text: Spark's partial aggregation combines inside each task; what
    tasks have of one text is merged under salts, a task's number modulo `salts`; the winners of the salts are combined. So a
    text that a third of all rows hold comes to a task of the second stage from one in `salts` tasks, once from each, and to
    the last stage at most `salts` times. Every text goes this way, at any size.

    Rows find their decision by sha-256, xxhash64 and length. Where two texts agree in all three, which the last stage shows,
    they find it by the text itself. The decisions of the `largest` largest groups are broadcast, so that no other group has
    more than one in `largest` of the rows on the key of the join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = docs.select("doc_id", F.length(text).alias("n_cp"), F.regexp_replace(text, SPACE, "").alias("norm"))
    keyed = norm.withColumns({"sha": F.unhex(F.sha2("norm", 256)), "check": F.xxhash64("norm"), "n_bytes": F.octet_length("norm")})
    key = ["sha", "check", "n_bytes"]
    small = staged(keyed.select("doc_id", "n_cp", *key), "exact-rows")

    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD"), F.expr("18446744073709551616BD"))
    best = F.col("n_cp").cast("decimal(10,0)") * F.expr(f"{_TOP}BD") - place
    parts = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*key, "norm", "salt").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = parts.groupBy(*key, "norm").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    n = f"CAST((best + {_TOP}BD - 1BD) div {_TOP}BD AS DECIMAL(10,0))"
    place_of = F.expr(f"{n} * {_TOP}BD - best")
    winners = winners.select(
        *key, "norm", "group_size", F.expr(f"CAST({n} AS INT)").alias("keep_cp"),
        F.when(place_of < F.expr("18446744073709551616BD"), (place_of - F.expr("9223372036854775808BD")).cast("long")).alias("keep_id"),
    )
    # one decision per digest; of digests with several texts the texts too
    each = F.struct("norm", "group_size", "keep_cp", "keep_id")
    alone = winners.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_cp").alias("keep_cp"), F.max("keep_id").alias("keep_id"))
    decisions = staged(alone, "exact-decisions")
    return _decided(docs, small, decisions, winners.select(*key, each.alias("each")), key, largest)


def _decided(docs: DataFrame, small: DataFrame, decisions: DataFrame, winners: DataFrame, key: list[str], largest: int) -> DataFrame:
    """The rows of `small` with their decisions."""
    top = staged(decisions.where("texts = 1").orderBy(F.col("group_size").desc(), "sha").limit(largest).drop("texts"), "exact-largest")
    rest = decisions.where("texts = 1").drop("texts").join(F.broadcast(top.select(*key)), key, "left_anti")
    big = small.join(F.broadcast(top), key)
    other = small.join(F.broadcast(top.select(*key)), key, "left_anti").join(rest, key)
    found = big.unionByName(other)
    clashes = decisions.where("texts > 1").select(*key)
    if clashes.limit(1).count():
        text = F.coalesce(F.col("text"), F.lit(""))
        norm = docs.select("doc_id", F.length(text).alias("n_cp"), F.regexp_replace(text, SPACE, "").alias("norm"))
        again = norm.withColumns({"sha": F.unhex(F.sha2("norm", 256)), "check": F.xxhash64("norm"), "n_bytes": F.octet_length("norm")}).join(clashes, key, "left_semi")
        per = winners.join(clashes, key, "left_semi").select(*key, "each.*")
        found = found.unionByName(again.join(per, [*key, "norm"]).select(*found.columns))
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group: of rows that agree in doc_id, length and text without white space too, the one with the least text.

    A doc_id of one row stays or goes by its decision alone. Rows without doc_id, or that repeat one, are found by their texts.
    """
    told = staged(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "exact-told")
    per = staged(told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("doc_id IS NULL OR n > 1 OR NOT kept"), "exact-others")
    out = without_ids(docs.where("doc_id IS NOT NULL"), per.where("doc_id IS NOT NULL").select("doc_id"))
    several = per.where("kept AND (doc_id IS NULL OR n > 1)").select(F.col("doc_id").alias("_several"))
    if several.limit(1).count():
        out = out.unionByName(_one_of_each(docs.join(several, F.col("doc_id").eqNullSafe(F.col("_several")), "left_semi"), told))
    return out


def _one_of_each(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of docs that told keeps, by doc_id and digest; of those with one digest the longest, then the least text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = told.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    marked = docs.withColumn("_own", F.sha2(F.regexp_replace(text, SPACE, ""), 256))
    same = F.col("_own") == F.col("_sha")
    mine = marked.join(kept, same & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    order = F.row_number().over(Window.partitionBy("_own").orderBy(F.length(text).desc(), F.col("doc_id").asc_nulls_last(), text))
    return mine.withColumn("_rank", order).where("_rank = 1").select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
