"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame operations only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, staged

#: Share of all words that the mix has, how often a word may be taken, and blocks that a source is cut into; as many parts has the block in which a source's words end.
SHARE, REPEATS, BLOCKS = 1.5, 2, 1024
#: Output shards, a power of two: LEAST_SHARDS, doubled as long as one has more than SHARD_WORDS words.
LEAST_SHARDS, SHARD_WORDS = 8, 4_000_000


def _number(seed: str, *parts: Column) -> Column:
    """52 bits of a digest of the parts: the same in every engine and every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, weight, source_size, target) of sized (source, size): one row per source, a null source among them.

    Weights are 3, 1, 2, repeating over the sources by code point, null last. The targets share `share` times all sizes by
    weight; a target stops at `repeats` times its source's size and its excess is shared again. They are min(cap, w * level)
    for one level: over the sources by cap / w, the first at which the words left, over the weights left, are not above its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(repeats).cast("long") * F.col("source_size"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (F.least(total * F.lit(float(share)), (total * F.lit(repeats)).cast("double")) - capped) / left)
    per = per.withColumn("ends", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.coalesce(F.first("ends", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max("level").over(Window.partitionBy()))
    return per.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "weight", "source_size", "target")


def split_quotas(slots: DataFrame, shards: int, seed: str) -> DataFrame:
    """slots (any columns and a unique string `slot`) with a shard: halved level by level until there are `shards` leaves or more.

    A slot stands for one block of a source's quota, not for a certain block. At each node the slots are put in an order by
    digest and the first half goes left: the counts of each source on the left are a draw from the multivariate
    hypergeometric distribution, and quotas stay exact. The root orders all slots, at most repeats * BLOCKS of each source.
    """
    out, level, width = slots.withColumn("shard", F.lit(0)), 0, 1
    while width < shards:
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(_number(f"{seed}-{level}", F.col("slot")), "slot"))
        n = F.count(F.lit(1)).over(node)
        out = out.withColumns({"rank": rank, "n": n}).withColumn("shard", F.col("shard") * 2 + (F.col("rank") > F.floor((F.col("n") + 1) / 2)).cast("int")).drop("rank", "n")
        width, level = width * 2, level + 1
    return out


class Mixture(NamedTuple):
    """sized: _id, _source, _size, _block, _part, _mark of each row; targets: see source_targets; draws: of each drawn block of a
    source, whole (copy, shard of each time that all of it is taken) and edge (copy, shard where it is the source's last, else null);
    parts: of the last blocks, `left`, the words that are left where each part begins."""

    sized: DataFrame
    targets: DataFrame
    draws: DataFrame
    parts: DataFrame
    shards: int
    seed: str


def _sized(docs: DataFrame, blocks: int, seed: str) -> DataFrame:
    """docs with source and size, the block and part that a digest of doc_id and size gives, and a mark of the text for ties."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_source": F.col("source").cast("string"), "_size": size, "_mark": F.xxhash64("text")})
    return out.withColumns({f"_{k}": F.pmod(_number(f"{seed}-{k}", F.col("_id"), F.col("_size")), F.lit(blocks)) for k in ("block", "part")})


_ADDED = ["_id", "_source", "_size", "_block", "_part", "_mark"]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mixture(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, blocks: int = BLOCKS, shards: int | None = None, seed: str = "mix", sized: DataFrame | None = None) -> Mixture:
    """What the mix takes of docs (doc_id, text, source).

    A source's documents fall into permuted blocks by a digest of doc_id and text size. Its quota is the number of blocks whose
    words make its target: whole passes have every block, the last pass those that come first in the pass's order until the
    words left end. The tree splits the quotas among the shards, which fixes how many blocks of each source a shard draws; the
    shards then draw, one after another, disjoint stretches of the source's permuted blocks, pass by pass. Of the block where
    the words end documents are taken part by part and one by one, in digest order; one document gives only its first words,
    so that a source's taken words are its target, rounded down.

    Null texts and empty ones have size 0 and are never drawn; a null source is a source; a repeated row, or one without
    doc_id, is a document of its own. An empty table draws nothing. shards None: LEAST_SHARDS or more, of SHARD_WORDS at most.
    sized: what _sized adds to docs, where it lies staged.
    """
    sized = staged(_sized(docs, blocks, seed).select(*_ADDED), "mix-sized") if sized is None else sized.select(*_ADDED)
    targets = staged(source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")), share, repeats), "mix-targets")
    total = targets.agg(F.sum("target")).first()[0] or 0
    if shards is None:
        shards = LEAST_SHARDS
        while shards * SHARD_WORDS < total:
            shards *= 2
    per = sized.groupBy("_source", "_block").agg(F.sum("_size").alias("words")).where("words > 0")
    passes = F.floor(F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))).cast("int")
    told = per.join(targets, _same("_source", "source")).select("_source", "_block", "words", passes.alias("passes"), (F.floor("target").cast("long") - passes * F.col("source_size")).alias("left"))
    copies = told.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    turn = Window.partitionBy("_source", "copy").orderBy(_number(f"{seed}-order", F.col("_source"), F.col("copy"), F.col("_block")), "_block")
    before = F.coalesce(F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = copies.withColumns({"turn": F.row_number().over(turn), "before": before}).where("copy < passes OR before < left")
    place = F.row_number().over(Window.partitionBy("_source").orderBy("copy", "turn"))
    drawn = staged(drawn.select("_source", "_block", "copy", place.alias("place"), F.expr("copy < passes OR before + words <= left").alias("all"), (F.col("left") - F.col("before")).alias("left")), "mix-quotas")

    slots = drawn.select("_source", F.concat_ws("|", "place", F.coalesce("_source", F.lit("-"))).alias("slot"))
    quotas = split_quotas(slots, shards, seed).groupBy("_source", "shard").agg(F.count(F.lit(1)).alias("quota"))
    upto = F.sum("quota").over(Window.partitionBy("_source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    stretch = quotas.withColumn("upto", upto).select(F.col("_source").alias("s"), "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("p"))
    taken = drawn.join(stretch, _same("_source", "s") & (F.col("place") == F.col("p")))
    turns = F.collect_list(F.when(F.col("all"), F.struct("copy", "shard")))
    draws = taken.groupBy("_source", "_block").agg(F.array_sort(turns).alias("whole"), F.max(F.when(~F.col("all"), F.struct("copy", "shard"))).alias("edge"), F.max(F.when(~F.col("all"), F.col("left"))).alias("left"))
    draws = staged(draws, "mix-draws")

    ends = draws.where("edge IS NOT NULL").select(F.col("_source").alias("s"), F.col("_block").alias("b"), "left")
    parts = sized.join(ends, _same("_source", "s") & (F.col("_block") == F.col("b"))).groupBy("_source", "_part", "left").agg(F.sum("_size").alias("words"))
    by_part = Window.partitionBy("_source").orderBy(_number(f"{seed}-turn", F.col("_source"), F.col("_part")), "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.select("_source", "_part", (F.col("left") - F.coalesce(F.sum("words").over(by_part), F.lit(0))).alias("left")), "mix-parts")
    return Mixture(sized, targets, draws.drop("left"), parts, shards, seed)


def _with_draws(rows: DataFrame, m: Mixture) -> DataFrame:
    """rows (with what _sized adds) with whole, edge, and last: the words taken of the row in the edge copy. Only rows of a source's last block are put in an order, part by part."""
    drawn = m.draws.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "whole", "edge")
    where = _same("_source", "_s") & (F.col("_block") == F.col("_b"))
    plain = rows.join(drawn, where, "left").where("edge IS NULL").drop("_s", "_b").withColumn("last", F.lit(0).cast("long"))
    parts = m.parts.select(F.col("_source").alias("_t"), F.col("_part").alias("_p"), "left")
    edge = rows.join(drawn.where("edge IS NOT NULL"), where).drop("_s", "_b").join(parts, _same("_source", "_t") & (F.col("_part") == F.col("_p"))).drop("_t", "_p")
    turn = Window.partitionBy("_source", "_block", "_part").orderBy(_number(f"{m.seed}-in", F.col("_id"), F.col("_size")), "_id", "_size", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left") - F.coalesce(F.sum("_size").over(turn), F.lit(0))
    edge = edge.withColumn("last", F.greatest(F.lit(0), F.least("_size", left)).cast("long")).drop("left")
    return plain.unionByName(edge)


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs repeated as drawn, cut to the words taken (n_chars, where there is one, follows), each shard in its own random order; columns of docs, then _copy, _shard."""
    sized = staged(_sized(docs, options.get("blocks", BLOCKS), options.get("seed", "mix")), "mix-rows")  # words are counted once: filters on a size that is not staged count them again
    m = mixture(docs, **options, sized=sized)
    rows = _with_draws(sized.where("_size > 0"), m)
    whole = F.transform(F.coalesce("whole", F.array().cast("array<struct<copy:int,shard:int>>")), lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), F.col("_size").alias("words")))
    last = F.when(F.col("last") > 0, F.array(F.struct(F.col("edge.copy").alias("copy"), F.col("edge.shard").alias("shard"), F.col("last").alias("words")))).otherwise(F.array().cast("array<struct<copy:int,shard:int,words:bigint>>"))
    out = rows.withColumn("_turn", F.explode(F.concat(whole, last)))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), F.col("_turn.words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("_turn.words") >= F.col("_size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_turn.copy").alias("_copy"), F.col("_turn.shard").alias("_shard"), _number(f"{m.seed}-place", F.col("_id"), F.col("_turn.copy")).alias("_place"))
    return out.repartitionById(m.shards, "_shard").sortWithinPartitions("_shard", "_place").drop("_place")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_summary(documents(spark, sf_dir))


def mix_summary(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, the words taken of this row, how often it is drawn, and the shards of its first and last copy (null: none)."""
    m = mixture(docs, **options)
    rows = _with_draws(m.sized, m)
    times = F.when(F.col("_size") > 0, F.coalesce(F.size("whole"), F.lit(0))).otherwise(F.lit(0))
    first = F.when(times > 0, F.element_at("whole", 1)["shard"]).when(F.col("last") > 0, F.col("edge.shard"))
    final = F.when(F.col("last") > 0, F.col("edge.shard")).when(times > 0, F.element_at("whole", -1)["shard"])
    return rows.join(m.targets, _same("_source", "source")).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (times * F.col("_size") + F.col("last")).cast("long").alias("taken"),
        (times + (F.col("last") > 0).cast("int")).cast("int").alias("draws"), first.cast("int").alias("first_shard"), final.cast("int").alias("last_shard"),
    )


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM per
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
             - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighed
), ends AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM ends) * weight) AS target FROM levels
), height AS (
  SELECT CAST(greatest(log2({LEAST_SHARDS}), ceil(log2(greatest(1, sum(target)) / {SHARD_WORDS}))) AS INTEGER) AS levels FROM targets
), b AS (
  SELECT *, ('0x' || substr(md5('mix-block|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || size), 1, 13))::BIGINT % {BLOCKS} AS block,
         ('0x' || substr(md5('mix-part|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || size), 1, 13))::BIGINT % {BLOCKS} AS part FROM d
), blocks AS (
  SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM b GROUP BY source, block HAVING sum(size) > 0
), told AS (
  SELECT k.*, CAST(floor(t.target / t.source_size) AS BIGINT) AS passes,
         CAST(floor(t.target) AS BIGINT) - CAST(floor(t.target / t.source_size) AS BIGINT) * t.source_size AS words_left
  FROM blocks k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, unnest(range(passes + 1)) AS copy FROM told
), turns AS (
  SELECT *, ('0x' || substr(md5('mix-order|' || coalesce(source, '-') || '|' || copy || '|' || block), 1, 13))::BIGINT AS digest FROM copies
), turned AS (
  SELECT *, coalesce(CAST(sum(words) OVER (PARTITION BY source, copy ORDER BY digest, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
         row_number() OVER (PARTITION BY source, copy ORDER BY digest, block) AS turn FROM turns
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY copy, turn) AS place, (copy < passes OR before + words <= words_left) AS whole
  FROM turned WHERE copy < passes OR before < words_left
), tree AS (
  SELECT source, place || '|' || coalesce(source, '-') AS slot, CAST(0 AS BIGINT) AS shard, 0 AS level FROM drawn
  UNION ALL
  SELECT source, slot, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('mix-' || level || '|' || slot), 1, 13))::BIGINT, slot)
                                         > (count(*) OVER (PARTITION BY shard) + 1) // 2 THEN 1 ELSE 0 END, level + 1
  FROM tree WHERE level < (SELECT levels FROM height)
), leaves AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard) AS place FROM tree WHERE level = (SELECT levels FROM height)
), draws AS (
  SELECT n.source, n.block, n.copy, n.whole, n.words_left - n.before AS left_here, q.shard
  FROM drawn n JOIN leaves q ON n.source IS NOT DISTINCT FROM q.source AND n.place = q.place
), per_block AS (
  SELECT source, block, count(*) FILTER (whole) AS times, arg_min(shard, copy) FILTER (whole) AS first_whole, arg_max(shard, copy) FILTER (whole) AS last_whole,
         max(shard) FILTER (NOT whole) AS edge, max(left_here) FILTER (NOT whole) AS left_here FROM draws GROUP BY source, block
), parts AS (
  SELECT b.source, b.part, max(p.left_here) AS left_here, CAST(sum(b.size) AS BIGINT) AS words
  FROM b JOIN per_block p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block WHERE p.edge IS NOT NULL GROUP BY b.source, b.part
), part_turns AS (
  SELECT source, part, left_here - coalesce(CAST(sum(words) OVER (PARTITION BY source
           ORDER BY ('0x' || substr(md5('mix-turn|' || coalesce(source, '-') || '|' || part), 1, 13))::BIGINT, part
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_part FROM parts
), placed AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN b.size > 0 THEN coalesce(p.times, 0) ELSE 0 END AS times, p.first_whole, p.last_whole, p.edge,
         CASE WHEN p.edge IS NULL THEN 0 ELSE greatest(0, least(b.size, q.left_part - coalesce(CAST(sum(b.size) OVER (PARTITION BY b.source, b.block, b.part
           ORDER BY ('0x' || substr(md5('mix-in|' || coalesce(CAST(b.doc_id AS VARCHAR), '-') || '|' || b.size), 1, 13))::BIGINT, b.doc_id, b.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))) END AS last
  FROM b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
  LEFT JOIN per_block p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block
  LEFT JOIN part_turns q ON b.source IS NOT DISTINCT FROM q.source AND b.part = q.part
)
SELECT doc_id, size, source_size, target, CAST(times * size + last AS BIGINT) AS taken, CAST(times + CAST(last > 0 AS INTEGER) AS INTEGER) AS draws,
       CAST(CASE WHEN times > 0 THEN first_whole WHEN last > 0 THEN edge END AS INTEGER) AS first_shard,
       CAST(CASE WHEN last > 0 THEN edge WHEN times > 0 THEN last_whole END AS INTEGER) AS last_shard
FROM placed
"""
