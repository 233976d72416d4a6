"""Precise tiers: references from a SCIP index or a language server, as joins on positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import location_end, location_start

SCIP_SCHEMA = "documents array<struct<relative_path: string, occurrences: array<struct<range: array<int>, symbol: string, symbol_roles: int>>>>"


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, symbol, roles) of a SCIP index in JSON; lines from 1."""
    raw = spark.read.schema(SCIP_SCHEMA).json(path, multiLine=True)
    return occurrences(raw)


def occurrences(index: DataFrame) -> DataFrame:
    docs = index.select(F.explode("documents").alias("d")).select(F.col("d.relative_path").alias("path"), F.posexplode("d.occurrences").alias("place", "o"))
    return docs.select("path", "place", (F.col("o.range")[0] + 1).alias("line"), F.col("o.symbol").alias("symbol"), F.coalesce("o.symbol_roles", F.lit(0)).alias("roles"))


def graph_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, source_file): an index's path to the graph's: the same, else one ends with the other, else the same name; the first by name. Suffixes are exploded, so all three are equi-joins."""
    from ..functions.scalars import path_suffixes

    a = paths.select("path").distinct()
    b = nodes.select("source_file").where("source_file IS NOT NULL").distinct()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    same = a.join(b, a["path"] == b["source_file"]).select("path", "source_file", F.lit(0).alias("rank"))
    longer = a.join(b.select("source_file", F.explode(path_suffixes(F.col("source_file"))).alias("s")), F.col("path") == F.col("s")).select("path", "source_file", F.lit(1).alias("rank"))
    shorter = a.select("path", F.explode(path_suffixes(F.col("path"))).alias("s")).join(b, F.col("s") == F.col("source_file")).select("path", "source_file", F.lit(1).alias("rank"))
    base = a.join(b, name(a["path"]) == name(b["source_file"])).select("path", "source_file", F.lit(2).alias("rank"))
    every = same.unionByName(longer).unionByName(shorter).unionByName(base)
    return every.groupBy("path").agg(F.min_by("source_file", F.struct("rank", "source_file")).alias("source_file"))


def enclosing(points: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Points (source_file, line, ...) with node_id, the innermost node whose lines hold them: latest start, then earliest end, then least id. `key` names a point.

    Which of two spans is the inner one doesn't depend on the point, so each aligned block of 2**k lines keeps only the
    innermost of the spans that it takes to make up their lines (at most two blocks of each size a span). A distinct line
    of a file asks the blocks that hold it, one of each size, and points find their line's answer: no pairs of points and spans.
    """
    spans = nodes.where("kind <> 'file'").select(F.col("id").alias("node_id"), F.col("source_file").alias("_f"), location_start(F.col("source_location")).cast("long").alias("_a"), location_end(F.col("source_location")).cast("long").alias("_b"))
    spans = spans.where("_a <= _b").groupBy("_f", "_a", "_b").agg(F.min("node_id").alias("node_id"))
    longest = spans.agg(F.max(F.col("_b") - F.col("_a") + 1)).first()[0] or 0
    blocks, asked = [], []
    for k in range(longest.bit_length()):
        first, after = F.shiftright(F.col("_a") + (2**k - 1), k), F.shiftright(F.col("_b") + 1, k)
        block = lambda c, k=k: F.struct(F.lit(k).alias("k"), c.alias("n"))
        blocks += [F.when((first < after) & (first.bitwiseAND(1) == 1), block(first)), F.when((first < after) & (after.bitwiseAND(1) == 1), block(after - 1))]
        asked.append(block(F.shiftright(F.col("line").cast("long"), k)))
    none = F.array().cast("array<struct<k:int,n:bigint>>")
    each = spans.withColumn("_at", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull()) if blocks else none))
    kept = each.groupBy("_f", F.col("_at.k").alias("_k"), F.col("_at.n").alias("_n")).agg(F.min(F.struct((-F.col("_a")).alias("a"), F.col("_b").alias("b"), "node_id")).alias("_s"))
    lines = points.select("source_file", "line").distinct()
    ask = lines.withColumn("_at", F.explode(F.array(*asked) if asked else none)).select("source_file", "line", F.col("_at.k").alias("_k"), F.col("_at.n").alias("_n"))
    found = ask.withColumnRenamed("source_file", "_f").join(kept, ["_f", "_k", "_n"]).groupBy("_f", F.col("line").alias("_line")).agg(F.min("_s").alias("_s"))
    hit = points.join(found, (F.col("source_file") == F.col("_f")) & (F.col("line") == F.col("_line")))
    rest = [c for c in points.columns if c not in key]
    best = F.min_by(F.struct(*rest, "_s.node_id"), F.col("_s"))
    return hit.groupBy(*key).agg(best.alias("_p")).select(*[F.col(c) if c in key else F.col(f"_p.{c}").alias(c) for c in points.columns], F.col("_p.node_id").alias("node_id"))


def scip_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of occurrences (path, place, line, symbol, roles): from the node that holds a reference to the one that holds the symbol's first definition. Role bit 1 defines, bit 2 imports."""
    at = found.join(graph_paths(found, nodes), "path").where(~F.col("symbol").startswith("local "))
    placed = enclosing(at, nodes, ["path", "place"])
    is_def = F.col("roles").bitwiseAND(1) == 1
    defs = placed.where(is_def).groupBy("symbol").agg(F.min_by("node_id", F.struct("path", "place")).alias("dst"))
    refs = placed.where(~is_def).join(defs, "symbol").where("node_id <> dst")
    kind = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    relation = F.when(F.col("roles").bitwiseAND(2) == 2, "imports").when(F.col("dst_kind").isin("function", "method"), "calls").otherwise("references")
    return _exact(refs.join(kind, "dst").withColumn("relation", relation).withColumn("src", F.col("node_id")), "scip")


def _exact(rows: DataFrame, evidence: str) -> DataFrame:
    context = F.when(F.col("relation") == "calls", "call").when(F.col("relation") == "imports", "import").otherwise("reference")
    return rows.select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), context.alias("context"), "source_file", F.concat(F.lit("L"), "line").alias("source_location"), F.lit(evidence).alias("evidence")).distinct()


def lsp_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of references (node_id, source_file, line) that a language server gave for definitions."""
    named = refs.withColumnRenamed("node_id", "dst")
    placed = enclosing(named, nodes, ["dst", "source_file", "line"]).where("node_id <> dst")
    kind = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    relation = F.when(F.col("dst_kind").isin("function", "method"), "calls").otherwise("references")
    return _exact(placed.join(kind, "dst").withColumn("relation", relation).withColumn("src", F.col("node_id")), "lsp")


def with_tier(edges: DataFrame, new: DataFrame, evidence: str) -> DataFrame:
    """Edges of a tier replaced as a whole, so that a second run changes nothing."""
    return edges.where(~F.col("evidence").eqNullSafe(F.lit(evidence))).unionByName(new, allowMissingColumns=True)
