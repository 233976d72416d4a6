"""Health checks, statistics, suggested questions, feedback, federation and pull-request impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decay
from ..plans.model import OUTCOMES
from .community import doc_fraction, sizes
from .graph import affected, entry_points, god_nodes
from .staging import spread


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, communities, extracted, inferred, ambiguous, and present files."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities"))
    count = lambda c: F.coalesce(F.sum((F.col("confidence") == c).cast("long")), F.lit(0)).alias(c.lower())
    e = edges.agg(F.count(F.lit(1)).alias("edges"), count("EXTRACTED"), count("INFERRED"), count("AMBIGUOUS"))
    out = n.crossJoin(e)  # one row each
    return out if files is None else out.crossJoin(files.where("status = 'present'").agg(F.count(F.lit(1)).alias("files")))


def confidence_share(edges: DataFrame) -> DataFrame:
    """(confidence, n, percent): half to even."""
    total = F.sum("n").over(Window.partitionBy())
    return edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.bround(F.col("n") * 100.0 / total, 0).cast("int"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("id").union(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id")).distinct()


def slug_collisions(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def files_without_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    code = files.where("file_type = 'code' AND status = 'present'").select(F.col("path").alias("source_file"))
    return code.join(nodes.select("source_file").distinct(), "source_file", "left_anti")


def diagnose(nodes: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame, head: str = "", built: str = "") -> DataFrame:
    """(check, value, ok) of eight health checks."""
    n, m, raw = nodes.count(), edges.count(), refs.count()
    one = lambda df: (df.first() or [0])[0] or 0
    cross = one(edges.where(F.col("evidence").isin("xfile-import", "xfile-infer")).agg(F.count(F.lit(1))))
    corrected = one(edges.where(F.col("evidence").isin("xfile-import", "xfile-infer", "xfile-recv")).agg(F.count(F.lit(1))))
    top = one(sizes(nodes).agg(F.max("n")))
    sure = one(edges.where("confidence = 'EXTRACTED'").agg(F.count(F.lit(1))))
    loose, collisions, bare = dangling(edges, nodes).count(), slug_collisions(nodes).count(), files_without_nodes(files, nodes).count()
    rows = [
        ("has nodes", float(n), n > 0),
        ("code files without nodes", float(bare), bare == 0),
        ("cross-file ratio", cross / raw if raw else 0.0, raw < 20 or cross / raw >= 0.15),
        ("cross-file ratio with receivers", corrected / raw if raw else 0.0, raw < 20 or corrected / raw >= 0.15),
        ("largest community", top / n if n else 0.0, not n or top / n <= 0.6),
        ("extracted share", sure / m if m else 0.0, m < 20 or sure / m >= 0.4),
        ("dangling edges", float(loose), loose == 0),
        ("slug collisions", float(collisions), True),
        ("commit", 0.0, not head or not built or head[:12] == built[:12]),
    ]
    return nodes.sparkSession.createDataFrame(rows, "check string, value double, ok boolean")


def suggested_questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, most: int = 10) -> DataFrame:
    """(place, question): about the best-connected symbols, entry points and cohesive communities of code; each text once."""
    gods = god_nodes(nodes, 5).select(F.lit(0).alias("part"), (-F.col("degree")).cast("double").alias("by"), F.concat(F.lit("What depends on "), "label", F.lit("?")).alias("question"))
    starts = nodes.join(entry_points(edges), "id").orderBy(F.desc("degree"), "id").limit(3).select(F.lit(1).alias("part"), (-F.col("degree")).cast("double").alias("by"), F.concat(F.lit("What happens when "), "label", F.lit(" runs?")).alias("question"))
    code = doc_fraction(nodes).where("doc_fraction < 0.5").join(communities.withColumnRenamed("id", "community"), "community").join(sizes(nodes).where("n >= 3"), "community")
    groups = code.orderBy(F.desc("cohesion"), "community").limit(3).select(F.lit(2).alias("part"), (-F.col("cohesion")).alias("by"), F.concat(F.lit("How does "), F.col("label"), F.lit(" work?")).alias("question"))
    every = gods.unionByName(starts).unionByName(groups).groupBy("question").agg(F.min(F.struct("part", "by")).alias("o"))
    place = F.row_number().over(Window.orderBy("o", "question"))  # eleven rows at most
    return every.withColumn("place", place).where(F.col("place") <= most).select("place", "question")


def reflect(log: DataFrame, now: Column, half_life: float = 30.0, corroboration: int = 2) -> DataFrame:
    """(node, score, pos, neg, last, lesson) from outcomes of answers, newer ones weighing more."""
    known = log.where(F.col("outcome").isin(*OUTCOMES)).withColumn("age", (now - F.col("ts")) / 86400.0)
    each = known.select(F.explode("source_nodes").alias("node"), "outcome", "ts", decay(F.col("age"), half_life).alias("w"))
    good = F.col("outcome") == "useful"
    per = each.groupBy("node").agg(
        F.sum(F.when(good, F.col("w")).otherwise(-F.col("w"))).alias("score"), F.sum(good.cast("long")).alias("pos"), F.sum((~good).cast("long")).alias("neg"), F.max("ts").alias("last")
    )
    return per.select("node", F.round("score", 3).alias("score"), "pos", "neg", "last", lesson(F.col("pos"), F.col("neg"), corroboration).alias("lesson"))


def lesson(pos: Column, neg: Column, corroboration: int = 2) -> Column:
    return F.when((pos > 0) & (neg > 0), "contested").when(pos >= corroboration, "preferred").when(pos > 0, "tentative").otherwise("dead_end")


def tagged(rows: DataFrame, tag: str, ids: list[str] = (), files: list[str] = ()) -> DataFrame:
    """Rows of a graph's table under the graph's name: digests of name and id in the columns `ids` (arrays too), the name before what `files` hold."""
    digest = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(tag), c), 1)
    kinds = dict(rows.dtypes)
    new = {c: F.transform(c, digest) if kinds[c].startswith("array") else digest(F.col(c)) for c in ids if c in kinds}
    return rows.withColumns(new | {c: F.concat(F.lit(tag + "/"), F.col(c)) for c in files if c in kinds})


def merge(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several graphs in one: slugs and files carry the graph's name, ids are digests of name and id."""
    tagged_nodes, tagged_edges = [], []
    for tag, (nodes, edges) in graphs.items():
        new = lambda c, t=tag: F.shiftrightunsigned(F.xxhash64(F.lit(t), F.col(c)), 1)
        at = lambda c, t=tag: F.concat(F.lit(t + "/"), F.col(c))
        tagged_nodes.append(nodes.withColumns({"id": new("id"), "slug": F.concat(F.lit(tag + ":"), "slug"), "source_file": at("source_file")}))
        tagged_edges.append(edges.withColumns({"id": new("id"), "src": new("src"), "dst": new("dst"), "source_file": at("source_file")}))
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return union(tagged_nodes), union(tagged_edges)


def edge_counts(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(relation, n, ids): edges and distinct edge ids of each relation. Of at most `rows` edges, where that is known."""
    each = spread(edges.select("relation", "id"), rows, "relation", "id").groupBy("relation", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("relation").agg(F.sum("n").alias("n"), F.count("id").alias("ids"))


def pr_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(source_file, nodes): symbols, by file, that depend on the changed files (source_file); those files left out."""
    seeds = nodes.join(changed.select("source_file").distinct(), "source_file", "left_semi").select("id")
    hit = affected(nodes, edges, seeds, depth)
    return hit.join(changed.select("source_file").distinct(), "source_file", "left_anti").groupBy("source_file").agg(F.count(F.lit(1)).alias("nodes"))


def triage(prs: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(number, title, blast_radius): pull requests (number, title, files) by how many files they reach. All walk at once, each with its own frontier."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    touched = prs.select("number", F.explode("files").alias("source_file"))
    seen = touched.join(nodes.select("id", "source_file"), "source_file").select("number", "id").distinct()
    front = seen
    for _ in range(depth):
        step = front.withColumnRenamed("id", "src").join(back, "src").select("number", F.col("dst").alias("id")).distinct()
        front = step.join(seen, ["number", "id"], "left_anti")
        seen = seen.unionByName(front)
    files = seen.join(nodes.select("id", "source_file"), "id").select("number", "source_file").distinct().join(touched, ["number", "source_file"], "left_anti")
    radius = files.groupBy("number").agg(F.count(F.lit(1)).alias("blast_radius"))
    return prs.select("number", "title").join(radius, "number", "left").select("number", "title", F.coalesce("blast_radius", F.lit(0)).alias("blast_radius")).orderBy(F.desc("blast_radius"), "number")
