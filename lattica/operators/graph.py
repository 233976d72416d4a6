"""Graph operators: degrees, lookups, reachability, paths, trees, cycles. All take nodes and edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import BUILTIN_LABELS, HUB_FLOOR, IMPORTS, WALKED
from .staging import written

#: A frontier of at most so many rows is sent to all executors; a larger one is joined by shuffle.
SMALL_FRONTIER = 100_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, a loop once, parallel ones each; 0 for a node without."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id")))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


def plain_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"^\.+|[()]+$", "")


def is_noise(label: Column, kind: Column, file_type: Column) -> Column:
    bare = plain_label(F.coalesce(label, F.lit("")))
    return F.coalesce(kind.isin("file", "module", "section", "concept"), F.lit(False)) | F.coalesce(file_type.isin("document", "paper", "image"), F.lit(False)) | bare.isin(*BUILTIN_LABELS) | (bare == "")


def god_nodes(nodes: DataFrame, n: int = 15) -> DataFrame:
    """The n symbols of highest degree; nodes have a degree."""
    return nodes.where(~is_noise(F.col("label"), F.col("kind"), F.col("file_type"))).orderBy(F.desc("degree"), "id").limit(n)


def resolve_node(nodes: DataFrame, label: str) -> DataFrame:
    """(id, tier, n_files, message) of what a label names: exact, then prefix, then part of label or slug; more than one file in the tier is ambiguous."""
    q = label.strip().lower().removesuffix("()").lstrip(".")
    name, slug = plain_label(F.coalesce("norm_label", "label")), F.lower(F.coalesce("slug", F.lit("")))
    tier = F.when((name == q) | (slug == q), 0).when(name.startswith(q) | slug.startswith(q), 1).when(name.contains(q) | slug.contains(q), 2)
    hit = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    per = hit.groupBy("tier").agg(
        F.countDistinct("source_file").alias("n_files"), F.max_by("id", F.struct(F.coalesce("degree", F.lit(0)), -F.col("id"))).alias("id"),
        F.array_join(F.slice(F.array_sort(F.collect_set("source_file")), 1, 5), ", ").alias("files"),
    )
    best = per.orderBy("tier").limit(1)
    return best.select(F.when(F.col("n_files") <= 1, F.col("id")).alias("id"), F.col("tier").cast("int").alias("tier"), F.col("n_files").cast("long").alias("n_files"), F.when(F.col("n_files") > 1, F.concat(F.lit("ambiguous: "), "files")).alias("message"))


def _sized(frontier: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frontier) if rows <= SMALL_FRONTIER else frontier


def reach(edges: DataFrame, seeds: DataFrame, depth: int, closed: DataFrame | None = None) -> DataFrame:
    """(id, hop): least number of steps src -> dst from the seeds (id), which have hop 0; nodes in `closed` are reached but not left, seeds aside.

    Level by level: each level is written, joined with the edges and stripped of what was seen, so that no node is walked
    twice, cycles end and a lost executor costs one level.
    """
    seen = written(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "reach")
    frontier, rows = seen, seen.count()
    for hop in range(1, depth + 1):
        if not rows:
            break
        start = frontier.select(F.col("id").alias("src"))
        if closed is not None and hop > 1:
            start = start.join(closed.select(F.col("id").alias("src")), "src", "left_anti")
        step = edges.select("src", "dst").join(_sized(start, rows), "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        rows = frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def affected(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, relations: list[str] = WALKED) -> DataFrame:
    """(id, label, source_file, hop) of what depends on the seeds (id): against the edges, up to `depth` steps, seeds left out."""
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = reach(back, seeds, depth).where("hop > 0")
    return nodes.join(hit, "id").select("id", "label", "source_file", F.col("hop").cast("int").alias("hop"))


def hub_limit(nodes: DataFrame) -> DataFrame:
    """One row, `hub`: the degree at place int(0.99 n) of all, HUB_FLOOR at least; from counts per degree, so no sort of the nodes."""
    per = nodes.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    at = F.least(total - 1, F.floor(total * 0.99).cast("long"))
    return per.withColumns({"u": upto, "at": at}).where("u > at").agg(F.greatest(F.min("degree"), F.lit(HUB_FLOOR)).cast("long").alias("hub"))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hop) around the seeds, edges walked both ways; a hub that is no seed isn't walked through."""
    hubs = nodes.join(F.broadcast(hub_limit(nodes)), F.col("degree") >= F.col("hub")).select("id")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reach(both, seeds, depth, hubs)


def touched_edges(edges: DataFrame, visited: DataFrame, hubs: DataFrame, depth: int) -> DataFrame:
    """Edges, in their true direction, met when walking from visited (id, hop) nodes that were left."""
    left = visited.where(F.col("hop") < depth).join(hubs, "id", "left_anti").unionByName(visited.where("hop = 0").join(hubs, "id", "left_semi"))
    out = edges.join(left.select(F.col("id").alias("src")), "src", "left_semi")
    return out.unionByName(edges.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select(*out.columns)).distinct()


def shortest_path(edges: DataFrame, source: int, target: int, max_hops: int = 8, directed: bool | None = None) -> DataFrame:
    """One row (hops, path, relations) or none: fewest steps, then the least path; directed=None tries both ways only where no directed path is. A step against an edge has relation ~."""
    forward = edges.select("src", "dst", "relation")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("~").alias("relation"))
    steps = forward if directed in (True, None) else forward.unionByName(back)
    spark = edges.sparkSession
    at = spark.createDataFrame([(source, [source], [])], "id long, path array<long>, relations array<string>")
    seen = at.select("id")
    for hop in range(max_hops + 1):
        hit = at.where(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select(F.lit(hop).alias("hops"), "path", "relations")
        if hop == max_hops:
            break
        rows = at.count()
        if not rows:
            break
        met = steps.join(_sized(at, rows), steps["src"] == at["id"]).groupBy("src", "dst").agg(F.max("relation").alias("relation"), F.min(F.struct("path", "relations")).alias("b"))  # one path a node
        grown = met.select(F.col("dst").alias("id"), F.concat("b.path", F.array("dst")).alias("path"), F.concat("b.relations", F.array("relation")).alias("relations"))
        best = grown.groupBy("id").agg(F.min(F.struct("path", "relations")).alias("b")).select("id", "b.path", "b.relations")
        at = written(best.join(seen, "id", "left_anti"), "path")
        seen = written(seen.unionByName(at.select("id")), "path-seen")
    if directed is None:
        return shortest_path(edges, source, target, max_hops, False)
    return spark.createDataFrame([], "hops int, path array<long>, relations array<string>")


def tree(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, label, depth, sort_key): containment outline from nodes that nothing contains, down to the last level (max_depth None); children by location, then id. A node doesn't contain what contains it."""
    held = edges.where(F.col("relation").isin("contains", "method")).select("src", "dst").distinct()
    key = F.concat(F.coalesce("source_location", F.lit("")), F.lit(":"), F.lpad(F.col("id").cast("string"), 20, "0"))
    named = nodes.select("id", "label", key.alias("k"))
    level = named.join(held.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "label", F.lit(0).alias("depth"), F.col("k").alias("sort_key"))
    level = written(level, "tree")
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        child = level.select(F.col("id").alias("src"), "sort_key").join(held, "src").join(named.select(F.col("id").alias("dst"), "label", "k"), "dst")
        child = child.where(~F.array_contains(F.split("sort_key", "/"), F.col("k")))
        level = written(child.select(F.col("dst").alias("id"), "label", F.lit(depth).alias("depth"), F.concat("sort_key", F.lit("/"), "k").alias("sort_key")), "tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def import_cycles(edges: DataFrame, file_of: DataFrame, max_len: int = 6, top: int = 20, relations: list[str] = IMPORTS) -> DataFrame:
    """(length, files): simple cycles between files, each from its least file on, shortest first. file_of: (id, source_file)."""
    src, dst = file_of.select(F.col("id").alias("src"), F.col("source_file").alias("a")), file_of.select(F.col("id").alias("dst"), F.col("source_file").alias("b"))
    steps = edges.where(F.col("relation").isin(*relations)).join(src, "src").join(dst, "dst").select("a", "b").where("a <> b").distinct()
    return cycles(written(steps, "cycle-steps"), max_len).orderBy("length", "files").limit(top)


def cycles(steps: DataFrame, max_len: int = 6) -> DataFrame:
    """(length, files) of all simple cycles of (a, b) pairs up to max_len, from their least member on. Paths only grow over members above their first, so each cycle is found once."""
    paths = steps.where("a < b").select(F.col("a").alias("first"), F.col("b").alias("last"), F.array("a", "b").alias("files"))
    found = None
    for _ in range(2, max_len + 1):
        closing = paths.join(steps, (paths["last"] == steps["a"]) & (paths["first"] == steps["b"])).select(F.size("files").alias("length"), "files")
        found = closing if found is None else found.unionByName(closing)
        paths = written(paths.join(steps, paths["last"] == steps["a"]).where((F.col("b") > F.col("first")) & ~F.array_contains("files", F.col("b"))).select("first", F.col("b").alias("last"), F.concat("files", F.array("b")).alias("files")), "cycle-paths")
    return found


def entry_points(edges: DataFrame) -> DataFrame:
    """(id): callers that nobody calls."""
    calls = edges.where("relation = 'calls'")
    return calls.select(F.col("src").alias("id")).distinct().join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def surprising_connections(nodes: DataFrame, edges: DataFrame, top: int | None = 8) -> DataFrame:
    """(src, dst, relation, score): edges across communities and top directories, or not sure; score 2 at least."""
    side = nodes.where(~F.coalesce(F.col("kind").isin("file", "module", "section"), F.lit(False))).select("id", "community", F.split("source_file", "/")[0].alias("root"))
    a = side.select(F.col("id").alias("src"), F.col("community").alias("ca"), F.col("root").alias("ra"))
    b = side.select(F.col("id").alias("dst"), F.col("community").alias("cb"), F.col("root").alias("rb"))
    met = edges.where(~F.col("relation").isin("contains", "method")).join(a, "src").join(b, "dst")
    doubt = F.when(F.col("confidence") == "AMBIGUOUS", 2).when(F.col("confidence") == "INFERRED", 1).otherwise(0)
    differ = lambda x, y: F.coalesce(F.col(x) != F.col(y), F.lit(False)).cast("int")
    out = met.withColumn("score", (differ("ca", "cb") + differ("ra", "rb") + doubt).cast("int")).where("score >= 2").select("id", "src", "dst", "relation", "score")
    return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)


def explain(nodes: DataFrame, edges: DataFrame, node_id: int, most: int = 25) -> DataFrame:
    """(direction, relation, other, label, confidence): up to `most` edges each way, by relation."""
    out = edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), "relation", F.col("dst").alias("other"), "confidence")
    come = edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "relation", F.col("src").alias("other"), "confidence")
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("relation", "other"))
    few = out.unionByName(come).withColumn("rank", rank).where(F.col("rank") <= most)
    return few.join(nodes.select(F.col("id").alias("other"), "label"), "other", "left").select("direction", "relation", "other", "label", "confidence")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    near = edges.where(F.col("src") == node_id).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == node_id).select("src")).distinct()
    return nodes.join(near, "id", "left_semi")


def context(nodes: DataFrame, edges: DataFrame, files: DataFrame, node_id: int, body_lines: int = 60, callees: int = 10, callers: int = 8) -> DataFrame:
    """(part, id, label, place, text): the node's lines, then signatures of callers and callees; `more` rows count what is left out. files: (path, content)."""
    from ..functions.scalars import location_end, location_start

    lines = files.select(F.col("path").alias("source_file"), F.split("content", "\n").alias("lines"))
    placed = nodes.select("id", "label", "source_file", location_start(F.col("source_location")).alias("a"), location_end(F.col("source_location")).alias("b"))
    body = placed.where(F.col("id") == node_id).join(lines, "source_file", "left")
    text = F.array_join(F.slice("lines", F.col("a"), F.least(F.col("b") - F.col("a") + 1, F.lit(body_lines))), "\n")
    parts = body.select(F.lit("body").alias("part"), "id", "label", F.concat_ws(":", "source_file", "a").alias("place"), text.alias("text"))
    calls = edges.where("relation = 'calls'")
    for part, here, there, most in (("caller", "dst", "src", callers), ("callee", "src", "dst", callees)):
        other = calls.where(F.col(here) == node_id).select(F.col(there).alias("id")).distinct().join(placed, "id")
        ranked = other.withColumns({"rank": F.row_number().over(Window.orderBy("source_file", "a", "id")), "all": F.count(F.lit(1)).over(Window.partitionBy())})
        shown = ranked.where(F.col("rank") <= most).join(lines, "source_file", "left")
        few = F.slice("lines", F.col("a"), F.lit(4))
        stop = F.array_position(F.transform(few, lambda x: F.rtrim(x).rlike(r"[:{]$|=>$|;$")), True)
        sign = F.trim(F.array_join(F.slice(few, 1, F.when(stop > 0, stop.cast("int")).otherwise(1)), " "))
        parts = parts.unionByName(shown.select(F.lit(part).alias("part"), "id", "label", F.concat_ws(":", "source_file", "a").alias("place"), sign.alias("text")))
        more = ranked.agg(F.max("all").alias("n")).where(F.col("n") > most).select(F.lit("more").alias("part"), F.lit(None).cast("long").alias("id"), F.lit(part).alias("label"), F.lit(None).cast("string").alias("place"), F.concat(F.lit("+"), F.col("n") - most).alias("text"))
        parts = parts.unionByName(more)
    return parts
