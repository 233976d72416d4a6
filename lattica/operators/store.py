"""The graph's store: immutable snapshots of tables and a pointer that is swapped at once; and what changes between snapshots."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import EDGE_KEY, TABLES

VERSION = 3


def node_id(source_file, slug, seq):
    """A 60-bit id of a node that doesn't change while its file, slug and number don't."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", source_file, slug, seq.cast("string")), 256), 1, 15), 16, 10).cast("long")


class Store:
    """Tables as Parquet under root/snap-*; root/CURRENT names the snapshot that readers see. A table that a commit doesn't name is taken over by reference."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.removeprefix("file://")
        os.makedirs(self.root, exist_ok=True)

    def manifest(self) -> dict:
        at = os.path.join(self.root, "CURRENT")
        if not os.path.exists(at):
            return {"version": VERSION, "tables": {}, "meta": {}}
        with open(at, encoding="utf-8") as f:
            found = json.load(f)
        if found["version"] != VERSION:
            raise ValueError(f"the store has schema version {found['version']}, not {VERSION}")
        return found

    def exists(self) -> bool:
        return os.path.exists(os.path.join(self.root, "CURRENT"))

    def table(self, name: str) -> DataFrame:
        at = self.manifest()["tables"].get(name)
        return self.spark.createDataFrame([], TABLES[name]) if at is None else self.spark.read.schema(TABLES[name]).parquet(at)

    def meta(self, key: str, default=None):
        return self.manifest()["meta"].get(key, default)

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None) -> None:
        """Writes the tables beside the old ones, then moves the pointer; a failure before that leaves all as it was."""
        old = self.manifest()
        snap = f"snap-{uuid.uuid4().hex}"
        paths = dict(old["tables"])
        for name, df in tables.items():
            at = os.path.join(self.root, snap, name)
            have = dict(df.dtypes)
            schema = self.spark.createDataFrame([], TABLES[name]).schema
            df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(at)
            paths[name] = at
        own = os.path.join(self.root, f"CURRENT-{uuid.uuid4().hex}")
        with open(own, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "tables": paths, "meta": old["meta"] | (meta or {})}, f)
        os.replace(own, os.path.join(self.root, "CURRENT"))

    def vacuum(self) -> None:
        """Drops snapshots that the pointer doesn't name."""
        used = {os.path.basename(os.path.dirname(p)) for p in self.manifest()["tables"].values()}
        for d in os.listdir(self.root):
            if d.startswith("snap-") and d not in used:
                shutil.rmtree(os.path.join(self.root, d), ignore_errors=True)

    def rebuild(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)
        os.makedirs(self.root, exist_ok=True)

    def clone(self, to: str) -> "Store":
        other = Store(self.spark, to)
        other.commit({n: self.table(n) for n in self.manifest()["tables"]}, self.manifest()["meta"])
        return other

    def protected(self) -> bool:
        """Whether there is work that a rebuild would lose: rationales or vectors."""
        return not self.table("nodes").where("rationale IS NOT NULL AND rationale <> ''").isEmpty() or not self.table("vec_cache").isEmpty()


def changed_files(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Rows of a scan (path, content_sha256) that are new or differ from the catalogue, or all."""
    known = files.where("status = 'present'").select("path", F.col("ast_hash").alias("known"))
    return scan.join(known, "path", "left").where(F.lit(force) | ~F.col("content_sha256").eqNullSafe(F.col("known"))).drop("known")


def file_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_sha256") -> DataFrame:
    """(key, status) of what was added, deleted or changed between two catalogues."""
    a, b = old.select(key, F.col(digest).alias("a"), F.lit(True).alias("in_a")), new.select(key, F.col(digest).alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status IS NOT NULL")


def replace_files(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame, origin: str = "ast") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files of `changed` (source_file) were extracted anew: their nodes of that origin go, with edges at them and edges whose site they are; then the new ones come, without dangling ends and doubles."""
    files = changed.select("source_file").distinct()
    touched = F.col("origin") == origin if origin != "ast" else F.col("origin").isin("ast", "stub")
    gone = old_nodes.where(touched).join(files, "source_file", "left_semi")
    nodes = old_nodes.join(gone.select("id"), "id", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    kept = old_edges.join(files, "source_file", "left_anti")
    edges = kept.unionByName(new_edges, allowMissingColumns=True)
    return nodes, clean_edges(edges, nodes)


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, no loop of an import relation, one for each key (a null place is a place)."""
    ids = nodes.select("id")
    live = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return live.where("NOT (src = dst AND relation IN ('imports', 'imports_from', 're_exports'))").dropDuplicates(EDGE_KEY)


def prune(nodes: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame, seen: DataFrame, keep_under: str = "out/") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All without what belongs to files that the scan `seen` (path) no longer has; the catalogue marks them deleted. Nothing under keep_under goes."""
    lost = files.where(~F.col("path").startswith(keep_under)).join(seen.select("path"), "path", "left_anti").select("path")
    by = lost.withColumnRenamed("path", "source_file")
    left = nodes.join(by, "source_file", "left_anti")
    status = files.join(lost.withColumn("lost", F.lit(True)), "path", "left").withColumn("status", F.when(F.col("lost"), "deleted").otherwise(F.col("status"))).drop("lost")
    return left, clean_edges(edges.join(by, "source_file", "left_anti"), left), refs.join(by, "source_file", "left_anti"), status


def lookup_slugs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src_slug, dst_slug, source_file, ...) with ids: of a slug's nodes the one in the edge's file, else the least id; edges with an end that is nowhere go."""
    local = nodes.groupBy("slug", "source_file").agg(F.min("id").alias("here"))
    least = nodes.groupBy("slug").agg(F.min("id").alias("any"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(local.select(F.col("slug").alias(f"{end}_slug"), "source_file", "here"), [f"{end}_slug", "source_file"], "left").join(least.select(F.col("slug").alias(f"{end}_slug"), "any"), f"{end}_slug", "left")
        out = out.withColumn(end, F.coalesce("here", "any")).drop("here", "any").where(F.col(end).isNotNull())
    return out.drop("src_slug", "dst_slug")
