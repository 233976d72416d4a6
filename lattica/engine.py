"""The engine: a store, and the operators on it by the names that users know."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import make_slug, norm_label
from .operators import analysis, community, export, graph, precise, resolve, retrieval, semantic
from .operators.staging import written
from .operators.store import Store, changed_files, clean_edges, file_diff, node_id, prune, replace_files
from .sources import code, scan, text

#: Edges that a file makes by itself; those between files are made again of all references.
OWN = "coalesce(evidence, '') NOT LIKE 'xfile-%'"


class GraphEngine:
    """A knowledge graph of a corpus. Inputs are DataFrames (path, content binary); results are DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @property
    def nodes(self) -> DataFrame:
        return self.store.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.table("edges")

    def extract(self, files: DataFrame, patterns: list[str] | None = None, force: bool = False, transcribe=None, resolve_imports: bool = False, head: str | None = None) -> None:
        """Brings the graph to the state of files: only changed files are parsed; what spans files is computed anew, in one plan each."""
        found = written(scan.catalogue(files, patterns), "scan")
        known, old_nodes, old_edges, old_refs = (self.store.table(t) for t in ("files", "nodes", "edges", "raw_refs"))
        changed = written(changed_files(found, known, force), "changed")
        rows = written(code.extract(changed.where("file_type = 'code'").select("path", F.decode("content", "utf-8").alias("text"), "lang")), "rows")
        nodes, edges, refs = code.code_tables(rows)
        docs = changed.where("file_type IN ('document', 'paper')").select("path", F.decode("content", "utf-8").alias("content"))
        heard = text.transcripts(changed.where("file_type IN ('audio', 'video')").select("path", "content"), transcribe).withColumnRenamed("text", "content")
        doc_nodes, doc_edges = self._documents(docs, "document")
        tr_nodes, tr_edges = self._documents(heard, "transcript")
        images = self._file_nodes(changed.where("file_type = 'image'"), F.lit("image"))
        nodes = nodes.unionByName(doc_nodes, True).unionByName(tr_nodes, True).unionByName(images, True)
        edges = edges.unionByName(doc_edges, True).unionByName(tr_edges, True)
        site = changed.select(F.col("path").alias("source_file"))
        all_nodes, all_edges = replace_files(old_nodes, old_edges.where(OWN), nodes, edges, site)
        all_refs = old_refs.join(site, "source_file", "left_anti").unionByName(refs, True)
        now = found.select("path", F.col("path").alias("abs_identity"), "file_type", "lang", "content_sha256", F.col("content_sha256").alias("ast_hash"), F.lit("present").alias("status"))
        kept = known.join(now.select("path"), "path", "left_anti").unionByName(now.join(known.select("path", "semantic_hash"), "path", "left"), True)
        all_nodes, all_edges, all_refs, kept = prune(written(all_nodes, "nodes"), written(all_edges, "edges"), written(all_refs, "refs"), kept, found.select("path"))
        self._finish(all_nodes, all_edges, all_refs, kept, resolve_imports, head)

    def _file_nodes(self, files: DataFrame, file_type) -> DataFrame:
        return files.select(
            node_id(F.col("path"), make_slug(F.col("path")), F.lit(0)).alias("id"), make_slug(F.col("path")).alias("slug"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("norm_label"),
            file_type.alias("file_type"), F.col("path").alias("source_file"), F.lit("L1").alias("source_location"), F.lit("file").alias("kind"), F.lit("ast").alias("origin"), F.lit(0).alias("seq"),
        )

    def _documents(self, docs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        found = text.sections(text.headings(docs))
        ident = lambda line: F.when(line.isNull(), node_id(F.col("path"), make_slug(F.col("path")), F.lit(0))).otherwise(node_id(F.col("path"), F.lit("section"), line))
        heads = found.select(
            ident(F.col("line")).alias("id"), "slug", "label", norm_label(F.col("label")).alias("norm_label"), F.lit(kind).alias("file_type"), F.col("path").alias("source_file"),
            F.concat(F.lit("L"), "line", F.lit("-L"), "end").alias("source_location"), F.lit("section").alias("kind"), F.lit("ast").alias("origin"), F.col("line").alias("seq"),
        )
        held = found.select(
            ident(F.col("parent")).alias("src"), ident(F.col("line")).alias("dst"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("contains").alias("context"),
            F.col("path").alias("source_file"), F.concat(F.lit("L"), "line").alias("source_location"), F.lit("same-file").alias("evidence"),
        ).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "source_location"), 1))
        return self._file_nodes(docs, F.lit(kind)).unionByName(heads, True), held

    def _finish(self, nodes: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame, resolve_imports: bool = False, head: str | None = None, resolved: bool = False) -> None:
        """Stores a graph. Edges between files are made of refs, unless `resolved` says that edges hold them already."""
        refs, nodes = written(refs, "refs"), written(nodes, "nodes")
        cross = None if resolved else resolve.resolve(refs, nodes, resolve_imports).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "relation", "source_file", "source_location"), 1)).withColumn("weight", F.lit(1.0))
        edges = written(clean_edges(edges if resolved else edges.where(OWN).unionByName(cross, True), nodes), "edges")
        found = written(community.detect(nodes, edges), "communities")
        ranked = nodes.drop("degree", "community", "community_name").join(graph.degrees(nodes, edges), "id").join(found, "id", "left")
        ranked = written(ranked, "ranked")
        groups = community.names(ranked).join(community.cohesion(found, edges), "community", "left").join(community.member_sig(found), "community", "left")
        groups = written(groups.withColumnRenamed("community", "id"), "groups")
        named = ranked.join(groups.select(F.col("id").alias("community"), F.col("label").alias("community_name")), "community", "left")
        self.store.commit({"nodes": named, "edges": edges, "raw_refs": refs, "files": files, "communities": groups}, {"head": head} if head else None)

    update = extract

    def merge(self, graphs: dict[str, "GraphEngine"]) -> None:
        """Stores the union of other engines' graphs: all nodes and edges, references, files and hyperedges, under the name of each graph."""
        nodes, edges = analysis.merge({t: (e.nodes, e.edges) for t, e in graphs.items()})

        def union(table: str, ids: list[str], files: list[str]) -> DataFrame:
            parts = [analysis.tagged(e.store.table(table), t, ids, files) for t, e in graphs.items()]
            return reduce(lambda a, b: a.unionByName(b, True), parts)

        refs = union("raw_refs", ["caller_id"], ["source_file"])
        self._finish(nodes, edges, refs, union("files", [], ["path", "abs_identity"]), resolved=True)
        self.store.commit({"hyperedges": union("hyperedges", ["id", "members"], ["source_file"])})

    def check_update(self, files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
        return file_diff(self.store.table("files").where("status = 'present'"), scan.catalogue(files, patterns))

    def query(self, question: str, depth: int = 2, budget: int = 2000, corpus: str = "") -> DataFrame:
        began = time.time()
        out = written(retrieval.query(self.nodes, self.edges, question, depth, budget), "answer")
        self._log("query", question, out.where("line LIKE 'NODE %'").count(), (time.time() - began) * 1000, corpus)
        return out.orderBy("place")

    def _log(self, kind: str, question: str, n: int, ms: float, corpus: str = "", outcome: str | None = None, nodes: list[str] | None = None) -> None:
        row = self.spark.createDataFrame([(time.time(), kind, question, corpus, n, ms, outcome, None, nodes)], self.store.table("queries").schema)
        self.store.commit({"queries": self.store.table("queries").unionByName(row)})

    def save_result(self, question: str, outcome: str, source_nodes: list[str]) -> None:
        if outcome not in ("useful", "dead_end", "corrected"):
            raise ValueError(f"no such outcome: {outcome}")
        self._log("result", question, len(source_nodes), 0.0, outcome=outcome, nodes=source_nodes)

    def reflect(self, now: float | None = None) -> DataFrame:
        return analysis.reflect(self.store.table("queries"), F.lit(time.time() if now is None else now))

    def _one(self, label: str) -> int:
        r = graph.resolve_node(self.nodes, label).first()
        if r is None:
            raise KeyError(f"no node matches {label!r}")
        if r["id"] is None:
            raise KeyError(r["message"])
        return r["id"]

    def affected(self, label: str, depth: int = 3) -> DataFrame:
        return graph.affected(self.nodes, self.edges, self.spark.createDataFrame([(self._one(label),)], "id long"), depth).orderBy("hop", "source_file", "id")

    def path(self, a: str, b: str, max_hops: int = 8) -> DataFrame:
        return graph.shortest_path(self.edges, self._one(a), self._one(b), max_hops)

    def explain(self, label: str) -> DataFrame:
        return graph.explain(self.nodes, self.edges, self._one(label))

    def context(self, label: str, files: DataFrame, **limits) -> DataFrame:
        return graph.context(self.nodes, self.edges, files, self._one(label), **limits)

    def god_nodes(self, n: int = 15) -> DataFrame:
        return graph.god_nodes(self.nodes, n)

    def stats(self) -> DataFrame:
        return analysis.stats(self.nodes, self.edges, self.store.table("files"))

    def diagnose(self) -> DataFrame:
        return analysis.diagnose(self.nodes, self.edges, self.store.table("raw_refs"), self.store.table("files"))

    def embed(self, model: str = "hash") -> None:
        self.store.commit({"vec_cache": retrieval.build_vectors(self.nodes, self.store.table("vec_cache"), model)})

    def ingest_scip(self, index: DataFrame) -> None:
        new = precise.scip_edges(precise.occurrences(index), self.nodes).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "relation", "source_location"), 1))
        self.store.commit({"edges": precise.with_tier(self.edges, new, "scip")})

    def ingest_lsp(self, refs: DataFrame) -> None:
        new = precise.lsp_edges(refs, self.nodes).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "relation", "source_location"), 1))
        self.store.commit({"edges": precise.with_tier(self.edges, new, "lsp")})

    def apply_semantic(self, responses: DataFrame) -> None:
        nodes = semantic.apply_annotations(self.nodes, semantic.annotations_of(responses))
        doubt = semantic.ambiguous_edges(semantic.ambiguous_of(responses), self.nodes).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "relation"), 1))
        groups = semantic.rename_communities(self.store.table("communities"), semantic.names_of(responses))
        self.store.commit({"nodes": nodes, "edges": precise.with_tier(self.edges, doubt, "llm"), "communities": groups})

    def export(self, target: str, path: str) -> None:
        export.export(self.nodes, self.edges, target, path, self.store.table("communities"))

    def report(self, day: str = "") -> str:
        return export.report(self.nodes, self.edges, self.store.table("communities"), self.reflect(), day)

    def clone(self, root: str) -> "GraphEngine":
        self.store.clone(root)
        return GraphEngine(self.spark, root)


class Registry:
    """Names of graphs and where they are, in a JSON file; queries over all of them share the budget."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def list(self) -> dict[str, str]:
        import json
        import os

        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _save(self, entries: dict[str, str]) -> None:
        import json
        import os

        own = f"{self.path}.part"
        with open(own, "w", encoding="utf-8") as f:
            json.dump(entries, f, sort_keys=True)
        os.replace(own, self.path)

    def add(self, name: str, root: str) -> None:
        if not Store(self.spark, root).exists():
            raise ValueError(f"there is no graph at {root}")
        self._save(self.list() | {name: root})

    def remove(self, name: str) -> None:
        self._save({k: v for k, v in self.list().items() if k != name})

    def query(self, question: str, budget: int = 2000) -> DataFrame:
        from functools import reduce

        entries = self.list()
        share = max(400, budget // max(1, len(entries)))
        parts = [GraphEngine(self.spark, root).query(question, budget=share, corpus=name).withColumn("graph", F.lit(name)) for name, root in sorted(entries.items())]
        return reduce(lambda a, b: a.unionByName(b), parts)
