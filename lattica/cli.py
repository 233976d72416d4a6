"""python -m lattica.cli COMMAND --store DIR ...: the engine from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import GraphEngine, Registry
from .operators import analysis, semantic
from .sources import ingest, scan

COMMANDS: dict[str, list[str]] = {
    "extract": ["path"], "update": ["path"], "check-update": ["path"], "query": ["question"], "affected": ["label"], "path": ["a", "b"], "explain": ["label"], "context": ["label", "path"], "god-nodes": [], "stats": [], "diagnose": [],
    "embed": [], "export": ["target", "out"], "report": [], "clone": ["out"], "merge-graphs": ["other", "out"], "save-result": ["question", "outcome", "nodes"], "reflect": [], "apply-semantic": ["glob"], "prs": ["file"], "add": ["path", "source", "file"],
    "global": ["action", "name", "root"], "serve": [], "watch": ["path"],
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        p = sub.add_parser(name)
        for w in words:
            p.add_argument(w, **({"nargs": "?"} if name == "global" and w != "action" else {}))
        p.add_argument("--store", default="lattica-out")
        for option, value in (("--depth", 3), ("--budget", 2000)):
            p.add_argument(option, default=value, type=int)
        p.add_argument("--registry", default="lattica-registry.json")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    return run(spark, a)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    e = GraphEngine(spark, a.store)
    show = lambda df: [print("\t".join("" if v is None else str(v) for v in r)) for r in df.toLocalIterator()]
    c = a.command
    if c in ("extract", "update", "check-update"):
        files = scan.read_tree(spark, a.path)
        show(e.check_update(files)) if c == "check-update" else e.extract(files, force=c == "extract", head=scan.git_head(a.path))
    elif c == "query":
        show(e.query(a.question, budget=a.budget).select("line"))
    elif c == "affected":
        show(e.affected(a.label, a.depth))
    elif c == "path":
        show(e.path(a.a, a.b))
    elif c == "explain":
        show(e.explain(a.label))
    elif c == "context":
        files = scan.read_tree(spark, a.path).select("path", F.decode("content", "utf-8").alias("content"))
        show(e.context(a.label, files).select("part", "label", "place", "text"))
    elif c == "god-nodes":
        show(e.god_nodes().select("label", "degree", "source_file"))
    elif c in ("stats", "diagnose", "reflect"):
        show(getattr(e, c)())
    elif c == "embed":
        e.embed()
    elif c == "export":
        e.export(a.target, a.out)
    elif c == "report":
        print(e.report())
    elif c == "clone":
        e.clone(a.out)
    elif c == "merge-graphs":
        GraphEngine(spark, a.out).merge({"a": e, "b": GraphEngine(spark, a.other)})
    elif c == "save-result":
        e.save_result(a.question, a.outcome, a.nodes.split(","))
    elif c == "apply-semantic":
        e.apply_semantic(semantic.read_responses(spark, a.glob))
    elif c == "prs":
        prs = spark.read.schema("number int, title string, files array<string>").json(a.file)
        show(analysis.triage(prs, e.nodes, e.edges, a.depth))
    elif c == "add":
        body = spark.read.text(a.file, wholetext=True).select(F.lit(a.source).alias("source"), F.col("value").alias("body"))
        new = ingest.as_corpus(ingest.to_markdown(body).select("source", "text"))
        e.extract(scan.read_tree(spark, a.path).select("path", "content").unionByName(new))
    elif c == "global":
        r = Registry(spark, a.registry)
        if a.action == "add":
            r.add(a.name, a.root)
        elif a.action == "remove":
            r.remove(a.name)
        else:
            [print(f"{k}\t{v}") for k, v in sorted(r.list().items())]
    elif c == "serve":
        from .serve import serve

        serve(e if e.store.exists() else None, sys.stdin, sys.stdout)
    elif c == "watch":
        from .streaming.streams import watch

        watch(spark, a.path, lambda rows, batch: e.extract(scan.read_tree(spark, a.path)), f"{a.store}/watch", "2 seconds").awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
