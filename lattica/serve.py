"""The engine's questions as tools for an agent: JSON-RPC messages in, text out, over any line stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame

from .engine import GraphEngine

_TEXT, _COUNT = {"type": "string"}, {"type": "integer"}
TOOLS: dict[str, tuple[str, dict, Callable[[GraphEngine, dict], DataFrame]]] = {
    "query_graph": ("Nodes and edges that answer a question", {"question": _TEXT, "budget": _COUNT}, lambda e, a: e.query(a["question"], budget=a.get("budget", 2000)).select("line")),
    "get_node": ("A node by its label", {"label": _TEXT}, lambda e, a: e.nodes.where(e.nodes["id"] == e._one(a["label"]))),
    "get_neighbors": ("Nodes next to a node", {"label": _TEXT}, lambda e, a: _neighbors(e, a["label"])),
    "explain": ("Edges of a node, both ways", {"label": _TEXT}, lambda e, a: e.explain(a["label"])),
    "affected": ("What depends on a node", {"label": _TEXT, "depth": _COUNT}, lambda e, a: e.affected(a["label"], a.get("depth", 3))),
    "shortest_path": ("How two nodes hang together", {"source": _TEXT, "target": _TEXT}, lambda e, a: e.path(a["source"], a["target"])),
    "god_nodes": ("The best-connected symbols", {"n": _COUNT}, lambda e, a: e.god_nodes(a.get("n", 15)).select("label", "degree", "source_file")),
    "graph_stats": ("Counts of the graph", {}, lambda e, a: e.stats()),
    "diagnose": ("Health checks", {}, lambda e, a: e.diagnose()),
    "get_community": ("Members of a community", {"id": _COUNT}, lambda e, a: e.nodes.where(e.nodes["community"] == a["id"]).select("label", "source_file", "degree").orderBy("label")),
}


def _neighbors(e: GraphEngine, label: str) -> DataFrame:
    from .operators.graph import neighbors

    return neighbors(e.nodes, e.edges, e._one(label)).select("label", "kind", "source_file")


def handle(engine: GraphEngine | None, message: dict, most: int = 500) -> dict | None:
    """The answer to one message; notifications have none. At most `most` rows are shown, and how many there are."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    ok = lambda r, part="result": {"id": message["id"], part: r, "jsonrpc": "2.0"}
    shown = lambda t, **more: ok({"content": [dict(text=t, type="text")], **more})
    if method == "initialize":
        return ok({"serverInfo": {"version": "0.1", "name": "lattica"}, "protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": [{"inputSchema": {"properties": p, "type": "object"}, "description": d, "name": n} for n, (d, p, _) in TOOLS.items()]})
    if method != "tools/call":
        return ok({"message": f"no such method: {method}", "code": -32601}, "error")
    try:
        if engine is None:
            raise LookupError("there is no graph yet")
        out = TOOLS[params["name"]][2](engine, params.get("arguments") or {})
        rows = out.limit(most + 1).collect()
        lines = [r[0] if len(r) == 1 and isinstance(r[0], str) else json.dumps(r.asDict(recursive=True), default=str) for r in rows[:most]]
        return shown("\n".join(lines + (["and more"] if len(rows) > most else [])))
    except (LookupError, ValueError) as error:
        return shown(str(error), isError=True)


def serve(engine: GraphEngine | None, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if line.strip():
            answer = handle(engine, json.loads(line))
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
