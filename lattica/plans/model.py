"""Schemas of the graph's tables, its value domains and constants."""

from __future__ import annotations

META = "key string, value string"
FILES = "path string, abs_identity string, file_type string, lang string, content_sha256 string, ast_hash string, semantic_hash string, mtime double, seen double, status string"
NODES = (
    "id long, slug string, label string, norm_label string, file_type string, source_file string, source_location string, definition_file string, "
    "definition_location string, kind string, origin string, rationale string, community int, community_name string, degree int, cls string, concepts array<string>, seq int"
)
EDGES = (
    "id long, src long, dst long, relation string, confidence string, confidence_score double, context string, source_file string, source_location string, "
    "weight double, evidence string, deferred boolean, type_only boolean, note string"
)
RAW_REFS = (
    "caller_id long, callee string, relation string, source_file string, source_location string, import_evidence boolean, lang string, is_method boolean, "
    "recv string, recv_kind string, recv_type string, caller_class string, import_module string, import_symbol string"
)
HYPEREDGES = "id long, slug string, label string, relation string, confidence string, confidence_score double, source_file string, members array<long>"
COMMUNITIES = "id int, label string, cohesion double, member_sig string"
QUERY_LOG = "ts double, kind string, question string, corpus string, nodes_returned int, duration_ms double, outcome string, correction string, source_nodes array<string>"
VECTORS = "node_id long, text_sha string, model string, dim int, embedding array<float>"
TABLES = {"meta": META, "files": FILES, "nodes": NODES, "edges": EDGES, "raw_refs": RAW_REFS, "hyperedges": HYPEREDGES, "communities": COMMUNITIES, "queries": QUERY_LOG, "vec_cache": VECTORS}

#: What the traversals follow.
WALKED = "calls contains implements imports_from inherits method references".split()
IMPORTS = ["imports", "imports_from", "re_exports"]
EDGE_KEY = ["src", "dst", "relation", "source_file", "source_location"]
LADDER = [x / 100 for x in range(55, 100, 10)]
DOC_TYPES = ["document", "paper", "section"]
BUILTIN_LABELS = "any bool dict false float int list none object os path self set str sys true tuple".split()
KINDS_OF = {"calls": ["function", "method", "class"], "inherits": ["class"], "implements": ["class"], "references": ["class", "function", "method"]}
FAN_IN = 4
POPULAR = "add append apply build call check clear close commit connect copy create decode delete dump dumps encode execute exists extend fetch fetchall fetchone flush format from_dict get handle hash id init insert items json keys load loads make name next open parse pop process query read recv remove reset resolve rollback run save send set setup start stop text to_dict update validate value values write".split()
STOP_WORDS = "a an and are as be by do does for from get handle handled how in is it of on or set that the this to using what when where which who why with work worked working works".split()
RELATIONAL = "affected affects breaks dependencies dependency depends".split()
STOP_DIRS = "app apps backend client common core frontend internal lib packages pkg server shared src".split()
GENERIC = "build call check compute create execute get handle handler init load main make process run save send set setup start step stop update".split()
SOURCE_SUFFIXES = ["." + x for x in "c cc cjs cpp cs go h hpp java js jsx kt lua mjs php py pyi rb rs scala swift ts tsx".split()]
PALETTE = [f"#{x}" for x in "5b9dd9 d98b5b 7bd95b d95b9d d9cf5b 5bd9cf 9d5bd9 d95b5b".split()]
NO_COLOR = "#cccccc"
OUTCOMES = ["useful", "dead_end", "corrected"]
HUB_FLOOR = 50
