"""Code to symbols and references. Python by its own parser; other languages by line patterns and braces, indents or `end`. New languages register a Language."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_text

SELF = {"_self", "cls", "me", "self", "super", "this"}
VERBS = "DELETE GET HEAD OPTIONS PATCH POST PUT".split()
NOISE_CALLS = {
    "abs", "all", "any", "append", "bool", "catch", "console", "dict", "echo", "elif", "else", "enumerate", "filter", "float", "for", "format", "func", "function", "getattr", "hasattr", "if", "int",
    "isinstance", "items", "iter", "join", "keys", "len", "list", "log", "map", "max", "min", "next", "open", "print", "printf", "println", "range", "repr", "require", "return", "reversed", "round", "set",
    "setattr", "sizeof", "sorted", "split", "str", "strip", "sum", "super", "switch", "tuple", "type", "values", "while", "zip",
}


def enclosing(spans: list[tuple[int, int, int]], at: int) -> int | None:
    """Of (start, end, id) spans that hold a place, the one that starts last, of those the one that ends first."""
    return min(((-s, e, i) for s, e, i in spans if s <= at <= e), default=(0, 0, None))[2]


def route_prefix(path: str) -> str | None:
    """The URL of a file of a router by folders: app/.../route and pages/api/...; (groups) are no part of it."""
    parts = path.split("/")
    stem = parts[-1].rsplit(".", 1)[0]
    if "app" in parts and stem in ("route", "page"):
        inner = parts[parts.index("app") + 1 : -1]
    elif "pages" in parts:
        inner = parts[parts.index("pages") + 1 : -1] + ([] if stem == "index" else [stem])
    else:
        return None
    return "/" + "/".join(p for p in inner if not (p.startswith("(") and p.endswith(")")))


def resolve_module(module: str, path: str) -> str:
    """a.b -> a/b; leading dots are folders of the importing file."""
    bare = module.lstrip(".")
    dots = len(module) - len(bare)
    tail = bare.split(".") if bare else []
    if not dots:
        return "/".join(tail)
    base = path.split("/")[:-1]
    return "/".join((base[: len(base) - (dots - 1)] if dots > 1 else base) + tail)


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    supers: list[str]
    depth: int = 0


@dataclass
class Call:
    name: str
    line: int
    recv: str | None = None
    recv_kind: str = "bare"


@dataclass
class Found:
    definitions: list[Definition]
    calls: list[Call]
    imports: list[tuple[str, int]]
    specs: dict[str, tuple[str, str | None]]
    bindings: dict[str, str]


def parse_python(text: str, path: str) -> Found:
    tree = ast.parse(text)
    out = Found([], [], [], {}, {})

    def name_of(n) -> str | None:
        return n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.definitions.append(Definition(n.name, "function", n.lineno, n.end_lineno, []))
        elif isinstance(n, ast.ClassDef):
            out.definitions.append(Definition(n.name, "class", n.lineno, n.end_lineno, [x for b in n.bases if (x := name_of(b))]))
        elif isinstance(n, ast.Import):
            for a in n.names:
                out.imports.append((a.name.split(".")[0], n.lineno))
                out.specs[a.asname or a.name.split(".")[0]] = (resolve_module(a.name, path), None)
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            if n.module:
                out.imports.append((n.module.split(".")[-1], n.lineno))
            for a in n.names:
                if a.name != "*":
                    out.imports.append((a.name, n.lineno))
                    out.specs[a.asname or a.name] = (resolve_module(module, path), a.name)
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and (made := name_of(n.value.func)) and made[:1].isupper():
            for t in n.targets:
                if isinstance(t, ast.Name):
                    out.bindings.setdefault(t.id, made)
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.calls.append(Call(f.id, n.lineno))
            elif isinstance(f, ast.Attribute):
                v = f.value
                if isinstance(v, ast.Name):
                    out.calls.append(Call(f.attr, n.lineno, v.id, "self" if v.id in SELF else "name"))
                elif isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name):
                    own = v.value.id in SELF
                    out.calls.append(Call(f.attr, n.lineno, v.attr if own else f"{v.value.id}.{v.attr}", "self_attr" if own else "dotted"))
                elif isinstance(v, ast.Call) and (made := name_of(v.func)):
                    own = made == "super"
                    out.calls.append(Call(f.attr, n.lineno, made, "self" if own else "ctor" if made[:1].isupper() else "complex"))
                else:
                    out.calls.append(Call(f.attr, n.lineno, None, "complex"))
    return out


@dataclass
class Language:
    """How to read a language by lines: patterns with the name in group 1 (supertypes in group 2 of a class), what ends a body, and what begins a comment."""

    functions: list[str]
    classes: list[str]
    imports: list[str]
    body: str = "brace"  # brace, end, or line
    comment: str = "//"
    calls: str = r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|->|::|:)\s*)?([A-Za-z_$][\w$]*[!?]?)\s*\("
    tail: bool = False


_ID = r"([A-Za-z_$][\w$]*)"
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|open|virtual|sealed|partial|data|inline|suspend|readonly|const|unsafe|pub(?:\([^)]*\))?|case|implicit|mutating|declare)\s+)*"
_TYPED = rf"^\s*{_MOD}(?!return\b|new\b|else\b|throw\b|await\b|if\b|for\b|while\b|switch\b|catch\b)[\w:<>\[\],.&*?]+(?:\s*[&*]+\s*|\s+)(?:[\w~]+::)*{_ID}\s*\([^;]*$"
_IMPORT_PATH = r"^\s*import\s+(?:static\s+)?(.+?);?\s*$"
_JS_FUNCTIONS = [
    rf"^\s*{_MOD}function\s*\*?\s*{_ID}\s*[(<]", rf"^\s*{_MOD}(?:let|var|const)?\s*{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:\s*[^=]+)?|[A-Za-z_$][\w$]*)\s*=>",
    rf"^\s*{_MOD}(?:let|var)?\s*{_ID}\s*=\s*(?:async\s+)?function\b", rf"^\s*{_MOD}(?:get\s+|set\s+|\*\s*)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_ID}\s*\([^;{{]*\)\s*(?::[^;{{]+)?\{{",
]
LANGUAGES: dict[str, Language] = {
    "javascript": Language(_JS_FUNCTIONS, [rf"^\s*{_MOD}class\s+{_ID}(?:\s+extends\s+([\w.$]+))?"], [r"^\s*import\s+(.+?)\s*;?$", r"require\(\s*['\"]([^'\"]+)"]),
    "typescript": Language(_JS_FUNCTIONS, [rf"^\s*{_MOD}(?:class|interface|enum)\s+{_ID}(?:<[^>]*>)?(?:\s+extends\s+([\w.$, ]+))?"], [r"^\s*import\s+(.+?)\s*;?$"]),
    "go": Language([rf"^func\s+(?:\([^)]*\)\s*)?{_ID}\s*[(\[]"], [rf"^\s*type\s+{_ID}\s+(?:struct|interface)\b"], [r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"^\s+(?:\w+\s+)?\"([\w./-]+)\"\s*$"]),
    "java": Language([_TYPED, rf"^\s*(?:public|private|protected)\s+{_ID}\s*\([^;]*$"], [rf"^\s*{_MOD}(?:class|interface|enum|record)\s+{_ID}(?:<[^>]*>)?(?:\([^)]*\))?(?:\s+(?:extends|implements)\s+([\w., ]+?))?(?:\s+implements\s+[\w., ]+)?\s*(?:\{{|$)"], [_IMPORT_PATH]),
    "c": Language([_TYPED], [rf"^\s*(?:typedef\s+)?(?:struct|enum)\s+{_ID}\s*\{{"], [r"^\s*#\s*include\s*[<\"]([^>\"]+)"]),
    "cpp": Language([_TYPED], [rf"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+{_ID}(?:\s+final)?(?:\s*:\s*([\w:, ]+?))?\s*(?:\{{|$)"], [r"^\s*#\s*include\s*[<\"]([^>\"]+)"]),
    "ruby": Language([r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[!?=]?)"], [r"^\s*(?:class|module)\s+([A-Z]\w*)(?:\s*<\s*([\w:]+))?"], [r"^\s*(?:require|require_relative|load)\s+['\"]([^'\"]+)"], "end", "#"),
    "csharp": Language([_TYPED, rf"^\s*(?:public|private|protected|internal)\s+{_ID}\s*\([^;]*$"], [rf"^\s*{_MOD}(?:class|interface|struct|record|enum)\s+{_ID}(?:<[^>]*>)?(?:\([^)]*\))?(?:\s*:\s*([\w.<>, ]+?))?\s*(?:\{{|$)"], [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"]),
    "rust": Language([rf"^\s*{_MOD}(?:extern\s+\"C\"\s+)?fn\s+{_ID}"], [rf"^\s*{_MOD}(?:struct|enum|trait)\s+{_ID}"], [r"^\s*(?:pub\s+)?use\s+(.+?);"]),
    "kotlin": Language([rf"^\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?{_ID}\s*\("], [rf"^\s*{_MOD}(?:class|object|interface)\s+{_ID}(?:<[^>]*>)?(?:\([^)]*\))?(?:\s*:\s*([\w., ]+))?"], [r"^\s*import\s+([\w.]+)"], tail=True),
    "swift": Language([rf"^\s*{_MOD}func\s+{_ID}"], [rf"^\s*{_MOD}(?:class|struct|protocol|enum|actor)\s+{_ID}(?:<[^>]*>)?(?:\s*:\s*([\w., ]+))?"], [r"^\s*import\s+([\w.]+)"]),
    "php": Language([rf"^\s*{_MOD}function\s+&?{_ID}\s*\("], [rf"^\s*{_MOD}(?:class|interface|trait|enum)\s+{_ID}(?:\s+(?:extends|implements)\s+([\w\\, ]+?))?(?:\s+implements\s+[\w\\, ]+)?\s*(?:\{{|$)"], [r"^\s*use\s+([\w\\]+)"]),
    "scala": Language([rf"^\s*{_MOD}def\s+{_ID}"], [rf"^\s*{_MOD}(?:class|object|trait)\s+{_ID}(?:\[[^\]]*\])?(?:\([^)]*\))?(?:\s+extends\s+([\w.]+))?"], [r"^\s*import\s+([\w.]+)"], tail=True),
    "lua": Language([r"^\s*(?:local\s+)?function\s+(?:[\w]+[.:])*([A-Za-z_]\w*)", r"^\s*(?:local\s+)?(?:\w+\.)?([A-Za-z_]\w*)\s*=\s*function\b"], [], [], "end", "--"),
    "bash": Language([r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?", r"^\s*function\s+([A-Za-z_][\w-]*)"], [], [r"^\s*(?:source|\.)\s+(\S+)"], "brace", "#", r"(?:^|[;&|(`]|\b(?:then|do|else|if)\b)\s*()([A-Za-z_][\w-]*)(?=\s|$|;)"),
    "r": Language([r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\b"], [], [], "brace", "#"),
    "julia": Language([r"^\s*function\s+(?:\w+\.)*([A-Za-z_]\w*!?)", r"^\s*([A-Za-z_]\w*!?)\([^)]*\)\s*=(?!=)"], [r"^\s*(?:mutable\s+)?struct\s+([A-Z]\w*)(?:\{[^}]*\})?(?:\s*<:\s*(\w+))?"], [r"^\s*(?:import|using)\s+([\w.]+)"], "end", "#", tail=True),
    "elixir": Language([r"^\s*defp?\s+([a-z_]\w*[!?]?)"], [r"^\s*(?:defmodule|defprotocol)\s+([\w.]+)"], [r"^\s*(?:import|alias|require|use)\s+([\w.]+)"], "end", "#", tail=True),
    "powershell": Language([r"(?i)^\s*function\s+([A-Za-z_][\w-]*)"], [r"(?i)^\s*class\s+(\w+)(?:\s*:\s*(\w+))?"], [], "brace", "#", r"(?:^|[;|(={]|\breturn\b)\s*()([A-Za-z_][\w]*-?[\w-]*)(?=\s|$|;|\()"),
}
_OPENS = re.compile(r"^\s*(?:def|defp|defmodule|defprotocol|class|module|if|unless|while|until|for|case|begin|function|struct|mutable\s+struct|let|quote|try|do|local\s+function|macro)\b|\b(?:do|function)\b(?:\s*\|[^|]*\|)?\s*(?:\([^)]*\))?\s*$")
_ENDS = re.compile(r"^\s*end\b")


def _clean(line: str, comment: str) -> str:
    """A line without strings' insides and without its comment."""
    line = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", '""', line)
    at = line.find(comment)
    return line if at < 0 else line[:at]


def _end_of(lines: list[str], i: int, body: str) -> int:
    if body == "brace":
        depth, opened = 0, False
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            opened = opened or "{" in lines[j]
            if opened and depth <= 0:
                return j
            if not opened and (lines[j].rstrip().endswith(";") or j > i and not lines[j].strip() or j - i > 12):
                return i
        return len(lines) - 1 if opened else i
    depth = 0
    for j in range(i, len(lines)):
        if _ENDS.search(lines[j]):
            depth -= 1
        elif _OPENS.search(lines[j]) and not re.search(r"\bend\b\s*[)}]?\s*$|,\s*do:|=\s*[^=]+$" if j != i else r"\bend\s*$|,\s*do:", lines[j]):
            depth += 1
        if depth <= 0:
            return j
    return len(lines) - 1


def parse_lines(text: str, path: str, lang: Language) -> Found:
    raw = text.split("\n")
    lines = [_clean(x, lang.comment) for x in raw]
    out = Found([], [], [], {}, {})
    heads: set[int] = set()
    for i, line in enumerate(lines):
        for kind, patterns in (("class", lang.classes), ("function", lang.functions)):
            m = next((m for p in patterns if (m := re.search(p, line))), None)
            if m and m.group(1) and m.group(1) not in ("if", "for", "while", "switch", "catch", "return", "function", "else", "new"):
                supers = re.findall(r"[\w.]+", m.group(2)) if m.re.groups > 1 and m.group(2) else []
                supers = [s.rsplit(".", 1)[-1] for s in supers if s not in ("public", "private", "protected", "virtual", "implements", "extends", "with")]
                out.definitions.append(Definition(m.group(1), kind, i + 1, _end_of(lines, i, lang.body) + 1, supers))
                heads.add(i)
                break
        for p in lang.imports:
            m = re.search(p, raw[i])
            if m:
                ids = re.findall(r"[A-Za-z_]\w*", m.group(1))
                for x in ids[-1:] if lang.tail else [x for x in ids if x not in ("from", "as", "type", "static")]:
                    out.imports.append((x, i + 1))
                break
        m = re.search(r"([A-Za-z_]\w*)\s*(?::=|=)\s*(?:new\s+)?([A-Z]\w*)\s*[({]", line)
        if m:
            out.bindings.setdefault(m.group(1), m.group(2))
        own = {d.name for d in out.definitions if d.start == i + 1}
        for m in re.finditer(lang.calls, line):
            recv, name = m.group(1) or None, m.group(2)
            if name in own and not recv:
                continue
            kind = "bare" if not recv else "self" if recv in SELF else "ctor" if recv[:1].isupper() else "name"
            out.calls.append(Call(name, i + 1, recv, kind))
    return out


PARSERS: dict[str, Callable[[str, str], Found]] = {"python": parse_python} | {k: (lambda t, p, v=v: parse_lines(t, p, v)) for k, v in LANGUAGES.items()}

ROW = (
    "kind_of_row string, key string, path string, slug string, label string, norm_label string, kind string, location string, cls string, src string, dst string, relation string, callee string, "
    "is_method boolean, recv string, recv_kind string, recv_type string, caller_class string, import_module string, import_symbol string, import_evidence boolean, lang string, seq int, error string"
)
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def extract_file(path: str, text: str, lang: str) -> list[dict]:
    """Rows of one file: nodes (by key), edges between keys, references to resolve, or an error. Keys are slugs, unique in the file."""
    stem = normalize_text(re.sub(r"(?<=[^/])\.[^./]*$", "", path)) or "file"
    name = path.rsplit("/", 1)[-1]
    rows = [dict(kind_of_row="node", key=stem, slug=stem, label=name, norm_label=name.lower(), kind="file", location="L1", seq=0)]
    done = lambda: [dict.fromkeys(_COLUMNS) | r | {"path": path, "lang": lang} for r in rows]
    parser = PARSERS.get(lang)
    if parser is None:
        rows.append(dict(kind_of_row="error", error=f"no parser for {lang}"))
        return done()
    try:
        found = parser(text, path)
    except (SyntaxError, ValueError, RecursionError) as e:
        rows.append(dict(kind_of_row="error", error=f"{type(e).__name__}: {e}"))
        return done()
    spans: dict[tuple[int, int, str], Definition] = {}
    for d in found.definitions:
        old = spans.get((d.start, d.end, d.name))
        spans[d.start, d.end, d.name] = d if old is None or d.kind == "class" else old
    defs = sorted(spans.values(), key=lambda d: (d.start, -d.end, d.kind != "class"))
    places = [(d.start, d.end, i) for i, d in enumerate(defs)]
    parents: list[int | None] = []
    for i, d in enumerate(defs):
        parents.append(enclosing([p for p in places if p[2] != i and p[0] <= d.start and p[1] >= d.end and (p[0], -p[1], p[2]) < (d.start, -d.end, i)], d.start))
    keys: list[str] = []
    used = {stem}
    prefix = route_prefix(path)
    for i, d in enumerate(defs):
        up = parents[i]
        slug = f"{keys[up] if up is not None else stem}_{normalize_text(d.name)}"
        key = slug if slug not in used else f"{slug}_l{d.start}"
        while key in used:
            key += "_"
        used.add(key)
        keys.append(key)
        cls = defs[up].name if up is not None and defs[up].kind == "class" else None
        kind = "class" if d.kind == "class" else "method" if cls else "function"
        label = d.name if kind == "class" else f".{d.name}()" if kind == "method" else f"{d.name}()"
        if kind == "function" and prefix and up is None:
            if d.name in VERBS:
                kind, label = "route", f"{d.name} {prefix}"
            elif name.rsplit(".", 1)[0] == "page" and re.search(rf"export\s+default\s+(?:async\s+)?function\s+{re.escape(d.name)}\b", text):
                kind, label = "route", f"{prefix} ({d.name})"
        d.kind = kind
        rows.append(dict(kind_of_row="node", key=key, slug=slug, label=label, norm_label=label.lower(), kind=kind, location=f"L{d.start}-L{d.end}" if d.end > d.start else f"L{d.start}", cls=cls, seq=i + 1))
        rows.append(dict(kind_of_row="edge", src=keys[up] if up is not None else stem, dst=key, relation="method" if up is not None and defs[up].kind == "class" else "contains", location=f"L{d.start}"))
    classes: dict[str, str] = {}
    by_name: dict[str, str] = {}
    methods: dict[tuple[str, str], str] = {}
    for i, d in enumerate(defs):
        by_name.setdefault(d.name, keys[i])
        up = parents[i]
        if up is not None and defs[up].kind == "class":
            methods.setdefault((defs[up].name, d.name), keys[i])
        for s in d.supers if d.kind == "class" else ():
            if s in classes:
                rows.append(dict(kind_of_row="edge", src=keys[i], dst=classes[s], relation="inherits", location=f"L{d.start}"))
            else:
                module, symbol = found.specs.get(s, (None, None))
                rows.append(dict(kind_of_row="ref", src=keys[i], callee=s, relation="inherits", location=f"L{d.start}", import_module=module, import_symbol=symbol, import_evidence=module is not None, is_method=False))
        if d.kind == "class":
            classes.setdefault(d.name, keys[i])
    for x, line in found.imports:
        rows.append(dict(kind_of_row="ref", src=stem, callee=x, relation="imports", location=f"L{line}", is_method=False, import_evidence=False))
    imported = {x for x, _ in found.imports}
    seen = set()
    for c in found.calls:
        if c.name.lower() in NOISE_CALLS or c.name in VERBS and prefix:
            continue
        i = enclosing(places, c.line)
        caller = keys[i] if i is not None else stem
        up = i
        while up is not None and defs[up].kind != "class":
            up = parents[up]
        own = defs[up].name if up is not None else None
        kind = c.recv_kind
        typed = own if kind in ("self",) else c.recv if kind == "ctor" else found.bindings.get(c.recv) or (c.recv if c.recv in classes else None) if kind in ("name", "self_attr") else None
        if kind == "bare":
            target = by_name.get(c.name)
        elif kind == "self":
            target = methods.get((own, c.name)) or by_name.get(c.name)
        else:
            target = methods.get((typed, c.name)) if typed else None
        if target == caller or (caller, target or (c.name, c.recv), c.line) in seen:
            continue
        seen.add((caller, target or (c.name, c.recv), c.line))
        if target:
            rows.append(dict(kind_of_row="edge", src=caller, dst=target, relation="calls", location=f"L{c.line}"))
            continue
        root = (c.recv or "").split(".")[0]
        if c.name in found.specs and kind == "bare":
            module, symbol = found.specs[c.name]
        elif c.recv and root in found.specs:
            module, symbol = found.specs[root]
            module, symbol = (f"{module}/{symbol}" if symbol and root == c.recv and symbol[:1].islower() else module), None
        else:
            module, symbol = None, None
        known = kind != "bare" and typed and typed in found.specs
        if known:
            module, symbol = found.specs[typed][0], None
        rows.append(dict(kind_of_row="ref", src=caller, callee=c.name, relation="calls", location=f"L{c.line}", is_method=kind != "bare", recv=c.recv, recv_kind=kind, recv_type=typed, caller_class=own,
                         import_module=module, import_symbol=symbol, import_evidence=c.name in imported and kind == "bare"))
    return done()


#: Files that a task parses: programs are short for the time that they take, so how they lie doesn't say how many tasks are due.
FILES_OF_TASK = 20_000


def extract(files: DataFrame, batch: int | None = None) -> DataFrame:
    """Rows of all code files (path, text, lang); spread by path over `batch` tasks, or as many as their count asks for, since parsing is what takes the time."""

    def run(batches):
        for b in batches:
            rows = [r for p, t, lang in zip(b["path"], b["text"], b["lang"]) for r in extract_file(p, t or "", lang)]
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)

    spread = files.select("path", "text", "lang")
    batch = batch or max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_OF_TASK))
    return spread.repartition(batch, "path").mapInPandas(run, ROW)


def code_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, raw_refs) with ids, of extracted rows."""
    from ..operators.store import node_id

    ident = lambda key: node_id(F.col("path"), F.col(key), F.lit(0))
    nodes = rows.where("kind_of_row = 'node'").select(
        ident("key").alias("id"), "slug", "label", "norm_label", F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.col("location").alias("source_location"), "kind",
        F.lit("ast").alias("origin"), "cls", "seq",
    )
    edges = rows.where("kind_of_row = 'edge'").select(
        ident("src").alias("src"), ident("dst").alias("dst"), "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"),
        F.when(F.col("relation") == "calls", "call").when(F.col("relation") == "inherits", "type").otherwise("contains").alias("context"), F.col("path").alias("source_file"), F.col("location").alias("source_location"),
        F.lit(1.0).alias("weight"), F.lit("same-file").alias("evidence"),
    ).withColumn("id", F.shiftrightunsigned(F.xxhash64("src", "dst", "relation", "source_location"), 1))
    refs = rows.where("kind_of_row = 'ref'").select(
        ident("src").alias("caller_id"), "callee", "relation", F.col("path").alias("source_file"), F.col("location").alias("source_location"), "import_evidence", "lang", "is_method", "recv", "recv_kind", "recv_type",
        "caller_class", "import_module", "import_symbol",
    )
    return nodes, edges, refs
