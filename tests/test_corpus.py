import pytest
from pyspark.sql import functions as F

from lattica.engine import GraphEngine, Registry
from lattica.functions import fuzzy, scalars
from lattica.operators import export, precise, resolve, semantic
from lattica.sources import code, scan, text

AUTH = "class User:\n    def check(self):\n        return verify(self)\n\ndef verify(u):\n    return bool(u)\n\ndef login(u):\n    return verify(u)\n"
API = "from core.auth import login\n\ndef handle_request(u):\n    return login(u)\n"
DOC = "# Spec\n\ntext\n\n## Login flow\n\n### Details\n\n## Other\n"
FILES = {"core/auth.py": AUTH, "api.py": API, "docs/spec.md": DOC, ".env": "X=1", "node_modules/x.js": "function a() {}", "pic.png": "\x89"}


def corpus(spark, files=FILES):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = GraphEngine(spark, str(tmp_path_factory.mktemp("g") / "store"))
    e.extract(corpus(spark), resolve_imports=True)
    return e


def test_graph_of_a_corpus(engine):
    labels = {r.label: r for r in engine.nodes.collect()}
    assert {"User", ".check()", "verify()", "login()", "handle_request()", "Login flow", "pic.png"} <= set(labels)
    assert "a()" not in labels and all(r.source_file != ".env" for r in labels.values())
    ids = {r.id: r.label for r in labels.values()}
    got = {(ids[r.src], r.relation, ids[r.dst], r.evidence) for r in engine.edges.collect()}
    assert ("handle_request()", "calls", "login()", "xfile-import") in got
    assert ("login()", "calls", "verify()", "same-file") in got and ("User", "method", ".check()", "same-file") in got
    assert ("Login flow", "contains", "Details", "same-file") in got and ("api.py", "imports", "auth.py", "xfile-import") in got


def test_traversals_on_it(engine):
    assert {r.label for r in engine.affected("login()").collect()} >= {"handle_request()", "auth.py"}
    assert engine.path("handle_request", "verify").first().hops == 2
    assert {(r.direction, r.label) for r in engine.explain("login").collect()} >= {("in", "handle_request()"), ("out", "verify()")}
    files = engine.spark.createDataFrame(list(FILES.items()), "path string, content string")
    parts = {(r.part, r.label): r.text for r in engine.context("login", files).collect()}
    assert parts["body", "login()"].startswith("def login") and parts["caller", "handle_request()"] == "def handle_request(u):"
    with pytest.raises(KeyError):
        engine.affected("nothing such")


def test_query_answers_in_budget_and_logs(engine):
    lines = [r.line for r in engine.query("how does login work", budget=200).collect()]
    assert lines[1].startswith("NODE login()") and sum(len(x) + 1 for x in lines) <= 800
    engine.save_result("q", "useful", ["login()"])
    engine.save_result("q", "useful", ["login()"])
    assert [(r.node, r.lesson) for r in engine.reflect().collect()] == [("login()", "preferred")]
    with pytest.raises(ValueError):
        engine.save_result("q", "fine", [])


def test_merged_graphs_keep_edges_between_files_references_and_files(spark, engine, tmp_path):
    both = GraphEngine(spark, str(tmp_path / "both"))
    both.merge({"a": engine, "b": engine})
    kinds = lambda e: {r.evidence: r["count"] for r in e.edges.groupBy("evidence").count().collect()}
    one = kinds(engine)
    assert kinds(both) == {k: 2 * n for k, n in one.items()} and any(k.startswith("xfile") for k in one)
    for t in ("raw_refs", "files", "hyperedges"):
        assert both.store.table(t).count() == 2 * engine.store.table(t).count()
    refs, nodes = both.store.table("raw_refs"), both.nodes.select(F.col("id").alias("caller_id"))
    assert refs.join(nodes, "caller_id", "left_semi").count() == refs.count()
    assert {p[:2] for (p,) in both.store.table("files").select("path").collect()} == {"a/", "b/"}


def test_update_keeps_ids_and_equals_rebuild(spark, engine, tmp_path):
    new = FILES | {"api.py": API.replace("handle_request", "serve")}
    del new["docs/spec.md"]
    assert {(r.path, r.status) for r in engine.check_update(corpus(spark, new)).collect()} == {("api.py", "changed"), ("docs/spec.md", "deleted")}
    two, whole = engine.clone(str(tmp_path / "two")), GraphEngine(spark, str(tmp_path / "whole"))
    two.extract(corpus(spark, new), resolve_imports=True)
    whole.extract(corpus(spark, new), resolve_imports=True)
    rows = lambda df, *c: sorted(tuple(str(v) for v in r) for r in df.select(*c).collect())
    assert rows(two.nodes, "id", "label", "degree", "community") == rows(whole.nodes, "id", "label", "degree", "community")
    assert rows(two.edges, "src", "dst", "relation", "evidence") == rows(whole.edges, "src", "dst", "relation", "evidence")
    old = {r.id for r in engine.nodes.where("source_file = 'core/auth.py'").collect()}
    assert old == {r.id for r in two.nodes.where("source_file = 'core/auth.py'").collect()}


@pytest.mark.parametrize("target", export.TARGETS)
def test_exports(engine, tmp_path, target):
    import json

    at = tmp_path / target
    engine.export(target, str(at))
    if target == "json":
        g = json.loads(at.read_text())
        ids = {n["id"] for n in g["nodes"]}
        assert g["links"] and all(x["source"] in ids and x["target"] in ids for x in g["links"])
        engine.export(target, str(tmp_path / "again"))
        assert (tmp_path / "again").read_bytes() == at.read_bytes()
    elif target in ("graphml", "gexf"):
        import xml.etree.ElementTree as ET

        ET.parse(at)
    elif at.is_dir():
        assert any(at.rglob("*")) or target == "wiki"
    else:
        assert at.stat().st_size > 0


def test_report_diagnose_registry(spark, engine, tmp_path):
    assert "## Communities" in engine.report() and engine.stats().first().nodes > 5
    assert {r.check: r.ok for r in engine.diagnose().collect()}["dangling edges"]
    r = Registry(spark, str(tmp_path / "r.json"))
    r.add("one", engine.store.root)
    assert r.query("login").where("graph = 'one'").count() > 1
    with pytest.raises(ValueError):
        r.add("none", str(tmp_path / "nowhere"))
    r.remove("one")
    assert r.list() == {}


def resolved(spark, files, **options):
    rows = code.extract(spark.createDataFrame([(p, t, "python") for p, t in files.items()], "path string, text string, lang string"))
    nodes, _, refs = code.code_tables(rows)
    names = {r.id: f"{r.source_file}:{r.label}" for r in nodes.collect()}
    return {(names[r.src], names[r.dst], r.confidence, r.confidence_score, r.evidence) for r in resolve.resolve(refs, nodes, **options).where("relation = 'calls'").collect()}


def test_resolver_cases(spark):
    store, cache = "class Store:\n    def fetch_row(self): pass\n", "class Cache:\n    def fetch_row(self): pass\n"
    typed = "from s import Store\ndef go():\n    x = Store()\n    x.fetch_row()\n"
    assert ("a.py:go()", "s.py:.fetch_row()", "EXTRACTED", 1.0, "xfile-import") in resolved(spark, {"s.py": store, "c.py": cache, "a.py": typed})
    bare = {"m.py": "def rare_name(): pass\n", "a.py": "def go():\n    rare_name()\n"}
    assert resolved(spark, bare) == {("a.py:go()", "m.py:rare_name()", "INFERRED", 0.85, "xfile-infer")}
    twice = {"m.py": "def f1(): pass\n", "n.py": "def f1(): pass\n", "a.py": "def go():\n    f1()\n"}
    assert resolved(spark, twice) == set()
    pinned = twice | {"a.py": "from n import f1\ndef go():\n    f1()\n"}
    assert {x[1] for x in resolved(spark, pinned)} == {"n.py:f1()"}
    outside = bare | {"a.py": "from outside import rare_name\ndef go():\n    rare_name()\n"}
    assert resolved(spark, outside) == set()
    popular = {"m.py": "def get(): pass\n", "a.py": "def go(x):\n    x.get()\n"}
    assert resolved(spark, popular) == set()
    wide = {"m.py": "def lookup_it(): pass\n"} | {f"u{i}.py": f"def go{i}(x):\n    x.lookup_it()\n" for i in range(4)}
    assert resolved(spark, wide) == set()
    few = {k: v for k, v in wide.items() if k != "u3.py"}
    assert {x[2:] for x in resolved(spark, few)} == {("INFERRED", 0.65, "xfile-infer")}
    alias = {"a/b.py": "def deep_one(): pass\n", "c.py": "def deep_one(): pass\n", "x.py": "import a.b as z\ndef go():\n    z.deep_one()\n"}
    assert {x[1] for x in resolved(spark, alias)} == {"a/b.py:deep_one()"}


SNIPPETS = {
    "kotlin": "class Dog : Animal() {\n  fun bark() { help() }\n}\nfun help() {\n}\n", "ruby": "class Dog < Animal\n  def bark\n    help()\n  end\n  def help\n    1\n  end\nend\n",
    "go": "package a\ntype Dog struct {\n}\nfunc (s *Dog) bark() {\n  help()\n}\nfunc help() {\n}\n", "lua": "local function help()\n  return 1\nend\nfunction M.bark()\n  help()\nend\n",
    "bash": "help() {\n  echo hi\n}\nbark() {\n  help\n}\n", "elixir": "defmodule Dog do\n  def bark(x) do\n    help(x)\n  end\n  defp help(x), do: x\nend\n", "julia": "function help(x)\n  x\nend\nbark(x) = help(x)\n",
    "r": "help <- function(x) {\n  x\n}\nbark <- function(y) {\n  help(y)\n}\n", "swift": "class Dog: Animal {\n  func bark() {\n    help()\n  }\n}\nfunc help() {\n}\n",
    "php": "<?php\nclass Dog extends Animal {\n  public function bark() {\n    help();\n  }\n}\nfunction help() {\n}\n", "scala": "class Dog extends Animal {\n  def bark(): Unit = {\n    help()\n  }\n}\nobject O {\n  def help(): Unit = {\n  }\n}\n",
    "powershell": "function help {\n  1\n}\nfunction bark {\n  help\n}\n", "java": "public class Dog extends Animal {\n  public void bark() {\n    help();\n  }\n  private int help() {\n    return 1;\n  }\n}\n",
    "c": "static int help(int x) {\n  return x;\n}\nint bark(void) {\n  return help(1);\n}\n", "cpp": "class Dog : public Animal {\n  void bark() {\n    help();\n  }\n};\nvoid help() {\n}\n",
    "rust": "pub struct Dog {\n}\nfn help() -> i32 {\n  1\n}\npub fn bark() {\n  help();\n}\n", "csharp": "public class Dog : Animal {\n  public void bark() {\n    help();\n  }\n  void help() {\n  }\n}\n",
    "javascript": "class Dog extends Animal {\n  bark() {\n    help();\n  }\n}\nfunction help() {\n}\n", "typescript": "class Dog extends Animal {\n  bark(): void {\n    help();\n  }\n}\nconst help = (x: number) => {\n  return x;\n}\n", "python": "class Dog(Animal):\n    def bark(self):\n        help1()\n\ndef help1(): pass\n",
}


@pytest.mark.parametrize("lang", sorted(SNIPPETS))
def test_every_language(lang):
    rows = code.extract_file("x/a.z", SNIPPETS[lang], lang)
    assert not [r for r in rows if r["kind_of_row"] == "error"]
    calls = [r for r in rows if r["kind_of_row"] == "edge" and r["relation"] == "calls"]
    assert any(r["src"].endswith("bark") and "help" in r["dst"] for r in calls)
    if "Animal" in SNIPPETS[lang]:
        assert any(r["callee"] == "Animal" and r["relation"] == "inherits" for r in rows)


def test_extraction_errors_and_routes():
    assert code.extract_file("a.py", "def (", "python")[-1]["kind_of_row"] == "error"
    assert code.extract_file("a.q", "x", "q")[-1]["error"] == "no parser for q"
    assert code.route_prefix("src/app/api/(x)/users/route.ts") == "/api/users" and code.route_prefix("src/lib/a.ts") is None
    rows = code.extract_file("src/app/api/x/route.ts", "export async function POST(r) {\n}\n", "typescript")
    assert [r["label"] for r in rows if r["kind"] == "route"] == ["POST /api/x"]
    assert code.resolve_module("..b.c", "x/y/z.py") == "x/b/c" and code.resolve_module("a.b", "q.py") == "a/b"


def test_scan_rules(spark):
    paths = ["a/.env", ".env.example", "x/.ssh/config", "secrets/a.md", "secrets/a.py", "docs/api_key.txt", "my_long_notes_on_things.txt", "node_modules/a.js", ".github/w.md", "b.PY", "c.zip", "id_rsa.pub"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", scan.sensitive(F.col("path")).alias("s"), scan.is_noise_path(F.col("path")).alias("n"), scan.file_type(F.col("path")).alias("t"), scan.ignored(F.col("path"), ["*.txt", "!b.PY", "b*"]).alias("i"))
    r = {x.path: x for x in df.collect()}
    assert [p for p in paths if r[p].s] == ["a/.env", "x/.ssh/config", "secrets/a.md", "docs/api_key.txt", "id_rsa.pub"]
    assert r["node_modules/a.js"].n and not r[".github/w.md"].n and r["b.PY"].t == "code" and r["c.zip"].t is None
    assert r["docs/api_key.txt"].i and not r["b.PY"].i
    assert scan.read_ignore("# c\n*.log\n".encode("utf-16")) == ["*.log"]


def test_headings_nest(spark):
    d = spark.createDataFrame([("a.md", DOC), ("b.rst", "Title\n=====\n\nx\n"), ("c.adoc", "= T\n== U\n"), ("d.md", "One\n===\nTwo\n---\n")], "path string, content string")
    found = {(r.path, r.label): (r.level, r.line, r.end, r.parent) for r in text.sections(text.headings(d)).collect()}
    assert found["a.md", "Details"] == (3, 7, 8, 5) and found["a.md", "Other"] == (2, 9, 10, 1)
    assert found["b.rst", "Title"][0] == 1 and found["c.adoc", "U"][3] == 1 and found["d.md", "Two"] == (2, 3, 5, 1)


def test_pages_papers_notes_transcripts(spark):
    html = "<html><title>T &amp; U</title><script>x()</script><p>a&nbsp;b</p>\n\n\n\n<p>c</p>"
    xml = "<feed><entry><title>On\n X</title><summary>We do.</summary><author><name>A B</name></author><author><name>C</name></author></entry></feed>"
    r = spark.createDataFrame([(html, xml)], "h string, x string").select(text.html_to_text(F.col("h")).alias("h"), text.arxiv_to_markdown(F.col("x")).alias("x")).first()
    assert r.h.startswith("# T & U") and "x()" not in r.h and "\n\n\n" not in r.h
    assert r.x == "# On X\n\nAuthors: A B, C\n\n## Abstract\n\nWe do."
    blocks = spark.createDataFrame([("p", "1", None, 0, "heading_1", "H"), ("p", "2", "1", 0, "paragraph", "in"), ("p", "3", None, 1, "bulleted_list_item", "b")], "page string, id string, parent string, place int, type string, text string")
    assert text.notion_to_markdown(blocks).first().text == "# H\n  in\n- b"
    segments = spark.createDataFrame([("t", float(s), f"w{s}") for s in (0, 60, 119, 130, 240, 260, 4000)], "name string, start double, text string")
    assert [(x.heading, x.text) for x in text.transcript_blocks(segments).orderBy("start").collect()] == [("## 0:00", "w0 w60 w119"), ("## 2:10", "w130 w240"), ("## 4:20", "w260"), ("## 1:06:40", "w4000")]


def test_scip_and_lsp(spark):
    nodes = spark.createDataFrame([(1, "a.py", "L1-L3", "function"), (2, "b.py", "L1-L9", "class"), (3, "b.py", "L2-L4", "method")], "id long, source_file string, source_location string, kind string")
    docs = [("src/a.py", [([0, 0], "f", 1), ([1, 0], "m", 0), ([1, 4], "local 1", 0)]), ("b.py", [([1, 0], "m", 1), ([7, 0], "f", 2)])]
    index = spark.createDataFrame([(docs,)], precise.SCIP_SCHEMA)
    found = {(r.src, r.relation, r.dst) for r in precise.scip_edges(precise.occurrences(index), nodes).collect()}
    assert found == {(1, "calls", 3), (2, "imports", 1)}
    lsp = precise.lsp_edges(spark.createDataFrame([(1, "b.py", 3), (1, "a.py", 2)], "node_id long, source_file string, line int"), nodes)
    assert [(r.src, r.dst) for r in lsp.collect()] == [(3, 1)]
    once = precise.with_tier(lsp, lsp, "lsp")
    assert precise.with_tier(once, lsp, "lsp").count() == once.count() == 1


def test_semantic_layer(spark, engine, tmp_path):
    import json

    req = semantic.work_order(engine.spark.createDataFrame(list(FILES.items()), "path string, content string"), engine.nodes, 4)
    assert req.count() == 2
    answer = {"annotations": {"core/auth.py": [{"label": "login()", "line": 8, "rationale": "r" * 400, "concepts": ["c"] * 9}]}, "ambiguous_edges": {"api.py": [{"src": "handle_request", "dst": "verify", "relation": "uses", "why": "w"}]}, "community_names": {"0": "n" * 90}}
    (tmp_path / "response-1.json").write_text("Sure:\n```json\n" + json.dumps(answer) + "\n```")
    e = engine.clone(str(tmp_path / "s"))
    e.apply_semantic(semantic.read_responses(spark, f"file://{tmp_path}/response-*.json"))
    login = e.nodes.where("label = 'login()'").first()
    assert len(login.rationale) == 300 and len(login.concepts) == 6 and e.store.protected()
    assert e.edges.where("evidence = 'llm' AND confidence = 'AMBIGUOUS'").count() == 1
    assert len(e.store.table("communities").where("id = 0").first().label) == 60


def test_ideas(spark):
    concepts = spark.createDataFrame([("Trust", "a.py", "why", ["t"])], "label string, anchor_file string, rationale string, tags array<string>")
    cn = semantic.concept_nodes(concepts)
    nodes = spark.createDataFrame([(1, "login()", "function"), (2, "verify()", "function")], "id long, label string, kind string")
    labels = semantic.by_label(nodes, cn)
    ideas = spark.createDataFrame([("Trust", "login()", "conceptually_related_to", "INFERRED", 0.7, "y"), ("login()", "Trust", "rationale_for", "AMBIGUOUS", 0.9, "z"), ("login()", "nothing", "rationale_for", "INFERRED", 0.9, "")], "src string, dst string, relation string, confidence string, confidence_score double, why string")
    assert sorted(r.confidence_score for r in semantic.idea_edges(ideas, labels).collect()) == [0.3, 0.65]
    groups = spark.createDataFrame([("g", ["Trust", "login()", "verify()"], "r"), ("h", ["Trust", "Trust", "login()"], "r")], "label string, members array<string>, relation string")
    assert [r.label for r in semantic.hyperedges(groups, labels).collect()] == ["g"]


def test_scalars(spark):
    row = spark.range(1).select(scalars.normalize(F.lit("Straße—X  y")).alias("n"), scalars.norm_label(F.lit("Éa")).alias("l"), scalars.trigrams(F.lit("Ab")).alias("t"), scalars.quantize_confidence(F.lit(0.7)).alias("q"), scalars.path_suffixes(F.lit("a/b")).alias("p"),
                                scalars.location_end(F.lit("L3-L9")).alias("e"), scalars.timestamp_label(F.lit(3700)).alias("s"), scalars.module_stem(F.lit("A/b/__init__.py")).alias("m"), scalars.file_stem(F.lit("a.b/c.d.py")).alias("f")).first()
    assert tuple(row) == ("strasse_x_y", "ea", ["ab"], 0.65, ["a/b", "b"], 9, "1:01:40", "a/b", "a.b/c.d")


def test_text_functions():
    assert [fuzzy.stem(w) for w in "caresses ponies authentication relational hopping sky flies troubled".split()] == ["caress", "poni", "authent", "relat", "hop", "sky", "fli", "troubl"]
    assert fuzzy.lcs("kitten", "sitting") == 4 and fuzzy.ratio("abc", "abc") == 100 and fuzzy.partial_ratio("abc", "xxabcxx") == 100
    v = fuzzy.hash_embedding("login flow")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_watch(spark, tmp_path):
    from lattica.streaming import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("def f(): pass\n")
    seen = []
    for _ in range(2):
        streams.watch(spark, f"file://{tmp_path}/in", lambda rows, b: seen.extend(r.path.rsplit("/", 1)[-1] for r in rows.select("path").collect()), f"file://{tmp_path}/ck").awaitTermination()
        (tmp_path / "in/b.py").write_text("def g(): pass\n")
    assert seen == ["a.py", "b.py"]


def test_files_are_parsed_by_as_many_tasks_as_their_count_asks_for(spark, monkeypatch):
    from lattica.sources import code

    monkeypatch.setattr(code, "FILES_OF_TASK", 10)
    files = spark.createDataFrame([(f"m/p{i}.py", f"def f{i}():\n    pass\n", "python") for i in range(95)], "path string, text string, lang string").coalesce(1)
    rows = code.extract(files)
    assert rows.rdd.getNumPartitions() == 10 and rows.where("kind = 'function'").count() == 95


def test_references_are_resolved_without_the_text(spark, monkeypatch):
    import html

    texts = ["&amp;lt; a", "&eacute;&#233;&#xe9 &notit; &amp &nosuch; &#0; x&amp;&#128512;", "&lt;b&gt;", "& &; &&copy", None, "no", "\U0001f600&hearts;" + "&nbsp;z" * 50, "&CounterClockwiseContourIntegral;" + "y" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", text.unescaped(F.col("t")).alias("u")).collect()}
    assert got == {i: None if t is None else html.unescape(t) if i else "&lt; a" for i, t in enumerate(texts)}
    sent = []
    real = F.pandas_udf

    def udf(f, *args):
        made = real(f, *args)
        return lambda *columns: sent.extend(columns) or made(*columns)

    monkeypatch.setattr(F, "pandas_udf", udf)
    text.unescaped(F.col("t"))
    sizes = df.where("i = 6").select(F.length("t").alias("whole"), *[F.length(F.array_join(c, "")).alias("sent") for c in sent]).first()
    assert len(sent) == 1 and sizes["sent"] * 10 < sizes["whole"]


def test_only_terms_that_are_asked_for_leave_a_text(spark):
    from lattica import queries
    from lattica.operators import retrieval

    docs = spark.createDataFrame([(1, "Thing things other thing"), (2, None), (3, "none of it")], "doc_id long, text string")
    index, lengths = retrieval.matched(docs, "doc_id", F.col("text"), ["thing", "zz"])
    whole = retrieval.postings(docs, "doc_id", F.col("text"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(index) == rows(whole.where("term LIKE 'thing%'")) == [("thing", 1, 2), ("things", 1, 1)]
    assert rows(lengths) == rows(retrieval.doc_lengths(docs, "doc_id", F.col("text")))
    plan = queries.QUERIES["bm25_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Generate explode") <= 2


def test_stems_and_like_words_ask_python_for_few(spark):
    from lattica.operators import retrieval

    assert all(fuzzy.stem(w)[:1] == w[:1] for w in ["ies", "sses", "sky", "sing", "eed", "agreed", "yes", "ss", "oed", "ation", "ied", "7s", "relational", "ee", "ying"])
    n = spark.createDataFrame([(i, f"order {i}", f"order {i}", f"order:{i}", "a.py", "L1", "function", "code", 1, None) for i in range(1, 400)] + [(900, "happy suppliers", "happy suppliers", "s", "b.py", "L1", "function", "code", 2, None)],
                              "id long, label string, norm_label string, slug string, source_file string, source_location string, kind string, file_type string, degree long, rationale string")
    text = F.concat_ws(" ", "label", "slug")
    index, _ = retrieval.matched(n, "id", text, ["h", "7"])
    assert {r.term for r in index.collect()} == {"happy"} | {str(i) for i in range(1, 400) if str(i)[0] == "7"}
    whole = retrieval.postings(n, "id", text, stems=True).where("substr(term, 1, 1) IN ('h', '7')")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.by_stem(index)) == rows(whole)
    assert retrieval.expanded_terms(n, ["happi"]) == ["happi", "happy"]
    assert rows(retrieval.trigram_index(n, ["ord", "hap"])) == rows(retrieval.trigram_index(n).where("trigram IN ('ord', 'hap')"))
