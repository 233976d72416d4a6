import json

from lattica import cli, serve
from lattica.engine import GraphEngine
from lattica.sources import ingest


def args(**kw):
    import argparse

    return argparse.Namespace(**({"depth": 3, "budget": 2000, "registry": ""} | kw))


def test_cli_and_tools(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def login(): pass\n")
    (tmp_path / "src/b.py").write_text("from a import login\ndef handle_it():\n    login()\n")
    store = str(tmp_path / "store")
    cli.run(spark, args(command="extract", path=str(tmp_path / "src"), store=store))
    cli.run(spark, args(command="affected", label="login", store=store))
    assert "handle_it()" in capsys.readouterr().out
    (tmp_path / "src/b.py").unlink()
    cli.run(spark, args(command="check-update", path=str(tmp_path / "src"), store=store))
    assert capsys.readouterr().out.split() == ["b.py", "deleted"]
    e = GraphEngine(spark, store)
    call = lambda name, **a: serve.handle(e, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert "handle_it" in call("get_neighbors", label="login")["content"][0]["text"]
    assert call("get_node", label="nothing such")["isError"] and call("no_tool")["isError"]
    assert json.loads(call("graph_stats")["content"][0]["text"])["nodes"] == 4
    assert serve.handle(None, {"id": 2, "method": "tools/list"})["result"]["tools"] and serve.handle(None, {"method": "x"}) is None
    assert serve.handle(None, {"id": 3, "method": "tools/call", "params": {"name": "explain"}})["result"]["isError"]
    assert serve.handle(None, {"id": 4, "method": "x"})["error"]["code"] == -32601


def test_sources(spark):
    raw = spark.createDataFrame([("https://x.org/p", "<title>T</title><p>b</p>"), ("a.md", "# M")], "source string, body string")
    texts = {r.source: (r.kind, r.text) for r in ingest.to_markdown(raw).collect()}
    assert texts == {"https://x.org/p": ("web", "# T\n\nb"), "a.md": ("file", "# M")}
    assert sorted(r.path for r in ingest.as_corpus(ingest.to_markdown(raw).select("source", "text")).collect()) == ["sources/a_md.md", "sources/https_x_org_p.md"]
    page = spark.createDataFrame([("c", json.dumps({"title": "P", "body": {"storage": {"value": "<p>x</p>"}}}))], "source string, json string")
    assert ingest.confluence_to_markdown(page).first().text == "# P\n\nx"
    files = spark.createDataFrame([("a.txt", bytearray(b"hi")), ("b.xyz", bytearray(b"?"))], "path string, content binary")
    assert {r.path: r.text for r in ingest.converted(files).collect()} == {"a.txt": "hi", "b.xyz": "# b.xyz\n\nNo converter for .xyz is installed."}
