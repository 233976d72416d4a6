import pytest

from .fixture import rows, table
from .test_operators import TEXTS, components, exact_groups, library, sha, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline
    from lattica.llm.common import staged

    docs, out = table(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := staged(stage(spark, docs, ""), "stage"))
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "BPE" or after.columns == before.columns


def test_language_stage_rejects_what_has_no_letter(stages):
    before, after = map(texts_of, stages["language ID"])
    assert set(before) - set(after) == {d for d, t in TEXTS.items() if not any(c.isalpha() for c in t or "")}
    assert all(after[d] == before[d] for d in after)


def test_exact_stage_is_brute_force(stages):
    before, after = map(texts_of, stages["exact dedup"])
    assert after == {d: before[d] for d, x in exact_groups(before).items() if x[2]}


def test_near_stage_is_brute_force(stages):
    before, after = map(texts_of, stages["near dedup"])
    assert after == {d: before[d] for d, x in components(before, 5, 80).items() if x[2]}


def test_mix_stage_takes_whole_words(stages):
    before, after = stages["mix"]
    before = texts_of(before)
    total = 0
    for r in after.collect():
        w, full = words(r.text), words(before[r.doc_id])
        assert w == full[: len(w)] and w and r.n_chars == len(r.text)
        total += len(w)
    target = 1.5 * sum(len(words(t)) for t in before.values())
    assert target - 6 <= total <= target


def test_bpe_stage_is_the_library(stages):
    before, after = stages["BPE"]
    tok = library("word_bpe_49k.json")
    want = sorted((r.doc_id, sha(" ".join(map(str, tok.encode(r.text, add_special_tokens=False).ids)))) for r in before.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in after.collect()) == want


class Given:
    """Stands for a table; keeps what would run in a Python worker."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        self.work = work
        return self


def test_a_worker_keeps_the_tables_of_one_stage(spark, monkeypatch):
    import pyarrow as pa
    import pyspark

    from lattica.llm import bpe, common, langid, near

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    file, given = common.tokenizer_path(bpe.WORD_FILE), Given()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["der lange weg", "the long way there and back"]})
    model = langid.fit([("de", "der lange weg"), ("en", "the long way")], common.tokenizer_path(langid.PIECE_FILE))
    held = lambda: (len(langid._TABLES), len(common._DIGESTS) > 0, len(bpe._ENCODERS))
    langid._predict(model, "a table", ["der weg"])
    near.signatures(given, 5)
    assert sum(x.num_rows for x in given.work(iter([batch]))) == 2 and held() == (0, True, 0)
    langid._predict(model, "a table", ["der weg"])
    bpe._chunks(given, file, 4)
    assert [x.column(1).to_pylist() for x in given.work(iter([batch]))] == [[[1, 2]]] and held() == (0, False, 1)


def test_a_worker_gives_back_what_is_free():
    import re
    from pathlib import Path

    import pyarrow as pa

    from lattica.llm.common import lean

    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    kept = []

    def work(batches):
        for b in batches:
            many = [bytes(2000) for _ in range(50_000)]
            kept.append(many[-1])  # so that the end of the heap is in use
            del many
            yield b

    before = own()
    for _ in lean("nothing", work)(iter([pa.RecordBatch.from_pydict({"x": [1]})])):
        held = own() - before
    assert held > 50 and own() - before < held / 2


def test_run_is_the_stages(spark, stages, tmp_path):
    import corpus_pipeline

    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages["BPE"][1].count()
    assert len(rows()) == 60


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
