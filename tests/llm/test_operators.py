import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, common, exact, langid, media, mix, near, secretscan, substring, tokenfile, toxicity
from lattica.llm.common import staged, tokenizer_path

from .fixture import empty, rows, table

TEXTS = {r[0]: r[1] for r in rows()}
# Two words with one polynomial hash modulo 2 ** 64, whatever its base and the letters' codes.
TWIN_A, TWIN_B = "a", "b"
for _ in range(11):
    TWIN_A, TWIN_B = TWIN_A + TWIN_B, TWIN_B + TWIN_A
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(t):
    return (t or "").encode().split()


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 substring dedup


def without_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        w = words(texts[d])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(x)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    return out


def test_substring_dedup_is_brute_force(spark):
    found = got(substring.deduplicate(table(spark)))
    want = without_repeats(TEXTS)
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in found.items()} == want
    assert sum(x[1] for x in want.values()) > 100


def test_substring_query_feeds_batches_to_an_index(spark, monkeypatch):
    compacted, compact = [], substring.Index.compact
    monkeypatch.setattr(substring.Index, "compact", lambda self: (compacted.append(len(self.runs)), compact(self)))
    found = got(substring.deduplicate_in_batches(table(spark).where("doc_id <> 44")))
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in found.items()} == without_repeats({d: t for d, t in TEXTS.items() if d != 44})
    assert compacted == [substring.RUNS]


def test_substring_tells_twins_apart_and_heavy_fingerprints_meet(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 50)
    monkeypatch.setattr(substring, "SAMPLE", 1)
    head = " ".join(f"w{i}" for i in range(19))
    texts = {1: f"{head} {TWIN_A}", 2: f"{head} {TWIN_B}", 3: f"{head} {TWIN_A}", **{10 + i: f"{head} z {head} {i % 3}" for i in range(20)}}
    found = got(substring.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in found.items()} == without_repeats(texts)


def test_substring_batches_equal_one_batch_and_runs_compact(spark):
    whole = got(substring.deduplicate(table(spark)))
    index, parts = substring.Index(spark), {}
    for a in range(0, 60, 15):
        batch = table(spark).where((F.col("doc_id") >= a) & (F.col("doc_id") < a + 15))
        past = table(spark).where(F.col("doc_id") < a)
        parts |= got(substring.deduplicate(batch, index, past))
    assert parts == whole
    assert len(index.runs) <= substring.RUNS


def test_substring_index_without_history_raises(spark):
    index = substring.Index(spark)
    substring.deduplicate(table(spark).where("doc_id < 10"), index)
    with pytest.raises(ValueError, match="history"):
        substring.deduplicate(table(spark).where("doc_id >= 10"), index)


def test_substring_marks_only_group_and_need_no_digests(spark, monkeypatch):
    """Fingerprints come from arrays alone: a digest of each distinct word took more time than all else in them."""
    monkeypatch.setattr(common, "word_digests", lambda words: pytest.fail("a digest of each word"))
    w = common.Spans([b"a b  c d", b"x a\tb c", f"{TWIN_A} b c".encode(), f"{TWIN_B} b c".encode()])
    assert w.bounds.tolist() == [0, 4, 8, 11, 14]
    marks = w.marks(3)
    assert marks[0] == marks[5] and marks[8] == marks[11]  # equal words, and twins
    assert len({int(marks[i]) for i in (0, 1, 4, 8)}) == 4
    code, distinct = w.numbered(np.array([0, 5, 8, 11, 13]))
    assert [distinct[c] for c in code] == [b"a", b"a", TWIN_A.encode(), TWIN_B.encode(), b"c"] and len(distinct) == 4
    texts = {1: " ".join(f"w{i}" for i in range(60)), 2: "z " + "  ".join(f"w{i}" for i in range(20, 50)), 3: None}
    found = got(substring.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in found.items()} == without_repeats(texts)


def test_substring_edges(spark):
    assert substring.deduplicate(empty(spark)).count() == substring.deduplicate_in_batches(empty(spark)).count() == 0
    twice = table(spark).unionByName(table(spark).where("doc_id = 12"))
    rows12 = [r for r in substring.deduplicate(twice).collect() if r.doc_id == 12]
    assert len(rows12) == 2 and rows12[0] == rows12[1]
    null_id = substring.deduplicate(table(spark, [(None, TEXTS[1], *[None] * 12)])).where("doc_id IS NULL").collect()
    assert [r.n_removed for r in null_id] == [0]
    text = got(substring.deduplicate(table(spark), with_text=True))
    assert all(sha(r.kept_text) == r.kept_sha256 for r in text.values())


# 2 secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(t):
    t = t or ""
    x = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    x += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    x += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(x)]


def test_secrets_are_brute_force(spark):
    found = got(secretscan.secret_summary(table(spark)))
    for d, t in TEXTS.items():
        spans = base_spans(t)
        assert found[d].base_sha256 == sha(",".join(spans))
        assert set(spans) <= set(found[d].spans.split(",")) | {""}
    assert found[46].n_assign == found[46].n_access == found[46].n_hex == 1 and "github" in found[47].spans
    assert secretscan.secret_summary(empty(spark)).count() == 0


@pytest.mark.parametrize("rule, text, query", [("abcd", "xabcdx", [{"abc", "bcd"}]), ("(foo|bard)x?", "bard", [{"bar", "ard"}, {"foo"}]), ("[0-9]+", "12", None), ("ab?c", "ac", None), ("(xyz)+[Aa]bc", "xyzABC", [{"xyz", "abc"}])])
def test_trigram_queries(rule, text, query):
    found = secretscan.trigram_query(rule)
    assert (None if found is None else sorted(map(sorted, found))) == (None if query is None else sorted(map(sorted, query)))


def test_index_leaves_every_match(spark):
    texts = [t or "" for t in TEXTS.values()] + ["pass", "word = abcdefg", "PassWord=abcdefg"]
    s = secretscan.Scanner(secretscan.RULES)
    for kind, rule, _, _ in s.rules:
        hit = {i for i, t in enumerate(texts) if rule.search(t)}
        assert hit <= set(secretscan.candidates(s.queries[kind], s.index.postings(texts), len(texts)).tolist())


# 3 mixture


def test_mix_meets_targets(spark):
    found = mix.mix_summary(table(spark), blocks=4, shards=4)
    size = got(found)
    per, target = defaultdict(int), {}
    for d, r in size.items():
        source = rows()[d][3]
        assert r.size == len(words(TEXTS[d])) and 0 <= r.taken <= 2 * r.size and (r.taken > 0) == (r.first_shard is not None)
        per[source] += r.taken
        target[source] = r.target
        assert r.target <= 2 * r.source_size
    assert all(per[s] == int(target[s]) for s in target)
    total = sum(r.size for r in size.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    sizes = {rows()[d][3]: r.source_size for d, r in size.items()}
    below = {s: target[s] / w for s, w in zip(sorted((s for s in target if s), key=str), [3, 1, 2, 3]) if target[s] < 2 * sizes[s] - 1e-9}
    assert len({round(x, 6) for x in below.values()}) <= 1
    assert sorted(map(str, found.collect())) == sorted(map(str, mix.mix_summary(table(spark).repartition(3), blocks=4, shards=4).collect()))


def test_shards_hold_what_the_tree_gives_them(spark):
    m = mix.mixture(table(spark), blocks=4, shards=4)
    draws = [(r._source, r._block, t.copy, t.shard) for r in m.draws.collect() for t in [*r.whole, *([r.edge] if r.edge else [])]]
    assert len({x[:3] for x in draws}) == len(draws)  # no block twice in a pass
    slots = spark.createDataFrame([(s, f"{i}|{s or '-'}") for s in {x[0] for x in draws} for i in range(1, 1 + sum(x[0] == s for x in draws))], "source string, slot string")
    quota = {(r.source, r.shard): r["count"] for r in mix.split_quotas(slots, 4, "mix").groupBy("source", "shard").count().collect()}
    have = defaultdict(int)
    for s, _, _, shard in draws:
        have[s, shard] += 1
    assert have == quota
    out = mix.mixed_shards(table(spark), blocks=4, shards=4)
    assert out.columns == [*table(spark).columns, "_copy", "_shard"]
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
    assert taken == {d: r.taken for d, r in got(mix.mix_summary(table(spark), blocks=4, shards=4)).items() if r.taken}


def test_tree_keeps_quotas_and_splits_evenly(spark):
    slots = spark.range(101).select(F.concat(F.lit("u"), "id").alias("slot"))
    per = [r["count"] for r in mix.split_quotas(slots, 8, "t").groupBy("shard").count().collect()]
    assert sum(per) == 101 and len(per) == 8 and max(per) - min(per) <= 3


def test_mix_edges(spark):
    assert mix.mix_summary(empty(spark)).count() == 0
    assert mix.mixed_shards(table(spark).where("doc_id IN (40, 42)")).count() == 0
    assert {r.taken for r in mix.mix_summary(table(spark).where("doc_id IN (40, 42)")).collect()} == {0}


def test_mix_counts_rows_without_and_with_repeated_ids(spark):
    extra = [(d, TEXTS[44], "en", "s1", *[None] * 10) for d in (44, None, None)]
    found = mix.mix_summary(table(spark, extra), blocks=4, shards=4).collect()
    assert len(found) == 63 and all(r.taken <= 2 * r.size for r in found)
    per = defaultdict(int)
    for r in found:
        per[r.source_size, r.target] += r.taken
    assert {int(t): n for (_, t), n in per.items()} == {int(t): int(t) for _, t in per}


def test_mix_counts_words_once(spark):
    out = mix.mixed_shards(table(spark))
    assert "regexp_count" not in out._jdf.queryExecution().optimizedPlan().toString()
    m = mix.mix_summary(table(spark)).agg(F.sum("draws"), F.sum("taken")).first()
    assert (out.count(), sum(len(words(r.text)) for r in out.collect())) == tuple(m)


# 4 toxicity


def labelled(spark, n=400):
    docs, labels = [], []
    import random

    r = random.Random(3)
    for i in range(n):
        w = [r.choice(["the", "an", "er", "thing", "ont", "reing", "you", "not"]) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[r.randint(1, 38)] = r.choice(["wretchling", "wretchlet", "dolt"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(n, None), (n + 1, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(n, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_stems_and_scores_clauses(spark):
    docs, labels = labelled(spark)
    found = got(toxicity.toxicity(docs, labels))
    held = [r for d, r in found.items() if d < 400 and r.held_out]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    assert found[400].score == found[401].score == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_grammar_weighs_context():
    g = toxicity.Grammar({"idiot": 0.9})
    plain, negated, reported = (g.score(t) for t in ("you are an idiot.", "you are not an idiot.", "they said you are an idiot."))
    assert plain > negated > reported > 0
    assert g.score("idiot. they said nothing.") == g.score("idiot")
    assert g.score("i will kill you") > 0.2 > g.score("kill time")


def test_grammar_is_brute_force():
    import random

    g, r = toxicity.Grammar({"idiot": 0.9}), random.Random(8)
    kinds = {"idiot": "i", "idiots": "i", "kill": "k", "you": "t", "not": "n", "aren't": "n", "don’t": "n", "said": "r"}
    for _ in range(3000):
        tokens = [r.choice(["idiot", "idiots", "kill", "you", "not", "aren't", "don’t", "said", "the", "a", "thing"]) for _ in range(r.randint(1, 14))]
        k, want = [kinds.get(t, "o") for t in tokens], []
        taken = -1  # a target ends a threat; so does a negation, or a later threat
        for i, x in enumerate(k):
            near = lambda c, n: c in k[max(0, i - n) : i]  # noqa: E731, B023
            marks = {m for m, yes in (("report", "r" in k[:i]), ("target", near("t", 6)), ("negation", near("n", 3))) if yes}
            if x == "i":
                want.append("+".join(sorted(marks)))
            if x == "t":
                j = next((j for j in range(i - 1, max(taken, i - 4), -1) if k[j] in "kn"), None)
                if j is not None and k[j] == "k":
                    first, denied = j, False
                    while True:  # threats in a row that each came while the one before waited
                        denied = "n" in k[max(taken + 1, first - 3) : first]
                        earlier = next((e for e in range(first - 1, max(taken, first - 4), -1) if k[e] in "kn"), None)
                        if earlier is None or k[earlier] == "n":
                            break
                        first = earlier
                    want.append("threat+" + "+".join(sorted(marks - {"negation"} | ({"negation"} if denied else set()) | {"target"})))
                if j is not None and k[j] == "k":
                    taken = i
        assert [c for c, _ in g.clauses(" ".join(tokens))] == want, tokens


def test_contractions_negate():
    g = toxicity.Grammar({"idiot": 0.9})
    assert g.score("you aren't an idiot.") == g.score("you are not an idiot.") < g.score("you are an idiot.")
    assert g.score("i won't kill you") < g.score("i will kill you") and g.score("tu es l'idiot") > 0.5


def test_toxicity_takes_repeated_rows_and_other_columns(spark):
    docs, labels = labelled(spark, 100)
    more = docs.unionByName(docs.where("doc_id = 5")).withColumns({"toxic": F.lit(0), "score": F.lit(0.5), "stem": F.lit("x"), "held_out": F.lit(True)})
    assert toxicity.toxicity(more, labels.withColumn("text", F.lit("y"))).count() == 103


def test_long_clauses_run_whole():
    g = toxicity.Grammar({"idiot": 0.9})
    hit, far = ("", 0.9), "a " * 15_000
    assert list(g.clauses("they said " + far + "an idiot " + far)) == [("report", 0.9)]
    assert list(g.clauses("idiot " + "a " * 9_996 + "idiot " + far)) == [hit] * 2  # the second lies over the place 20,000 on
    assert list(g.clauses("idiot " + "a " * 9_800 + "idiot " + "a " * 500 + "idiot " + far)) == [hit] * 3


# 5 media


def test_media_round_trip(spark):
    found = got(media.media_features(media.media_table(table(spark))))
    for d, t in TEXTS.items():
        x = (t or "").encode()
        y = media.payload_of(x)
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), len(y), sha(y), zlib.crc32(y[-64:])) and len(y) % 64 == 0 and len(y) > 0
    assert found[1] [1:] == found[3][1:] and len(found[44].feature) == 16


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters_and_damage(kind):
    data = media.payload_of(bytes(range(256)) * 3 + b"x")
    png = media.write_png(data, kind)
    assert media.read_png(png).tobytes() == data
    with pytest.raises(ValueError):
        media.read_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])
    with pytest.raises(ValueError):
        media.read_png(png[:-12])


def test_media_edges_and_feature(spark):
    assert media.media_features(media.media_table(empty(spark))).count() == 0
    twice = table(spark).where("doc_id = 1")
    assert len(media.media_features(media.media_table(twice.unionByName(twice))).collect()) == 2
    rng = np.random.default_rng(7)
    for h in (1, 5, 32, 77):
        image = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        at = lambda n, i: (i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32))
        small = [[image[slice(*at(h, y)), slice(*at(64, x))].mean() for x in range(32)] for y in range(32)]
        low = [sum(small[y][x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = sorted(round(x, 6) for x in low[1:])[31]
        bits = "".join("1" if round(x, 6) > middle else "0" for x in low)
        assert media.cosine_hash(image) == f"{int(bits, 2):016x}"


def test_unfilter_average_and_paeth():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    for kind in (3, 4):
        lines = np.zeros((5, 8), np.uint8)
        lines[:, 0] = kind
        for y in range(5):
            for x in range(7):
                a = int(image[y, x - 1]) if x else 0
                b = int(image[y - 1, x]) if y else 0
                c = int(image[y - 1, x - 1]) if x and y else 0
                p = a + b - c
                guess = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                lines[y, x + 1] = (int(image[y, x]) - guess) % 256
        assert (media.unfiltered(lines) == image).all()


# 6 and 8 tokens


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_bpe_is_the_library(spark):
    tok, found = library(bpe.WORD_FILE), got(bpe.bpe_documents(table(spark)))
    for d, t in TEXTS.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (found[d].n_tokens, found[d].ids_sha256, found[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    file = tokenizer_path(bpe.WORD_FILE)
    back = table(spark).select("doc_id", bpe.encoded(F.col("text"), file).alias("ids")).select("doc_id", "ids", bpe.decoded(F.col("ids"), file).alias("back"))
    assert all(r.back == tok.decode(r.ids, skip_special_tokens=False) for r in back.collect())
    assert bpe.bpe_documents(empty(spark)).count() == 0
    twice = table(spark).where("doc_id IN (1, 42)").unionByName(table(spark).where("doc_id = 1"))
    assert sorted(r.doc_id for r in bpe.bpe_documents(twice).collect()) == [1, 1, 42]


def test_chunks_of_a_task_share_a_bucket(spark, monkeypatch):
    for n in (0, 1, 2**40, 2**62 + 12345):
        assert bpe.spark_bucket(n, 51) == spark.range(1).select(F.pmod(F.hash(F.lit(n).cast("long")), F.lit(51))).first()[0]
    want = {r.doc_id: r.ids for r in bpe.token_ids(table(spark)).collect()}
    monkeypatch.setattr(bpe, "CHUNK", 300)  # many chunks a task
    monkeypatch.setattr(bpe, "WORDS", 10)
    assert {r.doc_id: r.ids for r in bpe.token_ids(table(spark)).collect()} == want


@pytest.mark.parametrize("name", [bpe.WORD_FILE, bpe.BYTE_FILE])
def test_encoder_is_the_library_in_every_script(name):
    import random
    import unicodedata

    r, tok, e = random.Random(4), library(name), bpe.Encoder(tokenizer_path(name))
    known = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(chr(r.choice(known)) if r.random() < 0.7 else r.choice(" a1.'s\u0301\n") for _ in range(40)) for _ in range(3000)]
    texts += ["\u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440! \u6771\u4eac\u306f\u3044 \u0645\u0631\u062d\u0628\u0627 \U0001f600\U0001f1e9 \u039f\u0394\u03a3 \u039f\u03a3 \u0130x e\u0301", "a<|endoftext|>b<|startoftext|><|ENDOFTEXT|> <|endoftext|>", "x " + TWIN_A + " " + TWIN_B, ""]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_splits_are_the_patterns():
    import random

    import public_tokenizers
    import regex

    from lattica.llm.segment import Points, byte_level_pieces, text_ranges, word_level_pieces

    r = random.Random(2)
    texts = ["".join(r.choice("aabstrevmld'''  \n\t\r12é.!ß²\xa0ª") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    word = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    for split, pattern in ((byte_level_pieces, public_tokenizers.PATTERN), (word_level_pieces, word)):
        p = Points(texts)
        s, e = split(p)
        b = text_ranges(p, s)
        for i, t in enumerate(texts):
            assert [p.text[x:y] for x, y in zip(s[b[i] : b[i + 1]], e[b[i] : b[i + 1]])] == regex.findall(pattern, t)


def test_token_files_are_the_library(spark, tmp_path):
    tok, start = library(bpe.BYTE_FILE), 0
    extra = [(None, "no id", *[None] * 12), (7, TWIN_A + " " + TWIN_B, *[None] * 12)]
    more = TEXTS | {7: TWIN_A + " " + TWIN_B}
    manifest = tokenfile.write_tokens(table(spark, extra).where("doc_id IS NULL OR doc_id <> 7 OR lang IS NULL"), f"file://{tmp_path}/t", file_tokens=900)
    assert manifest.count() > 2
    found = got(tokenfile.read_tokens(manifest, f"file://{tmp_path}/t"))
    for d, t in [*sorted(more.items()), (None, "no id")]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(found[d])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    twice = table(spark).where("doc_id = 1")
    twice = tokenfile.write_tokens(twice.unionByName(twice), f"file://{tmp_path}/r")
    assert sorted(r.start for r in tokenfile.read_tokens(twice, f"file://{tmp_path}/r").collect()) == [0, found[1].n_tokens]
    none = tokenfile.write_tokens(empty(spark), f"file://{tmp_path}/e")
    assert tokenfile.read_tokens(none, f"file://{tmp_path}/e").count() == 0


def test_words_are_merged_together_and_packed_side_by_side():
    """What op8 spends its time on: a call a distinct word, and a step a packed word."""
    e = bpe.Encoder(tokenizer_path(bpe.BYTE_FILE))
    calls, model = [], e.tok.model

    class Counted:
        def tokenize(self, x):
            calls.append(x)
            return model.tokenize(x)

    class Tok:
        model = Counted()

    library, e.tok = e.tok, Tok()
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    texts = [" ".join(f"wo{letters(i)}x{letters(k)}ć" for i in range(400)) + "  \n x  à é\xa0 \xa0y 's <|endoftext|> z" for k in range(5)]
    found = list(e.encode([*texts, "", texts[0]]))
    assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, "", texts[0]]]
    assert len(calls) < 100  # of 2,000 distinct words

    r = np.random.default_rng(7)
    sizes = np.append(r.integers(0, 40, 3 * tokenfile.SIDE), [9000, 1])
    begin = np.cumsum(sizes) - sizes
    step = r.integers(1, 61, int(sizes.sum())).astype(np.uint8)
    want = []
    for b, n in zip(begin.tolist(), sizes.tolist()):
        i = b
        while i < b + n:
            want.append(i)
            i += int(step[i])
    assert tokenfile._word_starts(step, begin, begin + sizes).tolist() == want
    wide = r.integers(0, 1 << 63, 50, dtype=np.uint64) >> r.integers(0, 64, 50, dtype=np.uint64)
    assert tokenfile.bit_lengths(wide).tolist() == [int(x).bit_length() for x in wide] and tokenfile.bit_lengths(np.uint64([0, 1, 2, 131071])).tolist() == [0, 1, 2, 17]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for k in range(60):
        sizes = rng.integers(0, 200, rng.integers(1, 9))
        shift = rng.choice([0, 1, 3, 20, 40, 48, 50, 60, 62, 63], sizes.sum()).astype(np.uint64)
        ids = ((rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)) >> shift
        ids = ids % np.uint64(3) if k % 3 == 0 else ids
        w, n = tokenfile.pack(ids, sizes)
        assert (tokenfile.unpack(w, n, sizes) == ids).all()
    w, _ = tokenfile.pack(np.zeros(600, np.uint64), [600])
    assert len(w) == 10


# 7 language ID


def test_forward_is_the_sum_over_segmentations():
    m = langid.fit([("a", "thing thinking ring"), ("b", "zorg zarg zirg")], tokenizer_path(langid.PIECE_FILE))
    v = m.vocabulary()

    def total(word, k):
        cells = v.cells(np.array([[langid._MARK, *map(ord, word)]], np.uint32))[0]
        n = len(word) + 1
        sums = [1.0] + [0.0] * n
        for j in range(1, n + 1):
            for s in range(1, min(v.longest, j) + 1):
                piece = cells[j - s, s - 1]
                if piece < v.size or s == 1:
                    sums[j] += sums[j - s] * m.chances[piece, k]
        return np.log(sums[n])

    for word in ("thing", "zorg", "q", "ünknown"):
        for k in range(2):
            assert abs(m.word_scores([word])[0, k] - total(word, k)) < 1e-6
    assert np.isfinite(m.word_scores(["x" * 5000])).all()


def test_vocabulary_has_every_letter_piece():
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(langid.PIECE_FILE)), langid.Vocabulary(tokenizer_path(langid.PIECE_FILE))
    pieces = {p for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i).lower()).strip("\u2581").isalpha() and not sp.is_control(i)}
    assert max(map(len, pieces)) == v.longest > 8
    for p in sorted(pieces, key=len)[-200:]:
        at = v.cells(np.array([[ord(c) for c in p]], np.uint32))[0, 0, len(p) - 1]
        assert at < v.size and "".join(map(chr, v.letters[at, : len(p)])) == p


def test_expected_uses_are_the_same_on_both_sides_of_the_range():
    v = langid.Vocabulary(tokenizer_path(langid.PIECE_FILE))
    p = np.random.default_rng(3).random(v.size + 1)
    cells, weight = v.cells(np.array([[langid._MARK, *map(ord, w)] for w in ("insurance", "religious")], np.uint32)), np.array([2.0, 3.0])
    assert np.allclose(langid._expected(cells, p / p.sum(), weight), langid._expected_logs(cells, p / p.sum(), weight))
    assert np.isfinite(langid.fit([("a", "x" * 3000), ("b", "ring")], tokenizer_path(langid.PIECE_FILE)).chances).all()


def test_languages_take_long_texts_repeated_rows_and_ties(spark):
    t = [(i, "same words here", "en" if i % 2 else "de") for i in range(8)] + [(8, "x" * 200_000, None), (0, "same words here", "de"), (None, "same words here", None)]
    docs = spark.createDataFrame(t, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "p": F.lit(2), "_rank": F.lit(3)})
    found = langid.languages(docs).collect()
    assert len(found) == 11 and {r.lang_pred for r in found if r.doc_id != 8} == {"de"}


def test_languages(spark):
    t = [(i, "the thing is that this ring thinks" if i % 2 else "der hund und die katze sind nicht hier", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame([*t, (40, None, "en"), (41, "12 ... !", "de"), (42, "", None), (43, "the hund", None)], "doc_id long, text string, lang string")
    found = got(langid.languages(docs))
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < found[i].score <= 1 for i in range(40))
    assert [found[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and found[40].score == 0
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(docs.limit(0)).count() == 0


def test_pieces_are_found_by_what_they_begin_with():
    v = langid.Vocabulary(tokenizer_path(langid.PIECE_FILE))
    number = {"".join(map(chr, row[row > 0])): i for i, row in enumerate(v.letters)}
    for w in ("\u2581thinkingly", "\u2581religious", "\u2581zzqxvvwkj", "\u2581é東", "sin"):
        cells = v.cells(np.array([[ord(c) for c in w]] * 2, np.uint32))
        for i in range(len(w)):
            want = [number.get(w[i : i + k + 1], v.size) if i + k < len(w) else v.size for k in range(cells.shape[2])]
            assert cells[:, i].tolist() == [want, want]


def test_words_are_scored_once_until_the_table_is_full():
    m = langid.fit([("a", "thing thinking ring"), ("b", "zorg zarg zirg")], tokenizer_path(langid.PIECE_FILE))
    asked, score = [], m.word_scores
    m.word_scores = lambda w: asked.extend(w) or score(w)
    slices = [["thing", "zorg"], ["zorg", "q"], ["q", "thing", "zirg"], ["thing"]]
    for most, times in ((100, 4), (2, 7)):
        asked.clear()
        t = langid.ScoreTable(m, most)
        assert all(np.array_equal(t.look_up(w), score(w)) for w in slices) and len(asked) == times


# 9 near-duplicates


def components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_brute_force(spark, k):
    import random

    r = random.Random(9)
    base = [f"w{r.randint(0, 400)}" for _ in range(60)]
    chain = [(100 + i, " ".join([*base[2 * i :], *(f"n{i}x{j}" for j in range(2 * i))]), *[None] * 12) for i in range(12)]  # each like the next, the ends unlike
    texts = TEXTS | {c[0]: c[1] for c in chain}
    found = got(near.near_duplicates(table(spark, chain), words=k))
    assert {d: tuple(r)[1:] for d, r in found.items()} == components(texts, k, 80)


def test_near_duplicates_tell_twins_apart(spark):
    texts = {1: TWIN_A + " x", 2: TWIN_B + " x", 3: TWIN_A + " X", 4: TWIN_A}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {d: tuple(r)[1:] for d, r in got(near.near_duplicates(docs, words=2)).items()} == components(texts, 2, 80)


def test_near_repeated_ids_and_ties(spark):
    texts = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None), (4, None)]
    found = near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(found) == 6


def test_near_edges_and_hot_buckets(spark, monkeypatch):
    assert near.near_duplicates(empty(spark)).count() == 0
    for name, small in (("BESIDE", 1), ("CENTRES", 4), ("PAIR_BYTES", 100), ("SEGMENT_BITS", 1 << 12)):
        monkeypatch.setattr(near, name, small)
    found = got(near.near_duplicates(table(spark), words=2))
    assert {d: tuple(r)[1:] for d, r in found.items()} == components(TEXTS, 2, 80)
    null_id = near.near_duplicates(table(spark, [(None, TEXTS[1], *[None] * 12)])).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in null_id] == [(None, True)]


@pytest.mark.parametrize("together", [0, 1_000_000])
def test_near_judges_a_pair_once_and_merges_rounds(spark, monkeypatch, together):
    """Buckets of texts that share bands but aren't similar stay open for many rounds; components are the same in one task and in the cluster."""
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    texts = {i: " ".join([*base[: r.randint(25, 40)], *(f"n{i}x{j}" for j in range(r.randint(2, 12)))]) for i in range(40)}
    judged, confirmed = [], near._confirmed
    monkeypatch.setattr(near, "CENTRES", 2)
    monkeypatch.setattr(near, "_confirmed", lambda pairs, *a: (judged.append({(x.a, x.b) for x in pairs.collect()}), confirmed(pairs, *a))[1])
    found = got(near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2, together=together))
    assert {d: tuple(x)[1:] for d, x in found.items()} == components(texts, 2, 80)
    assert len(judged) > 2 and sum(map(len, judged)) == len(set().union(*judged)) > 100


def test_labels_follow_links(spark):
    old = spark.createDataFrame([(4, 1), (8, 6)], "id long, root long")
    for together in (0, 10):
        found = near._merged(old, spark.createDataFrame([(8, 4), (9, 10), (5, 9), (2, 8)], "u long, v long"), together)
        assert {x.id: x.root for x in found.collect()} == {2: 1, 4: 1, 6: 1, 8: 1, 9: 5, 10: 5}


def test_collision_corrected_estimate():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9, 1.0):
        n = int(3000 * 2 * share / (1 + share))  # common elements for that Jaccard similarity
        b = np.concatenate((a[:n], rng.integers(0, 2**63, 3000 - n, dtype=np.uint64)))
        x, y = (np.frombuffer(near.packed(near.minima(np.unique(s))), "<u8")[None] for s in (a, b))
        assert abs(near.estimated(x, y)[0] - share) < 0.17


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (70, 100)]
    found = {r.id: r.root for r in near.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: v for k, v in found.items() if k != v} == {i: 1 for i in range(2, 31)} | {100: 50, 70: 50}


# 10 exact dedup


def exact_groups(texts):
    by = defaultdict(list)
    norm = {d: re.sub("[\x20\x09-\x0d]", "", t or "") for d, t in texts.items()}
    for d, n in norm.items():
        by[n].append(d)
    out = {}
    for n, ds in by.items():
        keep = min(ds, key=lambda d: (-len(texts[d] or ""), d))
        out |= {d: (keep, len(ds), d == keep, sha(n)) for d in ds}
    return out


@pytest.mark.parametrize("largest", [10_000, 2])
def test_exact_duplicates_are_brute_force(spark, largest):
    extra = [(200 + i, TEXTS[1], *[None] * 12) for i in range(30)] + [(-5, TEXTS[1], *[None] * 12)]
    found = got(exact.exact_duplicates(table(spark, extra).repartition(7), salts=4, largest=largest))
    assert {d: tuple(r)[1:] for d, r in found.items()} == exact_groups(TEXTS | {e[0]: e[1] for e in extra})


def test_exact_compares_texts_where_digests_agree(spark, monkeypatch):
    class Weak:
        sha2 = staticmethod(lambda c, n: F.lit("00" * 32))
        xxhash64 = staticmethod(lambda *c: F.lit(0).cast("long"))
        __getattr__ = staticmethod(lambda name: getattr(F, name))

    monkeypatch.setattr(exact, "F", Weak())
    texts = [(1, "abc"), (2, "a bc"), (3, "xyz"), (4, "xyz"), (5, "long one")]
    found = got(exact.exact_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {d: (r.keep_id, r.group_size) for d, r in found.items()} == {1: (2, 2), 2: (2, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


def test_exact_survivors_are_one_of_each_group(spark):
    rows = [(None, "a b"), (None, "a  b"), (None, "ab"), (1, "c"), (1, "c"), (1, "d"), (2, "c")]
    kept = exact.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [(r := kept[0].__class__)(doc_id=None, text="a  b"), r(doc_id=1, text="c"), r(doc_id=1, text="d")]))


def test_exact_survivors_with_one_digest_all_stay(spark, monkeypatch):
    class Weak:
        sha2 = staticmethod(lambda c, n: F.lit("00" * 32))
        xxhash64 = staticmethod(lambda *c: F.lit(0).cast("long"))
        __getattr__ = staticmethod(lambda name: getattr(F, name))

    monkeypatch.setattr(exact, "F", Weak())
    docs = spark.createDataFrame([(1, "abc"), (2, "a bc"), (3, "xyz"), (4, "xyz"), (5, "long")], "doc_id long, text string")
    assert {r.doc_id for r in exact.without_duplicates(docs).collect()} == {2, 3, 5}


def test_rows_go_by_ids_however_many(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (7,)], "doc_id long")
    for most in (1, 2):
        assert sorted(r.text for r in common.without_ids(docs, ids, most).collect()) == ["c", "d"]


def test_exact_edges(spark):
    assert exact.exact_duplicates(empty(spark)).count() == 0
    ids = [2**63 - 1, -(2**63), None]
    found = exact.exact_duplicates(spark.createDataFrame([(i, t) for i in ids for t in ("", "abc")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(i, -(2**63), 3, i == -(2**63)) for i in ids}
    big = staged(table(spark), "t")
    assert big.count() == 60
