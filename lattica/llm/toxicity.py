"""Toxicity by a weighted finite-state grammar: learned insult stems, threats, targets, negation and reported speech, scored by clause."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, in_batches

#: Labelled documents that are learned from at most, each of at most so many code points.
SAMPLE_DOCS, SAMPLE_CHARS = 20_000, 200_000
#: Shortest and longest stem, and the chance below which a stem that only toxic documents hold is no accident.
LEAST, MOST, CHANCE = 4, 12, 0.05
PREDICTED = 0.3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, GAP = range(7)
_THREATS = "kill hurt destroy shoot stab strangle töten umbringen matar matarte tuer".split()
_TARGETS = "you your yours u he she him her they them this these du dich dir ihr euch sie tú te ti usted vosotros ustedes tu toi vous il elle ils".split()
_NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine keinen nie nunca jamás ni pas jamais aucun".split()
_REPORTS = "said says say wrote writes quote quoted called calls sagte sagt schrieb dijo dice escribió dit disait écrit".split()
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Words of letters; a negation's n't belongs to its word.
_TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+")
#: Tokens between a threat and its target, at most, and how far a target and a negation reach.
AFTER, TARGETED, NEGATED = 3, 6, 3


class Transducer:
    """States 0..; arcs (state, symbol) -> (state, output), by default to state 0 (or where it is, if stay) without output. `marks` says which states mark an output of any machine."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, str]], marks: dict[int, str] | None = None, stay: bool = False):
        self.arcs, self.marks, self.stay = arcs, marks or {}, stay

    def step(self, state: int, symbol: int) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state if self.stay else 0, ""))


def window(symbol: int, name: str, length: int) -> Transducer:
    """Marks what comes at most `length` tokens after the symbol, up to the end of the clause."""
    arcs = {}
    for s in range(length + 1):
        for x in range(GAP):
            arcs[s, x] = max(0, s - 1), ""
        arcs[s, symbol] = length, ""
    return Transducer(arcs, {s: name for s in range(1, length + 1)})


def rest_of_clause(symbol: int, name: str) -> Transducer:
    """Marks all that comes after the symbol in its clause."""
    return Transducer({(0, symbol): (1, ""), (1, GAP): (0, "")}, {1: name}, stay=True)


def insult() -> Transducer:
    """Gives out each insult where it stands."""
    return Transducer({(0, INSULT): (0, "insult")})


def threat(after: int = AFTER, negated: int = NEGATED) -> Transducer:
    """Gives out a threat at its target, at most `after` tokens on. States: none, `negated` after a negation, then `after` each of a threat that waits plain and negated."""
    plain, denied, arcs = negated, negated + after, {}
    for s in range(negated + 2 * after + 1):
        far = s - 1 if s not in (0, plain + 1, denied + 1) else 0  # one token nearer to the end of what is waited for
        waits = s > plain
        for x in range(GAP):
            arcs[s, x] = far, ""
        arcs[s, NEGATION] = negated, ""
        arcs[s, THREAT] = (denied if 0 < s <= plain or s > denied else plain) + after, ""
        if waits:
            arcs[s, TARGET] = 0, "negated threat" if s > denied else "threat"
    return Transducer(arcs)


def composed(machines: list[Transducer]) -> tuple[dict[tuple[int, int], tuple[int, str]], list[frozenset[str]]]:
    """One machine that runs all at once: its arcs with what some machine gives out, and the marks of each of its reachable states; 0 is the start."""
    states, arcs, todo = {(0,) * len(machines): 0}, {}, [(0,) * len(machines)]
    while todo:
        at = todo.pop()
        for x in range(GAP + 1):
            steps = [m.step(s, x) for m, s in zip(machines, at)]
            to = tuple(s for s, _ in steps)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            arcs[states[at], x] = states[to], "".join(o for _, o in steps)
    marks = [frozenset(m.marks[s] for m, s in zip(machines, at) if s in m.marks) for at in states]
    return arcs, marks


def prior(context: str) -> float:
    """How sure a context makes an insult before anything is learned."""
    weak = ("negation" in context) + ("threat" in context) + 2 * ("report" in context)
    return (0.9, 0.5, 0.25)[min(weak, 2)]


class Grammar:
    """stems: insult stem -> how sure it is; contexts: set of marks -> how sure an insult in it is, as learned."""

    def __init__(self, stems: dict[str, float], contexts: dict[str, float] | None = None):
        self.stems, self.contexts = stems, contexts or {}
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def ready(self):
        if self._ready is None:
            arcs, marks = composed([insult(), threat(), window(TARGET, "target", TARGETED), window(NEGATION, "negation", NEGATED), rest_of_clause(REPORT, "report")])
            kinds = {w: k for k, words in ((THREAT, _THREATS), (TARGET, _TARGETS), (NEGATION, _NEGATIONS), (REPORT, _REPORTS)) for w in words}
            by = sorted(self.stems, key=lambda s: (-len(s), s))
            words = "|".join(map(re.escape, by))
            seek = rf"(?<![^\W\d_])(?:{words + '|' if words else ''}(?:{'|'.join(_THREATS)})(?![^\W\d_]))"
            self._ready = arcs, marks, kinds, re.compile(seek), sorted({len(s) for s in by})
        return self._ready

    def symbols(self, clause: str) -> Iterator[tuple[int, float]]:
        """The symbol of each token, and how sure an insult is."""
        _, _, kinds, _, lengths = self.ready()
        for m in _TOKEN.finditer(clause):
            word = m.group()
            stem = next((word[:n] for n in lengths if word[:n] in self.stems), None) if len(word) >= LEAST else None
            symbol = INSULT if stem else kinds.get(word, NEGATION if word[-3:] in ("n't", "n’t") else OTHER)
            yield symbol, self.stems[stem] if stem else 0.6

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """(context, sureness of the word) of each insult or threat at a target, clause by clause."""
        arcs, marks, _, seek, _ = self.ready()
        low = text.lower()
        found = [m.start() for m in seek.finditer(low)]
        if not found:
            return
        for clause in self._around(low, found):
            state = 0
            for symbol, sure in self.symbols(clause):
                was, (state, out) = state, arcs[state, symbol]
                if out == "insult":
                    yield "+".join(sorted(marks[was])), sure
                elif out:
                    yield "threat+" + "+".join(sorted(marks[was] - {"negation"} | ({"negation"} if out == "negated threat" else set()) | {"target"})), sure

    @staticmethod
    def _around(low: str, found: list[int]) -> Iterator[str]:
        """Each clause that holds a place of `found`, once and whole, however long."""
        upto = -1
        for at in found:
            if at < upto:
                continue
            begin = max(low.rfind(c, 0, at) for c in ".!?;:\n") + 1
            stop = _CLAUSE.search(low, at)
            upto = stop.start() if stop else len(low)
            yield low[begin:upto]

    def score(self, text: str) -> float:
        left = 1.0
        for context, sure in self.clauses(text):
            left *= 1 - sure * self.contexts.get(context, prior(context))
            if left < 1e-9:
                break
        return 1 - left


def stems_of(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(LEAST, min(len(w), MOST) + 1)}


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Grammar:
    """The grammar of labelled (text, toxic) rows, at most sample_docs of them: stems whose documents are toxic beyond chance, and how sure each context is."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tox, clean, seen = Counter(), Counter(), Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                (tox if y else clean).update(stems_of(set(_TOKEN.findall(t.lower()))))
                seen[int(y)] += 1
            if len(clean) + len(tox) > 500_000:
                yield pd.DataFrame([(s, tox[s], clean[s]) for s in tox.keys() | clean.keys()], columns=["stem", "tox", "clean"])
                tox, clean = Counter(), Counter()
        rows = [(s, tox[s], clean[s]) for s in tox.keys() | clean.keys()] + [("", seen[1], seen[0])]
        yield pd.DataFrame(rows, columns=["stem", "tox", "clean"])

    per = labelled.select("text", "toxic").mapInPandas(counted, "stem string, tox long, clean long").groupBy("stem").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    per = per.where("stem = '' OR (tox >= 3 AND tox > 9 * clean)")  # of at most sample_docs documents
    rows = {r["stem"]: (r["tox"], r["clean"]) for r in per.collect()}
    n_tox, n_clean = rows.pop("", (0, 0))
    if not n_tox or not n_clean:
        return Grammar({})
    # Copies of a document repeat its rare words: a stem counts once for each pair of neighbours.
    wanted = set(rows)

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = set()
            for t in b["text"][b["toxic"] == 1]:
                words = ["", *_TOKEN.findall(t.lower()), ""]
                for left, w, right in zip(words, words[1:], words[2:]):
                    near.update((s, left, right) for s in (w[:n] for n in range(LEAST, min(len(w), MOST) + 1)) if s in wanted)
            yield pd.DataFrame(list(near), columns=["stem", "left", "right"])

    near = labelled.select("text", "toxic").mapInPandas(beside, "stem string, left string, right string").groupBy("stem").agg(F.countDistinct("left", "right").alias("n"))
    apart = {r["stem"]: r["n"] for r in near.collect()}
    raw = {s: t for s, (t, _) in rows.items()}
    rows = {s: (min(t, apart.get(s, 0)), c) for s, (t, c) in rows.items()}
    base = n_tox / (n_tox + n_clean)
    tests = 40 * (n_tox + n_clean)  # stems are about so many
    stems: dict[str, float] = {}
    for s in sorted(rows, key=lambda s: (len(s), s)):
        t, c = rows[s]
        if any(s[:n] in stems for n in range(LEAST, len(s))):
            continue
        if math.log(tests) + t * math.log(base) + (c and math.log(math.comb(t + c, c))) < math.log(CHANCE):
            stems[s] = (t + 0.5) / (t + c + 0.6)
    for s in sorted(stems):  # as long as nearly all of a stem's documents keep it: "pathet" rather than "path"
        longest = max((x for x in rows if x.startswith(s) and len(x) > len(s) and raw[x] >= 0.98 * raw[s]), key=len, default=s)
        stems[longest] = stems.pop(s)
    grammar = Grammar(stems)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits: Counter = Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                hits.update((c, int(y)) for c in {c for c, _ in grammar.clauses(t)})
        yield pd.DataFrame([(c, n if y else 0, 0 if y else n) for (c, y), n in hits.items()], columns=["context", "tox", "clean"])

    seen = labelled.select("text", "toxic").mapInPandas(contexts, "context string, tox long, clean long").groupBy("context").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean")).collect()
    for r in seen:
        grammar.contexts[r["context"]] = (r["tox"] + 2 * prior(r["context"])) / (r["tox"] + r["clean"] + 2)
    return Grammar(stems, grammar.contexts)


def scored(text: Column, grammar: Grammar) -> Column:
    """Score of a text from 0 to 1; null and empty texts have 0."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.fillna("").map(grammar.score).astype(float)

    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)(text)


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Labels (doc_id, toxic) teach only through documents that are not held out: the sample_docs that come first by a digest of
    doc_id, of at most SAMPLE_CHARS code points each; every text is scored whole. Of repeated labels the largest counts, null ones none. Null and empty texts score 0; without a usable label all
    insults are unknown and only threats at a target score. Repeated rows are rows of their own; an empty table gives an
    empty result.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # so it can be broadcast
    labelled = in_batches(docs).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    grammar = learn(labelled, sample_docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), grammar).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
