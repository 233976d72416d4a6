"""Secrets in text: rules are regular expressions, candidates come from a trigram inverted index, matches from the rules themselves."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # an older Python
    import sre_constants as sre
    import sre_parse as parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches
from .segment import slices


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
#: kind -> (rule, group whose length counts, least length). The first three are the base; the order is the order of ties.
RULES = {
    "assign": (rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "github": (r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "stripe": (r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "url": (r"://[^\s:/@]+:[^\s:/@]+@", 0, 8),
}
BASE = ("assign", "access", "hex")
#: A literal set larger than this is used up to the part before it.
MOST_LITERALS = 64


def trigram_query(rule: str) -> list[frozenset[str]] | None:
    """What any match must hold, as a disjunction of conjunctions of lower-case trigrams; None: nothing is mandatory."""
    return _minimal(_query(parser.parse(rule)))


def _minimal(q: set[frozenset[str]] | None) -> list[frozenset[str]] | None:
    if q is None or frozenset() in q:
        return None
    return sorted((a for a in q if not any(b < a for b in q)), key=sorted)


def _both(a: set[frozenset[str]] | None, b: set[frozenset[str]] | None) -> set[frozenset[str]] | None:
    if a is None or b is None:
        return b if a is None else a
    return {x | y for x in a for y in b} if len(a) * len(b) <= 512 else a


def _of_strings(strings: set[str]) -> set[frozenset[str]] | None:
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in out else out


def _exact(items) -> set[str] | None:
    """All strings that the items can match, in lower case, if few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            more = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            more = _exact(arg[3])
        elif op is sre.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            more = _exact(arg[2])
            more = more if more is None or arg[0] else more | {""}
        elif op is sre.AT:
            more = {""}
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items) -> set[frozenset[str]] | None:
    """Mandatory trigrams of a sequence: those of its literal stretches, and of its parts that are no literals."""
    query, run = None, {""}
    for item in items:
        op, arg = item
        literal = _exact([item])
        if literal is not None and len(run) * len(literal) <= MOST_LITERALS:
            run = {a + b for a in run for b in literal}
            continue
        inner = None
        if literal is not None:
            query, run = _both(query, _of_strings(run)), literal
            continue
        if op is sre.SUBPATTERN:
            inner = _query(arg[3])
        elif op is sre.BRANCH:
            parts = [_query(x) for x in arg[1]]
            inner = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
            first = _exact(arg[2])
            if first is not None and len(run) * len(first) <= MOST_LITERALS:
                run = {a + b for a in run for b in first}
            else:
                inner = _query(arg[2])
        query, run = _both(_both(query, _of_strings(run)), inner), {""}
    return _both(query, _of_strings(run))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Index:
    """Postings of the trigrams that rules ask for, over a run of texts: for each trigram, the texts that hold it, ascending."""

    def __init__(self, trigrams: list[str]):
        self.trigrams = trigrams
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(trigrams):
            a, b, c = t.encode("latin-1")
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = _FOLD[np.frombuffer(b"".join(raws), np.uint8)].astype(np.uint32)
        ends = np.cumsum([len(r) for r in raws])
        if len(raw) < 3:
            return {}
        found = self.number[raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]]
        at = np.flatnonzero(found)
        which = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[which] if len(at) else np.zeros(0, bool)
        key = np.unique(found[at[inside]].astype(np.int64) * (len(texts) + 1) + which[inside])
        number, text = key // (len(texts) + 1), key % (len(texts) + 1)
        cut = np.searchsorted(number, np.arange(1, len(self.trigrams) + 2))
        return {t: text[cut[i] : cut[i + 1]] for i, t in enumerate(self.trigrams)}


def candidates(query: list[frozenset[str]] | None, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Texts that a query leaves: the union, over its conjunctions, of the intersection of postings, the shortest first."""
    if query is None:
        return np.arange(n)
    none = np.zeros(0, np.int64)
    out = none
    for part in query:
        lists = sorted((postings.get(t, none) for t in part), key=len)
        hit = lists[0]
        for x in lists[1:]:
            if not len(hit):
                break
            hit = np.intersect1d(hit, x, assume_unique=True)
        out = np.union1d(out, hit)
    return out


class Scanner:
    def __init__(self, rules: dict[str, tuple[str, int, int]]):
        self.rules = [(k, re.compile(r), group, least) for k, (r, group, least) in rules.items()]
        self.queries = {k: trigram_query(r) for k, (r, _, _) in rules.items()}
        if any(not t.isascii() for q in self.queries.values() if q for part in q for t in part):
            self.queries = {k: q if q is None or all(t.isascii() for p in q for t in p) else None for k, q in self.queries.items()}
        self.index = Index(sorted({t for q in self.queries.values() if q for part in q for t in part}))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text, by start, then by the rules' order."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a, b in slices(texts):
            part = texts[a:b]
            postings = self.index.postings(part)
            for kind, rule, group, least in self.rules:
                for i in candidates(self.queries[kind], postings, len(part)).tolist():
                    out[a + i] += [(m.start(), m.end(), kind) for m in rule.finditer(part[i]) if m.end(group) - m.start(group) >= least]
        for x in out:
            x.sort(key=lambda s: s[0])  # stable: kinds stay in the rules' order
        return out


def secret_spans(text: Column, rules: dict[str, tuple[str, int, int]] = RULES) -> Column:
    """Array of structs (start, end, kind) of a text, in code points, end exclusive; null counts as empty."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scanner(rules)
        for batch in batches:
            yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in s.spans(batch.fillna("").tolist())], dtype=object)

    return F.pandas_udf(find, "array<struct<start: int, end: int, kind: string>>", F.PandasUDFType.SCALAR_ITER)(text)


def secret_summary(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Matches of a kind are leftmost and don't overlap; different kinds may. Texts without a match, null and empty ones have
    zeros, the digest of the empty string and an empty spans. Repeated rows are rows of their own; an empty table gives an
    empty result; other columns are not read.
    """

    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner(rules)
        written = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in x)
        for batch in batches:
            rows = []
            for x in s.spans(batch.fillna("").tolist()):
                base = [y for y in x if y[2] in BASE]
                rows.append((*(sum(y[2] == k for y in base) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(x)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    udf = F.pandas_udf(summed, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", F.PandasUDFType.SCALAR_ITER)
    return in_batches(docs).select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_summary(documents(spark, sf_dir))
