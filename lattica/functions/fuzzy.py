"""Text functions that the JVM doesn't have: stems, similarity ratios, hash embeddings. Plain Python, and Arrow-batched columns of them."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = where.get(c, 0)
        u = row & hit
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common / total."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a stretch of the longer, as long as it or cut at an end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for i in range(-n + 1, len(b)):
        part = b[max(0, i) : i + n]
        if part and (2 * min(n, len(part)) * 100 / (n + len(part))) > best:
            best = max(best, ratio(a, part))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """For single tokens: the ratio, or 0.9 (0.6 beyond eight times the length) of the partial one where lengths differ by half or more."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    return max(ratio(a, b), (0.9 if spread < 8 else 0.6) * partial_ratio(a, b))


_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWEL and not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    form = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(w, i) else "v" for i in range(len(w))))
    return form.count("vc")


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def stem(w: str) -> str:
    """Porter's algorithm of 1980."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s:
        base = w[: -len(s)]
        if _measure(base) > 1 and (s != "ion" or base[-1:] in ("s", "t")):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or m == 1 and not _cvc(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def hash_embedding(words: str, dim: int = 256) -> list[float]:
    """Signed hashed bag of trigrams, of length 1."""
    out = [0.0] * dim
    low = re.sub(r"[^a-z0-9]+", " ", words.lower()).strip()
    grams = [low[i : i + 3] for i in range(len(low) - 2)] or ([low] if low else [])
    for gram in grams:
        digest = hashlib.blake2b(bytes(gram, "ascii"), digest_size=8).digest()
        code = int.from_bytes(digest, "big")
        out[code % dim] += (code >> 8 & 1) * 2.0 - 1.0
    length = math.hypot(*out)
    return [v / length for v in out] if length else out


def _batched(f, kind: str):
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    return F.pandas_udf(apply, kind, F.PandasUDFType.SCALAR_ITER)


def _paired(f):
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(apply, "double", F.PandasUDFType.SCALAR_ITER)


def stemmed(words: Column) -> Column:
    """Porter stem of a column of words."""
    return _batched(stem, "string")(words)


def embedded(text: Column, dim: int = 256) -> Column:
    return _batched(lambda t: hash_embedding(t, dim), "array<float>")(text)


def partial_ratios(a: Column, b: Column) -> Column:
    return _paired(partial_ratio)(a, b)


def weighted_ratios(a: Column, b: Column) -> Column:
    return _paired(weighted_ratio)(a, b)
