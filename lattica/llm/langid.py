"""Language identification by unigram pieces over a fixed public vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, held_out, in_batches, keeps, lean, mixed, tokenizer_path
from .segment import LETTER, Points, distinct_words, slices, text_ranges

PIECE_FILE = "piece_bpe_32k.model"
#: Of each language at most so many labelled documents are learned from, each of at most so many code points.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 100_000
ROUNDS, SMOOTH, UNKNOWN = 3, 0.05, 1e-9
#: Sums of words up to this length stay within a double's range; those of longer ones are kept as logarithms.
SCALED = 60
UNDETERMINED = "und"
_MARK = 0x2581  # begins each word
_CELLS = 1 << 19
#: Bits of a hash that are left out where pieces may be ruled out. Words that a worker knows the scores of.
_SHIFT, _KNOWN = 44, 100_000


class Vocabulary:
    """All letter pieces of the public vocabulary, lower case, found by a hash of their code points and compared with them. longest: code points of the longest."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        pieces = sorted((p for p in pieces if p.strip("▁").isalpha() or p == "▁"), key=lambda p: (self._hash(p), p))
        self.hashes, self.size = np.array([self._hash(p) for p in pieces], np.uint64), len(pieces)
        self.longest = max(map(len, pieces))
        self.begins = np.zeros(1 << (64 - _SHIFT), bool)  # by the first bits of a hash, whether what some piece begins with has them
        self.begins[np.array([self._hash(x) for x in {p[:k] for p in pieces for k in range(1, len(p) + 1)}], np.uint64) >> np.uint64(_SHIFT)] = True
        self.letters = np.zeros((len(pieces), self.longest), np.uint32)
        for i, p in enumerate(pieces):
            self.letters[i, : len(p)] = [ord(c) for c in p]

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in mixed(np.array([ord(c) for c in piece], np.uint64)).tolist():
            out = (out * 0x9E3779B97F4A7C15 + c) % (1 << 64)
        return out

    def cells(self, words: np.ndarray) -> np.ndarray:
        """Of words, one per row of code points, the piece of each length (last axis) that begins at each position; size: none."""
        code = mixed(words.astype(np.uint64)).ravel()
        n, m = words.shape
        out = np.full((n, m, min(self.longest, m)), self.size, np.int32)
        flat, letters, most = out.reshape(-1), words.ravel(), out.shape[2]
        cell, left, h = np.arange(n * m), np.tile(np.arange(m, 0, -1), n), np.zeros(n * m, np.uint64)
        for k in range(most):
            if k:  # only where a piece may go on
                go = left > k
                cell, left, h = cell[go], left[go], h[go]
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[cell + k]
            go = self.begins[h >> np.uint64(_SHIFT)]
            cell, left, h = cell[go], left[go], h[go]
            if not len(cell):
                break
            at = np.searchsorted(self.hashes, h)
            at[at == self.size] = 0
            same = self.hashes[at] == h
            own, at = cell[same], at[same]
            same = np.ones(len(own), bool)
            for i in range(k + 1):
                same &= letters[own + i] == self.letters[at, i]
            if k + 1 < self.longest:  # no longer piece with that hash
                same &= self.letters[at, k + 1] == 0
            flat[own[same] * most + k] = at[same]
        return out


def _grouped(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length at a time, with their places, as rows of code points after the mark."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        step = max(1, _CELLS // (n + 1))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            cp = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            yield part, np.concatenate((np.full((len(part), 1), _MARK, np.uint32), cp), axis=1)


class Model:
    """langs in order, and of each piece its probability in each; the last row is for what is no piece: one code point alone."""

    def __init__(self, file: str, langs: list[str], chances: np.ndarray):
        self.file, self.langs, self.chances = file, langs, chances
        self._vocabulary: Vocabulary | None = None

    def __getstate__(self):
        return self.__dict__ | {"_vocabulary": None}

    def vocabulary(self) -> Vocabulary:
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.file)
        return self._vocabulary

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: the forward sum over all its segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        v = self.vocabulary()
        for at, cp in _grouped(words):
            out[at] = forward(v.cells(cp), self.chances)
        return out


def forward(cells: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log of the sum over segmentations, for each word and language; kept in scale as it goes."""
    n, m, most = cells.shape
    k = chances.shape[1]
    none = len(chances) - 1
    known = chances.copy()
    known[none] = 0
    scale = np.zeros(n)
    back = [np.ones((n, k))]  # sums up to the last `most` positions, the newest last
    used = (cells != none).any(axis=0)  # whether any word has a piece there
    used[:, 0] = True
    for j in range(m):
        total = np.zeros((n, k))
        for size in range(1, min(most, j + 1) + 1):
            if not used[j + 1 - size, size - 1]:
                continue
            piece = cells[:, j + 1 - size, size - 1]
            share = chances[piece] if size == 1 else known[piece]
            total += back[-size] * share
        back.append(total)
        back = back[-most:]
        if j % 4 == 3 or j == m - 1:
            top = np.maximum(total.max(axis=1), 1e-290)
            scale += np.log(top)
            back = [b / top[:, None] for b in back]
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(back[-1], 1e-300)) + scale[:, None]


def fit(samples: list[tuple[str, str]], file: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from (lang, text) pairs, by expectation-maximisation over all segmentations."""
    v = Vocabulary(file)
    counts: dict[str, Counter] = {}
    for lang, text in samples:
        p = Points([text.lower()])
        start, end = letters(p)
        counts.setdefault(lang, Counter()).update(p.text[s:e] for s, e in zip(start.tolist(), end.tolist()))
    langs = sorted(counts)
    chances = np.full((v.size + 1, len(langs)), UNKNOWN)
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        p = np.full(v.size + 1, 1.0 / max(v.size, 1))
        p[v.size] = UNKNOWN
        for _ in range(rounds):
            seen = np.zeros(v.size + 1)
            for at, cp in _grouped(words):
                seen += (_expected if cp.shape[1] <= SCALED else _expected_logs)(v.cells(cp), p, weight[at])
            p = (seen + SMOOTH) / (seen[: v.size].sum() + SMOOTH * v.size)
            p[v.size] = UNKNOWN
        chances[:, k] = p
    return Model(file, langs, chances)


def _expected(cells: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted."""
    n, m, most = cells.shape
    none = len(p) - 1
    q = p[cells]
    q[:, :, 1:][cells[:, :, 1:] == none] = 0
    q *= 30.0 ** np.arange(1, most + 1)  # the same for every segmentation of a word; keeps its sums in range
    up, down = np.zeros((m + 1, n)), np.zeros((m + 1, n))
    up[0] = down[m] = 1
    for j in range(1, m + 1):
        for s in range(1, min(most, j) + 1):
            up[j] += up[j - s] * q[:, j - s, s - 1]
    for j in range(m - 1, -1, -1):
        for s in range(1, min(most, m - j) + 1):
            down[j] += down[j + s] * q[:, j, s - 1]
    out = np.zeros(len(p))
    share = weight / np.maximum(up[m], 1e-290)
    for s in range(1, most + 1):
        uses = up[: m + 1 - s].T * q[:, : m + 1 - s, s - 1] * down[s:].T * share[:, None]
        out += np.bincount(cells[:, : m + 1 - s, s - 1].ravel(), uses.ravel(), len(p))
    out[none] = 0
    return out


def _expected_logs(cells: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What _expected gives, with sums as logarithms: for words of any length."""
    n, m, most = cells.shape
    none = len(p) - 1
    with np.errstate(divide="ignore"):
        q = np.log(p)[cells]
    q[:, :, 1:][cells[:, :, 1:] == none] = -np.inf
    up, down = np.full((m + 1, n), -np.inf), np.full((m + 1, n), -np.inf)
    up[0] = down[m] = 0
    for j in range(1, m + 1):
        k = min(most, j)
        up[j] = np.logaddexp.reduce([up[j - s] + q[:, j - s, s - 1] for s in range(1, k + 1)])
    for j in range(m - 1, -1, -1):
        down[j] = np.logaddexp.reduce([down[j + s] + q[:, j, s - 1] for s in range(1, min(most, m - j) + 1)])
    out = np.zeros(len(p))
    for s in range(1, most + 1):
        uses = np.exp(up[: m + 1 - s].T + q[:, : m + 1 - s, s - 1] + down[s:].T - up[m][:, None]) * weight[:, None]
        out += np.bincount(cells[:, : m + 1 - s, s - 1].ravel(), uses.ravel(), len(p))
    out[none] = 0
    return out


def letters(p: Points) -> tuple[np.ndarray, np.ndarray]:
    start, end, kind = p.runs()
    keep = kind == LETTER
    return start[keep], end[keep]


class ScoreTable:
    """Scores of the distinct words of the slices so far, in one array, each worked out once; it starts anew when it has many rows."""

    def __init__(self, model: Model, rows: int = _KNOWN):
        self.model, self.most = model, rows
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((1 << 14, len(self.model.langs)))

    def look_up(self, words: list[str]) -> np.ndarray:
        """The scores of distinct words, in order."""
        if len(self.known) > self.most:
            self._clear()
        at = list(map(self.known.get, words))
        new = [i for i, x in enumerate(at) if x is None]
        if new:
            have, names = len(self.known), [words[i] for i in new]
            if have + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores[:have], np.empty((have + len(new), self.scores.shape[1]))))
            self.scores[have : have + len(new)] = self.model.word_scores(names)
            self.known.update(zip(names, range(have, have + len(new))))
            for i, x in zip(new, range(have, have + len(new))):
                at[i] = x
        return self.scores[np.array(at, np.int64)]


_TABLES: dict[str, tuple[Model, ScoreTable]] = {}
keeps("languages", _TABLES.clear)


def _predict(model: Model, key: str, texts: list[str]) -> list[tuple[str, float]]:
    if not model.langs:
        return [(UNDETERMINED, 0.0)] * len(texts)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = model, ScoreTable(model)
    model, table = _TABLES[key]
    out: list[tuple[str, float]] = []
    for a, b in slices(texts):
        p = Points([t.lower() for t in texts[a:b]])
        start, end = letters(p)
        code, words = distinct_words(p, start, end)
        scores = table.look_up(words)
        bounds = text_ranges(p, start)
        for i in range(b - a):
            if bounds[i] == bounds[i + 1]:
                out.append((UNDETERMINED, 0.0))
                continue
            uses = np.bincount(code[bounds[i] : bounds[i + 1]], minlength=0)
            total = uses @ scores[: len(uses)]
            total = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((model.langs[best], float(total[best] / total.sum())))
    return out


def predicted(text: Column, model: Model) -> Column:
    """Struct lang_pred, score of a text; `und` and 0 where the text is null or has no letter, or nothing was learned."""
    import uuid

    key = uuid.uuid4().hex

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(_predict(model, key, s.fillna("").tolist()), columns=["lang_pred", "score"])

    return F.pandas_udf(lean("languages", predict), "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)(text)


def learned(docs: DataFrame, file: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the rows of docs (doc_id, text, lang) that may be learned from: of each lang, the sample_docs that come first by a digest of doc_id."""
    rows = in_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("_draw"))
    first = Window.partitionBy("lang").orderBy("_draw")
    drawn = rows.select("lang", "_draw").withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample_docs).select("lang", "_draw")
    pairs = sorted({(r[0], r[1]) for r in rows.join(F.broadcast(drawn), ["lang", "_draw"]).select("lang", "text").collect()})  # at most sample_docs a language
    return fit(pairs, file or tokenizer_path(PIECE_FILE))


def languages(docs: DataFrame, file: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The model knows text and lang of rows that are not held out, of each lang at most sample_docs of at most SAMPLE_CHARS code
    points; a prediction knows the text alone, all of it, by all pieces of the vocabulary. Null texts and
    texts without a letter are `und` with score 0; so is every row if no row can be learned from. Equal scores go to the first
    language by code point. Repeated rows are rows of their own; an empty table gives an empty result.
    """
    model = learned(docs, file, sample_docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))
