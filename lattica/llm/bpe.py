"""BPE encoding and decoding with public vocabularies, through a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, documents, in_batches, keeps, lean, lean_groups, tokenizer_path
from .segment import TABLE_ROWS, Points, byte_level_pieces, distinct_words, slices, text_ranges, word_level_pieces

#: Words that are merged in one call, where that is exact, and code points that are encoded at once.
JOINED, POINTS = 64, 1 << 20
#: From the first combining mark on, a letter may be composed otherwise.
_COMBINED = re.compile("[\u0300-\U0010ffff]")
WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizers library gives them without added special tokens.

    Texts are cut at the names of special tokens, and split into words here, in arrays; each distinct word goes through the
    vocabulary's merges once and its ids are put back by the positions of the word.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces_of = word_level_pieces if self.lower else byte_level_pieces
        self.table = IdTable(self.flat)
        self.bytes = _byte_characters()
        pieces = {} if self.lower else self.tok.get_vocab(with_added_tokens=False)
        self.ends = {a for piece in pieces for a, b in zip(piece, piece[1:]) if b == self.bytes[32]}  # what some piece has before a blank
        self.lengths = np.zeros(max(pieces.values(), default=-1) + 1, np.int64)
        for piece, i in pieces.items():
            self.lengths[i] = len(piece)

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many they are).

        Byte-level words that begin with a blank are merged some JOINED in a call: no merge reaches over a border where no piece
        of the vocabulary has that letter before a blank. Borders are found again by the lengths of the pieces.
        """
        table, special, blank, ends = self.bytes, self.special, self.bytes[32], self.ends
        joined, shown, lone = [], [], []
        for k, w in enumerate(words if len(self.lengths) else ()):
            if w[0] == " " and w not in special:
                body = w[1:]
                x = blank + body if body.isascii() and body.isalnum() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
                if x[-1] not in ends and blank not in x[1:]:
                    joined.append(k)
                    shown.append(x)
                    continue
            lone.append(k)
        if not len(self.lengths):
            lone = list(range(len(words)))
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        tokenize, ids = self.tok.model.tokenize, []
        for i in range(0, len(shown), JOINED):
            ids += [t.id for t in tokenize("".join(shown[i : i + JOINED]))]
        ids = np.array(ids, np.uint32)
        if joined:
            upto, border = np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in shown])
            last = np.searchsorted(upto, border)
            if len(upto) <= last[-1] or not np.array_equal(upto[last], border):
                raise ValueError("pieces don't end where words end")
            size[joined] = np.diff(np.append(-1, last))
            first[joined] = last + 1 - size[joined]
        made = self.words([words[k] for k in lone])
        size[lone] = [len(x) // 4 for x in made]
        first[lone] = len(ids) + np.cumsum(size[lone]) - size[lone]
        return np.concatenate((ids, np.frombuffer(b"".join(made), np.uint32))), first, size

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        tokenize, table, special, blank, out = self.tok.model.tokenize, self.bytes, self.special, self.bytes[32], []
        for w in words:
            body = w[1:] if w[0] == " " else w
            if body.isascii() and body.isalnum():  # these bytes stand for themselves
                shown = w if body is w else blank + body
            elif w in special:
                out.append(array("I", [special[w]]).tobytes())
                continue
            else:
                shown = w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            out.append(array("I", [t.id for t in tokenize(shown)]).tobytes())
        return out

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        if text.isascii() or not _COMBINED.search(text):  # composed, and lower() goes letter by letter
            return text.lower()
        return self.tok.normalizer.normalize_str(text)

    def pieces(self, texts: list[str]) -> tuple[Points, np.ndarray, np.ndarray, np.ndarray]:
        """(points, start and end of each word, bounds): the words of text i are bounds[i]:bounds[i + 1]. The name of a special token is one word."""
        parts, first, named = [], [], []
        for t in texts:
            first.append(len(parts))
            if self.cut and any(s in t for s in self.special):
                for k, x in enumerate(self.cut.split(t)):
                    if k % 2:
                        named.append(len(parts))
                    parts.append(x if k % 2 else self._normal(x))
            else:
                parts.append(self._normal(t))
        p = Points(parts)
        start, end = self.pieces_of(p)
        if named:
            inside = np.isin(np.searchsorted(p.offsets, start, "right") - 1, named)
            start, end = np.concatenate((start[~inside], p.offsets[named])), np.concatenate((end[~inside], p.offsets[np.array(named) + 1]))
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return p, start, end, np.append(text_ranges(p, start)[first], len(start))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for a, b in slices(texts, POINTS):
            p, start, end, bounds = self.pieces(texts[a:b])
            ids, upto = self.table.look_up(p, start, end)
            for k in range(b - a):
                yield ids[upto[bounds[k]] : upto[bounds[k + 1]]]


class IdTable:
    """Ids of the distinct words of the slices so far, in one array, and where those of each word lie; it starts anew when it has many rows."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = TABLE_ROWS):
        self.encode, self.rows = encode, rows
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # first place << 32 | how many
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _learn(self, words: list[str]) -> list[int]:
        ids, first, size = self.encode(words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + len(ids), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = ((self.used + first) << 32 | size).tolist()
        self.used += len(ids)
        self.known.update(zip(words, at))
        return at

    def look_up(self, p: Points, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the spans, ends of each span in them)."""
        code, words = distinct_words(p, start, end)
        if len(self.known) > self.rows:
            self._clear()
        at = list(map(self.known.get, words))
        new = [i for i, x in enumerate(at) if x is None]
        for i, x in zip(new, self._learn([words[i] for i in new]) if new else ()):
            at[i] = x
        place = np.array(at, np.int64)
        return placed(self.flat, place >> 32, place & 0xFFFFFFFF, code)


def placed(flat: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of words by position, ends of each word in them), from the number of the word at each position, and where in `flat` the ids of each number lie."""
    per = size[code]
    upto = np.concatenate(([0], np.cumsum(per)))
    return flat[np.repeat(first[code] - upto[:-1], per) + np.arange(upto[-1])], upto


def spread_flat(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return placed(flat, np.cumsum(size) - size, size, code)


_ENCODERS: dict[str, Encoder] = {}
_SHOWN: dict[str, tuple[np.ndarray, np.ndarray]] = {}
keeps("ids", lambda: (_ENCODERS.clear(), _SHOWN.clear()))


def encoder(file: str) -> Encoder:
    """The encoder of this process, so that its word table serves all tasks that the process runs."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def encoded(text: Column, file: str) -> Column:
    """Array of ids of the text; null counts as empty."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(file)
        for s in batches:
            yield pd.Series(list(e.encode(s.fillna("").tolist())), index=s.index, dtype=object).map(lambda x: x.astype(np.int32))

    return F.pandas_udf(ids, "array<int>", F.PandasUDFType.SCALAR_ITER)(text)


def pieces_by_id(file: str) -> np.ndarray:
    """The piece of each id: as many as the vocabulary has, whatever the corpus."""
    tok = encoder(file).tok
    n = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    return np.array([tok.id_to_token(i) or "" for i in range(n)], object)


def shown_by_id(file: str) -> tuple[np.ndarray, np.ndarray]:
    """(the piece, the decimal) of each id, made once in a process: words share these strings."""
    if file not in _SHOWN:
        pieces = pieces_by_id(file)
        _SHOWN[file] = pieces, np.array([str(i) for i in range(len(pieces))], object)
    return _SHOWN[file]


def decoded(ids: Column, file: str) -> Column:
    """Text of an array of ids, for a vocabulary whose pieces are joined by blanks when decoded. Null counts as empty."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_by_id(file)
        for s in batches:
            yield s.map(lambda x: "" if x is None else " ".join(pieces[np.asarray(x, np.int64)].tolist()))

    return F.pandas_udf(texts, "string", F.PandasUDFType.SCALAR_ITER)(ids)


#: Code points of texts whose distinct words are put together before they leave a task, about.
CHUNK = 16_000_000
#: A task that has met so many distinct words starts a new table.
WORDS = 2_000_000


def _squeezed(x: np.ndarray) -> bytes:
    """32-bit integers as zlib data, their bytes in planes."""
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T).reshape(-1), 1)


def _loosed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _scrambled(word: int) -> int:
    word = word * 0xCC9E2D51 & 0xFFFFFFFF
    return ((word << 15 | word >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF


def spark_bucket(value: int, buckets: int) -> int:
    """The bucket that Spark gives a long: its Murmur3 hash with seed 42, modulo the number of buckets."""
    h = 42
    for part in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        h ^= _scrambled(part)
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * times & 0xFFFFFFFF
    return (h - (1 << 32) if h >> 31 else h) % buckets


def _chunks(docs: DataFrame, file: str, buckets: int) -> DataFrame:
    """Rows of some documents of one task: chunk, doc_ids, sizes (words of each), codes (of each word's place), part and words (the chunk's distinct words, by a digest of the word).

    A word's code is its place among the words of all parts. Chunk ids of a task fall into one bucket, so that it writes one file.
    """

    def make(batches):
        from pyspark import TaskContext

        e, pid = encoder(file), TaskContext.get().partitionId()
        number: dict[str, int] = {}
        doc_ids, sizes, codes, have, made = [], [], [], 0, 0

        def close():
            nonlocal made
            words = list(number)
            part = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words], np.int64)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            cut = np.searchsorted(part[order], np.arange(buckets + 1))
            parts = np.flatnonzero(np.diff(cut))
            lists = [zlib.compress("\n".join(words[i] for i in order[cut[k] : cut[k + 1]].tolist()).encode("utf-8", "surrogatepass"), 1) for k in parts.tolist()]
            chunk = (pid << 40) + (made << 20)
            while spark_bucket(chunk, buckets) != pid % buckets:
                chunk += 1
            made += 1
            every = np.concatenate(codes)
            codes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([_squeezed(np.array(sizes))], pa.binary()), pa.array([_squeezed(place[every])], pa.binary()), pa.array([parts.tolist()], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.binary()))],
                names=["chunk", "doc_ids", "sizes", "codes", "parts", "words"],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                p, start, end, bounds = e.pieces(texts[a:b])
                code, words = distinct_words(p, start, end)
                codes.append(np.array([number.setdefault(w, len(number)) for w in words], np.uint32)[code])
                doc_ids += ids[a:b]
                sizes += np.diff(bounds).tolist()
                have += len(p.cp)
                if have >= CHUNK:
                    yield close()
                    number, doc_ids, sizes, codes, have = {}, [], [], [], 0
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean("ids", make), "chunk long, doc_ids array<long>, sizes binary, codes binary, parts array<int>, words array<binary>")


def _encoded_words(words: DataFrame, file: str) -> DataFrame:
    """chunk, part, sizes, ids of rows (part, chunk, words): all rows of a part come to one task, which encodes each distinct word once."""

    def make(batches):
        e, known = encoder(file), {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for part, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                mine = zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")
                if len(known) > WORDS:
                    known = {}
                new = [w for w in mine if w not in known]
                known.update(zip(new, e.words(new)))
                ids = [known[w] for w in mine]
                for x, y in zip(out, (chunk, part, _squeezed(np.array([len(x) // 4 for x in ids])), _squeezed(np.frombuffer(b"".join(ids), np.uint32)))):
                    x.append(y)
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["chunk", "part", "sizes", "ids"])

    return words.mapInArrow(lean("ids", make), "chunk long, part int, sizes binary, ids binary")


def _word_ids(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has) of a chunk's words, by code."""
    order = np.argsort(np.array(right.column("part").to_pylist(), np.int64)).tolist()
    sizes, ids = right.column("sizes").to_pylist(), right.column("ids").to_pylist()
    empty = np.zeros(0, np.uint32)
    return np.concatenate([empty, *(_loosed(ids[k]) for k in order)]), np.concatenate([empty, *(_loosed(sizes[k]) for k in order)]).astype(np.int64)


def _with_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    """doc_id, ids of the documents of a chunk (left), from the ids of its words (right)."""
    flat, size = _word_ids(right)
    doc_ids, values, ends, base = [], [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    for row in left.to_pylist():
        words = np.concatenate(([0], np.cumsum(_loosed(row["sizes"]).astype(np.int64))))
        found, upto = spread_flat(flat, size, _loosed(row["codes"]).astype(np.int64))
        doc_ids += row["doc_ids"]
        values.append(found)
        ends.append(base + upto[words[1:]])
        base += len(found)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(values).astype(np.int32)))
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": lists})


def _digests(file: str):
    """doc_id, n_tokens and digests of the ids and of the decoded text, as _with_ids; the ids find their pieces word by word, before the words take their places."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, size = _word_ids(right)
        cut = np.concatenate(([0], np.cumsum(size))).tolist()
        doc_ids, own = [], []
        for row in left.to_pylist():
            codes, end = _loosed(row["codes"]), np.cumsum(_loosed(row["sizes"]).astype(np.int64))
            own += [codes[a:b] for a, b in zip(np.append(0, end[:-1]).tolist(), end.tolist())]
            doc_ids += row["doc_ids"]
        n_tokens = [int(size[x].sum()) for x in own]

        def digests(shown: np.ndarray) -> list[str]:
            each = shown[flat].tolist()
            word = np.array([" ".join(each[a:b]) for a, b in zip(cut, cut[1:])], object)
            del each
            return [hashlib.sha256(" ".join(word[x].tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in own]

        pieces, decimal = shown_by_id(file)
        out = doc_ids, n_tokens, digests(decimal), digests(pieces)  # one after the other: the words' strings of both are large
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return make


def _in_place(docs: DataFrame, file: str, make, schema: str) -> DataFrame:
    """What `make` gives of each chunk of docs (doc_id, text) and the ids of its words.

    Each task splits its texts and sends the distinct words of some documents, by a digest of the word, to the task that encodes
    them; there each distinct word of the corpus is encoded once. The ids come back by chunk and position and take the words'
    places in the documents, which stayed where they were. A word crosses the network once for CHUNK code points of text, so
    the most common one makes no large group.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, _ = bucketed(_chunks(in_batches(docs), file, buckets), "bpe-chunks", "chunk", buckets)
    words = chunks.select("chunk", F.explode(F.arrays_zip("parts", "words")).alias("w")).select(F.col("w.parts").alias("part"), "chunk", F.col("w.words").alias("words"))
    back = _encoded_words(words.repartitionById(buckets, "part"), file)
    return chunks.select("chunk", "doc_ids", "sizes", "codes").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lean_groups("ids", make), schema)


def token_ids(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, ids (array) of each row of docs (doc_id, text), by a table of distinct words. Null texts have an empty array."""
    return _in_place(docs, file or tokenizer_path(WORD_FILE), _with_ids, "doc_id long, ids array<int>")


def bpe_documents(docs: DataFrame, file: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no token and the digests of the empty string. Repeated rows are rows of their own; an empty
    table gives an empty result; other columns are not read.
    """
    file = file or tokenizer_path(WORD_FILE)
    return _in_place(docs, file, _digests(file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_documents(documents(spark, sf_dir))
