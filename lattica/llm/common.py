"""What the corpus operators share: the shared folder, staging, and words told apart by their bytes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every operator here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own on this machine, and only if Spark runs here alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lattica.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
        spark.conf.set("spark.lattica.shared.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = stage_path(spark, name)
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _file_system(spark: SparkSession, at: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is there goes when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, at)
    fs.deleteOnExit(path)
    return at


def discard(spark: SparkSession, at: str) -> None:
    """Deletes what was staged at a path and is no longer read."""
    fs, path = _file_system(spark, at)
    fs.delete(path, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> tuple[DataFrame, str]:
    """df written in buckets of a column, each sorted by it, and read so that joins on the column need no exchange; where it lies."""
    spark = df.sparkSession
    at, table = stage_path(spark, name), f"lattica_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", at).option("compression", "zstd").saveAsTable(table)
    return spark.table(table), at


#: Up to so many ids, counted, are broadcast to the rows that go by them; above it both are shuffled, with the same result.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (staged; doc_id, each once, none null): up to `most` ids, texts stay where they are."""
    few = ids.count() <= (BROADCAST_IDS if most is None else most)
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch that a Python worker gets at once: texts are large, and two workers share what an executor has beside its heap.
BATCH_ROWS = 1000


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, its session set to send Python workers at most BATCH_ROWS rows at once."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


#: By operator, what empties the tables that a Python worker keeps from task to task.
_EMPTY: dict[str, Callable[[], None]] = {}
_TRIM = getattr(ctypes.pythonapi, "malloc_trim", None)  # the GNU C library has it


def keeps(operator: str, empty: Callable[[], None]) -> None:
    """Says how to empty the tables that this process keeps for an operator."""
    _EMPTY[operator] = empty


def begin(operator: str) -> None:
    """Empties the tables of all other operators."""
    for name, empty in _EMPTY.items():
        if name != operator:
            empty()


def give_back() -> None:
    """Memory that this process has freed goes back to the system, which its allocators would keep."""
    if _TRIM:
        _TRIM(0)
    pa.default_memory_pool().release_unused()


def lean(operator: str, work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, for the Python workers of an executor, which live on beside its heap when a task or a stage is over: they keep the tables of one operator, and nothing that is free."""

    def run(batches: Iterator) -> Iterator:
        begin(operator)
        for out in work(batches):
            yield out
            out = None
            give_back()
        give_back()

    return run


def lean_groups(operator: str, work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What lean is for iterators, for a function of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        begin(operator)
        try:
            return work(left, right)
        finally:
            give_back()

    return run


def held_out(doc_id) -> "F.Column":
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary lies; folder None: where the installed package has it."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size <= 1 << 22:
            _POWERS[name] = out
        return out
    return have


_MIXED = mixed(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 20


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(word.view(np.int8)))  + 1
    starts = edge[word[edge]]
    ends = edge[~word[edge]]
    if word[0]:
        starts = np.concatenate(([0], starts))
    if word[-1]:
        ends = np.concatenate((ends, [len(raw)]))
    return starts, ends


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each span of a buffer (bytes or code points, none empty), the same for the same content wherever it lies. They only group: contents with one hash are easily made."""
    if not len(start):
        return np.zeros(0, np.uint64)
    codes = _MIXED[buffer] if buffer.dtype == np.uint8 else mixed(buffer.astype(np.uint64) + np.uint64(1))
    codes *= _powers(_BASE, "base", len(buffer))[: len(buffer)]
    sums = np.add.accumulate(codes, out=codes)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    h = (sums[end - 1] - before) * _powers(_INVERSE, "inverse", len(buffer))[start]
    return mixed(h ^ (end - start).astype(np.uint64))


def span_codes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's content, first span of each content): equal numbers mean equal content, item by item.

    Spans of a buffer (bytes or code points, none empty) are grouped by a hash (hashes: these, if known); then each is compared
    with the first of its group, whole. Hashes that collide only cost time: those spans are told apart by their bytes.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = end - start
    code, distinct = pd.factorize(span_hashes(buffer, start, end) if hashes is None else hashes)
    first = _firsts(code, len(distinct))
    if not _same(buffer, start, length, first[code]):
        content = [buffer[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())]
        code, distinct = pd.factorize(np.array(content, object))
        first = _firsts(code, len(distinct))
    return code, first


def _firsts(code: np.ndarray, n: int) -> np.ndarray:
    first = np.empty(n, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first


def _same(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span equals the span `other`, item by item."""
    again = np.flatnonzero(other != np.arange(len(start)))
    if not (length[again] == length[other[again]]).all():
        return False
    n = length[again]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((buffer[np.repeat(start[again], n) + inside] == buffer[np.repeat(start[other[again]], n) + inside]).all())


#: Digests of words are keyed; a process remembers so many of words up to so many bytes.
_KEY, _KNOWN, _SHORT = b"lattica words", 200_000, 64
_DIGESTS: dict[bytes, bytes] = {}
_KEYED = hashlib.blake2b(digest_size=16, key=_KEY)
keeps("words", _DIGESTS.clear)


def word_digests(words: list[bytes]) -> np.ndarray:
    """128 bits of a keyed digest of each word, as two 64-bit lanes."""
    if len(_DIGESTS) > _KNOWN:
        _DIGESTS.clear()
    out = list(map(_DIGESTS.get, words))
    for i in [i for i, d in enumerate(out) if d is None]:
        w, h = words[i], _KEYED.copy()
        h.update(w)
        out[i] = d = h.digest()
        if len(w) <= _SHORT:
            _DIGESTS[w] = d
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k values from each place on; shorter by k - 1."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(values * _powers(_BASE, "base", n)[:n])))
    return mixed((total[k:] - total[:-k]) * _powers(_INVERSE, "inverse", n)[: n - k + 1] + np.uint64(k))


class Spans:
    """The words of texts (UTF-8 bytes) together: those of text i are bounds[i]:bounds[i + 1]."""

    def __init__(self, raws: list[bytes], lower: bool = False):
        self.buffer = b" ".join(raws)
        if lower:
            self.buffer = self.buffer.translate(_LOWER)
        self.raw = np.frombuffer(self.buffer, np.uint8)
        self.start, self.end = word_spans(self.raw)
        sizes = np.array([len(r) for r in raws], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        self.bounds = np.searchsorted(self.start, np.append(begin, len(self.buffer) + 1), "left")
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        """64 bits of each word, which only group."""
        if self._hashes is None:
            self._hashes = span_hashes(self.raw, self.start, self.end)
        return self._hashes

    def marks(self, k: int) -> np.ndarray:
        """64 bits of the k words from each place on, over the ends of texts too, which only group; shorter by k - 1."""
        return rolled(self.hashes, k)

    def numbered(self, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(number of each of the words at some places, the word of each number): the same for the same bytes only."""
        start, end = self.start[at], self.end[at]
        code, first = span_codes(self.raw, start, end, self.hashes[at])
        return code, [self.buffer[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]


class Words(Spans):
    """Spans with code: a number of each word, the same for the same bytes only; distinct: the word of each number."""

    def __init__(self, raws: list[bytes], lower: bool = False):
        super().__init__(raws, lower)
        self.code, self.first = span_codes(self.raw, self.start, self.end, self.hashes)
        self._distinct = self._lanes = None

    @property
    def distinct(self) -> list[bytes]:
        if self._distinct is None:
            self._distinct = [self.buffer[s:e] for s, e in zip(self.start[self.first].tolist(), self.end[self.first].tolist())]
        return self._distinct

    def lane(self, k: int) -> np.ndarray:
        """64 bits of each word's digest."""
        if self._lanes is None:
            self._lanes = word_digests(self.distinct)
        return self._lanes[self.code, k]

    def grams(self, k: int, lane: int = 0) -> np.ndarray:
        """64-bit hash of the k words from each place on, over the ends of texts too; shorter by k - 1. Lanes are independent."""
        return rolled(self.lane(lane), k)

    def gram_codes(self, k: int) -> np.ndarray:
        """A number of the k words from each place on, the same for the same words only."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.int64)
        out, many = self.code[: n - k + 1], np.uint64(len(self.first))
        for i in range(1, k):  # both factors are below 2 ** 32, so a pair is one 64-bit word
            out, _ = pd.factorize(out.astype(np.uint64) * many + self.code[i : n - k + 1 + i].astype(np.uint64))
        return out


def byte_slices(raws: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `size` bytes together."""
    start = have = 0
    for i, r in enumerate(raws):
        if have and have + len(r) > size:
            yield start, i
            start, have = i, 0
        have += len(r)
    if start < len(raws):
        yield start, len(raws)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]
