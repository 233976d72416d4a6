"""Repeated passages by a log-structured index: sorted immutable runs of window fingerprints, merge-joined with each batch, verified, compacted.

A window is `window` consecutive words. A run doesn't hold every window: of the grams of GRAM words inside a window the one
with the least hash speaks for it (the first of equal ones), so equal windows always have an equal fingerprint, and about one
place in seven is one. Fingerprints that only one place has end there. For the others the windows themselves are taken from
the texts, brought together with their words, and compared word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, Words, bucketed, byte_slices, discard, documents, in_batches, stage_path, staged, utf8

WINDOW, GRAM = 20, 8
#: Bits of a fingerprint.
BITS = 48
#: Runs that an index holds before they are merged into one, and batches of doc_id that the query feeds to it.
RUNS, BATCHES = 2, 3
#: Windows are sent in blocks, by fingerprint: of about so many fingerprints each, LEAST_BLOCKS at least.
BLOCK_PRINTS, LEAST_BLOCKS = 4096, 64
#: Windows that a task compares before it sends them.
FLUSH = 250_000


def fingerprint_keys(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of the window from each place on, its fingerprint (the high BITS) and the low bits of the place that has it; over the ends of texts too."""
    span = window - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    low = np.uint64(64 - BITS)
    keys = grams >> low << low | np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << (64 - BITS)) - 1)
    have = 1
    while have < span:  # the least of `have` places, then of up to twice as many
        step = min(have, span - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return keys


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(print, doc_id, times): the distinct fingerprints of each document and how many places have each."""

    def make(batches):
        for batch in batches:
            ids, raws = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for a, b in byte_slices(raws):
                w = Spans(raws[a:b])
                keys = fingerprint_keys(w.marks(gram), window, gram)
                n = np.maximum(0, np.diff(w.bounds) - window + 1)  # windows of each text
                at = np.repeat(w.bounds[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                owner, keys = np.repeat(np.arange(b - a), n), keys[at] if len(at) else keys[:0]
                place = np.ones(len(at), bool)  # windows in a row share a place
                place[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                prints, owner = _short(keys[place]), owner[place]
                order = np.lexsort((prints, owner))
                prints, owner = prints[order], owner[order]
                head = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1]))[: len(prints)])
                times = np.diff(np.append(head, len(prints)))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((prints[head], np.int64), (ids[a + owner[head]], np.int64), (times, np.int32))], names=["print", "doc_id", "times"])

    return docs.select("doc_id", "text").mapInArrow(make, "print long, doc_id long, times int")


#: A fingerprint that more than one in HEAVY of sampled documents has lies in no bucket of its run, which one task would read; only its place depends on the sample.
HEAVY, SAMPLE = 1000, 64


class Run(NamedTuple):
    """cold: (print, doc_id, times) in buckets by print, sorted; hot: the rows of heavy prints; heavy: those prints; where they lie."""

    cold: DataFrame
    hot: DataFrame
    heavy: DataFrame
    paths: list[str]


class Index:
    """Runs of fingerprints, oldest first. Runs never change: a batch adds one, and where there are RUNS already they are merged into a new one first."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []

    def _write(self, rows: DataFrame) -> Run:
        """Sorts staged rows (print, doc_id, times) into a run."""
        some = staged(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), "substring-sample")
        least = max(2, some.select("doc_id").distinct().count() // HEAVY)
        at = [stage_path(self.spark, "substring-heavy"), stage_path(self.spark, "substring-hot")]
        some.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("print").write.parquet(at[0])  # at most HEAVY a print of a document
        heavy = self.spark.read.schema("print long").parquet(at[0])
        rows.join(F.broadcast(heavy), "print").select("print", "doc_id", "times").write.parquet(at[1])
        hot = self.spark.read.schema("print long, doc_id long, times int").parquet(at[1])
        cold = rows.join(F.broadcast(heavy), "print", "left_anti").select("print", "doc_id", "times").repartition(self.buckets, "print")
        cold, where = bucketed(cold, "substring-run", "print", self.buckets)
        return Run(cold, hot, heavy, [*at, where])

    def heavy(self) -> DataFrame | None:
        """Prints that are heavy in some run."""
        out = None
        for r in self.runs:
            out = r.heavy if out is None else out.unionByName(r.heavy)
        return out.distinct() if out is not None else None

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (print, doc_id, times) as a run; (print, doc_id) of all places of a print that the batch and some other place have.

        The batch's prints are merge-joined with those of each earlier run: both lie in the same buckets, in order.
        """
        if len(self.runs) >= RUNS:
            self.compact()
        new, before, old_heavy = self._write(rows), list(self.runs), self.heavy()
        fresh = new.cold.groupBy("print").agg((F.sum("times") > 1).alias("again"))
        for k, r in enumerate(before):
            fresh = fresh.join(r.cold.select("print").distinct().withColumn(f"_{k}", F.lit(True)), "print", "left").withColumn("again", F.col("again") | F.coalesce(f"_{k}", F.lit(False))).drop(f"_{k}")
        touched = new.heavy
        if old_heavy is not None:
            fresh = fresh.join(F.broadcast(old_heavy.withColumn("_h", F.lit(True))), "print", "left").withColumn("again", F.col("again") | F.coalesce("_h", F.lit(False))).drop("_h")
            touched = staged(new.cold.join(F.broadcast(old_heavy), "print", "left_semi").select("print").unionByName(new.heavy).distinct(), "substring-touched")
        wanted = fresh.where("again").select("print")
        hits = [new.cold.join(wanted, "print", "left_semi"), new.hot]
        for r in before:
            told = r.cold.join(F.broadcast(new.heavy.withColumn("_h", F.lit(True))), "print", "left").join(wanted.withColumn("_w", F.lit(True)), "print", "left")
            hits += [told.where("_h OR _w"), r.hot.join(F.broadcast(touched), "print", "left_semi")]
        out = hits[0].select("print", "doc_id")
        for h in hits[1:]:
            out = out.unionByName(h.select("print", "doc_id"))
        out = staged(out, "substring-hits", "zstd")
        self.runs.append(new)
        return out

    def compact(self) -> None:
        """Merges all runs into one; the old ones go."""
        every = self.runs[0].cold.unionByName(self.runs[0].hot)
        for r in self.runs[1:]:
            every = every.unionByName(r.cold).unionByName(r.hot)
        old, self.runs = self.runs, [self._write(every)]
        for r in old:
            for at in r.paths:
                discard(self.spark, at)


def _later(h: np.ndarray, d: np.ndarray, s: np.ndarray, at: np.ndarray, code: np.ndarray, window: int) -> np.ndarray:
    """Of windows (hash, document, start, and where their words' numbers begin in `code`), which have an equal one that starts earlier. Hashes only group them: the words are compared."""
    order = np.lexsort((s, d, h))
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    head = np.flatnonzero(~same)
    first = order[np.repeat(head, np.diff(np.append(head, len(h))))]
    again = order[same]
    left, right = at[again], at[first[same]]
    if not all((code[left + k] == code[right + k]).all() for k in range(window)):
        number: dict[bytes, int] = {}
        exact = np.array([number.setdefault(code[x : x + window].tobytes(), len(number)) for x in at.tolist()], np.uint64)
        return _later(exact, d, s, at, code, window)
    out = np.zeros(len(h), bool)
    out[order] = same & ((d[order] != d[first]) | (s[order] != s[first]))
    return out


def _runs(d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of stretches of windows in (document, start) order that follow each other."""
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(d)))


_PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def _windows(docs: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """Blocks of windows, and repeats, of docs (doc_id, text, prints); prints of heavy fingerprints are given as -1 - print.

    Each task compares its suspect windows and keeps the first of equal ones; later ones are repeats whatever other tasks
    hold, and go out as such (block -1). The others go by the high bits of their fingerprint, so that equal windows meet and
    windows in a row stay in a row: the words of each row, and its (document, start, length). Those of a heavy fingerprint go
    by a hash of all their words instead, as many windows may share the fingerprint alone.
    """

    def make(batches):
        kept: list[tuple] = []
        slices: list[tuple] = []
        number: dict[bytes, int] = {}
        have = [0, 0]  # windows, words

        def flush():
            h, d, s, f, at = (np.concatenate(x) for x in zip(*kept))
            code = np.concatenate([c for c, *_ in slices])
            later = _later(h, d, s, at, code, window)
            yield from _marks(d[later], s[later])
            first = ~later
            block = np.where(f >= 0, f * blocks >> BITS, (h >> np.uint64(64 - BITS)).astype(np.int64) * blocks >> BITS)
            yield from _blocks(block[first], d[first], s[first], at[first], slices, window)

        for batch in batches:
            prints = batch.column(2)
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(prints), 0), 0))
            ids, raws, prints = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1)), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)))  # prints of the texts before each
            for a, b in byte_slices(raws):
                w = Spans(raws[a:b])
                n = np.maximum(0, np.diff(w.bounds) - window + 1)  # windows of each text
                at = np.repeat(w.bounds[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                if not len(at):
                    continue
                owner, own = np.repeat(np.arange(b - a), n), _short(fingerprint_keys(w.marks(gram), window, gram)[at])
                head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])))
                given, of = prints[upto[a] : upto[b]], np.repeat(np.arange(b - a), np.diff(upto[a : b + 1]))
                heavy = given < 0
                keyed = lambda text, f: text.astype(np.uint64) << np.uint64(BITS) | f.astype(np.uint64)
                mine, given = keyed(owner[head], own[head]), keyed(of, np.where(heavy, -1 - given, given))
                asked, alike = np.isin(mine, given), np.diff(np.append(head, len(own)))
                pick = np.repeat(asked, alike)
                f, at, owner = np.repeat(np.where(np.isin(mine, given[heavy]), -1, own[head]), alike)[pick], at[pick], owner[pick]
                if not len(at):
                    continue
                used = np.zeros(len(w.start) + 1, np.int32)  # words of some window that is asked for
                used[at] += 1
                used[at + window] -= 1
                places = np.flatnonzero(np.cumsum(used[:-1]))
                code, distinct = w.numbered(places)
                numbers = np.full(len(w.start), -1, np.int32)
                numbers[places] = np.array([number.setdefault(x, len(number)) for x in distinct], np.int32)[code]
                slices.append((numbers, w.buffer.translate(_PLAIN), w.start, w.end))
                kept.append((w.marks(window)[at], ids[a + owner].astype(np.int64), at - w.bounds[owner], f, have[1] + at))
                have[0] += len(at)
                have[1] += len(numbers)
                if have[0] > FLUSH:
                    yield from flush()
                    kept, slices, number, have = [], [], {}, [0, 0]
        if kept:
            yield from flush()

    return docs.select("doc_id", "text", "prints").mapInArrow(make, _BLOCK)


_BLOCK = "block long, doc_id long, words binary, rows binary"
_NAMES = ["block", "doc_id", "words", "rows"]
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_ROW = np.dtype([("doc", "<i8"), ("start", "<i4"), ("length", "<i4")])


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _marks(d: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeated windows: of each document one row, with the first and last start of each stretch."""
    if not len(d):
        return
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    at, n = _runs(d, s)
    owner, begin = d[at], s[at]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    ends = np.append(cut[1:], len(owner))
    pairs = np.stack((begin, begin + n - 1), 1).astype("<i4")
    yield _batch([[-1] * len(cut), owner[cut].tolist(), [None] * len(cut), [pairs[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())]])


def _blocks(block: np.ndarray, d: np.ndarray, s: np.ndarray, at: np.ndarray, slices: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((s, d, block))
    block, d, s, at = block[order], d[order], s[order], at[order]
    base = np.cumsum([0, *(len(x[0]) for x in slices)])
    cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
    out: list[list] = [[], [], [], []]
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        row, n = _runs(d[x:y], s[x:y])
        rows = np.empty(len(row), _ROW)
        rows["doc"], rows["start"], rows["length"] = d[x:y][row], s[x:y][row], n
        words, begin = [], at[x:y][row]
        for k, p, m in zip((np.searchsorted(base, begin, "right") - 1).tolist(), begin.tolist(), n.tolist()):
            _, text, start, end = slices[k]
            words.append(text[start[p - base[k]] : end[p - base[k] + m + window - 2]])
        for c, v in zip(out, (int(block[x]), None, b"\n".join(words), rows.tobytes())):
            c.append(v)
        if len(out[0]) >= 256:
            yield _batch(out)
            out = [[], [], [], []]
    if out[0]:
        yield _batch(out)


def _repeats(blocks: DataFrame, window: int) -> DataFrame:
    """(doc_id, starts): stretches of windows that an earlier place has, from blocks of all tasks."""

    def merge(batches):
        block, parts = None, []

        def close():
            w = Words([t for p in parts for t in p[0].split(b"\n")])
            rows = np.concatenate([np.frombuffer(p[1], _ROW) for p in parts])
            n = rows["length"].astype(np.int64)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            d, s, at = np.repeat(rows["doc"], n), np.repeat(rows["start"].astype(np.int64), n) + inside, np.repeat(w.bounds[:-1], n) + inside
            later = _later(w.marks(window)[at], d, s, at, w.code, window)
            yield from _marks(d[later], s[later])

        for batch in batches:
            for b, doc, words, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if b < 0:
                    yield _batch([[b], [doc], [None], [rows]])
                    continue
                if b != block and parts:
                    yield from close()
                    parts = []
                block = b
                parts.append((words, rows))
        if parts:
            yield from close()

    spread = F.when(F.col("block") >= 0, F.col("block")).otherwise(F.xxhash64("doc_id"))
    merged = blocks.withColumn("_to", spread).repartition("_to").drop("_to").sortWithinPartitions("block").mapInArrow(merge, _BLOCK)
    return merged.select("doc_id", F.col("rows").alias("starts"))


def removed(n: int, runs: list[bytes], window: int) -> np.ndarray:
    """Of n words, which a repeated window covers."""
    step = np.zeros(n + 1, np.int64)
    for r in runs:
        pairs = np.frombuffer(r, "<i4").reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1] + window, -1)
    return np.cumsum(step[:-1]) > 0


def _kept(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept text) of docs (doc_id, text, runs)."""

    def keep(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, raw, runs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                words = raw.split()
                gone = removed(len(words), runs, window) if runs else None
                kept = words if gone is None else [words[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(kept)
                for x, y in zip(out, (doc, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None)):
                    x.append(y)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "runs").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _verified(base: DataFrame, past: DataFrame | None, hits: DataFrame, heavy: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """What deduplicate returns of base (doc_id, text), from hits (print, doc_id) of base and past."""
    blocks = max(LEAST_BLOCKS, hits.count() // BLOCK_PRINTS)  # only where windows meet depends on it
    told = hits.join(F.broadcast(heavy.withColumn("_h", F.lit(True))), "print", "left").select("doc_id", F.when(F.col("_h"), -1 - F.col("print")).otherwise(F.col("print")).alias("print"))
    suspects = told.groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
    # Both joins below take the texts by doc_id, from one exchange: so nothing here may filter what goes into it.
    todo = base.join(suspects, "doc_id", "left").select("doc_id", "text", "prints")
    if past is not None:
        todo = todo.unionByName(past.join(suspects, "doc_id").select("doc_id", "text", "prints"))
    runs = _repeats(_windows(todo, window, gram, blocks), window).groupBy("doc_id").agg(F.collect_list("starts").alias("runs"))
    out = _kept(base.join(runs, "doc_id", "left"), window, with_text)
    return out if with_text else out.drop("kept_text")


def _based(docs: DataFrame) -> DataFrame:
    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def deduplicate(docs: DataFrame, index: Index | None = None, history: DataFrame | None = None, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text), a batch: doc_id, n_words, n_removed, kept_sha256, and kept_text if with_text.

    Words split at ASCII white space. A word goes if a window that covers it starts earlier too: in a document with a smaller
    doc_id, or earlier in its own; all windows are judged on the input, word for word. index: holds earlier batches, whose texts are history
    (doc_id, text), without which an index with runs raises; it gets this batch as a new run. A batch is judged against all before it by doc_id, so batches should
    come in its order. Null texts have no word; a text of fewer than `window` words keeps all. Rows without doc_id keep all
    words; of rows that repeat a doc_id, equal windows at equal places are not earlier than each other. An empty table gives
    an empty result; other columns are not read.
    """
    index = index or Index(docs.sparkSession)
    if index.runs and history is None:
        raise ValueError("the index holds earlier batches: history must have their texts")
    base, past = _based(docs), _based(history).where("doc_id IS NOT NULL") if index.runs else None
    hits = index.add(staged(fingerprints(base.where("doc_id IS NOT NULL"), window, gram), "substring-prints", "zstd"))
    return _verified(base, past, hits, index.heavy(), window, gram, with_text)


def deduplicate_in_batches(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """What deduplicate gives for all of docs, fed to one index in `batches` batches in the order of doc_id (cut at its approximate quantiles).

    Each batch is merge-joined with the runs of those before it, and runs are compacted as they come; what the joins suggest is
    verified for all batches at once, so that texts cross the network once.
    """
    base = _based(docs)
    prints = staged(fingerprints(base.where("doc_id IS NOT NULL"), window, gram), "substring-prints", "zstd")
    cuts = prints.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] or [] if batches > 1 else []
    cuts = [None, *sorted(set(cuts)), None]
    index, hits = Index(docs.sparkSession), None
    for low, high in zip(cuts, cuts[1:]):
        batch = prints if low is None else prints.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        found = index.add(batch)
        hits = found if hits is None else hits.unionByName(found)
    return _verified(base, None, hits, index.heavy(), window, gram, with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_in_batches(documents(spark, sf_dir))
