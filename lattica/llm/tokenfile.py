"""Token ids in files of Simple-8b words: packing, the file format, and writing and reading a corpus in document order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BYTE_FILE, encoder
from .common import documents, in_batches, stage_path, staged, tokenizer_path

#: How many ids a word holds and of how many bits, by selector; ESCAPE: the id, of more than 60 bits, is the next word.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = 15
#: Ids of a block at most; a document is one block or several.
BLOCK = 1 << 16
MAGIC = b"S8BTOK1\n"
#: Ids after which a file ends, and ids that are packed together, about.
FILE_TOKENS, GROUP = 8_000_000, 1 << 19
END_ID = 2
#: More blocks than this find their words side by side.
SIDE = 32


_LENGTHS = np.array([i.bit_length() for i in range(1 << 17)], np.uint8)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit integer without leading zeros."""
    if not len(values) or values.max() < len(_LENGTHS):
        return _LENGTHS[values]
    return np.searchsorted(_POWERS, values, "right").astype(np.uint8)


def _word_starts(step: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places in ascending order where words start, if a word that starts at i takes step[i] places and the first of each block starts at its beginning. Blocks go on side by side while there are many."""
    heads = np.zeros(len(step), bool)
    live = begin < end
    while live.sum() > SIDE:
        begin, end = begin[live], end[live]
        heads[begin] = True
        begin = begin + step[begin]
        live = begin < end
    steps, at = step.tobytes(), []
    for i, last in zip(begin[live].tolist(), end[live].tolist()):
        while i < last:
            at.append(i)
            i += steps[i]
    heads[at] = True
    return np.flatnonzero(heads)


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, words of each block) of blocks of `sizes` ids each, all in `ids`. A word's high 4 bits are its selector; unused places at a block's end are 0."""
    ids, sizes = np.asarray(ids, np.uint64), np.asarray(sizes, np.int64)
    pad = int(COUNTS[0])
    room = sizes + pad
    begin = np.cumsum(room) - room  # of each block, in an array with places to spare between blocks
    old = np.cumsum(sizes) - sizes
    values = np.zeros(int(room.sum()), np.uint64)
    values[np.repeat(begin - old, sizes) + np.arange(len(ids))] = ids
    choice = np.full(len(values), len(COUNTS) - 1, np.uint8)
    width = bit_lengths(values)
    most, have = width, 1  # the widest of the `have` ids from each place on
    for s in range(len(COUNTS) - 2, -1, -1):  # from few ids to many: the last that fits stays
        c = int(COUNTS[s])
        n = len(values) - c + 1
        most, have = np.maximum(most[:n], most[c - have : c - have + n]), c
        np.copyto(choice[:n], s, where=most <= BITS[s])
    choice[width > 60] = ESCAPE
    where = _word_starts(np.append(COUNTS, [1, 1])[choice].astype(np.uint8), begin, begin + sizes)
    per = np.searchsorted(where, begin + sizes) - np.searchsorted(where, begin)
    kind = choice[where]
    length = 1 + (kind == ESCAPE)
    place = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint64)
    for s, (c, b) in enumerate(zip(COUNTS.tolist(), BITS.tolist())):
        mine = np.flatnonzero(kind == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            for k in range(c):
                word |= values[where[mine] + k] << np.uint64(b * k)
            out[place[mine]] = word
    raw = np.flatnonzero(kind == ESCAPE)
    out[place[raw]] = np.uint64(ESCAPE << 60)
    out[place[raw] + 1] = values[where[raw]]
    ends = np.concatenate(([0], np.cumsum(length)))
    upto = np.concatenate(([0], np.cumsum(per))).astype(np.int64)
    return out, np.diff(ends[upto])


def unpack(words: np.ndarray, n_words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of the blocks, all at once: counts by selector give each word's place."""
    words, n_words, sizes = np.asarray(words, np.uint64), np.asarray(n_words, np.int64), np.asarray(sizes, np.int64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (kind == ESCAPE).any():  # which words are raw: those after an escape that isn't raw itself
        for i in np.flatnonzero(kind == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
    count = np.append(COUNTS, [0, 0])[kind]  # an escape has none of its own
    count[raw] = 1
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s, (c, b) in enumerate(zip(COUNTS.tolist(), BITS.tolist())):
        mine = np.flatnonzero((kind == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << b) - 1)
            for k in range(c):
                out[place[mine] + k] = (words[mine] >> np.uint64(b * k)) & mask
    out[place[raw]] = words[raw]
    filled = np.append(place, len(out))[np.cumsum(n_words)] if len(n_words) else np.zeros(0, np.int64)
    start = np.concatenate(([0], filled[:-1])) if len(n_words) else filled
    old = np.cumsum(sizes) - sizes
    return out[np.repeat(start - old, sizes) + np.arange(int(sizes.sum()))]


class FileWriter:
    """A token file as it grows: the magic, the words of all blocks, then for each document its id, whether it has one, its ids and blocks, and of each block where it ends in words; a checksum of these tables, their counts, and the magic again."""

    def __init__(self, f):
        self.f, self.tokens = f, 0
        self.doc_ids: list[int | None] = []
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        blocks, per = block_sizes(sizes, block)
        words, n_words = pack(np.concatenate(ids), blocks)
        self.f.write(words.astype("<u8").tobytes())
        self.doc_ids += doc_ids
        self.tables.append((sizes, per, n_words))
        self.tokens += int(sizes.sum())

    def close(self) -> None:
        sizes, per, n_words = (np.concatenate(x) if self.tables else np.zeros(0, np.int64) for x in (zip(*self.tables) if self.tables else ((), (), ())))
        known = np.array([d is not None for d in self.doc_ids], "u1")
        table = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + known.tobytes() + sizes.astype("<i8").tobytes() + per.astype("<i4").tobytes() + np.cumsum(n_words).astype("<i8").tobytes()
        self.f.write(table + struct.pack("<IQQ", zlib.crc32(table), len(sizes), len(n_words)) + MAGIC)


def block_sizes(sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each block, blocks of each document) of documents of so many ids."""
    per = np.maximum(1, -(-np.asarray(sizes, np.int64) // block))
    out = np.full(int(per.sum()), block, np.int64)
    last = np.cumsum(per) - 1
    out[last] = sizes - (per - 1) * block
    return out, per


def read_file(data: bytes, block: int = BLOCK) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a file, in its order, some megabytes of ids at a time."""
    if data[:8] != MAGIC or data[-8:] != MAGIC or len(data) < 36:
        raise ValueError("not a whole token file")
    check, n, m = struct.unpack_from("<IQQ", data, len(data) - 28)
    size = 21 * n + 8 * m
    at = len(data) - 28 - size
    if at < 8 or zlib.crc32(data[at : at + size]) != check:
        raise ValueError("the token file's tables are damaged")
    doc_ids = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, "u1", n, at + 8 * n)
    sizes = np.frombuffer(data, "<i8", n, at + 9 * n)
    doc_blocks = np.frombuffer(data, "<i4", n, at + 17 * n)
    ends = np.frombuffer(data, "<i8", m, at + 21 * n)
    words = np.frombuffer(data, "<u8", int(ends[-1]) if m else 0, 8)
    starts = np.concatenate(([0], ends[:-1])) if m else ends
    first = np.concatenate(([0], np.cumsum(doc_blocks)))
    all_sizes, _ = block_sizes(sizes, block)
    i = 0
    while i < n:
        j, have = i, 0
        while j < n and (j == i or have + sizes[j] <= 1 << 21):
            have += int(sizes[j])
            j += 1
        a, b = first[i], first[j]
        ids = unpack(words[starts[a] : ends[b - 1]], ends[a:b] - starts[a:b], all_sizes[a:b])
        cut = np.concatenate(([0], np.cumsum(sizes[i:j])))
        for k in range(i, j):
            yield int(doc_ids[k]) if known[k] else None, ids[cut[k - i] : cut[k - i + 1]]
        i = j


def _file_system(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_tokens(docs: DataFrame, out: str, file: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes docs (doc_id, text) and writes token files in ascending doc_id order under `out`; the manifest: part, seq, path, n_docs, n_tokens.

    Rows are cut into ranges of doc_id (and of a digest of the text, should one doc_id have many rows), each sorted by one task,
    which writes as it reads: a file ends when it has file_tokens ids, so a task holds no more than GROUP ids and one document.
    Files in the order of (part, seq) have all documents in order. A file is written under a name of its own and renamed at its
    end, so that a task can run again.
    """
    file = file or tokenizer_path(BYTE_FILE)

    def written(batches):
        import uuid

        from pyspark import TaskContext

        e, part = encoder(file), TaskContext.get().partitionId()
        system, base = _file_system(out)
        system.create_dir(base, recursive=True)
        state: dict = {"seq": 0, "w": None, "own": ""}

        def close():
            w, at = state["w"], f"{base}/part-{part:06d}-{state['seq']:06d}.tok"
            w.close()
            w.f.close()
            system.move(state["own"], at)
            row = {"part": [part], "seq": [state["seq"]], "path": [at], "n_docs": [len(w.doc_ids)], "n_tokens": [w.tokens]}
            state.update(seq=state["seq"] + 1, w=None)
            return pa.RecordBatch.from_pydict(row, schema=manifest)

        def add(doc_ids, group):
            if state["w"] is None:
                state["own"] = f"{base}/_{uuid.uuid4().hex}"
                state["w"] = FileWriter(system.open_output_stream(state["own"]))
            state["w"].add(doc_ids, group)

        for batch in batches:
            names, group, have, first = batch.column(0).to_pylist(), [], 0, 0
            for ids in e.encode([t or "" for t in batch.column(1).to_pylist()]):
                group.append(np.append(ids, np.uint32(end_id)))
                have += len(group[-1])
                if have >= min(GROUP, file_tokens):
                    add(names[first : first + len(group)], group)
                    first, group, have = first + len(group), [], 0
                    if state["w"].tokens >= file_tokens:
                        yield close()
            if group:
                add(names[first:], group)
                if state["w"].tokens >= file_tokens:
                    yield close()
        if state["w"] is not None:
            yield close()

    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return staged(rows.mapInArrow(written, "part int, seq int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of a manifest; start counts the ids of all documents before it."""
    order = Window.orderBy("part", "seq")  # one small row a file
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("before"), F.row_number().over(order).alias("number"))
    tasks = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches):
        system, _ = _file_system(out)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(path) as f:
                    data = f.read()
                rows = []
                for doc_id, ids in read_file(data):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = files.repartitionById(tasks, F.pmod("number", F.lit(tasks))).select("path", "before")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the token files.

    Null and empty texts have the end id alone. Rows with one doc_id lie side by side, ordered by a digest of their text; rows
    without doc_id come last; an empty table gives no file and no row. Other columns are not read.
    """
    out = stage_path(spark, "tokens")
    return read_tokens(write_tokens(documents(spark, sf_dir), out), out)
