"""Near-duplicates by b-bit MinHash: band candidates, collision-corrected similarity from packed low bits, and links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, byte_slices, documents, in_batches, lean, mixed, staged, utf8

#: Minima of a signature, bands and rows of a band, low bits kept of each minimum.
HASHES, BANDS, ROWS, LOW = 128, 32, 4, 4
#: A pair goes on to its full sets when the estimate is at most so many standard deviations below the threshold.
DEVIATIONS = 6
#: The parts that a bucket's members fall into; centres of stars meet each part in a task of its own.
SALTS = 64
#: Centres of stars in a round of a bucket part, doubled from round to round; members beside one copy of a centre's text.
CENTRES, BESIDE = 8, 256
#: Bits of the filter of classes with candidates, at most, and of each segment that one task fills.
FILTER_BITS, SEGMENT_BITS = 1 << 28, 1 << 20
#: Bytes of text of pairs that are confirmed together, about.
PAIR_BYTES = 4 << 20
#: Up to so many distinct edges, counted, components are found in one task; above it by rounds of stars in the cluster, with the same result.
TOGETHER = 1_000_000

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(raws: list[bytes], words: int) -> list[np.ndarray]:
    """128-bit digests, as rows of two 64-bit words in ascending order, of each text's distinct shingles of so many words, lower case; a text of fewer words has one, a text without words none."""
    out = []
    for a, b in byte_slices(raws):
        w = Words(raws[a:b], lower=True)
        lanes = [w.grams(words, k) for k in (0, 1)]
        for i in range(b - a):
            s, e = int(w.bounds[i]), int(w.bounds[i + 1])
            if e - s >= words:
                out.append(_distinct(lanes[0][s : e - words + 1], lanes[1][s : e - words + 1]))
            elif e > s:
                own = b"\x00".join([b"%d" % (e - s), *(w.distinct[c] for c in w.code[s:e].tolist())])  # no word has such a digest: words hold no count
                out.append(np.frombuffer(hashlib.blake2b(own, digest_size=16, key=b"lattica short").digest(), "<u8").reshape(1, 2))
            else:
                out.append(np.zeros((0, 2), np.uint64))
    return out


def _distinct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    same = x[1:] == x[:-1]
    if (y[1:][same] != y[:-1][same]).any():  # one lane alone doesn't tell them apart
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    keep = np.append(True, ~same)
    return np.stack((x[keep], y[keep]), 1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash function over the shingles (32 bits)."""
    best = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * _A + _B
        np.minimum(best, part.min(axis=0), out=best)
    return best >> np.uint64(32)


def packed(low: np.ndarray) -> bytes:
    """The low LOW bits of the minima, side by side in 64-bit words."""
    per = 64 // LOW
    parts = (low & np.uint64((1 << LOW) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(LOW))
    return np.bitwise_or.reduce(parts, axis=1).astype("<u8").tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row: equal minima by bit counts, less what LOW bits make equal by chance."""
    differ = a ^ b
    any_bit = differ.copy()
    for k in range(1, LOW):
        any_bit |= differ >> np.uint64(k)
    lowest = np.uint64(sum(1 << (LOW * k) for k in range(64 // LOW)))
    unequal = np.bitwise_count(any_bit & lowest).sum(axis=1)
    chance = 1 / (1 << LOW)
    return (1 - unequal / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    p = percent / 100 + (1 - percent / 100) / (1 << LOW)
    return percent / 100 - DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5 / (1 - 1 / (1 << LOW))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), digest of the whole set, sig (packed low bits), bands (64-bit keys); of an empty set the last three are null."""

    def sign(batches):
        salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            raws = utf8(batch.column(1))
            n, digest, sig, bands = [], [], [], []
            for s in shingle_sets(raws, words):
                n.append(len(s))
                if not len(s):
                    digest.append(None), sig.append(None), bands.append(None)
                    continue
                digest.append(hashlib.blake2b(np.ascontiguousarray(s, "<u8").tobytes(), digest_size=32).digest())
                low = minima(s[:, 0])
                sig.append(packed(low))
                key = salt.copy()
                for r in low.reshape(BANDS, ROWS).T:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + r)
                bands.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean("words", sign), "doc_id long, n long, digest binary, sig binary, bands array<long>")


def _joined_together(pairs: DataFrame) -> DataFrame:
    """(id, root) of the ends of pairs (u, v) but roots, in one task: roots hook to lesser ones, then all ids jump to their root, until no pair has two."""

    def join(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        u, v = (np.concatenate(x) for x in zip(*parts))
        ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        u, v, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
        while True:
            x, y = root[u], root[v]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        other = np.flatnonzero(root != np.arange(len(ids)))
        for i in range(0, len(other), 1 << 16):
            own = other[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["id", "root"])

    return pairs.coalesce(1).mapInArrow(join, "id long, root long")


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(id, root) of the ends of edges (u, v) but roots: root is the least id that links reach; in one task, or by large and small stars, round by round."""
    pairs = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near-edges")
    if pairs.count() <= together:
        return staged(_joined_together(pairs), "near-stars")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = staged(small, "near-stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == mark:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = now


def _filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a long column, FILTER_BITS at most: each task fills segments of it, which are joined here. A full one stops little, and nothing depends on it."""
    n = ids.count()
    bits = 1 << 16
    while bits < FILTER_BITS and bits < 16 * n:
        bits *= 2
    step = min(bits, SEGMENT_BITS)

    def split(batches):
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // step).astype(np.int32)), pa.array((at % step).astype(np.int32))], names=["segment", "place"])

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(segment).tolist():
                own.setdefault(k, np.zeros(step, bool))[place[segment == k]] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(x).tobytes() for x in own.values()], pa.binary())], names=["segment", "part"])

    whole = np.zeros(bits // 8, np.uint8)
    places = ids.select(column).mapInArrow(split, "segment int, place int").distinct().repartition("segment")
    for row in places.mapInArrow(fill, "segment int, part binary").toLocalIterator():
        whole[row["segment"] * (step // 8) :][: step // 8] |= np.frombuffer(row["part"], np.uint8)
    return whole


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))
    return [((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 20, 36)]


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, text of the wanted classes (cls): that of the document that names the class. A filter of bounded size drops most others before the shuffle; the join drops the rest."""
    bloom = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, "cls"))

    def make(batches):
        for batch in batches:
            flat, bits = bloom.value, len(bloom.value) * 8
            keep = np.ones(batch.num_rows, bool)
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                keep &= (flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            if keep.any():
                yield batch.filter(pa.array(keep))

    made = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("cls"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(lean("words", make), "cls long, text binary")
    return made.join(wanted, "cls", "left_semi").distinct()  # a doc_id on several rows may have several texts


def similar(left: list[bytes], right: list[bytes], words: int, percent: int) -> list[bool]:
    """Of pairs of texts, whether percent * union <= 100 * intersection of their shingles, compared word for word."""
    number: dict[bytes, int] = {}
    for x in (*left, *right):
        number.setdefault(x, len(number))
    w = Words(list(number), lower=True)
    grams = w.gram_codes(words)
    sets = []
    for i in range(len(number)):
        s, e = int(w.bounds[i]), int(w.bounds[i + 1])
        sets.append(np.unique(grams[s : e - words + 1]) if e - s >= words else w.code[s:e])
    out = []
    for i, j in ((number[x], number[y]) for x, y in zip(left, right)):
        x, y = sets[i], sets[j]
        short = w.bounds[i + 1] - w.bounds[i] < words, w.bounds[j + 1] - w.bounds[j] < words
        if any(short):  # one set of one sequence: equal or nothing in common
            out.append(all(short) and len(x) > 0 and np.array_equal(x, y))
            continue
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * common >= percent * (len(x) + len(y) - common))
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A class with many partners meets them in parts, beside a copy of its text in each."""

    def check(batches):
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (2, 3))
            ok: list[bool] = []
            for x, y in byte_slices([p + q for p, q in zip(left, right)], PAIR_BYTES):
                ok += similar(left[x:y], right[x:y], words, percent)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BESIDE).cast("int").alias("parts"))
    pairs = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("right")), "b")
    left = parts.join(texts, F.col("a") == F.col("cls")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("left"))
    return right.join(left, ["a", "part"]).select("a", "b", "left", "right").mapInArrow(lean("words", check), "u long, v long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, judged: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (a < b), without those judged before, whose sizes allow the similarity and whose signatures don't rule it out."""
    least = least_estimate(percent)

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(estimated(a, b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    if judged is not None:
        pairs = pairs.join(judged, ["a", "b"], "left_anti")
    one = pairs.join(reps.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    two = one.join(reps.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return two.where(fits).select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def _stars(members: DataFrame, centres: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of buckets, and the members that were a centre.

    members: key, cls, label, part, done. Of each part of a bucket the first `centres` members that were none yet become
    centres, and each meets the members of the bucket with another label: in one task per part, so that no task holds a bucket.
    Members that were a centre before have met all others then; those with their label had it ever since.
    """
    order = F.row_number().over(Window.partitionBy("key", "part").orderBy("cls"))
    chosen = staged(members.where("NOT done").withColumn("rank", order).where(F.col("rank") <= centres).select("key", "cls", "label"), "near-centres")
    everywhere = chosen.join(members.select("key", "part").distinct(), "key").select("key", "part", F.col("cls").alias("c"), F.col("label").alias("l"))
    return members.where("NOT done").join(everywhere, ["key", "part"]).where("label <> l").select(F.col("c").alias("a"), F.col("cls").alias("b")), chosen.select("key", "cls")


def _merged(labels: DataFrame | None, links: DataFrame, together: int) -> DataFrame:
    """labels (id, root; None: none yet) after links (u, v): only the links' roots are joined, and take what has them along."""
    if labels is None:
        return components(links, together)
    ends = links.join(labels.select(F.col("id").alias("u"), F.col("root").alias("ru")), "u", "left").join(labels.select(F.col("id").alias("v"), F.col("root").alias("rv")), "v", "left")
    roots = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), together)
    moved = roots.select(F.col("id").alias("root"), F.col("root").alias("to"))
    told = labels.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return staged(told.unionByName(roots.join(labels.select("id"), "id", "left_anti").select("id", "root")), "near-labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, together: int = TOGETHER) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts lower-case A-Z and split at ASCII white space; a text's set has its distinct shingles of `words` words, or its whole
    sequence if it has fewer. Two documents are linked when 100 * intersection >= percent * union of their sets; component_id
    is the least doc_id that links reach, kept is doc_id = component_id. Null, empty and blank texts have no shingle and are
    linked with nothing; rows without doc_id too (component_id null, kept). doc_id is taken as unique: rows that
    repeat one are judged by their own text, and texts whose class it names share a component. An empty table gives an empty result; other columns are not read.

    Sets hold 128-bit keyed digests of shingles, and documents whose sets have one digest are a class, named by its least
    doc_id; only classes are compared. A class pair is a candidate if a band of ROWS minima agrees (at similarity 0.8 all 32
    bands disagree with chance 5e-8), and is linked only when its texts' shingles, compared word for word, are similar enough.
    In each bucket stars are confirmed, round by round, from one centre and then from more, against all members that are not yet
    in the centre's component, until a bucket is one component or every member was a centre: no bucket is cut, no pair left out.
    A pair is judged once, in whichever bucket it comes up first. together: as many edges as components are found of in one task.
    """
    rows = staged(signatures(in_batches(docs), words), "near-signatures")
    reps = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = staged(reps, "near-classes")

    keyed = reps.select("cls", F.explode("bands").alias("key"))
    per_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.least(F.lit(SALTS), F.ceil(F.col("size") / BESIDE)).cast("int")
    members = keyed.join(per_key, "key").select("key", "cls", F.col("cls").alias("label"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"), F.lit(False).alias("done"))
    members = staged(members, "near-buckets")
    texts = staged(_texts_of(docs, staged(members.select("cls").distinct(), "near-wanted")), "near-texts")

    judged, labels, centres = None, None, 1
    while members.limit(1).count():
        pairs, chosen = _stars(members, centres)
        likely = _likely(pairs, reps, percent, judged)
        likely = staged(likely, "near-likely")
        judged = likely if judged is None else judged.unionByName(likely)
        links = staged(_confirmed(likely, texts, words, percent), "near-links")
        labels = _merged(labels, links, together)
        was = members.join(chosen.withColumn("now", F.lit(True)), ["key", "cls"], "left").select("key", "cls", "part", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        told = was.join(labels, was["cls"] == labels["id"], "left").select("key", "cls", F.coalesce("root", "cls").alias("label"), "part", "done")
        open_keys = told.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min("done").alias("all")).where("l <> h AND NOT all").select("key")
        members = staged(told.join(open_keys, "key", "left_semi"), "near-open")
        centres = max(CENTRES, 2 * centres)

    full = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "digest")
    roots = reps.select("digest", F.col("cls").alias("component_id"))
    if labels is not None:
        roots = reps.select("digest", "cls").join(labels, F.col("cls") == F.col("id"), "left").select("digest", F.coalesce("root", "cls").alias("component_id"))
    full = full.join(roots, "digest").select("doc_id", "n", "component_id")
    bare = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = full.unionByName(bare)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2, percent=80)
