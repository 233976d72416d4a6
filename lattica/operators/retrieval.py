"""Ranked retrieval: terms, text and trigram indexes, BM25, fuzzy and vector candidates, scores, seeds, and the budgeted answer."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import embedded, hash_embedding, partial_ratios, stem, stemmed, weighted_ratios
from ..functions.scalars import norm_label_text, tokens, trigrams
from ..plans.model import RELATIONAL, STOP_WORDS
from .graph import expand, hub_limit, plain_label, touched_edges
from .staging import written

K1, B = 1.2, 0.75
TEXT_LIMIT, FUZZY_LIMIT, SEEDS, SEED_SHARE = 200, 300, 8, 0.15


def terms(question: str) -> list[str]:
    """Words of a question without stop words; all of them if none would be left. Words that ask for a relation go too, unless they are all there is."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", question)]
    kept = [w for w in words if w not in STOP_WORDS and len(w) >= 2] or words
    return [w for w in kept if w not in RELATIONAL] or kept


def postings(docs: DataFrame, id_col: str, text: Column, stems: bool = False) -> DataFrame:
    """(term, id, tf): how often each document has each term."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(text)).alias("term"))
    counted = words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return by_stem(counted) if stems else counted


def by_stem(index: DataFrame) -> DataFrame:
    """(term, id, tf) with terms as their stems, each stemmed once. A term without a letter of a suffix is its own stem and stays out of Python."""
    terms = index.select("term").distinct()
    lettered = F.col("term").rlike("[a-z]")
    stems = terms.where(~lettered).select("term", F.col("term").alias("stem")).unionByName(terms.where(lettered).select("term", stemmed(F.col("term")).alias("stem")))
    return index.join(stems, "term").groupBy(F.col("stem").alias("term"), "id").agg(F.sum("tf").alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(text)).cast("long").alias("len"))


def terms_with(prefixes: list[str]):
    """A test of a term: whether it begins with one of the prefixes."""
    return lambda term: reduce(or_, [term.startswith(p) for p in dict.fromkeys(prefixes)], F.lit(False))


def matched(docs: DataFrame, id_col: str, text: Column, prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) of terms that begin with a prefix, and (id, len): each text is split once, and only terms that are asked for leave it."""
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("words"))
    found = written(words.select("id", F.size("words").cast("long").alias("len"), F.filter("words", terms_with(prefixes)).alias("words")), "matched")
    index = found.select("id", F.explode("words").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return index, found.select("id", "len")


def bm25(index: DataFrame, lengths: DataFrame, prefixes: list[str], limit: int | None = TEXT_LIMIT) -> DataFrame:
    """(id, score): each prefix is a phrase, found in all terms that begin with it; Okapi weights with k1 = 1.2, b = 0.75."""
    spark = index.sparkSession
    q = F.broadcast(spark.createDataFrame([(p,) for p in dict.fromkeys(prefixes)] or [("\0",)], "phrase string"))
    tf = index.join(q, F.col("term").startswith(F.col("phrase"))).groupBy("phrase", "id").agg(F.sum("tf").alias("tf"))
    n = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    stats = lengths.agg(F.count(F.lit(1)).alias("total"), F.avg("len").alias("mean"))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    scored = tf.join(F.broadcast(n), "phrase").join(lengths, "id").crossJoin(F.broadcast(stats))  # n: a row a phrase; stats: one row
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    out = scored.groupBy("id").agg(F.sum(part).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def trigrams_of(words: list[str]) -> list[str]:
    return sorted({g for w in words for g in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])})


def trigram_index(nodes: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(trigram, id) of labels and slugs; only of the wanted trigrams, where these are given."""
    both = F.array_union(trigrams(F.coalesce("norm_label", F.lit(""))), trigrams(F.coalesce("slug", F.lit(""))))
    if wanted is not None:
        both = F.array_intersect(both, F.array(*map(F.lit, wanted)).cast("array<string>"))
    return nodes.select(F.explode(both).alias("trigram"), "id")


def trigram_candidates(index: DataFrame, words: list[str], limit: int = FUZZY_LIMIT) -> DataFrame:
    """(id, overlap): nodes with most of the words' trigrams."""
    return index.where(F.col("trigram").isin(*trigrams_of(words))).groupBy("id").agg(F.count(F.lit(1)).alias("overlap")).orderBy(F.desc("overlap"), "id").limit(limit)


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(word): distinct tokens of three letters or more of labels and slugs."""
    text = F.regexp_replace(F.concat_ws(" ", "norm_label", "slug"), "_", " ")
    return nodes.select(F.explode(tokens(text)).alias("word")).where(F.length("word") >= 3).distinct()


def expanded_terms(nodes: DataFrame, words: list[str], least: float = 78.0, most: int = 3) -> list[str]:
    """The words, and for those that no label has, up to three like ones that labels have."""
    spark = nodes.sparkSession
    known = written(vocabulary(nodes), "vocabulary")
    q = F.broadcast(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "place int, term string"))
    have = {r["word"] for r in known.join(q.select(F.col("term").alias("word")), "word", "left_semi").collect()}
    missing = F.broadcast(spark.createDataFrame([(i, w) for i, w in enumerate(words) if w not in have] or [(0, None)], "place int, term string"))
    near = F.abs(F.length("word") - F.length("term")) < F.greatest(F.length("word"), F.length("term"))
    # Words without a letter of the term have ratio 0: they stay out of Python, which a condition after it wouldn't keep them from.
    shared = F.arrays_overlap(F.split("word", ""), F.split("term", "")) if least > 0 else F.lit(True)
    scored = written(known.join(missing, near).where(shared), "near-words").withColumn("score", weighted_ratios(F.col("term"), F.col("word"))).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "word"))
    extra = [r["word"] for r in scored.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("place", "rank").select("word").collect()]
    return list(dict.fromkeys([*words, *extra]))


def fuzzy_candidates(nodes: DataFrame, words: list[str], least: float = 70.0) -> DataFrame:
    """(id, score): best partial similarity of a word with label and slug, of the trigram candidates; 70 or more, over 100."""
    spark = nodes.sparkSession
    few = trigram_candidates(trigram_index(nodes, trigrams_of(words)), words)
    text = F.lower(F.concat_ws(" ", "norm_label", "slug"))
    q = F.broadcast(spark.createDataFrame([(w,) for w in words] or [("\0",)], "term string"))
    pairs = nodes.join(F.broadcast(few.select("id")), "id").select("id", text.alias("text")).join(q)  # FUZZY_LIMIT rows times the words
    return pairs.withColumn("s", partial_ratios(F.col("term"), F.col("text"))).where(F.col("s") >= least).groupBy("id").agg((F.max("s") / 100).alias("score"))


def scores(nodes: DataFrame, words: list[str], text: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """(id, score, degree) above 0: text candidates 2 + BM25, fuzzy ones their ratio, label and slug hits on top, all by the share of words that hit; documents half."""
    name, slug = plain_label(F.coalesce("norm_label", "label", F.lit(""))), F.coalesce("slug", F.lit(""))
    exact = [F.when(name == w, 5.0).when(name.contains(w), 1.5).otherwise(0.0) for w in words]
    bonus = sum(exact, F.lit(0.0)) + sum((F.when(~name.contains(w) & slug.contains(w), 0.5).otherwise(0.0) for w in words), F.lit(0.0))
    matched = sum((F.when(name.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    base = nodes.join(text.select("id", F.col("score").alias("t")), "id", "left").join(fuzzy.select("id", F.col("score").alias("f")), "id", "left")
    total = F.coalesce(F.col("t") + 2, F.lit(0.0)) + F.coalesce("f", F.lit(0.0)) + bonus
    total = total * F.when(matched > 0, 0.4 + 0.6 * matched / max(1, len(words))).otherwise(1.0)
    doc = (F.col("kind") == "section") | F.col("file_type").isin("document", "paper")
    total = total * F.when(F.coalesce(doc, F.lit(False)), 0.5).otherwise(1.0)
    return base.select("id", total.alias("score"), F.coalesce("degree", F.lit(0)).alias("degree")).where("score > 0")


def seeds(ranked: DataFrame, most: int = SEEDS, share: float = SEED_SHARE) -> DataFrame:
    """(id, score, rank): the best, and up to `most` in all while scores are at least `share` of its; ties to the lower degree."""
    top = ranked.orderBy(F.desc("score"), "degree", "id").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "degree", "id"))  # at most `most` rows
    best = F.max("score").over(Window.partitionBy())
    return top.withColumns({"rank": rank, "best": best}).where((F.col("rank") == 1) | (F.col("score") >= share * F.col("best"))).select("id", "score", F.col("rank").cast("int").alias("rank"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 8, least: float = 0.30) -> DataFrame:
    """(node_id, sim): top k by cosine, at least `least`; vectors of another length are left out. One pass, no shuffle but that of the top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = vectors.where(F.size("embedding") == len(query)).select("node_id", cosine(F.col("embedding"), q).alias("sim"))
    return sim.where(F.col("sim") >= least).orderBy(F.desc("sim"), "node_id").limit(k)


def embedding_text(nodes: DataFrame) -> DataFrame:
    """(node_id, text) of nodes that get a vector."""
    text = F.trim(F.concat_ws(" ", "label", F.regexp_replace("slug", "_", " "), "rationale", F.array_join(F.coalesce("concepts", F.array().cast("array<string>")), " ")))
    return nodes.where(~F.coalesce(F.col("kind").isin("file", "module"), F.lit(False))).select(F.col("id").alias("node_id"), text.alias("text")).where("text <> ''")


def build_vectors(nodes: DataFrame, cache: DataFrame | None = None, model: str = "hash", embed=embedded) -> DataFrame:
    """(node_id, text_sha, model, dim, embedding): vectors of texts that the cache has are taken from it; only others are computed, each text once."""
    texts = embedding_text(nodes).withColumn("text_sha", F.sha2(F.concat(F.lit(model + "\0"), "text"), 256))
    distinct = texts.select("text_sha", "text").dropDuplicates(["text_sha"])
    if cache is not None:
        have = cache.where(F.col("model") == model).select("text_sha", "embedding").dropDuplicates(["text_sha"])
        distinct = distinct.join(have, "text_sha", "left_anti")
    made = distinct.select("text_sha", embed(F.col("text")).alias("embedding"))
    if cache is not None:
        made = made.unionByName(have)
    return texts.join(made, "text_sha").select("node_id", "text_sha", F.lit(model).alias("model"), F.size("embedding").alias("dim"), "embedding")


def vector_boost(ranked: DataFrame, near: DataFrame) -> DataFrame:
    """Ranked scores, raised by the best score times the similarity of vector neighbours; neighbours that weren't ranked come in."""
    best = F.coalesce(F.max("score").over(Window.partitionBy()), F.lit(1.0))
    joined = ranked.join(near.select(F.col("node_id").alias("id"), "sim"), "id", "full_outer")
    return joined.select("id", (F.coalesce("score", F.lit(0.0)) + best * F.coalesce("sim", F.lit(0.0))).alias("score"), F.coalesce("degree", F.lit(0)).alias("degree"))


def budgeted(lines: DataFrame, budget: int, order: str = "place") -> DataFrame:
    """The lines (place, line), in order, while their characters and line ends are at most `budget`."""
    used = F.sum(F.length("line") + 1).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where(F.col("used") <= budget)


def query(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, budget: int = 2000, vectors: DataFrame | None = None) -> DataFrame:
    """(place, line) of the answer: a header, nodes (seeds first, then by degree), and edges between them, up to 4 * budget characters. No row if nothing matches."""
    words = expanded_terms(nodes, terms(question))
    text = F.concat_ws(" ", "label", "slug", "source_file", "rationale")
    stems = [stem(norm_label_text(w)) for w in words]
    index, lengths = matched(nodes, "id", text, [s[:1] for s in stems])  # a stem begins with its word's first letter
    found = bm25(by_stem(index), lengths, stems)
    ranked = scores(nodes, words, found, fuzzy_candidates(nodes, words))
    if vectors is not None:
        ranked = vector_boost(ranked, nearest(vectors, hash_embedding(question)))
    first = seeds(ranked)
    visited = expand(nodes, edges, first, depth)
    hubs = nodes.join(F.broadcast(hub_limit(nodes)), F.col("degree") >= F.col("hub")).select("id")
    shown = nodes.join(visited.select("id"), "id").join(first.select("id", "rank"), "id", "left")
    most = budget * 4  # a line takes two characters at least, so what comes after so many can't be within the budget
    first_nodes = [F.col("rank").asc_nulls_last(), F.desc("degree"), F.col("id").cast("string")]
    order = F.row_number().over(Window.orderBy(*first_nodes))
    node_lines = shown.orderBy(*first_nodes).limit(most).select(order.cast("long").alias("place"), F.format_string("NODE %s [%s %s]", "label", F.coalesce("source_file", F.lit("")), F.coalesce("source_location", F.lit(""))).alias("line"))
    met = touched_edges(edges.select("id", "src", "dst", "relation", "confidence"), visited, hubs, depth)
    met = met.groupBy("src", "dst", "relation").agg(F.min_by("confidence", "id").alias("confidence"))  # the confidence of the first parallel edge
    names = nodes.select("id", "label")
    met = met.join(names.withColumnRenamed("id", "src").withColumnRenamed("label", "a"), "src").join(names.withColumnRenamed("id", "dst").withColumnRenamed("label", "b"), "dst")
    edge_order = F.row_number().over(Window.orderBy("src", "dst", "relation")) + 1_000_000_000
    edge_lines = met.orderBy("src", "dst", "relation").limit(most).select(edge_order.cast("long").alias("place"), F.format_string("EDGE %s --%s [%s]--> %s", "a", "relation", F.coalesce("confidence", F.lit("")), "b").alias("line"))
    header = first.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("place"), F.format_string("%d seeds for: %s", "n", F.lit(" ".join(words))).alias("line"))
    return budgeted(header.unionByName(node_lines).unionByName(edge_lines), budget * 4).select("place", "line").orderBy("place")
