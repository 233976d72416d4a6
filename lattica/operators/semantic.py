"""The semantic layer: work orders for a model, and what its answers change. The model itself is a callable that is passed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_object, location_start, normalize, quantize_confidence
from .graph import plain_label
from .staging import numbered

RATIONALE, CONCEPTS, CONCEPT_CHARS, NAME, CHUNK_FILES, FILE_CHARS = 300, 6, 40, 60, 25, 18_000
RESPONSE = (
    "annotations map<string, array<struct<label: string, line: int, rationale: string, concepts: array<string>>>>, "
    "ambiguous_edges map<string, array<struct<src: string, dst: string, relation: string, why: string>>>, community_names map<string, string>"
)


def work_order(files: DataFrame, nodes: DataFrame, per_chunk: int = CHUNK_FILES, text_chars: int = FILE_CHARS) -> DataFrame:
    """(chunk, request): JSON requests of up to per_chunk files (path, content), each with its symbols. The model sees at most text_chars of a file: the limit is the model's."""
    symbols = nodes.where("kind <> 'file'").groupBy(F.col("source_file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("source_location", "label", "kind"))).alias("symbols"))
    chunk = numbered(files.select("path"), ["path"]).select("path", F.floor(F.col("n") / per_chunk).cast("int").alias("chunk"))  # the texts join afterwards
    body = files.join(chunk, "path").join(symbols, "path", "left").select("chunk", F.struct("path", F.substring("content", 1, text_chars).alias("text"), "symbols").alias("f"))
    return body.groupBy("chunk").agg(F.to_json(F.struct(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["path"] < b["path"], -1).otherwise(1)).alias("files"))).alias("request"))


def ask(requests: DataFrame, complete) -> DataFrame:
    """(chunk, response): complete(text) -> text, called once a request where the request lies."""

    def run(batches):
        for b in batches:
            b["response"] = [complete(x) for x in b["request"]]
            yield b[["chunk", "response"]]

    return requests.mapInPandas(run, "chunk int, response string")


def read_responses(spark: SparkSession, glob: str) -> DataFrame:
    """Response files, parsed: lists of one file's annotations and edges of all responses together, of names the last by file name."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.from_json(json_object(F.col("value")), RESPONSE).alias("r"))
    return raw.select("at", "r.*")


def annotations_of(responses: DataFrame) -> DataFrame:
    """(source_file, label, line, rationale, concepts)."""
    return responses.select(F.explode("annotations").alias("source_file", "list")).select("source_file", F.explode("list").alias("a")).select("source_file", "a.*")


def ambiguous_of(responses: DataFrame) -> DataFrame:
    return responses.select(F.explode("ambiguous_edges").alias("source_file", "list")).select("source_file", F.explode("list").alias("e")).select("source_file", "e.*")


def names_of(responses: DataFrame) -> DataFrame:
    """(community, label): the last response's name for each, 60 characters at most."""
    each = responses.select("at", F.explode("community_names").alias("community", "label"))
    return each.groupBy(F.col("community").cast("int").alias("community")).agg(F.substring(F.max_by("label", "at"), 1, NAME).alias("label"))


def nearest_node(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations with the id of the node in their file that has their label and lies nearest to their line, of equally near ones the least id; without a line the first one. A node without a place is at every line.

    Nodes are told apart by file, label and place, and questions by file, label and line: sorted together, each question
    takes the last place before it and the first after it, so there are no pairs of annotations and nodes.
    """
    key = lambda c: plain_label(F.trim(c))
    named = nodes.select(F.col("source_file").alias("_f"), key(F.col("label")).alias("_k"), location_start(F.col("source_location")).cast("long").alias("_at"), "id")
    spots = named.groupBy("_f", "_k", "_at").agg(F.min("id").alias("id"))
    anywhere = named.groupBy("_f", "_k").agg(F.min("id").alias("first"), F.min(F.when(F.col("_at").isNull(), F.col("id"))).alias("loose"))
    asked = annotations.select(F.col("source_file").alias("_f"), key(F.col("label")).alias("_k"), F.col("line").cast("long").alias("_at")).distinct()
    lines = asked.where("_at IS NOT NULL").join(anywhere.select("_f", "_k", "loose"), ["_f", "_k"])
    spot = F.struct("_at", "id")
    none = F.lit(None)
    both = spots.where("_at IS NOT NULL").select("_f", "_k", "_at", spot.alias("spot"), none.cast("long").alias("loose"), F.lit(False).alias("asks"))
    both = both.unionByName(lines.select("_f", "_k", "_at", F.when(F.lit(False), F.struct("_at", F.col("loose").alias("id"))).alias("spot"), "loose", F.lit(True).alias("asks")))
    here = Window.partitionBy("_f", "_k").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("before", F.last("spot", ignorenulls=True).over(here.orderBy("_at", "asks"))).withColumn("after", F.last("spot", ignorenulls=True).over(here.orderBy(F.desc("_at"), "asks")))
    choice = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{c}._at")).alias("d"), F.col(f"{c}.id").alias("id"))) for c in ("before", "after")]
    loose = F.when(F.col("loose").isNotNull(), F.struct(F.lit(0).cast("long").alias("d"), F.col("loose").alias("id")))
    found = near.where("asks").select("_f", "_k", "_at", F.least(*choice, loose)["id"].alias("id"))
    found = found.unionByName(asked.where("_at IS NULL").join(anywhere.select("_f", "_k", F.col("first").alias("id")), ["_f", "_k"]))
    same = (F.col("source_file") == F.col("_f")) & (key(F.col("label")) == F.col("_k")) & F.col("line").cast("long").eqNullSafe(F.col("_at"))
    return annotations.join(found, same).select(*[annotations[c] for c in annotations.columns], "id")


def apply_annotations(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes whose files were annotated, with rationale and concepts of their annotation, or none; others as they were."""
    few = F.slice(F.transform(F.coalesce("concepts", F.array().cast("array<string>")), lambda c: F.substring(c, 1, CONCEPT_CHARS)), 1, CONCEPTS)
    got = nearest_node(annotations, nodes).groupBy("id").agg(F.max_by(F.struct(F.substring("rationale", 1, RATIONALE).alias("r"), few.alias("c")), "line").alias("new"))
    done = annotations.select("source_file").distinct().withColumn("_done", F.lit(True))
    out = nodes.join(done, "source_file", "left").join(got, "id", "left")
    reset = F.coalesce("_done", F.lit(False)) & (F.col("origin") == "ast")
    rationale = F.when(F.col("new").isNotNull(), F.col("new.r")).when(~reset, F.col("rationale"))
    concepts = F.when(F.col("new").isNotNull(), F.col("new.c")).when(~reset, F.col("concepts"))
    return out.withColumns({"rationale": rationale, "concepts": concepts}).select(*nodes.columns)


def ambiguous_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AMBIGUOUS edges (0.2, evidence llm) of (source_file, src, dst, relation, why) whose labels are nodes of their file or, failing that, anywhere."""
    out = edges.withColumn("note", F.substring("why", 1, 200))
    for end in ("src", "dst"):
        here = nodes.groupBy(plain_label(F.col("label")).alias("k"), "source_file").agg(F.min("id").alias("here"))
        far = nodes.groupBy(plain_label(F.col("label")).alias("k")).agg(F.min("id").alias("far"))
        out = out.withColumn("k", plain_label(F.col(end))).join(here, ["k", "source_file"], "left").join(far, "k", "left").withColumn(end, F.coalesce("here", "far")).drop("here", "far", "k")
    return out.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst", "relation", F.lit("AMBIGUOUS").alias("confidence"), F.lit(0.2).alias("confidence_score"), F.lit("llm").alias("evidence"), "source_file", "note").distinct()


def rename_communities(communities: DataFrame, names: DataFrame) -> DataFrame:
    return communities.join(names.select(F.col("community").alias("id"), F.substring("label", 1, NAME).alias("new")), "id", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def idea_score(confidence: Column, score: Column) -> Column:
    given = F.coalesce(score, F.lit(0.75))
    return F.when(confidence == "AMBIGUOUS", F.least(F.greatest(given, F.lit(0.1)), F.lit(0.3))).otherwise(quantize_confidence(F.least(F.greatest(given, F.lit(0.55)), F.lit(0.95))))


def concept_nodes(concepts: DataFrame) -> DataFrame:
    """Nodes of kind concept from (label, anchor_file, rationale, tags)."""
    slug = F.concat(F.lit("idea:"), normalize(F.col("label")))
    few = F.slice(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda c: F.substring(c, 1, CONCEPT_CHARS)), 1, CONCEPTS)
    return concepts.select(
        F.shiftrightunsigned(F.xxhash64(slug), 4).alias("id"), slug.alias("slug"), "label", F.lower("label").alias("norm_label"), F.lit("concept").alias("file_type"), F.col("anchor_file").alias("source_file"),
        F.lit("concept").alias("kind"), F.lit("semantic").alias("origin"), F.substring("rationale", 1, RATIONALE).alias("rationale"), few.alias("concepts"),
    ).dropDuplicates(["id"])


def by_label(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(k, id): labels to nodes; a concept is taken before a symbol, of symbols the least id."""
    old = nodes.where("kind <> 'concept'").groupBy(plain_label(F.col("label")).alias("k")).agg(F.min("id").alias("old"))
    new = concepts.groupBy(plain_label(F.col("label")).alias("k")).agg(F.min("id").alias("new"))
    return old.join(new, "k", "full_outer").select("k", F.coalesce("new", "old").alias("id"))


def idea_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (evidence llm-idea) of (src, dst, relation, confidence, confidence_score, why) between labels that are known."""
    a, b = labels.select(F.col("k").alias("ka"), F.col("id").alias("a")), labels.select(F.col("k").alias("kb"), F.col("id").alias("b"))
    hit = edges.join(a, plain_label(F.col("src")) == F.col("ka")).join(b, plain_label(F.col("dst")) == F.col("kb")).where("a <> b")
    allowed = ["semantically_similar_to", "conceptually_related_to", "rationale_for"]
    kind = F.when(F.col("confidence") == "AMBIGUOUS", "AMBIGUOUS").otherwise("INFERRED")
    return hit.where(F.col("relation").isin(*allowed)).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "relation", kind.alias("confidence"), idea_score(kind, F.col("confidence_score")).alias("confidence_score"), F.lit("idea").alias("context"), F.lit("llm-idea").alias("evidence"), F.substring("why", 1, 200).alias("note")
    ).distinct()


def hyperedges(groups: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(label, relation, members): groups (label, members, relation) of three known nodes or more, each once."""
    each = groups.select(F.substring("label", 1, 120).alias("label"), "relation", F.explode("members").alias("m"))
    found = each.join(labels, plain_label(F.col("m")) == F.col("k")).groupBy("label", "relation").agg(F.array_sort(F.collect_set("id")).alias("members"))
    return found.where(F.size("members") >= least)


def stale_files(files: DataFrame, fingerprint: str, last: str) -> DataFrame:
    """Files that the model must see: all if the prompt or model changed, else those whose text did."""
    return files.where(F.lit(fingerprint != last) | ~F.col("semantic_hash").eqNullSafe(F.col("content_sha256")))
