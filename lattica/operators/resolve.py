"""Cross-file resolution of references: one declarative plan over raw references and definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import infer_score, module_stem, norm_label, path_suffixes
from ..plans.model import EDGE_KEY, FAN_IN, KINDS_OF, POPULAR
from .staging import written


def bare_name(column: Column) -> Column:
    return F.regexp_replace(norm_label(F.coalesce(column, F.lit(""))), r"^[.()]+|[.()]+$", "")


def definitions(nodes: DataFrame) -> DataFrame:
    """(def_id, kind, name, def_file, cls) of what a reference can mean."""
    return nodes.where(F.col("kind").isin("function", "method", "class")).select(
        F.col("id").alias("def_id"), "kind", bare_name(F.coalesce("norm_label", "label")).alias("name"), F.col("source_file").alias("def_file"), bare_name(F.col("cls")).alias("def_cls")
    )


def popular_names(refs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(name) of methods called without a known receiver type in fan_in files or more, and of names that are common everywhere."""
    calls = refs.where("relation = 'calls' AND is_method AND coalesce(recv_type, '') = ''").select("callee", "source_file").distinct()
    wide = calls.groupBy(bare_name(F.col("callee")).alias("name")).agg(F.countDistinct("source_file").alias("n")).where(F.col("n") >= fan_in).select("name")
    fixed = refs.sparkSession.createDataFrame([(w,) for w in POPULAR], "name string")
    return wide.union(fixed).distinct()


def module_files(nodes: DataFrame) -> DataFrame:
    """(want, def_file): every path suffix by which a file can be imported; turns `ends with` into an equality."""
    files = nodes.where("source_file IS NOT NULL").select(F.col("source_file").alias("def_file")).distinct()
    return files.select("def_file", F.explode(path_suffixes(module_stem(F.col("def_file")))).alias("want")).distinct()


#: What decides what a reference means; the caller only can't mean itself.
ASKS = ["callee", "relation", "source_file", "import_evidence", "is_method", "recv_type", "import_module", "import_symbol"]
#: Kinds of evidence, least first, as equal scores choose among them.
EVIDENCE = ["xfile-import", "xfile-infer", "xfile-recv"]


def resolve(refs: DataFrame, nodes: DataFrame, resolve_imports: bool = False) -> DataFrame:
    """Edges that the references mean, where exactly one definition in another file is left: src, dst, relation, confidence, confidence_score, context, source_file, source_location, evidence.

    References that ask the same (ASKS) are answered once; equal references give one edge. An imported module narrows the
    candidates to its files; a module that no file matches is external and drops the reference. A method call with a known
    receiver class must find it there; a popular name needs an import that names it.
    """
    asked = refs.where("relation <> 'imports' AND source_file IS NOT NULL").select(*ASKS).distinct()
    wanted = asked.withColumns({"callee_name": bare_name(F.col("callee")), "lookup": F.when(F.coalesce("import_symbol", F.lit("")) != "", bare_name(F.col("import_symbol"))).otherwise(bare_name(F.col("callee")))})
    wanted = wanted.where("callee_name <> ''")
    kinds = {r: k for r, k in KINDS_OF.items()}
    allowed = F.create_map(*[x for r, k in kinds.items() for x in (F.lit(r), F.array(*map(F.lit, k)))])
    wanted = wanted.withColumn("kinds", F.coalesce(F.try_element_at(allowed, "relation"), F.array(*map(F.lit, KINDS_OF["calls"]))))
    want = F.regexp_replace(F.lower(F.coalesce("import_module", F.lit(""))), "^/+|/+$", "")
    wanted = wanted.withColumn("want", want)
    popular = popular_names(refs).withColumnRenamed("name", "callee_name").withColumn("popular", F.lit(True))
    call = F.col("relation") == "calls"
    typed = F.coalesce("is_method", F.lit(False)) & (F.coalesce("recv_type", F.lit("")) != "") & call
    wanted = wanted.withColumns({"recv_match": typed, "recv": F.when(typed, bare_name(F.col("recv_type")))})
    # A popular name that nothing pins can't be resolved: it goes before the join, where it would meet every definition of that name.
    hopeless = call & ~F.col("recv_match") & F.coalesce("popular", F.lit(False)) & (F.col("want") == "") & ~F.coalesce("import_evidence", F.lit(False))
    wanted = wanted.join(popular, "callee_name", "left").where(~hopeless)

    # Nor can a name that nothing narrows down and that two other files define: definitions are counted by name first.
    defs = written(definitions(nodes), "definitions")
    meant = F.explode(F.array(*[F.when(F.col("kind").isin(*k), F.array(*map(F.lit, k))) for k in sorted(set(map(tuple, kinds.values())))]))
    by_kinds = defs.select("def_id", F.col("name").alias("lookup"), F.col("def_file").alias("source_file"), meant.alias("kinds")).where("kinds IS NOT NULL")
    total = by_kinds.groupBy("lookup", "kinds").agg(F.countDistinct("def_id").alias("total"))
    own = by_kinds.groupBy("lookup", "kinds", "source_file").agg(F.countDistinct("def_id").alias("own"))
    wanted = wanted.join(total, ["lookup", "kinds"]).join(own, ["lookup", "kinds", "source_file"], "left")
    wanted = wanted.where(F.col("recv_match") | (F.col("want") != "") | (F.col("total") - F.coalesce("own", F.lit(0)) <= 1)).drop("own")

    ref = Window.partitionBy(*ASKS)
    away = wanted.join(defs, (F.col("lookup") == F.col("name")) & F.array_contains("kinds", F.col("kind"))).where("def_file <> source_file")

    suffixes = module_files(nodes)
    known = suffixes.select("want").distinct().withColumn("known", F.lit(True))
    match = suffixes.withColumn("in_module", F.lit(True))
    away = away.join(match, ["want", "def_file"], "left").join(known, "want", "left")
    away = away.withColumn("n_module", F.sum(F.coalesce("in_module", F.lit(False)).cast("int")).over(ref))
    has = F.col("want") != ""
    away = away.where(~has | F.col("known")).where(~has | (F.col("n_module") == 0) | F.col("in_module"))
    away = away.withColumn("mod_match", has & (F.col("n_module") == 1))

    away = away.where(~F.col("recv_match") | (F.col("def_cls") == F.col("recv")))
    evident = F.col("mod_match") | F.coalesce("import_evidence", F.lit(False))
    away = away.where(~(call & ~F.col("recv_match") & F.coalesce("popular", F.lit(False)) & ~evident))

    one = away.withColumn("left", F.size(F.collect_set("def_id").over(ref))).where("`left` = 1")
    same_root = F.split("source_file", "/")[0] == F.split("def_file", "/")[0]
    unique = F.col("total") == 1
    sure = F.when(~call | evident, "EXTRACTED").when(F.col("recv_match") & unique & same_root, "EXTRACTED").otherwise("INFERRED")
    score = F.when(sure == "EXTRACTED", 1.0).when(F.col("recv_match"), 0.85).when(F.coalesce("is_method", F.lit(False)), 0.65).otherwise(infer_score(unique, same_root))
    evidence = F.when(~call | evident, "xfile-import").when(F.col("recv_match"), "xfile-recv").otherwise("xfile-infer")
    # The better of two edges has the higher score, then the later evidence: one number, so that edges are told apart by hash. Only sure ones score 1.
    worth = F.round(score * 1_000_000).cast("long") * len(EVIDENCE) + F.array_position(F.array(*map(F.lit, EVIDENCE)), evidence) - 1
    answers = one.select(*[F.col(c).alias("q_" + c) for c in ASKS], F.col("def_id").alias("dst"), worth.alias("worth")).groupBy(*["q_" + c for c in ASKS], "dst").agg(F.max("worth").alias("worth"))
    same = [refs[c].eqNullSafe(answers["q_" + c]) for c in ASKS]
    out = refs.join(answers, same).where("dst <> caller_id").select(F.col("caller_id").alias("src"), "dst", "relation", "source_file", "source_location", "worth")
    if resolve_imports:
        out = out.unionByName(resolve_modules(refs, nodes).withColumn("worth", F.lit(1_000_000 * len(EVIDENCE)).cast("long")).select(*out.columns))
    context = F.when(call, "call").when(F.col("relation") == "imports", "import").otherwise("type")
    points = F.floor(F.col("worth") / len(EVIDENCE))
    return out.groupBy(*EDGE_KEY).agg(F.max("worth").alias("worth")).select(
        "src", "dst", "relation", F.when(points == 1_000_000, "EXTRACTED").otherwise("INFERRED").alias("confidence"), (points / 1_000_000).alias("confidence_score"), context.alias("context"),
        "source_file", "source_location", F.element_at(F.array(*map(F.lit, EVIDENCE)), (F.col("worth") % len(EVIDENCE) + 1).cast("int")).alias("evidence"),
    )


def resolve_modules(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`imports` edges from file to file, where an import's module names exactly one other file."""
    found = refs.where("relation = 'imports'").select("caller_id", "source_file", "source_location", F.lower(F.regexp_replace(F.coalesce("import_module", "callee"), r"\.", "/")).alias("want"))
    files = nodes.where("kind = 'file'").select(F.col("id").alias("dst"), F.col("source_file").alias("def_file"))
    hit = found.join(module_files(nodes), "want").join(files, "def_file").where("def_file <> source_file")
    hit = hit.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("caller_id", "source_location", "want"))).where("n = 1")
    return hit.select(F.col("caller_id").alias("src"), "dst", F.lit("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("import").alias("context"), "source_file", "source_location", F.lit("xfile-import").alias("evidence")).distinct()
