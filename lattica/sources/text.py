"""Documents: headings and their nesting, web pages, papers, notes and wiki pages as Markdown, transcripts as sections."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import file_stem, make_slug, timestamp_label


def headings(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, level, title, n_lines): # headings in every format; underlined ones in rst (level 1) and, as = or -, in others; = in adoc. Fenced code is not left out."""
    lines = docs.select(F.col(path).alias("path"), F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n").alias("l")).select("path", F.size("l").alias("n_lines"), F.posexplode("l").alias("p", "text"))
    by = Window.partitionBy("path").orderBy("p")
    rows = lines.withColumn("before", F.lag("text").over(by))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    atx = F.regexp_extract("text", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 1)
    adoc = F.when(ext == "adoc", F.regexp_extract("text", r"^(={1,6})\s+(.+?)\s*$", 1)).otherwise("")
    under = F.col("before").isNotNull() & (F.trim("before") != "")
    rst = ext.isin("rst", "rest") & under & F.col("text").rlike(r"^([=\-~^\"'`*+#])\1{2,}\s*$") & ~F.col("before").rlike(r"^[=\-~^\"'`*+#]{3,}\s*$")
    setext = ~ext.isin("rst", "rest", "adoc") & under & ~F.col("before").rlike(r"^#") & F.col("text").rlike(r"^(=+|-{2,})\s*$")
    level = F.when(atx != "", F.length(atx)).when(adoc != "", F.length(adoc)).when(rst, 1).when(setext, F.when(F.col("text").startswith("="), 1).otherwise(2))
    title = F.when(atx != "", F.regexp_extract("text", r"^(#{1,6})\s+(.*?)\s*#*\s*$", 2)).when(adoc != "", F.regexp_extract("text", r"^(={1,6})\s+(.+?)\s*$", 2)).otherwise(F.trim("before"))
    line = F.when((atx != "") | (adoc != ""), F.col("p") + 1).otherwise(F.col("p"))
    return rows.select("path", line.alias("line"), level.cast("int").alias("level"), title.alias("title"), "n_lines").where("level IS NOT NULL")


def sections(found: DataFrame) -> DataFrame:
    """(path, line, level, title, end, parent, slug, label): each heading's lines up to the next one, and the line of the nearest earlier heading of lower level (null: the file).

    The parent is the previous smaller element: for each level below, the last heading that had it, so six windows and no
    stack.
    """
    by = Window.partitionBy("path").orderBy("line", "level")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.lead("line").over(by) - 1, F.col("n_lines"))
    last = [F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(before) for k in range(1, 7)]
    parent = F.array_max(F.array(*[F.when(F.col("level") > k, last[k - 1]) for k in range(1, 7)]))
    out = found.withColumns({"end": end, "parent": parent})
    bare = F.when(F.trim("title") == "", F.concat(F.lit("section"), "line")).otherwise(F.col("title"))
    base = make_slug(file_stem(F.col("path")), bare)
    again = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) > 1
    out = out.withColumn("base", base).withColumn("slug", F.when(again, F.concat("base", F.lit("_l"), "line")).otherwise(F.col("base")))
    label = F.when(F.trim("title") == "", F.concat(F.lit("§"), "line")).otherwise(F.col("title"))
    return out.select("path", "line", "level", "title", F.col("end").cast("int").alias("end"), "parent", "slug", label.alias("label"))


#: What html.unescape takes for a character reference, each by itself.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescaped(column: Column) -> Column:
    """Character references resolved: the five common ones in the JVM; of texts with others, Python gets each distinct reference, never the text."""

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda found: [html.unescape(x) for x in found], na_action="ignore")

    once = lambda value, f: F.transform(F.array(value), f)[0]
    rare = lambda t: t.rlike(r"&(?!lt;|gt;|quot;|#39;|amp;)#?\w+;?|&amp;#?\w+;")
    each = lambda t: F.regexp_extract_all(t, F.lit(_REFERENCE), 0)
    distinct = once(column, lambda t: F.when(rare(t), F.array_distinct(each(t))))
    resolved = F.pandas_udf(apply, "array<string>", F.PandasUDFType.SCALAR_ITER)(distinct)

    def put(x: Column) -> Column:
        t, known = x["text"], x["resolved"]
        plain = t
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(a), F.lit(b))
        found = once(F.map_from_arrays(F.array_distinct(each(t)), known), lambda m: F.transform(each(t), lambda r: F.element_at(m, r)))
        whole = F.array_join(F.zip_with(F.split(t, _REFERENCE, -1), F.concat(found, F.array(F.lit(""))), lambda between, r: F.concat(between, r)), "")
        return F.when(known.isNotNull(), whole).otherwise(plain)

    return once(F.struct(column.alias("text"), resolved.alias("resolved")), put)  # Python can't be called inside a lambda, its results can be used there


def page_title(raw: Column) -> Column:
    return F.trim(F.regexp_extract(raw, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text(raw: Column) -> Column:
    """A page as Markdown: its title as heading, no scripts and styles, tags as line ends, blanks and empty lines collapsed."""
    body = F.regexp_replace(raw, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<title[^>]*>.*?</title>", "")
    text = unescaped(F.regexp_replace(body, r"(?s)<[^>]+>", "\n"))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    title = page_title(raw)
    return F.concat(F.when(title != "", F.concat(F.lit("# "), unescaped(title), F.lit("\n\n"))).otherwise(""), F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))


def source_kind(source: Column) -> Column:
    """Which reader a source needs: a repository, arXiv, Notion, Confluence, a web page, or a file."""
    return (
        F.when(source.rlike(r"^(arxiv:|https?://arxiv\.org/)"), "arxiv")
        .when(source.rlike(r"^(notion:|https?://([\w-]+\.)?notion\.(so|site)/)"), "notion")
        .when(source.rlike(r"^(confluence:|https?://[^/]+/wiki/)"), "confluence")
        .when(source.rlike(r"^(git@|ssh://|git://)|\.git/?$"), "git")
        .when(source.rlike(r"^https?://"), "web")
        .otherwise("file")
    )


def arxiv_to_markdown(xml: Column) -> Column:
    """Title, authors and abstract of an Atom entry."""
    entry = F.regexp_extract(xml, r"(?s)<entry>(.*?)</entry>", 1)
    line = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(entry, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    authors = F.array_join(F.regexp_extract_all(entry, F.lit(r"(?s)<name>(.*?)</name>"), 1), ", ")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), unescaped(line("title"))), F.concat(F.lit("Authors: "), unescaped(authors)), F.concat(F.lit("## Abstract\n\n"), unescaped(line("summary"))))


_NOTION = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "to_do": "- [ ] ", "quote": "> "}


def notion_to_markdown(blocks: DataFrame, max_depth: int = 4) -> DataFrame:
    """(page, text) of blocks (page, id, parent, place, type, text): children after their block, indented, down to max_depth."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _NOTION.items() for x in kv]), "type"), F.lit(""))
    b = blocks.withColumn("line", F.concat(prefix, F.coalesce("text", F.lit("")))).withColumn("key", F.lpad(F.col("place").cast("string"), 8, "0"))
    level = b.where("parent IS NULL").select("page", "id", "line", "key")
    out = level
    for depth in range(1, max_depth):
        child = b.select("page", F.col("id").alias("c"), F.col("parent").alias("id"), F.col("line").alias("l"), F.col("key").alias("k"))
        level = child.join(level, ["page", "id"]).select("page", F.col("c").alias("id"), F.concat(F.lit("  " * depth), "l").alias("line"), F.concat("key", F.lit("/"), "k").alias("key"))
        out = out.unionByName(level)
    return out.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n").alias("text"))


def transcript_blocks(segments: DataFrame, seconds: float = 120.0) -> DataFrame:
    """(name, start, heading, text) of segments (name, start, text): blocks of about `seconds`, each from its own first segment on. A block's start depends on the one before, so it is a fold over the sorted segments."""
    lists = segments.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), "text"))).alias("s"))
    kind = "array<struct<start:double,text:string>>"

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.concat_ws(" ", last["text"], F.trim(x["text"])).alias("text"))))
        fresh = F.concat(acc, F.array(F.struct(x["start"].alias("start"), F.trim(x["text"]).alias("text"))))
        return F.when((F.size(acc) > 0) & (x["start"] - F.try_element_at(acc, F.lit(-1))["start"] < seconds), joined).otherwise(fresh)

    def safe(acc, x):
        return F.when(F.size(acc) == 0, F.array(F.struct(x["start"].alias("start"), F.trim(x["text"]).alias("text")))).otherwise(add(acc, x))

    blocks = lists.select("name", F.explode(F.aggregate("s", F.array().cast(kind), lambda a, x: safe(a, x).cast(kind))).alias("b"))
    return blocks.select("name", "b.start", F.concat(F.lit("## "), timestamp_label(F.col("b.start"))).alias("heading"), "b.text")


def transcripts(files: DataFrame, transcribe=None) -> DataFrame:
    """(path, text) of media files: what the callable hears, where there is one; else a note that says so."""
    if transcribe is None:
        return files.select("path", F.concat(F.lit("# "), "path", F.lit("\n\nNo transcriber is set.")).alias("text"))

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, float(s), t) for s, t in transcribe(p, c)], columns=["name", "start", "text"])

    heard = files.select("path", "content").mapInPandas(run, "name string, start double, text string")
    blocks = transcript_blocks(heard).withColumn("part", F.concat_ws("\n", "heading", "text"))
    return blocks.groupBy(F.col("name").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
