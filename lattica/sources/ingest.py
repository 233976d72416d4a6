"""Outside sources as Markdown in the corpus. Nothing is fetched here: raw pages, feeds, blocks and converters are passed in."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize, repo_slug
from .text import arxiv_to_markdown, html_to_text, source_kind

PLAIN = ["md", "rst", "txt"]
#: What turns a file of a kind into text on standard output, if it is installed; {} is the file.
CONVERTERS = {"pdf": ["pdftotext", "-layout", "{}", "-"], **dict.fromkeys("docx epub html odt pptx rtf".split(), ["pandoc", "-t", "gfm", "{}"])}


def confluence_to_markdown(pages: DataFrame) -> DataFrame:
    """(source, text) of REST answers (source, json): the title, and the storage format read as a page."""
    r = F.from_json("json", "title string, body struct<storage: struct<value: string>>")
    return pages.select("source", r.alias("r")).select("source", F.concat(F.lit("# "), "r.title", F.lit("\n\n"), html_to_text(F.col("r.body.storage.value"))).alias("text"))


def to_markdown(raw: DataFrame) -> DataFrame:
    """(source, kind, text) of fetched sources (source, body): papers and pages are converted, files are text already."""
    kind = source_kind(F.col("source"))
    text = F.when(kind == "arxiv", arxiv_to_markdown(F.col("body"))).when(kind.isin("web", "confluence"), html_to_text(F.col("body"))).otherwise(F.col("body"))
    return raw.select("source", kind.alias("kind"), text.alias("text"))


def converted(files: DataFrame, convert: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(path, text) of files (path, content): plain text as it is, others through a converter that is installed, or the one given; without one a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, (convert or _convert)(p, bytes(c))) for p, c in zip(b["path"], b["content"])], columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def _convert(path: str, content: bytes) -> str:
    import tempfile

    ext = path.rsplit(".", 1)[-1].lower()
    if ext in PLAIN:
        return content.decode("utf-8", "replace")
    command = CONVERTERS.get(ext)
    if command is None or shutil.which(command[0]) is None:
        return f"# {path}\n\nNo converter for .{ext} is installed."
    with tempfile.NamedTemporaryFile(suffix=f".{ext}") as f:
        f.write(content)
        f.flush()
        return subprocess.run([x.format(f.name) for x in command], capture_output=True, timeout=120, check=False).stdout.decode("utf-8", "replace")


def as_corpus(texts: DataFrame) -> DataFrame:
    """(path, content) of (source, text): each source is a document sources/<slug>.md."""
    return texts.select(F.concat(F.lit("sources/"), F.substring(normalize(F.col("source")), 1, 120), F.lit(".md")).alias("path"), F.encode("text", "utf-8").alias("content"))


def clone(url: str, folder: str, branch: str | None = None) -> str:
    """A shallow clone of a repository in a cache folder by its slug; what is there already is taken."""
    import re

    slug = re.sub(r"[^a-z0-9]+", "-", re.sub(r"(\.git)?/?$", "", re.sub(r"^(https?://|ssh://|git://|git@)", "", url.lower())))
    at = os.path.join(folder, slug)
    if not os.path.isdir(os.path.join(at, ".git")):
        subprocess.run(["git", "clone", "--depth", "1", *(["--branch", branch] if branch else []), url, at], check=True, timeout=600)
    return at


__all__ = ["as_corpus", "clone", "confluence_to_markdown", "converted", "repo_slug", "to_markdown"]
