"""The file scan: noise, ignore patterns, secrets, kinds and digests."""

from __future__ import annotations

import fnmatch
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOISE_DIRS = (
    ".cache .git .gradle .hg .idea .lattica .mypy_cache .next .nox .nuxt .pytest_cache .ruff_cache .svelte-kit .svn .tox .venv .vscode .worktrees "
    "__pycache__ bin build coverage dist env lattica-out node_modules obj out site-packages target vendor venv .env"
).split()
SKIPPED = "Cargo.lock composer.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock yarn.lock .gitignore .latticaignore".split()
CODE = {
    "bash": "bash sh", "c": "c h", "cpp": "cc cpp cu cxx hh hpp", "csharp": "cs", "elixir": "ex exs", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "julia": "jl", "kotlin": "kt kts", "lua": "lua",
    "php": "php php3 php4 php5 phtml", "powershell": "ps1 psm1", "python": "py pyi", "r": "r", "ruby": "rake rb", "rust": "rs", "scala": "sc scala", "swift": "swift", "typescript": "cts mts ts tsx",
}
OTHER = {"document": "adoc md mdx rst txt", "paper": "tex", "image": "bmp gif jpeg jpg png svg tif tiff webp", "video": "avi m4v mkv mov mp4 webm", "audio": "aac flac m4a mp3 ogg opus wav wma"}
LANG_OF = {s: lang for lang, suffixes in CODE.items() for s in suffixes.split()}
TYPE_OF = {s: "code" for s in LANG_OF} | {s: kind for kind, suffixes in OTHER.items() for s in suffixes.split()}
KEY_DIRS = ".aws .azure .gcloud .gnupg .kube .ssh".split()
SECRET_DIRS = ".secrets credentials secrets".split()
SECRET_NAMES = [r"^\.envrc$", r"\.(cert|crt|der|jks|key|keystore|p12|p8|pem|pfx)$", r"^id_(dsa|ecdsa|ed25519|rsa)(\.pub)?$", r"^secring", r"^\.(boto|git-credentials|htpasswd|netrc|npmrc|pgpass|pypirc)$"]
ENV_NAME, ENV_SAMPLE = r"^\.env($|\.)", r"^\.env\.(dist|example|sample|template)"
SECRET_WORD = r"access[_-]?token|api[_-]?key|credential|passwd|password|private[_-]?key|secret|service[._-]?account"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


def file_type(path: Column) -> Column:
    return _lookup(TYPE_OF, suffix(path))


def language(path: Column) -> Column:
    return _lookup(LANG_OF, suffix(path))


def is_noise_path(path: Column) -> Column:
    """In a noise folder, or in a hidden one other than .github, or a lock or ignore file."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(dirs, lambda d: d.isin(*NOISE_DIRS) | (d.startswith(".") & (d != ".github") & (d != ".")))
    return hidden | F.element_at(parts, -1).isin(*SKIPPED)


def sensitive(path: Column) -> Column:
    """Why a file may hold secrets, or null: its folder, its name, or a telling word in the name of what is no code."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    name = F.lower(F.element_at(parts, -1))
    code = language(path).isNotNull()
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    pieces = F.split(stem, "[-_]")
    telling = F.element_at(pieces, -1).rlike(SECRET_WORD) | (F.size(pieces) <= 2)
    named = reduce(lambda a, b: a | b, [name.rlike(p) for p in SECRET_NAMES], name.rlike(ENV_NAME) & ~name.rlike(ENV_SAMPLE))
    return (
        F.when(F.exists(dirs, lambda d: d.isin(*KEY_DIRS)), "key folder")
        .when(F.exists(dirs, lambda d: d.isin(*SECRET_DIRS)) & ~code, "secret folder")
        .when(named, "secret name")
        .when(~code & name.rlike(SECRET_WORD) & telling, "secret word")
    )


def read_ignore(data: bytes) -> list[str]:
    """Patterns of an ignore file, in whichever of four encodings it is."""
    for encoding in ("utf-8-sig", "utf-16", "cp1252", "latin-1"):
        try:
            text = data.decode(encoding)
            break
        except (UnicodeDecodeError, UnicodeError):
            continue
    lines = (unicodedata.normalize("NFC", x.strip()) for x in text.splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the first pattern that matches it decides; ! negates. One chain of conditions, compiled once."""
    out = None
    for p in patterns:
        keep = p.startswith("!")
        p = p.removeprefix("!").strip("/")
        forms = [p, f"{p}/*", f"*/{p}", f"*/{p}/*"]
        regex = "|".join(fnmatch.translate(f).replace(r"\Z", "$").replace(r"\z", "$") for f in forms)
        base = fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")
        hit = path.rlike(f"^(?:{regex})") | F.element_at(F.split(path, "/"), -1).rlike(f"^(?:{base})")
        out = F.when(hit, not keep) if out is None else out.when(hit, not keep)
    return F.lit(False) if out is None else out.otherwise(False)


def catalogue(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """(path, content, file_type, lang, content_sha256) of what is indexed of files (path, content binary)."""
    kept = files.where(~is_noise_path(F.col("path")) & sensitive(F.col("path")).isNull() & ~ignored(F.col("path"), patterns or []))
    kept = kept.select("path", "content", file_type(F.col("path")).alias("file_type"), language(F.col("path")).alias("lang"), F.sha2("content", 256).alias("content_sha256"))
    return kept.where("file_type IS NOT NULL")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files under root, paths relative to it, in normal form NFC."""
    from pyspark.sql.functions import pandas_udf

    at = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    plain = re.escape(at.removeprefix("file://"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{plain}/", "")

    def nfc(batches):
        for s in batches:
            yield s.map(lambda x: unicodedata.normalize("NFC", x))

    udf = pandas_udf(nfc, "string", F.PandasUDFType.SCALAR_ITER)
    return raw.select(F.when(rel.rlike(r"^[\x00-\x7F]*$"), rel).otherwise(udf(rel)).alias("path"), "content", F.unix_timestamp("modificationTime").cast("double").alias("mtime"))


def git_head(root: str) -> str | None:
    """The commit that a work tree is at."""
    import os

    try:
        with open(os.path.join(root, ".git", "HEAD")) as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head
        ref = os.path.join(root, ".git", head[5:])
        if os.path.exists(ref):
            with open(ref) as f:
                return f.read().strip()
        with open(os.path.join(root, ".git", "packed-refs")) as f:
            return next((x.split()[0] for x in f if x.rstrip().endswith(head[5:])), None)
    except OSError:
        return None
