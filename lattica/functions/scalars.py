"""Scalar functions as Column builders; Python only where the JVM has no such function (Unicode normal forms)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import LADDER, SOURCE_SUFFIXES


def normalize_text(s: str | None) -> str | None:
    """Case-folded NFKC to a fixed point (six rounds at most), what is no word character to single underscores, none at the ends."""
    import re

    if s is None:
        return None
    for _ in range(6):
        t = unicodedata.normalize("NFKC", s.casefold())
        if t == s:
            break
        s = t
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", s)).strip("_")


def norm_label_text(s: str | None) -> str | None:
    """Lower case without diacritics and without what is not ASCII then."""
    return None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()


def _unicode(python, column: Column, ascii_form: Column) -> Column:
    """ascii_form where the text is ASCII; the Python function, batch by batch, elsewhere. A condition doesn't keep a row from Python, so ASCII texts are null there."""

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(python, na_action="ignore")

    udf = F.pandas_udf(apply, "string", F.PandasUDFType.SCALAR_ITER)
    plain = column.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, ascii_form).otherwise(udf(F.when(~plain, column)))


def normalize(column: Column) -> Column:
    return _unicode(normalize_text, column, normalize_ascii(column))


def normalize_ascii(column: Column) -> Column:
    words = F.regexp_replace(F.lower(column), r"[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_+|_+$", "")


def norm_label(column: Column) -> Column:
    return _unicode(norm_label_text, column, F.lower(column))


def make_slug(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", *[normalize_ascii(p) for p in parts]), r"^[_.]+|[_.]+$", "")


def file_stem(path: Column) -> Column:
    """The path without the last extension of its name."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def trigrams(column: Column) -> Column:
    """Distinct lower-case trigrams; a shorter text is its own only one, an empty one has none."""
    low = F.lower(column)
    n = F.length(low)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(low)).otherwise(many)


def tokens(column: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), 1)


def quantize_confidence(score: Column) -> Column:
    """The nearest rung of the ladder; of two as near, the lower."""
    return F.array_min(F.array(*[F.struct(F.round(F.abs(score - r), 9).alias("d"), F.lit(r).alias("r")) for r in LADDER]))["r"]


def infer_score(unique: Column, same_package: Column) -> Column:
    return F.when(unique & same_package, 0.95).when(unique, 0.85).when(same_package, 0.75).otherwise(0.65)


def location_start(loc: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(loc, r"^L(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("int")


def location_end(loc: Column) -> Column:
    end = F.try_to_number(F.nullif(F.regexp_extract(loc, r"-L(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("int")
    return F.coalesce(end, location_start(loc))


def module_stem(path: Column) -> Column:
    """Lower-case path without a source suffix and without a trailing package file."""
    suffix = "|".join(s.replace(".", r"\.") for s in SOURCE_SUFFIXES)
    return F.regexp_replace(F.regexp_replace(F.lower(path), rf"({suffix})$", ""), r"/(__init__|index|mod)$", "")


def path_suffixes(stem: Column) -> Column:
    """a/b/c -> [a/b/c, b/c, c]: makes `ends with /x or is x` an equality."""
    parts = F.split(stem, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / F.lit(float(half_life)))


def timestamp_label(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("int")
    h, m, r = (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def titleize(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, r"[_\-./]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.initcap(F.trim(F.regexp_replace(spaced, r"[()]+", "")))


def safe_name(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r"[^\w\- .]+", "_")), 1, 120)


def xml_escape(column: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(out, '"', "&quot;")


def json_string(column: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(column.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def json_object(column: Column) -> Column:
    """The JSON object in a model's reply: the body of a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(column, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(column, r"(?s)(\{.*\})", 1)), F.lit(""))


def is_git_url(column: Column) -> Column:
    return column.rlike(r"^(https?://|git@|ssh://|git://).+") & (column.rlike(r"\.git/?$") | column.rlike(r"^(git@|ssh://|git://)") | column.rlike(r"^https?://(github|gitlab|bitbucket)\.(com|org)/[^/]+/[^/]+/?$"))


def repo_slug(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(url), r"^(https?://|ssh://|git://|git@)", ""), r"(\.git)?/?$", ""), r"[^a-z0-9]+", "-")
