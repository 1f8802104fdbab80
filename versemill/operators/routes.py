"""Addresses to pages (F-12..F-15, F-20, D-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_segment(path: Column) -> Column:
    """F-12: up to the first slash."""
    return F.substring_index(path, "/", 1)


def split_parts(text: Column, mark: str) -> Column:
    """F-12: parts between marks, without a trailing empty one."""
    parts = F.split(text, F.regexp_replace(F.lit(mark), r"([\\{}|()\[\].*+?^$])", r"\\$1"))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def language_of(path: Column, codes: list[str], default: str) -> Column:
    """F-14: the first segment where it is a known code."""
    seg = F.regexp_extract(path, "^/([^/]*)", 1)
    return F.when(seg.isin(*codes), seg).otherwise(F.lit(default))


def strip_language(path: Column, codes: list[str]) -> Column:
    """F-14: the path without a known language segment."""
    seg = F.regexp_extract(path, "^/([^/]*)", 1)
    return F.when(seg.isin(*codes), F.substr(path, F.length(seg) + 2)).otherwise(path)


def _int(text: Column) -> Column:
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"^-?[0-9]{1,9}$")), text.try_cast("int")), F.lit(0))


def parse_route(path: Column, codes: list[str], default: str = "en") -> Column:
    """F-13/D-19: (lang, kind, short, chapter, page) of a path; kinds are about, lang, books, b, r and home.

    Numbers that aren't numbers are 0. `/books` holds for any longer path, `/r` needs a colon and a chapter over 0.
    """
    rest = strip_language(path, codes)
    part = lambda p: F.regexp_extract(rest, p, 1)
    chapter = _int(part("^/r/[^/]+/([^:]*):"))
    kind = (
        F.when(rest == "/about", "about")
        .when(rest == "/lang", "lang")
        .when(F.regexp_like(rest, F.lit("^/b/[^/]+")), "b")
        .when(F.regexp_like(rest, F.lit("^/r/[^/]+/")) & (chapter > 0), "r")
        .when(F.startswith(rest, F.lit("/books")), "books")
        .otherwise("home")
    )
    page = F.when(kind == "b", _int(part("^/b/[^/]+/(.*)$"))).when(kind == "r", _int(part("^/r/[^:]*:(.*)$"))).when(kind == "books", _int(part("^/books/(.*)$")))
    return F.struct(
        language_of(path, codes, default).alias("lang"),
        kind.alias("kind"),
        F.when(kind.isin("b", "r"), F.regexp_extract(rest, "^/[br]/([^/]+)", 1)).alias("short"),
        F.when(kind == "r", chapter).alias("chapter"),
        page.alias("page"),
    )


def ui_string(ui: DataFrame, requests: DataFrame, default: str = "en") -> DataFrame:
    """F-15: value of (lang, key); the default language's where the language lacks the key."""
    own = ui.select("lang", "key", F.col("value").alias("_own"))
    base = ui.filter(F.col("lang") == default).select("key", F.col("value").alias("_base"))
    return requests.join(own, ["lang", "key"], "left").join(base, "key", "left").select(*requests.columns, F.coalesce("_own", "_base").alias("value"))


def picker(ui: DataFrame) -> DataFrame:
    """F-20: languages in declared order as `endonym (english name)`."""
    by = ui.groupBy("lang").agg(
        F.min("lang_pos").alias("pos"), F.max(F.when(F.col("key") == "endonym", F.col("value"))).alias("endonym"), F.max(F.when(F.col("key") == "english", F.col("value"))).alias("english")
    )
    return by.select("pos", "lang", F.format_string("%s (%s)", "endonym", "english").alias("label")).orderBy("pos")


def key_numbers(ui: DataFrame, wanted: DataFrame) -> DataFrame:
    """F-22: position of each wanted key; unknown keys come with null, for the caller to reject."""
    return wanted.join(ui.select("key", "pos").distinct(), "key", "left")
