"""References and keyed lookup (F-01, F-04..F-07, F-11, F-18, F-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ref(ref: Column) -> Column:
    """F-04: (name, chapter, verse) of `Book C[:V]`, the name lower-cased; null where there is no chapter."""
    pattern = r"^\s*(.*?)\s*(\d+)(?::(\d+))?\s*$"
    part = lambda i: F.regexp_extract(ref, pattern, i)
    ok = F.regexp_like(ref, F.lit(r"^\s*\S.*?\s*\d+(?::\d+)?\s*$")) & (part(1) != "")
    return F.when(
        ok,
        F.struct(F.lower(part(1)).alias("name"), part(2).try_cast("int").alias("chapter"), F.nullif(part(3), F.lit("")).try_cast("int").alias("verse")),
    )


def name_index(books: DataFrame) -> DataFrame:
    """S-02: (key, n): each book by lower-cased name and short; a name wins over another book's short."""
    keys = books.select(F.explode(F.array(F.struct(F.lower("name").alias("key"), F.lit(0).alias("rank")), F.struct(F.lower("short").alias("key"), F.lit(1).alias("rank")))).alias("k"), "n")
    return keys.groupBy("k.key").agg(F.min(F.struct("k.rank", "n")).alias("m")).select("key", "m.n")


def resolve_refs(refs: DataFrame, books: DataFrame, ref_col: str = "ref") -> DataFrame:
    """F-04/F-05: rows with (n, chapter, verse); chapter and verse default to 1, n is null for unknown names."""
    parsed = refs.withColumn("_r", parse_ref(F.col(ref_col)))
    named = parsed.withColumn("_key", F.coalesce(F.col("_r.name"), F.lower(F.trim(F.col(ref_col)))))
    joined = named.join(name_index(books).withColumnsRenamed({"key": "_key"}), "_key", "left")
    return joined.select(*refs.columns, "n", F.coalesce("_r.chapter", F.lit(1)).alias("chapter"), F.coalesce("_r.verse", F.lit(1)).alias("verse"))


def read_refs(refs: DataFrame, books: DataFrame, verses: DataFrame, ref_col: str = "ref") -> DataFrame:
    """F-05: the verse of each reference; a known book without that verse gives a row without text."""
    found = resolve_refs(refs, books, ref_col)
    text = verses.select("n", "chapter", F.col("v").alias("verse"), "text")
    return found.join(text, ["n", "chapter", "verse"], "left")


def prefix_book(refs: DataFrame, books: DataFrame, ref_col: str = "ref") -> DataFrame:
    """F-06: the first book, in order, whose name equals or starts with the lower-cased text."""
    key = F.lower(F.trim(F.col("r." + ref_col)))
    hit = refs.alias("r").join(F.broadcast(books.alias("b")), F.startswith(F.lower("b.name"), key), "left")  # a catalogue has as many rows as a canon has books
    best = F.min_by("b.n", F.struct((F.lower("b.name") != key).cast("int"), F.col("b.n")))
    return hit.groupBy(F.col("r." + ref_col).alias(ref_col)).agg(best.alias("n"))


def jump(requests: DataFrame, books: DataFrame) -> DataFrame:
    """F-07: requests (book, chapter) by name, short or ordinal; the chapter is cut to the book's last; error is null, NO BOOK or CHAPTER?."""
    named = requests.withColumn("_key", F.lower(F.trim("book"))).join(name_index(books).select(F.col("key").alias("_key"), F.col("n").alias("_named")), "_key", "left")
    wanted = named.withColumn("n", F.coalesce("_named", F.col("book").try_cast("int")))
    last = books.select("n", F.col("chapters").alias("_last"))
    out = wanted.join(last, "n", "left")
    chapter = F.col("chapter").try_cast("int")
    error = F.when(F.col("_last").isNull(), "NO BOOK").when(chapter.isNull() | (chapter < 1), "CHAPTER?")
    return out.select("book", "chapter", F.when(error.isNull(), F.col("n")).alias("n"), F.when(error.isNull(), F.least(chapter, "_last")).alias("to_chapter"), error.alias("error"))


def chapter_payload(verses: DataFrame, books: DataFrame, n: int, chapter: int) -> DataFrame:
    """F-01/D-11: one chapter with its book's name and number of chapters; no row if it is absent."""
    own = verses.filter((F.col("n") == n) & (F.col("chapter") == chapter))
    rows = own.groupBy("n", "chapter").agg(F.array_sort(F.collect_list(F.struct("v", "text"))).alias("verses"))
    total = verses.filter(F.col("n") == n).agg(F.countDistinct("chapter").alias("total_chapters"))
    return rows.crossJoin(total).join(books.select("n", F.col("name").alias("book_name")), "n")


def slug_number(slugs: DataFrame, books: DataFrame, slug_col: str = "slug") -> DataFrame:
    """F-11: number of the book with exactly this short, 0 if none."""
    return slugs.join(books.select(F.col("short").alias(slug_col), F.col("n").alias("_n")), slug_col, "left").select(*slugs.columns, F.coalesce("_n", F.lit(0)).alias("n"))


def latest(kv: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """F-18/D-10: the last write of each key; combines before the shuffle."""
    rest = [c for c in kv.columns if c not in (key, order)]
    return kv.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def label(name: Column, chapter: Column, verse: Column, text: Column, width: int = 110) -> Column:
    """F-19: `Name C:V - text`, cut to `width` characters."""
    return F.substr(F.concat(name, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"), F.lit(" - "), text), F.lit(1), F.lit(width))
