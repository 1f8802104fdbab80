"""Release gates (C-29, F-17, J-09, J-10, P-07..P-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import fixed
from versemill.functions import text as T


def line_problems(line: Column, network: Column | None = None) -> Column:
    """C-29: kinds of online references in a line: url, host:<name> and, where `network` holds, api."""
    low = F.lower(line)
    kinds = [F.when(F.regexp_like(line, F.lit("(?i)https?://")), "url")]
    kinds += [F.when(F.contains(low, F.lit(h.lower())), F.lit(f"host:{h}")) for h in fixed.ONLINE_HOSTS]
    api = F.regexp_like(line, F.lit(fixed.NETWORK_CALLS))
    kinds.append(F.when(api if network is None else api & network, "api"))
    return F.array_compact(F.array(*kinds))


def offline_gate(lines: DataFrame) -> DataFrame:
    """P-07: (file, lineno, kind, line) of each online reference in rows (file, lineno, line)."""
    hits = lines.withColumn("kinds", line_problems(F.col("line"))).filter(F.size("kinds") > 0)
    return hits.select("file", "lineno", F.explode("kinds").alias("kind"), F.substring(F.trim("line"), 1, 70).alias("line"))


def slug_gate(books: DataFrame, canon: DataFrame) -> DataFrame:
    """J-09: rows (edition, short, problem): by position for editions as large as the canon, as sets for smaller ones."""
    size = books.groupBy("edition").agg(F.count("*").alias("k"))
    total = canon.agg(F.count("*").alias("t"))
    sized = books.join(size, "edition").crossJoin(F.broadcast(total))  # one row of one number
    shape = sized.filter(~F.coalesce(F.regexp_like("short", F.lit("^[A-Za-z0-9]{1,12}$")), F.lit(False))).select("edition", "short", F.lit("shape").alias("problem"))
    full = sized.filter("k >= t").join(canon.select("n", F.col("short").alias("_s")), "n", "left")
    moved = full.filter(~F.col("short").eqNullSafe(F.col("_s"))).select("edition", "short", F.lit("position").alias("problem"))
    strange = sized.filter("k < t").join(canon.select("short"), "short", "left_anti").select("edition", "short", F.lit("unknown").alias("problem"))
    return shape.unionByName(moved).unionByName(strange)


def cross_tree(declared: DataFrame, cases: DataFrame, modules: DataFrame, imported: DataFrame) -> DataFrame:
    """J-10/P-08: rows (lang, problem): editions whose declared chapters, emitted cases and modules don't agree, or that nobody imports."""
    emitted = cases.groupBy("lang").agg(F.count("*").alias("cases"))
    files = modules.groupBy("lang").agg(F.countDistinct("file").alias("modules"))
    both = declared.join(emitted, "lang", "full_outer").join(files, "lang", "full_outer").join(imported.select("lang").distinct().withColumn("_i", F.lit(True)), "lang", "left")
    problem = F.array_compact(
        F.array(
            F.when(~F.col("chapters").cast("long").eqNullSafe(F.col("cases")), "cases"),
            F.when(~F.col("books").cast("long").eqNullSafe(F.col("modules")), "modules"),
            F.when(F.col("_i").isNull(), "import"),
        )
    )
    return both.select("lang", F.explode(problem).alias("problem"))


def missing_keys(ui: DataFrame, key: str = "key") -> DataFrame:
    """P-09: (lang, key) that a language lacks; an empty text is no gap. Languages and keys are both catalogues."""
    langs, keys = ui.select("lang").distinct(), ui.select(key).distinct()
    return langs.crossJoin(keys).join(ui.select("lang", key), ["lang", key], "left_anti")


def unknown_codes(spark, wanted: list[str], known: DataFrame) -> DataFrame:
    """F-17: wanted codes that no source has."""
    return spark.createDataFrame([(x,) for x in wanted], "code string").join(known.select("code"), "code", "left_anti")


def bad_flags(tags: DataFrame) -> DataFrame:
    """P-07: release tags and version flags of another shape."""
    ok = F.regexp_like("tag", F.lit(r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:-[A-Za-z0-9.]+)?$"))
    return tags.filter(~F.coalesce(ok, F.lit(False)))


def has_forbidden(verses: DataFrame) -> DataFrame:
    """Verses that a literal can't hold."""
    return verses.filter(T.forbidden(F.col("text")))
