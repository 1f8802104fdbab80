"""Operators that need spans, catalogues, registries or event streams, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.catalog import query
from versemill.functions import fixed
from versemill.functions import text as T
from versemill.functions import unicode as U
from versemill.operators import align, render, routes
from versemill.plans import gates, verify
from versemill.queries.study import CARDS, _NOTES, grade_events, note_events, six
from versemill.session import shared_dir, table
from versemill.sources import books as B
from versemill.sources import dialects
from versemill.streaming import incremental


@query(
    "red_verses",
    """SELECT lang, count(*) FILTER (red) AS red_verses, count(*) FILTER (red) > 0 AS legend FROM (SELECT lang, len(string_split(text, chr(10))) >= 3 AND lang <> 'es' AS red FROM documents) GROUP BY lang""",
)
def red_verses(spark, sf_dir):
    """Lines of a document as spans, every third one highlighted, in all languages but one."""
    span = lambda line, i: F.struct(line.alias("t"), ((i % 3 == 2) & (F.col("lang") != "es")).alias("r"))
    return render.red_verses(table(spark, sf_dir, "documents").select("lang", F.transform(F.split("text", "\n"), span).alias("segs")), ["lang"])


@query("empty_verses", r"SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN '   ' ELSE text END AS text FROM conversations) WHERE trim(regexp_replace(text, '\s+', '', 'g')) = ''")
def empty_verses(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "   ").otherwise(F.col("text")).alias("text"))
    return render.empty_verses(rows).select("conv_id", "turn")


@query(
    "usfm_clean",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g')) || ' ' || p_brand END AS text FROM part""",
)
def usfm_clean(spark, sf_dir):
    """Markers around added words and attributes behind words; a lone backslash rejects the verse."""
    k = F.col("p_partkey") % 5
    raw = F.concat(F.lit("\\add "), "p_name", F.lit("\\add*  "), "p_type", F.when(k == 1, "|strong=7").otherwise(""), F.lit(" \\nd "), "p_brand", F.lit("\\nd*"), F.when(k == 4, " \\ ").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.usfm_clean(raw).alias("text"))


@query(
    "literal_modules",
    r"""WITH l AS (SELECT conv_id, turn, replace(replace(min(text), '\', '\\'), '"', '\"') AS t FROM conversations GROUP BY conv_id, turn)
    SELECT conv_id, 'switch chapter {' || chr(10) || string_agg('    case ' || turn::VARCHAR || ': return s"1{|}' || replace(t, chr(10), '{~}') || '";', chr(10) ORDER BY turn) || chr(10) || '};' AS module FROM l GROUP BY conv_id""",
)
def literal_modules(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("chapter")).agg(F.min("text").alias("text"))
    verses = turns.select("conv_id", "chapter", F.lit(1).alias("v"), F.split("text", "\n").alias("lines"))
    return B.literal_modules(render.encode_chapters(verses, ["conv_id", "chapter"]), "conv_id")


@query(
    "provenance",
    """WITH v AS (SELECT DISTINCT lang AS code, lang || '.xml' AS f FROM documents), r AS (SELECT lang, source, 'raw/' || CASE WHEN source = 'src3' THEN 'other' ELSE lang END || '.xml' AS s FROM documents)
    SELECT r.lang AS edition, count(*) AS count FROM r JOIN v ON code = lang WHERE string_split(s, '/')[-1] <> f GROUP BY r.lang""",
)
def provenance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vetted = docs.select(F.col("lang").alias("code"), F.concat(F.lit("x/"), "lang", F.lit(".xml")).alias("file")).distinct()
    said = F.concat(F.lit("raw/"), F.when(F.col("source") == "src3", "other").otherwise(F.col("lang")), F.lit(".xml"))
    report = docs.select(F.col("lang").alias("edition"), "lang", said.alias("source"))
    return verify.check_provenance(report, vetted).select("edition", "count")


@query("picker", "SELECT pos, lang, upper(lang) || ' (' || lang || ')' AS label FROM (SELECT lang, min(doc_id) AS pos FROM documents GROUP BY lang)")
def picker(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("lang_pos"))
    names = F.explode(F.array(F.struct(F.lit("endonym").alias("key"), F.upper("lang").alias("value")), F.struct(F.lit("english").alias("key"), F.col("lang").alias("value")))).alias("x")
    return routes.picker(langs.select("lang", "lang_pos", names).select("lang", "lang_pos", "x.key", "x.value"))


@query("ui_key_numbers", "SELECT s.key, k.pos FROM (SELECT DISTINCT source AS key FROM documents) s LEFT JOIN (SELECT 'src' || n_nationkey::VARCHAR AS key, n_nationkey AS pos FROM nation WHERE n_nationkey % 2 = 0) k ON s.key = k.key")
def ui_key_numbers(spark, sf_dir):
    ui = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").alias("pos"))
    return routes.key_numbers(ui, table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct())


@query("report_json", """SELECT lang, '{"lang":"' || lang || '","verses":' || count(*)::VARCHAR || '}' AS json FROM documents GROUP BY lang""")
def report_json(spark, sf_dir):
    report = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("verses"))
    return B.report_json(report).select(F.get_json_object("json", "$.lang").alias("lang"), "json")


@query(
    "absent_per_book",
    """WITH b AS (SELECT DISTINCT source, doc_id FROM documents WHERE doc_id % 6 <> 0) SELECT d.lang AS edition, d.source AS usfm, count(*) AS absent FROM documents d WHERE doc_id % 6 = 0 GROUP BY ALL""",
)
def absent_per_book(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("edition"), F.col("source").alias("usfm"), F.lit(1).alias("chapter"), F.col("doc_id").alias("v"), F.lit(0).alias("pos"), "text")
    return verify.absent_per_book(align.roundtrip(rows.filter("v % 6 <> 0"), rows, ["edition"]))


_OPENINGS = [*fixed.OPENINGS.values(), ["the", "of", "in"], ["der", "die", "und"], ["que", "de", "la"], ["le", "et", "pour"]]
_TOKENS = ", ".join("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in _OPENINGS)


@query(
    "anchor_words",
    rf"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), ' ') || ' ' AS padded, [{_TOKENS}][(doc_id % {len(_OPENINGS) + 1})::INT + 1] AS tokens FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, CASE WHEN tokens IS NOT NULL THEN len(list_filter(tokens, lambda t: contains(padded, ' ' || t || ' '))) END AS hits FROM d)
    SELECT doc_id, hits::INT AS hits, hits >= 2 AS ok FROM h""",
)
def anchor_words(spark, sf_dir):
    """J-07: whole documents as first chapters, each against the openings of a book or common words of a language; some have none."""
    rows = [(i, ws) for i, ws in enumerate(_OPENINGS)]
    anchors = spark.createDataFrame(rows, "k int, tokens array<string>")
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    first = docs.select(F.col("doc_id").cast("string").alias("usfm"), F.lit(1).alias("v"), "text")
    wanted = docs.select(F.col("doc_id").cast("string").alias("usfm"), (F.col("doc_id") % (len(rows) + 1)).alias("k")).join(F.broadcast(anchors), "k")
    return align.anchors_found(first, wanted.select("usfm", "tokens")).select(F.col("usfm").cast("long").alias("doc_id"), "hits", "ok")


@query("ascii_words", "SELECT lang, sum(len(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')))::BIGINT AS words FROM documents GROUP BY lang")
def ascii_words(spark, sf_dir):
    """C-13 word counts by language."""
    words = table(spark, sf_dir, "documents").select("lang", F.size(U.words("text")).alias("n"))
    return words.groupBy("lang").agg(F.sum("n").alias("words"))


@query("harvest_verses", r"SELECT conv_id, count(*) AS verses FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id HAVING count(*) > 1")
def harvest_verses(spark, sf_dir):
    """C-30: talks printed with marginal numbers and read back."""
    flat = F.regexp_replace("text", r"[\s0-9]+", " ")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(flat).alias("t"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    numbered = turns.withColumn("k", number).withColumn("line", F.when(F.col("k") == 1, F.col("t")).otherwise(F.concat(F.lit("  "), F.col("k").cast("string"), F.lit("  x"), "t")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"])
    pages = numbered.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("text"))
    found = dialects.harvest_chapters(pages.select(F.col("conv_id").cast("string").alias("usfm"), F.lit(1).alias("chapter"), "text"))
    return found.groupBy(F.col("usfm").cast("long").alias("conv_id")).agg(F.count("*").alias("verses"))


@query("bad_flags", r"SELECT p_name AS tag FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'v1.' || p_size::VARCHAR FROM part WHERE p_partkey % 3 = 1")
def bad_flags(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    tag = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("v1."), size)).otherwise(F.concat(F.lit("v1.2."), size))
    return gates.bad_flags(table(spark, sf_dir, "part").select(tag.alias("tag")))


@query("stream_notes", rf"WITH {_NOTES} SELECT ref, body, regexp_extract(ref, ':([0-9]+)\s*$', 1)::INT AS verse, created, updated FROM lives WHERE trashed_at IS NULL AND puts > 0")
def stream_notes(spark, sf_dir):
    """ST-03: note events as a stream of files into the table of current notes."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = note_events(spark, sf_dir)
    events.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    q = stream.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(incremental.note_sink(at)).trigger(availableNow=True).start()
    q.awaitTermination()
    return incremental.current_notes(spark, at)


@query("stream_deck", f"WITH RECURSIVE {CARDS} SELECT ref, round(interval, 6) AS interval, round(ease, 6) AS ease, reps, state, due FROM cards")
def stream_deck(spark, sf_dir):
    """ST-02: grade events as a stream, one card per reader in keyed state; the last state of each card stands.

    Events come in two runs of the stream; within a batch the state orders a card's events. A session of its own holds the state
    store's setting, so the caller's stays as it is.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = grade_events(spark, sf_dir).select(F.col("ref").cast("string").alias("ref"), "seq", "ts", "kind", "q")
    ends = events.agg(F.min("seq").alias("first"), F.max("seq").alias("last")).first()
    middle = ((ends["first"] or 0) + (ends["last"] or 0)) // 2
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")

    first = F.coalesce(F.col("seq") <= middle, F.lit(False))
    for when in (first, ~first):  # the second half meets the cards that the first has left in the state
        events.filter(when).write.mode("append").parquet(f"{at}/in")
        cards = incremental.deck_stream(own.readStream.schema(events.schema).parquet(f"{at}/in"))
        cards.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{at}/out")
    last = seen.groupBy("ref").agg(F.max_by(F.struct("interval", "ease", "reps", "state", "due"), "batch").alias("c"))
    return last.select(F.col("ref").cast("long").alias("ref"), six("c.interval").alias("interval"), six("c.ease").alias("ease"), "c.reps", "c.state", "c.due")
