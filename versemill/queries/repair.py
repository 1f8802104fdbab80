"""Text repair, probes and language statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill.catalog import query
from versemill.functions import fixed
from versemill.functions import text as T
from versemill.functions import unicode as U
from versemill.operators import align
from versemill.plans import convert, gates, verify
from versemill.session import table


def _sql_pass(x: str) -> str:
    for name, letter in (("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{letter}')"
    return x


_ENT, _TAG = fixed.ENTITY, fixed.TAG
_COUNT = "len(regexp_extract_all({}, '{}'))"
_C1, _CP1252 = fixed.mojibake()
#: Pages as they are but every third one, whose asterisks are C1 controls: each of them in turn by the page's number.
_BROKEN = f"CASE WHEN page_id % 3 = 0 THEN replace(html, '*', chr(CASE WHEN page_id % 9 = 0 THEN 146 WHEN page_id % 9 = 3 THEN 128 ELSE 159 END)) ELSE html END"
_REPAIRED = f"translate({_BROKEN}, '{_C1}', '{_CP1252}')"
SANITIZED = f"""p0 AS (SELECT page_id, {_REPAIRED} AS t, (length({_BROKEN}) <> length(translate({_BROKEN}, '{_C1}', '')))::BIGINT AS c1 FROM pages), p1 AS (SELECT page_id, c1, t AS t0, {_sql_pass('t')} AS t FROM p0), p2 AS (SELECT page_id, c1, t0, t AS t1, {_sql_pass('t')} AS t FROM p1),
p3 AS (SELECT page_id, c1, t0, t1, t AS t2, {_sql_pass('t')} AS t FROM p2), p4 AS (SELECT page_id, c1, t0, t1, t2, t AS t3, {_sql_pass('t')} AS t FROM p3),
clean AS (SELECT page_id, c1, {' + '.join(_COUNT.format(x, _ENT) for x in ('t0', 't1', 't2', 't3'))} AS entity_residue, {_COUNT.format('t', _TAG)} AS tag_residue, regexp_replace(t, '{_TAG}', '', 'g') AS b FROM p4),
done AS (SELECT page_id, translate(b, '{{}}~', '') AS text, c1::BIGINT AS c1_mojibake, entity_residue, tag_residue, (length(b) - length(replace(b, chr(65533), ''))) AS replacement_char,
    (length(b) - length(translate(b, '{{}}~', ''))) AS stray_delimiters FROM clean)"""


@query("strip_tags_entities", f"WITH {SANITIZED} SELECT page_id, text, c1_mojibake, entity_residue, tag_residue, replacement_char::BIGINT AS replacement_char, stray_delimiters::BIGINT AS stray_delimiters FROM done")
def strip_tags_entities(spark, sf_dir):
    return broken_pages(spark, sf_dir).select("page_id", T.sanitize(F.col("html")).alias("s")).select("page_id", "s.*")


def broken_pages(spark, sf_dir):
    k = F.col("page_id") % 9
    letter = F.when(k == 0, "\u0092").when(k == 3, "\u0080").otherwise("\u009f")
    html = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("*"), letter)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query(
    "sanitize_counters",
    f"""WITH {SANITIZED} SELECT sum(c1_mojibake)::BIGINT AS c1_mojibake, sum(entity_residue)::BIGINT AS entity_residue, sum(tag_residue)::BIGINT AS tag_residue,
    sum(replacement_char)::BIGINT AS replacement_char, sum(stray_delimiters)::BIGINT AS stray_delimiters FROM (SELECT d.* FROM done d)""",
)
def sanitize_counters(spark, sf_dir):
    fixes = broken_pages(spark, sf_dir).select(T.sanitize(F.col("html")).alias("fixes"))
    return convert.repair_totals(fixes.withColumn("k", F.lit(1)), ["k"]).drop("k")


@query(
    "strip_margins",
    r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '¶ ¶ ' || p_name WHEN 1 THEN p_name || ' :+ 1.' || p_size::VARCHAR || ' ' || p_type || ': or, ' || p_brand WHEN 2 THEN p_name || ':' ELSE p_name || '+ 1.x ' END AS t FROM part),
    b AS (SELECT p_partkey, t, regexp_replace(t, '^(?:\s*¶\s*)+', '') AS x FROM v)
    SELECT p_partkey, CASE WHEN regexp_matches(x, '\+ [0-9]+\.[0-9]+ ') THEN regexp_replace(regexp_replace(x, '(?s)\+ [0-9]+\.[0-9]+ .*$', ''), '\s*:\s*$', '') ELSE x END AS text FROM b""",
)
def strip_margins(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    t = (
        F.when(k == 0, F.concat(F.lit("¶ ¶ "), name))
        .when(k == 1, F.concat(name, F.lit(" :+ 1."), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit(": or, "), "p_brand"))
        .when(k == 2, F.concat(name, F.lit(":")))
        .otherwise(F.concat(name, F.lit("+ 1.x ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_margins(t).alias("text"))


@query(
    "normalise_text",
    r"""SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g')), '\s+([,.;:!?%»›])', '\1', 'g')) AS digest FROM documents""",
)
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise(F.col("text")).cast("binary")).alias("digest"))


HALVES = r"""h AS (SELECT doc_id, i, t, s, n, trim(regexp_replace(n, '\s+', ' ', 'g')) AS head FROM (SELECT doc_id, i, t, regexp_replace(t, '\s+', '', 'g') AS s, t AS n FROM units)),
k AS (SELECT *, length(head) // 2 AS half, length(t) > 40 AND position(substr(t, 1, 40) IN substr(t, 2)) > 0 AS prefix FROM h),
kinds AS (SELECT doc_id, i, CASE WHEN t = '' THEN NULL WHEN length(t) >= 4 AND length(t) % 2 = 0 AND substr(t, 1, length(t) // 2) = substr(t, length(t) // 2 + 1) THEN 'exact'
    WHEN (length(s) <> length(t) AND length(s) >= 4 AND length(s) % 2 = 0 AND substr(s, 1, length(s) // 2) = substr(s, length(s) // 2 + 1))
      OR (CASE WHEN half < 8 THEN prefix ELSE rtrim(substr(head, 1, half)) = rtrim(substr(trim(substr(head, half + 1)), 1, half)) END) THEN 'half'
    WHEN prefix THEN 'prefix40' END AS kind FROM k)"""


@query(
    "doubled_text_kinds",
    f"WITH units AS (SELECT doc_id, 0 AS i, text AS t FROM documents), {HALVES} SELECT doc_id, kind FROM kinds WHERE kind IS NOT NULL",
)
def doubled_text_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.double_kind(F.col("text")).alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


@query(
    "doubled_line_counts",
    f"""WITH units AS (SELECT doc_id, i, t FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))), {HALVES}
    SELECT lang, kind, count(*) AS n FROM kinds JOIN documents USING (doc_id) WHERE kind IS NOT NULL GROUP BY lang, kind""",
)
def doubled_line_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("t"))
    kinds = lines.select("lang", T.double_kind(F.col("t")).alias("kind")).filter(F.col("kind").isNotNull())
    return kinds.groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query(
    "forbidden_probe",
    rf"""SELECT 'documents' AS src, count(*) FILTER (regexp_matches(text, '[{{}}~¶\\\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]')) AS forbidden, count(*) FILTER (regexp_matches(text, '{fixed.ANY_ENTITY}')) AS entities,
    count(*) FILTER (regexp_matches(text, '{fixed.ANY_TAG}')) AS tags FROM documents
    UNION ALL SELECT 'pages', count(*) FILTER (regexp_matches(html, '[{{}}~¶\\\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]')), count(*) FILTER (regexp_matches(html, '{fixed.ANY_ENTITY}')),
    count(*) FILTER (regexp_matches(html, '{fixed.ANY_TAG}')) FROM pages""",
)
def forbidden_probe(spark, sf_dir):
    def probe(name, column):
        t = F.col(column)
        counts = [F.count_if(T.forbidden(t)).alias("forbidden"), F.count_if(T.has(t, T.ANY_ENTITY)).alias("entities"), F.count_if(T.has(t, T.ANY_TAG)).alias("tags")]
        return table(spark, sf_dir, name).agg(*counts).select(F.lit(name).alias("src"), "*")

    return probe("documents", "text").unionByName(probe("pages", "html"))


@query(
    "encoding_probe",
    r"""SELECT lang, count(*) FILTER (regexp_matches(text, '[\x{80}-\x{9F}]')) AS c1, count(*) FILTER (contains(text, chr(65533))) AS lost, sum(length(text) - length(replace(text, chr(160), '')))::BIGINT AS nbsp FROM documents GROUP BY lang""",
)
def encoding_probe(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(T.has(t, r"[\u0080-\u009F]")).alias("c1"), F.count_if(F.contains(t, F.lit("�"))).alias("lost"), F.sum(T.count_of(t, " ")).alias("nbsp")
    )


_ACCENTED = "[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]"


@query("decomposed_probe", f"SELECT doc_id, doc_id % 2 = 0 AND contains(text, 'é') AND len(regexp_extract_all(text, '{_ACCENTED}')) >= 2 AS decomposed FROM documents WHERE text IS NOT NULL")
def decomposed_probe(spark, sf_dir):
    """C-21: every second document has its é in two parts."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("é"), F.lit("é"))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", text.alias("text"))
    marked = T.has(F.col("text"), r"\p{M}")  # only rows with marks reach Python
    return docs.select("doc_id", F.coalesce(U.decomposed(F.when(marked, F.col("text"))), F.lit(False)).alias("decomposed"))


@query(
    "gap_probe",
    r"""SELECT doc_id, kind FROM (SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(t, ''), '\s+', '', 'g')) = '' THEN 'empty' WHEN regexp_matches(t, '⟨[^⟩]{0,60}⟩') OR regexp_matches(t, '(?i)missing in this (?:edition|version|translation|printing)')
    OR regexp_matches(t, '(?i)\b(?:verse )?(?:not available|not present|not in this)\b') OR regexp_matches(t, '(?i)^\s*(?:n\s*/?\s*a\.?|not available|no text)\s*$') OR regexp_matches(t, '^\s*(?:\.{3,}|—|-)\s*$') THEN 'marker' END AS kind
    FROM (SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '⟨' || lang || '⟩' WHEN 3 THEN 'N/A' WHEN 4 THEN '...' WHEN 5 THEN 'Verse not present here' ELSE text END AS t FROM documents)) WHERE kind IS NOT NULL""",
)
def gap_probe(spark, sf_dir):
    k = F.col("doc_id") % 50
    t = F.when(k == 0, "").when(k == 1, " ").when(k == 2, F.concat(F.lit("⟨"), "lang", F.lit("⟩"))).when(k == 3, "N/A").when(k == 4, "...").when(k == 5, "Verse not present here")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.gap_kind(t.otherwise(F.col("text"))).alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


_CASES = " ".join(f"WHEN unicode(c) BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in fixed.SCRIPTS)
SCRIPTS = rf"""letters AS (SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang, c),
scripts AS (SELECT lang, CASE {_CASES} WHEN regexp_matches(c, '^\p{{L}}$') THEN 'other' ELSE '' END AS script, n FROM letters),
counts AS (SELECT lang, script, sum(n)::BIGINT AS letters FROM scripts WHERE script <> '' GROUP BY lang, script)"""


@query("script_histogram", f"WITH {SCRIPTS} SELECT * FROM counts")
def script_histogram(spark, sf_dir):
    return verify.script_counts(table(spark, sf_dir, "documents"), "lang")


@query("script_fingerprint", f"WITH {SCRIPTS} SELECT lang, arg_max(script, letters) AS script, sum(letters)::BIGINT AS letters, round(max(letters) / sum(letters), 4) AS ratio FROM counts GROUP BY lang")
def script_fingerprint(spark, sf_dir):
    return verify.dominant_script(verify.script_counts(table(spark, sf_dir, "documents"), "lang"), "lang")


WORDS = r"words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM documents) GROUP BY lang, word)"
_ENGLISH = ", ".join(f"'{w}'" for w in fixed.ENGLISH)


@query("stopword_ratio", f"WITH {WORDS} SELECT lang, sum(n)::BIGINT AS tokens, round(sum(CASE WHEN word IN ({_ENGLISH}) THEN n ELSE 0 END) / sum(n), 4) AS ratio FROM words GROUP BY lang")
def stopword_ratio(spark, sf_dir):
    return verify.stopword_ratio(verify.word_counts(table(spark, sf_dir, "documents"), "lang"), "lang")


@query(
    "nonascii_top_words",
    rf"WITH {WORDS} SELECT lang, word, n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM words WHERE regexp_matches(word, '[^\x00-\x7F]')) WHERE r <= 8",
)
def nonascii_top_words(spark, sf_dir):
    return verify.top_words(verify.word_counts(table(spark, sf_dir, "documents"), "lang"), "lang", 8, True)


@query("top_words", f"WITH {WORDS} SELECT lang, word, n, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM words) WHERE r <= 10")
def top_words(spark, sf_dir):
    return verify.top_words(verify.word_counts(table(spark, sf_dir, "documents"), "lang"), "lang", 10, False)


@query("accent_ratio", rf"SELECT lang, sum(len(regexp_extract_all(text, '{_ACCENTED}')))::BIGINT AS accented, sum(len(regexp_extract_all(text, '\p{{L}}')))::BIGINT AS letters FROM documents GROUP BY lang")
def accent_ratio(spark, sf_dir):
    """Accented letters are those whose decomposition has a mark; only non-ASCII letters reach Python."""
    rest = F.regexp_replace("text", r"[\x00-\x7F]+", "")
    letters = F.regexp_count("text", F.lit(r"\p{L}")).cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(U.accented_letters(rest)).alias("accented"), F.sum(letters).alias("letters"))


@query(
    "marker_counts",
    "SELECT lang, " + ", ".join(
        rf"sum(len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x = '{m}')))::BIGINT AS {m}" for m in ("the", "der", "pour")
    ) + " FROM documents GROUP BY lang",
)
def marker_counts(spark, sf_dir):
    return align.marker_counts(table(spark, sf_dir, "documents"), "lang", ["the", "der", "pour"])


SLUGS = r"""books AS (SELECT s_nationkey AS edition, s_suppkey AS n, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN s_name WHEN 2 THEN 'é' || s_suppkey::VARCHAR WHEN 3 THEN 'same' ELSE 'Bk' || s_suppkey::VARCHAR END AS short FROM supplier)"""


def supplier_books(spark, sf_dir):
    k = F.col("s_suppkey")
    short = F.when(k % 6 == 0, "").when(k % 6 == 1, F.col("s_name")).when(k % 6 == 2, F.concat(F.lit("é"), k.cast("string"))).when(k % 6 == 3, "same").otherwise(F.concat(F.lit("Bk"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("edition"), k.alias("n"), short.alias("short"))


@query(
    "slug_problems",
    rf"""WITH {SLUGS} SELECT * FROM (SELECT edition, n, short, CASE WHEN short = '' THEN 'empty' WHEN regexp_matches(short, '[^\x00-\x7F]') THEN 'ascii' WHEN regexp_matches(short, '[^A-Za-z0-9._~-]') THEN 'unsafe'
    WHEN row_number() OVER (PARTITION BY edition, short ORDER BY n) > 1 THEN 'duplicate' END AS problem FROM books) WHERE problem IS NOT NULL""",
)
def slug_problems(spark, sf_dir):
    return verify.slug_problems(supplier_books(spark, sf_dir), ["edition"])


@query(
    "slug_gate",
    rf"""WITH {SLUGS}, canon AS (SELECT n_nationkey AS n, 'Bk' || n_nationkey::VARCHAR AS short FROM nation), sized AS (SELECT *, count(*) OVER (PARTITION BY edition) AS k, (SELECT count(*) FROM canon) AS t FROM books)
    SELECT edition, short, 'shape' AS problem FROM sized WHERE NOT regexp_matches(short, '^[A-Za-z0-9]{{1,12}}$')
    UNION ALL SELECT edition, s.short, 'position' FROM sized s LEFT JOIN canon c USING (n) WHERE k >= t AND s.short IS DISTINCT FROM c.short
    UNION ALL SELECT edition, short, 'unknown' FROM sized WHERE k < t AND short NOT IN (SELECT short FROM canon)""",
)
def slug_gate(spark, sf_dir):
    canon = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.concat(F.lit("Bk"), F.col("n_nationkey").cast("string")).alias("short"))
    return gates.slug_gate(supplier_books(spark, sf_dir), canon)


_HOSTS = " UNION ALL ".join(f"SELECT page_id, lineno, 'host:{h}', line FROM lines WHERE contains(lower(line), '{h.lower()}')" for h in fixed.ONLINE_HOSTS)


@query(
    "offline_gate",
    rf"""WITH lines AS (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1)::INT AS lineno FROM (SELECT page_id, string_split(url || chr(10) || html, chr(10)) AS l FROM pages)),
    hits AS (SELECT page_id, lineno, 'url' AS kind, line FROM lines WHERE regexp_matches(line, '(?i)https?://') UNION ALL {_HOSTS}
    UNION ALL SELECT page_id, lineno, 'api', line FROM lines WHERE regexp_matches(line, '\b(curl|wget|HttpClient|urllib|requests\.|socket\.|XMLHttpRequest|WebSocket|io\.popen|os\.system)\b'))
    SELECT page_id AS file, lineno, kind, substr(trim(line), 1, 70) AS line FROM hits""",
)
def offline_gate(spark, sf_dir):
    text = F.concat("url", F.lit("\n"), "html")
    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return gates.offline_gate(lines.select("file", (F.col("i") + 1).alias("lineno"), "line"))


_BARE = r"regexp_replace(regexp_replace(html, '(?s)<title>.*?</title>', ' ', 'g'), '</?(?:div|p)\b[^<>]*>', ' ', 'g')"


@query("markup_scrub", "SELECT page_id, md5(replace(replace(replace(replace(replace(" + _BARE + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')) AS digest FROM pages")
def markup_scrub(spark, sf_dir):
    """C-10, C-11: titles go with their content, divisions and paragraphs without, named and numeric entities are decoded once."""
    text = U.entities(U.scrub("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.cast("binary")).alias("digest"))


_SPAN = r"regexp_replace({}, '(?s)<{}\b[^>]*>.*?</{}>', '', 'g')"
_PLAIN = "replace(html, '<!', '!')"
for _name in ("title", "nav", "footer"):
    _PLAIN = _SPAN.format(_PLAIN, _name, _name)
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '<(?:script|style)>[^<]*</[^>]*>', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g')"


@query("tag_text", f"SELECT page_id, md5({_PLAIN}) AS digest FROM pages")
def tag_text(spark, sf_dir):
    """C-12: the text of pages without some elements and their content, by depth of tags alone."""
    text = U.tag_text(["title", "nav", "footer", "script", "style"])
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text("html").cast("binary")).alias("digest"))


@query(
    "osis_refs",
    r"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Gen.' || l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR WHEN 1 THEN 'ps.' || l_orderkey::VARCHAR ELSE 'Tob.x.' || l_linenumber::VARCHAR END AS ref FROM lineitem),
    p AS (SELECT *, regexp_matches(ref, '^[^.]*(?:\.[0-9]+)+$') AS ok, string_split(ref, '.') AS x FROM r)
    SELECT ref, CASE WHEN ok THEN upper(x[1]) END AS book, CASE WHEN ok THEN try_cast(x[2] AS INT) END AS chapter, CASE WHEN ok THEN try_cast(x[3] AS INT) END AS verse, lower(x[1]) = 'tob' AS apocryphal, count(*) AS n FROM p GROUP BY ALL""",
)
def osis_refs(spark, sf_dir):
    o, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    ref = (
        F.when(n % 3 == 0, F.concat(F.lit("Gen."), o, F.lit("."), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("ps."), o)).otherwise(F.concat(F.lit("Tob.x."), n.cast("string")))
    )
    rows = table(spark, sf_dir, "lineitem").select(ref.alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    r = T.osis_ref(F.col("ref"))
    apocryphal = T.is_apocryphal(F.concat(F.substring_index("ref", ".", 1), F.lit(".1"))).alias("apocryphal")
    return rows.select("ref", r["book"].alias("book"), r["chapter"].alias("chapter"), r["verse"].alias("verse"), apocryphal, "n")
