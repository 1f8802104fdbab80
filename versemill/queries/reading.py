"""Retrieval, references, navigation, routes and display over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.catalog import query
from versemill.operators import navigate, refs, render, routes, search
from versemill.session import table

# Books of conversations: conversation c is book c + 1 with one chapter, a turn is a verse (turn + 1).
BOOKS = """books AS (SELECT conv_id + 1 AS n, 'Talk ' || (conv_id + 1)::VARCHAR AS name, 'tk' || (conv_id + 1)::VARCHAR AS short, 1 AS chapters,
    count(DISTINCT turn) AS verses FROM conversations GROUP BY conv_id)"""
VERSES = "verses AS (SELECT conv_id + 1 AS n, 1 AS chapter, turn + 1 AS v, min(text) AS text FROM conversations GROUP BY conv_id, turn)"


def talk_books(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("turn").alias("verses"))
    n = F.col("conv_id") + 1
    return talks.select(n.alias("n"), F.concat(F.lit("Talk "), n.cast("string")).alias("name"), F.concat(F.lit("tk"), n.cast("string")).alias("short"), F.lit(1).alias("chapters"), "verses")


def talk_verses(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return turns.select((F.col("conv_id") + 1).alias("n"), F.lit(1).alias("chapter"), (F.col("turn") + 1).alias("v"), "text")


@query(
    "search_all_tokens",
    """SELECT doc_id, lang, text FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') ORDER BY doc_id LIMIT 24""",
)
def search_all_tokens(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "the ing", "text", ["doc_id"])


@query(
    "search_by_lang",
    """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents
    WHERE contains(lower(text), 'en') AND contains(lower(text), 're')) WHERE r <= 24""",
)
def search_by_lang(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").filter(search.matches(F.col("text"), "EN re")).select("lang", "doc_id")
    w = Window.partitionBy("lang").orderBy("doc_id")
    return hits.withColumn("r", F.row_number().over(w)).filter("r <= 24").drop("r")


@query(
    "search_hit_counts",
    """SELECT lang, count(*) AS docs, count(*) FILTER (contains(lower(text), 'license')) AS license,
    count(*) FILTER (contains(lower(text), 'gnu') AND contains(lower(text), 'license')) AS gnu_license FROM documents GROUP BY lang""",
)
def search_hit_counts(spark, sf_dir):
    text = F.col("text")
    hits = lambda q: F.count_if(search.matches(text, q))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), hits("License").alias("license"), hits("gnu license").alias("gnu_license"))


TERMS = "terms AS (SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '''?[A-Za-z0-9]+''?')) AS term FROM documents) GROUP BY term)"


@query("term_index_top", f"WITH {TERMS} SELECT term, count FROM terms ORDER BY count DESC, term LIMIT 100")
def term_index_top(spark, sf_dir):
    return search.terms(table(spark, sf_dir, "documents"), "text").orderBy(F.desc("count"), "term").limit(100)


@query("term_prefix", f"WITH {TERMS} SELECT term, count FROM terms WHERE starts_with(term, 'th') ORDER BY count DESC, term LIMIT 12")
def term_prefix(spark, sf_dir):
    return search.term_prefix(search.terms(table(spark, sf_dir, "documents"), "text"), "Th")


@query("term_suggestions", f"WITH {TERMS} SELECT term, count FROM terms WHERE starts_with(term, 'inh') ORDER BY count DESC, term LIMIT 6")
def term_suggestions(spark, sf_dir):
    return search.term_prefix(search.terms(table(spark, sf_dir, "documents"), "text"), "inh", 6)


REFS = """refs AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Talk ' || (n_nationkey + 1)::VARCHAR || ' 1:' || (n_regionkey + 1)::VARCHAR
    WHEN 1 THEN 'TK' || (n_nationkey + 1)::VARCHAR || ' 1' WHEN 2 THEN n_name || ' 3:16' WHEN 3 THEN 'talk ' || (n_nationkey + 1)::VARCHAR || ' 1:99'
    ELSE lower(n_name) END AS ref FROM nation)"""
PARSED = r"""parsed AS (SELECT n_nationkey, ref, CASE WHEN ok THEN lower(regexp_extract(ref, p, 1)) END AS name,
    CASE WHEN ok THEN regexp_extract(ref, p, 2)::INT END AS chapter, CASE WHEN ok AND regexp_extract(ref, p, 3) <> '' THEN regexp_extract(ref, p, 3)::INT END AS verse
    FROM (SELECT *, '^\s*(.*?)\s*([0-9]+)(?::([0-9]+))?\s*$' AS p, regexp_matches(ref, '^\s*\S.*?\s*[0-9]+(?::[0-9]+)?\s*$') AND regexp_extract(ref, '^\s*(.*?)\s*([0-9]+)(?::([0-9]+))?\s*$', 1) <> '' AS ok FROM refs))"""
KEYS = "keys AS (SELECT key, min(rank * 1000000000 + n) % 1000000000 AS n FROM (SELECT lower(name) AS key, 0 AS rank, n FROM books UNION ALL SELECT lower(short), 1, n FROM books) GROUP BY key)"


def nation_refs(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    s = lambda c: c.cast("string")
    ref = (
        F.when(k % 5 == 0, F.concat(F.lit("Talk "), s(k + 1), F.lit(" 1:"), s(r + 1)))
        .when(k % 5 == 1, F.concat(F.lit("TK"), s(k + 1), F.lit(" 1")))
        .when(k % 5 == 2, F.concat(F.col("n_name"), F.lit(" 3:16")))
        .when(k % 5 == 3, F.concat(F.lit("talk "), s(k + 1), F.lit(" 1:99")))
        .otherwise(F.lower("n_name"))
    )
    return table(spark, sf_dir, "nation").select("n_nationkey", ref.alias("ref"))


@query("ref_parse", f"WITH {REFS}, {PARSED} SELECT n_nationkey, ref, name, chapter, verse FROM parsed")
def ref_parse(spark, sf_dir):
    return nation_refs(spark, sf_dir).withColumn("r", refs.parse_ref(F.col("ref"))).select("n_nationkey", "ref", "r.name", "r.chapter", "r.verse")


@query(
    "ref_read",
    f"""WITH {BOOKS}, {VERSES}, {REFS}, {PARSED}, {KEYS}, found AS (SELECT n_nationkey, ref, n, coalesce(chapter, 1) AS chapter, coalesce(verse, 1) AS verse
    FROM parsed LEFT JOIN keys ON key = coalesce(name, lower(trim(ref))))
    SELECT n_nationkey, ref, f.n, f.chapter, f.verse, text FROM found f LEFT JOIN verses v ON f.n = v.n AND f.chapter = v.chapter AND f.verse = v.v""",
)
def ref_read(spark, sf_dir):
    return refs.read_refs(nation_refs(spark, sf_dir), talk_books(spark, sf_dir), talk_verses(spark, sf_dir)).select("n_nationkey", "ref", "n", "chapter", "verse", "text")


@query(
    "ref_prefix",
    """WITH wanted AS (SELECT DISTINCT lower(substr(n_name, 1, 7 + n_nationkey % 3)) AS ref FROM nation)
    SELECT ref, min_by(n, (lower(n_name) <> ref)::INT * 1000 + n) AS n FROM wanted LEFT JOIN (SELECT n_nationkey AS n, n_name FROM nation) ON starts_with(lower(n_name), ref) GROUP BY ref""",
)
def ref_prefix(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    wanted = nation.select(F.lower(F.substr("n_name", F.lit(1), 7 + F.col("n_nationkey") % 3)).alias("ref")).distinct()
    return refs.prefix_book(wanted, nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name")))


@query(
    "jump",
    f"""WITH {BOOKS}, {KEYS}, req AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'tk' || (n_nationkey + 1)::VARCHAR WHEN 1 THEN n_nationkey::VARCHAR
    WHEN 2 THEN ' Talk 3 ' ELSE 'nowhere' END AS book, CASE WHEN n_regionkey = 4 THEN 'x' ELSE (n_regionkey * 2)::VARCHAR END AS chapter FROM nation),
    w AS (SELECT req.*, coalesce(k.n, try_cast(book AS INT)) AS n FROM req LEFT JOIN keys k ON key = lower(trim(book))),
    e AS (SELECT w.*, b.chapters AS last, try_cast(chapter AS INT) AS c, CASE WHEN b.n IS NULL THEN 'NO BOOK' WHEN try_cast(chapter AS INT) IS NULL OR try_cast(chapter AS INT) < 1 THEN 'CHAPTER?' END AS error
    FROM w LEFT JOIN books b ON w.n = b.n)
    SELECT book, chapter, CASE WHEN error IS NULL THEN n END AS n, CASE WHEN error IS NULL THEN least(c, last) END AS to_chapter, error FROM e""",
)
def jump(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    book = F.when(k % 4 == 0, F.concat(F.lit("tk"), (k + 1).cast("string"))).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, " Talk 3 ").otherwise("nowhere")
    req = table(spark, sf_dir, "nation").select(book.alias("book"), F.when(r == 4, "x").otherwise((r * 2).cast("string")).alias("chapter"))
    return refs.jump(req, talk_books(spark, sf_dir))


@query(
    "chapter_payload",
    f"""WITH {BOOKS}, {VERSES} SELECT n, chapter, v, text, 1::BIGINT AS total_chapters, 'Talk 2' AS book_name FROM verses WHERE n = 2 AND chapter = 1""",
)
def chapter_payload(spark, sf_dir):
    payload = refs.chapter_payload(talk_verses(spark, sf_dir), talk_books(spark, sf_dir), 2, 1)
    return payload.select("n", "chapter", F.explode("verses").alias("x"), "total_chapters", "book_name").select("n", "chapter", "x.v", "x.text", "total_chapters", "book_name")


@query("slug_lookup", f"WITH {BOOKS}, s AS (SELECT 'tk' || n_nationkey::VARCHAR AS slug FROM nation) SELECT slug, coalesce(n, 0) AS n FROM s LEFT JOIN books ON short = slug")
def slug_lookup(spark, sf_dir):
    slugs = table(spark, sf_dir, "nation").select(F.concat(F.lit("tk"), F.col("n_nationkey").cast("string")).alias("slug"))
    return refs.slug_number(slugs, talk_books(spark, sf_dir))


@query("result_labels", f"""WITH {BOOKS}, {VERSES} SELECT n, v, substr(name || ' ' || chapter::VARCHAR || ':' || v::VARCHAR || ' - ' || text, 1, 110) AS label FROM verses JOIN books USING (n)""")
def result_labels(spark, sf_dir):
    rows = talk_verses(spark, sf_dir).join(talk_books(spark, sf_dir).select("n", "name"), "n")
    return rows.select("n", "v", refs.label(F.col("name"), F.col("chapter"), F.col("v"), F.col("text")).alias("label"))


@query(
    "settings_latest",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def settings_latest(spark, sf_dir):
    return refs.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    "nav_prev_next",
    """SELECT n_regionkey, n_nationkey, coalesce(lag(n_nationkey) OVER w, n_nationkey) AS prev, coalesce(lead(n_nationkey) OVER w, n_nationkey) AS next
    FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
)
def nav_prev_next(spark, sf_dir):
    out = navigate.steps(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"])
    return out.select("n_regionkey", "n_nationkey", F.col("prev.n_nationkey").alias("prev"), F.col("next.n_nationkey").alias("next"))


@query(
    "nav_chapters",
    """SELECT l_suppkey, book, chapter, coalesce(lag(book) OVER w, book) AS prev_book, coalesce(lag(chapter) OVER w, chapter) AS prev_chapter,
    coalesce(lead(book) OVER w, book) AS next_book, coalesce(lead(chapter) OVER w, chapter) AS next_chapter
    FROM (SELECT DISTINCT l_suppkey, l_orderkey AS book, l_linenumber AS chapter FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY book, chapter)""",
)
def nav_chapters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("chapter")).distinct()
    out = navigate.steps(rows, ["l_suppkey"], ["book", "chapter"])
    return out.select("l_suppkey", "book", "chapter", *[F.col(f"{d}.{c}").alias(f"{d}_{c}") for d in ("prev", "next") for c in ("book", "chapter")])


@query(
    "verse_cursor",
    f"""WITH {BOOKS}, moves AS (SELECT unnest([-10, -1, 1, 10]) AS delta) SELECT n, delta, greatest(1, least(verses, 3 + delta)) AS at FROM books, moves""",
)
def verse_cursor(spark, sf_dir):
    rows = talk_books(spark, sf_dir).select("n", "verses", F.explode(F.array(*[F.lit(d) for d in (-10, -1, 1, 10)])).alias("delta"))
    return rows.select("n", "delta", navigate.cursor(F.lit(3), F.col("delta"), F.col("verses")).cast("long").alias("at"))


@query(
    "page_list",
    """SELECT p_brand, p_partkey, page, (r % 8)::INT AS on_page, pages, page > 0 AS has_prev, page + 1 < pages AS has_next FROM
    (SELECT p_brand, p_partkey, r, (r // 8)::INT AS page, greatest(1, ceil(total / 8))::INT AS pages FROM
    (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS total FROM part))""",
)
def page_list(spark, sf_dir):
    return navigate.pages(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 8)


ROUTES = r"""urls AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1) AS seg, regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 2) AS num,
    regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
paths AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN path WHEN 1 THEN '/' || seg || '/b/' || num || '/2' WHEN 2 THEN '/' || seg || '/r/s' || num || '/' || (page_id % 9)::VARCHAR || ':' || (page_id % 4)::VARCHAR
    WHEN 3 THEN '/about' WHEN 4 THEN '/zz/about' WHEN 5 THEN '/' || seg || '/books/' || num ELSE '/b/' || num END AS path FROM urls),
stripped AS (SELECT page_id, path, CASE WHEN s IN ('en', 'de', 'fr', 'es') THEN s ELSE 'en' END AS lang, CASE WHEN s IN ('en', 'de', 'fr', 'es') THEN substr(path, length(s) + 2) ELSE path END AS rest
    FROM (SELECT *, regexp_extract(path, '^/([^/]*)', 1) AS s FROM paths)),
nums AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(rest, '^/r/[^/]+/([^:]*):', 1), '') AS INT), 0) AS c FROM stripped),
kinds AS (SELECT *, CASE WHEN rest = '/about' THEN 'about' WHEN rest = '/lang' THEN 'lang' WHEN regexp_matches(rest, '^/b/[^/]+') THEN 'b'
    WHEN regexp_matches(rest, '^/r/[^/]+/') AND c > 0 THEN 'r' WHEN starts_with(rest, '/books') THEN 'books' ELSE 'home' END AS kind FROM nums),
routes AS (SELECT page_id, lang, kind, CASE WHEN kind IN ('b', 'r') THEN regexp_extract(rest, '^/[br]/([^/]+)', 1) END AS short, CASE WHEN kind = 'r' THEN c END AS chapter,
    CASE kind WHEN 'b' THEN coalesce(try_cast(nullif(regexp_extract(rest, '^/b/[^/]+/(.*)$', 1), '') AS INT), 0) WHEN 'r' THEN coalesce(try_cast(nullif(regexp_extract(rest, '^/r/[^:]*:(.*)$', 1), '') AS INT), 0)
    WHEN 'books' THEN coalesce(try_cast(nullif(regexp_extract(rest, '^/books/(.*)$', 1), '') AS INT), 0) END AS page FROM kinds)"""


def page_routes(spark, sf_dir):
    url, k = F.col("url"), F.col("page_id")
    seg, num = (F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/([0-9]+)", i) for i in (1, 2))
    slash = F.lit("/")
    path = (
        F.when(k % 7 == 0, F.regexp_extract(url, "^https?://[^/]+([^?#]*)", 1))
        .when(k % 7 == 1, F.concat(slash, seg, F.lit("/b/"), num, F.lit("/2")))
        .when(k % 7 == 2, F.concat(slash, seg, F.lit("/r/s"), num, slash, (k % 9).cast("string"), F.lit(":"), (k % 4).cast("string")))
        .when(k % 7 == 3, "/about")
        .when(k % 7 == 4, "/zz/about")
        .when(k % 7 == 5, F.concat(slash, seg, F.lit("/books/"), num))
        .otherwise(F.concat(F.lit("/b/"), num))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.withColumn("r", routes.parse_route(F.col("path"), ["en", "de", "fr", "es"])).select("page_id", "r.*")


@query("route_parse", f"WITH {ROUTES} SELECT * FROM routes")
def route_parse(spark, sf_dir):
    return page_routes(spark, sf_dir)


@query("route_lang_counts", f"WITH {ROUTES} SELECT lang, kind, count(*) AS n FROM routes GROUP BY lang, kind")
def route_lang_counts(spark, sf_dir):
    return page_routes(spark, sf_dir).groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query(
    "path_split",
    r"""SELECT page_id, split_part(path, '/', 1) AS first, CASE WHEN ends_with(path, '/') THEN len(string_split(path, '/')) - 1 ELSE len(string_split(path, '/')) END::INT AS parts
    FROM (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)""",
)
def path_split(spark, sf_dir):
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", routes.first_segment(path).alias("first"), F.size(routes.split_parts(path, "/")).alias("parts"))


@query(
    "ui_strings",
    """WITH ui AS (SELECT DISTINCT lang, source AS key, lang || ':' || source AS value FROM documents WHERE lang = 'en' OR doc_id % 3 = 0),
    req AS (SELECT DISTINCT lang, source AS key FROM documents) SELECT r.lang, r.key, coalesce(o.value, b.value) AS value
    FROM req r LEFT JOIN ui o ON r.lang = o.lang AND r.key = o.key LEFT JOIN ui b ON b.lang = 'en' AND b.key = r.key""",
)
def ui_strings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("key"))
    ui = docs.filter((F.col("lang") == "en") | (F.col("doc_id") % 3 == 0)).select("lang", "key", F.concat("lang", F.lit(":"), "key").alias("value")).distinct()
    return routes.ui_string(ui, docs.select("lang", "key").distinct())


@query(
    "line_wrap",
    r"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    flat AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
    cums AS (SELECT doc_id, list(s ORDER BY i) AS c, list(x ORDER BY i) AS w FROM
        (SELECT doc_id, i, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM flat) GROUP BY doc_id),
    walk AS (SELECT doc_id, 1 AS a, greatest(1, len(list_filter(c, lambda x: x - 1 <= 88))) AS b, 1 AS line FROM cums
        UNION ALL SELECT doc_id, b + 1, greatest(b + 1, len(list_filter(c, lambda x: x - 1 - c[b] <= 88))), line + 1 FROM walk JOIN cums USING (doc_id) WHERE b < len(w))
    SELECT doc_id, line::INT AS line, array_to_string(w[a:b], ' ') AS text FROM walk JOIN cums USING (doc_id)""",
)
def line_wrap(spark, sf_dir):
    lines = render.wrap(render.coloured_runs(F.col("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "l"))
    return docs.select("doc_id", (F.col("i") + 1).alias("line"), "l.text")


@query(
    "page_pack",
    """WITH RECURSIVE v AS (SELECT conv_id, turn, 1 + max(len(string_split(text, chr(10)))) AS need FROM conversations GROUP BY conv_id, turn),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM v),
    p AS (SELECT conv_id, turn, i, 0 AS page, need AS used FROM o WHERE i = 1
      UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN p.used + o.need > 10 AND p.used > 0 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + o.need > 10 AND p.used > 0 THEN o.need ELSE p.used + o.need END
      FROM p JOIN o ON o.conv_id = p.conv_id AND o.i = p.i + 1)
    SELECT conv_id, turn AS v, page::INT AS page FROM p""",
)
def page_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("v")).agg(F.max(F.size(F.split("text", "\n"))).alias("n_lines"))
    return render.paginate(turns, ["conv_id"])


@query(
    "encode_chapters",
    r"""SELECT conv_id, replace(replace(string_agg(turn::VARCHAR || '{|}' || array_to_string(string_split(text, chr(10)), '{~}'), '{|}' ORDER BY turn), '\', '\\'), '"', '\"') AS literal
    FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) GROUP BY conv_id""",
)
def encode_chapters(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("v")).agg(F.min("text").alias("text"))
    return render.encode_chapters(turns.select("conv_id", "v", F.split("text", "\n").alias("lines")), ["conv_id"])


@query("encode_roundtrip", "SELECT conv_id, turn::INT AS v, replace(min(text), chr(10), '|') AS lines FROM conversations GROUP BY conv_id, turn")
def encode_roundtrip(spark, sf_dir):
    return render.decode_chapters(encode_chapters(spark, sf_dir), ["conv_id"]).withColumn("lines", F.array_join("lines", "|"))
