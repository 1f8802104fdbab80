import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from versemill.functions import fixed
from versemill.functions import unicode as U
from versemill.operators import align, navigate, refs, render, routes, search, study
from versemill.plans import convert, gates
from versemill.sources import books as B
from versemill.sources import dialects as D
from versemill.streaming import incremental


def test_search(spark):
    assert search.tokens_of("Lord's 'twas foo_bar") == ["lord'", "s", "'twas", "foo", "bar"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["The King sings", "king", "no", None])], "i int, t string")
    assert [r.i for r in search.search(df, "kin ING", "t", ["i"]).collect()] == [0, 1]
    assert search.search(df, " -- ", "t", ["i"]).count() == 0


def test_refs(spark):
    df = spark.createDataFrame([("1 Foo 3:16",), ("foo 2",), ("foo",), ("Foo3",)], "ref string").select("ref", refs.parse_ref(F.col("ref")).alias("r"))
    got = {r.ref: tuple(r.r) if r.r else None for r in df.collect()}
    assert got == {"1 Foo 3:16": ("1 foo", 3, 16), "foo 2": ("foo", 2, None), "foo": None, "Foo3": ("foo", 3, None)}
    books = spark.createDataFrame([(1, "Foo", "Fo", 3), (2, "Bar", "foo", 2)], "n int, name string, short string, chapters int")
    assert {r.key: r.n for r in refs.name_index(books).collect()} == {"foo": 1, "fo": 1, "bar": 2}
    reqs = spark.createDataFrame([("fo", "9"), ("2", "1"), ("zip", "1"), ("Bar", "x")], "book string, chapter string")
    assert {(r.book, r.n, r.to_chapter, r.error) for r in refs.jump(reqs, books).collect()} == {("fo", 1, 3, None), ("2", 2, 1, None), ("zip", None, None, "NO BOOK"), ("Bar", None, None, "CHAPTER?")}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/es/r/Bk01/3:2", ("es", "r", "Bk01", 3, 2)), ("/b/Bk02", ("en", "b", "Bk02", None, 0)), ("/books/x", ("en", "books", None, None, 0)),
        ("/zz/about", ("en", "home", None, None, None)), ("/booksX", ("en", "books", None, None, 0)), ("/de/about", ("de", "about", None, None, None)),
        ("/r/Bk01/3", ("en", "home", None, None, None)), ("", ("en", "home", None, None, None)), ("/fr/lang", ("fr", "lang", None, None, None)),
    ],
)
def test_routes(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string").select(routes.parse_route(F.col("p"), ["en", "es", "de", "fr"]).alias("r"))
    assert tuple(df.first().r) == want


def test_picker_and_ui(spark):
    rows = [("es", 1, "endonym", 0, "Español"), ("es", 1, "english", 1, "Spanish"), ("en", 0, "endonym", 0, "English"), ("en", 0, "english", 1, "English"), ("en", 0, "home", 2, "Home")]
    ui = spark.createDataFrame(rows, "lang string, lang_pos int, key string, pos int, value string")
    assert [r.label for r in routes.picker(ui).collect()] == ["English (English)", "Español (Spanish)"]
    req = spark.createDataFrame([("es", "home"), ("es", "endonym"), ("es", "no")], "lang string, key string")
    assert {r.key: r.value for r in routes.ui_string(ui, req).collect()} == {"home": "Home", "endonym": "Español", "no": None}
    assert {tuple(r) for r in gates.missing_keys(ui).collect()} == {("es", "home")}
    assert {r.key: r.pos for r in routes.key_numbers(ui, req.select("key")).collect()} == {"home": 2, "endonym": 0, "no": None}


def py_wrap(words, width):
    lines, red, cur = [], None, []
    for r, w in words:
        if cur and red == r and len(" ".join([*cur, w])) <= width:
            cur.append(w)
        else:
            if cur:
                lines.append((red, " ".join(cur)))
            red, cur = r, [w]
    return lines + ([(red, " ".join(cur))] if cur else [])


def test_wrap_against_plain_loop(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        segs = [("  ".join("w" * rng.randrange(1, 14) for _ in range(rng.randrange(8))), rng.random() < 0.4) for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(s for s, _ in segs), segs if i % 2 else None))
    df = spark.createDataFrame(rows, "i int, text string, segs array<struct<t: string, r: boolean>>")
    got = df.select("i", render.wrap(render.coloured_runs(F.col("text"), F.col("segs")), 20).alias("l")).collect()
    for r in got:
        _, text, segs = rows[r.i]
        words = [(red, w) for t, red in (segs or [(text, False)]) for w in t.split()]
        assert [(x.red, x.text) for x in r.l] == py_wrap(words, 20)


def test_encode_decode_and_pack(spark):
    df = spark.createDataFrame([(1, 2, ['say "x"', "b\\c"]), (1, 1, [""]), (2, 1, ["{r}red{/r}"])], "ch int, v int, lines array<string>")
    lit = render.encode_chapters(df, ["ch"])
    assert lit.filter("ch = 1").first().literal == '1{|}{|}2{|}say \\"x\\"{~}b\\\\c'
    assert {(r.ch, r.v, tuple(r.lines)) for r in render.decode_chapters(lit, ["ch"]).collect()} == {(1, 2, ('say "x"', "b\\c")), (1, 1, ("",)), (2, 1, ("{r}red{/r}",))}
    needs = spark.createDataFrame([([3, 3, 3, 3, 12, 2],), ([],), ([12, 12, 1],)], "n array<int>").select(render.pack_pages(F.col("n")).alias("p"))
    assert [r.p for r in needs.collect()] == [[0, 0, 0, 1, 2, 3], [], [0, 1, 2]]


def test_study_fold(spark):
    qs = [0, 4, 5, 0, 3, 5, 4]
    ev = [("a", 0, 0, "add", None)] + [("a", i + 1, 10 * i, "grade", q) for i, q in enumerate(qs)] + [("b", 1, 5, "grade", 4), ("c", 1, 5, "add", None)]
    cards = {r.ref: r for r in study.fold_cards(spark.createDataFrame(ev, "ref string, seq long, ts long, kind string, q int")).collect()}
    assert set(cards) == {"a", "c"}
    assert (cards["a"].state, cards["a"].reps, round(cards["a"].ease, 9), round(cards["a"].interval, 9)) == (2, 5, 2.5, 6.25)
    card = None
    for _, _, ts, kind, q in ev[:8]:
        card = incremental.py_grade(card, ts, kind, q)
    assert card[:4] == pytest.approx((cards["a"].interval, cards["a"].ease, cards["a"].reps, cards["a"].state)) and card[4] == cards["a"].due


def test_notes(spark):
    ev = [("r 1:3", 1, 10, "put", "x"), ("r 1:3", 2, 20, "put", "y"), ("q", 1, 5, "put", "old"), ("q", 2, 6, "delete", None), ("q", 3, 7, "delete", None), ("q", 4, 9, "put", "new"), ("z", 1, 1, "delete", None)]
    df = spark.createDataFrame(ev, "ref string, seq long, ts long, op string, body string")
    assert {tuple(r) for r in study.notes(df).collect()} == {("r 1:3", "y", 3, 10, 20), ("q", "new", 1, 9, 9)}
    assert {tuple(r) for r in study.trash(df).collect()} == {("q", "old", 6)}


def test_navigation(spark):
    df = spark.createDataFrame([("e", i) for i in range(20)], "edition string, n int")
    p = {r.n: (r.page, r.pages, r.has_prev, r.has_next) for r in navigate.pages(df, ["edition"], ["n"], 8).collect()}
    assert p[0] == (0, 3, False, True) and p[19] == (2, 3, True, False)
    s = {r.n: (r.prev.n, r.next.n) for r in navigate.steps(df, ["edition"], ["n"]).collect()}
    assert s[0] == (0, 1) and s[19] == (18, 19)
    assert [r[0] for r in df.select(navigate.clamp_page(F.col("n") - 5, F.lit(3))).limit(9).collect()] == [0, 0, 0, 0, 0, 0, 1, 2, 2]


DIALECTS = {
    "zefania": "<XMLBIBLE><BIBLEBOOK bnumber='1' bname='Alpha'><CHAPTER cnumber='1'><CAPTION>Head</CAPTION><VERS vnumber='1'>Um</VERS><VERS vnumber='2'>Dois</VERS></CHAPTER></BIBLEBOOK></XMLBIBLE>",
    "osis": "<osis><osisText><div type='book' osisID='Gen'><title>Alpha</title><chapter osisID='Gen.1'><verse osisID='Gen.1.1'>Um<note>apparatus</note></verse><verse osisID='Gen.1.2'>Dois</verse></chapter></div></osisText></osis>",
    "osis milestones": "<osis><osisText><div type='book' osisID='Gen'><chapter osisID='Gen.1'><verse sID='Gen.1.1'/>Um<verse eID='Gen.1.1'/><verse sID='Gen.1.2'/>Dois<verse eID='Gen.1.2'/></chapter></div></osisText></osis>",
    "usfm": "\\id GEN x\n\\h Alpha\n\\c 1\n// note\n\\v 1 Um\n\\v 2 Dois\n",
    "usfx b": "<usfx><book id='GEN'><c id='1'/><v id='1'>Um</v><v id='2'>Dois</v></book></usfx>",
    "sjson": '{"books":[{"name":"GEN","chapters":[{"chapter":1,"verses":[{"verse":1,"text":"Um"},{"verse":2,"text":"Dois <note>n</note>"}]}]}]}',
}


@pytest.mark.parametrize("name", DIALECTS)
def test_dialects(name):
    assert D.parse(name.split()[0], DIALECTS[name]) == [("GEN", 1, 1, "Um", None), ("GEN", 1, 2, "Dois", None)]


def test_dialect_corners(spark):
    usfx = "<usfx><book id='GEN'><h>Alpha</h><c id='1'/><v id='1'/>Um <add>mais</add> x<ve/><v id='2'/>Dois<ve/><c id='2'/><v id='1'/>Tres<ve/></book></usfx>"
    assert [r[1:4] for r in D.parse("usfx", usfx)] == [(1, 1, "Um mais x"), (1, 2, "Dois"), (2, 1, "Tres")]
    assert D.parse("usfm", "\\id GEN\n\\c 1\n\\v 1 Um \\add mais\\add*\nsegue\n\\v 2 Dois")[0][3] == "Um mais segue"
    assert D.parse("sjson", '{"books":[{"name":"Genesis","chapters":[{"chapter":1,"verses":[{"verse":1,"text":"Um <transChange>x</transChange>"},{"verse":2,"text":"D&amp;ois"}]}]}]}') == [
        ("Genesis", 1, 1, "Um x", None), ("Genesis", 1, 2, "D&ois", None)
    ]
    uxlc = D.parse("uxlc", "<Tanach><book n='GEN'><c n='1'><v n='1'><w>be<x>t</x></w><k>aa</k><q>bb</q></v></c></book></Tanach>")
    assert [r[3] for r in uxlc] == ["bet bb"] and D.pairs_in(["w", "k", "q", "k", "q", "q"]) == (2, 0, 1)
    assert D.parse("osis", "<broken")[0][4].startswith("ExpatError")
    rows = [("f1", DIALECTS["zefania"]), ("f2", DIALECTS["osis"]), ("f3", usfx), ("f4", DIALECTS["usfm"]), ("f5", DIALECTS["sjson"]), ("f6", "plain")]
    df = spark.createDataFrame(rows, "file string, value string").withColumn("dialect", D.sniff(F.col("value")))
    assert {r.file: r.dialect for r in df.collect()} == {"f1": "zefania", "f2": "osis", "f3": "usfx", "f4": "usfm", "f5": "sjson", "f6": None}
    assert D.parse_sources(df).filter("problem is null").count() == 11
    text = "Um inicio\n  2 Dois aqui\nsegue      3\n tres\n"
    assert D.harvest(text) == [(1, "Um inicio"), (2, "Dois aqui segue"), (3, "tres")] and D.harvest("sem numero") == []


def test_whole_turns_pass_through_every_dialect(spark):
    import hashlib
    import re

    from versemill.queries.editions import whole_verses

    odd = ["long " * 400 + "end.", "a & b < c > d &amp; e", "\"q\" 'r' {s} [t]", "back\\slash \\v 2 and \\\\ bar | x|y z", "çé ß Ünï 漢字 😀 .", "// not a note\n\n// nor this", "12 begins with digits"]
    odd += ["<osis> \"books\" <v n='3'>", "tab\tline\r\nnext\u2003wide\u00a0hard\x0bv\x85n", "bell\x07 end \ufffe", "", None, "<note>kept</note> &#65;"]
    rows = [(7, i, t) for i, t in enumerate(odd)] + [(8, 0, "only one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    want = []
    for c, i, t in rows:
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ", t or "")
        t = re.sub(r" ([,.;:!?%»›])", r"\1", " ".join(t.split()))
        want += [(d, c, i, len(t), hashlib.md5(t.encode()).hexdigest()) for d in ("osis", "sjson", "usfm", "usfx", "uxlc", "zefania")]
    got = whole_verses(df).select("dialect", "conv_id", "turn", "chars", "digest").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_resolve_sources(spark):
    raw = ["raw/por-x.xml", "raw/es.usfx", "raw/es_b.xml"]
    rows = [("por", "given.xml", None, raw), ("por", None, "old/es.usfx", raw), ("por", None, "gone.xml", raw), ("es", None, None, raw)]
    out = D.resolve_sources(spark.createDataFrame(rows, "lang string, explicit string, reported string, files array<string>"))
    assert [r.source for r in out.collect()] == ["given.xml", "raw/es.usfx", "raw/por-x.xml", None]


def test_book_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"1":[{"v":1,"text":"a","segs":[{"t":"a","r":true}]},{"v":2,"text":"b"}],"x":[{"v":1,"text":"c"}]}')
    (tmp_path / "2.json").write_text("not json")
    (tmp_path / "3.json").write_text('{"10":[{"v":"q","text":"d"}],"2":[{"v":1,"text":"e"}]}')
    verses, errors = B.book_rows(spark, str(tmp_path))
    assert {(r.usfm, r.chapter, r.v, r.text) for r in verses.collect()} == {("GEN", 1, 1, "a"), ("GEN", 1, 2, "b"), ("LEV", 2, 1, "e")}
    assert {(r.file, r.problem) for r in errors.collect()} == {("1.json", "chapter x"), ("2.json", "unreadable"), ("3.json", "verse row in chapter 10")}
    assert B.missing_books(verses, 4).count() == 2
    assert render.red_verses(verses, ["n"]).filter("legend").count() == 1
    docs = {r.n: r.json for r in B.book_documents(verses, ["n"]).collect()}
    assert docs[3] == '{"2":[{"v":1,"text":"e"}]}'
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "books.json").write_text('[{"n":1,"name":"Alpha","short":"Al","chapters":1,"verses":2}]')
    assert B.catalogue(spark, str(tmp_path / "cat")).first().usfm == "GEN"
    (tmp_path / "reg").write_text("# c\npor raw/por.xml extra\n\nlone\n")
    assert [tuple(r) for r in B.registry(spark, str(tmp_path / "reg")).collect()] == [("por", "raw/por.xml")]


def test_text_tree_and_literals(spark, tmp_path):
    (tmp_path / "a.lua").write_text('x\nopen("http://e.org")\nio.popen("ls")\n')
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe http://x")
    (tmp_path / "c.txt").write_bytes(b"\xff http://x")
    lines = B.text_lines(spark, str(tmp_path), [".lua", ".txt"])
    assert {(r.lineno, r.kind) for r in gates.offline_gate(lines).collect()} == {(2, "url"), (3, "api")}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.reds").write_text('  case 1: return s"1{|}a \\"q\\"";\n  case 2: return s"2{|}b";\nother\n')
    assert {(r.number, r.literal) for r in B.literals(spark, str(tmp_path / "m")).collect()} == {(1, '1{|}a \\"q\\"'), (2, "2{|}b")}


def test_roundtrip_and_fill(spark):
    cols = "usfm string, chapter int, v int, pos int, text string"
    b = spark.createDataFrame([("GEN", 1, 1, 0, "one"), ("GEN", 1, 1, 1, "uno"), ("GEN", 1, 3, 2, "x"), ("GEN", 9, 1, 0, "y")], cols)
    s = spark.createDataFrame([("GEN", 1, 1, 0, "uno"), ("GEN", 1, 2, 0, "dos")], cols)
    got = {(r.chapter, r.v): r["class"] for r in align.roundtrip(b, s).collect()}
    assert got == {(1, 1): "exact", (1, 2): "absent", (1, 3): "extra"}
    full, log = align.donor_fill(b, s.unionByName(spark.createDataFrame([("EXO", 1, 1, 0, "z")], cols)), align.KEY)
    assert full.count() == 6 and {(r.usfm, r.kind) for r in log.collect()} == {("GEN", "verse_filled"), ("EXO", "chapter_filled")}


def test_realign(spark):
    left = [(1, "the old gate"), (2, "a green lamp shone"), (3, "the river ran"), (4, "the end")]
    right = [(1, "the old gate"), (2, "the river ran"), (3, "the ends"), (4, "extra verse")]
    got = align._realign(left, right)
    assert (2, None, "left-only", "", "") in got and (4, 3, "near-miss", "end", "ends") in got and (None, 4, "right-only", "", "") in got and len(got) == 3
    frames = [spark.createDataFrame(pd.DataFrame(x, columns=["v", "text"])).withColumn("chapter", F.lit(1)) for x in (left, right)]
    assert align.realign(*frames, ["chapter"]).count() == 3


def test_diff_ledger(spark):
    left = [(1, "El río."), (2, "the old green gate stands"), (3, "wholly other words"), (4, "one two three"), (5, "x y")]
    right = [(1, "el rio"), (2, "the old grean gate stands"), (3, "one two three"), (4, "nothing like it"), (5, "x, y")]
    a, b = (spark.createDataFrame([(1, *r) for r in rows], "chapter int, v int, text string") for rows in (left, right))
    got = {r.v: r["class"] for r in align.diff_ledger(a, b, ["chapter"]).collect()}
    assert got == {1: "identical", 2: "orthographic", 3: "substantive", 4: "misaligned->3", 5: "identical"}


def test_convert(spark):
    cols = "usfm string, chapter int, v int, pos int, text string"
    canon = convert.canon_table(spark, [("GEN", "Alpha", "Al", 2, 3), ("EXO", "Beta", "Be", 1, 1)])
    src = spark.createDataFrame([("GEN", 1, 1, 0, "a &amp; {b}"), ("GEN", 1, 2, 0, ""), ("TOB", 1, 1, 0, "t"), (None, 1, 1, 0, "lost")], cols)
    donor = spark.createDataFrame([("GEN", 1, 1, 0, "other"), ("GEN", 1, 3, 0, "three"), ("EXO", 1, 1, 0, "exo�")], cols)
    out = convert.convert(src, canon, donor, "⟨missing⟩")
    assert {(r.usfm, r.v, r.text) for r in out["verses"].collect()} == {("GEN", 1, "a & b"), ("GEN", 2, "⟨missing⟩"), ("GEN", 3, "three"), ("EXO", 1, "exo�")}
    kinds = {(r.kind, r.usfm, r.chapter, r.verse) for r in out["disclosure"].collect()}
    assert kinds == {
        ("chapter_boundary", "GEN", None, None), ("verse_filled", "GEN", 1, 3), ("chapter_filled", "EXO", 1, None), ("missing_chapter", "GEN", 2, None),
        ("unfilled_gap", "GEN", 1, 2), ("lost_character", "EXO", 1, 1),
    }
    assert [tuple(r) for r in out["skipped"].collect()] == [("TOB", 1)] and out["problems"].count() == 1
    assert out["report"].first().entity_residue == 1 and out["report"].first().stray_delimiters == 2
    assert {(r.usfm, r.chapters, r.verses) for r in out["books"].collect()} == {("GEN", 1, 3), ("EXO", 1, 1)}


def test_names_anchors_merges(spark):
    canon = spark.createDataFrame([("1KI", "1 Kings"), ("PSA", "Psalms"), ("SNG", "Song of Songs")], "usfm string, name string")
    found = spark.createDataFrame([("I Kings",), ("Psalm",), ("songs",), ("Foo",)], "name string")
    assert {r.name: r.usfm for r in align.match_names(found, canon).collect()} == {"I Kings": "1KI", "Psalm": "PSA", "songs": "SNG", "Foo": None}
    first = spark.createDataFrame([("GEN", 1, "In the beginning"), ("GEN", 2, "he created"), ("EXO", 1, "x"), ("ZZZ", 1, "x")], "usfm string, v int, text string")
    anchors = spark.createDataFrame([("GEN", ["in the beginning", "created", "firmament"]), ("EXO", ["moses"])], "usfm string, tokens array<string>")
    assert {(r.usfm, r.hits, r.ok) for r in align.anchors_found(first, anchors).collect()} == {("GEN", 2, True), ("EXO", 0, False), ("ZZZ", None, None)}
    v = spark.createDataFrame([(1, 1, "a"), (1, 2, "b."), (1, 3, "c"), (1, 4, "d")], "ch int, v int, text string")
    out = align.fold_merges(v, spark.createDataFrame([(1, 2)], "ch int, expected int"), spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "ch int, source int, target int"), ["ch"])
    assert {(r.v, r.text) for r in out.collect()} == {(1, "a; c"), (2, "b.; d")}


def test_gates(spark):
    canon = spark.createDataFrame([(1, "Aa"), (2, "Bb")], "n int, short string")
    books = spark.createDataFrame([("x", 1, "Aa"), ("x", 2, "B b"), ("y", 1, "Bb"), ("z", 1, "Zz")], "edition string, n int, short string")
    assert {tuple(r) for r in gates.slug_gate(books, canon).collect()} == {("x", "B b", "shape"), ("x", "B b", "position"), ("z", "Zz", "unknown")}
    assert gates.bad_flags(spark.createDataFrame([("v1.2.3",), ("1.0",), (None,)], "tag string")).count() == 2
    assert [r.code for r in gates.unknown_codes(spark, ["a", "b"], spark.createDataFrame([("a",)], "code string")).collect()] == ["b"]


def test_anchor_check_has_english_openings_and_skips_others(spark):
    rows = [("GEN", 1, "In the beginning it was created"), ("GEN", 2, "over the firmament"), ("ROM", 1, "Nothing of the kind"), ("XXX", 1, "a")]
    first = spark.createDataFrame(rows, "usfm string, v int, text string")
    got = {r.usfm: (r.hits, r.ok, r.skipped) for r in align.anchor_check(first, "en").collect()}
    assert got == {"GEN": (3, True, None), "ROM": (0, False, None), "XXX": (None, None, "no anchors for this book")}
    assert {(r.ok, r.skipped) for r in align.anchor_check(first, "swe").collect()} == {(None, "no anchors for swe")}
    own = spark.createDataFrame([("ROM", ["kind", "nothing"])], "usfm string, tokens array<string>")
    assert {r.usfm: r.ok for r in align.anchor_check(first, "swe", own).collect()}["ROM"] is True


@pytest.mark.parametrize("dialect", ["usfx", "osis", "zefania"])
def test_each_dialect_drops_its_own_apparatus(dialect):
    """Every element of the dialect's sets goes with its content, those of other dialects keep theirs."""
    own = {"usfx": fixed.DROPPED_USFX, "osis": fixed.DROPPED_OSIS, "zefania": fixed.DROPPED_ZEFANIA}
    frame = {
        "usfx": "<usfx><book id='GEN'><c id='1'/><v id='1'/>Um {} x<ve/></book></usfx>",
        "osis": "<osis><osisText><div type='book' osisID='Gen'><chapter osisID='Gen.1'><verse osisID='Gen.1.1'>Um {} x</verse></chapter></div></osisText></osis>",
        "zefania": "<XMLBIBLE><BIBLEBOOK bnumber='1'><CHAPTER cnumber='1'><VERS vnumber='1'>Um {} x</VERS></CHAPTER></BIBLEBOOK></XMLBIBLE>",
    }
    for name in sorted(fixed.DROPPED.union(*own.values())):
        rows = D.parse(dialect, frame[dialect].format(f"<{name}>inner</{name}>"))
        gone = name in fixed.DROPPED | own[dialect]
        assert [r[3] for r in rows] == ["Um x" if gone else "Um inner x"], (dialect, name)


def test_tag_text():
    gone = frozenset(["note", "title"])
    cases = [("a <note>b</note> c", "a  c"), ("<title>x <i>y</i> z</title>w", "w"), ("p <add>q</add>", "p q"), ("<note/>r", "r"), ("<note><lb/>s<b>t</b></note>u", "u")]
    cases += [("a < b", "a  b"), (None, ""), ('<w a="x>y">v</w>', "v"), ("</note>k", "k"), ("<NOTE>m</note>n", "n")]
    for text, want in cases:
        assert U.py_tag_text(text, gone) == want, text
