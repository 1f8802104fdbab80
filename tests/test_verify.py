"""Mutations of a small edition: each must fire its check and leave others alone."""

import pytest
from pyspark.sql import functions as F

from versemill.functions import fixed
from versemill.plans import verify as V

TEXT = "Lá na colina velha a lanterna verde brilhou. E o rio lento levou a canção até a ponte de pedra."


class Edition:
    def __init__(self, name):
        self.name = name
        self.verses = {(u, 1, 1, 0): TEXT for u in fixed.BOOK_IDS}
        self.source = dict(self.verses)
        self.books = {n: [u, f"Bk{n:02}", 1, 1] for n, u in enumerate(fixed.BOOK_IDS, 1)}
        self.disclosure, self.report, self.sanitize, self.file = [], [66, 66], {}, "por.xml"
        self.problems = []


def findings(spark, editions):
    """All editions in one plan: checks are by edition."""
    rows = lambda e, d: [(e.name, fixed.BOOK_IDS.index(u) + 1, u, c, v, p, t) for (u, c, v, p), t in d.items()]
    table = lambda rows, cols: spark.createDataFrame(rows, cols).coalesce(2)
    cols = "edition string, n int, usfm string, chapter int, v int, pos int, text string"
    verses = table([r for e in editions for r in rows(e, e.verses)], cols)
    source = table([(*r, None) for e in editions for r in rows(e, e.source)] + [x for e in editions for x in e.problems], cols + ", problem string")
    books = table([(e.name, n, u, short, c, k) for e in editions for n, (u, short, c, k) in e.books.items()], "edition string, n int, usfm string, short string, chapters int, verses int")
    canon = table([(n, u, f"Bk{n:02}", 1, 1) for n, u in enumerate(fixed.BOOK_IDS, 1)], "n int, usfm string, short string, chapters int, verses int")
    disclosure = table([(e.name, *d) for e in editions for d in e.disclosure], "edition string, usfm string, chapter int, verse int")
    report = table(
        [(e.name, "por", e.file, *e.report, [(n, 1, 1) for n in e.books], e.sanitize) for e in editions],
        "edition string, lang string, source string, total_chapters bigint, total_verses bigint, books array<struct<n: int, chapters: int, verses: int>>, sanitize map<string, bigint>",
    )
    vetted = table([("por", "raw/por.xml")], "code string, file string")
    out = {e.name: set() for e in editions}
    for r in V.verify(verses, books, canon, disclosure, report, source, vetted, F.lit("por")).collect():
        out[r.edition].add((r.check, r.severity))
    return out


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


GEN = ("GEN", 1, 1, 0)


def both(e, text):
    e.verses[GEN] = e.source[GEN] = text


def _doubled(e):
    e.verses[GEN] = TEXT + " " + TEXT


def _removed(e):
    del e.verses[GEN]


def _slug(e):
    e.books[1][1] = "é"
    e.books[2][1] = "a b"
    e.books[3][1] = e.books[4][1]


def _gap(e, told):
    both(e, "")
    if told:
        e.disclosure.append(("GEN", 1, 1))


def _holes(e):
    e.verses[("GEN", 1, 3, 1)] = e.source[("GEN", 1, 3, 1)] = e.verses[("GEN", 1, 1, 0)]
    e.books[1][3] = 2
    e.report[1] = 67


def _dup(e):
    e.verses[("GEN", 1, 1, 1)] = TEXT


def _c1(e):
    both(e, TEXT + "\u0092")
    e.sanitize = {"c1_mojibake": 4}


CASES = {
    "clean": (lambda e: None, set(), {"structure", "roundtrip", "script", "encoding", "doubled_text"}),
    "doubled": (_doubled, {("doubled_text", "fail"), ("roundtrip", "fail")}, {"missing_verses"}),
    "repeat in source": (lambda e: both(e, TEXT + " " + TEXT), {("doubled_text", "warn")}, {"missing_verses", "roundtrip"}),
    "removed": (_removed, {("missing_verses", "fail"), ("structure", "fail")}, {"gaps"}),
    "forbidden": (lambda e: both(e, TEXT + " {x} \u0007"), {("forbidden_tokens", "fail")}, {"roundtrip"}),
    "markup": (lambda e: both(e, TEXT + " &quot;<q>x</q>"), {("markup_residue", "fail")}, {"roundtrip"}),
    "slugs": (_slug, {("short_slug", "fail"), ("short_slug", "warn")}, {"structure"}),
    "undisclosed": (lambda e: _gap(e, False), {("undisclosed_gap", "fail")}, {"gaps"}),
    "disclosed": (lambda e: _gap(e, True), {("gaps", "warn")}, {"undisclosed_gap"}),
    "stale": (lambda e: e.disclosure.append(("GEN", 1, 1)), {("gaps", "warn")}, {"undisclosed_gap"}),
    "hole in source too": (_holes, {("edition_versification", "warn"), ("versification", "warn")}, {"structure"}),
    "duplicate": (_dup, {("structure", "fail")}, {"roundtrip"}),
    "catalogue": (lambda e: e.books[1].__setitem__(2, 99), {("structure", "fail")}, {"roundtrip"}),
    "report": (lambda e: e.report.__setitem__(0, 99), {("report_reconciliation", "fail")}, {"structure"}),
    "claimed repair": (_c1, {("report_reconciliation", "fail"), ("encoding", "fail"), ("forbidden_tokens", "fail")}, set()),
    "lost letter": (lambda e: both(e, TEXT + "�"), {("encoding", "fail")}, {"roundtrip"}),
    "decomposed": (lambda e: both(e, "Lá na colina té " + TEXT), {("encoding", "fail")}, {"roundtrip"}),
    "wording": (lambda e: e.source.__setitem__(GEN, "Another wording here."), {("roundtrip", "fail")}, {"missing_verses"}),
    "provenance": (lambda e: setattr(e, "file", "other.xml"), {("provenance", "warn")}, {"structure"}),
    "lost source verse": (lambda e: e.problems.append((e.name, None, None, None, 1, 9, "x", "verse outside any book")), {("source_parse", "fail")}, {"structure"}),
}


@pytest.fixture(scope="module")
def found(spark):
    editions = [Edition(name) for name in CASES]
    for e in editions:
        CASES[e.name][0](e)
    return findings(spark, editions)


@pytest.mark.parametrize("case", CASES)
def test_mutation(found, case):
    _, fires, silent = CASES[case]
    assert fires <= found[case], found[case]
    assert not {c for c, _ in found[case]} & silent, found[case]
    if case == "clean":
        assert not found[case], found[case]


def test_wrong_script_and_english(spark):
    rows = [("a", "And the people that were there have heard this from them"), ("b", "Это обычный русский текст"), ("c", "123")]
    df = spark.createDataFrame(rows, "edition string, text string")
    got = {(r.edition, r.severity, r.title) for r in V.check_script(df, F.lit("rus")).collect()}
    assert ("a", "fail", "another script") in got and ("a", "fail", "English function words") in got and ("c", "fail", "no letters") in got
    assert not [g for g in got if g[0] == "b"]


def test_verdicts_rank_failures_above_warnings(spark):
    rows = [("a", "x", "warn"), ("b", "x", "warn"), ("b", "y", "fail"), ("c", "z", "info")]
    df = spark.createDataFrame(rows, "edition string, check string, severity string")
    v = V.verdicts(df)
    assert {(r.edition, r.worst, r.exit) for r in v.collect()} == {("a", "warn", 2), ("b", "fail", 1), ("c", "info", 0)}
    assert V.batch_exit(v).first().exit == 1 and V.batch_exit(v.filter("edition <> 'b'")).first().exit == 2
