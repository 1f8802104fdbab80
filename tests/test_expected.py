"""Queries that SQL can't express, against plain loops over the same tables."""

import difflib
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

from versemill.queries import ORACLES, QUERIES
from versemill.queries.editions import talk_pair

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("conversations", "documents"):
        c.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return c


def words(text):
    flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.findall("[a-z0-9]+", flat)


def sides(spark):
    return [[(r.chapter, r.v, r.text) for r in side.select("chapter", "v", "text").collect()] for side in talk_pair(spark, SF)]


def test_similarity_ledger(spark, duck):
    talks = sorted(duck.sql("SELECT conv_id, turn, min(text) FROM conversations GROUP BY ALL").fetchall())
    want = {(c, t): round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for (c, t, a), (d, _, b) in zip(talks, talks[1:]) if c == d}
    got = {(r.conv_id, r.turn): r.ratio for r in QUERIES["similarity_ledger"](spark, SF).collect()}
    assert got == want and len(want) > 20


def test_diff_ledger(spark):
    left, right = sides(spark)
    other, chapters = {(c, v): words(s) for c, v, s in right}, {}
    for (c, v), w in sorted(other.items()):
        chapters.setdefault(c, []).append((v, "".join(w)))
    want = {}
    for c, v, text in left:
        a, b = words(text), other.get((c, v), [])
        x, y = "".join(a), "".join(b)
        if a == b:
            kind = "identical"
        elif x == y:
            kind = "punctuation-only"
        elif difflib.SequenceMatcher(None, x, y).ratio() >= 0.90:
            kind = "orthographic"
        else:
            own = [q for q, z in chapters.get(c, []) if q != v and z and z in x]
            kind = f"misaligned->{own[0]}" if own else "substantive"
        want[c, v] = kind
    got = {(r.chapter, r.v): r["class"] for r in QUERIES["diff_ledger"](spark, SF).collect()}
    assert got == want and len(set(want.values())) >= 3


def test_realign_variants(spark):
    """Every row is checked by itself: verses on one side only, and word runs that stand in their verses and differ."""
    left, right = sides(spark)
    texts = [{(c, v): words(t) for c, v, t in side} for side in (left, right)]
    rows = QUERIES["realign_variants"](spark, SF).collect()
    for r in rows:
        mine, theirs = r.left_words.split(), r.right_words.split()
        if r["class"] in ("left-only", "right-only"):
            assert not mine and not theirs and (r.left_v is None) == (r["class"] == "right-only") and (r.right_v is None) == (r["class"] == "left-only")
            continue
        for side, key, own in ((texts[0], r.left_v, mine), (texts[1], r.right_v, theirs)):
            whole = side[r.chapter, key]
            assert any(whole[i : i + len(own)] == own for i in range(len(whole) + 1))
        near = bool(mine and theirs) and difflib.SequenceMatcher(None, "".join(mine), "".join(theirs)).ratio() >= 0.80
        assert mine != theirs and r["class"] == ("insert-delete" if not mine or not theirs else "near-miss" if near else "wording")
    # what any alignment of a chapter must leave over: letters of one side that the other hasn't
    for c in {c for c, _ in texts[0]}:
        a, b = (Counter(x for (d, _), ws in side.items() if d == c for w in ws for x in w) for side in texts)
        touched = Counter(x for r in rows if r.chapter == c for x in r.left_words.replace(" ", ""))
        alone = Counter(x for r in rows if r.chapter == c and r["class"] == "left-only" for w in texts[0][c, r.left_v] for x in w)
        assert not (a - b) - touched - alone
    assert {"wording", "insert-delete"} <= {r["class"] for r in rows}


def test_verify_editions(spark, duck):
    found = {(r.edition, r.check, r.title): r["count"] for r in QUERIES["verify_editions"](spark, SF).collect()}
    by_check = Counter()
    for (edition, check, _), n in found.items():
        by_check[edition, check] += n
    doubled = Counter()
    for d, in duck.sql(f"SELECT lang FROM ({ORACLES['doubled_text_kinds']}) JOIN documents USING (doc_id)").fetchall():
        doubled[d] += 1
    assert {e: by_check[e, "doubled_text"] for e in doubled} == dict(doubled)
    lost = dict(duck.sql("SELECT lang, count(*) FROM documents WHERE contains(text, chr(65533)) GROUP BY lang").fetchall())
    assert {e: n for (e, c), n in by_check.items() if c == "encoding" and e in lost}.keys() == lost.keys()
    reworded = dict(duck.sql("SELECT lang, count(*) FROM documents WHERE doc_id % 10 = 0 GROUP BY lang").fetchall())
    assert {e: found[e, "roundtrip", "verses with another wording"] for e in reworded} == reworded
