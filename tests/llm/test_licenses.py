import random

import pytest

from versemill.llm.common import words_of
from versemill.llm.licence_texts import TEXTS
from versemill.llm.licenses import LEAST_COVER, PHRASES, Automaton, Scanner, read_templates, scan_licenses


def brute(text, phrases=PHRASES):
    words = words_of(text.encode())
    out = []
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def test_matching_statistics_against_brute_force():
    rng = random.Random(3)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(4)]
    a = Automaton(seqs)
    factors = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        x = [rng.randrange(3) for _ in range(6)]
        state, ok = 0, True
        for w in x:
            state = a.next[state].get(w)
            if state is None:
                ok = False
                break
        assert ok == (tuple(x) in factors)


def test_places_against_brute_force():
    rng = random.Random(5)
    vocab = "mit license apache general public the under version 2 other LICENSE".split()
    scanner = Scanner()
    for _ in range(500):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))
        assert sorted(scanner.scan(text.encode()).places) == brute(text), text


def test_spans_cover_a_reworded_template():
    s = Scanner().scan(b"Intro. Licensed under the very Apache License, Version 2.0. End.")
    assert [x[2] for x in s.spans] == ["apache-2.0-notice"]
    assert s.spans[0][:2] == (1, 10)


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_every_whole_text_is_found_where_it_stands():
    scanner = Scanner()
    before, after = [f"before{i}" for i in range(40)], [f"after{i}" for i in range(40)]
    for label, text in TEXTS.items():
        words = [w.decode() for w in words_of(text.encode())]
        found = scanner.scan(" ".join(before + words + after).encode()).spans
        own = [s for s in found if s[2] == label]
        assert own == [(40, 40 + len(words), label, 1.0)]


def test_spans_of_reworded_texts_against_the_longest_common_words():
    """Some words gone, put in or changed: the text is still found, at its place, and no span claims more than the words in common."""
    rng, scanner = random.Random(11), Scanner()
    for label, text in TEXTS.items():
        template = [w.decode() for w in words_of(text.encode())]
        if len(template) < 60:
            continue
        for _ in range(4):
            words = list(template)
            for _ in range(len(template) // 40):
                i = rng.randrange(5, len(words) - 5)
                rng.choice([lambda: words.pop(i), lambda: words.insert(i, "new"), lambda: words.__setitem__(i, "other")])()
            all_words = [f"a{i}" for i in range(30)] + words + [f"b{i}" for i in range(30)]
            spans = scanner.scan(" ".join(all_words).encode()).spans
            best = [s for s in spans if s[2] == label]
            assert best and abs(best[0][0] - 30) <= 3 and abs(best[0][1] - 30 - len(words)) <= 3, label
            for first, end, name, cover in spans:
                other = [w.decode() for w in words_of(TEXTS[name].encode())]
                assert LEAST_COVER <= cover <= common(all_words[first:end], other) / len(other) + 1e-9


def test_licences_that_differ_in_a_part_are_told_apart():
    scanner = Scanner()
    labels = lambda text: {x[2] for x in scanner.scan(text.encode()).spans}
    assert "bsd-3-clause" in labels(TEXTS["bsd-3-clause"]) and "bsd-3-clause" not in labels(TEXTS["bsd-2-clause"])
    assert "mit" not in labels(TEXTS["mit-0"]) and "lgpl-3.0-or-later" not in labels(TEXTS["gpl-3.0-or-later"])
    assert not labels("All rights reserved") and not labels("this software is fine and the license is not")


def test_own_templates_from_files(spark, tmp_path):
    (tmp_path / "House-1.0.txt").write_text("You may read this text aloud at home but nowhere else and never after ten.")
    templates = read_templates(spark, str(tmp_path))
    with pytest.raises(ValueError):
        read_templates(spark, str(tmp_path), most_bytes=10)
    rows = [(1, "So: you may read this text aloud at home but nowhere else and never after ten, mit license"), (2, "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(df, templates=templates).collect()}
    assert got == {1: ("house-1.0,mit", 1.0), 2: ("", 0.0)}


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "x MIT License y mit-license"), (3, "x MIT License y mit-license"), (4, "word " * 50_000)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert got == [(1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 6, 2, 1, 4, "mit"), (3, 6, 2, 1, 4, "mit"), (4, 50_000, 0, None, None, "")]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
