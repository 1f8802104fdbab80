import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from versemill.llm.bpe import ADDED, ADDED_ID, chunks, encoder, vocabulary
from versemill.llm.packing import Schedule, pack, queue_totals
from versemill.llm.tokencount import TokenTree, sample_edits, token_counts

SNIPPETS = ["word", " the", "  ", "\n", "\n\n", " \n", "\t", "é", "ß!", "don't", "'s", "123", "  x", " ", "中文", "a" * 30, " , ", "", "😀", "$$$", "<|endoftext|>", " ", "<|endof", "text|>", "<|"]


def random_text(rng, n=30):
    return "".join(rng.choice(SNIPPETS) for _ in range(rng.randrange(n)))


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_public_tokenizer(plain):
    rng, enc = random.Random(1), encoder(vocabulary())
    for _ in range(600):
        text = random_text(rng)
        assert np.frombuffer(enc.ids(text), dtype="<u2").tolist() == plain(text), repr(text)


def test_chunks_are_encoded_by_themselves(plain):
    rng, enc = random.Random(12), encoder()
    for _ in range(300):
        text = random_text(rng, 400)
        parts = chunks(text)
        assert "".join(parts) == text
        assert sum((enc.plain(x) for x in parts), []) == plain(text), repr(text)
    assert len(chunks("word " * 100)) > 6 and chunks("") == [] and chunks("x" * 500) == ["x" * 500]
    assert len(chunks("x" * 3_000_000)) == 1 and len(chunks("  x" * 1_000_000)) == 1  # in linear time


def test_the_added_token(plain):
    enc = encoder()
    for text in (ADDED, f"a {ADDED} b", f"{ADDED}{ADDED}", f"  {ADDED}  ", f"!!{ADDED}!!", f"x\n\n{ADDED}\n", ADDED[:-1], ADDED[1:], f"<|{ADDED}|>"):
        assert np.frombuffer(enc.ids(text), dtype="<u2").tolist() == plain(text), text
        assert "".join(enc.split(text)) == text
    assert plain(ADDED) == [ADDED_ID]
    tree = TokenTree("some words <|endof", enc)
    assert tree.edit(18, 18, "text|> and more") == len(plain(f"some words {ADDED} and more"))
    assert tree.edit(13, 14, "") == len(plain("some words <|ndoftext|> and more"))


def test_edits_equal_counting_anew():
    rng, enc = random.Random(2), encoder(vocabulary())
    for trial in range(150):
        text = random_text(rng, 200)
        tree = TokenTree(text, enc)
        for _ in range(8):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.randrange(12))
            new = random_text(rng, rng.choice([1, 4, 4, 300]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text
            assert tree.n_tokens == len(enc.plain(text)), (trial, repr(text))


def test_edits_encode_little(spark):
    enc = encoder(vocabulary())
    text = " ".join(f"word{i}" for i in range(5000))
    tree = TokenTree(text, enc)
    for e in sample_edits(len(text), text):
        tree.edit(*e)
    assert tree.encoded < len(text) / 20


def test_count_query(spark):
    rng, enc = random.Random(3), encoder(vocabulary())
    rows = [(i, random_text(rng, 100)) for i in range(40)] + [(90, None), (91, ""), (3, "twice"), (3, "twice")]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for doc_id, text in rows:
        text = new = text or ""
        for a, b, put in sample_edits(len(text), text):
            b = min(b, len(new))
            new = new[:a] + put + new[max(a, b) :]
        want.append((doc_id, len(text), len(enc.plain(text)), len(new), len(enc.plain(new))))
    assert sorted((r.doc_id, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in out) == sorted(want)


def test_schedule_meets_targets_and_carries_deficits():
    for totals in ([5000, 3000, 701, 17], [1], [2048], [40, 3]):
        s = Schedule(totals, 64 if min(totals) * 64 >= sum(totals) else sum(totals))
        given = s.given(np.arange(s.windows + 1))
        assert (np.diff(given, axis=0) >= 0).all()
        assert (given.sum(axis=1) == np.minimum(np.arange(s.windows + 1) * s.length, sum(totals))).all()
        exact = np.minimum(np.arange(s.windows + 1) * s.length, sum(totals))[:, None] * np.array(totals) / sum(totals)
        assert (np.abs(given - exact) < 1).all()
    big = Schedule([2**40, 2**41, 2**33 + 1], 2048)
    assert big.given(np.array([10**8, 10**8 + 1])).sum(axis=1).tolist() == [2048 * 10**8, 2048 * (10**8 + 1)]


def played(totals, weights, length):
    """Tokens given before each window, played with exact fractions: credit, whole tokens, then the largest deficits."""
    ideal, out = [Fraction(0)] * len(totals), [[0] * len(totals)]
    while sum(out[-1]) < sum(totals):
        room = Fraction(min(length, sum(totals) - sum(out[-1])))
        while room:
            live = [q for q, w in enumerate(weights) if w and ideal[q] < totals[q]] or [q for q in range(len(totals)) if ideal[q] < totals[q]]
            w = {q: weights[q] or 1 for q in live}
            step = min(room, *((totals[q] - ideal[q]) * sum(w.values()) / w[q] for q in live))
            for q in live:
                ideal[q] += step * w[q] / sum(w.values())
            room -= step
        own = [int(x) for x in ideal]
        left = round(sum(ideal)) - sum(own)
        live_weight = [x - int(x) for x in ideal]
        for q in sorted(range(len(own)), key=lambda q: (-live_weight[q], q))[:left]:
            own[q] += 1
        out.append(own)
    return out


def test_schedule_equals_the_played_one():
    rng = random.Random(8)
    for _ in range(400):
        n, length = rng.randrange(1, 6), rng.choice([16, 64])
        totals = [rng.randrange(1, 900) for _ in range(n)]
        weights = rng.choice([totals, [rng.randrange(1, 10) for _ in range(n)], [*[rng.randrange(1, 5) for _ in range(n - 1)], 0]])
        if any(0 < w * length < sum(weights) for w in weights):
            continue
        s = Schedule(totals, length, weights)
        given = s.given(np.arange(s.windows + 1))
        assert given.tolist() == played(totals, weights, length), (totals, weights, length)
        assert (np.diff(given, axis=0) >= 0).all() and given[-1].tolist() == totals
        for q, t in enumerate(totals):
            for at in range(0, t, 7):
                w = s.window_of(q, at)
                assert given[w][q] <= at, (totals, weights, q, at)


def test_pack_to_targets(spark):
    rows = [(i, "word " * 50, "abc"[i % 3] if i % 10 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = pack(df, length=256, targets={"a": 0.5, "b": 0.25}).collect()
    source, n, whole = {d: s for d, _, s in rows}, {}, {}
    for p in pieces:
        n[p.sequence_id, source[p.doc_id]] = n.get((p.sequence_id, source[p.doc_id]), 0) + p.length
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert all(whole[p.doc_id] == p.doc_tokens for p in pieces) and len(whole) == len(rows)
    total = {s: sum(v for (_, x), v in n.items() if x == s) for s in ("a", "b")}
    dry = int(total["a"] * 1.5) // 256  # a runs dry first
    assert all(abs(n[w, "a"] - 256 * 2 / 3) <= 1 and abs(n[w, "b"] - 256 / 3) <= 1 for w in range(dry))
    late = {w for (w, s) in n if s in ("c", None)}
    assert min(late) >= (total["a"] + total["b"]) // 256
    with pytest.raises(ValueError):
        pack(df, length=256, targets={"a": 1, "b": 0.001})


def test_small_sources_share_a_queue():
    assert queue_totals([5000, 5000], 3, 100) == [5000, 5003]
    assert queue_totals([5000, 5000], 500, 100) == [5000, 5000, 500]
    assert queue_totals([], 7, 2) == [7]
    assert queue_totals([5, 5], 0, 2) == [5, 5]


def test_pack_round_trip(spark, plain):
    rng = random.Random(4)
    rows = [(i, random_text(rng, 120), rng.choice(["a", "a", "a", "b", None]), 1) for i in range(150)]
    rows += [(500, None, "a", 1), (501, "", "tiny", 1), (502, "word " * 6000, "a", 2)] + [(3, "twice", "b", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, part int").repartition(5)
    pieces = pack(df, with_ids=True).collect()
    ids = {}
    for doc_id, text, *_ in rows:
        ids[doc_id] = plain(text or "") + [1]
    total = sum(len(plain(t or "")) + 1 for _, t, *_ in rows)
    assert sum(p.length for p in pieces) == total
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        if p.doc_id != 3:
            assert p.ids == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
    assert sorted(by_seq) == list(range(-(-total // 2048)))
    for s, own in by_seq.items():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at == 2048 or s == max(by_seq)
    for d in set(ids) - {3}:
        spans = sorted((p.start, p.length) for p in pieces if p.doc_id == d)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == len(ids[d])


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
