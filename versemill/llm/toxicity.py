"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores of the hits' context windows.

The lexicon holds terms (whole words and word stems) that stand in toxic training documents and hardly in others. The
automaton that accepts all words within the allowed edits of any term is the product of the trie with Levenshtein
automata, made deterministic state by state as texts need it. Around each hit a window of words and the quotation marks
tell reported speech from abuse. A logistic model over a document's hits gives the score.

Lexicon and weights are learned from a sample of at most SAMPLE labelled training rows, chosen by a hash of their ids; the lexicon has at
most TERMS terms.

Defined results: null is the empty text and has no hits; rows without a label or with one other than 0 or 1 are not learned from;
without toxic or without clean labels the fixed seed terms and weights stand; repeated rows count each; texts are scored whole whatever their
length; all columns of filtered documents stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import fold_of, raw_texts, texts, training_labels, words_of
from versemill.session import materialize, ship

FOLDS, HELD_OUT = 3, 1
SAMPLE = 12_000
TERMS = 400
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7)  # lengths of stems
STEM_FORMS = 4  # different words that a stem needs
SIGNS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)  # odd factors
ALIKE = 0.8  # share of runs from which texts are near copies
FUZZY_FROM = 5  # letters from which a term may have one edit
WINDOW = 6
# Abusive words that are in the lexicon unless the labels refute them, and words that report speech.
SEEDS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
CUES = frozenset([
    "say", "says", "said", "saying", "quote", "quoted", "quotes", "quoting", "called", "term", "word", "words", "phrase", "wrote", "writes",
    "written", "insult", "insults", "slur",
])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUOTES = "\"“”„«»‘’'"
SPACES = re.compile(r"\s")


class Trie:
    """Terms as (letters, is a stem); edits[node]: most edits that any term below allows."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.edits = [0]
        self.terms = terms
        self.allowed = [1 if len(t) >= FUZZY_FROM + stem else 0 for t, stem in terms]
        for k, (term, _) in enumerate(terms):
            node = 0
            self.edits[0] = max(self.edits[0], self.allowed[k])
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.edits.append(0)
                node = self.next[node][c]
                self.edits[node] = max(self.edits[node], self.allowed[k])
            self.ends[node].append(k)


class Matcher:
    """Deterministic automaton of the trie's terms with edits; its states are sets of (trie node, edits), found as needed."""

    MEMO, STATES = 200_000, 50_000

    def __init__(self, terms: list[tuple[str, bool]]):
        self.trie = Trie(terms)
        self._reset()
        self.memo: dict[bytes, tuple[int, int] | None] = {}

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple | None] = []  # (term, edits) that a state accepts as a whole word
        self.stems: list[tuple | None] = []  # the same, whatever follows
        self._id(frozenset())  # 0: no term can be met any more
        self.start = self._id(self._close({0: 0}))

    def _close(self, nodes: dict[int, int]) -> frozenset:
        """With letters of terms left out of the word: each one is an edit. Keeps the fewest edits of a node."""
        trie, stack = self.trie, list(nodes)
        while stack:
            node = stack.pop()
            e = nodes[node] + 1
            for child in trie.next[node].values():
                if e <= trie.edits[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    stack.append(child)
        return frozenset(nodes.items())

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            best: list[tuple | None] = [None, None]
            for node, e in sorted(state, key=lambda x: (x[1], x[0])):
                for k in self.trie.ends[node]:
                    if e <= self.trie.allowed[k]:
                        best[0] = best[0] or (k, e)
                        if self.trie.terms[k][1]:
                            best[1] = best[1] or (k, e)
            self.hits.append(best[0])
            self.stems.append(best[1])
        return self.ids[state]

    def _step(self, state: int, c: str) -> int:
        trie, out = self.trie, {}
        for node, e in self.sets[state]:
            child = trie.next[node].get(c)
            if child is not None and e <= trie.edits[child] and e < out.get(child, 99):
                out[child] = e
            if e + 1 <= trie.edits[node]:
                if e + 1 < out.get(node, 99):
                    out[node] = e + 1  # a letter too many
                for other in trie.next[node].values():  # another letter
                    if e + 1 <= trie.edits[other] and e + 1 < out.get(other, 99):
                        out[other] = e + 1
        to = self._id(self._close(out)) if out else 0
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the lexicon entry that a lower-case word meets, exact ones first, or None."""
        if len(self.sets) > self.STATES:
            self._reset()
        state, stem = self.start, None
        steps = self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                return stem
            found = self.stems[state]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        hit = self.hits[state]
        return min((x for x in (hit, stem) if x), key=lambda x: x[1], default=None)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(word number, term, edits) of all hits; remembers what words met."""
        memo = self.memo
        out = []
        for i, w in enumerate(words):
            try:
                got = memo[w]
            except KeyError:
                if len(memo) > self.MEMO:
                    memo.clear()
                got = memo[w] = self.match(w.decode())
            if got is not None:
                out.append((i, *got))
        return out


def quoted(text: str, at: list[int]) -> list[bool]:
    """For each word number: whether its window shows it as reported: quotation marks around it, or a reporting word near before it."""
    places = list(WORD.finditer(text))
    out = []
    for i in at:
        lo, hi = places[max(0, i - WINDOW)].start(), places[min(len(places) - 1, i + WINDOW)].end()
        before, after = text[lo : places[i].start()], text[places[i].end() : hi]
        marks = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        cue = any(places[j].group().lower() in CUES for j in range(max(0, i - 3), i))
        out.append(marks or cue)
    return out


N_FEATURES = 6


def features(matcher: Matcher, text: str, raw: bytes, clean: frozenset) -> list[float]:
    """Constant; exact and near hits as abuse; reported ones; hits by words; different terms."""
    words = words_of(raw)
    hits = [h for h in matcher.find(words) if words[h[0]] not in clean]
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    reported = quoted(text, [h[0] for h in hits])
    exact = sum(not r and not e for (_, _, e), r in zip(hits, reported))
    near = sum(not r and e > 0 for (_, _, e), r in zip(hits, reported))
    rate = 100 * (exact + near) / len(words)
    return [1.0, float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(sum(reported))), float(np.log1p(rate)), float(np.log1p(len({h[1] for h in hits})))]


def _term_counts(batches):
    """(word, toxic documents, clean documents) over a partition of labelled rows."""
    counts: dict[bytes, list[int]] = {}
    for b in batches:
        for raw, y in zip(raw_texts(b.column(0)), b.column(1).to_pylist()):
            for w in set(words_of(raw)):
                counts.setdefault(w, [0, 0])[1 - y] += 1
    rows = list(counts.items())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        cols = [pa.array([w.decode() for w, _ in part], pa.string()), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["word", "toxic", "clean"])


def _runs(raw: bytes) -> np.ndarray:
    """Hashes of a text's runs of three words, or of all its words if it has fewer."""
    w = words_of(raw)
    runs = zip(w, w[1:], w[2:]) if len(w) > 2 else [w]
    return np.array([xxhash.xxh64_intdigest(b" ".join(r)) for r in runs], dtype=np.uint64)


def _signatures(batches):
    """One hash of a text's least runs under each of the SIGNS: near copies mostly share it."""
    for b in batches:
        out = [xxhash.xxh64_intdigest((_runs(raw)[:, None] * SIGNS).min(axis=0).tobytes()) for raw in raw_texts(b.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(out, dtype=np.uint64).view(np.int64)), b.column(0), b.column(1)], ["signature", "text", "y"])


def _single(alike: pa.Table) -> pa.Table:
    """Texts of equal signature and label without those that share ALIKE or more of their runs with one that stays."""
    kept, sets = [], []
    for text in sorted(set(texts(alike.column("text")))):
        own = set(_runs(text.encode()).tolist())
        if not any(len(own & s) >= ALIKE * len(own | s) for s in sets):
            kept.append(text)
            sets.append(own)
    return pa.table({"text": pa.array(kept, pa.string()), "y": pa.array([alike.column("y")[0].as_py()] * len(kept), pa.int32())})


def choose_terms(sample: DataFrame) -> tuple[list[tuple[str, bool]], frozenset]:
    """Lexicon from labelled rows (text, y), and the harmless words of clean rows that meet a term by an edit or by a stem.

    A word or stem is a term if its share of toxic documents is far above its share of clean ones and so many have it that of all
    words less than one would get there by chance. That number grows with the logarithm of the vocabulary, not with the sample. The fixed
    seeds are terms unless the sample shows them in clean documents too.
    Near copies of one label count once, as what one text happens to say is no evidence however often it is copied; texts
    that only share a passage count each.
    """
    signed = sample.select("text", "y").mapInArrow(_signatures, "signature long, text string, y int")
    single = materialize(signed.groupBy("signature", "y").applyInArrow(_single, "text string, y int"), "toxicity-single")
    n = single.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    toxic, clean = n.toxic, n.clean
    counts = single.mapInArrow(_term_counts, "word string, toxic long, clean long")
    words = materialize(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    pure = lambda least: (F.col("toxic") >= least) & ((F.col("clean") + 0.5) / clean * 20 < (F.col("toxic") + 0.5) / toxic)
    chance = np.log(max(words.count(), 2)) / np.log((toxic + clean) / toxic)
    least = max(4, int(np.ceil(chance)))
    stems = words.select("*", F.explode(F.array(*[F.lit(n) for n in STEMS])).alias("n")).filter(F.length("word") >= F.col("n"))
    stems = stems.groupBy(F.expr("substring(word, 1, n)").alias("word")).agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("forms")
    )
    best = [F.desc(F.col("toxic") * clean - 20 * F.col("clean") * toxic), F.asc("word")]
    top_stems = stems.filter(pure(least) & (F.col("forms") >= STEM_FORMS)).orderBy(*best).limit(TERMS).collect()
    top_words = words.filter(pure(least) & (F.length("word") >= 3)).orderBy(*best).limit(TERMS * 4).collect()
    chosen: list[str] = []
    for r in sorted(top_stems, key=lambda r: len(r.word)):
        if not any(r.word.startswith(s) for s in chosen):
            chosen.append(r.word)
    share = lambda r: (r.clean + 0.5) / clean * 20 < (r.toxic + 0.5) / toxic
    refuted = {r.word for r in words.filter(F.col("word").isin(SEEDS)).collect() if not share(r)}
    terms = [(w, False) for w in SEEDS if w not in refuted] + [(s, True) for s in chosen]
    for r in top_words:
        if len(terms) < TERMS and r.word not in SEEDS and not any(r.word.startswith(s) for s in chosen):
            terms.append((r.word, False))
    matcher_terms, whole = list(terms), {w for w, stem in terms if not stem}

    def near(batches):
        matcher = Matcher(matcher_terms)
        for b in batches:
            met = [w not in whole and matcher.match(w) is not None for w in b.column(0).to_pylist()]
            yield b.filter(pa.array(met, pa.bool_()))

    forms = words.filter((F.col("clean") > 0) & (F.col("clean") * 4 >= F.col("toxic"))).select("word").mapInArrow(near, "word string")
    return terms, frozenset(r.word.encode() for r in forms.collect())  # the sample bounds them


#: Weights where there is nothing to learn from, in the order of features().
DEFAULT = np.array([-4.0, 4.0, 1.5, -0.5, 1.0, 2.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms, clean, weights):
        self.terms, self.clean, self.weights = terms, clean, weights

    def scores(self, column, matcher: Matcher) -> np.ndarray:
        x = np.array([features(matcher, t, t.encode(), self.clean) for t in texts(column)]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", bound: int = SAMPLE) -> Model:
    """Model from at most `bound` labelled training rows; their ids are broadcast, so no text is shuffled."""
    ids = training_labels(labels, label_col, fold_of("doc_id", FOLDS) != HELD_OUT, bound, "toxicity-ids")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = materialize(src.join(F.broadcast(ids), "doc_id").select("text", "y"), "toxicity-sample")
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model([(w, False) for w in SEEDS], frozenset(), DEFAULT)
    terms, near = choose_terms(sample)

    def run(batches):
        matcher = Matcher(terms)
        for b in batches:
            x = [features(matcher, t, t.encode(), near) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").collect()  # at most `bound` short rows
    x, t = np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float)
    return Model(terms, near, logistic(x, t))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    ship(docs.sparkSession)
    model = fit(docs, labels)

    def run(batches):
        matcher = Matcher(model.terms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1), matcher), pa.float64())], ["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = src.mapInArrow(run, "doc_id long, score double")
    held = (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns: each row is judged where it is, so nothing is shuffled."""
    ship(docs.sparkSession)
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        matcher = Matcher(model.terms)
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at), matcher) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
