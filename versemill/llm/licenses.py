"""License scans: a generalised suffix automaton of licence templates.

Templates are word sequences under a label. The automaton accepts every run of words that occurs in any template. A text is
streamed through it once: at each word the state and the length of the longest run that ends there and occurs in a template (the
matching statistic) are known. Templates of the kind `phrase` are reported at every place where the whole phrase
ends, read from the state. Of the others, runs that can't be extended are chained in order of both text and
template into spans; a span is reported if it covers enough of its template. Templates are the texts of licence_texts.py unless others are given,
such as whole long licences from files (read_templates).

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each give a row; texts are read whole whatever their
length; an empty table gives an empty result; columns other than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.llm.common import raw_texts, words_of
from versemill.llm.licence_texts import TEXTS
from versemill.session import ship

# The base phrases, by label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MOST_WORDS = 500_000  # of templates: what a scan sends to the executors
LEAST_RUN = 2  # words of a run that takes part in a chain
MOST_GAP = 6  # words between two runs of a chain, in the text or the template
LEAST_COVER = 0.8  # of a template's words


class Automaton:
    """Generalised suffix automaton over word ids; endings[s] are the (template, end) places of state s."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(sequences):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, w, own)
                own[last].append((t, end))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        self.own = own
        self.endings = [list(x) for x in own]
        for s in order:  # a shorter run ends wherever a longer one that it is a suffix of ends
            self.endings[self.link[s]].extend(self.endings[s])
        self.endings[0] = []

    def _new(self, length: int, edges: dict[int, int], link: int, own: list) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        own.append([])
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int, own: list) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, own: list) -> int:
        q = self.next[last].get(w)
        if q is not None:  # a run that an earlier template has as well
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, own)
        new = self._new(self.length[last] + 1, {}, 0, own)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, own)
        return new


@dataclass
class Scan:
    """What one text holds: places (start word, phrase label) and spans (start word, end word, label, share of the template)."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[int, int, str, float]] = field(default_factory=list)


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEXTS):
        self.items = [(label, words_of(text.encode()), True) for text, label in phrases.items()]
        self.items += [(label, words_of(text.encode()), False) for label, text in templates.items()]
        self.vocab: dict[bytes, int] = {}
        sequences = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words, _ in self.items]
        self.automaton = a = Automaton(sequences)
        #: The phrases that end wherever a state's longest run ends, with their lengths: its own and those of its suffixes.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in a.length]
        for s in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            whole = [t for t, end in a.own[s] if self.items[t][2] and end == len(self.items[t][1])]
            self.phrases[s] = [(len(self.items[t][1]), self.items[t][0]) for t in whole] + self.phrases[a.link[s]]

    def scan(self, raw: bytes) -> Scan:
        words = words_of(raw)
        out = Scan(len(words))
        a, get = self.automaton, self.vocab.get
        edges, link, length, phrases = a.next, a.link, a.length, self.phrases
        state = run = 0
        runs: list[tuple[int, int, int]] = []  # end, words, state of runs that can't be extended
        for i, w in enumerate(map(get, words)):
            if w is None:
                if run >= LEAST_RUN:
                    runs.append((i, run, state))
                state = run = 0
                continue
            to = edges[state].get(w)
            if to is None:
                if run >= LEAST_RUN:
                    runs.append((i, run, state))
                while state and to is None:
                    state = link[state]
                    run = length[state]
                    to = edges[state].get(w)
                if to is None:
                    run = 0
                    continue
            state, run = to, run + 1
            while length[link[state]] >= run and state:  # the run is as short as those of the state's suffix
                state = link[state]
            if phrases[state]:
                out.places += [(i + 1 - n, label) for n, label in phrases[state] if run >= n]
        if run >= LEAST_RUN:
            runs.append((len(words), run, state))
        if runs:
            out.spans = self._chain(runs)
        return out

    def _chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Per template, greedy chains of runs in increasing text and template order without overlap."""
        chains: dict[int, list[list[int]]] = {}  # template -> open chains [text start, text end, template end, matched words]
        done: list[tuple[int, list[int]]] = []
        for end, n, state in runs:
            best: dict[int, tuple] = {}
            for t, place in self.automaton.endings[state]:
                if self.items[t][2]:
                    continue
                choices = [(n, None, 0)]
                for c in chains.get(t, []):
                    cut = max(0, c[2] - (place - n), c[1] - (end - n))  # words of the run that the chain has already
                    if cut < n and place > c[2] and end - n + cut - c[1] <= MOST_GAP and place - n + cut - c[2] <= MOST_GAP:
                        choices.append((c[3] + n - cut, c, cut))
                got = max(choices, key=lambda x: x[0])
                if t not in best or got[0] > best[t][0]:
                    best[t] = (*got, place)
            for t, (matched, chain, _, place) in best.items():
                if chain is None:
                    chains.setdefault(t, []).append([end - n, end, place, matched])
                else:
                    chain[1:] = [end, place, matched]
            for t in list(chains):
                old = [c for c in chains[t] if end - c[1] > MOST_GAP + len(self.items[t][1])]
                done += [(t, c) for c in old]
                chains[t] = [c for c in chains[t] if c not in old]
        done += [(t, c) for t, cs in chains.items() for c in cs]
        spans = [(c[0], c[1], self.items[t][0], c[3] / len(self.items[t][1])) for t, c in done]
        return sorted(s for s in spans if s[3] >= LEAST_COVER)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first: long, last: long, label: string, cover: double>>"
)


def _scan_batches(templates: dict[str, str]):
    return lambda batches: _scanned(batches, Scanner(templates=templates))


def _scanned(batches, scanner: Scanner):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])))]
    )
    for b in batches:
        rows = []
        for doc_id, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
            s = scanner.scan(raw)
            starts = [p for p, _ in s.places]
            base = {label for _, label in s.places}
            cover = max([c for *_, c in s.spans], default=0.0)
            rows.append(
                {
                    "doc_id": doc_id,
                    "n_words": s.n_words,
                    "n_base": len(starts),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | {x[2] for x in s.spans})),
                    "score": min(1.0, max(cover, 0.5 if starts else 0.0)),
                    "spans": [{"first": f, "last": e - 1, "label": label, "cover": c} for f, e, label, c in s.spans],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_templates(spark: SparkSession, path: str, most_bytes: int = 10 * MOST_WORDS) -> dict[str, str]:
    """Licence texts of the files below a path, by lower-case file name without extension; too many bytes of them are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if (files.agg(F.sum("length")).first()[0] or 0) > most_bytes:
        raise ValueError(f"templates have more than {most_bytes} bytes")
    name = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:txt|md)$", ""))
    return {r.label: r.text for r in files.select(name.alias("label"), F.decode("content", "UTF-8").alias("text")).collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base phrase places, labels, score and template spans; one pass, no shuffle.

    score: the largest share of a template that a span covers, at least 0.5 where a base phrase stands, else 0.
    """
    ship(docs.sparkSession)
    templates = TEXTS if templates is None else templates
    if sum(len(words_of(t.encode())) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_scan_batches(templates), SCHEMA)
