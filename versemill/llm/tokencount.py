"""Edit-aware token counts: a segment tree of pre-tokens per document.

A document's leaves are slots of whole pre-tokens, each with its length and token count: chunks cut at spaces, or runs of
SLOT pre-tokens where there are none. A binary tree over the slots holds subtree sums of both. An edit touches the slots that it
overlaps and those within the context that a pre-token boundary may look at. Only their text is split and encoded again, up to the first
old slot boundary that is still a pre-token boundary, and the sums on the paths above are updated.

Splitting is left to right and looks beyond a pre-token's end at most two characters, or as many as the string of the vocabulary's added
token has, so what ends CONTEXT characters before an edit stays, and what starts at a boundary after it stays as well: counts equal
those of encoding the edited text anew.

Defined results: null is the empty text and has no tokens; edits beyond the text's ends are cut to it; repeated rows each
give a row; an empty table gives an empty result; columns other than doc_id and text are not looked at, whatever their names. Texts are
counted whole: a task holds one document's tree at a time, about ten bytes for each character.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.bpe import ADDED, Encoder, chunks, encoder
from versemill.llm.common import texts
from versemill.session import ship

SLOT = 16  # pre-tokens of a slot where a text has no spaces, or where an edit has made new ones
LONG = 1024  # characters beyond which a chunk is cut into pre-tokens
CONTEXT = len(ADDED) + 2  # characters before an edit that belong to its region
AHEAD = 64  # characters after a region that the split may look at


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, text: str, enc: Encoder):
        self.enc = enc
        self.encoded = 0  # characters encoded by edits
        self.slots: list[str] = []
        counts: list[int] = []
        for chunk in chunks(text):
            if len(chunk) <= LONG:
                self.slots.append(chunk)
                counts.append(len(enc.plain(chunk)))
            else:  # no space to cut at: runs of pre-tokens
                leaves = enc.split(chunk)
                own = [leaves[i : i + SLOT] for i in range(0, len(leaves), SLOT)]
                self.slots += ["".join(x) for x in own]
                counts += [sum(len(enc.plain(y)) for y in x) for x in own]
        self._build(list(zip(map(len, self.slots), counts)))

    def _build(self, sizes) -> None:
        """Sums over slots of (characters, tokens)."""
        self.width = 1
        while self.width < len(sizes):
            self.width *= 2
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        if len(sizes):
            self.sums[self.width : self.width + len(sizes)] = sizes
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.slots)

    def _find(self, at: int) -> tuple[int, int]:
        """The slot that holds a character, and the characters before that slot."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if at - before >= left:
                before += left
                node += 1
        return min(node - self.width, max(0, len(self.slots) - 1)), before

    def _update(self, slot: int, chars: int, tokens: int) -> None:
        node = self.width + slot
        self.sums[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _after(self, slot: int) -> str:
        """Text after a slot: enough for a split to end, with a character that is no white space unless none is left."""
        out = ""
        while slot + 1 < len(self.slots) and (len(out) < AHEAD or not out.strip()):
            slot += 1
            out += self.slots[slot]
        return out

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) by `new`; the new token count."""
        n = self.n_chars
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        if not self.slots:
            self.__init__(new, self.enc)
            self.encoded += len(new)
            return self.n_tokens
        first, before = self._find(max(0, start - CONTEXT))
        last, last_before = self._find(max(start, end - 1)) if end > start or start < n else (len(self.slots) - 1, 0)
        last = max(first, last)
        region = "".join(self.slots[first : last + 1])
        region = region[: start - before] + new + region[end - before :]
        while True:
            leaves = self.enc.split(region + self._after(last))
            ends = list(accumulate(map(len, leaves), initial=0))
            if len(region) in ends:
                break
            last += 1
            region += self.slots[last]
        leaves = leaves[: ends.index(len(region))]
        counts = [len(self.enc.plain(x)) for x in leaves]
        self.encoded += len(region)
        room = last - first + 1
        per = -(-len(leaves) // room)
        if per > 8 * SLOT:  # a large insertion: new slots
            sizes = [tuple(x) for x in self.sums[self.width : self.width + len(self.slots)].tolist()]
            groups = [(leaves[i : i + SLOT], counts[i : i + SLOT]) for i in range(0, len(leaves), SLOT)]
            self.slots[first : last + 1] = ["".join(x) for x, _ in groups]
            sizes[first : last + 1] = [(sum(map(len, x)), sum(c)) for x, c in groups]
            self._build(sizes)
            return self.n_tokens
        for k in range(room):
            own = slice(k * per, (k + 1) * per)
            self.slots[first + k] = "".join(leaves[own])
            self._update(first + k, len(self.slots[first + k]), sum(counts[own]))
        return self.n_tokens


def sample_edits(n_chars: int, text: str) -> list[tuple[int, int, str]]:
    """The edits that the registered query applies, each to the text as the ones before have left it: 20 characters go at a quarter,
    ten at the middle give way to the text's first 12, and the text's last 16 are put at the start."""
    out = [(n_chars // 4, n_chars // 4 + 20, "")]
    n = n_chars - max(0, min(20, n_chars - n_chars // 4))
    return [*out, (n // 2, n // 2 + 10, text[:12]), (0, 0, text[-16:])]


FIELDS = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_again long"


def _counter(path: str | None):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                tree = TokenTree(text, enc)
                n, before = tree.n_chars, tree.n_tokens
                for e in sample_edits(n, text):
                    tree.edit(*e)
                out.append((doc_id, n, before, tree.n_chars, tree.n_tokens, tree.encoded))
            names = [f.split()[0] for f in FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], names)

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: tokens before and after the sample edits, and the characters that the edits made to be encoded again."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_counter(path), FIELDS)
