"""Source dialects to one verse schema (S-06..S-11, S-13, C-30).

XML dialects keep verse text beside elements, in an order that row-tag readers lose; a reader is a stream of start, end and text
events with a small state, run once per file inside mapInPandas. Apparatus (notes, headings) is dropped with its content; a
verse is given once, whether its text lies inside its element or after it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versemill.functions import fixed, unicode
from versemill.session import ship

VERSES = "usfm string, chapter int, v int, pos int, text string, problem string"
_OSIS = {o.lower(): u for o, u in zip(fixed.OSIS_IDS, fixed.BOOK_IDS)} | {"psalms": "PSA"}


def sniff(head: Column) -> Column:
    """S-13: dialect from a file's first 4096 letters, null if none."""
    low = F.lower(F.substring(head, 1, 4096))
    any_of = lambda *marks: F.greatest(*[F.contains(low, F.lit(m)) for m in marks], F.lit(False))
    return (
        F.when(any_of("<xmlbible", "<biblebook"), "zefania")
        .when(any_of("<osistext", "<osis", 'type="book"'), "osis")
        .when(any_of('"books"') | F.startswith(F.ltrim(low), F.lit("{")), "sjson")
        .when(any_of("<usfx", "<bible"), "usfx")
        .when(any_of("<tanach") | (any_of("<w>") & any_of("<v n=")), "uxlc")
        .when(any_of("\\id ", "\\c "), "usfm")
    )


def _tidy(text: str) -> str:
    text = re.sub(r"\s+", " ", text.replace("\u00a0", " ")).strip()
    return re.sub(r"\s+([,.;:!?%»›])", r"\1", text)


class _Reader:
    """Events of one XML file to verses. A dialect says what starts a book, chapter or verse, and which elements go with their content."""

    apparatus: frozenset[str] = fixed.DROPPED

    def __init__(self):
        self.gone = {x.lower() for x in self.apparatus}
        self.rows: list[tuple] = []
        self.book = self.chapter = self.v = None
        self.text: list[str] = []
        self.drop = 0
        self.lost = 0

    def read(self, raw: str) -> list[tuple]:
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.chars
        p.Parse(raw.encode(), True)
        self.close()
        return self.rows

    def close(self) -> None:
        if self.v is not None:
            text = _tidy("".join(self.text))
            if self.book is None or self.chapter is None:
                self.rows.append((self.book, self.chapter, self.v, text, "verse outside any book"))
            else:
                self.rows.append((self.book, self.chapter, self.v, text, None))
        self.v, self.text = None, []

    def chars(self, data: str) -> None:
        if self.v is not None and not self.drop:
            self.text.append(data)

    def start(self, tag: str, attrs: dict) -> None:
        name = tag.rpartition(":")[2].lower()
        a = {k.lower(): x for k, x in attrs.items()}
        if self.drop or name in self.gone:
            self.drop += 1
            return
        self.open(name, a)

    def end(self, tag: str) -> None:
        if self.drop:
            self.drop -= 1
            return
        self.shut(tag.rpartition(":")[2].lower())

    def open(self, name: str, a: dict) -> None: ...

    def shut(self, name: str) -> None: ...


def _number(x: str | None) -> int | None:
    m = re.match(r"\s*(\d+)", x or "")
    return int(m.group(1)) if m else None


class _Usfx(_Reader):
    """S-07: markers <c id/> and <v id/>; a verse ends at <ve/>, the next verse, chapter or book."""

    apparatus = fixed.DROPPED | fixed.DROPPED_USFX

    def open(self, name, a):
        if name in ("book", "c", "v", "ve"):
            self.close()
        if name == "book":
            self.book, self.chapter = (a.get("id") or "").upper() or None, None
        elif name == "c":
            self.chapter = _number(a.get("id"))
        elif name == "v":
            self.v = _number(a.get("id"))

    def shut(self, name):
        if name == "book":
            self.close()
            self.book = None


class _Osis(_Reader):
    """S-08: verses by dotted reference, as containers or as start and end milestones."""

    apparatus = fixed.DROPPED | fixed.DROPPED_OSIS

    def __init__(self):
        super().__init__()
        self.ids: list[str | None] = []

    def _ref(self, a):
        return a.get("osisid") or a.get("osisref") or a.get("sid") or a.get("n") or ""

    def open(self, name, a):
        self.ids.append(None)
        if name == "div" and a.get("type", "").lower() == "book":
            self.close()
            self.book, self.chapter = self._book(self._ref(a)), None
        elif name == "chapter" and "eid" not in a:
            self.close()
            self.chapter = _number(self._ref(a).split(".")[-1])
        elif name == "verse":
            self.close()
            if "eid" in a:
                return
            parts = self._ref(a).split(" ")[0].split(".")
            if len(parts) >= 3:
                self.book, self.chapter = self._book(parts[0]), _number(parts[-2])
            self.v = _number(parts[-1])
            self.ids[-1] = None if "sid" in a else "verse"

    def _book(self, ref):
        return _OSIS.get(ref.split(".")[0].lower()) or ref.split(".")[0].upper() or None

    def shut(self, name):
        if self.ids and self.ids.pop() == "verse":
            self.close()


class _Zefania(_Reader):
    """S-09: numbered books, chapters and verses."""

    apparatus = fixed.DROPPED | fixed.DROPPED_ZEFANIA

    def open(self, name, a):
        if name == "biblebook":
            n = _number(a.get("bnumber"))
            self.book = fixed.BOOK_IDS[n - 1] if n and n <= 66 else None
        elif name == "chapter":
            self.chapter = _number(a.get("cnumber"))
        elif name == "vers":
            self.close()
            self.v = _number(a.get("vnumber"))

    def shut(self, name):
        if name == "vers":
            self.close()


class _Uxlc(_Reader):
    """S-11: words as elements; of a written and read pair the read one stands; paragraph marks are counted, not given."""

    apparatus = frozenset(["note", "header", "tei"])

    def __init__(self):
        super().__init__()
        self.word: str | None = None
        self.kinds: list[str] = []

    def open(self, name, a):
        if name == "book":
            self.book = self.book or (a.get("n") or "").upper() or None
        elif name == "c":
            self.chapter = _number(a.get("n"))
        elif name == "v":
            self.close()
            self.v, self.kinds = _number(a.get("n")), []
        elif name in ("w", "k", "q"):
            self.word = name
            self.kinds.append(name)
            if name != "k":
                self.text.append(" ")

    def chars(self, data):
        if self.word in ("w", "q") and self.v is not None and not self.drop:
            self.text.append(data.strip("\n"))

    def shut(self, name):
        if name in ("w", "k", "q"):
            self.word = None
        elif name == "v":
            lone = [k for i, k in enumerate(self.kinds) if k == "k" and self.kinds[i + 1 : i + 2] != ["q"]]
            self.close()
            if lone and self.rows:
                self.rows[-1] = (*self.rows[-1][:4], f"{len(lone)} written without read")


def pairs_in(kinds: list[str]) -> tuple[int, int, int]:
    """A-14: written-read pairs, lone written and lone read words of a verse's word kinds."""
    pairs = sum(a == "k" and b == "q" for a, b in zip(kinds, kinds[1:]))
    return pairs, kinds.count("k") - pairs, kinds.count("q") - pairs


def _usfm(raw: str) -> Iterator[tuple]:
    """S-06: line markers; a line without one goes on with its verse. A backslash before a backslash or a bar makes it text."""
    book = chapter = v = None
    text: list[str] = []

    def give():
        if v is not None:
            # Escaped characters stand aside as surrogates, which no file holds.
            t = " ".join(text).replace("\\\\", "\ud800").replace("\\|", "\ud801")
            t = re.sub(r"\|[^|]*?(?=\s|\Z)", "", t)
            t = _tidy(re.sub(r"\\[+\-a-zA-Z0-9]+\*?", "", t))
            problem = "unknown marker" if "\\" in t else None if book and chapter else "verse outside any book"
            yield (book, chapter, v, t.replace("\ud800", "\\").replace("\ud801", "|"), problem)

    for line in raw.splitlines():
        line = line.strip()
        if line.startswith("//"):
            continue
        m = re.match(r"\\(id|h|toc\d?|mt\d?|c|v|s\d?|r|d|p|m|q\d?|b|nb|li\d?)\b\s*(.*)", line)
        marker, rest = m.groups() if m else (None, line)
        if marker in ("id", "c", "v"):
            yield from give()
            v, text = None, []
        if marker == "id":
            book, chapter = (rest.split() or [""])[0].upper() or None, None
        elif marker == "c":
            chapter = _number(rest)
        elif marker == "v":
            v, text = _number(rest), [re.sub(r"^\s*\d+\s*", "", rest)]
        elif marker in ("h", "s", "r") or marker and marker.startswith(("toc", "mt", "s")):
            continue
        elif rest and v is not None:
            text.append(rest)
    yield from give()


def _sjson(raw: str) -> Iterator[tuple]:
    """S-10: nested books, chapters and verses; books keep their names, to be matched by alias."""
    for b in json.loads(raw).get("books", []):
        for c in b.get("chapters", []):
            for x in c.get("verses", []):
                text = unicode.py_entities(unicode.py_scrub(re.sub(r"</?transChange\b[^>]*>", "", str(x.get("text") or ""))))
                yield (b.get("name"), c.get("chapter"), x.get("verse"), _tidy(text), None)


def parse(dialect: str, raw: str) -> list[tuple]:
    """(book, chapter, v, text, problem) of one file; a file that can't be parsed gives one problem."""
    readers = {"usfx": _Usfx, "osis": _Osis, "zefania": _Zefania, "uxlc": _Uxlc}
    try:
        if dialect in readers:
            return readers[dialect]().read(raw)
        return list({"usfm": _usfm, "sjson": _sjson}[dialect](raw))
    except (expat.ExpatError, ValueError, AttributeError, TypeError) as e:
        return [(None, None, None, None, f"{type(e).__name__}: {e}")]


def read_sources(spark: SparkSession, path: str, dialect: str | None = None) -> DataFrame:
    """Verses of all source files below a path, (file, usfm, chapter, v, pos, text, problem); the dialect is sniffed unless given.

    One row per file goes to Python; a file is one edition, so files are the unit of work.
    """
    return parse_sources(_files(spark, path, dialect))


def _files(spark: SparkSession, path: str, dialect: str | None) -> DataFrame:
    ship(spark)
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.withColumn("dialect", F.lit(dialect) if dialect else sniff(F.col("value")))


def read_donors(spark: SparkSession, path: str, dialect: str | None = None) -> DataFrame:
    """S-17: verses of donor files of any dialect, (file, dialect, usfm, chapter, v, pos, text), for donor_fill; what can't be placed is left out."""
    files = _files(spark, path, dialect)
    rows = parse_sources(files).filter(F.col("problem").isNull()).drop("problem")
    return rows.join(files.select("file", "dialect"), "file")


def parse_sources(raw: DataFrame) -> DataFrame:
    """Verses of rows (file, value, dialect)."""
    names = ["file", "usfm", "chapter", "v", "pos", "text", "problem"]

    def run(batches):
        for b in batches:
            rows = []
            for file, value, dialect in b[["file", "value", "dialect"]].itertuples(index=False):
                found = parse(dialect, value) if dialect else [(None, None, None, None, "unknown dialect")]
                rows += [(file, u, c, v, i, t, p) for i, (u, c, v, t, p) in enumerate(found)]
            yield pd.DataFrame(rows, columns=names).astype({"chapter": "Int32", "v": "Int32", "pos": "int32"})

    return raw.mapInPandas(run, "file string, " + VERSES)


def harvest(chapter: str) -> list[tuple[int, str]]:
    """C-30: verses of a chapter's printed text: numbers on their own, at line starts or far right, taken in turn from 2; what
    stands before the 2 is verse 1."""
    places: dict[int, int] = {}
    for pattern in fixed.NUMBERED:
        for m in re.finditer(pattern, chapter):
            places.setdefault(int(m.group(1)), m.start(1))
    last = 1
    while last + 1 in places:
        last += 1
    if last == 1:
        return []
    tidy = lambda t: re.sub(r"\s+", " ", t).strip()
    out = [(1, tidy(chapter[: places[2]]))]
    for v in range(2, last + 1):
        end = places[v + 1] if v < last else len(chapter)
        out.append((v, tidy(chapter[places[v] + len(str(v)) : end])))
    return out


def harvest_chapters(texts: DataFrame) -> DataFrame:
    """C-30: (usfm, chapter, v, text) of rows (usfm, chapter, text)."""
    ship(texts.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(u, c, v, t) for u, c, raw in b[["usfm", "chapter", "text"]].itertuples(index=False) for v, t in harvest(raw or "")]
            yield pd.DataFrame(rows, columns=["usfm", "chapter", "v", "text"]).astype({"chapter": "int32", "v": "int32"})

    return texts.mapInPandas(run, "usfm string, chapter int, v int, text string")


def resolve_sources(editions: DataFrame) -> DataFrame:
    """S-14: rows (lang, explicit, reported, files) with the `source` of each: the one named, else the one that its report names if it is there,
    else the only raw file of its language."""
    name = lambda f: F.substring_index(f, "/", -1)
    told = F.get(F.filter("files", lambda f: name(f) == name(F.col("reported"))), F.lit(0))
    own = F.filter("files", lambda f: F.startswith(name(f), F.col("lang")) & F.substr(name(f), F.length("lang") + 1, F.lit(1)).isin("-", "_", "."))
    return editions.withColumn("source", F.coalesce("explicit", told, F.when(F.size(own) == 1, F.get(own, F.lit(0)))))
