"""Document fingerprints: a quartile bucket digest.

Every text is read as UTF-8. Byte triplets within windows of five bytes are hashed by tabulation into 256 buckets; each bucket's
count is encoded in two bits by the quartile it falls into, and a header holds the length on a logarithmic scale and two
ratios of the quartiles. Digests are compared with a difference score bounded by `MOST`, from which likeness is 1 - score / MOST.

Defined results: null is the empty text; a text of under three bytes has no triplets, so all its buckets are 0; equal texts have
equal digests; repeated rows each give a row; a single document is its own next one; null ids come last in the order; texts are read whole
whatever their length; columns other than the id and the text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.llm.common import texts
from versemill.session import materialize, ship

BUCKETS = 256
PATTERNS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]  # offsets of a triplet's second and third byte
TABLES = np.random.RandomState(20240229).randint(0, 256, (5, 256)).astype(np.uint8)  # tabulation hash by offset
#: Differences at and beyond this count as no likeness: unrelated buckets differ by 1.25 each on average.
MOST = 240.0
SYMBOL_COST = np.array([0, 1, 2, 4], dtype=np.int64)


def bucket_counts(raw: bytes) -> np.ndarray:
    """Counts of hashed byte triplets by bucket."""
    x = np.frombuffer(raw, dtype=np.uint8)
    out = np.zeros(BUCKETS, dtype=np.int64)
    n = len(x)
    if n < 3:
        return out
    parts = [t[x] for t in TABLES]
    for a, b in PATTERNS:
        m = n - b
        if m > 0:
            out += np.bincount(parts[0][:m] ^ parts[a][a : a + m] ^ parts[b][b : b + m], minlength=BUCKETS)
    return out


def digest(counts: np.ndarray, n_bytes: int) -> str:
    """Hex digest: length code, two quartile ratios, two bits for each bucket."""
    s = np.sort(counts)
    q1, q2, q3 = (int(s[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).view(np.int8) + (counts > q2).view(np.int8) + (counts > q3).view(np.int8)).astype(np.uint8)
    quads = codes.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8)
    length = min(255, round(12 * math.log2(1 + n_bytes)))
    r1, r2 = ((16 * q1 // q3) % 16, (16 * q2 // q3) % 16) if q3 else (0, 0)
    return f"{length:02x}{r1:x}{r2:x}{body.tobytes().hex()}"


def difference(a: str, b: str) -> float:
    """Difference of two digests: symbol distances of the buckets plus distances of the header's fields."""
    x, y = (np.frombuffer(bytes.fromhex(d), dtype=np.uint8) for d in (a, b))
    gap = 0
    for shift in (0, 2, 4, 6):
        u, v = (x[2:] >> shift & 3).astype(np.int64), (y[2:] >> shift & 3).astype(np.int64)
        gap += int(SYMBOL_COST[np.abs(u - v)].sum())
    head = abs(int(x[0]) - int(y[0])) + abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    return float(gap + head)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 at a difference of MOST."""
    return 1.0 - min(difference(a, b), MOST) / MOST


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode()
    return digest(bucket_counts(raw), len(raw))


def edited_pair(text: str, counts: np.ndarray, following: str) -> tuple[str, str]:
    """sha256 and digest of the text whose last third of code points gives way to the following text's first ones.

    Only triplets that touch the changed tail are counted again.
    """
    k = len(text) // 3
    head, old, new = text[: len(text) - k].encode(), text[len(text) - k :].encode(), following[:k].encode()
    seam = head[-4:]
    changed = counts - bucket_counts(seam + old) + bucket_counts(seam + new)
    edited = head + new
    return hashlib.sha256(edited).hexdigest(), digest(changed, len(edited))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document, in one pass without a shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in texts(b.column(1))], pa.string())], ["doc_id", "fingerprint"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, fingerprint string")


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
DONE, TAIL, HEAD = 0, 1, 2


def _pairs(batches):
    """Each row's text and the next row's, of rows in order; the first row of a partition comes out as HEAD, the last as TAIL."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None  # the row before: id, text, counts, digest
    out: list = []

    def flush():
        cols = list(zip(*out)) if out else [[]] * 10
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["part", "role", "text", *(f.split()[0] for f in FIELDS.split(", "))]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        out.clear()
        return batch

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            raw = text.encode()
            counts = bucket_counts(raw)
            mine = digest(counts, len(raw))
            if held is None:
                out.append((part, HEAD, text, doc_id, None, None, None, None, None, None))
            else:
                out.append((part, DONE, None, *_row(*held, text, mine)))
            held = (doc_id, text, counts, mine)
        if out:
            yield flush()
    if held is not None:
        out.append((part, TAIL, held[1], held[0], None, None, None, None, None, None))
        yield flush()


def _row(doc_id, text, counts, mine, following, theirs) -> tuple:
    sha, edited = edited_pair(text, counts, following)
    return doc_id, len(text), sha, mine, edited, likeness(mine, edited), likeness(mine, theirs)


def _seams(batches):
    """The rows of _pairs whose next row is in another partition."""
    for b in batches:
        rows = []
        for doc_id, text, following in zip(b.column(0).to_pylist(), texts(b.column(1)), texts(b.column(2))):
            raw = text.encode()
            counts = bucket_counts(raw)
            rows.append(_row(doc_id, text, counts, digest(counts, len(raw)), following, fingerprint(following)))
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and the likeness to both it and the next document's.

    One range exchange puts the documents in descending order of doc_id (ties by a hash of the text), so that all but one row of each
    partition find the next document beside them. The last row of a partition meets the first one of the next partition
    that has rows in a join of one row for each partition.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by id and hash, so that the driver samples no texts and documents of equal or null id are spread
    order = [F.desc("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).asc()]
    ordered = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(_pairs, f"part int, role int, text string, {FIELDS}"), "fingerprint-rows")
    heads = found.filter(F.col("role") == HEAD).select("part", F.col("text").alias("next_text"))
    parts = heads.select("part")
    first = parts.agg(F.min("part")).first()[0]  # one number; null without rows
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.lit(first)).alias("next"))
    tails = found.filter(F.col("role") == TAIL).select("part", "doc_id", "text").join(following, "part")
    seams = tails.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")
    done = found.filter(F.col("role") == DONE).select(*(f.split()[0] for f in FIELDS.split(", ")))
    return done.unionByName(seams.mapInArrow(_seams, FIELDS))
