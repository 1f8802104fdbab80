"""Shared pieces of the llm operators: byte tables for words, Arrow columns, labelled folds."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.session import materialize

#: A-Z to a-z and every ASCII byte that is no letter or digit to a space; bytes from 0x80 on stay, so that
#: `text.translate(WORD_BYTES).split()` gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return raw.translate(WORD_BYTES).split()


def tokens_of(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, as UTF-8."""
    return raw.lower().split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def each_raw(column: pa.Array):
    """The same, one by one, a few of them in memory as Python objects."""
    for i in range(0, len(column), 64):
        yield from raw_texts(column.slice(i, 64))


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def training_labels(labels: DataFrame, label_col: str, training: Column, bound: int, label: str) -> DataFrame:
    """(doc_id, y) of labels 0 and 1 where `training` holds, at most `bound` rows chosen by a hash of their ids: small enough to broadcast."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    y = y.filter(F.col("doc_id").isNotNull() & training)
    n = y.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    # the limit only guards the bound
    return materialize(y if n <= bound else y.filter(h < F.lit(int(2**30 * 0.95 * bound / n))).limit(bound), label)


def unused_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the stems and that `df` doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
