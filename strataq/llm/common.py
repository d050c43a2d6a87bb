"""Shared parts of the training-data operators: words, storage, sessions.

Two word definitions recur.  *Alphanumeric* words are the maximal runs outside
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased; *spaced* words
are the maximal runs outside ``[\\x20\\x09-\\x0D]``.  Both classes are closed
over ASCII, so they are cut on UTF-8 bytes, where every byte of a non-ASCII
character is a word byte.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store, shared_dir  # noqa: F401

ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alnum_table() -> bytes:
    table = bytearray(range(256))
    for b in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


ALNUM_TABLE = _alnum_table()


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    return encode(text).translate(ALNUM_TABLE).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and U+0009 to U+000D."""
    return encode(text).lower().split()


def held_out(doc_id) -> bool:
    """Fold rule of the classifiers: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(int(doc_id)).encode()) % 5 == 0


def fold(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch holds, as a single text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def like_input(docs: DataFrame, step) -> DataFrame:
    """Rows of ``docs`` that ``step`` keeps or rewrites batch by batch, same columns."""
    return docs.mapInPandas(step, docs.schema)
