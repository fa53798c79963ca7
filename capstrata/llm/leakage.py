"""Evaluation texts leaking into training text, by winnowing.

Both sides are fingerprinted (least k-gram hash per window of k-grams); with k + w - 1 = the shortest span that
counts, every shared span of that length shares a fingerprint at the same place of the span, so nothing is missed.
Equal fingerprints are joined and extended in both directions; a pair counts if the run reaches the required length.

A fingerprint carries the hashes of the span - k words on either side of it, which is all that extending it can need.
So no text is looked up again: it does not matter how often a ``doc_id`` occurs, and what is shuffled is the hits. Of
the evaluation side a bitmap of fixed size goes to the executors, by which documents drop fingerprints that no item
has before anything is joined. Every fingerprint is salted, so one of boilerplate is joined in many tasks.

Defined results: null and short texts match nothing; repeated documents each give their rows; a repeated
``doc_id`` or ``item_id`` gives one row per pair. Very long texts are processed whole. Empty inputs give empty
results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import SALTS
from ..session import cut_lineage
from . import fingerprint as fp

SPAN, GRAM = 15, 5
#: Bits of the bitmap of evaluation fingerprints, whatever their number (8 MB; with 10 million items' worth of 100 million
#: fingerprints most bits are set and it drops little, but nothing is lost).
BITS = 1 << 26

PRINTS = "print bigint, left array<bigint>, right array<bigint>"


def _around(hashes: np.ndarray, rows: np.ndarray, at: np.ndarray, start: int, step: int, n: int) -> pa.Array:
    """For each position the hashes of up to n words of its row, going from ``start`` on by ``step``."""
    where = at[:, None] + start + step * np.arange(n)[None]
    inside = (where >= 0) & (where < len(hashes))
    where = np.where(inside, where, 0)
    inside &= rows[where] == rows[at][:, None]
    counts = inside.sum(axis=1)
    values = hashes[where][inside].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def fingerprints(df: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM, bitmap=None) -> DataFrame:
    """key, print and the words left (nearest first) and right of it, of the winnowed fingerprints of each text; with
    ``bitmap`` (a broadcast), of those whose bit is set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for b in batches:
            for first, _, raw, offsets in fp.text_chunks(b.column(1)):
                h, rows, _, _ = fp.words(raw, offsets)
                at = fp.winnow(h, rows, gram, span - gram + 1)
                prints = fp.gram_hashes(h, gram)[at]
                if bits is not None:
                    slot = prints % np.uint64(BITS)
                    kept = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at, prints = at[kept], prints[kept]
                keys = b.column(0).take(pa.array(rows[at] + first))
                yield pa.RecordBatch.from_arrays([keys, pa.array(prints.view(np.int64)), _around(h, rows, at, -1, -1, span - gram), _around(h, rows, at, gram, 1, span - gram)], names=[key, "print", "left", "right"])

    return df.select(F.col(key).cast("bigint").alias(key), text).where(f"{key} is not null and {text} is not null").mapInArrow(scan, f"{key} bigint, {PRINTS}")


def print_bitmap(prints: DataFrame) -> np.ndarray:
    """BITS bits as 64-bit words; at most BITS / 64 rows reach the driver, whatever the number of fingerprints."""
    slot = F.pmod("print", F.lit(BITS))
    words = prints.select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(print, {BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _same(a: Column, b: Column) -> Column:
    """How many elements two arrays agree in from their beginning on."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal))


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, item_id of every document that holds at least ``span`` consecutive words of an item."""
    right = cut_lineage(fingerprints(items, "item_id", "item_text", span, gram))
    bitmap = documents.sparkSession.sparkContext.broadcast(print_bitmap(right))
    left = fingerprints(documents, "doc_id", "text", span, gram, bitmap).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = right.select("item_id", "print", F.col("left").alias("l"), F.col("right").alias("r"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    hits = left.join(right, ["print", "salt"]).where(_same(F.col("left"), F.col("l")) + _same(F.col("right"), F.col("r")) + gram >= span)
    return hits.select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: suite and number of documents that hold it; items that leaked nowhere count 0."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
