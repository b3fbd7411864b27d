"""Near copies by the Jaccard similarity of runs of words: MinHash bands find them, the runs themselves decide.

A document's set holds the hashes of all runs of `words` lower-cased words (a shorter text is one run). BANDS keys of
ROWS minima each are made of it, and documents that share a key are compared by their whole sets: two at similarity
0.8 share some key with probability 0.9996. Keys come in passes (LIMITS). In a pass the rows of a key are read in the
order of doc_id; a row as similar as asked to a row that stands before it is lost and joins no later pass. So of the
rows that are left no two that share a key are that similar, and each lost row is a near copy of a smaller doc_id.

Only rows that share a key travel with their texts, and a task holds the sets of one key's rows that are not lost.
Texts without words are copies of nothing. doc_id must be unique and not null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64

ROWS, BANDS, PIECE = 5, 20, 4096
LIMITS = (0, 2, 8, BANDS)
FACTORS = C.mix(np.arange(1, ROWS * BANDS + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


class Runs:
    """The set of a text's runs of words, as sorted distinct hashes."""

    def __init__(self, words: int) -> None:
        self.words, self.table, self.powers = words, C.byte_table(9), C.Powers()

    def __call__(self, text: bytes) -> np.ndarray:
        parts = text.lower().split()
        if not parts:
            return np.zeros(0, U64)
        body = np.frombuffer(b" ".join(parts), np.uint8)
        up, down = self.powers.get(len(body) + 1)
        h = np.concatenate((np.zeros(1, U64), np.cumsum(self.table[body] * up[: len(body)])))
        space = np.flatnonzero(body == 32)
        more = max(0, len(parts) - self.words)
        s = np.concatenate(([0], space[:more] + 1))
        e = np.concatenate((space[self.words - 1 :][:more], [len(body)]))
        return np.unique(C.mix((h[e] - h[s]) * down[s]))


def keys(runs: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none of an empty one."""
    if not len(runs):
        return np.zeros(0, np.int64)
    least = np.full(len(FACTORS), np.iinfo(U64).max, U64)
    for at in range(0, len(runs), PIECE):
        np.minimum(least, (runs[None, at : at + PIECE] * FACTORS[:, None]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=U64)
    for column in least.reshape(BANDS, ROWS).T:
        out = C.mix(out * U64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, keys (array<long>)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(words)
        for batch in batches:
            text, off = C.strings(batch.column(1))
            found = [keys(runs(text[off[i] : off[i + 1]].tobytes())) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, keys array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Keys of more than one row."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")


def _lost(rows: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, of: rows (key, doc_id, text) as similar as `least` to one of their key that stands before them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, now, kept = Runs(words), None, []
        for batch in batches:
            text, off = C.strings(batch.column(2))
            lost, of = [], []
            for i, (key, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != now:
                    now, kept = key, []
                mine = runs(text[off[i] : off[i + 1]].tobytes())
                near = next((d for d, other in kept if similarity(mine, other) >= least), None)
                if near is None:
                    kept.append((doc, mine))
                else:
                    lost.append(doc)
                    of.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64()), pa.array(of, pa.int64())], names=["doc_id", "of"])

    ordered = rows.select("key", "doc_id", "text").repartition("key").sortWithinPartitions("key", "doc_id")
    return ordered.mapInArrow(work, "doc_id long, of long").groupBy("doc_id").agg(F.min("of").alias("of"))


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, of: the rows that are near copies of a smaller doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = C.materialize(sketches(texts, words), "sketches")
    every = sketch.select("doc_id", F.explode("keys").alias("key"))
    meet = every.join(_shared(every), "key", "left_semi").select("doc_id").distinct()
    left = C.materialize(texts.join(sketch.join(meet, "doc_id", "left_semi"), "doc_id"), "meeting")
    found = None
    for lo, hi in zip(LIMITS, LIMITS[1:], strict=False):
        rows = left.select("doc_id", "text", F.explode(F.slice("keys", lo + 1, hi - lo)).alias("key"))
        lost = C.materialize(_lost(rows.join(_shared(rows.select("key")), "key", "left_semi"), words, least), "lost")
        left = left.join(lost, "doc_id", "left_anti")
        found = lost if found is None else found.unionByName(lost)
    return found
