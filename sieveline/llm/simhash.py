"""Op 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at up to `2 * HALF` differing bits share a value within HALF bits of each. Every distinct fingerprint
emits all such variants; equal variants meet in one bucket; whoever shares one is verified and linked. The variants
are dealt in PASSES passes by a hash, one after the other, so that only a part is on disk at a time, and travel packed
(value and number of the flip mask) instead of as rows. Each bucket returns a spanning forest of its links, which
keeps every component; components are found by star contraction over the distinct fingerprints, and a document
takes the smallest doc_id of its component.

Null, empty and word-less texts have fingerprint zero, linked like any other. Repeated rows and exact copies share a
fingerprint, so groups of copies of any size cost one fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import U64
from .graph import components, local_forest

HALF, PASSES, PER_BUCKET, SLICE = 2, 8, 1_000_000, 1024
MASKS = np.array([sum(1 << i for i in c) for n in range(HALF + 1) for c in combinations(range(64), n)], U64)
WORDS = 4
MULTIPLIER = U64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority bits over the XXH64 (seed 42) of all runs of `words` lower-cased words, repeats included."""
    parts = text.lower().split()
    if not parts:
        return 0
    body = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(body, 42)]
    else:
        space = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
        starts = [0, *(space[: len(parts) - words] + 1).tolist()]
        ends = [*space[words - 1 :].tolist(), len(body)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[s:e], 42) for s, e in zip(starts, ends, strict=True)]
    bits = np.unpackbits(np.array(hashes, U64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp: the 64 bits as a signed long."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, off = C.strings(batch.column(1))
            found = [fingerprint(text[off[i] : off[i + 1]].tobytes(), words) for i in range(len(off) - 1)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, U64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def variants(part: int, buckets: int) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(MASKS), dtype=np.uint16)
        for batch in batches:
            all_ = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for lo in range(0, len(all_), SLICE):
                v = all_[lo : lo + SLICE, None] ^ MASKS[None, :]
                h = v * MULTIPLIER
                mine = (h >> U64(61)) == part
                v, m = v[mine], np.broadcast_to(number, mine.shape)[mine]
                b = (((h[mine] >> U64(29)) & U64(0xFFFFFFFF)) * U64(buckets)) >> U64(32)
                order = np.argsort(b.astype(np.uint16 if buckets <= 65536 else np.uint32), kind="stable")
                v, m = v[order], m[order]
                ends = np.cumsum(np.bincount(b.astype(np.int64), minlength=buckets))
                begins = np.concatenate(([0], ends[:-1]))
                there = np.flatnonzero(ends > begins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there, pa.int32()), pa.array([v[begins[i] : ends[i]].tobytes() for i in there], pa.binary()), pa.array([m[begins[i] : ends[i]].tobytes() for i in there], pa.binary())], names=["bucket", "v", "m"]
                )

    return deal


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(table: pa.Table) -> pa.Table:
    """A spanning forest of the fingerprints in one bucket that share a variant."""
    v = np.frombuffer(b"".join(table.column("v").to_pylist()), U64)
    m = np.frombuffer(b"".join(table.column("m").to_pylist()), np.uint16)
    ordered = np.sort(v)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return EDGES.empty_table()
    flag = np.zeros(1 << 16, bool)
    flag[(shared * MULTIPLIER) >> U64(48)] = True
    hit = np.flatnonzero(flag[(v * MULTIPLIER) >> U64(48)])
    w = v[hit]
    at = np.searchsorted(shared, w)
    hit, at = hit[ok := shared[np.minimum(at, len(shared) - 1)] == w], at[ok]
    fp = v[hit] ^ MASKS[m[hit]]
    order = np.lexsort((fp, at))
    at, fp = at[order], fp[order]
    head = np.concatenate(([True], at[1:] != at[:-1]))
    least = fp[np.flatnonzero(head)][np.cumsum(head) - 1]
    pairs = np.unique(np.stack((least[~head], fp[~head]), axis=1), axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * HALF]
    a, b = local_forest(pairs[:, 0], pairs[:, 1])
    return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=EDGES)


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints `fp` at up to 2 * HALF differing bits, enough for all components."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-distinct.count() * len(MASKS) // (PASSES * PER_BUCKET)), min(parts, 12))
    spread = distinct.select("fp").repartition(parts)
    out = C.new_path(spark, "links")
    for part in range(PASSES):
        dealt = spread.mapInArrow(variants(part, buckets), "bucket int, v binary, m binary")
        C.write(dealt.groupBy("bucket").applyInArrow(links, "a long, b long"), out, "append")
    return spark.read.schema("a long, b long").parquet(out)


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    found = C.materialize(fingerprints(docs, words), "fingerprints")
    distinct = C.materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(linked(distinct))
    of = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    home = of.groupBy("label").agg(F.min("least").alias("component_id"))
    place = of.join(home, "label").select("fp", "component_id")
    return found.join(place, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
