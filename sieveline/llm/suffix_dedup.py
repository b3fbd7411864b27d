"""Op 1: exact substring dedup by difference-cover suffix sorting.

A byte is removed if a `length`-byte string that covers it also starts earlier: in a document of smaller
doc_id, or at an earlier place of the same one. Strings are judged on the input and never cross documents.

1. Anchors. Every `length`-byte string owns one anchor: the leftmost of its `gram`-byte strings with the least
   hash. Equal strings have equal anchors, so strings can only be equal within an anchor's group, and the text
   falls apart into independent blocks, one for each anchor hash, without one global suffix array of all text.
   Consecutive strings with the same anchor form one context of at most 2 * length bytes.
2. Contexts that repeat as a whole keep their first place; the others are covered. Contexts that occur once, under
   an anchor that occurs once, hold no repeat.
3. The remaining contexts (one of each content, under an anchor that has several) are suffix-sorted block by block
   by the difference cover {1, 2} modulo 3: sort sampled triples, recurse on their names, sort the remaining
   suffixes by (first byte, rank of the next), merge, and compare the `length`-byte prefixes of neighbours.
   Blocks are cut between anchors, so no `length`-byte string is compared across blocks.
4. Hot anchors (a line that very many documents share, in other surroundings each time) would make blocks that grow
   with the data. Contexts under an anchor with more than MOST contexts therefore fall apart further: into their
   strings, dealt by 128 bits of hash; of equal strings within a chunk only the first asks further. Anchors that a
   share of HOT of the documents holds (judged by one document in SAMPLED) are dealt by (anchor, content) from the
   beginning, so that no task gathers all their occurrences; the sample (bounded: HOTTEST anchors) only says where
   rows go, never what is removed.

Null text is empty; texts shorter than `length` lose nothing. Rows with a repeated or null doc_id are documents of
their own, ordered by (doc_id, text), null first; of equal rows, any one is the first. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .common import U64

LENGTH, GRAM, CHUNK, BLOCK = 100, 32, 1 << 20, 1 << 19
#: Most contexts of an anchor in a block; one document in SAMPLED looks for hot anchors: a share of HOT, LEAST times at least.
MOST, SAMPLED, HOT, LEAST, HOTTEST = 8192, 8, 0.002, 8, 1 << 16


def leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width`, the place of its leftmost least value."""
    at, v, span = np.arange(len(g), dtype=np.int32), g, 1
    while span * 2 <= width:
        less = v[span:] < v[:-span]
        at = np.where(less, at[span:], at[:-span])
        v = np.minimum(v[span:], v[:-span])
        span *= 2
    if rest := width - span:
        at = np.where(v[rest:] < v[:-rest], at[rest:], at[:-rest])
    return at


def contexts(text: np.ndarray, off: np.ndarray, length: int, gram: int, tab: np.ndarray, powers: C.Powers):
    """(document index, start of first string, start of last string, anchor hash, content hash) of all contexts."""
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U64), none.astype(U64)
    up, down = powers.get(n + 1)
    h = np.zeros(n + 1, U64)
    np.cumsum(tab[text] * up[:n], out=h[1:])
    g = C.mix((h[gram:] - h[:-gram]) * down[: n + 1 - gram])
    anchor = leftmost_minima(g, length - gram + 1)
    ends = np.repeat(off[1:], np.diff(off))
    v = np.flatnonzero(np.arange(n - length + 1) + length <= ends[: n - length + 1])
    if not len(v):
        return none, none, none, none.astype(U64), none.astype(U64)
    a = anchor[v]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (v[1:] != v[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(v) - 1]))
    s, e, p = v[first], v[last], a[first].astype(np.int64)
    shape = ((p - s) * 4096 + (e - s)).astype(U64)
    content = C.mix((h[e + length] - h[s]) * down[s] + C.mix(shape + U64(1)))
    return np.searchsorted(off, s, "right") - 1, s, e, g[p], content


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows, text, offsets, contexts) of chunks of about CHUNK bytes of (row, text) batches."""
    tab, powers = C.byte_table(1), C.Powers()
    for batch in batches:
        text, off = C.strings(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in C.chunks(off, CHUNK):
            o = off[lo : hi + 1] - off[lo]
            found = contexts(text[off[lo] : off[hi]], o, LENGTH, GRAM, tab, powers)
            if len(found[0]):
                yield ids[lo:hi], o, found


def _anchor_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, documents) of chunks."""
    for _, _, (d, _, _, fp, _) in _chunked(batches):
        order = np.lexsort((d, fp))
        new = np.ones(len(d), bool)
        new[1:] = (fp[order[1:]] != fp[order[:-1]]) | (d[order[1:]] != d[order[:-1]])
        k, n = np.unique(fp[order[new]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["k", "n"])


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors that a share of HOT of the documents holds, by a sample of (_row, text); at most HOTTEST."""
    some = docs.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLED)) == 0).select("_row", "text")
    least = max(LEAST, HOT * some.select("_row").count())
    often = some.mapInArrow(_anchor_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.k for r in often.orderBy(F.desc("n"), "k").limit(HOTTEST).collect()], np.int64))


def anchors_of(hot: np.ndarray) -> Callable:
    """Contexts of (_row, text): key, content, row and place = start << 13 | hot << 12 | length << 1 | settled."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, o, (d, s, e, fp, ch) in _chunked(batches):
            doc, place = ids[d], s - o[d]
            # In this chunk only the first of equal contexts asks further; the others are covered by it.
            order = np.lexsort((place, doc, ch, fp))
            again = np.zeros(len(d), bool)
            again[order[1:]] = (ch[order[1:]] == ch[order[:-1]]) & (fp[order[1:]] == fp[order[:-1]])
            often = np.isin(fp.view(np.int64), hot) if len(hot) else np.zeros(len(d), bool)
            key = np.where(often, C.mix(fp + ch * U64(0xD1B54A32D192ED03)), fp)
            key = np.where(again, C.mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + place.astype(U64)), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(doc), pa.array((place << 13) | (often.astype(np.int64) << 12) | ((e - s) << 1) | again)], names=["k", "ch", "_row", "place"]
            )

    return work


def dc3(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of s (values 1..k) by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, [0, 0, 0])).astype(np.int64)
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))

    def keys(i):
        if k < 1 << 20:
            return (t[i] << 42) | (t[i + 1] << 21) | t[i + 2]
        pair = np.unique(t[i] * (k + 1) + t[i + 1], return_inverse=True)[1]
        return pair * (k + 1) + t[i + 2]

    key = keys(sample)
    order = np.argsort(key, kind="stable")
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate(([1], key[order[1:]] != key[order[:-1]])))
    if (most := int(name.max())) < len(sample):
        order = dc3(name, most)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    sample = sample[order]
    width = len(sample) + 2
    zero = zero[np.argsort(t[zero] * width + rank[zero + 1], kind="stable")]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    ones = ones[ones < n]
    before = np.searchsorted(t[ones] * width + rank[ones + 1], t[zero] * width + rank[zero + 1])
    if (k + 1) ** 2 * width < 1 << 62:
        far = lambda i: (t[i] * (k + 1) + t[i + 1]) * width + rank[i + 2]
        before += np.searchsorted(far(twos), far(zero))
    else:
        both = np.concatenate((twos, zero))
        pair = np.unique(t[both] * (k + 1) + t[both + 1], return_inverse=True)[1]
        far = pair * width + rank[both + 2]
        before += np.searchsorted(far[: len(twos)], far[len(twos) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zero
    out[rest] = sample[sample < n]
    return out


def repeats(blobs: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the starts of its strings that occur earlier; order: of the contexts by place, none shared."""
    lens = np.array([len(b) for b in blobs], np.int64)
    raw = np.frombuffer(b"\0".join(blobs) + bytes(16), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    n = int(starts[-1] + lens[-1]) + 1
    sep = starts + lens
    text = raw[:n].astype(np.int64) + 2
    text[sep] = 1
    sa = dc3(text, 257)
    owner = np.repeat(np.arange(len(blobs)), lens + 1)
    valid = np.arange(n) + length <= sep[owner]
    p = sa[valid[sa]]
    words = np.zeros(n, U64)
    for j in range(8):
        words |= raw[j : j + n].astype(U64) << U64(8 * j)
    same = np.ones(max(len(p) - 1, 0), bool)
    for step in [*range(0, length - 7, 8), length - 8]:
        w = words[p + step] if len(p) else words[:0]
        same &= w[1:] == w[:-1]
    place = order[owner[p]] * 8192 + (p - starts[owner[p]])
    heads = np.flatnonzero(np.concatenate(([True], ~same))) if len(p) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(p)))) if len(p) else place
    hit = np.zeros(n, bool)
    hit[p[place != least]] = True
    return [np.flatnonzero(hit[a : a + k]) for a, k in zip(starts, lens, strict=True)]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(x[1:] != x[:-1] + 1) + 1
    return x[np.concatenate(([0], cut))], x[np.concatenate((cut - 1, [len(x) - 1]))]


def sorted_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, _row, s, ctx) sorted by k; whole anchors are gathered into blocks of about BLOCK bytes."""

    def work(block):
        doc, s = np.array([r[1] for r in block], np.int64), np.array([r[2] for r in block], np.int64)
        rank = np.empty(len(block), np.int64)
        rank[np.lexsort((s, doc))] = np.arange(len(block))
        rows = []
        for r, hit in zip(block, repeats([r[3] for r in block], rank, LENGTH), strict=True):
            if len(hit):
                rows += [(r[1], r[2] + int(a), r[2] + int(b)) for a, b in zip(*runs(hit), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["_row", "s", "e"])

    block, held, last = [], 0, None
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if r[0] != last and held >= BLOCK:
                yield work(block)
                block, held = [], 0
            last = r[0]
            block.append(r)
            held += len(r[3])
    if block:
        yield work(block)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def judged(text: bytes, spans: list[list[int]]) -> dict:
    h, at = hashlib.sha256(), 0
    for a, b in spans:
        h.update(text[at:a])
        at = b
    h.update(text[at:])
    return {"n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": h.hexdigest()}


FOUND = "_row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
OUT = pa.schema([("_row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
HALF = pa.schema([*OUT, ("text", pa.binary()), ("blocks", pa.list_(pa.struct([("k", pa.int64()), ("s", pa.int64()), ("hot", pa.bool_()), ("ctx", pa.binary())])))])
#: What is held as Python objects before it is passed on: rows, bytes.
ROWS, BYTES = 500, 1 << 21


def first_half(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their covered contexts: those without open contexts are done, the others keep their text."""
    for batch in batches:
        rows, held = [], 0
        text, off = C.strings(batch.column(1))
        ids, marks = batch.column(0).to_pylist(), batch.column(2)
        for i, doc in enumerate(ids):
            body = text[off[i] : off[i + 1]].tobytes()
            spans, blocks = [], []
            for m in marks[i].as_py() or ():
                k, place = m["k"], m["place"]
                s, e, open_ = place >> 13, (place >> 13) + ((place & 4095) >> 1), place & 1
                if open_:
                    blocks.append({"k": k, "s": s, "hot": bool(place >> 12 & 1), "ctx": body[s : e + LENGTH]})
                    held += e - s + LENGTH
                else:
                    spans.append((s, e + LENGTH))
            spans = merged(spans)
            row = {"_row": doc, "n_bytes": len(body), "spans": [x for y in spans for x in y], "text": body if blocks else None, "blocks": blocks or None}
            rows.append(row | ({} if blocks else judged(body, spans)))
            held += len(body)
            if len(rows) >= ROWS or held >= BYTES:
                yield from pa.Table.from_pylist(rows, schema=HALF).to_batches()
                rows, held = [], 0
        if rows:
            yield from pa.Table.from_pylist(rows, schema=HALF).to_batches()


def second_half(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(len(batch)):
            doc, body, spans, more = (batch.column(c)[i].as_py() for c in range(4))
            both = merged([*zip(spans[::2], spans[1::2], strict=True), *((m["s"], m["e"] + LENGTH) for m in more or ())])
            rows.append({"_row": doc, "n_bytes": len(body), "spans": [x for y in both for x in y]} | judged(body, both))
        yield from pa.Table.from_pylist(rows, schema=OUT).to_batches()


def strings_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All `length`-byte strings of the contexts (_row, s, ctx): two hashes, row, start, and whether the chunk has it earlier."""
    tabs, powers = (C.byte_table(3), C.byte_table(4)), C.Powers()
    for batch in batches:
        text, off = C.strings(batch.column(2))
        ids, starts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
        for lo, hi in C.chunks(off, CHUNK // 2):
            body, o = text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            up, down = powers.get(len(body) + 1)
            owner = np.repeat(np.arange(hi - lo), np.diff(o))
            at = np.flatnonzero(np.arange(len(body)) + LENGTH <= o[1:][owner])
            both = []
            for tab in tabs:
                h = np.concatenate((np.zeros(1, U64), np.cumsum(tab[body] * up[: len(body)])))
                both.append(C.mix((h[at + LENGTH] - h[at]) * down[at]))
            row, s = ids[lo:hi][owner[at]], starts[lo:hi][owner[at]] + at - o[owner[at]]
            order = np.lexsort((s, row, *both))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (both[0][order[1:]] == both[0][order[:-1]]) & (both[1][order[1:]] == both[1][order[:-1]])
            both[0] = np.where(again, C.mix(row.astype(U64) * U64(0x9E3779B97F4A7C15) + s.astype(U64)), both[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in both), pa.array(row), pa.array(s), pa.array(again)], names=["h", "g", "_row", "s", "again"])


def _judged_contexts(docs: DataFrame) -> DataFrame:
    """Documents with their covered contexts and, where some are open, their text and those; written to the shared folder."""
    found = docs.mapInArrow(anchors_of(hot_anchors(docs)), "k long, ch long, _row long, place long")
    by = Window.partitionBy("k")
    earlier = by.orderBy("ch", "_row", "place")
    found = found.withColumns({"was": F.lag("ch").over(earlier), "most": F.max("ch").over(by), "n": F.count(F.lit(1)).over(by)})
    hot = F.col("place").bitwiseAND(F.lit(4096)) != 0
    covered = (F.col("place").bitwiseAND(F.lit(1)) == 1) | F.coalesce(F.col("was") == F.col("ch"), F.lit(False))
    open_ = ~covered & (hot | F.col("was").isNotNull() | (F.col("most") != F.col("ch")))
    flags = F.when(open_ & (F.col("n") > MOST), F.lit(4096)).otherwise(F.lit(0)).bitwiseOR(open_.cast("int"))
    kept = found.where(covered | open_).select("_row", F.struct("k", F.col("place").bitwiseAND(F.lit(-2)).bitwiseOR(flags.cast("long")).alias("place")).alias("m"))
    # Written apart, so that the anchors' shuffle can go before texts are shuffled.
    marks = C.materialize(kept.groupBy("_row").agg(F.collect_list("m").alias("marks")), "suffix_marks")
    half = docs.join(marks, "_row", "left").select("_row", "text", "marks")
    return C.materialize(half.mapInArrow(first_half, FOUND + ", text binary, blocks array<struct<k:long,s:long,hot:boolean,ctx:binary>>"), "suffix_half")


def _hot_hits(blocks: DataFrame) -> DataFrame:
    """_row, s, e (= s) of strings of hot contexts that start earlier elsewhere."""
    each = blocks.select("_row", "s", "ctx").mapInArrow(strings_of, "h long, g long, _row long, s long, again boolean")
    before = F.lag("_row").over(Window.partitionBy("h", "g").orderBy("_row", "s"))
    return each.withColumn("before", before).where("again OR before IS NOT NULL").select("_row", "s", F.col("s").alias("e"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (flat starts and ends, in bytes) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, plain = C.numbered(docs, "doc_id", "text")
    half = _judged_contexts(docs.select("_row", "text"))
    blocks = half.where(F.col("blocks").isNotNull()).select("_row", F.explode("blocks").alias("b")).select("b.k", "_row", "b.s", "b.ctx", "b.hot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = blocks.where("NOT hot").drop("hot")
    more = cool.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(sorted_blocks, "_row long, s long, e long")
    more = more.unionByName(_hot_hits(blocks.where("hot"))).groupBy("_row").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    names = OUT.names
    left = half.where(F.col("text").isNotNull()).select("_row", "text", "spans").join(more, "_row", "left").select("_row", "text", "spans", "more")
    late = left.mapInArrow(second_half, FOUND)
    out = half.where(F.col("text").isNull()).select(*names).unionByName(late.select(*names))
    return out.withColumnRenamed("_row", "doc_id") if plain else out.join(docs.select("_row", "doc_id"), "_row").select("doc_id", *names[1:])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(C.table(spark, sf_dir, "documents")).drop("spans")
