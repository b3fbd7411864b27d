"""Op 5: bounded-space online packing of token sequences.

Each partition keeps OPEN windows of SIZE tokens. Whole stretches of SIZE tokens become sequences at once. The rest
of a document goes to the window it fits best; where none has room, a new window opens, or, if OPEN are open, the
fullest is filled up with the beginning of the piece and emitted, and the remainder is placed again. What is open at a
partition's end (at most OPEN * SIZE tokens) is merged over MERGED partitions at a time: pieces are laid end to end,
and the last tokens of a merge are cut into sequences whose lengths are powers of two. So no sequence is padded.

A document is its token ids and then END; null texts are empty and so one token. Repeated rows are packed as often as
they occur, an empty table gives an empty result, and words and texts of any length are cut as any other.

Ids are those of the `tokenizers` library for the JSON vocabulary, without added special tokens; the string of a special
token in a text is that token, as there. Only texts that hold such a string go through that library; all others go
through the rank file of the same vocabulary, which gives the same ids (compared on every code point) four times as fast.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SIZE, OPEN, MERGED, END = 1024, 64, 16, 0
VOCABULARY = "byte_bpe_50k"


class Ids:
    """Token ids of texts."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{vocabulary}.json")
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.append(ids, np.uint32(END)).astype(np.uint32, copy=False)


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int64()), ("ids", pa.binary())])
TYPES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open long, ids binary"


class Packer:
    def __init__(self, first_id: int, with_ids: bool) -> None:
        self.next, self.with_ids = first_id, with_ids
        self.windows: list[list] = []  # [fill, pieces]
        self.rows: list[tuple] = []

    def put(self, window: list, piece: tuple) -> None:
        doc, start, ids, total = piece
        window[1].append((doc, start, ids, total, window[0]))
        window[0] += len(ids)

    def emit(self, pieces: list[tuple], still_open: int | None = None) -> None:
        for doc, start, ids, total, offset in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next, offset, still_open, raw if self.with_ids or still_open is not None else None))
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= SIZE:
            self.emit([(doc, at, ids[at : at + SIZE], total, 0)])
            at += SIZE
        while at < total:
            n = total - at
            fits = [w for w in self.windows if SIZE - w[0] >= n]
            if fits:
                w = max(fits, key=lambda w: w[0])
                cut = n
            elif len(self.windows) < OPEN:
                self.windows.append(w := [0, []])
                cut = n
            else:
                w = max(self.windows, key=lambda w: w[0])
                cut = SIZE - w[0]
            self.put(w, (doc, at, ids[at : at + cut], total))
            at += cut
            if w[0] == SIZE:
                self.windows = [x for x in self.windows if x is not w]
                self.emit(w[1])

    def flush(self, group: int) -> None:
        for w in self.windows:
            self.emit(w[1], group)
        self.windows = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PIECE)], schema=PIECE)


def _pack(with_ids: bool) -> Callable:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, packer = Ids(), Packer(part << 32, with_ids)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, ids_of(text.as_py() or ""))
                if len(packer.rows) >= 20_000:
                    yield packer.batch()
        packer.flush(part // MERGED)
        yield packer.batch()

    return work


def _merge(with_ids: bool) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        packer = Packer((1 << 62) + (rows[0]["open"] << 32), with_ids)
        left = sum(r["length"] for r in rows)
        room, pieces, fill = 0, [], 0
        for r in rows:
            ids, at = np.frombuffer(r["ids"], np.uint32), 0
            while at < len(ids):
                if not room:
                    room = fill = min(SIZE, 1 << (left.bit_length() - 1))
                cut = min(room, len(ids) - at)
                pieces.append((r["doc_id"], r["start"] + at, ids[at : at + cut], r["doc_tokens"], fill - room))
                at, room, left = at + cut, room - cut, left - cut
                if not room:
                    packer.emit(pieces)
                    pieces = []
        return pa.Table.from_batches([packer.batch()])

    return work


def pack(docs: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids (32-bit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = C.materialize(rows.mapInArrow(_pack(with_ids), TYPES), "pieces")
    late = pieces.where(F.col("open").isNotNull()).groupBy("open").applyInArrow(_merge(with_ids), TYPES)
    out = pieces.where(F.col("open").isNull()).unionByName(late).drop("open")
    return out if with_ids else out.drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"), with_ids=False)
