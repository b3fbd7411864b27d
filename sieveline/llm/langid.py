"""Op 4: language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Letters are folded to lower case and to an alphabet of 62 frequent letters and one for the rest; everything else is
one separator. Each language has a character model of order 4 with absolute discounts; probabilities of seen strings
and back-off weights of seen contexts lie in sorted arrays of hashes. A document takes the language of the lowest
cross-entropy per character (ties: the first by name). Its score is a posterior whose sharpness is fitted on a fifth
of the learning sample, and it is rejected where its cross-entropy lies beyond all that this fifth shows, with a
margin that widens for short texts.

Learning takes at most PER_LANG documents of each language (the least hashes of doc_id; those beyond MOST_CHARS
characters only where the others are too few, and of them that many characters); scoring reads every whole text. Null
texts and texts without letters are `und` with score 0 and rejected. Bytes that are no UTF-8 count as U+FFFD. Repeated
rows are scored alike, and columns of other names are not read. Without any document to learn from, all is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .common import U64

PER_LANG, MOST_CHARS, ORDER, CHUNK = 300, 20_000, 4, 1 << 20


class KneserNey:
    """Hash arrays of one language: for each order, seen strings with probabilities and seen contexts with weights."""

    def __init__(self, codes: np.ndarray) -> None:
        grams, count = np.unique(codes, return_counts=True)
        levels = [(ORDER, grams, count)]
        for n in range(ORDER - 1, 0, -1):
            grams, count = np.unique(grams & ((1 << 6 * n) - 1), return_counts=True)
            levels.append((n, grams, count))
        self.grams: list = [None] * (ORDER + 1)
        self.contexts: list = [None] * (ORDER + 1)
        for n, grams, count in reversed(levels):
            ones, twos = int((count == 1).sum()), int((count == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, at = np.unique(grams >> 6, return_inverse=True)
            total = np.bincount(at, count).astype(float)
            back = d * np.bincount(at) / total
            p = np.maximum(count - d, 0) / total[at] + back[at] * self.prob(grams & ((1 << 6 * (n - 1)) - 1), n - 1)
            self.grams[n] = self.sorted(grams, p, n)
            self.contexts[n] = self.sorted(ctx, back, n + 16)

    @staticmethod
    def hashed(codes: np.ndarray, n: int) -> np.ndarray:
        return C.mix(codes.astype(U64) + U64(n << 40))

    def sorted(self, codes, values, n):
        h = self.hashed(codes, n)
        order = np.argsort(h)
        return h[order], values[order]

    @staticmethod
    def find(pair, h):
        keys, values = pair
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.nan)

    def prob(self, codes: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(codes), 1 / 64)
        p = self.find(self.grams[n], self.hashed(codes, n))
        miss = np.isnan(p)
        if miss.any():
            back = self.find(self.contexts[n], self.hashed(codes[miss] >> 6, n + 16))
            p[miss] = np.where(np.isnan(back), 1, back) * self.prob(codes[miss] & ((1 << 6 * (n - 1)) - 1), n - 1)
        return p


def alphabet(texts: list[str]) -> np.ndarray:
    """Code point -> 0 for no letter, 1 to 62 for the most frequent letters, 63 for others."""
    seen = Counter()
    for t in texts:
        seen.update(t.lower())
    top = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:62]
    number = {c: i + 1 for i, c in enumerate(top)}
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            out[cp] = number.get(c.lower()[:1], 63)
    return out


def coded(text: np.ndarray, off: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order-4 codes of all characters, their start for each text, whether the text has a letter); texts of UTF-8."""
    try:
        points = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return coded(*packed([text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]), letters)
    begins = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))[off]
    c = letters[points].astype(np.int64)
    first = np.zeros(len(c) + 1, bool)
    first[begins] = True
    keep = (c > 0) | np.concatenate(([True], c[:-1] > 0))[: len(c)] | first[: len(c)]
    seen = np.concatenate(([0], np.cumsum(c > 0)))
    has = seen[begins[1:]] > seen[begins[:-1]]
    begins = np.concatenate(([0], np.cumsum(keep)))[begins]
    c = c[keep]
    codes = c.copy()
    lens = np.diff(begins)
    place = np.arange(len(c)) - np.repeat(begins[:-1], lens)
    for n in range(1, ORDER):
        codes[n:] |= np.where(place[n:] >= n, c[:-n] << (6 * n), 0)
    return codes, begins, has


class Model:
    def __init__(self, langs: list[str], tables: list[KneserNey], letters: np.ndarray, sharp: float = 1.0, mean=None, slack: float = np.inf) -> None:
        self.langs, self.tables, self.letters, self.sharp, self.mean, self.slack = langs, tables, letters, sharp, mean, slack

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "logs", "used")}

    def entropies(self, text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits per character for each text and language, characters, whether it has a letter)."""
        if not hasattr(self, "slot"):
            self.slot, self.logs, self.used = np.full(1 << 24, -1, np.int32), np.zeros((1024, len(self.langs)), np.float32), 0
        codes, begins, has = coded(text, off, self.letters)
        new = codes[self.slot[codes] < 0]
        if len(new):
            new = np.unique(new)
            if (need := self.used + len(new)) > len(self.logs):
                self.logs = np.concatenate((self.logs, np.zeros((2 * need - len(self.logs), len(self.langs)), np.float32)))
            self.logs[self.used : need] = np.stack([-np.log2(t.prob(new)) for t in self.tables], axis=1)
            self.slot[new] = np.arange(self.used, need)
            self.used = need
        n = np.diff(begins)
        out = np.zeros((len(n), len(self.langs)))
        if (full := np.flatnonzero(n > 0)).size:
            out[full] = np.add.reduceat(self.logs[self.slot[codes]], begins[full], axis=0, dtype=np.float64) / n[full, None]
        return out, n, has

    def stretch(self, bits: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (bits[np.arange(len(best)), best] - self.mean[best]) * np.minimum(1, np.sqrt(n / 100))

    def predict(self, text: np.ndarray, off: np.ndarray):
        if not self.langs:
            n = len(off) - 1
            return [None] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        bits, n, has = self.entropies(text, off)
        best = bits.argmin(axis=1)
        low = bits.min(axis=1)
        p = 1 / np.exp2((low[:, None] - bits) * self.sharp).sum(axis=1)
        out = ~has | (self.stretch(bits, best, n) > self.slack)
        return [self.langs[b] if h else None for b, h in zip(best, has, strict=True)], np.where(has, p, 0.0), np.where(has, low, 0.0), out


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)


def learn(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows; each fifth row calibrates."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], [], np.zeros(0x110000, np.uint8))
    letters = alphabet([t for _, t in rows])
    by = {lang: [t for x, t in rows if x == lang] for lang in langs}
    fit = {lang: [t for i, t in enumerate(ts) if i % 5 or len(ts) < 5] for lang, ts in by.items()}
    hold = [(k, t) for k, lang in enumerate(langs) for i, t in enumerate(by[lang]) if i % 5 == 0]
    tables = [KneserNey(coded(*packed(fit[lang]), letters)[0]) if any(fit[lang]) else KneserNey(np.zeros(1, np.int64)) for lang in langs]
    model = Model(langs, tables, letters)
    bits, n, has = model.entropies(*packed([t for _, t in hold]))
    truth = np.array([k for k, _ in hold])
    bits, n, truth = bits[has], n[has], truth[has]
    if not len(truth):
        model.mean = np.full(len(langs), 6.0)
        return model
    best = bits.argmin(axis=1)
    low = bits.min(axis=1, keepdims=True)
    loss = lambda s: np.mean((bits[np.arange(len(truth)), truth] - low[:, 0]) * s + np.log2(np.exp2((low - bits) * s).sum(axis=1)))
    model.sharp = float(min(2.0 ** np.arange(0, 7, 0.5), key=loss))
    model.mean = np.array([np.median(bits[best == k, k]) if (best == k).any() else np.median(low) for k in range(len(langs))])
    model.slack = float(max(2.5, 1.5 * model.stretch(bits, best, n).max()))
    return model


def sample(docs: DataFrame, may_learn) -> list[tuple[str, str]]:
    """At most PER_LANG (lang, text) rows of each language that `may_learn` allows, of at most MOST_CHARS characters each."""
    able = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    able = able.select(F.col("doc_id").alias("id"), F.col("lang").alias("la"), F.xxhash64("doc_id").alias("h"), (F.length("text") > MOST_CHARS).alias("long"))
    ranked = able.withColumn("r", F.row_number().over(Window.partitionBy("la").orderBy("long", "h", "id"))).where(F.col("r") <= PER_LANG)
    picked = F.broadcast(ranked.select("id", "la").distinct())  # at most PER_LANG rows a language
    rows = docs.where(may_learn).select("doc_id", "lang", F.substring("text", 1, MOST_CHARS).alias("t")).join(picked, (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("lang") == F.col("la")))
    one = rows.where("t IS NOT NULL").groupBy("lang", "doc_id").agg(F.min("t").alias("t"))
    return sorted((r[0], r[1]) for r in one.select("lang", "t").collect())


def train(docs: DataFrame, may_learn=None) -> Model:
    return learn(sample(docs, F.lit(True) if may_learn is None else may_learn))


def _predict(model) -> Callable:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            text, off = C.strings(batch.column(1))
            for lo, hi in C.chunks(off, CHUNK):
                lang, p, bits, out = m.predict(text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x or "und" for x in lang], pa.string()), pa.array(p), pa.array(bits), pa.array(out)], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    return work


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (per character), rejected of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with the columns they came with; a null lang becomes the language found."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns and docs.schema["lang"].dataType.simpleString() == "string" else None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text, off = C.strings(batch.column(at))
            for lo, hi in C.chunks(off, CHUNK):
                found, _, _, out = m.predict(text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                part = batch.slice(lo, hi - lo)
                if lang is not None and part.column(lang).null_count:
                    said = part.column(lang)
                    part = part.set_column(lang, part.schema.field(lang), pa.array([f if s is None else s for s, f in zip(said.to_pylist(), found, strict=True)], said.type))
                yield part.filter(pa.array(~out))

    return docs.mapInArrow(work, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "rejected")
