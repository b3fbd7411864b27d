"""Op 2: mixing documents to target weights over soft domains.

A softmax classifier over the presence of chosen terms, learned on the labelled table, gives each document a posterior p over domains (quality x toxic).
With n tokens in a document and T in all, the rates r >= 0 minimise, for a small e,

    || sum_d r_d n_d p_d / T - b ||^2 / 2e  +  sum_d n_d (r_d - 1)^2 / 2T

where b are the target token shares: of all rates that meet the targets, those nearest to 1. The optimum is
r = max(0, 1 - p . m) for one number m a domain, found by Newton steps on the dual, which hold rare domains as strictly
as large ones. Only m travels: a round is one distributed pass over (tokens, posterior) that tries TRIES step lengths.
Each e is solved to its optimum, and e falls until every share is within TOLERANCE of its target or until the gap
falls no further: then no rates meet the targets, and a warning names the gap that is left. ROUNDS without an optimum
are an error.

The classifier sees at most SAMPLE labelled rows (the least hashes of doc_id) of at most MOST_BYTES bytes; posteriors
and totals cover every row and whole texts. Null text is empty: no tokens, and a posterior of the classifier's bias. Without
labelled rows all posteriors are uniform, so that no rates can change a share: rates stay near 1 and a warning says so.
Repeated rows have equal rates. Columns of any name are carried through `mixed`. Empty tables give empty results.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .common import U64

SAMPLE, MOST_BYTES, FEATURES, ROUNDS, TOLERANCE, CHUNK = 6000, 20_000, 2048, 200, 1e-3, 1 << 20
#: Step lengths tried in one pass; the penalties e, and how near to the optimum of each Newton goes.
TRIES, PENALTIES, SETTLED = 0.5 ** np.arange(12), 10.0 ** -np.arange(1, 10), 1e-5
#: Target shares of all tokens: good and clean text is raised, the others are lowered.
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
TARGET = {"q0t0": 0.10, "q0t1": 0.0, "q1t0": 0.87, "q1t1": 0.03}


KIND = np.full(256, 1, np.uint8)  # letters and bytes beyond ASCII; 0 white space, 2 digits, 3 other signs
KIND[:128] = [0 if c in b" \t\n\v\f\r" else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BITS = 18


class Terms:
    """Hashed terms (runs of bytes of one kind, in lower case) and tokens (runs between white space) of UTF-8 texts."""

    def __init__(self) -> None:
        self.table, self.powers = C.byte_table(2)[LOWER], C.Powers()

    def __call__(self, text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each term, its hash of BITS bits, tokens of each row)."""
        rows, n = len(off) - 1, len(text)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
        up, down = self.powers.get(n + 1)
        h = np.concatenate((np.zeros(1, U64), np.cumsum(self.table[text] * up[:n])))
        kind = KIND[text]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        token = (kind > 0) & edge[:n]
        token[1:] |= (kind[1:] > 0) & (kind[:-1] == 0)
        edge[1:n] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        s, e = at[:-1], at[1:]
        words = kind[s] > 0
        s, e = s[words], e[words]
        row = np.searchsorted(off, s, "right") - 1
        counts = np.bincount(np.searchsorted(off, np.flatnonzero(token), "right") - 1, minlength=rows)
        return row, (C.mix((h[e] - h[s]) * down[s]) >> U64(64 - BITS)).astype(np.int64), counts


class Classifier:
    """Softmax over the presence of chosen terms."""

    def __init__(self, chosen: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
        self.chosen, self.w, self.b = chosen, w, b

    def present(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        f = self.chosen[term]
        out = np.zeros((rows, len(self.w)), np.float32)
        out[row[f >= 0], f[f >= 0]] = 1
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(row: np.ndarray, term: np.ndarray, y: np.ndarray, k: int, rounds: int = 200, l2: float = 1e-3) -> Classifier:
    """The FEATURES terms that depend most on the domain (chi square), and a regression by accelerated descent."""
    prior = np.maximum(np.bincount(y, minlength=k), 0.5) / len(y)
    pairs = np.unique(row * (1 << BITS) + term)
    row, term = pairs >> BITS, pairs & ((1 << BITS) - 1)
    seen = np.stack([np.bincount(term[y[row] == c], minlength=1 << BITS) for c in range(k)], axis=1)
    usual = seen.sum(axis=1, keepdims=True) * prior
    chosen = np.full(1 << BITS, -1, np.int64)
    top = np.argsort(-((seen - usual) ** 2 / (usual + 1)).sum(axis=1), kind="stable")[:FEATURES]
    chosen[top] = np.arange(len(top))
    model = Classifier(chosen, np.zeros((len(top), k), np.float32), np.log(prior).astype(np.float32))
    x = model.present(row, term, len(y))
    v = np.ones(len(top), np.float32)
    for _ in range(10):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-9)
    step = 1 / (0.5 * np.linalg.norm(x @ v) ** 2 / len(y) + l2 + 0.5)
    truth = np.eye(k, dtype=np.float32)[y]
    w, b = model.w, model.b
    ahead = Classifier(chosen, w, b)
    for t in range(rounds):
        g = (ahead.posterior(x) - truth) / len(y)
        nw, nb = ahead.w - step * (x.T @ g + l2 * ahead.w), ahead.b - step * g.sum(axis=0)
        m = np.float32(t / (t + 3))
        ahead = Classifier(chosen, nw + m * (nw - w), nb + m * (nb - b))
        w, b = nw, nb
    return Classifier(chosen, w, b)


def learn(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """From labels (doc_id, quality, toxic); None without usable rows."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max(2 * F.col("quality") + F.col("toxic")).alias("y"))
    picked = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # at most SAMPLE rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_BYTES).join(picked, F.col("doc_id") == F.col("id")).select("id", "y", "text")
    rows = sorted({(r[0], r[1], r[2]) for r in rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(SAMPLE).collect()})
    if not rows:
        return None
    terms, found = Terms(), []
    for lo in range(0, len(rows), 200):
        raw = [r[2].encode("utf-8", "replace") for r in rows[lo : lo + 200]]
        row, term, _ = terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64))
        found.append((row + lo, term))
    return fit(*(np.concatenate(x) for x in zip(*found, strict=True)), np.array([r[1] for r in rows]), len(DOMAINS))


def posteriors(docs: DataFrame, model: Classifier | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with tokens (long) and posterior (array<double>)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS places and FEATURES x domains numbers
    at = len(keep)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = sent.value, Terms()
        for batch in batches:
            text, off = C.strings(batch.column(at))
            for lo, hi in C.chunks(off, CHUNK):
                row, term, tokens = terms(text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                p = m.posterior(m.present(row, term, hi - lo)).astype(np.float64) if m else np.full((hi - lo, len(DOMAINS)), 1 / len(DOMAINS))
                p = pa.ListArray.from_arrays(np.arange(0, p.size + 1, len(DOMAINS), dtype=np.int32), p.ravel())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(at)), pa.array(tokens, pa.int64()), p], names=[*keep, "tokens", "posterior"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(work, schema)


def rate(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rates of posteriors under the dual numbers m."""
    return np.maximum(0, 1 - p @ m)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def solve(found: DataFrame, target: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(m, token shares less targets) over (tokens, posterior) rows."""
    k = len(DOMAINS)
    b = np.array([target[d] for d in DOMAINS])
    total = found.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return np.zeros(k), np.zeros(k)
    width = k + k * k + 1

    def tried(points: np.ndarray) -> np.ndarray:
        """For each m of points: sum w r p, sum w p p' where r > 0, and sum w r^2, with w = n / T."""

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(points), width))
            for batch in batches:
                if len(batch):
                    p, w = _matrix(batch.column(1)), batch.column(0).to_numpy() / total
                    for i, m in enumerate(points):
                        r = rate(p, m)
                        out[i] += np.concatenate(((w * r) @ p, ((w * (r > 0))[:, None] * p).T @ p, [(w * r) @ r]), axis=None)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "x"])

        parts = found.select("tokens", "posterior").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x")).collect()
        out = np.zeros(len(points) * width)
        for i, x in parts:
            out[i] = x
        return out.reshape(len(points), width)

    m, last, rounds = np.zeros(k), np.inf, 0
    now = tried(m[None])[0]
    for e in PENALTIES:
        while True:
            gap = now[:k] - b
            slope = e * m - gap
            if np.abs(slope).max() < SETTLED:
                break
            if (rounds := rounds + 1) > ROUNDS:
                raise RuntimeError(f"no optimum in {ROUNDS} rounds; shares less targets: {gap}")
            step = np.linalg.solve(now[k:-1].reshape(k, k) + e * np.eye(k), slope)
            points = m - TRIES[:, None] * step
            got = tried(points)
            height = e / 2 * (points**2).sum(axis=1) + got[:, -1] / 2 + points @ b
            best = int(height.argmin())
            if height[best] >= e / 2 * m @ m + now[-1] / 2 + m @ b:
                break  # as low as floating point tells
            m, now = points[best], got[best]
        most = np.abs(now[:k] - b).max()
        if most <= TOLERANCE or most > 0.99 * last:
            break
        last = most
    return m, now[:k] - b


def rates(docs: DataFrame, labels: DataFrame, keep: list[str], target: dict[str, float] = TARGET) -> DataFrame:
    """The columns `keep` with tokens, posterior and rate."""
    found = C.materialize(posteriors(docs, learn(docs, labels), keep), "posteriors")
    m, gap = solve(found, target)
    if np.abs(gap).max() > TOLERANCE:
        warnings.warn(f"no rates meet the targets; token shares less targets: {dict(zip(DOMAINS, gap.round(5).tolist(), strict=True))}", stacklevel=2)
    at = len(keep)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rate(_matrix(batch.column(at + 1)), m) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, pa.float64())], names=[*keep, "tokens", "posterior", "rate"])

    return found.mapInArrow(apply, T.StructType([*found.schema.fields, T.StructField("rate", T.DoubleType())]))


def mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET) -> DataFrame:
    """The rows of docs, each as often as its rate says: the whole part, and one more with the fraction's probability.

    The draw is a hash of the row, so a run repeats itself.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"])
    if "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    found = rates(rows.withColumn("doc_id", F.col("row.doc_id")), labels, ["row"], target)
    draw = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 20)) / float(1 << 20)
    times = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return found.withColumn("n", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate")
