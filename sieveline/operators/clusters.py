"""Principal components, k-means families, tempo bands, medoids, names and a softmax model: passes over all rows.

What travels to the driver is a few numbers a cluster, class or component; what a pass sends up is one partial sum a
partition. Rows with a null vector take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearness import centroids
from .written import written

#: k-means++ starts from at most this many rows (the least hashes of the key); all rows are then assigned and averaged.
START_ROWS = 4096
#: Of so many starts the one of least inertia counts. Iterations that have not settled after MOST_ROUNDS are an error.
STARTS, MOST_ROUNDS = 5, 1000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(items: DataFrame, vector: str, *others: str) -> DataFrame:
    return items.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("_v"), *others)


def _summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a function that gives `size` numbers."""

    def work(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "x"])

    found = rows.mapInArrow(work, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # `size` rows
    out = np.zeros(size)
    for r in found:
        out[r[0]] = r[1]
    return out


def pca(items: DataFrame, vector: str, most: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) from exact sums of all rows; a component's largest entry is positive."""
    rows = _rows(items, vector)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not n:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    mean = _summed(rows, lambda b: _matrix(b.column(0)).sum(axis=0), dim) / n

    def centred(b):
        x = _matrix(b.column(0)) - mean
        return (x.T @ x).ravel()

    values, axes = np.linalg.eigh(_summed(rows, centred, dim * dim).reshape(dim, dim) / max(1, n - 1))
    top = np.argsort(-values, kind="stable")[: min(most, dim, n)]
    parts = axes[:, top].T
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    return mean, parts * signs[:, None], np.maximum(values[top], 0)


def families_wanted(n: int, per: int, least: int, most: int) -> int:
    """How many clusters n rows get."""
    return max(1, min(n, max(least, min(most, n // per))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over a few rows."""
    picked = [int(rng.integers(len(x)))]
    far = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)) and far.max() > 0:
        picked.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def kmeans(items: DataFrame, vector: str, key: str, k: int, seed: int = 0, rounds: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Centres of k-means over all rows, iterated until they settle or for `rounds`, where given.

    Of STARTS starts, which share their passes, the one of least inertia counts; `start` continues from an earlier
    build's centres alone. An emptied centre stays where it was.
    """
    rows = _rows(items, vector, key)
    if start is None:
        sample = rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(START_ROWS).collect()  # at most START_ROWS rows
        if not sample:
            return np.zeros((0, 0))
        x, rng = np.array([r[0] for r in sample], float), np.random.default_rng(seed)
        every = [_start(x, k, rng) for _ in range(STARTS)]
    else:
        every = [np.array(start, float)]
    dim, cost, open_ = every[0].shape[1], np.full(len(every), np.inf), list(range(len(every)))
    sizes = [c.shape[0] * (dim + 1) + 1 for c in every]
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        now = [every[i] for i in open_]

        def sums(b, now=now):
            x = _matrix(b.column(0))
            parts = []
            for centres in now:
                out = np.zeros((len(centres), dim + 1))
                at = _nearest(x, centres)
                np.add.at(out, at, np.c_[x, np.ones(len(x))])
                parts += [out.ravel(), [((x - centres[at]) ** 2).sum()]]
            return np.concatenate(parts)

        found, at, left = _summed(rows.select("_v"), sums, sum(sizes[i] for i in open_)), 0, []
        for i in open_:
            one, at = found[at : at + sizes[i]], at + sizes[i]
            table, before = one[:-1].reshape(-1, dim + 1), every[i]
            every[i], cost[i] = np.where(table[:, -1:] > 0, table[:, :-1] / np.maximum(table[:, -1:], 1), before), one[-1]
            if np.abs(every[i] - before).max() >= 1e-9:
                left.append(i)
        open_ = left
        if not open_:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"centres did not settle in {MOST_ROUNDS} rounds")
    return every[int(cost.argmin())]


def merged_centres(centres: np.ndarray, over: float = 0.80) -> np.ndarray:
    """The family of each centre: those whose cosine exceeds a threshold, also through others, are one (the least number)."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T > over
    family = np.arange(len(centres))
    for _ in range(len(centres)):
        least = np.where(near | np.eye(len(centres), dtype=bool), family[None, :], len(centres)).min(axis=1)
        if (least == family).all():
            break
        family = least
    return family


def assigned(items: DataFrame, vector: str, key: str, centres: np.ndarray, family: np.ndarray | None = None) -> DataFrame:
    """(key, cluster, distance) of every row with a vector; ties go to the lower centre."""
    group = np.arange(len(centres)) if family is None else family

    def work(batches):
        for b in batches:
            x = _matrix(b.column(0)) if b.num_rows else np.zeros((0, centres.shape[1]))
            at = _nearest(x, centres)
            away = np.sqrt(((x - centres[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(group[at].astype(np.int64)), pa.array(away)], names=[key, "cluster", "distance"])

    schema = T.StructType([items.schema[key], T.StructField("cluster", T.LongType()), T.StructField("distance", T.DoubleType())])
    return _rows(items, vector, key).mapInArrow(work, schema)


def medoid_order(distance: Column, support: Column, quality: Column, favoured: Column) -> Column:
    """The cost that picks a cluster's items: near the centre, well supported, clean and wanted."""
    return distance - 0.03 * (support - 1) - 0.06 * quality - F.when(favoured, 0.10).otherwise(0.0)


def picked(items: DataFrame, group: str, key: str, cost: Column, incumbent: Column, want: int) -> DataFrame:
    """The `want` cheapest items of each group, those of the build before first."""
    order = Window.partitionBy(group).orderBy(F.when(incumbent, 0).otherwise(1), cost, key)
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= want)


def _middle(counts: Counter) -> float:
    """The median of counted values."""
    values = sorted(counts)
    ends = np.cumsum([counts[v] for v in values])
    low, high = (values[int(np.searchsorted(ends, k, "right"))] for k in ((ends[-1] - 1) // 2, ends[-1] // 2))
    return (low + high) / 2


def thin_bands(bands: dict[int, dict[float, int]], least: int) -> dict[int, int]:
    """Band -> the first band of its group: thin ones join the neighbour whose median is nearer, then the smaller one.

    Of each band its values and how often they occur, from an aggregation over rounded tempos, so that a merged band has
    its true median. Bands without rows are in no group.
    """
    groups = [([band], Counter(counts)) for band, counts in sorted(bands.items()) if sum(counts.values())]
    while len(groups) > 1:
        size = [c.total() for _, c in groups]
        thin = int(np.argmin(size))
        if size[thin] >= least:
            break
        middle = _middle(groups[thin][1])
        beside = [i for i in (thin - 1, thin + 1) if 0 <= i < len(groups)]
        to = min(beside, key=lambda i: (abs(_middle(groups[i][1]) - middle), size[i], i))
        first = min(thin, to)
        groups[first : first + 2] = [(groups[first][0] + groups[first + 1][0], groups[first][1] + groups[first + 1][1])]
    return {band: names[0] for names, _ in groups for band in names}


def named(scores: list[dict[str, float]], strong: float = 1.5, weak: float = 0.75, before: dict[int, str] | None = None) -> list[str]:
    """A name for each of a few clusters: the best phrase over the strong threshold, then over the weak one, each
    phrase once; a number for the rest. Names of the build before stick where they are given."""
    names: dict[int, str] = dict(before or {})
    for least in (strong, weak):
        ranked = sorted((-z, i, p) for i, s in enumerate(scores) for p, z in s.items() if z >= least)
        for _, i, phrase in ranked:
            if i not in names and phrase not in names.values():
                names[i] = phrase
    return [names.get(i, f"family {i + 1}") for i in range(len(scores))]


class Softmax:
    """Standardised features to class probabilities at a temperature."""

    def __init__(self, mean, spread, w, b, temperature: float = 1.0) -> None:
        self.mean, self.spread, self.w, self.b, self.temperature = mean, spread, w, b, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.w + self.b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(items: DataFrame, vector: str, label: str, classes: int, held: Column, l2: float = 1e-3, rounds: int | None = None, prior: np.ndarray | None = None) -> Softmax:
    """A class-balanced softmax over all rows that aren't held out, pulled to a prior, by accelerated gradient passes.

    It stops where the held-out loss has not fallen for five rounds and keeps the best; its temperature is the one of
    least held-out loss. Labels are 0 to classes - 1; rows without a label or vector take no part. Without rows to
    hold out, it stops where the gradient is next to nothing, at temperature 1. `rounds` ends it before, where given.
    """
    rows = _rows(items.where(F.col(label).between(0, classes - 1)), vector, F.col(label).cast("int").alias("_y"), F.coalesce(held, F.lit(False)).alias("_h"))
    fit, hold = rows.where("NOT _h"), rows.where("_h")
    dim = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    counts = _summed(fit, lambda b: np.bincount(b.column(1).to_numpy(), minlength=classes).astype(float), classes)
    n = max(1.0, counts.sum())
    mean = _summed(fit, lambda b: _matrix(b.column(0)).sum(axis=0), dim) / n
    spread = np.sqrt(_summed(fit, lambda b: ((_matrix(b.column(0)) - mean) ** 2).sum(axis=0), dim) / n) + 1e-9
    weight = np.where(counts > 0, 1 / np.maximum(counts, 1) / max(1, (counts > 0).sum()), 0)
    start = np.zeros((dim, classes)) if prior is None else prior
    w, b, ahead_w, ahead_b = start.copy(), np.zeros(classes), start.copy(), np.zeros(classes)
    second = lambda batch: float(((((_matrix(batch.column(0)) - mean) / spread) ** 2).sum(axis=1) * weight[batch.column(1).to_numpy()]).sum())
    step = 1 / (0.5 * (_summed(fit, lambda x: np.array([second(x)]), 1)[0] + 1) + l2)

    def gradient(model):
        def of(batch):
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            g = (model.probabilities(x) - np.eye(classes)[y]) * weight[y][:, None]
            return np.concatenate((((x - mean) / spread).T @ g, g.sum(axis=0, keepdims=True))).ravel()

        return _summed(fit, of, (dim + 1) * classes).reshape(dim + 1, classes)

    heats = 2.0 ** np.arange(-3, 3.5, 0.5)

    def losses(model, heats):
        def of(batch):
            z, y = model.logits(_matrix(batch.column(0))), batch.column(1).to_numpy()
            out = [len(y)]
            for t in heats:
                s = z / t - (z / t).max(axis=1, keepdims=True)
                out.append(float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).sum()))
            return np.array(out, float)

        found = _summed(hold, of, len(heats) + 1)
        return found[1:] / found[0] if found[0] else None

    best, least, since = None, np.inf, 0
    for t in range(MOST_ROUNDS if rounds is None else rounds):
        g = gradient(Softmax(mean, spread, ahead_w, ahead_b))
        nw, nb = ahead_w - step * (g[:-1] + l2 * (ahead_w - start)), ahead_b - step * g[-1]
        ahead_w, ahead_b = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
        model = Softmax(mean, spread, w, b)
        loss = losses(model, [1.0])
        if loss is None:
            best = model
            if np.abs(np.concatenate((g[:-1] + l2 * (ahead_w - start), g[-1:]))).max() < 1e-4:
                break
        elif loss[0] < least - 1e-6:
            best, least, since = model, loss[0], 0
        elif (since := since + 1) >= 5:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"the model did not settle in {MOST_ROUNDS} rounds")
    model = best or Softmax(mean, spread, w, b)
    if (found := losses(model, heats)) is not None:
        model.temperature = float(heats[found.argmin()])
    return model


def classified(items: DataFrame, vector: str, key: str, model: Softmax) -> DataFrame:
    """(key, label, probability) of every row with a vector."""

    def work(batches):
        for b in batches:
            p = model.probabilities(_matrix(b.column(0))) if b.num_rows else np.zeros((0, len(model.b)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(p.argmax(axis=1).astype(np.int64)), pa.array(p.max(axis=1) if len(p) else np.zeros(0))], names=[key, "label", "probability"])

    schema = T.StructType([items.schema[key], T.StructField("label", T.LongType()), T.StructField("probability", T.DoubleType())])
    return _rows(items, vector, key).mapInArrow(work, schema)


def split_capped(groups: list[tuple[str, int, np.ndarray]], ceil: int) -> dict[str, int]:
    """How many parts each family is cut into, of (name, size, spread of its members) rows of a cluster table.

    A family over its ceiling is cut into as many parts as its members fill; the one whose members lie widest (spread
    times size) is served first, and a family of copies (no spread) is never cut, as its parts would be the same.
    """
    order = sorted(groups, key=lambda g: (-float(np.sum(g[2])) * g[1], g[0]))
    return {name: max(1, -(-size // ceil)) if size > ceil and float(np.sum(spread)) > 0 else 1 for name, size, spread in order}


def spread_capped(items: DataFrame, vector: str, group: str, key: str, cap: int) -> DataFrame:
    """At most `cap` rows a group that lie far apart: the row nearest to the group's mean, then again and again the one
    farthest from all that were taken (ties to the lesser key). Rows without a group are free.

    Every round is a pass over the rows with a group: a partial maximum for each group, joined back; no group meets in
    one task, and `cap` rounds do. Groups of at most `cap` rows stay whole.
    """
    rows = items.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    small = rows.join(sizes.where(F.col("_n") <= cap), group, "left_semi").select(key)
    large = written(rows.join(sizes.where(F.col("_n") > cap), group, "left_semi").select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")), "spread")
    middle = centroids(large, "v", "g").select("g", F.col("centroid").alias("c"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    first = large.join(middle, "g").groupBy("g").agg(F.min_by(F.struct("k", "v"), F.struct(far(F.col("v"), F.col("c")).alias("d"), "k")).alias("t"))
    first = written(first, "taken")
    taken = first.select("t.k")
    left = large.withColumn("near", F.lit(float("inf")))
    for _ in range(cap - 1):
        left = written(left.join(first, "g").select("g", "k", "v", F.least("near", far(F.col("v"), F.col("t.v"))).alias("near")), "spread")
        first = written(left.groupBy("g").agg(F.min_by(F.struct("k", "v"), F.struct((-F.col("near")).alias("d"), "k")).alias("t")), "taken")
        taken = taken.unionByName(first.select("t.k"))
    chosen = small.select(F.col(key).alias("_k")).unionByName(taken.select(F.col("k").alias("_k"))).distinct()
    return items.where(F.col(group).isNull()).unionByName(items.where(F.col(group).isNotNull()).join(chosen, F.col(key) == F.col("_k"), "left_semi"))
