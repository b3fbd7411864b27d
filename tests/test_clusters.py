"""Clustering, components, bands, names and the softmax model against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import clusters as C


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    middle = np.array([[8, 0, 0, 1], [0, 8, 0, 1], [0, 0, 8, 1.0]])
    x = np.concatenate([m + rng.normal(size=(40, 4)) for m in middle])
    rows = [(i, [float(v) for v in r], i // 40) for i, r in enumerate(x)] + [(900, None, 0)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(4)


def test_pca_equals_svd(blobs):
    x, df = blobs
    mean, parts, variance = C.pca(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(variance, s[:3] ** 2 / (len(x) - 1))
    assert np.allclose(np.abs(parts @ vt[:3].T), np.eye(3), atol=1e-6)


def test_kmeans_finds_the_groups_and_warm_starts(blobs):
    x, df = blobs
    centres = C.kmeans(df, "v", "id", 3, seed=1)
    got = {r.id: r.cluster for r in C.assigned(df, "v", "id", centres).collect()}
    assert len(got) == 120 and 900 not in got
    assert all(len({got[i] for i in range(g * 40, g * 40 + 40)}) == 1 for g in range(3)) and len(set(got.values())) == 3
    assert np.allclose(C.kmeans(df, "v", "id", 3, start=centres, rounds=1), centres)
    for c in range(3):
        assert np.allclose(centres[c], x[[i for i, k in got.items() if k == c]].mean(axis=0))
    assert C.families_wanted(10, 800, 8, 30) == 8 and C.families_wanted(5, 800, 8, 30) == 5 and C.families_wanted(10**6, 800, 8, 30) == 30


def test_empty_tables_have_no_centres(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert C.kmeans(none, "v", "id", 3).shape == (0, 0) and C.pca(none, "v")[0].size == 0


def test_near_centres_merge_through_each_other():
    at = np.radians([0, 30, 60, 170])
    assert C.merged_centres(np.c_[np.cos(at), np.sin(at)]).tolist() == [0, 0, 0, 3]


def test_thin_bands_join_the_nearer_neighbour():
    assert C.thin_bands({0: {80.0: 100}, 1: {95.0: 3}, 2: {120.0: 50}}, 10) == {0: 0, 1: 0, 2: 2}
    assert C.thin_bands({0: {80.0: 1}, 1: {100.0: 2}}, 10) == {0: 0, 1: 0}
    assert C.thin_bands({0: {80.0: 40}, 1: {100.0: 3}, 2: {120.0: 20}, 3: {}}, 10) == {0: 0, 1: 1, 2: 1}  # a tie goes to the smaller
    assert C.thin_bands({0: {80.0: 4, 81.0: 5}, 1: {140.0: 2}, 2: {150.0: 12}, 3: {160.0: 3}}, 5) == {0: 0, 1: 1, 2: 1, 3: 1}
    # 100 joins 90 (a tie, and the smaller); their median is 90, not a mean of medians, so 96 would go there
    assert C.thin_bands({0: {90.0: 8}, 1: {100.0: 2}, 2: {110.0: 9}, 3: {200.0: 20}}, 5) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert C.thin_bands({}, 10) == {}


def test_names_are_exclusive_and_stick():
    scores = [{"dark": 2.0, "soft": 1.6}, {"dark": 2.5}, {"soft": 0.8}, {}]
    assert C.named(scores) == ["soft", "dark", "family 3", "family 4"]
    assert C.named(scores, before={0: "dark"}) == ["dark", "family 2", "soft", "family 4"]


def test_medoids_prefer_incumbents(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, False), (2, 0, 0.1, False), (3, 0, 0.9, True), (4, 1, 0.2, False)], "id long, c int, d double, inc boolean")
    cost = C.medoid_order(F.col("d"), F.lit(1), F.lit(1.0), F.lit(False))
    assert sorted(r.id for r in C.picked(rows, "c", "id", cost, F.col("inc"), 2).collect()) == [2, 3, 4]


def test_softmax_learns_and_calibrates(blobs):
    x, df = blobs
    model = C.train(df, "v", "y", 3, F.col("id") % 5 == 0, rounds=25)
    got = {r.id: (r.label, r.probability) for r in C.classified(df, "v", "id", model).collect()}
    assert np.mean([got[i][0] == i // 40 for i in range(120)]) > 0.97
    assert all(0 <= p <= 1 for _, p in got.values()) and model.temperature in 2.0 ** np.arange(-3, 3.5, 0.5)


def test_centres_of_many_rows_settle(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(size=(1500, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    centres = C.kmeans(df, "v", "id", 8)
    at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose([x[at == i].mean(axis=0) for i in range(8)], centres, atol=1e-8)
    early = C.kmeans(df, "v", "id", 8, rounds=10)
    assert not np.allclose(early, C.kmeans(df, "v", "id", 8, start=early, rounds=1), atol=1e-8)


def test_caps_by_spread_and_splits(spark):
    x = [[0.0, 0.0], [0.1, 0.0], [5.0, 0.0], [5.1, 0.0], [0.0, 7.0], [2.0, 2.0]]
    rows = [(i, "a", v) for i, v in enumerate(x)] + [(10, "b", [1.0, 1.0]), (11, None, [1.0, 1.0]), (12, "b", [9.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = {r.id for r in C.spread_capped(df, "v", "g", "id", 3).collect()}
    middle = np.mean(x, axis=0) / np.linalg.norm(np.mean(x, axis=0))
    taken = [min(range(6), key=lambda i: (np.linalg.norm(x[i] - middle), i))]
    while len(taken) < 3:
        taken.append(max((i for i in range(6) if i not in taken), key=lambda i: (min(np.linalg.norm(np.subtract(x[i], x[j])) for j in taken), -i)))
    assert got == {*taken, 10, 11, 12}
    assert C.split_capped([("a", 100, np.array([1.0])), ("b", 100, np.zeros(1)), ("c", 10, np.ones(1))], 40) == {"a": 3, "b": 1, "c": 1}
