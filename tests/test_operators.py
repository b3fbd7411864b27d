"""Operators on small literal tables: nulls, ties, empty tables, and loops restated."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import names as N
from sieveline.functions import tempo as T
from sieveline.operators import copies, diffs, labels, selection


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_pruning_equals_a_loop(spark):
    rng = random.Random(1)
    for n in (1, 8, 30):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15]
        rank = list(range(n))
        rng.shuffle(rank)
        near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
        kept = []
        for i in sorted(range(n), key=rank.__getitem__):
            if not near[i] & set(kept):
                kept.append(i)
        nodes = spark.createDataFrame([(i, rank[i]) for i in range(n)], "id long, r int")
        got = copies.pruned(nodes, spark.createDataFrame(pairs, "a long, b long"), "id", "r", lambda d: d.checkpoint())
        rows = {r.id: r for r in got.collect()}
        assert {i for i, r in rows.items() if r.kept} == set(kept)
        assert all(rows[i].partner in near[i] & set(kept) for i in range(n) if i not in kept)


def test_nested_labels_tell_empty_from_unseen(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    some = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "id long, rank int, label string")
    covered = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.id: r.labels for r in labels.nested(items, some, "id", covered).collect()}
    assert got == {1: ["a", "b"], 2: [], 3: None}


def test_moves_are_one_to_one(spark):
    gone = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "k string, h string")
    new = spark.createDataFrame([("d", "x"), ("e", "y")], "k string, h string")
    assert [tuple(r) for r in copies.moves(gone, new, "k", ["h"]).collect()] == [("a", "d")]


def test_release_plan_on_empty_base(spark):
    base = spark.createDataFrame([], "k string, d string")
    now = spark.createDataFrame([("a", "x")], "k string, d string")
    assert [tuple(r) for r in diffs.release_plan(base, now, "k", "d").collect()] == [("a", "added")]


def test_budget_meets_its_bounds(spark):
    def shares(sizes, budget, floor, ceil):
        df = spark.createDataFrame(list(enumerate(sizes)), "fam long, n long")
        return [r.share for r in selection.apportioned(df, "fam", "n", budget, floor, ceil).orderBy("fam").collect()]

    assert shares([], 10, 1, 5) == []
    assert shares([100, 50, 10], 60, 5, 40) == [36, 19, 5]
    assert shares([3, 3], 100, 1, 50) == [3, 3]
    assert shares([100, 100, 1, 1, 1], 4, 1, 50) == [1, 1, 1, 1, 1]
    assert shares([90, 5, 5], 30, 4, 20) == [20, 5, 5]
    assert shares([40, 40, 20], 7, 0, 50) == [3, 3, 1]
    rng = random.Random(3)
    for _ in range(4):
        sizes = [rng.randint(1, 60) for _ in range(9)]
        budget, floor, ceil = rng.randint(5, 150), rng.randint(0, 6), rng.randint(8, 30)
        low, high = [min(floor, x) for x in sizes], [min(ceil, x) for x in sizes]
        got = shares(sizes, budget, floor, ceil)
        assert all(a <= x <= b for a, x, b in zip(low, got, high, strict=True))
        assert sum(got) == min(max(budget, sum(low)), sum(high))


def test_share_cap_leaves_few_groups_and_nulls_alone(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else None if i < 95 else "b") for i in range(100)], "id long, g string")
    assert selection.share_capped(rows, "g", "id", 0.4).count() == 100
    rows = spark.createDataFrame([(i, "a" if i < 80 else "b" if i < 90 else "c") for i in range(100)], "id long, g string")
    got = {r.g: r["count"] for r in selection.share_capped(rows, "g", "id", 0.4).groupBy("g").count().collect()}
    assert got == {"a": 13, "b": 10, "c": 10}


def test_tempo_folds_and_names(spark):
    row = spark.range(1).select(
        T.fold_closed(F.lit(30.0)).alias("a"), T.fold_closed(F.lit(401.0)).alias("b"), T.fold_half_open(F.lit(200.0), 100, 200).alias("c"), T.fold_closed(F.lit(-1.0)).alias("d"),
        N.note_of(F.lit("Bass C3 long")).alias("n"), N.note_of(F.lit("C3 or D3")).alias("two"), N.ascii_name(F.lit("Café ﬁn")).alias("s"), F.array_join(N.words(F.lit("kickDrum01_v2")), " ").alias("w"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (60.0, 100.25, 100.0, None)
    assert (row.n, row.two, row.s, row.w) == (60, None, "Cafe fin", "kick drum 01 v 2")


def test_pruning_of_long_chains_decides_every_row(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(56)], "id long, r long").coalesce(1)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(55)], "a long, b long").coalesce(1)
    write = lambda d: d.coalesce(1).localCheckpoint()
    got = {r.id: r.kept for r in copies.pruned(nodes, pairs, "id", "r", write).collect()}
    assert got == {i: i % 2 == 0 for i in range(56)}
    with pytest.raises(RuntimeError):
        copies.pruned(nodes, pairs, "id", "r", write, most_rounds=2)


def test_pruning_ends_whole_on_long_chains(spark, tmp_path):
    from sieveline.operators.written import written

    nodes = spark.range(70).withColumnRenamed("id", "k")
    pairs = spark.range(69).selectExpr("id a", "id + 1 b")
    got = {r.k: (r.kept, r.partner) for r in copies.pruned(nodes, pairs, "k", "k", lambda df: written(df, "chain").coalesce(2)).collect()}
    assert got == {k: (k % 2 == 0, None if k % 2 == 0 else k - 1) for k in range(70)}


def test_blocks_of_pairs_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    from sieveline.operators import nearness

    monkeypatch.setattr(nearness, "BLOCK_ROWS", 7)
    x = np.random.default_rng(2).normal(size=(60, 5))
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(90, 0, None), (91, None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and x[i] @ x[j] >= 1.5}
    assert {(r.a, r.b) for r in nearness.close_pairs(df, "v", "id", "g", 1.5).collect()} == want
    near = nearness.nearest_in_group(df.where("id < 4"), df, "v", "id", "g", 3).collect()
    for q in range(4):
        order = sorted((j for j in range(60) if j % 2 == q % 2 and j != q), key=lambda j: -(x[q] @ x[j]))[:3]
        assert [r.b for r in sorted((r for r in near if r.a == q), key=lambda r: r.place)] == order
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {r.id: r.nearest for r in nearness.nearest_to_set(df.where("id < 60"), df.where("id < 30"), "v", "id").collect()}
    assert all(abs(best[i] - max(u[i] @ u[j] for j in range(30) if j != i)) < 1e-12 for i in range(60))


def test_paths_through_parents(spark):
    from sieveline.operators import trees

    rows = [("a", None, "A")] + [(f"a{i}", "a" if i == 0 else f"a{i - 1}", str(i)) for i in range(9)] + [("x", "y", "X"), ("y", "x", "Y"), ("z", "y", "Z"), ("o", "gone", "O")]
    got = {r.id: (r.path, r.depth) for r in trees.paths(spark.createDataFrame(rows, "id string, up string, name string"), "id", "up", "name").collect()}
    assert got["a8"] == ("A/0/1/2/3/4/5/6/7/8", 10) and got["o"] == ("O", 1) and got["a"] == ("A", 1)
    assert all(got[k] == (None, None) for k in "xyz")
