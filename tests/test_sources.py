"""Files, audio measures and stored tables: round trips over small fixtures."""

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import audio as A
from sieveline.operators import stored as S
from sieveline.sources import files as W

RATE = 8000


def wave(x, bits=16, *extra):
    x = np.atleast_2d(x.T).T
    ints = np.clip(np.round(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)
    body = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in ints.ravel()) if bits == 24 else (ints + 128).astype(np.uint8).tobytes() if bits == 8 else ints.astype(f"<i{bits // 8}").tobytes()
    n = x.shape[1]
    parts = [b"fmt " + struct.pack("<IHHIIHH", 16, 1, n, RATE, RATE * n * bits // 8, n * bits // 8, bits), b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1), *extra]
    return b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WAVE" + b"".join(parts)


def acid(bpm, beats, root, flags):
    return b"acid" + struct.pack("<IIHHfIHHf", 24, flags, root, 0, 0.0, beats, 4, 4, bpm)


def hits(*at, level=0.5, seconds=1.0):
    x = np.zeros(int(RATE * seconds))
    for i, a in enumerate(at):
        s = int(a * RATE)
        x[s : s + 400] = level * (0.5**i) * np.sin(np.arange(400) * 0.7)
    return x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    (at / "a b").mkdir()
    (at / "a b" / "echo.wav").write_bytes(wave(hits(0.0, 0.25, 0.5), 16, acid(120.0, 4, 60, 2)))
    (at / "one.WAV").write_bytes(wave(np.stack([hits(0.1), -hits(0.1)], 1), 24, b"smpl" + struct.pack("<I9I", 36, 0, 0, 0, 62, 0, 0, 0, 0, 0)))
    (at / "silent.wav").write_bytes(wave(np.zeros(1000), 8, acid(120.0, 4, 60, 1)))
    (at / "empty.wav").write_bytes(b"")
    (at / "broken.wav").write_bytes(b"RIFF....WAVEfmt ")
    (at / "x.txt").write_text("no audio")
    return str(at)


def test_listing_and_change_states(spark, folder):
    rows = W.listed(spark, folder, (".wav",))
    assert {r.rel_path for r in rows.collect()} == {"a b/echo.wav", "one.WAV", "silent.wav", "broken.wav"}  # Spark lists no empty file
    known = rows.where("rel_path <> 'one.WAV'").withColumn("size", F.when(F.col("rel_path") == "silent.wav", 1).otherwise(F.col("size")))
    known = known.unionByName(known.limit(1).withColumn("rel_path", F.lit("gone.wav")))
    states = {r.rel_path: r.state for r in W.classified(known, rows).collect()}
    assert (states["one.WAV"], states["silent.wav"], states["gone.wav"], states["broken.wav"]) == ("new", "changed", "gone", "known")


def test_wav_facts_and_measures(spark, folder):
    files = W.contents(spark, folder, "*.{wav,WAV}")
    facts = {r.path.rsplit("/", 1)[-1]: r for r in W.wav_facts(files).collect()}
    assert len(facts) == 4 and not facts["broken.wav"].readable
    e = facts["echo.wav"]
    assert (e.readable, e.duration_s, e.sample_rate, e.channels, e.bit_depth, e.bpm, e.beats, e.root_note) == (True, 1.0, RATE, 1, 16, 120.0, 4, 60)
    assert (facts["one.WAV"].root_note, facts["one.WAV"].bit_depth, facts["one.WAV"].channels) == (62, 24, 2)
    assert (facts["silent.wav"].bpm, facts["silent.wav"].root_note) == (None, None)
    got = {r.path.rsplit("/", 1)[-1]: r for r in A.measured(files).collect()}
    assert (got["echo.wav"].n_events, got["echo.wav"].echo) == (3, True) and got["echo.wav"].regularity < 0.01
    assert got["echo.wav"].silence_s > 0.3 and abs(got["echo.wav"].trim_s - 0.55) < 0.1
    assert got["one.WAV"].stereo == pytest.approx(-1, abs=1e-3) and got["echo.wav"].stereo is None
    assert got["silent.wav"].n_events == 0 and got["broken.wav"].n_events is None


def test_samples_come_back():
    x = hits(0.0, 0.3)
    for bits in (8, 16, 24, 32):
        assert np.abs(W.samples(W.wav(wave(x, bits)))[:, 0] - x).max() <= 2.0 ** (1 - bits)


def test_events_equal_a_walk_over_hops():
    rng = np.random.default_rng(3)
    for _ in range(200):
        db = np.where(rng.random(rng.integers(0, 90)) < rng.random(), -10.0, -80.0)
        want, start, quiet = [], None, 0
        for k, on in enumerate(db > A.FLOOR_DB):
            if on:
                start, quiet = k if start is None else start, 0
            elif start is not None and (quiet := quiet + 1) >= 8:
                want.append((start, k - quiet + 1))
                start = None
        want += [(start, len(db))] if start is not None else []
        want = [(a, b) for a, b in want if (b - a) * A.HOP_S >= A.LEAST_S]
        starts, ends, _ = A.events(db)
        assert [(round(a / A.HOP_S), round(b / A.HOP_S)) for a, b in zip(starts, ends, strict=True)] == want


def test_sounds_are_alike_at_a_lag_and_upside_down():
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    assert A.alike(a, -np.concatenate((np.zeros(37), a, np.zeros(20)))) == pytest.approx(1)
    assert A.alike(a, rng.normal(size=500)) < 0.6
    assert A.alike(a, np.zeros(10)) is None


@pytest.mark.parametrize("code", ["utf-8-sig", "utf-16", "cp1252"])
def test_ratings_in_any_encoding(spark, tmp_path, code):
    text = "Rating,PATH,category,scope\nkeep,é.wav,,\nDrop,b.wav,,set\nmisfiled,c.wav,FX,\nkeep,d.wav,FX,\nbad,e.wav,,\nkeep,f.wav,,set\n,,,\ndrop,é.wav,,\ndrop,b.wav,,set\n"
    (tmp_path / "r.csv").write_bytes(text.encode(code))
    rows = W.ratings(W.contents(spark, str(tmp_path), "*.csv"))
    assert {r.line: r.problem is None for r in rows.collect()} == {2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 9: True, 10: True}
    got = {r.target: r for r in W.agreed(rows).collect()}
    assert got["é.wav"].clash and got["é.wav"].verdict is None
    assert (got["b.wav"].verdict, got["b.wav"].scope, got["c.wav"].category) == ("drop", "set", "FX")


def test_manifests_sidecars_and_databases(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"src_roots": ["/lib/", "/two"], "n": 1, "categories": {"K": {"entries": [{"src": "a.wav"}, {"src": "b.wav", "src_root": 1}, {"src": "/c.wav"}, 5]}, "odd": 3}}')
    (tmp_path / "bad.json").write_text("{")
    got = W.manifests(W.contents(spark, str(tmp_path), "*.json")).collect()
    assert [(r.section, r.category, r.src) for r in got] == [("categories", "K", s) for s in ("/lib/a.wav", "/two/b.wav", "/c.wav")]
    (tmp_path / "s.xmp").write_text('<x xmlns:q="u:q" xmlns:r="u:r"><r:li><q:filePath>k.wav</q:filePath><q:keywords><r:Bag><r:li>Drop</r:li></r:Bag></q:keywords></r:li></x>')
    (tmp_path / "t.xmp").write_text("<x")
    assert [(r.file, r.keywords, r.colors) for r in W.sidecars(W.contents(spark, str(tmp_path), "*.xmp")).collect()] == [("k.wav", ["Drop"], [])]
    with sqlite3.connect(tmp_path / "v.db") as con:
        con.execute("CREATE TABLE t(a INTEGER, b TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    con.close()
    rows = W.sqlite_table(W.contents(spark, str(tmp_path), "*.db"), "SELECT a, b FROM t ORDER BY a", "a long, b string")
    assert [(r.a, r.b) for r in rows.collect()] == [(1, "x"), (2, None)]


def test_stored_tables(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "provider string, id long")
    at = str(tmp_path / "labels")
    S.replace_provider(rows(("a", 1), ("b", 2)), at)
    S.replace_provider(rows(("a", 3)), at)
    assert {(r.provider, r.id) for r in spark.read.parquet(at).collect()} == {("a", 3), ("b", 2)}
    items, parts = S.Versioned(spark, str(tmp_path / "items"), ["id"]), S.Versioned(spark, str(tmp_path / "parts"), ["part"])
    df = lambda s, *r: spark.createDataFrame(list(r), s)
    assert not items.exists()
    items.upsert(df("id long, v long, x string", (1, 1, "a"), (2, 1, "b")), "v")
    items.upsert(df("id long, v long, x string", (1, 2, "c"), (2, 0, "old")), "v")
    assert {(r.id, r.x) for r in items.read().collect()} == {(1, "c"), (2, "b")}
    assert items.evolve(T.StructType([T.StructField("y", T.DoubleType())])) == ["y"] and items.evolve(items.read().schema) == []
    parts.replace(df("part long, item long", (10, 1), (11, 2)))
    S.cascade(df("id long", (1,)), [(parts, "item")], items)
    assert [r.id for r in items.read().collect()] == [2] and [r.part for r in parts.read().collect()] == [11]
    ran, applied = [], S.Versioned(spark, str(tmp_path / "versions"), ["version"])
    steps = [(2, lambda: ran.append(2)), (1, lambda: ran.append(1))]
    assert S.migrate(applied, steps) == [1, 2] and S.migrate(applied, steps) == [] and ran == [1, 2]
    S.record_release(str(tmp_path / "rel"), "1.0", df("path string", ("a",)))
    S.record_release(str(tmp_path / "rel"), "1.1", df("path string", ("b",)))
    S.record_release(str(tmp_path / "rel"), "1.0", df("path string", ("c",)))
    assert {(r.path, str(r.version)) for r in spark.read.option("basePath", str(tmp_path / "rel")).schema("path string, version string").parquet(str(tmp_path / "rel")).collect()} == {("c", "1.0"), ("b", "1.1")}
    kept = S.merged_manifest(df("c string, f string", ("k", "1"), ("h", "2")), df("c string, f string", ("k", "3")), "c")
    assert {(r.c, r.f) for r in kept.collect()} == {("h", "2"), ("k", "3")}
