"""Rules over names, audio measures, settings and stored tables, on small cases."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import audio as A
from sieveline.functions import features as X
from sieveline.functions import names as N
from sieveline.functions import rules as R
from sieveline.functions import sound as S
from sieveline.functions import tempo as T
from sieveline.operators import checks, ranks, routing, stored
from sieveline.plans import settings
from sieveline.streaming import sessions


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keys_in_names(spark):
    names = ["Lead_Am_01", "Bass F# min", "Pad Bb", "Keys C 120", "Am to Em", "Amaj Amin", "Dmaj7", None, "G#m.wav", "Loop Abmaj"]
    got = column(spark, names, R.key_in)
    assert [(g.pitch, g.mode) if g else None for g in got] == [(9, "minor"), (6, "minor"), (10, None), None, None, None, None, None, (8, "minor"), (8, "major")]


def test_names_are_renoted(spark):
    rows = spark.createDataFrame([("Bass E3", 1), ("Lead_F#2_x", -7), ("Kick 01", 2), ("Pad C-1.wav", 0), ("Tom A3", None)], "x string, s int")
    got = rows.select(R.renoted(F.col("x"), N.note_of(F.col("x")), F.col("s")).alias("y")).collect()
    assert [r.y for r in got] == ["Bass F3", "Lead_B1_x", "Kick 01", "Pad C-1.wav", "Tom A3"]


def test_editions_sets_and_safe_names(spark):
    assert column(spark, ["Hit 87 Cleanup.wav", "Hit_87.aif", "KEYS c#3 Stereo.wav"], lambda x: R.edition_name(x, "cleanup|stereo|mono")) == ["hit 87", "hit 87", "keys c#3"]
    assert column(spark, ["Tom C3 v2", "tom_D3_v4"], lambda x: N.without_tokens(x, "^([a-g][0-9]?|v|[0-9]+)$")) == ["tom", "tom"]
    assert column(spark, ['a<b>:"c', "x" * 70, " two   words "], lambda x: N.safe_name(x, 20)) == ["a b c", "x" * 10 + "~" + "x" * 9, "two words"]
    assert column(spark, ["Ünïcode ﬁ ♥"], N.ascii_name) == ["Unicode fi "]
    keys = column(spark, ["Deluxe Drums v2", "drums"], lambda x: N.content_key(x, F.lit("Kick.WAV"), F.lit(1.004)))
    assert keys[0] == keys[1] and keys[0].stem == "kick" and keys[0].seconds == 1.0
    assert column(spark, ['["a", "b"]', "no list", None, "[]"], R.json_list) == [["a", "b"], [], None, []]
    assert column(spark, ["200", "60", "401"], lambda x: T.fold_half_open(x.cast("double"), 100.0, 200.0)) == [100.0, 120.0, 100.25]


def test_editions_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK_ROWS", 5)
    lengths = [None, float("nan"), float("inf"), -3.0, 0.0, 1e-310, 9.5, 10.0, 10.5, 10.53, 11.0, 1e300]
    rows = [(i % 170, "v" if i % 7 else None, "pq"[i % 2] if i % 5 else None, "fg"[i % 3 // 2] if i % 11 else None, ("hit 87", "keys c3", "slap", "hit")[i % 4], lengths[i * i % 12]) for i in range(180)]
    rows += [(200 + i, "w", "p", "f", "hot one", 20.0 + i / 20) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v string, p string, f string, n string, s double")
    df.createOrReplaceTempView("edition_items")
    for tolerance in (0.0, 0.05, 0.5, 1.5):
        alike = f"coalesce(abs(x.s - y.s) <= {tolerance}D * greatest(x.s, y.s), true) AND CASE WHEN x.p = y.p THEN x.f = y.f ELSE x.n NOT IN ('hit 87') END"
        want = spark.sql(f"SELECT x.id a, y.id b FROM edition_items x JOIN edition_items y ON x.v = y.v AND x.n = y.n AND x.id < y.id WHERE x.n RLIKE '[0-9]| ' AND {alike}").collect()
        got = routing.edition_pairs(df, "id", "v", "p", "f", "n", "s", tolerance).collect()
        assert len(want) > 100 and sorted(got) == sorted(want)


def test_editions_of_far_lengths_do_not_meet(spark):
    rows = [(1, "v", "p", "f", "hit 87", 2_000_000_000), (2, "v", "p", "f", "hit 87", -2_000_000_000), (3, "v", "p", "f", "hit 87", 1_990_000_000)]
    df = spark.createDataFrame(rows, "id long, v string, p string, f string, n string, s int")
    assert [tuple(r) for r in routing.edition_pairs(df, "id", "v", "p", "f", "n", "s").collect()] == [(1, 3)]  # lengths of 1 and 2 differ by more than an int holds


def test_editions_of_one_name_grow_with_the_pairs(spark):
    rows = spark.range(300_000).selectExpr("id", "'v' AS v", "'p' AS p", "'f' AS f", "'hit 87' AS n", "exp(floor(id / 2) * 1e-5D) AS s")
    began = time.monotonic()
    got = routing.edition_pairs(rows, "id", "v", "p", "f", "n", "s", 1e-6).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("b") - F.col("a")).alias("far")).first()
    assert (got.n, got.far) == (150_000, 1)
    assert time.monotonic() - began < 30  # 45 billion pairs share the name


def test_numbers_that_are_notes(spark):
    rows = [("a", n, n + 24.0 + (12 if n == 61 else 0)) for n in (40, 41, 45, 61)] + [("b", n, 60.0) for n in (1, 2, 3, 4)] + [("c", 1, 25.0), ("c", 2, 26.0), ("d", 1, None)]
    got = routing.number_sets(spark.createDataFrame(rows, "g string, n int, r double"), "g", "n", "r").collect()
    assert [(r.g, r.offset) for r in got] == [("a", 24.0)]


def test_anchors_prefer_the_true_one_of_a_near_tie(spark):
    anchors = spark.createDataFrame([("clap", [1.0, 0.0], [0.0, -1.0]), ("hat", [0.98, 0.2], [0.0, -1.0])], "category string, anchor array<double>, anti array<double>")
    items = spark.createDataFrame([(1, [0.995, 0.1]), (2, [0.1, -0.9]), (3, None)], "id long, v array<double>")
    plain = {r.id: r.home for r in routing.nearest_anchor(items, anchors, "v", "id").collect()}
    kind = {r.id: r.home for r in routing.nearest_anchor(items, anchors, "v", "id", prefer={"hat": "clap"}, close=0.05).collect()}
    assert plain == {1: None, 2: None} and kind == {1: "clap", 2: None}


def test_layouts(spark):
    def of(paths):
        return tuple(routing.layout(spark.createDataFrame([(p,) for p in paths], "p string"), "p", "^(loops|wav)$").first())

    assert of([]) == ("packs", [], 0)
    assert of(["a.wav", "b.wav", "x/c.wav"]) == ("flat", [], 3)
    assert of(["Loops/a.wav", "WAV/b.wav", "x/c.wav"]) == ("types", [], 3)
    assert of([f"Vendor/pack{i}/a.wav" for i in range(5)]) == ("umbrella", ["Vendor"], 5)
    assert of([f"v{i}/pack/a.wav" for i in range(5)])[0] == "packs"


def clicks(times, rate=8000, seconds=2.0):
    x = np.zeros(int(rate * seconds))
    for t in times:
        n = int(t * rate)
        x[n : n + 200] = np.exp(-np.arange(200) / 40)[: len(x) - n]
    return x, rate


def test_onsets_grids_slices_and_turns():
    beat = 0.5 * np.arange(4)
    x, rate = clicks(np.sort(np.r_[beat, beat + 0.25, beat + 0.125]))
    times, strengths = A.onsets(x, rate)
    assert len(times) == 12 and np.abs(times - np.sort(np.r_[beat, beat + 0.25, beat + 0.125])).max() <= 0.005
    assert A.grid_fit(times, strengths, 120.0) == 1.0 and A.grid_tempo(2.0, times, strengths) == 120.0
    assert A.grid_tempo(2.0, times[:2], strengths[:2]) is None and A.grid_tempo(0.0, times, strengths) is None
    straight = np.arange(16) * 0.125
    assert A.slices(2.0, straight, 120.0) == {"bars": 1.0, "clean": 1.0, "hits": 1.0, "error": 0.0, "swing": 50.0}
    late = straight + 0.125 * 0.2 * (np.arange(16) % 2)
    assert A.slices(2.0, late, 120.0)["swing"] == 60.0 and A.slices(2.0, straight + 0.05, 120.0)["clean"] == 0.0
    assert A.slices(2.0, straight, None) == {}
    assert A.turn_offset(straight + 0.02, 120.0) == pytest.approx(0.02) and A.turn_offset(straight, 120.0) == 0.0
    assert A.turn_offset(straight[:4] + 0.02, 120.0) == 0.0


def test_envelopes_and_pitch():
    rate = 8000
    t = np.arange(rate) / rate
    assert A.envelope(np.zeros(800), rate).max() == A.SILENT_DB and not len(A.envelope(np.zeros(3), rate))
    db = A.envelope(np.stack((np.r_[np.ones(400), np.full(400, 0.1)], np.zeros(800)), axis=1), rate)
    assert db[0] == 0 and db[-1] == pytest.approx(-20)
    assert A.pitch(np.sin(2 * np.pi * 220 * t), rate) == pytest.approx(57, abs=0.3)
    assert A.pitch(np.random.default_rng(0).normal(size=rate), rate) is None and A.pitch(np.zeros(rate), rate) is None


def test_settings_come_in_layers(spark, tmp_path):
    (tmp_path / "a.toml").write_text("[vendor]\nshare = 0.5\n")
    (tmp_path / "b.json").write_text(json.dumps({"vendor": {"share": 0.6}, "budget": {"floor": 7}}))
    layers = [(n, settings.read(str(tmp_path / n))) for n in ("a.toml", "b.json")]
    found = settings.resolved(layers, ["budget.ceil=100"])
    assert found["vendor.share"] == (0.6, "b.json") and found["budget.floor"] == (7, "b.json") and found["budget.ceil"] == (100, "set") and found["anchor.least"] == (0.30, "default")
    assert settings.table(spark, found).where("layer = 'default'").count() == len(settings.DEFAULTS) - 3
    with pytest.raises(KeyError):
        settings.resolved([("x", {"no": 1})])
    with pytest.raises(TypeError):
        settings.resolved([("x", {"budget": {"floor": "many"}})])
    profiles = {"base": {"rate": 44100, "names": "long"}, "small": {"extends": "base", "names": "short"}, "a": {"extends": "b"}, "b": {"extends": "a"}}
    assert settings.extended(profiles, "small") == {"rate": 44100, "names": "short"}
    with pytest.raises(ValueError, match="extend each other"):
        settings.extended(profiles, "a")


def test_swaps_go_on_where_they_stopped(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("next", "now", "before")}
    for n in ("one", "two", "three"):
        spark.createDataFrame([(n,)], "x string").write.parquet(at["next"])
        stored.swapped(spark, at["next"], at["now"], at["before"])
        stored.swapped(spark, at["next"], at["now"], at["before"])
    assert spark.read.parquet(at["now"]).first().x == "three" and spark.read.parquet(at["before"]).first().x == "two"


def test_texts_are_embedded_once(spark, tmp_path):
    seen = []

    def embed(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return rows.withColumn("vector", F.array(F.length("text").cast("double")))

    texts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "text string")
    path = str(tmp_path / "cache")
    assert {r.text: r.vector for r in stored.embedded(texts("a", "bb", "a", None), path, embed).collect()} == {"a": [1.0], "bb": [2.0]}
    assert {r.text for r in stored.embedded(texts("bb", "ccc"), path, embed).collect()} == {"bb", "ccc"}
    assert seen == [["a", "bb"], ["ccc"]]


def test_spectral_measures():
    rate = 16000
    t = np.arange(rate) / rate
    tone, noise = np.sin(2 * np.pi * 1000 * t), np.random.default_rng(1).normal(size=rate) * 0.2
    a, b = S.measures(tone, rate), S.measures(noise, rate)
    assert a["centre_hz"] == pytest.approx(1000, rel=0.05) and a["crossings_hz"] == pytest.approx(2000, rel=0.01) and a["crest"] == pytest.approx(2**0.5, rel=1e-3)
    assert a["flatness"] < 0.01 < 0.3 < b["flatness"] and a["harmonic"] > 0.9 and a["rolloff_hz"] < 1200 < b["rolloff_hz"] and b["spread_hz"] > 4 * a["spread_hz"]
    assert len(a["cepstrum"]) == 13 and a["flat_tops"] < 0.01 < S.flat_tops(np.clip(3 * tone, -1, 1))
    decay = np.r_[np.linspace(0, 1, 160), np.exp(-np.arange(8000) / 800)]
    assert S.measures(decay, rate)["attack_ms"] == pytest.approx(9, abs=1) and S.measures(decay, rate)["decay_ms"] == pytest.approx(115, abs=3)
    assert S.measures(np.zeros(100), rate)["centre_hz"] is None and S.measures(np.zeros(0), rate)["peak"] == 0


def test_export_steps():
    rate = 8000
    sound = np.r_[np.zeros(800), np.sin(np.arange(1600) / 5), np.zeros(4000)]
    assert 1600 <= len(S.trimmed(sound, rate)) <= 1600 + 2 * 40 + 2 and not len(S.trimmed(np.zeros(10), rate))
    assert np.abs(S.levelled(0.1 * sound)).max() == pytest.approx(10 ** (-1 / 20)) and not S.levelled(np.zeros(4)).any()
    assert np.abs(S.limited(3 * sound)).max() <= 0.98 and (S.limited(0.5 * sound) == 0.5 * sound).all()
    assert len(S.repitched(sound, 12)) == pytest.approx(len(sound) / 2, abs=1) and S.repitched(np.stack((sound, sound), axis=1), -12).shape[1] == 2
    out = S.exported(np.stack((sound, sound), axis=1) + 0.1, rate)
    assert out.ndim == 1 and out[0] == 0 and abs(out[-1]) < 1e-9 and np.abs(out).max() <= 0.98


def test_sound_faults(spark):
    rows = [("a", 0.2, 0.0, 60.0, 72.2), ("b", None, None, None, None), ("c", 1e-5, 0.0, None, 60.0), ("d", 0.5, 3.0, 61.0, 60.0)]
    got = {r.check: (r.status, r.n, r.example) for r in checks.sound_faults(spark.createDataFrame(rows, "k string, level double, silence_s double, root double, want_root double"), "k").collect()}
    assert got == {"unreadable": ("FAIL", 1, "b"), "silent": ("FAIL", 1, "c"), "hot": ("PASS", 0, None), "tail": ("WARN", 1, "d"), "root": ("FAIL", 1, "d"), "all": ("FAIL", 4, None)}


def test_commands_answer(spark, capsys):
    from sieveline import __main__ as M
    from sieveline.plans.registry import QUERIES

    assert set(M.COMMANDS.values()) <= set(QUERIES)
    assert M.main(["releases", "--data", "/root/testdata/sf0.001", "--limit", "2"]) == 0 and "version" in capsys.readouterr().out


def test_ranks_by_ranges_equal_row_numbers(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"g{i % 5}", (i * 37) % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: r.place for r in ranks.ranked(df, "g", [F.desc("v"), F.col("id")], "place").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = place
    assert got == want


def test_tempos_notes_and_round_robins_in_names(spark):
    assert column(spark, ["Loop 120bpm", "x 49 BPM", "a 250 bpm", "128 Bpm mix", "bpm", None], T.named_bpm) == [120, None, 250, 128, None, None]
    assert column(spark, ["Bass C3", "Lead_F#2.wav", "Pad Bb-1", "Kick", "C3 E3", "a4", None], N.note_of) == [60, 54, 22, None, None, 81, None]
    assert [(g.key, g.number) for g in column(spark, ["Tom_RR3", "tom rr12", "Tom"], N.round_robin)] == [("tom", 3), ("tom", 12), ("tom", None)]


def test_reliable_tempos_and_loop_shares(spark):
    rows = spark.createDataFrame([(120.0, 0.7, ["Loop"], [0.9, 0.2]), (120.0, None, ["OneShot"], [0.9, 0.2]), (None, 0.9, [], [0.1, 0.4]), (90.0, 0.6, ["Loop"], [0.5])], "b double, c double, k array<string>, s array<double>")
    got = rows.select(X.reliable_tempo(F.col("b"), F.col("c")).alias("r"), X.loop_confidence(F.col("k"), F.col("s")).alias("l")).collect()
    assert [(g.r, g.l) for g in got] == [(True, 0.9), (False, 0.2), (False, 0.4), (False, None)]


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    rows = [(i, u, f"2024-01-01 00:{m:02d}:00") for i, (u, m) in enumerate([(1, 0), (1, 4), (1, 20), (2, 1), (2, 2), (1, 21), (2, 50)])] + [(99, 3, "2024-01-02 00:00:00")]
    batch = spark.createDataFrame(rows, "event_id long, user long, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    found = sessions.streamed_sessions(stream, "user", "ts", "10 minutes", "1 minute")
    run = found.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.user, str(r.starts), r.n) for r in spark.table("streamed").collect()}
    want = {(r.user, str(r.starts), r.n) for r in sessions.gap_sessions(batch.where("user < 3"), "user", "ts", 600).collect()}
    assert got == want and len(want) == 4
    both = sessions.upserted(batch.select("event_id", "ts"), batch.where("event_id = 1").select("event_id", F.expr("ts + INTERVAL 1 DAY").alias("ts")), "event_id", "ts")
    assert both.count() == 8 and str(both.where("event_id = 1").first().ts) == "2024-01-02 00:04:00"


def test_seams():
    rate = 8000
    wave = np.sin(2 * np.pi * 100 * np.arange(8000) / rate)
    assert A.seam(wave, 8000, rate) == pytest.approx(1.0, abs=0.01) and A.seam(np.r_[wave[:4000], 0.1 * wave[:4020]], 8020, rate) < 0.2
    assert A.seam(wave, 10, rate) == 0 and A.seam(np.zeros(8000), 8000, rate) == 0


def test_chains_of_keepers_end(spark):
    from sieveline.operators import trees

    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("s", "s"), ("x", "y"), ("y", "x"), ("o", "gone")]
    got = {r.k: (r.root, r.steps) for r in trees.roots(spark.createDataFrame(rows, "k string, up string"), "k", "up").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("a", 4), "s": ("s", 0), "x": (None, None), "y": (None, None), "o": ("o", 0)}
