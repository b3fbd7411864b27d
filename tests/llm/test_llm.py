"""The training-data operators against brute force, round trips and held-out rows, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import chat, common, exact_digest, graph, langid, mixing, multi_index, packing, pii, shingles, simhash, suffix_dedup, warc

EDGE = [None, "", " ", "x", "é" * 40, "long " * 4000, "same text of some length, " * 6, "same text of some length, " * 6, "\t\n", "😀 á b"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(word() for _ in range(40))
    texts += [t + " " + shared + " " + texts[(i * 7) % 60] for i, t in enumerate(texts[:20])]
    texts += [re.sub(r"\b(\w+)$", "changed", t) for t in texts[:10]] + EDGE
    rows = [(i * 3, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(5).cache()


def texts_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def covered(rows, n=100):
    seen, out = set(), {}
    for doc, text in rows:
        b = text.encode()
        hit = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                hit[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out[doc] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 50, 400):
        for k in (1, 2, 30):
            s = rng.integers(1, k + 1, n)
            t = s.tolist()
            assert suffix_dedup.dc3(s, k).tolist() == sorted(range(n), key=lambda i: t[i:])  # noqa: B023


def test_suffix_dedup_equals_brute_force(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == covered(texts_of(docs))
    assert sum(x[1] for x in got.values())


def removed(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(df).collect()))


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    a, b = "one text of more than a hundred bytes " * 3, "".join(chr(33 + i * 7 % 90) for i in range(300))
    rows = [(1, b), (1, b), (2, a + b), (2, b + a), (None, b[:150]), (None, None), (3, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_removed string")
    order = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    order = sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text or ""))
    want = covered([(i, r.text or "") for i, r in enumerate(order)])
    assert removed(df) == sorted((r.doc_id is not None, r.doc_id or 0, *want[i]) for i, r in enumerate(order))
    assert sum(r[3] for r in removed(df)) >= 900 and not removed(df.limit(0))


def test_one_hot_line_is_split_and_exact(spark, monkeypatch):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefghij ") for _ in range(140))
    noise = lambda: "".join(rng.choice("klmnopq") for _ in range(rng.randint(0, 300)))
    rows = [(i, noise() + line + noise()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((True, d, *x) for d, x in covered(rows).items())
    assert removed(df) == want and sum(x[3] for x in want) >= 399 * 140
    monkeypatch.setattr(suffix_dedup, "MOST", 5)
    assert removed(df) == want
    for name, value in (("MOST", 1 << 30), ("SAMPLED", 1), ("HOT", 0.005)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert len(suffix_dedup.hot_anchors(df.withColumnRenamed("doc_id", "_row")))
    assert removed(df) == want


def test_simhash_equals_brute_force(docs):
    rows = texts_of(docs)

    def slow(t):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fp = {d: slow(t) for d, t in rows}
    label = {d: d for d, _ in rows}
    for _ in rows:
        label = {d: min(label[e] for e, _ in rows if (fp[d] ^ fp[e]).bit_count() <= 4) for d, _ in rows}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (fp[d], label[d]) for d, _ in rows}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{i: 5 for i in range(200, 260)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_and_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[50:80] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        s[np.abs(s - s[50]) < 1e-12] = s[50] if q != 50 else s[np.abs(s - s[50]) < 1e-12][0]
        best = np.lexsort((np.arange(600), -s))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 5 * 12
    assert multi_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_neighbours_of_small_tables_are_whole(spark):
    x = np.random.default_rng(1).normal(size=(8, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for n, want in ((8, 5), (4, 3)):
        got = multi_index.nearest(df.where(F.col("vec_id") < n), F.lit(True)).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == dict.fromkeys(range(n), want)


def test_language_model_sums_to_one_and_tells_languages(spark):
    codes, _, _ = langid.coded(*langid.packed(["abc abd abc", "bca"]), langid.alphabet(["abcd"]))
    model = langid.KneserNey(codes)
    ctx = codes[3] >> 6
    assert abs(model.prob((np.arange(64) | (ctx << 6)).astype(np.int64)).sum() - 1) < 1e-9
    rng = random.Random(2)
    make = lambda syllables: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(40))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"]}
    rows = [(i, make(kinds[lang]), lang) for i in range(60) for lang in [("aa", "bb")[i % 2]]] + [(100, None, "aa"), (101, "12 34", "bb"), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df, ~langid.held_out())).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 and not got[i].rejected for i in range(60))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    none = langid.identify(df, langid.train(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_packing_is_gapless_and_exact(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and (n == 1024 or n.bit_count() == 1) for n in lengths.values())
    for doc, text in texts_of(docs):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], np.uint32)
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)]
    luhn = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["a@b.c+d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.255", "4111 1111 1111 1111", "+1 (415) 555-0100.", "é😀 a@b.co 1.1.1.1", None, "", "u@h.com@o.org"]
    texts += ["".join(rng.choice("a1.@+-( )5é") for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.spans(df).select("doc_id", *(f"spans_{k}" for k in pii.KINDS)).collect()
    for r in found:
        for k in pii.KINDS:
            want = [(m.start(), m.end()) for m in re.finditer(PLAIN[k], texts[r.doc_id] or "") if passes(k, m[0])]
            assert [(x.s, x.e) for x in r[f"spans_{k}"]] == want, (k, texts[r.doc_id])


def test_revealing_terms_are_removed(spark):
    rows = [(i, f"note {i} from zorbex about the bob@mail.org matter again {i}") for i in range(4)] + [(9 + i, f"the matter from note about again {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert all("zorbex" not in clean[i] and "[EMAIL]" in clean[i] and "matter" in clean[i] for i in range(4))
    assert clean[9] == rows[4][1]
    assert pii.sanitize(df.limit(0)).count() == 0


def test_terms_of_entities_in_one_text_are_removed(spark):
    rows = [(0, "note from zorbex about the bob@mail.org matter again")] + [(9 + i, f"the matter from note about again {i}") for i in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorbex" not in clean[0] and "[EMAIL]" in clean[0] and "matter" in clean[0]
    assert clean[9] == rows[1][1]


def test_terms_are_counted_and_removed_in_the_whole_document(spark):
    far = "the matter from note about again " * 10
    rows = [(i, f"zorbex wrote to bob@mail.org {far} and quixol, Zorbex again {i}\nquixol") for i in range(3)]
    rows += [(None, rows[0][1])] * 2 + [(9 + i, f"{far} and wrote to zorbexes {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = pii.sanitize(df).collect()
    named = [r.text for r in clean if r.doc_id is None or r.doc_id < 9]
    assert len(named) == 5 and not [t for t in named if re.search("zorbex|quixol", t, re.IGNORECASE)]
    assert all(t.startswith(" wrote to [EMAIL] the matter") and t.endswith("\n") for t in named)
    assert {r.doc_id: r.text for r in clean if r.doc_id == 9}[9] == rows[5][1]
    for r in pii.spans(df).collect():
        assert [r.text[x.s : x.e].lower() for x in r.terms] == (["zorbex", "quixol", "zorbex", "quixol"] if "bob@" in r.text else [])


def test_archives_round_trip(spark):
    big = "".join(f"<p>{i} é</p>\r\n\r\nWARC/1.1\r\n" for i in range(3000))
    pages = [(1, "u", "small"), (2, "u\r\nx: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    path = common.new_path(spark, "archives")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = warc.read(spark, path).collect()
    got = {int(r.rid.split(":")[3]): r for r in rows}
    assert len(rows) == 10 and not [r for r in rows if r.error]
    assert {i for i, r in got.items() if r.type == "revisit"} == {2, 7} and got[2].refers.split(":")[3] == "3"
    for i, _, html in pages:
        if got[i].type == "response":
            assert bytes(got[i].payload) == (html or "").encode()


def test_broken_segments_are_reported(spark):
    path = common.new_path(spark, "broken")
    warc.write(spark.createDataFrame([(1, "u", "z" * 60000)], "page_id long, url string, html string"), path)
    raw = [r.value for r in spark.read.option("lineSep", "\r\n\r\nWARC").text(path).collect()]
    assert len(raw) > 3
    short = "WARC".join(x + "\r\n\r\n" for x in raw[:2])
    spark.createDataFrame([(short,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path + "2")
    parts = list(warc.parsed(short.encode()))
    assert [p["number"] for p in parts] == [1, 2] and parts[0]["rid"] == parts[1]["rid"]
    with pytest.raises(ValueError):
        list(warc.parsed(short.encode()[:-50]))


def test_exact_groups_and_neighbours(spark):
    rows = [(1, "Ａbc  ſ x"), (2, "abc s x"), (130, "ABC S X "), (5000, "é"), (5001, "É"), (70000000, None), (-4, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in exact_digest.groups(df).collect()}
    assert got == {1: 1, 2: 1, 130: 1, 5000: 5000, 5001: 5000, 70000000: -4, -4: -4}
    order = [d for d, _ in sorted(rows)]
    links = exact_digest.neighbours(df.selectExpr("doc_id _row", "length(coalesce(text, '')) n")).collect()
    assert {r._row: r.before for r in links} == dict(zip(order, [order[-1], *order], strict=False))
    n = {d: len(t or "") for d, t in rows}
    assert all(r.half == n[r.before] // 2 for r in links)


def test_calls_and_results(spark):
    ok, bad = '{"words": 1, "prompt": "p"}', '{"prompt": 3, "words": 1}'
    rows = [(1, 5, "result", "a", None, "early"), (1, 7, "call", "a", "reply", ok), (1, 8, "call", "b", "reply", bad), (1, 9, "result", "c", None, "lost"), (1, 10, "plain", None, None, "hi"), (1, 11, "call", "d", "reply", "{no"), (1, 12, "result", "a", None, "again"), (1, 13, "call", None, "other", ok), (1, 14, "call", "e", "reply", '{"words": 1, "prompt": "p", "more": 1}')]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, kind string, call_id string, tool string, body string")).collect()}
    assert {t: r.state for t, r in got.items()} == {5: "linked", 7: "linked", 8: "no result", 9: "no call", 10: None, 11: "no result", 12: "repeated result", 13: "no identifier", 14: "no result"}
    assert [got[t].valid for t in (7, 8, 11, 13, 14)] == [True, False, False, False, False]
    order = sorted(got.values(), key=lambda r: (r.anchor, r.step, r.turn))
    assert [r.turn for r in order][:3] == [7, 5, 12]
    assert got[7].json == '{"arguments":"{\\"prompt\\":\\"p\\",\\"words\\":1}","call_id":"a","kind":"call","tool":"reply"}'


def test_rates_meet_targets(spark):
    rng = random.Random(4)
    text = {(1, 0): "fine good plain", (0, 0): "poor $$$ junk", (1, 1): "fine idiot words", (0, 1): "junk idiot ###"}
    rows = []
    for i in range(400):
        kind = rng.choices(list(text), [70, 15, 10, 5])[0]
        rows.append((i, (text[kind] + " ") * rng.randint(3, 9), *kind))
    rows += [(900, None, 1, 0), (901, "", 1, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(r[0], *r[2:]) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = mixing.rates(docs, known, ["doc_id"]).collect()
    total = sum(r.tokens for r in got)
    for i, d in enumerate(mixing.DOMAINS):
        assert abs(sum(r.rate * r.tokens * r.posterior[i] for r in got) / total - mixing.TARGET[d]) < 0.03, d
    assert all(r.rate >= 0 for r in got)
    assert {round(r.rate, 6) for r in mixing.rates(docs.limit(0), known, ["doc_id"]).collect()} == set()
    assert len(mixing.rates(docs, known.limit(0), ["doc_id"]).collect()) == len(rows)


def test_rates_of_a_rare_domain_meet_targets(spark):
    rng = np.random.default_rng(6)
    kind = rng.choice(4, 4000, p=[0.21, 0.01, 0.77, 0.01])
    p = 0.9 * np.eye(4)[kind] + 0.1 * rng.dirichlet([1, 0.05, 1, 1], 4000)
    p[kind != 1, 1] *= 1e-3
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(10, 500, 4000)
    found = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(n, p, strict=True)], "tokens long, posterior array<double>")
    m, gap = mixing.solve(found, mixing.TARGET)
    shares = (n * mixing.rate(p, m)) @ p / n.sum()
    assert np.abs(shares - gap - [mixing.TARGET[d] for d in mixing.DOMAINS]).max() < 1e-9
    assert np.abs(gap).max() <= mixing.TOLERANCE


def test_targets_out_of_reach_are_told(spark):
    docs = spark.createDataFrame([(i, "word " * 9) for i in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        assert {round(r.rate, 3) for r in mixing.rates(docs, known, ["doc_id"]).collect()} == {1.0}


def near_pairs(seed, pairs=120):
    """(doc_id, text) of pairs 2i, 2i + 1 with replaced words, and the 5-word similarity of each pair."""
    rng, rows, like = random.Random(seed), [], []
    runs = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i in range(pairs):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 600))]
        b = list(a)
        for j in rng.sample(range(len(a)), max(1, int(len(a) * rng.uniform(0.004, 0.05)))):
            b[j] = f"v{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, "  ".join(b).upper())]
        like.append(len(runs(a) & runs(b)) / len(runs(a) | runs(b)))
    return rows, like


def test_stage_catches_near_copies_from_similarity_080(spark):
    import corpus_pipeline

    rows, like = near_pairs(8)
    rows += [(900 + i, t) for i, t in enumerate(["few words", "", None])]
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert {2 * i for i in range(len(like))} <= left and 900 in left
    assert sum(0.8 <= x < 0.95 for x in like) > 20 and sum(x < 0.75 for x in like) > 20
    assert not [x for i, x in enumerate(like) if x >= 0.8 and 2 * i + 1 in left]
    assert not [x for i, x in enumerate(like) if x < 0.7 and 2 * i + 1 not in left]


def test_near_copies_equal_all_pairs(spark):
    rows, like = near_pairs(9)
    found = {(r.doc_id, r.of) for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2 * i + 1, 2 * i) for i, x in enumerate(like) if x >= 0.8}
    assert shingles.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialize(stage(spark, at, folder), name)
        assert at.columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.count() and {"doc_id", "sequence_id", "ids"} <= set(out.columns)
