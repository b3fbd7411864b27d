"""Every opN query on small tables with awkward rows, on empty tables, and against plain restatements of its result."""

import hashlib
import json
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chat, exact_digest, langid, mixing, pii, warc
from sieveline.llm.queries import QUERIES

CLASH = "row string, _row string, t string, th string, terms string, tokens string, posterior string, rate string, n string, every string, component_id string, at string"
TABLES = {
    "documents": f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}",
    "embeddings": f"vec_id long, embedding array<float>, label int, {CLASH}",
    "pages": "page_id long, url string, html string, row string, digest string, n string, origin string, block string, at string",
    "labels": "doc_id long, quality int, toxic int, id string, y string",
    "conversations": "conv_id long, turn long, role string, text string, kind string, call_id string, h string, at string, state string",
}


def _documents():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(50)]
    texts += [texts[3], texts[3], texts[4] + " x", None, "", " ", "é", "Ａ ſ", "a s", "w" * 30_000, "a<|endoftext|>b", "mail zorbex at a@b.co or +1 415 555 0100", "\t\n", "😀 á b"]
    rows = [(i * 3 - 6, t, ["en", "de", None][i % 3], "s", None) for i, t in enumerate(texts)]
    rows += [(6, "another text of the id six", "en", "s", 1), (9, texts[5], "en", "s", 1), (9, texts[5], "en", "s", 1), (None, "no id", "en", None, 1), (None, None, None, None, None)]
    return rows


ROWS = {
    "documents": _documents(),
    "embeddings": [(i, None if i == 7 else [float(math.sin(i * j + j * j)) for j in range(1, 9)], 0) for i in range(0, 120)] + [(200, [0.0] * 8, 1), (250, [float("nan")] * 8, 1), (50, [1.0] * 8, 1), (None, [1.0] * 8, 1)],
    "pages": [(1, "u", "small"), (2, "u\r\nx", "y" * 70_000), (3, None, "y" * 70_000), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "a", "z" * 1000), (7, "b", "z" * 1000), (8, "u", "q" * 999), (9, "u", "q" * 999), (None, "u", "é" * 700)],
    "labels": [(i * 3 - 6, i % 2, 0) for i in range(0, 40)] + [(0, 1, 1), (None, 1, 0), (3, None, 0), (6, 7, 0)],
    "conversations": [(1, 0, "system", "s"), (1, 1, "user", 'hi "there"\n'), (1, 2, "assistant", "yes"), (1, 3, "user", None), (1, 5, "assistant", "lost"), (2, 0, "user", "x" * 5000), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 4, "user", "n"), (4, None, "assistant", "n"), (5, 1, None, "n"), (6, 1, "user", "a"), (6, 1, "user", "b")],
}


def _written(spark, folder, rows):
    for name, schema in TABLES.items():
        width = len(schema.split(", "))
        spark.createDataFrame([(*r, *["clash"] * (width - len(r))) for r in rows[name]], schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return _written(spark, tmp_path_factory.mktemp("edge"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _written(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(TABLES, []))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_takes_awkward_and_empty_tables(spark, folder, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, folder)
    assert kept.columns == docs.columns and kept.where("lang IS NULL").count() == 0 and 50 <= kept.count() < docs.count()
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert left.columns == docs.columns
    texts = Counter(r.text for r in left.collect())
    assert texts[ROWS["documents"][3][1]] == 1 and texts["another text of the id six"] == 1 and texts["no id"] == 1 and texts[ROWS["documents"][5][1]] == 1
    clean = corpus_pipeline.sanitised(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == docs.count() and not clean.where("text LIKE '%@b.co%'").count()
    mixed = corpus_pipeline.mixed(spark, docs, folder)
    assert mixed.columns == docs.columns and {r.row for r in mixed.select("row").distinct().collect()} <= {"clash"}


def test_op1(spark, folder):
    got = QUERIES["op1_suffix_dedup"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS["documents"])
    assert sorted(r.n_bytes for r in got) == sorted(len((r[1] or "").encode()) for r in ROWS["documents"])
    same = [r for r in got if r.doc_id == 9]
    assert sum(r.n_removed == r.n_bytes for r in same) >= 2 and all(len(r.kept_sha256) == 64 for r in got)


def test_op2(spark, folder):
    got = QUERIES["op2_mixing"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS["documents"])
    assert {r.doc_id: r.tokens for r in got if r.doc_id in (-6, -3)} == {d: len(t.split()) for d, t, *_ in ROWS["documents"][:2]}


def test_rates_are_the_least_squares_optimum(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 0.2, 3, 0.3], 200)
    n = rng.integers(5, 60, 200)
    found = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(n, p, strict=True)], "tokens long, posterior array<double>")
    m, gap = mixing.solve(found, mixing.TARGET)
    b, w, r = np.array([mixing.TARGET[d] for d in mixing.DOMAINS]), n / n.sum(), mixing.rate(p, m)
    assert np.abs((w * r) @ p - b - gap).max() < 1e-9 and (r == 0).any() and (r > 0).any()
    e = float(np.median(gap / m))  # at the optimum m is the gap over e, so the gradient is w * (r - 1 + p @ gap / e)
    slope = r - 1 + p @ gap / e
    # zero where a rate can move both ways, not negative where it stands at zero: no rates >= 0 are better
    assert np.abs(slope[r > 0]).max() < 0.02 * np.abs(m).max() and slope[r == 0].min() > -0.02 * np.abs(m).max()
    cost = lambda r: ((w * r) @ p - b) @ ((w * r) @ p - b) / 2 / e + (w * (r - 1) ** 2).sum() / 2
    for size in (1e-3, 1e-2, 0.1, 1):
        assert all(cost(np.maximum(0, r + size * rng.normal(size=200))) > cost(r) for _ in range(200))


def test_op3_equals_brute_force_where_the_walk_is_whole(spark, folder):
    got = defaultdict(list)
    for r in QUERIES["op3_multi_index"](spark, folder).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    sound = [(i, np.array(v)) for i, v, _ in ROWS["embeddings"] if i is not None and v and any(v) and not any(map(math.isnan, v))]
    assert set(got) == {0, 50, 100}
    for q, rows in got.items():
        rows.sort(key=lambda r: r[0])
        assert Counter(r[0] for r in rows) == dict.fromkeys(range(1, 6), 2 if q == 50 else 1)
        if q != 50:  # two rows share the id 50
            x = np.float64(np.float32(next(v for i, v in sound if i == q)))
            score = {i: float(np.dot(x, np.float64(np.float32(v))) / np.linalg.norm(x) / np.linalg.norm(np.float32(v).astype(float))) for i, v in sound if i != q}
            assert all(i in (50, None) or abs(score[i] - s) < 1e-9 for _, i, s in rows)


def test_op4(spark, folder):
    got = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(got) == len(ROWS["documents"])
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {d for d, t, *_ in ROWS["documents"] if d not in (6, 9, None) and not any(c.isalpha() for c in t or "")} == none - {None}


def test_language_of_long_texts_only_is_learned_and_broken_bytes_are_read(spark):
    rows = [(i, ("kalomi " if i % 2 else "schung ein ") * (4000 if i % 2 else 20), "aa" if i % 2 else "bb") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bad = df.limit(1).select(F.lit(100).cast("long").alias("doc_id"), F.expr("cast(X'6b616cc3286bff' as string)").alias("text"), F.lit("aa").alias("lang"))
    found = {r.doc_id: r.lang_pred for r in langid.identify(df.unionByName(bad), langid.train(df)).collect()}
    assert all(found[i] == lang for i, _, lang in rows) and found[100] == "aa"


def test_gibberish_is_rejected(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["kalo", "miru", "tesan", "dolu"]) for _ in range(60)), "aa") for i in range(60)] + [(100, "".join(chr(rng.randrange(97, 123)) for _ in range(600)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accepted(df, langid.train(df)).collect()} == set(range(60))


def test_kneser_ney_equals_its_definition():
    codes, begins, _ = langid.coded(*langid.packed(["abc abd abca", "bca ab", "dd"]), langid.alphabet(["abcd"]))
    model = langid.KneserNey(codes)
    level = {4: Counter(codes.tolist())}
    for n in (3, 2, 1):
        level[n] = Counter(g & ((1 << 6 * n) - 1) for g in level[n + 1])

    def prob(g, n):
        if n == 0:
            return 1 / 64
        ones, twos = (sum(c == k for c in level[n].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        under = {x: c for x, c in level[n].items() if x >> 6 == g >> 6}
        lower = prob(g & ((1 << 6 * (n - 1)) - 1), n - 1)
        if not under:
            return lower
        return max(under.get(g, 0) - d, 0) / sum(under.values()) + d * len(under) / sum(under.values()) * lower

    for g in [*codes.tolist(), 0, 1, 66, 4161, (5 << 18) | 77]:
        assert abs(model.prob(np.array([g]))[0] - prob(g, 4)) < 1e-12


def test_op5_has_the_ids_of_the_library(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op5_packing"](spark, folder).collect()
    want = Counter()
    for doc, text, *_ in ROWS["documents"]:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        want[doc] += len(ids)
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc and r.doc_tokens == len(ids))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine) or doc in (6, 9, None)
    got, ends = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        got[r.doc_id] += r.length
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert got == want and all(n <= 1024 and (n == 1024 or n.bit_count() == 1) for n in ends.values())
    assert tok.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]


def test_ids_are_equal_on_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer

    from sieveline.llm.packing import Ids

    tok, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Ids()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}" for c in points[lo : lo + 50_000]]
        assert [list(mine(t)[:-1]) for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_op6_terms_equal_pmi_by_hand(spark):
    rng = random.Random(3)
    words = ["zor", "quix", "matter", "note", "about", "again", "lorem"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 6)))
        rows.append((i, text + rng.choice(["", "", " a@b.co", " 1.2.3.4 a@b.co", " +1 415 555 0100"])))
    rows += [(None, rows[5][1]), (7, "zor second seven a@b.co"), (70, None), (71, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t string")
    entity = re.compile(r"[a-z]@b\.co|1\.2\.3\.4|\+1 415 555 0100")
    sets = [(set(entity.findall(t or "")), set(w for w in entity.sub(" ", t or "").split() if len(w) > 2)) for _, t in rows]
    n, want = len(rows), []
    for (_, t), (es, _ts) in zip(rows, sets, strict=True):
        bad = set()
        for e in es:
            ne = sum(e in x for x, _ in sets)
            for w in set().union(*(y for x, y in sets if e in x)):
                nt, nte = sum(w in y for _, y in sets), sum(e in x and w in y for x, y in sets)
                ic = math.log2(n / ne)
                if ic > 0 and math.log2(n * nte / (nt * ne)) >= pii.DISCLOSES * ic - 1e-12:
                    bad.add(w)
        want.append(sorted(m.span() for w in bad for m in re.finditer(rf"(?<![a-z@]){w}(?![a-z@])", t or "")))
    got = pii.spans(df).collect()
    assert sorted((r.text or "", [(x.s, x.e) for x in r.terms]) for r in got) == sorted((t or "", w) for (_, t), w in zip(rows, want, strict=True))
    assert sum(map(len, want))


def test_op6_columns(spark, folder):
    got = {(r.doc_id, r.spans): r for r in QUERIES["op6_pii"](spark, folder).collect()}
    mine = next(r for r in got.values() if r.n_email)
    text = next(t for _, t, *_ in ROWS["documents"] if t and "@" in t)
    base = [f"email:{text.index('a@b')}:{text.index('a@b') + 6}", f"phone:{text.index('+1')}:{len(text)}"]
    assert (mine.n_email, mine.n_ip, mine.n_card, mine.n_phone) == (1, 0, 0, 1)
    assert mine.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and mine.spans.startswith(",".join(base))


def test_op7(spark, folder):
    got = sorted(((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in QUERIES["op7_warc"](spark, folder).collect()), key=repr)
    want = []
    for i, url, html in ROWS["pages"]:
        body = (html or "").encode()
        to = {2: 3}.get(i) if i != 7 else (7 if url == "a" else None)
        want.append([i is not None, i or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to, None])
    sevens = [w for w in want if w[1] == 7]
    assert sorted(w[4] for w in sevens) == ["response", "revisit"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got) == key(want)


def test_damaged_archives_give_errors_not_failures(spark, tmp_path):
    big, eol = "z" * 60_000, b"\r\n"

    def record(kind, rid, block, *more):
        head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + rid + b">", *more, b"Content-Length: %d" % len(block)]
        return eol.join(head) + eol * 2 + block + eol * 2

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = http + b"3\r\nabc\r\n0\r\n\r\n"
    origin = b"WARC-Segment-Origin-ID: <%s>"
    parts = {
        "fine": record(b"response", b"u:fine", good),
        "chunk": record(b"response", b"u:chunk", http + b"9\r\nabc\r\n0\r\n\r\n") + record(b"response", b"u:hex", http + b"zz\r\nabc"),
        "digest": record(b"response", b"u:digest", good, b"WARC-Payload-Digest: sha1:00"),
        "gap": record(b"response", b"u:gap", good[:20], b"WARC-Segment-Number: 1") + record(b"continuation", b"u:gap:3", good[20:], b"WARC-Segment-Number: 3", origin % b"u:gap", b"WARC-Segment-Total-Length: %d" % len(good)),
        "total": record(b"response", b"u:total", good[:20], b"WARC-Segment-Number: 1") + record(b"continuation", b"u:total:2", good[20:], b"WARC-Segment-Number: 2", origin % b"u:total", b"WARC-Segment-Total-Length: 5"),
        "joined": record(b"continuation", b"u:joined:2", good[20:], b"WARC-Segment-Number: 2", origin % b"u:joined", b"WARC-Segment-Total-Length: %d" % len(good)) + record(b"response", b"u:joined", good[:20], b"WARC-Segment-Number: 1"),
        "cut": record(b"response", b"u:before", good) + record(b"response", b"u:cut", good + big.encode())[:-50],
        "junk": b"no archive at all",
    }
    for name, data in parts.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    packed = zlib.compressobj(wbits=31)
    whole = packed.compress(record(b"response", b"u:gz", good) + record(b"response", b"u:gz2", good)) + packed.flush()
    (tmp_path / "gz.txt.gz").write_bytes(whole[:-20])
    rows = warc.read(spark, str(tmp_path)).collect()
    by = {r.rid: r for r in rows if r.rid}
    assert all(bytes(by[r].payload) == b"abc" for r in ("u:fine", "u:joined", "u:before"))
    assert {r: by[r].error.split(" at")[0] for r in ("u:chunk", "u:digest", "u:gap", "u:total")} == {"u:chunk": "broken chunk", "u:digest": "payload digest differs", "u:gap": "missing or repeated segment", "u:total": "total length differs"}
    assert by["u:hex"].error and by["u:hex"].payload is None
    assert len([r for r in rows if r.rid is None and r.error]) >= 2 and "u:cut" not in by


def _plain_canonical(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def test_op8(spark, folder):
    order = spark.createDataFrame([r[:2] for r in ROWS["documents"]], "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()
    order = sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.t))
    want, first = [], {}
    for i, r in enumerate(order):
        after, half = order[(i + 1) % len(order)].t, len(r.t) // 2
        edited = r.t[: len(r.t) - half] + after[:half]
        c = _plain_canonical(r.t)
        first.setdefault(c, r.doc_id)
        want.append((r.doc_id, len(r.t), hashlib.sha256(edited.encode()).hexdigest(), float(_plain_canonical(edited) == c), float(_plain_canonical(after) == c), c))
    got = QUERIES["op8_exact_digest"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.class_id) for r in got), key=repr) == sorted(((*w[:5], first[w[5]]) for w in want), key=repr)
    assert len({r.fingerprint for r in got}) == len(first)


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "fingerprint", lambda canon: F.substring(F.hex(F.xxhash64(canon)), 1, 1))
    rows = [(i, f"text {i % 50}".upper() if i % 3 else f" text  {i % 50}") for i in range(150)]
    got = {r.doc_id: (r.class_id, r.n) for r in exact_digest.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 50, 3) for i in range(150)}


def test_op9(spark, folder):
    got = QUERIES["op9_simhash"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS["documents"])
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {-6 + 53 * 3, -6 + 54 * 3, -6 + 55 * 3} <= {r.doc_id for r in zero} and len({r.component_id for r in zero}) == 1
    assert all(len(r.fingerprint) == 16 for r in got)


def test_op10(spark, folder):
    got = {(r.conv_id, r.turn, r.json): r for r in QUERIES["op10_tool_calls"](spark, folder).collect()}
    state = defaultdict(set)
    for (c, t, _), r in got.items():
        state[c, t].add(r.state)
    assert state == {(1, 0): {None}, (1, 1): {"linked"}, (1, 2): {"linked"}, (1, 3): {"no result"}, (1, 5): {"no call"}, (2, 0): {"linked"}, (2, 1): {"linked", "repeated result"}, (3, 0): {"linked"}, (3, 1): {"repeated result"}, (None, 4): {"no identifier"}, (4, None): {"no identifier"}, (5, 1): {None}, (6, 1): {"repeated call"}}
    one = next(r for (c, t, _), r in got.items() if (c, t) == (1, 1))
    assert one.valid and json.loads(json.loads(one.json)["arguments"]) == {"prompt": 'hi "there"\n', "words": 2}
    assert next(r for (c, t, _), r in got.items() if (c, t) == (2, 0)).valid is False


def test_calls_stand_behind_what_they_need(spark):
    schema = "conv_id long, turn long, kind string, call_id string, tool string, body string, needs array<string>"
    call = lambda t, c, *needs: (1, t, "call", c, "reply", None, list(needs))
    result = lambda t, c: (1, t, "result", c, None, "r", None)
    rows = [call(1, "a", "d"), call(2, "b", "a"), call(3, "c", "b", "none"), call(4, "d"), result(5, "a"), result(6, "d"), call(7, "x", "y"), call(8, "y", "x"), call(9, "z", "y"), call(10, "e", "d"), (2, 1, "call", "a", "reply", None, None)]
    got = chat.link(spark.createDataFrame(rows, schema)).collect()
    order = [r.call_id + r.kind[0] for r in sorted((r for r in got if r.conv_id == 1 and r.call_id not in "xyz"), key=lambda r: (r.anchor, r.step, r.turn))]
    assert {r.call_id for r in got if r.state == "cyclic"} & {"x", "y"} and not [r for r in got if r.state == "cyclic" and r.call_id not in "xyz"]
    assert order == ["dc", "dr", "ac", "ar", "bc", "cc", "ec"]
