"""Labels from names and paths, guards, votes and homes over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import vectors as V
from ..functions.sqlfuncs import register
from ..operators import labels as L
from ..operators import routing as G
from .registry import Tables, query

#: Kinds of the part table's nouns, and of pages' paths: the vocabulary these queries route by.
KINDS = [("round", r"\b(ring|gear)\b"), ("flat", r"\b(plate|bolt)\b"), ("odd", r"\b(gizmo|widget|anvil)\b")]
TONES = [("cold", r"\b(blue|cold)\b"), ("warm", r"\b(red|hot)\b"), ("aged", r"\bold\b")]
KIND_SQL = "CASE WHEN regexp_matches({0}, '\\b(ring|gear)\\b') THEN 'round' WHEN regexp_matches({0}, '\\b(plate|bolt)\\b') THEN 'flat' WHEN regexp_matches({0}, '\\b(gizmo|widget|anvil)\\b') THEN 'odd' END"
TONE_SQL = "CASE WHEN regexp_matches({0}, '\\b(blue|cold)\\b') THEN 'cold' WHEN regexp_matches({0}, '\\b(red|hot)\\b') THEN 'warm' WHEN regexp_matches({0}, '\\bold\\b') THEN 'aged' END"
PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


def joined(x: Column) -> Column:
    return F.concat_ws(",", x)


@query(f"""SELECT p_partkey, {KIND_SQL.format('p_name')} AS kind, coalesce({TONE_SQL.format('p_name')}, {TONE_SQL.format('lower(p_type)')}, 'none') AS tone FROM part""")
def first_label(t: Tables) -> DataFrame:
    """The first rule that fits: the name before the type (instrument and machine labels)."""
    name = F.col("p_name")
    return t.part.select("p_partkey", R.first_label(name, KINDS).alias("kind"), F.coalesce(R.first_label(name, TONES, F.lower("p_type")), F.lit("none")).alias("tone"))


@query("""WITH n AS (SELECT doc_id, text, regexp_matches(text, '\\band\\b') AS a, regexp_matches(text, '\\bof\\b') AS b, regexp_matches(text, '\\bthe\\b') AS c, source FROM documents)
SELECT doc_id, CASE WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) = 1 THEN CASE WHEN a THEN 'and' WHEN b THEN 'of' ELSE 'the' END
WHEN CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) > 1 AND source = 'src0' AND a THEN 'and' END AS kind FROM n""")
def only_label(t: Tables) -> DataFrame:
    """Exactly one kind named; of several, the one that the folder names."""
    rules = [("and", r"\band\b"), ("of", r"\bof\b"), ("the", r"\bthe\b")]
    tie = F.when(F.col("source") == "src0", "and")
    return t.documents.select("doc_id", R.only_label(F.col("text"), rules, tie).alias("kind"))


@query(f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages), s AS (SELECT page_id, split_part(path, '/', 1) AS far, regexp_extract(path, '([^/]*/?[^/]*)$', 1) AS near FROM p)
SELECT page_id, CASE WHEN regexp_matches(near, '(^|/)(de|fr)/') THEN 'abroad' WHEN regexp_matches(near, '[0-9]$') THEN 'numbered' WHEN regexp_matches(far, '\\.net$') THEN 'net' ELSE '' END AS labels FROM s""")
def path_labels(t: Tables) -> DataFrame:
    """Strong rules before weak ones, name and folder before what stands above them."""
    path = path_of(F.col("url"))
    near, far = F.regexp_extract(path, r"([^/]*/?[^/]*)$", 1), F.split(path, "/")[0]
    strong, weak = [("abroad", r"(^|/)(de|fr)/")], [("numbered", r"[0-9]$"), ("net", r"\.net$")]
    return t.pages.select("page_id", joined(R.leaning(near, far, strong, weak)).alias("labels"))


@query(f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages), s AS (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS name, list_filter(string_split(path, '/'), lambda x: x <> '') AS q FROM p), r AS (SELECT page_id, name, q[1:len(q) - 1] AS f FROM s),
n AS (SELECT page_id, name, coalesce(list_filter(f, lambda x: NOT regexp_matches(x, '^(en|de)$'))[-1], f[1]) AS folder FROM r)
SELECT page_id, folder, CASE WHEN regexp_matches(name, '[05]$') THEN 'oneshot' WHEN regexp_matches(name, '7$') THEN 'loop' WHEN regexp_matches(folder, 'org$') THEN 'oneshot'
WHEN regexp_matches(folder, '(com|fr)$') AND NOT regexp_matches(name, '^1') THEN 'loop' END AS shape FROM n""")
def path_shape(t: Tables) -> DataFrame:
    """The shape that the name states, else its telling folder; a hit's name takes no loop from a folder."""
    path = path_of(F.col("url"))
    name, folder = F.regexp_extract(path, "([^/]*)$", 1), R.near_folder(path, "^(en|de)$")
    rows = t.pages.select("page_id", name.alias("name"), folder.alias("folder"))
    own = [("oneshot", "[05]$"), ("loop", "7$"), ("oneshot", "org$"), ("loop", "(com|fr)$")]
    return rows.select("page_id", "folder", R.shape(F.col("name"), F.col("folder"), own, "^1", "loop").alias("shape"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS s, CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS BIGINT) END AS n, CASE WHEN l_linestatus = 'O' THEN l_discount * 40 END AS hz, l_tax * 12 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN CASE WHEN s < 1.5 THEN 'oneshot' END WHEN s >= 1.0 AND n >= 4 THEN 'loop'
WHEN coalesce(s > 1.5 AND hz >= 1.0 AND hz * s >= 4 AND NOT coalesce(h >= 0.8 AND hz < 2.0, false), false) THEN 'loop' WHEN n <= 1 THEN 'oneshot' END AS shape FROM m""")
def sound_shape(t: Tables) -> DataFrame:
    """A shape from length, events, onset rate and harmonic share alone."""
    events = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("long"))
    onset = F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 40)
    return t.lineitem.select("l_orderkey", "l_linenumber", R.sound_shape(F.col("l_quantity") / 10, events, onset, F.col("l_tax") * 12).alias("shape"))


@query("""WITH m AS (SELECT p_partkey, p_name, p_size * 0.24 AS s, CAST(60 + p_partkey % 90 AS DOUBLE) AS bpm FROM part), b AS (SELECT *, s * bpm / 60.0 AS beats FROM m)
SELECT p_partkey, coalesce(round(beats) >= 4 AND abs(beats - round(beats)) * 60.0 / bpm <= 0.010 AND NOT regexp_matches(p_name, 'bolt'), false) AS cut FROM b""")
def cut_to_grid(t: Tables) -> DataFrame:
    """Whole beats at a stated tempo, unless the name says it is one sound."""
    bpm = (60 + F.col("p_partkey") % 90).cast("double")
    return t.part.select("p_partkey", R.on_grid(F.col("p_size") * F.lit(0.24), bpm, F.col("p_name").rlike("bolt")).alias("cut"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR (l_quantity >= 7 AND l_discount > 0.05) AS by_either, l_returnflag = 'R' AND l_quantity >= 7 AS by_both FROM lineitem""")
def loop_guard(t: Tables) -> DataFrame:
    """Hits that are loops, in both modes."""
    args = F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_discount") > 0.05
    return t.lineitem.select("l_orderkey", "l_linenumber", R.mislabeled_loop("tag_or_onset", *args).alias("by_either"), R.mislabeled_loop("tag_and_onset", *args).alias("by_both"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS n, CASE WHEN l_linenumber >= 3 THEN l_discount * 4 END AS cv, l_linestatus = 'F' AS echo FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(n >= 2 AND NOT echo, false) AS strict, coalesce(n >= 3 AND cv < 0.2 AND NOT echo, false) AS regular FROM m""")
def chain_guard(t: Tables) -> DataFrame:
    """Files that hold several sounds; those not profiled pass."""
    n = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))
    cv = F.when(F.col("l_linenumber") >= 3, F.col("l_discount") * 4)
    chain = lambda mode: R.sample_chain(mode, n, cv, F.col("l_linestatus") == "F").alias(mode)
    return t.lineitem.select("l_orderkey", "l_linenumber", chain("strict"), chain("regular"))


@query("""WITH w AS (SELECT * FROM (VALUES ('SMALL', 5, 40), ('LARGE', NULL, 30), ('PROMO', 10, NULL)) w(p_type, lo, hi))
SELECT p_partkey FROM part JOIN w USING (p_type) WHERE p_retailprice > 905 AND (p_size < coalesce(lo, p_size) OR p_size > coalesce(hi, p_size))""")
def pitch_window(t: Tables) -> DataFrame:
    """Sure notes outside their category's limits."""
    limits = t.spark.createDataFrame([("SMALL", 5, 40), ("LARGE", None, 30), ("PROMO", 10, None)], "p_type string, lo int, hi int")
    rows = t.part.join(F.broadcast(limits), "p_type")  # one row for each category
    return rows.where(R.outside_window(F.col("p_size"), F.col("p_retailprice") > 905, F.col("lo"), F.col("hi"))).select("p_partkey")


@query("""WITH c AS (SELECT p_partkey, p_name, list_distinct([split_part(p_name, ' ', 2), lower(p_type), 'other']) AS c FROM part),
f AS (SELECT p_partkey, p_name, c, list_filter(c, lambda x: x NOT IN ('small', 'large', 'other')) AS k FROM c), g AS (SELECT p_partkey, p_name, CASE WHEN len(k) > 0 THEN k ELSE c END AS c FROM f),
h AS (SELECT p_partkey, c, list_filter(c, lambda x: contains(p_name, x)) AS k FROM g)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN len(k) > 0 THEN k ELSE c END), ',') AS left_over FROM h""")
def vetoes(t: Tables) -> DataFrame:
    """Candidates less those that the family, then the name rule out; never none."""
    every = F.array_distinct(F.array(F.split("p_name", " ")[1], F.lower("p_type"), F.lit("other")))
    family = R.vetoed(every, lambda x: ~x.isin("small", "large", "other"))
    rows = t.part.select("p_partkey", "p_name", family.alias("c"))
    return rows.select("p_partkey", joined(F.array_sort(R.vetoed(F.col("c"), lambda x: F.col("p_name").contains(x)))).alias("left_over"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, ' (re|und|the) ') AND NOT (regexp_matches(text, ' (of|der) ') AND NOT regexp_matches(text, '@'))""")
def style_excluded(t: Tables) -> DataFrame:
    """Excluded by style, unless spared, unless the content tells."""
    return t.documents.where(R.ruled_out(F.col("text"), " (re|und|the) ", " (of|der) ", "@")).select("doc_id")


@query(f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path, url FROM pages)
SELECT page_id, regexp_matches(url, '[?&]ref=') AS preview, CASE WHEN contains(path, '/fr/') THEN 'french' WHEN contains(path, '/de/') THEN 'german' END AS reserved FROM p""")
def reserved_names(t: Tables) -> DataFrame:
    """Previews by path, and categories that a part of the path reserves."""
    path = path_of(F.col("url"))
    return t.pages.select("page_id", F.col("url").rlike("[?&]ref=").alias("preview"), R.first_label(path, [("french", "/fr/"), ("german", "/de/")]).alias("reserved"))


@query("""WITH w AS (SELECT doc_id, n_chars < 400 AND lang = 'en' AS wave, n_chars > 3000 AND source IN ('src1', 'src2') AS long_table, md5(text) AS digest FROM documents)
SELECT doc_id, coalesce(wave, false) AS wave, coalesce(long_table, false) AS long_table, NOT coalesce(wave, false) AND digest IN (SELECT digest FROM w WHERE wave AND digest IS NOT NULL) AS not_here FROM w""")
def wave_tests(t: Tables) -> DataFrame:
    """Short waves and long tables by path and length; copies of waves count for nothing elsewhere."""
    rows = t.documents.select("doc_id", F.coalesce((F.col("n_chars") < 400) & (F.col("lang") == "en"), F.lit(False)).alias("wave"), F.coalesce((F.col("n_chars") > 3000) & F.col("source").isin("src1", "src2"), F.lit(False)).alias("long_table"), F.md5("text").alias("digest"))
    waves = rows.where("wave").select("digest", F.lit(True).alias("_w")).distinct()
    return rows.join(waves, "digest", "left").select("doc_id", "wave", "long_table", (~F.col("wave") & F.coalesce("_w", F.lit(False))).alias("not_here"))


ANCHORS = "SELECT label AS category, arg_min(embedding::DOUBLE[], vec_id) AS anchor, arg_max(embedding::DOUBLE[], vec_id) AS other FROM embeddings GROUP BY label"


def anchors(t: Tables) -> DataFrame:
    """An anchor and an anti-anchor for each label: its first and its last vector."""
    return t.embeddings.groupBy(F.col("label").alias("category")).agg(F.min_by("embedding", "vec_id").alias("anchor"), F.max_by("embedding", "vec_id").alias("anti"))


@query(f"""WITH a AS ({ANCHORS}), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], anchor) AS s, list_dot_product(embedding::DOUBLE[], other) AS n FROM embeddings JOIN a ON category = label)
SELECT vec_id, label, round(s, 6) AS score, s >= 0.1 AND s > n AS passes FROM s""")
def contrast_gate(t: Tables) -> DataFrame:
    """Nearer to the own anchor than to its anti-anchor, and near enough."""
    near = t.embeddings.join(F.broadcast(anchors(t)), F.col("category") == F.col("label"))  # one row for each label
    rows = near.select("vec_id", "label", V.dot(F.col("embedding"), F.col("anchor")).alias("s"), V.dot(F.col("embedding"), F.col("anti")).alias("n"))
    return rows.select("vec_id", "label", F.round("s", 6).alias("score"), R.contrast(F.col("s"), F.col("n"), 0.1).alias("passes"))


@query(f"""WITH a AS ({ANCHORS}), s AS (SELECT vec_id, category, list_dot_product(embedding::DOUBLE[], anchor) AS s, list_dot_product(embedding::DOUBLE[], other) AS n FROM embeddings, a),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, category DESC) AS r FROM s), b AS (SELECT x.vec_id, x.category, x.s, x.n, y.s AS s2, y.category AS c2 FROM r x LEFT JOIN r y ON y.vec_id = x.vec_id AND y.r = 2 WHERE x.r = 1)
SELECT vec_id, category, round(s, 6) AS score, CASE WHEN s >= 0.12 AND s - coalesce(s2, -1.0) >= 0.02 AND coalesce(s - n >= 0.02, true) THEN category END AS home FROM b""")
def nearest_anchor(t: Tables) -> DataFrame:
    """The home by sound alone, where it is clear; the nearest anchor in any case (which fills bands)."""
    found = G.nearest_anchor(t.embeddings, anchors(t), "embedding", "vec_id", 0.1, 0.02)
    return found.select("vec_id", "category", F.round("score", 6).alias("score"), "home")


@query("""WITH s AS (SELECT doc_id, lang, CASE WHEN length(text) > 0 THEN 1 - length(regexp_replace(text, '[ \\t\\n]', '', 'g')) / CAST(length(text) AS DOUBLE) END AS share FROM documents)
SELECT doc_id, round(share, 6) AS share FROM s WHERE lang = 'en' AND share > 0.18""")
def mostly_silent(t: Tables) -> DataFrame:
    """Loops that are more silence than a share allows."""
    whole = F.length("text")
    share = F.when(whole > 0, 1 - F.length(F.regexp_replace("text", "[ \t\n]", "")) / whole.cast("double"))
    return t.documents.where("lang = 'en'").select("doc_id", share.alias("share")).where("share > 0.18").withColumn("share", F.round("share", 6))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN 'name' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'folder' WHEN p_type = 'PROMO' THEN 'tag' WHEN p_size < 10 THEN 'sound' END AS witness FROM part""")
def evidence(t: Tables) -> DataFrame:
    """Who speaks for an item: its name, its folder, a tag, the sound."""
    said = R.evidence(("name", F.col("p_name").like("%ring")), ("folder", F.col("p_brand").isin("Brand#1", "Brand#2")), ("tag", F.col("p_type") == "PROMO"), ("sound", F.col("p_size") < 10))
    return t.part.select("p_partkey", said.alias("witness"))


@query("""WITH r AS (SELECT page_id, url, url LIKE 'https://%' AS inside FROM pages), m AS (SELECT bool_or(inside) AND NOT bool_and(inside) AS mixed FROM r) SELECT page_id FROM r, m WHERE mixed AND NOT inside""")
def outside_library(t: Tables) -> DataFrame:
    """Items under none of the roots; they are left out only where others are inside."""
    rows = t.pages.select("page_id", F.col("url").startswith("https://").alias("inside"))
    mixed = rows.agg((F.bool_or("inside") & ~F.bool_and("inside")).alias("mixed"))
    return rows.crossJoin(F.broadcast(mixed)).where("mixed AND NOT inside").select("page_id")  # one row


@query("""SELECT count(*) AS embedded, count(*) FILTER (d.doc_id IS NULL) AS missing, count(*) FILTER (d.source IN ('src0', 'src1')) AS elsewhere, count(*) FILTER (d.doc_id IS NOT NULL AND d.source NOT IN ('src0', 'src1')) AS usable FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""")
def usable_count(t: Tables) -> DataFrame:
    """Embedded items less the missing ones and those of other libraries."""
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id")).join(t.documents.select("doc_id", "source", F.lit(True).alias("there")), "doc_id", "left")
    other = F.col("source").isin("src0", "src1")
    return rows.agg(F.count(F.lit(1)).alias("embedded"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(other).alias("elsewhere"), F.count_if(F.col("there") & ~other).alias("usable"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urg%' AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def addition_scope(t: Tables) -> DataFrame:
    """A fragment of the path, and when it was seen."""
    return t.orders.where(F.col("o_orderpriority").ilike("%urg%") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, round(least(l_quantity / 20, coalesce((l_discount * 10000 + CASE WHEN l_returnflag <> 'R' THEN l_tax * 10000 END) / 1000.0, l_quantity / 20)), 9) AS seconds FROM lineitem""")
def hat_length(t: Tables) -> DataFrame:
    decay = F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 10000)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(R.hat_seconds(F.col("l_quantity") / 20, F.col("l_discount") * 10000, decay), 9).alias("seconds"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'and', 'of')))), ' ') AS tokens FROM conversations""")
def description_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", F.array_sort(R.tokens(F.col("text"), ["the", "and", "of"]))).alias("tokens"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 1.0 END AS a, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) % 12 * 1.0 END AS b, CASE WHEN l_tax > 0.01 THEN round(l_discount * 100) * 1.0 END AS c FROM lineitem),
o AS (SELECT *, (((a - c + 6) % 12) + 12) % 12 - 6 AS ac, (((a - b + 6) % 12) + 12) % 12 - 6 AS ab, (((b - c + 6) % 12) + 12) % 12 - 6 AS bc, (((c - a + 6) % 12) + 12) % 12 - 6 AS ca FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL THEN CASE WHEN abs(bc) <= 0.5 THEN 'fill both' WHEN b IS NULL AND c IS NOT NULL THEN 'fill heard' WHEN c IS NULL AND b IS NOT NULL THEN 'fill vendor' END
WHEN coalesce(abs(ac) <= 0.5, false) OR coalesce(abs(ab) <= 0.5, false) OR (b IS NULL AND c IS NULL) THEN 'keep' WHEN c IS NULL OR coalesce(round(ca) = -5, false) THEN 'conflict' WHEN coalesce(abs(bc) <= 0.5, false) THEN 'retune' ELSE 'renote' END AS verdict FROM o""")
def pitch_checks(t: Tables) -> DataFrame:
    """Named, vendor's and heard roots decide what happens to a name."""
    named = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") * F.lit(1.0))
    vendor = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int") % 12 * F.lit(1.0))
    heard = F.when(F.col("l_tax") > 0.01, F.round(F.col("l_discount") * 100) * F.lit(1.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", R.pitch_verdict(named, vendor, heard).alias("verdict"))


@query(f"""WITH p AS (SELECT page_id, [CAST(x AS INTEGER) FOR x IN regexp_extract_all({PATH_SQL}, '[0-9]+') IF length(x) < 6] AS n, length(html) / 400.0 AS s FROM pages),
f AS (SELECT page_id, list_filter(n, lambda b: b BETWEEN 60 AND 200 AND abs(s * b / 60.0 - round(s * b / 60.0)) <= 0.15) AS fits FROM p) SELECT page_id, fits[1] AS bpm FROM f""")
def stated_tempo(t: Tables) -> DataFrame:
    """The first number of a path that is a tempo at which the length is whole beats."""
    numbers = F.transform(F.filter(F.regexp_extract_all(path_of(F.col("url")), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) < 6), lambda x: x.cast("int"))
    rows = t.pages.select("page_id", numbers.alias("n"), (F.length("html") / F.lit(400.0)).alias("s"))
    beats = lambda b: F.col("s") * b / 60.0
    fits = F.filter("n", lambda b: b.between(60, 200) & (F.abs(beats(b) - F.round(beats(b))) <= 0.15))
    return rows.select("page_id", F.try_element_at(fits, F.lit(1)).alias("bpm"))


@query(f"""SELECT p_partkey, unnest(list_filter([CASE WHEN regexp_matches(p_name, '\\b(ring|gear)\\b') THEN 'round' END, CASE WHEN p_type = 'SMALL' OR p_name LIKE 'small %' THEN 'small' END, CASE WHEN p_size >= 40 THEN 'big' END], lambda x: x IS NOT NULL)) AS category FROM part
UNION SELECT p_partkey, 'small' FROM part WHERE p_retailprice > 910""")
def candidate_pairs(t: Tables) -> DataFrame:
    """Every category whose predicate holds, and what is pinned to one."""
    name, kind = F.col("p_name"), F.col("p_type")
    rules = {"round": name.rlike(r"\b(ring|gear)\b"), "small": (kind == "SMALL") | name.like("small %"), "big": F.col("p_size") >= 40}
    pins = t.part.where("p_retailprice > 910").select("p_partkey", F.lit("small").alias("category"))
    return G.candidates(t.part, "p_partkey", rules, pins)


VOTES = f"""SELECT p_partkey, 'name' AS source, {KIND_SQL.format('p_name')} AS category FROM part UNION ALL SELECT p_partkey, 'type', CASE p_type WHEN 'SMALL' THEN 'odd' WHEN 'PROMO' THEN 'flat' WHEN 'LARGE' THEN 'round' END FROM part
UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size < 15 THEN 'round' WHEN p_size > 35 THEN 'odd' END FROM part"""


def votes(t: Tables) -> DataFrame:
    name = R.first_label(F.col("p_name"), KINDS)
    kind = F.when(F.col("p_type") == "SMALL", "odd").when(F.col("p_type") == "PROMO", "flat").when(F.col("p_type") == "LARGE", "round")
    size = F.when(F.col("p_size") < 15, "round").when(F.col("p_size") > 35, "odd")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("source"), c.alias("category")) for n, c in (("name", name), ("type", kind), ("size", size)))))
    return t.part.select("p_partkey", each.alias("v")).select("p_partkey", "v.*").where("category IS NOT NULL")


@query(f"""WITH v AS (SELECT DISTINCT * FROM ({VOTES}) WHERE category IS NOT NULL), s AS (SELECT p_partkey, category, count(*) AS support FROM v GROUP BY ALL), h AS (SELECT p_partkey, count(DISTINCT source) AS heard FROM v GROUP BY p_partkey),
t AS (SELECT s.*, CASE WHEN category = 'round' THEN p_size / 50.0 WHEN category = 'flat' THEN 0.5 ELSE -1 END AS score FROM s JOIN part USING (p_partkey)),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY support DESC, score DESC, category DESC) AS r FROM t)
SELECT p_partkey, category AS home, support, heard >= 3 AND support < 2 AS conflict FROM b JOIN h USING (p_partkey) WHERE r = 1""")
def home_votes(t: Tables) -> DataFrame:
    """The home most classifiers vote for, its support and whether they contradict each other."""
    tie = t.part.select("p_partkey", F.explode(F.array(F.struct(F.lit("round").alias("category"), (F.col("p_size") / 50.0).alias("score")), F.struct(F.lit("flat").alias("category"), F.lit(0.5).alias("score")))).alias("x")).select("p_partkey", "x.*")
    return G.homes(votes(t), "p_partkey", 3, tie)


@query(f"""WITH p AS (SELECT list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') AS p FROM pages), r AS (SELECT CASE WHEN len(p) > 1 THEN p[1] END AS top, CASE WHEN len(p) > 2 THEN p[2] END AS sub FROM p),
c AS (SELECT top, count(*) AS n, count(DISTINCT CASE WHEN NOT regexp_matches(lower(sub), '^(wav|loops)$') THEN sub END) AS packs FROM r GROUP BY top),
w AS (SELECT sum(n) AS files, coalesce(sum(n) FILTER (top IS NULL), 0) AS loose, coalesce(sum(n) FILTER (regexp_matches(lower(top), '^(wav|loops)$')), 0) AS typed FROM c),
b AS (SELECT sum(n) AS held, coalesce(sum(n) FILTER (packs >= 4), 0) AS over_, coalesce(list(top ORDER BY top) FILTER (packs >= 4), []) AS names FROM (SELECT * FROM c WHERE top IS NOT NULL ORDER BY n DESC, top LIMIT 2)),
k AS (SELECT CASE WHEN loose >= 0.5 * files THEN 'flat' WHEN typed >= 0.6 * (files - loose) THEN 'types' WHEN held >= 0.8 * (files - loose) AND len(names) > 0 AND over_ >= 0.8 * (files - loose) THEN 'umbrella' ELSE 'packs' END AS layout, names, files FROM w, b)
SELECT layout, CASE WHEN layout = 'umbrella' THEN array_to_string(names, ',') ELSE '' END AS umbrellas, CAST(files AS BIGINT) AS files FROM k""")
def path_layout(t: Tables) -> DataFrame:
    """How a library is laid out, by the shares of its top folders."""
    found = G.layout(t.pages.select(path_of(F.col("url")).alias("path")), "path", "^(wav|loops)$")
    return found.select("layout", joined(F.col("umbrellas")).alias("umbrellas"), "files")


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, CASE WHEN len(p) > 1 THEN p[1] END AS vendor, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] END AS pack FROM p""")
def vendor_of_path(t: Tables) -> DataFrame:
    """The vendor and pack a path is capped under, by the library's layout."""
    rows = t.pages.select("page_id", path_of(F.col("url")).alias("path"))
    rows = rows.crossJoin(F.broadcast(G.layout(rows, "path", "^(wav|loops)$")))  # one row
    name = lambda depth: R.vendor(F.col("path"), F.col("layout"), F.col("umbrellas"), depth)
    return rows.select("page_id", name(1).alias("vendor"), name(2).alias("pack"))


@query("""WITH e AS (SELECT p_partkey AS k, p_type, p_name, p_brand, p_size FROM part)
SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.k < b.k WHERE abs(a.p_size - b.p_size) <= 0.05 * greatest(a.p_size, b.p_size)""")
def edition_pairs(t: Tables) -> DataFrame:
    """Recordings released twice: one name of one vendor, lengths alike."""
    rows = t.part.select("p_partkey", "p_type", "p_name", "p_size", F.col("p_brand").alias("pack"), F.col("p_brand").alias("folder"))
    return G.edition_pairs(rows, "p_partkey", "p_type", "pack", "folder", "p_name", "p_size")


@query("""WITH g AS (SELECT p_brand || '/' || p_type AS g, p_size AS n, CASE WHEN p_name LIKE '%bolt' OR p_type IN ('SMALL', 'PROMO') THEN p_size + 24.0 ELSE CAST(p_partkey % 60 AS DOUBLE) END AS root FROM part),
p AS (SELECT g, n, median(root) - n AS o FROM g GROUP BY g, n), v AS (SELECT x.g, x.n, x.o, count(*) FILTER (abs(x.o - y.o) <= 0.5) AS exact, count(*) FILTER (abs(((((x.o - y.o + 6) % 12) + 12) % 12) - 6) <= 0.5) AS agree, count(*) AS c FROM p x JOIN p y ON x.g = y.g GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY exact DESC, o, agree DESC) AS r FROM v) SELECT g, o AS "offset" FROM b WHERE r = 1 AND exact >= 3 AND agree >= c * 2.0 / 3""")
def number_sets(t: Tables) -> DataFrame:
    """Sets whose bare numbers are notes."""
    root = F.when(F.col("p_name").like("%bolt") | F.col("p_type").isin("SMALL", "PROMO"), F.col("p_size") + F.lit(24.0)).otherwise((F.col("p_partkey") % 60).cast("double"))
    rows = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("g"), F.col("p_size").alias("n"), root.alias("root"))
    return G.number_sets(rows, "g", "n", "root")


@query("""WITH e AS (SELECT d.doc_id, source, lang, quality, toxic, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
f AS (SELECT doc_id, source, lang, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS b, CASE WHEN toxic = 1 THEN CAST(n_chars AS DOUBLE) WHEN quality = 0 THEN CAST(-n_chars AS DOUBLE) ELSE CAST(CAST('0x' || substr(md5('7:' || doc_id), 1, 12) AS BIGINT) AS DOUBLE) END AS o FROM e WHERE quality IS DISTINCT FROM 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY b, o, doc_id) AS r FROM f) WHERE r <= 2), d AS (SELECT * EXCLUDE (r) FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY source ORDER BY b, o, doc_id) AS r FROM c) WHERE r <= 4),
q AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o, doc_id) AS r FROM d)
SELECT doc_id, CASE b WHEN 0 THEN 'toxic' WHEN 1 THEN 'poor' ELSE 'random' END AS bucket, r AS place FROM q WHERE r <= CASE b WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 40 END ORDER BY b, o, doc_id LIMIT 40""")
def review_queue(t: Tables) -> DataFrame:
    """What to review next: suspects by bucket and quota, caps by category and family, the rest drawn."""
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left").where("NOT (quality <=> 1)")
    toxic = rows.where("toxic = 1").select("doc_id", F.col("n_chars").cast("double").alias("order"))
    poor = rows.where("quality = 0").select("doc_id", (-F.col("n_chars")).cast("double").alias("order"))
    return G.review_queue(rows, "doc_id", "source", "lang", [("toxic", 0.25, toxic), ("poor", 0.15, poor)], 40, 4, 2, 7)


@query("""SELECT doc_id, coalesce(n_chars > 300, false) AND (coalesce(contains(text, '@'), false) OR (coalesce(regexp_matches(text, ' (and|of) '), false) AND NOT coalesce(source = 'src2', false))) AS phrase FROM documents""")
def phrase_test(t: Tables) -> DataFrame:
    """Loops that are phrases: marked so, or tonal by their words where nothing names drums."""
    text = F.col("text")
    return t.documents.select("doc_id", R.phrase(F.col("n_chars") > 300, text.contains("@"), text.rlike(" (and|of) "), F.col("source") == "src2").alias("phrase"))


@query("""WITH own AS (SELECT DISTINCT p_partkey, p_type AS tag FROM part WHERE p_type <> 'SMALL'), m AS (SELECT * FROM (VALUES ('red', 'warm'), ('hot', 'warm'), ('blue', 'cold'), ('bolt', 'metal'), ('ring', 'metal')) m(word, tag)),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_type = 'SMALL') SELECT p_partkey, tag, 'provider' AS origin FROM own UNION ALL SELECT DISTINCT p_partkey, tag, 'words' FROM w JOIN m USING (word)""")
def tag_stand_ins(t: Tables) -> DataFrame:
    """Words of the name stand in for the tags of items that the provider never saw."""
    tags = t.part.where("p_type <> 'SMALL'").select("p_partkey", F.col("p_type").alias("tag"))
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    mapping = t.spark.createDataFrame([("red", "warm"), ("hot", "warm"), ("blue", "cold"), ("bolt", "metal"), ("ring", "metal")], "word string, tag string")
    return L.stood_in(t.part, tags, words, F.broadcast(mapping), "p_partkey")  # a word list


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, least(label % 12, 12 - label % 12) AS off FROM embeddings""")
def sql_functions(t: Tables) -> DataFrame:
    """The engine's expressions called from SQL."""
    register(t.spark)
    t.embeddings.createOrReplaceTempView("sieveline_vectors")
    axis = "transform(sequence(1, 64), i -> CASE WHEN i = 1 THEN 1D ELSE 0D END)"
    return t.spark.sql(f"SELECT vec_id, round(vec_norm(CAST(embedding AS ARRAY<DOUBLE>)), 6) AS norm, round(vec_cosine(CAST(embedding AS ARRAY<DOUBLE>), {axis}), 6) AS first, pitch_distance(CAST(label AS INT), 0) AS off FROM sieveline_vectors")
