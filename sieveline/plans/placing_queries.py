"""Folders, sets, plans, twins, guards, rhythm and keys over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import vectors as V
from ..operators import clusters as K
from ..operators import graph as G
from ..operators import nearness as R
from ..operators import placing as P
from . import registry
from .curation_queries import BASE, NOW, two_releases
from .registry import Tables, query

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@query("SELECT c_custkey, c_nationkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 + 1 AS INTEGER) AS sibling FROM customer")
def folder_with_room(t: Tables) -> DataFrame:
    return P.numbered_folders(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", [F.col("c_custkey")], 20)


@query("""SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
WHERE n <= 12 OR (r * 12) // n <> ((r - 1) * 12) // n""")
def set_cap_spread(t: Tables) -> DataFrame:
    return P.evenly_spread(t.part.select("p_partkey", "p_brand", "p_size"), "p_brand", [F.col("p_size"), F.col("p_partkey")], 12).select("p_partkey", "p_brand")


@query("""SELECT p_partkey FROM (SELECT p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1 OR p_retailprice > 910""")
def one_per_round_robin(t: Tables) -> DataFrame:
    """The best of each set and number; pinned items all stay."""
    return P.one_each(t.part, ["p_brand", "p_size"], [F.desc("p_retailprice"), F.col("p_partkey")], F.col("p_retailprice") > 910).select("p_partkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 1 END""")
def kit_pins(t: Tables) -> DataFrame:
    """One item a role, two for some roles, of each kit."""
    most = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).otherwise(1)
    return P.quota(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], most).select("o_orderkey")


@query("""SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size % 12 ORDER BY CASE WHEN p_retailprice > 910 THEN 0 ELSE 1 END, abs((p_size + 6) % 12 - 6), p_partkey) AS r FROM part) WHERE r = 1""")
def note_dedup(t: Tables) -> DataFrame:
    """One note of each set and target: a pin first, then the smallest shift."""
    rows = t.part.withColumn("target", F.col("p_size") % 12)
    order = [F.when(F.col("p_retailprice") > 910, 0).otherwise(1), F.abs((F.col("p_size") + 6) % 12 - 6), F.col("p_partkey")]
    return P.one_each(rows, ["p_brand", "target"], order, F.lit(False)).select("p_partkey")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars < 300)
SELECT source, CAST(max(r) AS BIGINT) AS count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE r <= 3) AS examples FROM r GROUP BY source""")
def first_examples(t: Tables) -> DataFrame:
    """How many short texts each source has, and the first three."""
    return P.examples(t.documents.where("n_chars < 300").select("source", "doc_id"), "source", "doc_id", 3)


@query("""WITH d AS (SELECT doc_id, md5(text) AS digest, coalesce(source IN ('src0', 'src1'), false) AS chosen FROM documents WHERE text IS NOT NULL), s AS (SELECT digest, count(*) AS n FROM d WHERE chosen GROUP BY digest)
SELECT doc_id, n - CAST(chosen AS INTEGER) AS twins FROM d JOIN s USING (digest) WHERE n - CAST(chosen AS INTEGER) > 0""")
def twin_lookup(t: Tables) -> DataFrame:
    return P.twins(t.documents.select("doc_id", "source", F.md5("text").alias("digest")), "doc_id", "digest", F.col("source").isin("src0", "src1"))


@query("""WITH d AS (SELECT doc_id, md5(text) AS digest, lang, source FROM documents), f AS (SELECT * FROM d WHERE source <> 'src0'),
a AS (SELECT digest, lang, min(doc_id) AS a FROM f GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT digest, min(doc_id) AS b FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT d.doc_id AS old, coalesce(a, b) AS new, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'only' ELSE 'lost' END AS how FROM d LEFT JOIN a ON a.digest = d.digest AND a.lang = d.lang LEFT JOIN b ON b.digest = d.digest WHERE d.source = 'src0'""")
def rating_rekey(t: Tables) -> DataFrame:
    """Where the content of a source that went lives on."""
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"), "lang", "source")
    return P.rekeyed(rows.where("source = 'src0'"), rows.where("source <> 'src0'"), "doc_id", "digest", "lang")


@query(f"""WITH b AS (SELECT k, digest, k % 3 AS kind FROM {BASE}), n AS (SELECT k, digest, k % 3 AS kind FROM {NOW}),
j AS (SELECT coalesce(b.k, n.k) AS k, coalesce(b.kind, n.kind) AS kind, coalesce(b.digest, n.digest) AS digest, CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'retired' WHEN b.digest = n.digest THEN 'kept' ELSE 'changed' END AS x FROM b FULL JOIN n ON b.k = n.k)
SELECT k, CASE WHEN x = 'new' AND EXISTS (SELECT 1 FROM j g WHERE g.x = 'retired' AND g.kind = j.kind AND g.digest = j.digest) THEN 'duplicate' ELSE x END AS action FROM j""")
def device_plan(t: Tables) -> DataFrame:
    """Two releases as a lock and a plan."""
    lock, now = (r.withColumn("kind", F.col("k") % 3) for r in two_releases(t))
    return P.device_plan(lock, now, "k", "digest", "kind")


@query("""WITH b AS (SELECT source, doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)), f AS (SELECT source, doc_id, n_chars FROM documents WHERE lang = 'en')
SELECT source, doc_id, 'base' AS origin FROM b UNION ALL
SELECT source, doc_id, 'added' FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = f.source AND b.doc_id = f.doc_id)) WHERE r <= 25""")
def superset_build(t: Tables) -> DataFrame:
    """A base as it is, and an allowance of additions for each group."""
    docs = t.documents.select("source", "doc_id", "lang", "n_chars")
    base = docs.join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    return P.superset(base, docs.where("lang = 'en'"), "source", "doc_id", [F.desc("n_chars"), F.col("doc_id")], 25)


@query("""SELECT count(*) AS known, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS gone, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) >= 10 AND sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) > 0.2 * count(*) AS blocked FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def missing_guard(t: Tables) -> DataFrame:
    return P.guard(t.documents.select("doc_id"), t.labels, "doc_id")


@query(f"""WITH b AS {BASE}, n AS {NOW} SELECT b.k, 'left' AS change, y.o_orderstatus AS reason FROM b LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000) y ON y.o_orderkey = b.k WHERE b.k NOT IN (SELECT k FROM n)
UNION ALL SELECT k, 'joined', NULL FROM n WHERE k NOT IN (SELECT k FROM b)""")
def change_log(t: Tables) -> DataFrame:
    """What left and joined, with the reason on record."""
    why = t.orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("reason"))
    return P.changes(*two_releases(t), "k", why)


@query("SELECT round(sum(s), 6) AS work, round(max(s), 6) AS longest, round(greatest(max(s), sum(s) / 8) + 45.0, 6) AS wall FROM (SELECT p_type, sum(p_size) * 0.06 AS s FROM part GROUP BY p_type)")
def timing_estimate(t: Tables) -> DataFrame:
    costs = t.part.groupBy("p_type").agg((F.sum("p_size") * 0.06).alias("s"))
    return P.wall_seconds(costs, "s", 8, 45.0).select(*(F.round(c, 6).alias(c) for c in ("work", "longest", "wall")))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, value < lag(value) OVER w - 1.5 AS fall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(stddev_pop(gap) / (avg(gap) + 1e-9), 6) END AS regularity, coalesce(bool_and(fall), false) AS echo FROM g GROUP BY user_id""")
def event_rhythm(t: Tables) -> DataFrame:
    rows = P.rhythm(t.events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value", "event_id", 1.5)
    return rows.withColumn("regularity", F.round("regularity", 6))


def _subtype_sql() -> str:
    return """SELECT l_orderkey, l_linenumber, CASE
WHEN cat LIKE '%kick%' THEN CASE WHEN b < 0.10 AND h > 0.70 AND dur > 0.25 THEN 'sub_kick' WHEN b > 0.45 AND crest > 6 AND dur < 0.15 THEN 'click_kick' ELSE 'acoustic_kick' END
WHEN cat LIKE '%snare%' THEN CASE WHEN b > 0.70 AND crest > 9 THEN 'rimshot' WHEN b > 0.55 AND dur > 0.30 AND noise > 0.70 THEN 'clap' ELSE 'snare' END
WHEN cat LIKE '%hat%' OR cat LIKE '%shaker%' THEN CASE WHEN dur > 0.80 AND b IS NOT NULL THEN 'cymbal' WHEN dur < 0.15 AND b > 0.60 THEN 'closed_hat' WHEN dur >= 0.15 AND b > 0.55 THEN 'open_hat' ELSE 'closed_hat' END END AS subtype
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Perc Kicks' WHEN 1 THEN 'Perc Snares' WHEN 2 THEN 'Perc Hats & Shakers' END AS c0, lower(c0) AS cat, CASE WHEN l_quantity = 13 THEN NULL ELSE l_tax * 12 END AS b, l_discount * 10 AS h, l_discount * 9 AS noise, l_quantity / 4.0 AS crest, l_quantity / 50.0 AS dur FROM lineitem)"""


@query(_subtype_sql())
def drum_subtype(t: Tables) -> DataFrame:
    n, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    category = F.when(n == 0, "Perc Kicks").when(n == 1, "Perc Snares").when(n == 2, "Perc Hats & Shakers")
    bright, tonal, noisy = F.when(q != 13, F.col("l_tax") * 12), F.col("l_discount") * 10, F.col("l_discount") * 9
    return t.lineitem.select("l_orderkey", "l_linenumber", X.drum_subtype(category, bright, tonal, noisy, q / 4.0, q / 50.0).alias("subtype"))


PROFILES = ", ".join(f"({r * 2 + m}, '{X.NOTES[r]} {('major', 'minor')[m]}', {i}, {p[(i - r) % 12]})" for r in range(12) for m, p in enumerate((X.MAJOR, X.MINOR)) for i in range(12))


@query(f"""WITH c AS (SELECT vec_id, unnest(range(12)) AS i, unnest(list_transform(embedding[1:12], lambda x: abs(x::DOUBLE))) AS w FROM embeddings), p(place, key, i, v) AS (VALUES {PROFILES}),
x AS (SELECT vec_id, place, key, corr(w, v) AS r FROM c JOIN p USING (i) GROUP BY ALL), b AS (SELECT vec_id, key, r, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, place) AS n FROM x)
SELECT vec_id, CASE WHEN r >= 0.7 THEN key END AS key, round(r, 6) AS r FROM b WHERE n = 1""")
def key_estimate(t: Tables) -> DataFrame:
    """The first twelve components' sizes taken as pitch-class weights."""
    found = t.embeddings.select("vec_id", X.key_of(F.transform(F.slice("embedding", 1, 12), F.abs)).alias("k"))
    return found.select("vec_id", F.col("k.key").alias("key"), F.round("k.r", 6).alias("r"))


@query("""WITH f AS (SELECT split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS top FROM pages)
SELECT host || '/' || top AS folder, count(*) AS n, round(count(*) / (SELECT count(*) FROM f)::DOUBLE, 9) AS share FROM f GROUP BY 1 ORDER BY n DESC, folder LIMIT 20""")
def top_folders(t: Tables) -> DataFrame:
    """The largest folders and their share of everything: a report of twenty rows."""
    parts = F.split("url", "/")
    counts = t.pages.select(F.concat(F.get(parts, F.lit(2)), F.lit("/"), F.coalesce(F.get(parts, F.lit(3)), F.lit(""))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    whole = t.pages.agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("n"), "folder").limit(20)
    return top.crossJoin(F.broadcast(whole)).select("folder", "n", F.round(F.col("n") / F.col("_n"), 9).alias("share"))  # one row


@query("SELECT lang, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM documents GROUP BY lang")
def content_digest(t: Tables) -> DataFrame:
    """A digest that does not depend on the order of rows: partial sums of hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))), 1, 8), 16, 10).cast("long")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("digest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, ts >= TIMESTAMP '2024-01-10 00:00:00' AS recent FROM events")
def date_stamps(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("stamp"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (ts >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("recent"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 100")
def pending_first(t: Tables) -> DataFrame:
    """The first hundred not done yet: the batch limit is the feature."""
    return t.documents.join(t.labels, "doc_id", "left_anti").orderBy("doc_id").limit(100).select("doc_id")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 400000 THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place FROM orders""")
def pins_first(t: Tables) -> DataFrame:
    """Pinned rows move to the front, the others keep their order."""
    order = [F.when(F.col("o_totalprice") > 400000, 0).otherwise(1), F.col("o_orderdate"), F.col("o_orderkey")]
    return t.orders.select("o_orderkey", F.row_number().over(P.Window.partitionBy("o_custkey").orderBy(*order)).alias("place"))


@query("""SELECT o_custkey, c AS home FROM (SELECT o_custkey, o_orderpriority AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN max(o_totalprice) > 400000 THEN 0 ELSE 1 END, count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1""")
def duplicate_winner(t: Tables) -> DataFrame:
    """An item in several categories keeps one: pinned, then the most hits, then the first by name."""
    hits = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("p"))
    return hits.groupBy("o_custkey").agg(F.min(F.struct(F.when(F.col("p") > 400000, 0).otherwise(1).alias("a"), (-F.col("n")).alias("b"), F.col("o_orderpriority").alias("home"))).alias("m")).select("o_custkey", "m.home")


@query("""SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_discount = 0)""")
def unplaced(t: Tables) -> DataFrame:
    """Items that no home and no candidate list took."""
    keys = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_discount")
    return t.part.select("p_partkey").join(keys.where("l_quantity > 45"), "p_partkey", "left_anti").join(keys.where("l_discount = 0"), "p_partkey", "left_anti")


@query("""WITH d AS (SELECT doc_id, md5(text) AS digest FROM documents), l AS (SELECT doc_id FROM labels WHERE quality = 0), h AS (SELECT DISTINCT digest FROM d JOIN l USING (doc_id))
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'path' ELSE 'content' END AS how FROM d LEFT JOIN (SELECT DISTINCT doc_id FROM l) l ON l.doc_id = d.doc_id WHERE l.doc_id IS NOT NULL OR d.digest IN (SELECT digest FROM h)""")
def rating_reach(t: Tables) -> DataFrame:
    """A verdict reaches its own item and all of the same content."""
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"))
    said = t.labels.where("quality = 0").select("doc_id").distinct()
    own = rows.join(said.withColumn("_p", F.lit(1)), "doc_id", "left")
    same = rows.join(said, "doc_id", "left_semi").where("digest IS NOT NULL").select("digest").distinct().withColumn("_h", F.lit(1))
    return own.join(same, "digest", "left").where("_p = 1 OR _h = 1").select("doc_id", F.when(F.col("_p") == 1, "path").otherwise("content").alias("how"))


@query("""WITH n AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), w AS (SELECT sum(n) AS total FROM n)
SELECT p_type, n, round(least(1.0, total / (8.0 * 1000)), 6) AS scale, CAST(greatest(1, floor(200 * least(1.0, total / (8.0 * 1000)))) AS BIGINT) AS budget FROM n CROSS JOIN w""")
def library_scaling(t: Tables) -> DataFrame:
    """Budgets shrink where the library is small for them."""
    sizes = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    scale = F.least(F.lit(1.0), F.col("total") / (8.0 * 1000))
    rows = sizes.crossJoin(F.broadcast(t.part.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return rows.select("p_type", "n", F.round(scale, 6).alias("scale"), F.greatest(F.lit(1), F.floor(200 * scale)).cast("long").alias("budget"))


@query("""WITH t AS (SELECT l_suppkey AS k, 60 + (l_quantity * 3) % 140 AS bpm FROM lineitem) SELECT CASE WHEN bpm < 90 THEN 0 WHEN bpm < 110 THEN 1 WHEN bpm < 128 THEN 2 WHEN bpm < 150 THEN 3 ELSE 4 END AS band, count(*) AS n, count(DISTINCT k) AS packs, median(bpm) AS middle FROM t GROUP BY 1""")
def tempo_bands(t: Tables) -> DataFrame:
    """Half-open bands with their counts and medians."""
    bpm = 60 + (F.col("l_quantity") * 3) % 140
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), bpm.alias("bpm"))
    band = sum((F.when(F.col("bpm") >= e, 1).otherwise(0) for e in (90, 110, 128, 150)), F.lit(0))
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("packs"), F.median("bpm").alias("middle"))


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id, v FROM m JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l ON l.doc_id = m.vec_id)
SELECT m.vec_id, round(max(list_dot_product(m.v, q.v) / sqrt(list_dot_product(m.v, m.v)) / sqrt(list_dot_product(q.v, q.v))), 6) AS nearest FROM m JOIN q ON q.vec_id <> m.vec_id GROUP BY m.vec_id""")
def coverage_audit(t: Tables) -> DataFrame:
    """How near each item is to the nearest other of a curated set."""
    chosen = t.embeddings.join(t.labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return R.nearest_to_set(t.embeddings, chosen, "embedding", "vec_id").select("vec_id", F.round("nearest", 6).alias("nearest"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS b FROM part WHERE p_size <= 20), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(a, b) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT w.a, u.b FROM w JOIN u ON u.a = w.b) SELECT a AS p_partkey, min(b) AS component FROM w GROUP BY a""")
def copy_components(t: Tables) -> DataFrame:
    """Connected components of links between parts."""
    whole = t.part.agg(F.count(F.lit(1)).alias("n"))
    links = t.part.where("p_size <= 20").crossJoin(F.broadcast(whole)).select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).alias("b"))  # one row
    found = G.components(t.part.select("p_partkey"), links, "p_partkey")
    return found


@query("""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1),
d AS (SELECT e.vec_id, e.label, sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, coalesce(l.quality, 0) AS q, coalesce(l.toxic, 1) AS t FROM embeddings e JOIN c ON c.label = e.label LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = e.vec_id)
SELECT vec_id, label, CAST(r AS INTEGER) AS place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(d - 0.06 * q - CASE WHEN t = 0 THEN 0.10 ELSE 0.0 END, 9), vec_id) AS r FROM d) WHERE r <= 5""")
def medoid_pick(t: Tables) -> DataFrame:
    """The five items of each group that stand for it."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    middle = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))  # 64 numbers a group
    said = t.labels.groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    rows = t.embeddings.join(middle, "label").join(said, "vec_id", "left")
    away = V.norm(F.zip_with("embedding", "c", lambda a, b: a.cast("double") - b))
    cost = F.round(K.medoid_order(away, F.lit(1), F.coalesce("q", F.lit(0)), F.coalesce("x", F.lit(1)) == 0), 9)
    return K.picked(rows, "label", "vec_id", cost, F.lit(False), 5).select("vec_id", "label", "place")


@query()
def kmeans_families(t: Tables) -> DataFrame:
    """Families of all vectors; an iteration, which SQL does not express."""
    n = t.embeddings.count()
    centres = K.kmeans(t.embeddings, "embedding", "vec_id", K.families_wanted(n, 800, 8, 30))
    return K.assigned(t.embeddings, "embedding", "vec_id", centres, K.merged_centres(centres))


@query()
def sound_model(t: Tables) -> DataFrame:
    """A softmax model of the groups' vectors, learned on four fifths of the rows and applied to all."""
    top = t.embeddings.agg(F.max("label")).first()[0]
    model = K.train(t.embeddings, "embedding", "label", (top or 0) + 1, F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    return K.classified(t.embeddings, "embedding", "vec_id", model)
