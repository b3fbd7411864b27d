"""Scans, hashes, change states, missing marks, caches, moves and stored results, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ingest as I
from ..operators.written import written
from .registry import Tables, query


@query("""SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size BETWEEN 5 AND 30 AND list_has_any(string_split(p_name, ' '), ['ring', 'bolt', 'red']) AND p_brand = 'Brand#3'""")
def vendor_scan(t: Tables) -> DataFrame:
    """A vendor's table by types, range, list membership and status."""
    rows = t.part.withColumn("words", F.split("p_name", " "))
    found = I.scan(rows, types=("p_type", ("SMALL", "PROMO")), ranges={"p_size": (5, 30)}, lists={"words": ("ring", "bolt", "red")}, status=("p_brand", "Brand#3"))
    return found.select("p_partkey", "p_type", "p_retailprice")


@query("""SELECT o.o_orderkey, o.o_totalprice, c.c_mktsegment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' AND o.o_totalprice >= 1000""")
def bulk_import(t: Tables) -> DataFrame:
    """A whole import: filters, then the extended table on the left."""
    rows = I.scan(t.orders, status=("o_orderstatus", "F"), ranges={"o_totalprice": (1000, None)})
    return rows.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH live AS (SELECT DISTINCT l_orderkey AS k, p_type || '/' || p_brand AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'), g AS (SELECT k, array_to_string(list_sort(list(path)), ',') AS tags FROM live GROUP BY k)
SELECT o_orderkey, coalesce(tags, '') AS tags FROM orders LEFT JOIN g ON k = o_orderkey""")
def child_tags(t: Tables) -> DataFrame:
    """Each item's live tags as sorted paths of the taxonomy."""
    tags = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").alias("deleted"))
    paths = t.part.select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("path"))
    return I.child_tags(t.orders, tags, paths, "o_orderkey", "p_partkey", "deleted").select("o_orderkey", F.concat_ws(",", "tags").alias("tags"))


@query("""WITH q AS (SELECT doc_id, text, substr(sha256(encode(text)[1:64]), 1, 16) AS quick FROM documents WHERE text IS NOT NULL), c AS (SELECT quick FROM q GROUP BY quick HAVING count(*) > 1)
SELECT d.doc_id, quick AS quick_hash, CASE WHEN quick IN (SELECT quick FROM c) THEN substr(sha256(q.text), 1, 16) END AS file_hash FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id""")
def content_hashes(t: Tables) -> DataFrame:
    """A quick hash of the head of each file, and a whole one where quick ones collide."""
    return I.hashed(t.documents, "doc_id", "text", 64)


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey % 50 AS g, o_custkey AS size, o_orderdate AS modified, md5(o_orderstatus) AS q, CASE WHEN o_orderkey % 4 <> 0 THEN md5(o_orderpriority) END AS f FROM orders),
o AS (SELECT k, g, CASE WHEN k % 13 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN k % 3 = 0 OR g < 25 THEN modified + INTERVAL 1 HOUR ELSE modified END AS modified, CASE WHEN k % 5 = 0 THEN 'x' ELSE q END AS q, CASE WHEN k % 5 = 0 THEN 'x' ELSE f END AS f FROM s),
b AS (SELECT s.*, o.size AS osize, o.q AS oq, o.f AS of_, s.modified IS DISTINCT FROM o.modified AS moved FROM s JOIN o USING (k)), g AS (SELECT g, count(*) FILTER (moved) >= 20 AND count(*) FILTER (moved) >= 0.8 * count(*) AS most FROM b GROUP BY g)
SELECT k, CASE WHEN size <> osize THEN 'changed' WHEN NOT moved THEN 'same' WHEN NOT coalesce(f = of_, q = oq) THEN 'changed' WHEN most THEN 'copied' WHEN coalesce(f = of_, q = oq) THEN 'touched' ELSE 'unsure' END AS state FROM b JOIN g USING (g)""")
def known_changes(t: Tables) -> DataFrame:
    """What became of known files: size and time first, then hashes; many moved times in a folder are a copy."""
    k, g = F.col("o_orderkey"), F.col("o_custkey") % 50
    seen = t.orders.select(k.alias("k"), g.alias("g"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("modified"), F.md5("o_orderstatus").alias("quick_hash"), F.when(k % 4 != 0, F.md5("o_orderpriority")).alias("file_hash"))
    edited = F.col("k") % 5 == 0
    known = seen.select("k", F.when(F.col("k") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when((F.col("k") % 3 == 0) | (F.col("g") < 25), F.expr("modified + INTERVAL 1 HOUR")).otherwise(F.col("modified")).alias("modified"), F.when(edited, "x").otherwise(F.col("quick_hash")).alias("quick_hash"), F.when(edited, "x").otherwise(F.col("file_hash")).alias("file_hash"))
    return I.known_changes(known, seen, "k", "g")


@query("""WITH i AS (SELECT vec_id AS k, label FROM embeddings), s AS (SELECT doc_id FROM documents WHERE lang <> 'fr'), m AS (SELECT vec_id AS k, DATE '2024-01-01' AS since FROM embeddings WHERE label < 4), v AS (SELECT vec_id AS k, vec_id + 100000 AS to_ FROM embeddings WHERE label = 5)
SELECT i.k, CASE WHEN s.doc_id IS NULL THEN coalesce(m.since, DATE '2024-06-01') END AS since, CASE WHEN s.doc_id IS NULL THEN to_ END AS moved_to, CASE WHEN s.doc_id IS NULL AND m.k IS NOT NULL THEN 'still' WHEN s.doc_id IS NULL THEN 'newly' ELSE 'again found' END AS event
FROM i LEFT JOIN s ON s.doc_id = i.k LEFT JOIN m ON m.k = i.k LEFT JOIN v ON v.k = i.k WHERE s.doc_id IS NULL OR m.k IS NOT NULL""")
def missing_marks(t: Tables) -> DataFrame:
    """Items newly, still and no longer missing, since when, and where they moved."""
    items = t.embeddings.select(F.col("vec_id").alias("k"), "label")
    marks = items.where("label < 4").select("k", F.lit("2024-01-01").cast("date").alias("since"))
    moves = items.where("label = 5").select("k", (F.col("k") + 100000).alias("to"))
    seen = t.documents.where("lang <> 'fr'").select(F.col("doc_id").alias("k"))
    return I.missing_marks(items, seen, marks, moves, "k", F.lit("2024-06-01").cast("date"))


@query("""WITH c AS (SELECT doc_id AS k, CASE WHEN toxic = 0 THEN quality END AS result FROM labels) SELECT DISTINCT d.doc_id AS k, CASE WHEN c.k IS NULL THEN 'miss' WHEN result IS NULL THEN 'negative' ELSE 'hit' END AS answer FROM documents d LEFT JOIN c ON c.k = d.doc_id""")
def cache_answers(t: Tables) -> DataFrame:
    """Hits, negative hits and misses of a keyed cache."""
    cache = t.labels.select(F.col("doc_id").alias("k"), F.when(F.col("toxic") == 0, F.col("quality")).alias("result"))
    return I.looked_up(t.documents.select(F.col("doc_id").alias("k")), cache, "k")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND ts < TIMESTAMP '2024-01-03'")
def cache_prune(t: Tables) -> DataFrame:
    """Cache entries that nothing links to and nobody used lately."""
    linked = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return I.expired(t.events, linked, "user_id", "ts", F.lit("2024-01-03").cast("timestamp_ntz")).select("event_id")


@query("""WITH w AS (SELECT doc_id FROM documents), c AS (SELECT DISTINCT 'labels' AS provider, doc_id FROM labels UNION SELECT 'vectors', vec_id FROM embeddings UNION SELECT 'pages', page_id FROM pages), n AS (SELECT count(*) AS whole FROM w),
p AS (SELECT unnest(['labels', 'vectors', 'pages', 'none']) AS provider), g AS (SELECT c.provider, count(w.doc_id) AS has, count(*) - count(w.doc_id) AS gone FROM c LEFT JOIN w USING (doc_id) GROUP BY 1),
r AS (SELECT provider, whole - coalesce(has, 0) AS todo, coalesce(gone, 0) AS gone, whole FROM p LEFT JOIN g USING (provider), n)
SELECT provider, CASE WHEN todo > 0.5 * whole THEN 'rebuild' WHEN todo > 0 OR gone > 0 THEN 'update' ELSE 'current' END AS action, todo, gone FROM r""")
def provider_freshness(t: Tables) -> DataFrame:
    """Which providers are rebuilt, which updated."""
    of = lambda df, name, key: df.select(F.lit(name).alias("provider"), F.col(key).alias("doc_id"))
    covered = of(t.labels, "labels", "doc_id").unionByName(of(t.embeddings, "vectors", "vec_id")).unionByName(of(t.pages, "pages", "page_id"))
    names = t.spark.createDataFrame([(n,) for n in ("labels", "vectors", "pages", "none")], "provider string")
    return I.freshness(t.documents.select("doc_id"), names, covered, "doc_id")


@query("""WITH s AS (SELECT doc_id AS k, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS verdict FROM labels), l AS (SELECT * FROM s WHERE k NOT IN (SELECT vec_id FROM embeddings WHERE label = 2)),
m AS (SELECT CASE WHEN k % 10 = 0 THEN k + 1 ELSE k END AS k, verdict, k % 10 = 0 AS moved FROM l), o AS (SELECT k, arg_min(verdict, (moved, verdict)) AS verdict, CASE WHEN bool_and(moved) THEN 'moved' ELSE 'kept' END AS origin FROM m GROUP BY k)
SELECT * FROM o UNION ALL SELECT DISTINCT doc_id, 'misfiled', 'detected' FROM documents WHERE n_chars % 100 > 90 AND doc_id NOT IN (SELECT k FROM o)""")
def ratings_after(t: Tables) -> DataFrame:
    """The ratings once some are cleared, some moved with their files, and wide misfiles recorded."""
    store = t.labels.select(F.col("doc_id").alias("k"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    cleared = t.embeddings.where("label = 2").select(F.col("vec_id").alias("k"))
    moved = store.where("k % 10 = 0").select("k", (F.col("k") + 1).alias("to"))
    found = t.documents.select(F.col("doc_id").alias("k"), (F.col("n_chars") % 100 - 50).alias("margin"))
    return I.ratings_after(store, cleared, moved, found, "k", 40)


@query("""WITH b AS (SELECT p_partkey AS k, md5(p_name || p_size) AS digest, p_brand || '/' || p_retailprice AS path FROM part), l AS (SELECT CASE WHEN k % 7 = 0 THEN k + 1000000 ELSE k END AS k, CASE WHEN k % 14 = 0 THEN NULL ELSE digest END AS digest, path FROM b), n AS (SELECT k, digest, path FROM b),
g AS (SELECT * FROM l WHERE k NOT IN (SELECT k FROM n)), w AS (SELECT * FROM n WHERE k NOT IN (SELECT k FROM l)),
m1 AS (SELECT a.k AS old, b.k AS new FROM (SELECT digest, min(k) AS k FROM g WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) = 1) a JOIN (SELECT digest, min(k) AS k FROM w GROUP BY digest HAVING count(*) = 1) b USING (digest)),
g2 AS (SELECT * FROM g WHERE k NOT IN (SELECT old FROM m1)), w2 AS (SELECT * FROM w WHERE k NOT IN (SELECT new FROM m1)),
m2 AS (SELECT a.k AS old, b.k AS new FROM (SELECT path, min(k) AS k FROM g2 GROUP BY path HAVING count(*) = 1) a JOIN (SELECT path, min(k) AS k FROM w2 GROUP BY path HAVING count(*) = 1) b USING (path))
SELECT old, new, 1 AS way FROM m1 UNION ALL SELECT old, new, 2 FROM m2""")
def lock_moves(t: Tables) -> DataFrame:
    """Locked files that moved: by content, then by path, one to one."""
    base = t.part.select(F.col("p_partkey").alias("k"), F.md5(F.concat("p_name", F.col("p_size").cast("string"))).alias("digest"), F.concat("p_brand", F.lit("/"), F.col("p_retailprice").cast("string")).alias("path"))
    locked = base.select(F.when(F.col("k") % 7 == 0, F.col("k") + 1000000).otherwise(F.col("k")).alias("k"), F.when(F.col("k") % 14 != 0, F.col("digest")).alias("digest"), "path")
    return I.followed(locked, base, "k", [["digest"], ["path"]])


@query("""WITH b AS (SELECT *, year(o_orderdate) AS build FROM orders) SELECT o_orderpriority AS family, o_orderkey AS source, CAST(build AS INTEGER) AS build FROM b WHERE build = (SELECT max(build) FROM b WHERE o_orderstatus = 'F')""")
def latest_build(t: Tables) -> DataFrame:
    """The families and sources of the latest archived build."""
    rows = t.orders.withColumn("build", F.year("o_orderdate"))
    last = rows.where("o_orderstatus = 'F'").agg(F.max("build").alias("build"))
    return rows.join(F.broadcast(last), "build").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("source"), "build")  # one row


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS version, count(*) AS files, count(DISTINCT o_orderpriority) AS families FROM orders GROUP BY 1")
def release_list(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("version")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("o_orderpriority").alias("families"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS x63 FROM v""")
def embeddings_by_id(t: Tables) -> DataFrame:
    """Unit vectors of the ids asked for; ids without one are absent."""
    some = t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return some.select("vec_id", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[63], 6).alias("x63"))


@query("""SELECT label, count(*) AS n, round(sum(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS sum0 FROM embeddings GROUP BY label""")
def vector_index(t: Tables) -> DataFrame:
    """The unit vectors written as an index and read again."""
    index = written(t.embeddings.select("vec_id", "label", V.unit(F.col("embedding")).alias("v")), "vector_index")
    return index.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v")[0]), 5).alias("sum0"))


@query("""SELECT CAST(id AS BIGINT) AS id, ['kick', 'snare', 'hat', 'pad'][id % 4 + 1] AS kind, 'pack' || chr(CAST(65 + id // 70 AS INTEGER)) AS pack, CASE WHEN id % 9 <> 0 THEN CAST(60 + (id * 37) % 140 AS INTEGER) END AS bpm, id % 71 = 0 AS defect FROM range(280) r(id)""")
def synthetic_items(t: Tables) -> DataFrame:
    """A made library of 280 items: every kind in every pack, some without a tempo, some defective."""
    i = F.col("id")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("kick", "snare", "hat", "pad"))), (i % 4 + 1).cast("int"))
    pack = F.concat(F.lit("pack"), F.char(65 + F.floor(i / 70)))
    return t.spark.range(280).select("id", kind.alias("kind"), pack.alias("pack"), F.when(i % 9 != 0, (60 + (i * 37) % 140).cast("int")).alias("bpm"), (i % 71 == 0).alias("defect"))


@query("""SELECT doc_id FROM (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def pending_union(t: Tables) -> DataFrame:
    """Ids of either table, once, less those that are current."""
    either = t.labels.select("doc_id").union(t.embeddings.select("vec_id")).distinct()
    return either.join(t.documents.where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT d.doc_id, d.lang, e.label AS loop FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def current_labels(t: Tables) -> DataFrame:
    """Labels of the marker's version, and the loop score where there is one."""
    marked = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id")
    return marked.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("loop")), "doc_id", "left").select("doc_id", "lang", "loop")


@query("""WITH c AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 47) SELECT p_partkey, p_brand, p_size AS root FROM part WHERE p_brand IN (SELECT p_brand FROM c)""")
def folder_roots(t: Tables) -> DataFrame:
    """All roots of the files in the folders of a candidate set."""
    return t.part.join(t.part.where("p_size > 47").select("p_brand"), "p_brand", "left_semi").select("p_partkey", "p_brand", F.col("p_size").alias("root"))


@query("SELECT event_id, c_custkey AS item FROM events LEFT JOIN customer ON c_custkey = user_id * 37")
def path_to_id(t: Tables) -> DataFrame:
    """A manifest's sources and the ids they have; null where the catalog has none."""
    return t.events.join(t.customer.select("c_custkey"), F.col("c_custkey") == F.col("user_id") * 37, "left").select("event_id", F.col("c_custkey").alias("item"))


@query("""WITH r AS (SELECT d.doc_id, d.source, md5(d.text) AS digest, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id), s AS (SELECT source, count(*) AS peers FROM documents GROUP BY source),
h AS (SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT r.doc_id, r.digest, r.n_chars / 1000.0 AS seconds, s.peers, coalesce(h.n, 1) > 1 AS shared FROM r LEFT JOIN s ON s.source = r.source LEFT JOIN h ON h.digest = r.digest""")
def rated_facts(t: Tables) -> DataFrame:
    """Of rated paths: content, length, how many files lie beside them, and whether the content lives elsewhere too."""
    docs = t.documents.select("doc_id", "source", F.md5("text").alias("digest"), (F.col("n_chars") / F.lit(1000.0)).alias("seconds"))
    peers = docs.groupBy("source").agg(F.count(F.lit(1)).alias("peers"))
    shared = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("_s"))
    rows = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").join(peers, "source", "left").join(shared, "digest", "left")
    return rows.select("doc_id", "digest", "seconds", "peers", F.coalesce("_s", F.lit(False)).alias("shared"))
