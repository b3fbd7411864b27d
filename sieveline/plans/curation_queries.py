"""Copies, diffs, gates, caps, vectors, reports and sessions over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import copies as C
from ..operators import diffs as D
from ..operators import nearness as R
from ..operators import selection as S
from ..operators import trees as E
from ..operators.written import written
from ..streaming import sessions
from .registry import Tables, query

LIST_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def dup_groups_having(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""SELECT doc_id, place FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, -1) DESC, n_chars DESC, d.doc_id) AS place,
count(*) OVER (PARTITION BY md5(text)) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE n > 1""")
def dup_keeper_rank(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.md5("text").alias("digest")).join(t.labels, "doc_id", "left")
    rows = rows.join(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digest", "left_semi")
    order = [F.coalesce("quality", F.lit(-1)).desc(), F.desc("n_chars"), F.asc("doc_id")]
    return C.keepers(rows, ["digest"], order).select("doc_id", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT doc_id, source, n_chars, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS stem, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY source, stem ORDER BY doc_id) AS q FROM a WHERE r = 1) SELECT doc_id FROM b WHERE q = 1""")
def first_seen_dedup(t: Tables) -> DataFrame:
    """Equal bytes, then equal words of one source: the first of each stays."""
    stem = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"), F.md5(F.concat_ws("|", "source", stem)).alias("content"))
    return C.first_seen(rows, [F.asc("doc_id")], "digest", "content").select("doc_id")


@query("""SELECT d.doc_id, CASE WHEN h.any_de THEN 'de' ELSE h.home END AS home FROM documents d JOIN
(SELECT md5(text) AS digest, min_by(CASE WHEN doc_id % 9 = 0 THEN 'de' ELSE lang END, doc_id) AS home, bool_or(CASE WHEN doc_id % 9 = 0 THEN 'de' ELSE lang END = 'de') AS any_de FROM documents GROUP BY md5(text)) h ON h.digest = md5(d.text)""")
def twin_home_unify(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("digest"), F.when(F.col("doc_id") % 9 == 0, "de").otherwise(F.col("lang")).alias("home"))
    return C.unified(rows, "digest", "doc_id", "home", "de").select("doc_id", "home")


@query("""WITH o AS (SELECT md5(text) AS digest, n_chars, doc_id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT md5(text) AS digest, n_chars, doc_id FROM documents WHERE doc_id % 2 = 1)
SELECT a.k AS old, b.k AS new FROM (SELECT digest, n_chars, min(doc_id) AS k FROM o GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT digest, n_chars, min(doc_id) AS k FROM n GROUP BY 1, 2 HAVING count(*) = 1) b USING (digest, n_chars)""")
def move_match_1to1(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.md5("text").alias("digest"))
    return C.moves(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", ["digest", "n_chars"])


@query("SELECT doc_id FROM documents WHERE source IN ('src0', 'src1') AND md5(text) IN (SELECT md5(text) FROM documents WHERE source NOT IN ('src0', 'src1'))")
def mirror_copies(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.md5("text").alias("digest"))
    return C.mirrored(rows, "digest", F.col("source").isin("src0", "src1")).select("doc_id")


BASE = "(SELECT o_orderkey AS k, md5(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS digest FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0)"
NOW = "(SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN md5('x') ELSE md5(o_orderstatus || CAST(o_custkey AS VARCHAR)) END AS digest FROM orders WHERE o_orderkey % 7 <> 0)"


def two_releases(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, digest = F.col("o_orderkey"), F.md5(F.concat("o_orderstatus", F.col("o_custkey").cast("string")))
    base = t.orders.where("o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0").select(k.alias("k"), digest.alias("digest"))
    now = t.orders.where("o_orderkey % 7 <> 0").select(F.when(k % 17 == 0, k + 10000000).otherwise(k).alias("k"), F.when(k % 19 == 0, None).when(k % 13 == 0, F.md5(F.lit("x"))).otherwise(digest).alias("digest"))
    return base, now


@query(f"""WITH b AS {BASE}, n AS {NOW}, j AS (SELECT coalesce(b.k, n.k) AS k, b.k AS kb, n.k AS kn, b.digest AS was, n.digest AS now_is FROM b FULL JOIN n ON b.k = n.k)
SELECT k, CASE WHEN kb IS NULL THEN 'added' WHEN kn IS NULL THEN CASE WHEN was IN (SELECT now_is FROM j WHERE kb IS NULL AND now_is IS NOT NULL) THEN 'moved' ELSE 'removed' END
WHEN was IS NULL OR now_is IS NULL THEN 'unverified' WHEN was <> now_is THEN 'changed' ELSE 'unchanged' END AS change FROM j""")
def release_plan(t: Tables) -> DataFrame:
    return D.release_plan(*two_releases(t), "k", "digest")


@query(f"""WITH b AS {BASE}, n AS {NOW} SELECT coalesce(b.k, n.k) AS k, CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'removed' WHEN b.digest IS DISTINCT FROM n.digest THEN 'changed' WHEN b.digest IS NULL THEN 'retry' ELSE 'unchanged' END AS action FROM b FULL JOIN n ON b.k = n.k""")
def incremental_sync(t: Tables) -> DataFrame:
    return D.sync_actions(*two_releases(t), "k", "digest", "digest")


@query("""WITH o AS (SELECT p_partkey, p_brand AS fam FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 7 = 0), n AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand || '-big' WHEN p_size < 5 THEN 'small' ELSE p_brand END AS fam FROM part WHERE p_partkey % 7 <> 0),
sizes AS (SELECT fam, count(*) AS size FROM n GROUP BY fam), x AS (SELECT n.fam, o.fam AS was, count(*) AS c FROM n JOIN o USING (p_partkey) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY c DESC, was) AS r FROM x) WHERE r = 1)
SELECT s.fam, CASE WHEN coalesce(c / size, 0) >= 0.5 THEN was END AS matched, coalesce(CAST(c AS DOUBLE) / size, 0.0) AS overlap, CASE WHEN coalesce(c / size, 0) < 0.5 THEN 'new' WHEN was = s.fam THEN 'same' ELSE 'renamed' END AS status FROM sizes s LEFT JOIN best b ON b.fam = s.fam""")
def family_overlap_diff(t: Tables) -> DataFrame:
    fam = F.when(F.col("p_size") > 40, F.concat("p_brand", F.lit("-big"))).when(F.col("p_size") < 5, "small").otherwise(F.col("p_brand"))
    old = t.part.where("p_partkey % 5 <> 0 OR p_partkey % 7 = 0").select("p_partkey", F.col("p_brand").alias("fam"))
    return D.families(old, t.part.where("p_partkey % 7 <> 0").select("p_partkey", fam.alias("fam")), "fam", "p_partkey")


@query("""WITH b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 0),
j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS k, a.p_partkey AS ka, b.p_partkey AS kb, a.p_size AS sa, b.p_size AS sb FROM part a FULL JOIN b ON a.p_partkey = b.p_partkey)
SELECT k AS p_partkey, 'row' AS field, 'there' AS was, NULL AS now FROM j WHERE kb IS NULL UNION ALL SELECT k, 'p_size', CAST(sa AS VARCHAR), CAST(sb AS VARCHAR) FROM j WHERE kb IS NOT NULL AND sa IS DISTINCT FROM sb""")
def snapshot_compare(t: Tables) -> DataFrame:
    other = t.part.where("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return D.field_changes(t.part, other, "p_partkey", ["p_brand", "p_size"])


@query("""WITH s AS (SELECT user_id, max(event_type) AS v FROM events WHERE event_id % 10 = 0 GROUP BY user_id), f AS (SELECT * FROM events WHERE event_id % 10 <> 0),
r AS (SELECT f.user_id, f.event_type AS v, row_number() OVER (PARTITION BY f.user_id ORDER BY CASE WHEN s.v IS NOT DISTINCT FROM f.event_type THEN 1 ELSE 0 END, CASE f.event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END, f.ts DESC, f.event_id DESC) AS n FROM f LEFT JOIN s ON s.user_id = f.user_id)
SELECT coalesce(r.user_id, s.user_id) AS user_id, coalesce(r.v, s.v) AS verdict FROM (SELECT * FROM r WHERE n = 1) r FULL JOIN s ON s.user_id = r.user_id""")
def rating_merge(t: Tables) -> DataFrame:
    stored = t.events.where("event_id % 10 = 0").groupBy("user_id").agg(F.max("event_type").alias("verdict"))
    found = t.events.where("event_id % 10 <> 0").select("user_id", F.col("event_type").alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return D.merged_ratings(stored, found, "user_id", "verdict", ["error", "purchase", "view", "signup", "click"])


@query("""SELECT coalesce(source, 'all') AS source, count(*) AS files, count(quality) AS rated, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS keeps, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS drops,
round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / CAST(nullif(count(quality), 0) AS DOUBLE), 6) AS keep_rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ROLLUP (source)""")
def scorecard(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").rollup("source")
    found = rows.agg(F.count(F.lit(1)).alias("files"), F.count("quality").alias("rated"), F.count_if(F.col("quality") == 1).alias("keeps"), F.count_if(F.col("toxic") == 1).alias("drops"))
    return found.select(F.coalesce("source", F.lit("all")).alias("source"), "files", "rated", "keeps", "drops", F.when(F.col("rated") > 0, F.round(F.col("keeps") / F.col("rated"), 6)).alias("keep_rate"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS chars, round(avg(quality), 6) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def category_stats(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"), F.round(F.avg("quality"), 6).alias("quality"))


@query("SELECT count(*) AS items, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 6) AS share, max(d.doc_id) AS newest FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def coverage_status(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count("quality").alias("covered"), F.round(F.lit(100.0) * F.count("quality") / F.count(F.lit(1)), 6).alias("share"), F.max("doc_id").alias("newest"))


@query("""WITH a AS (SELECT p_partkey, string_split(p_type, ' ')[1] AS x, CASE WHEN p_size % 3 = 0 THEN string_split(p_type, ' ')[1] ELSE p_brand END AS y FROM part)
SELECT x, y, n FROM (SELECT x, y, count(*) AS n, row_number() OVER (PARTITION BY x ORDER BY count(*) DESC, y) AS r FROM a GROUP BY x, y) WHERE r <= 3""")
def provider_agreement(t: Tables) -> DataFrame:
    """The most frequent readings of a second source for each reading of the first."""
    first = F.split("p_type", " ")[0]
    pairs = t.part.select(first.alias("x"), F.when(F.col("p_size") % 3 == 0, first).otherwise(F.col("p_brand")).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))).where("r <= 3").drop("r")


@query("""SELECT kind, CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS compared, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS found FROM
(SELECT 'quality' AS kind, quality AS a, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS b FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT 'toxic', toxic, CASE WHEN d.doc_id % 2 = 0 THEN NULL WHEN contains(text, 'idiot') THEN 1 ELSE 0 END FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY kind""")
def disagreements(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    second = F.when(F.col("doc_id") % 2 != 0, F.when(F.col("text").contains("idiot"), 1).otherwise(0))
    pairs = F.array(F.struct(F.lit("quality").alias("kind"), F.col("quality").cast("int").alias("a"), (F.col("n_chars") > 2000).cast("int").alias("b")), F.struct(F.lit("toxic").alias("kind"), F.col("toxic").cast("int").alias("a"), second.alias("b")))
    each = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return each.groupBy("kind").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("found"))


GATES = "CASE WHEN n_chars < 100 THEN 'short' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END"


def gates(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")
    return S.gated(rows, ("short", F.col("n_chars") < 100), ("toxic", F.col("toxic") == 1), ("quality", F.col("quality") == 0), ("language", ~F.col("lang").isin("en", "de", "fr")))


@query(f"SELECT d.doc_id, {GATES} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def gate_reasons(t: Tables) -> DataFrame:
    return gates(t).select("doc_id", "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {GATES} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(t: Tables) -> DataFrame:
    return gates(t).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS (SELECT d.doc_id, n_chars, {GATES} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), k AS (SELECT count(*) AS c FROM g WHERE reason IS NULL)
SELECT doc_id FROM g WHERE reason IS NULL UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM g WHERE reason IS NOT NULL) WHERE r <= 900 - (SELECT c FROM k)""")
def readmit_to_floor(t: Tables) -> DataFrame:
    return S.readmitted(gates(t), "n_chars", "doc_id", 900).select("doc_id")


@query("""WITH g AS (SELECT lang, count(*) AS g FROM documents GROUP BY lang), w AS (SELECT sum(g) AS n, count(*) AS k, max(g) AS top FROM g)
SELECT g.lang, CASE WHEN k >= 3 AND top > 0.4 * n AND g > greatest(1, round(0.4 / 0.6 * (n - g))) THEN CAST(greatest(1, round(0.4 / 0.6 * (n - g))) AS BIGINT) ELSE g END AS n FROM g, w""")
def vendor_share_cap(t: Tables) -> DataFrame:
    kept = S.share_capped(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.4)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def group_cap(t: Tables) -> DataFrame:
    return S.group_capped(t.documents.select("doc_id", "source", "n_chars"), "source", 5, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_quantity < 10 AND top >= l_quantity + 30")
def soft_layers(t: Tables) -> DataFrame:
    return S.soft_layers(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", 10, 30).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey FROM orders JOIN (SELECT o_custkey, median(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING count(*) >= 3) USING (o_custkey) WHERE o_totalprice > 0 AND 20 * log10(o_totalprice / m) <= -6""")
def folder_median_gate(t: Tables) -> DataFrame:
    return S.quiet_members(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", 6.0).select("o_orderkey")


@query("""WITH s AS (SELECT p_brand, count(*) AS size FROM part GROUP BY p_brand), n AS (SELECT sum(size) AS total FROM s)
SELECT p_brand, size, CAST(least(least(40, size), greatest(least(10, size), round(500.0 * size / total))) AS BIGINT) AS share FROM s, n""")
def budget_proportional(t: Tables) -> DataFrame:
    return S.budgeted(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("size")), "p_brand", "size", 500, 10, 40)


@query("""WITH s AS (SELECT p_brand, count(*) AS size FROM part GROUP BY p_brand), n AS (SELECT sum(size) AS total FROM s),
b AS (SELECT p_brand, size, CAST(least(least(90, size), greatest(least(5, size), round(600.0 * size / total))) AS BIGINT) AS share FROM s, n), o AS (SELECT 600 - sum(share) AS gap FROM b),
u AS (SELECT p_brand, size, gap, unnest(CASE WHEN gap > 0 THEN range(size - least(90, size) + 1, size - share + 1) WHEN gap < 0 THEN range(least(5, size) + 1, share + 1) ELSE [] END) AS v FROM b, o),
k AS (SELECT p_brand, count(*) AS moved FROM (SELECT *, row_number() OVER (ORDER BY v DESC, size DESC, p_brand) AS r FROM u) WHERE r <= abs(gap) GROUP BY p_brand)
SELECT b.p_brand, size, CAST(share + coalesce(moved * sign(gap), 0) AS BIGINT) AS share FROM b CROSS JOIN o LEFT JOIN k ON k.p_brand = b.p_brand""")
def budget_met(t: Tables) -> DataFrame:
    """The budget filled by the largest gaps, or drained from the largest shares."""
    return S.apportioned(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("size")), "p_brand", "size", 600, 5, 90)


@query("""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label)
SELECT m.label, n, CAST(i AS INTEGER) AS i, round(m / l, 6) AS x FROM m JOIN s ON s.label = m.label""")
def centroid_by_label(t: Tables) -> DataFrame:
    return R.centroids(t.embeddings, "embedding", "label").select("label", "n", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), s AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label),
c AS (SELECT m.label, list(m / l ORDER BY i) AS v FROM m JOIN s ON s.label = m.label GROUP BY m.label), d AS (SELECT e.vec_id, e.label, c.label AS g, list_dot_product(e.embedding::DOUBLE[], c.v) AS s FROM embeddings e, c)
SELECT vec_id, label, round(max(CASE WHEN g = label THEN s END), 6) AS own_score, round(max(CASE WHEN g <> label THEN s END) - max(CASE WHEN g = label THEN s END), 6) AS margin FROM d GROUP BY vec_id, label""")
def misfile_margin(t: Tables) -> DataFrame:
    found = R.placed(t.embeddings, R.centroids(t.embeddings, "embedding", "label"), "embedding", "label", "vec_id")
    return found.select("vec_id", "label", F.round("own_score", 6).alias("own_score"), F.round("margin", 6).alias("margin"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({LIST_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {LIST_DOT} >= 0.25")
def near_dup_pairs(t: Tables) -> DataFrame:
    return R.close_pairs(t.embeddings, "embedding", "vec_id", "label", 0.25).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {LIST_DOT} >= 0.25),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, coalesce((SELECT list(a) FROM p WHERE p.b = vec_id), []) AS better FROM embeddings),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.r, CASE WHEN list_has_any(o.better, s.kept) THEN s.kept ELSE list_append(s.kept, o.vec_id) END FROM s JOIN o ON o.r = s.i + 1),
k AS (SELECT kept FROM s ORDER BY i DESC LIMIT 1)
SELECT vec_id, list_contains(kept, vec_id) AS kept, CASE WHEN NOT list_contains(kept, vec_id) THEN list_min(list_intersect(better, kept)) END AS partner FROM o, k""")
def near_dup_keepers(t: Tables) -> DataFrame:
    """Greedy pruning by rank."""
    pairs = R.close_pairs(t.embeddings, "embedding", "vec_id", "label", 0.25).select("a", "b")
    return C.pruned(t.embeddings.select("vec_id"), pairs, "vec_id", "vec_id", lambda df: written(df, "pruning"))


@query(f"""SELECT a, b, CAST(r AS INTEGER) AS place, round(s, 6) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {LIST_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {LIST_DOT} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE r <= 3""")
def nearest_k_per_drop(t: Tables) -> DataFrame:
    """The three nearest of the same group for each dropped item."""
    near = R.nearest_in_group(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "embedding", "vec_id", "label", 3)
    return near.select("a", "b", "place", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT p_brand, split_part(p_brand, '#', 1) AS g, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY p_brand)
SELECT p_brand, round((size - avg(size) OVER (PARTITION BY g)) / (stddev_pop(size) OVER (PARTITION BY g) + 1e-9), 6) AS z_size, round((price - avg(price) OVER (PARTITION BY g)) / (stddev_pop(price) OVER (PARTITION BY g) + 1e-9), 6) AS z_price FROM s""")
def zscore_traits(t: Tables) -> DataFrame:
    rows = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price")).withColumn("g", F.split("p_brand", "#")[0])
    return R.z_scores(rows, ["size", "price"], ["g"]).select("p_brand", F.round("z_size", 6).alias("z_size"), F.round("z_price", 6).alias("z_price"))


@query("""WITH RECURSIVE tree(id, parent, name) AS (SELECT 'r' || r_regionkey, NULL, r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
w(id, path, depth) AS (SELECT id, name, 1 FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, w.path || '/' || t.name, w.depth + 1 FROM tree t JOIN w ON t.parent = w.id) SELECT id, path, depth FROM w""")
def tree_paths(t: Tables) -> DataFrame:
    """Paths by parent pointers: three levels of nodes in one table."""
    node = lambda df, mark, key, up, name: df.select(F.concat(F.lit(mark), key).alias("id"), up.alias("parent"), F.col(name).alias("name"))
    nodes = node(t.region, "r", "r_regionkey", F.lit(None).cast("string"), "r_name")
    nodes = nodes.unionByName(node(t.nation, "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name"))
    nodes = nodes.unionByName(node(t.supplier, "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey"), "s_name"))
    return E.paths(nodes, "id", "parent", "name")


@query("""WITH k AS (SELECT p_brand, p_size, p_name, p_partkey FROM part WHERE p_type = 'PROMO'), a AS (SELECT p_brand, p_size, max(p_partkey) AS m FROM k GROUP BY ALL), b AS (SELECT p_brand, p_name, max(p_partkey) AS m FROM k GROUP BY ALL),
u AS (SELECT p_name, p_size, max(p_partkey) AS m FROM k GROUP BY ALL HAVING count(*) = 1) SELECT p.p_partkey, coalesce(a.m, b.m, u.m) AS matched, CASE WHEN a.m IS NOT NULL THEN 'path' WHEN b.m IS NOT NULL THEN 'folder and name' WHEN u.m IS NOT NULL THEN 'unambiguous' END AS method
FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand AND b.p_name = p.p_name LEFT JOIN u ON u.p_name = p.p_name AND u.p_size = p.p_size""")
def cascade_match(t: Tables) -> DataFrame:
    """The whole key first, then folder and name, then what is left of it where that is unambiguous; which one matched."""
    known = t.part.where("p_type = 'PROMO'")
    by = lambda name, *keys: known.groupBy(*keys).agg(F.max("p_partkey").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_name").join(by("a", "p_brand", "p_size"), ["p_brand", "p_size"], "left").join(by("b", "p_brand", "p_name"), ["p_brand", "p_name"], "left")
    rows = rows.join(by("u", "p_name", "p_size").where("n_u = 1"), ["p_name", "p_size"], "left")
    how = F.when(F.col("a").isNotNull(), "path").when(F.col("b").isNotNull(), "folder and name").when(F.col("u").isNotNull(), "unambiguous")
    return rows.select("p_partkey", F.coalesce("a", "b", "u").alias("matched"), how.alias("method"))


@query("""WITH p AS (SELECT quality AS y, (n_chars % 1000) / 1000.0 AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id), t AS (SELECT unnest([0.25, 0.5, 0.75]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS prec FROM p JOIN t ON p >= threshold GROUP BY threshold""")
def precision_by_threshold(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p")).join(t.labels, "doc_id")
    each = rows.select("quality", "p", F.explode(F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75)))).alias("threshold")).where("p >= threshold")
    return each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("hits"), F.round(F.sum("quality") / F.count(F.lit(1)), 6).alias("prec"))


@query("""WITH a AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS starts, max(ts) AS ends, count(*) AS n FROM b GROUP BY 1, 2""")
def gap_sessions(t: Tables) -> DataFrame:
    return sessions.gap_sessions(t.events, "user_id", "ts", 3600)


@query("""WITH c AS (SELECT source, count(*) AS n, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS share FROM documents GROUP BY source)
SELECT source, 'floor' AS check_name, 'FAIL' AS level FROM c WHERE n < 50 UNION ALL SELECT source, 'share', 'WARN' FROM c WHERE share > 0.6""")
def validate_shares(t: Tables) -> DataFrame:
    rows = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("lang") == "en") / F.count(F.lit(1))).alias("share"))
    checks = F.array(F.struct(F.lit("floor").alias("check_name"), F.lit("FAIL").alias("level"), (F.col("n") < 50).alias("bad")), F.struct(F.lit("share").alias("check_name"), F.lit("WARN").alias("level"), (F.col("share") > 0.6).alias("bad")))
    return rows.select("source", F.explode(checks).alias("c")).where("c.bad").select("source", "c.check_name", "c.level")


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS roles, count(*) AS n FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '5-LOW') AND count(DISTINCT o_orderpriority) >= 4""")
def kits_with_roles(t: Tables) -> DataFrame:
    """Groups that have the required roles and enough of them."""
    role = F.col("o_orderpriority")
    kits = t.orders.groupBy("o_custkey").agg(F.size(F.collect_set(role)).cast("long").alias("roles"), F.count(F.lit(1)).alias("n"), F.bool_or(role == "1-URGENT").alias("a"), F.bool_or(role == "5-LOW").alias("b"))
    return kits.where("a AND b AND roles >= 4").select("o_custkey", "roles", "n")


@query("""WITH s AS (SELECT source, count(*) AS n, sha1(source) AS h FROM documents GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM s)
SELECT source, before < 0.2 * total AS held FROM c""")
def holdout_packs(t: Tables) -> DataFrame:
    """Whole packs in the order of a hash until the share is reached; the window runs over one row for each pack."""
    packs = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    rows = packs.withColumns({"before": F.sum("n").over(w.orderBy(F.sha1("source")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(w)})
    return rows.select("source", (F.col("before") < 0.2 * F.col("total")).alias("held"))


@query("""SELECT p_partkey, lower(p_brand) AS folder, CASE WHEN r = 1 THEN lower(p_type) ELSE lower(p_type) || '_' || r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) AS r FROM part)""")
def unique_names(t: Tables) -> DataFrame:
    folder, name = F.lower("p_brand"), F.lower("p_type")
    r = F.row_number().over(Window.partitionBy(folder, name).orderBy("p_partkey"))
    rows = t.part.select("p_partkey", folder.alias("folder"), name.alias("name"), r.alias("r"))
    return rows.select("p_partkey", "folder", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("r").cast("string"))).alias("name"))


@query("""WITH v AS (SELECT doc_id, lang AS c, 1.0 AS s FROM documents UNION ALL SELECT doc_id, source, 0.5 FROM documents UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'src0' END, 1.0 FROM labels), x AS (SELECT doc_id, c, sum(s) AS s FROM v GROUP BY 1, 2)
SELECT doc_id, c AS home, s AS support FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, c DESC) AS r FROM x) WHERE r = 1""")
def support_votes_home(t: Tables) -> DataFrame:
    """Votes of several sources; the most support wins, a tie goes to the last name."""
    votes = t.documents.select("doc_id", F.explode(F.array(F.struct(F.col("lang").alias("c"), F.lit(1.0).alias("s")), F.struct(F.col("source").alias("c"), F.lit(0.5).alias("s")))).alias("v")).select("doc_id", "v.*")
    votes = votes.unionByName(t.labels.select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("src0").alias("c"), F.lit(1.0).alias("s")))
    rows = votes.groupBy("doc_id", "c").agg(F.sum("s").alias("s"))
    return rows.groupBy("doc_id").agg(F.max(F.struct("s", "c")).alias("m")).select("doc_id", F.col("m.c").alias("home"), F.col("m.s").alias("support"))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, source FROM documents), k AS (SELECT DISTINCT doc_id, source, w FROM m WHERE length(w) >= 6)
SELECT source, w, n FROM (SELECT source, w, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) AS r FROM k GROUP BY 1, 2) WHERE r <= 3""")
def phrase_support(t: Tables) -> DataFrame:
    """The words most members of a group have."""
    pairs = t.documents.select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w")).where(F.length("w") >= 6).dropDuplicates(["doc_id", "source", "w"])
    counts = pairs.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))).where("r <= 3").drop("r")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Ring%' OR contains(lower(p_type), 'promo') ORDER BY CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 ELSE 2 END, p_partkey LIMIT 25")
def text_search_sorted(t: Tables) -> DataFrame:
    rows = t.part.where(F.col("p_name").ilike("%Ring%") | F.lower("p_type").contains("promo"))
    return rows.orderBy(F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 20, 1).otherwise(2), "p_partkey").limit(25).select("p_partkey", "p_name")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 5 AS INTEGER) END AS rr FROM supplier""")
def round_robin_numbers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.lit("tom")).otherwise(F.concat(F.lit("Tom_RR"), (k % 5).cast("string")))
    return t.supplier.select("s_suppkey", N.round_robin(name)["number"].alias("rr"))


@query("""WITH a AS (SELECT user_id, max_by(value, (ts, event_id)) AS value, max(event_id) AS m FROM events GROUP BY user_id) SELECT user_id, value FROM a""")
def upsert_latest(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "value", F.struct("ts", "event_id").alias("version"))
    return sessions.upserted(e.where("version.event_id % 2 = 0"), e.where("version.event_id % 2 = 1"), "user_id", "version").select("user_id", "value")


@query("""SELECT o_orderkey, CAST(o_totalprice > 200000 AS INTEGER) AS kept, CASE WHEN f.c IS NULL THEN 'no customer' WHEN n.n_name IS NULL THEN 'no nation' ELSE 'ok' END AS place FROM orders o LEFT JOIN (SELECT c_custkey AS c, c_nationkey FROM customer WHERE c_acctbal > 0) f ON f.c = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = f.c_nationkey AND n.n_regionkey < 3""")
def explain_item(t: Tables) -> DataFrame:
    """Why an item is where it is: lookups by key, the first that fails names the reason."""
    owners = t.customer.where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    places = t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name")
    rows = t.orders.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("kept"), F.when(F.col("c_custkey").isNull(), "no customer").when(F.col("n_name").isNull(), "no nation").otherwise("ok").alias("place"))
