"""Releases, moves, copies, names and scores told whole, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import copies as C
from ..operators import diffs as D
from ..operators import labels as L
from ..operators import selection as S
from ..operators.ranks import ranked
from ..operators.written import written
from .curation_queries import BASE, NOW, two_releases
from .registry import Tables, query


@query(f"""WITH b AS {BASE}, n AS {NOW}, j AS (SELECT coalesce(b.k, n.k) AS k, b.k AS kb, n.k AS kn, b.digest AS was, n.digest AS now_is FROM b FULL JOIN n ON b.k = n.k),
c AS (SELECT CASE WHEN kb IS NULL THEN 'added' WHEN kn IS NULL THEN CASE WHEN was IN (SELECT now_is FROM j WHERE kb IS NULL AND now_is IS NOT NULL) THEN 'moved' ELSE 'removed' END WHEN was IS NULL OR now_is IS NULL THEN 'unverified' WHEN was <> now_is THEN 'changed' ELSE 'unchanged' END AS change FROM j)
SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'moved') AS moved, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unverified') AS unverified,
count(*) FILTER (change IN ('removed', 'changed', 'moved', 'unverified')) = 0 AS safe FROM c""")
def release_safety(t: Tables) -> DataFrame:
    """What a release would change, and whether it is safe: nothing that is out changes, moves, goes or can't be told."""
    plan = D.release_plan(*two_releases(t), "k", "digest")
    names = ("added", "removed", "moved", "changed", "unverified")
    counts = plan.agg(*(F.count_if(F.col("change") == n).alias(n) for n in names))
    return counts.withColumn("safe", sum((F.col(n) for n in names[1:]), F.lit(0)) == 0)


OLD_FAM = "SELECT p_partkey AS k, p_brand AS fam FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 7 = 0"
NEW_FAM = "SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN p_brand || '-big' WHEN p_size < 5 THEN 'small' WHEN p_brand = 'Brand#7' THEN 'Brand#8' ELSE p_brand END AS fam FROM part WHERE p_partkey % 7 <> 0"


@query(f"""WITH o AS ({OLD_FAM}), n AS ({NEW_FAM}), f AS (SELECT DISTINCT fam FROM o UNION SELECT DISTINCT fam FROM n), j AS (SELECT coalesce(o.k, n.k) AS k, o.fam AS was, n.fam AS now FROM o FULL JOIN n ON o.k = n.k)
SELECT f.fam, count(*) FILTER (j.was = f.fam) AS had, count(*) FILTER (j.now = f.fam) AS has, count(*) FILTER (j.was = f.fam AND j.now IS NOT NULL AND j.now <> f.fam) AS moved_out, count(*) FILTER (j.now = f.fam AND j.was IS NOT NULL AND j.was <> f.fam) AS moved_in,
count(*) FILTER (j.was = f.fam AND j.now IS NULL) AS removed, count(*) FILTER (j.now = f.fam AND j.was IS NULL) AS added, CASE WHEN count(*) FILTER (j.now = f.fam) = 0 THEN 'gone' WHEN count(*) FILTER (j.was = f.fam) = 0 THEN 'new' ELSE 'there' END AS status FROM f JOIN j ON j.was = f.fam OR j.now = f.fam GROUP BY f.fam""")
def family_moves(t: Tables) -> DataFrame:
    """Every family of either build: what it had and has, what moved in and out, what joined and left; gone families, too."""
    fam = F.when(F.col("p_size") > 40, F.concat("p_brand", F.lit("-big"))).when(F.col("p_size") < 5, "small").when(F.col("p_brand") == "Brand#7", "Brand#8").otherwise(F.col("p_brand"))
    k = F.col("p_partkey").alias("k")
    old = t.part.where("p_partkey % 5 <> 0 OR p_partkey % 7 = 0").select(k, F.col("p_brand").alias("was"))
    both = old.join(t.part.where("p_partkey % 7 <> 0").select(k, fam.alias("now")), "k", "full_outer")
    side = lambda name, other: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("fam"), F.lit(name).alias("side"), F.col(other).alias("other")))
    rows = both.select(F.explode(F.filter(F.array(side("was", "now"), side("now", "was")), lambda x: x.isNotNull())).alias("x")).select("x.*")
    was, now, elsewhere = F.col("side") == "was", F.col("side") == "now", F.col("other") != F.col("fam")
    counts = {"had": was, "has": now, "moved_out": was & elsewhere, "moved_in": now & elsewhere, "removed": was & F.col("other").isNull(), "added": now & F.col("other").isNull()}
    out = rows.groupBy("fam").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return out.withColumn("status", F.when(F.col("has") == 0, "gone").when(F.col("had") == 0, "new").otherwise("there"))


@query("""WITH g AS (SELECT p_partkey AS k, p_type, p_size, p_name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS k, p_type, p_size, p_name FROM part WHERE p_partkey % 2 = 1),
a AS (SELECT p_type, p_size, p_name, min(k) AS k FROM g GROUP BY ALL HAVING count(*) = 1), b AS (SELECT p_type, p_size, p_name, min(k) AS k FROM n GROUP BY ALL HAVING count(*) = 1), m AS (SELECT a.k AS old, b.k AS new FROM a JOIN b USING (p_type, p_size, p_name)),
c AS (SELECT p_type, p_size, min(k) AS k FROM g WHERE k NOT IN (SELECT old FROM m) GROUP BY ALL HAVING count(*) = 1), d AS (SELECT p_type, p_size, min(k) AS k FROM n WHERE k NOT IN (SELECT new FROM m) GROUP BY ALL HAVING count(*) = 1)
SELECT old, new, 1 AS way FROM m UNION ALL SELECT c.k, d.k, 2 FROM c JOIN d USING (p_type, p_size)""")
def moves_by_name(t: Tables) -> DataFrame:
    """Moves one to one: by content and name, then by content alone."""
    from ..operators import ingest as I

    rows = t.part.select(F.col("p_partkey").alias("k"), "p_type", "p_size", "p_name")
    return I.followed(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), "k", [["p_type", "p_size", "p_name"], ["p_type", "p_size"]])


@query("""WITH r AS (SELECT d.doc_id, source, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT coalesce(lang, 'all') AS category, count(quality) AS rated, count(*) FILTER (quality = 1 AND toxic = 0) AS kept, count(*) FILTER (toxic = 1) AS dropped, count(*) FILTER (quality = 0 AND toxic = 0) AS misfiled,
count(*) FILTER (quality = 1 AND toxic = 0 AND source = 'src0') AS lost, count(*) FILTER (toxic = 1 AND source <> 'src0') AS back, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(CAST(count(quality) AS DOUBLE), 0), 3) AS keep_rate FROM r GROUP BY ROLLUP (lang)""")
def scorecard_whole(t: Tables) -> DataFrame:
    """Ratings by category: rated, kept, dropped, misfiled, keeps that are lost, drops that are back; and in all."""
    rows = t.documents.select("doc_id", "source", F.col("lang").alias("category")).join(t.labels, "doc_id", "left")
    here, toxic = F.col("source") != "src0", F.col("toxic") == 1
    keep = (F.col("quality") == 1) & (F.col("toxic") == 0)
    found = rows.rollup("category").agg(F.count("quality").alias("rated"), F.count_if(keep).alias("kept"), F.count_if(toxic).alias("dropped"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("misfiled"), F.count_if(keep & ~here).alias("lost"), F.count_if(toxic & here).alias("back"))
    return found.withColumns({"category": F.coalesce("category", F.lit("all")), "keep_rate": F.round(F.col("kept") / F.nullif(F.col("rated"), F.lit(0)), 3)})


@query("""WITH p AS (SELECT vec_id, CAST(label AS INTEGER) % 3 AS truth, CASE WHEN embedding[1] > 0.1 THEN 0 WHEN embedding[2] > 0 THEN 1 ELSE 2 END AS said FROM embeddings)
SELECT truth, said, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY said) AS DOUBLE), 6) AS prec, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY truth) AS DOUBLE), 6) AS recall FROM p GROUP BY truth, said""")
def confusion_table(t: Tables) -> DataFrame:
    """Truth against prediction: counts, and each cell's share of its column and row."""
    said = F.when(F.col("embedding")[0] > F.lit(0.1), 0).when(F.col("embedding")[1] > 0, 1).otherwise(2)
    cells = t.embeddings.select((F.col("label").cast("int") % 3).alias("truth"), said.alias("said")).groupBy("truth", "said").agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(c)), 6)
    return cells.withColumns({"prec": share("said"), "recall": share("truth")})


@query("""SELECT d.doc_id, coalesce(l.quality, CAST(CASE WHEN e.label < 5 THEN 1 WHEN e.label >= 5 THEN 0 END AS INTEGER), CASE WHEN n_chars > 1000 THEN 1 END) AS quality, CASE WHEN l.quality IS NOT NULL THEN 'rated' WHEN e.label IS NOT NULL THEN 'sound' WHEN n_chars > 1000 THEN 'length' END AS provider
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def coalesced_fields(t: Tables) -> DataFrame:
    """A field by the first of several classifiers that has it, and which one."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    sound = F.when(F.col("label") < 5, 1).when(F.col("label") >= 5, 0)
    length = F.when(F.col("n_chars") > 1000, 1)
    who = F.when(F.col("quality").isNotNull(), "rated").when(sound.isNotNull(), "sound").when(length.isNotNull(), "length")
    return rows.select("doc_id", F.coalesce("quality", sound, length).alias("quality"), who.alias("provider"))


@query("""WITH l AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label, unnest(range(len(string_split(p_name, ' ')))) AS rank FROM part), m AS (SELECT * FROM (VALUES ('red', 'warm'), ('hot', 'warm'), ('ring', 'metal'), ('bolt', 'metal')) m(label, canonical))
SELECT p_partkey, 'name' AS provider, 'raw' AS kind, label, CAST(rank AS BIGINT) AS rank FROM l UNION ALL SELECT p_partkey, 'name', 'canonical', canonical, CAST(min(rank) AS BIGINT) FROM l JOIN m USING (label) GROUP BY p_partkey, canonical""")
def provider_rebuild(t: Tables) -> DataFrame:
    """A provider's rows written anew: raw labels with their ranks, and the canonical ones."""
    raw = L.exploded(t.part.withColumn("words", F.split("p_name", " ")), "p_partkey", "words", "name", "raw")
    mapping = t.spark.createDataFrame([("red", "warm"), ("hot", "warm"), ("ring", "metal"), ("bolt", "metal")], "label string, canonical string")
    canon = L.canonical(raw, F.broadcast(mapping), "p_partkey").select("p_partkey", F.lit("name").alias("provider"), F.lit("canonical").alias("kind"), F.col("canonical").alias("label"), "rank")  # a vocabulary
    return written(raw.select("p_partkey", "provider", "kind", "label", "rank").unionByName(canon).withColumn("rank", F.col("rank").cast("long")), "provider")


@query("""WITH r AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS version, o_orderpriority AS category, 'order/' || o_custkey AS src FROM orders WHERE year(o_orderdate) = 1999) SELECT version, category, src, o_orderkey, c_custkey AS item FROM r LEFT JOIN customer ON src = 'order/' || c_custkey AND c_acctbal > 0""")
def release_record(t: Tables) -> DataFrame:
    """A release's rows with the ids of their sources, null where the catalog has none."""
    rows = t.orders.where(F.year("o_orderdate") == 1999).select("o_orderkey", F.year("o_orderdate").alias("version"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("order/"), F.col("o_custkey").cast("string")).alias("src"))
    ids = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("order/"), F.col("c_custkey").cast("string")).alias("src"), F.col("c_custkey").alias("item"))
    return rows.join(ids, "src", "left").select("version", "category", "src", "o_orderkey", "item")


@query("""WITH g AS (SELECT doc_id, lang, md5(text) AS digest, CAST(n_chars < 200 AS INT) + CAST(source = 'src1' AS INT) + CAST(coalesce(quality = 0, false) AS INT) AS shut, n_chars FROM (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)), k AS (SELECT lang, count(*) AS kept FROM g WHERE shut = 0 GROUP BY lang),
c AS (SELECT * FROM g WHERE shut = 1 AND digest NOT IN (SELECT digest FROM g WHERE shut = 0)), f AS (SELECT *, row_number() OVER (PARTITION BY lang, digest ORDER BY n_chars DESC, doc_id) AS r FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM f WHERE r = 1)
SELECT doc_id, q.lang FROM q LEFT JOIN k ON k.lang = q.lang WHERE place <= 200 - coalesce(kept, 0)""")
def readmitted_once(t: Tables) -> DataFrame:
    """Rows that one gate alone shut out return until their category has its floor, best first, no copy of what is there."""
    rows = t.documents.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest")).join(t.labels, "doc_id", "left")
    gates = ((F.col("n_chars") < 200), (F.col("source") == "src1"), F.coalesce(F.col("quality") == 0, F.lit(False)))
    rows = rows.withColumn("shut", sum((g.cast("int") for g in gates), F.lit(0)))
    kept = rows.where("shut = 0")
    able = rows.where("shut = 1").join(kept.select("digest"), "digest", "left_anti")
    one = C.keepers(able, ["lang", "digest"], [F.desc("n_chars"), F.asc("doc_id")]).where("place = 1").drop("place")
    places = ranked(one, "lang", [F.desc("n_chars"), F.col("doc_id")], "place").join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
    return places.where(F.col("place") <= 200 - F.coalesce("kept", F.lit(0))).select("doc_id", "lang")


@query("""WITH d AS (SELECT md5(text) AS g, doc_id, n_chars, quality, source FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT g, max(n_chars) AS longest FROM d GROUP BY g HAVING count(*) > 1),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.g ORDER BY n_chars >= 0.95 * longest DESC, source IN ('src0', 'src1') DESC, coalesce(quality, -1) DESC, doc_id) AS r FROM d JOIN t ON t.g = d.g) SELECT g, doc_id AS winner FROM r WHERE r = 1""")
def copy_winner(t: Tables) -> DataFrame:
    """Of copies, the one that stays: among the longest (within a twentieth), pinned, rated, of the least id."""
    rows = t.documents.select("doc_id", "n_chars", "source", F.md5("text").alias("g")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    tops = rows.groupBy("g").agg(F.max("n_chars").alias("longest"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    key = F.struct((F.col("n_chars") < F.lit(0.95) * F.col("longest")).alias("a"), (~F.col("source").isin("src0", "src1")).alias("b"), (-F.coalesce("quality", F.lit(-1))).alias("c"), "doc_id")
    return rows.join(tops, "g").groupBy("g").agg(F.min(key).alias("k")).select("g", F.col("k.doc_id").alias("winner"))


@query("""WITH n AS (SELECT p_partkey, lower(p_brand) AS folder, substr(lower(p_name), 1, 8) AS stem FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY p_partkey) AS r FROM n)
SELECT p_partkey, folder, CASE WHEN r = 1 THEN stem ELSE substr(stem, 1, 8 - length(CAST(r AS VARCHAR)) - 1) || '_' || r END AS name FROM r""")
def limited_names(t: Tables) -> DataFrame:
    """Names of a limited length, numbered where they meet: the number counts into the limit."""
    rows = t.part.select("p_partkey", F.lower("p_brand").alias("folder"), F.substring(F.lower("p_name"), 1, 8).alias("stem"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("folder", "stem").orderBy("p_partkey")).cast("string"))
    short = F.concat(F.substring(F.col("stem"), F.lit(1), 7 - F.length("r")), F.lit("_"), F.col("r"))
    return rows.select("p_partkey", "folder", F.when(F.col("r") == "1", F.col("stem")).otherwise(short).alias("name"))


@query("""WITH k AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS roles, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '5-LOW') AND count(DISTINCT o_orderpriority) >= 4),
r AS (SELECT *, row_number() OVER (ORDER BY roles DESC, best DESC, o_custkey) AS place FROM k), p AS (SELECT r.o_custkey, place, o_orderpriority AS role, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS pick FROM r JOIN orders USING (o_custkey) WHERE place <= 20 GROUP BY ALL) SELECT * FROM p""")
def kits_picked(t: Tables) -> DataFrame:
    """The twenty best kits (most roles, then the dearest), and the pick for each of their roles."""
    role = F.col("o_orderpriority")
    kits = t.orders.groupBy("o_custkey").agg(F.count_distinct(role).alias("roles"), F.max("o_totalprice").alias("best"), F.bool_or(role == "1-URGENT").alias("a"), F.bool_or(role == "5-LOW").alias("b")).where("a AND b AND roles >= 4")
    top = kits.orderBy(F.desc("roles"), F.desc("best"), "o_custkey").limit(20)  # a report of twenty
    top = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("roles"), F.desc("best"), "o_custkey")).cast("long")).select("o_custkey", "place")
    pick = F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("pick")
    return t.orders.join(F.broadcast(top), "o_custkey").groupBy("o_custkey", "place", role.alias("role")).agg(pick)


LIMITS_SQL = "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(DISTINCT md5(text)) AS texts, count(*) FILTER (n_chars < 20) AS tiny FROM documents GROUP BY source"


@query(f"""WITH c AS ({LIMITS_SQL}) SELECT source, 'budget' AS check_name, 'FAIL' AS level FROM c WHERE n > 52 UNION ALL SELECT source, 'floor', 'FAIL' FROM c WHERE n < 10 UNION ALL SELECT source, 'share', 'WARN' FROM c WHERE en > 0.6 * n UNION ALL SELECT source, 'copies', 'FAIL' FROM c WHERE texts < n UNION ALL SELECT source, 'hygiene', 'WARN' FROM c WHERE tiny > 0""")
def validate_whole(t: Tables) -> DataFrame:
    """Budget, floor, share, copies and hygiene of each category; what fails or warns."""
    rows = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_distinct(F.md5("text")).alias("texts"), F.count_if(F.col("n_chars") < 20).alias("tiny"))
    rules = [("budget", "FAIL", F.col("n") > 52), ("floor", "FAIL", F.col("n") < 10), ("share", "WARN", F.col("en") > F.lit(0.6) * F.col("n")), ("copies", "FAIL", F.col("texts") < F.col("n")), ("hygiene", "WARN", F.col("tiny") > 0)]
    return rows.select("source", F.explode(F.filter(F.array(*(F.when(bad, F.struct(F.lit(n).alias("check_name"), F.lit(level).alias("level"))) for n, level, bad in rules)), lambda x: x.isNotNull())).alias("c")).select("source", "c.*")


@query("""WITH g AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN o_totalprice IS NULL OR o_totalprice < 2000 THEN 'quality' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unnamed' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'old' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500) THEN 'dropped' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'missing' WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' WHEN o_totalprice > 400000 THEN 'too large' END AS reason FROM orders)
SELECT reason, count(*) AS n, min(o_orderkey) AS first FROM g GROUP BY reason""")
def gates_in_order(t: Tables) -> DataFrame:
    """Eight gates, the first that shuts is the reason; how many each took, and what is kept (null)."""
    known = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal"), F.lit(True).alias("there"))
    rows = t.orders.join(known, "o_custkey", "left")
    gates = [
        ("status", F.col("o_orderstatus") == "P"),
        ("quality", F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 2000)),
        ("unnamed", F.col("o_orderpriority") == "4-NOT SPECIFIED"),
        ("old", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")),
        ("dropped", F.col("c_acctbal") < -500),
        ("missing", F.col("there").isNull()),
        ("weekend", F.dayofweek("o_orderdate").isin(1, 7)),
        ("too large", F.col("o_totalprice") > 400000),
    ]
    return S.gated(rows, *gates).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
