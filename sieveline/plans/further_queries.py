"""Chains, outcomes, fallbacks, shares and audits over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tempo as T
from ..functions import vectors as V
from ..operators import copies as C
from ..operators import diffs as D
from ..operators import nearness as R
from ..operators import trees as E
from ..operators.ranks import ranked
from ..operators.written import written
from .curation_queries import two_releases
from .registry import Tables, query
from .routing_queries import ANCHORS, PATH_SQL, anchors, path_of


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 > 0 AND p_partkey >= p_size THEN p_partkey - p_size % 4 END AS up FROM part), w AS (SELECT k, k AS root, 0 AS steps FROM p WHERE up IS NULL UNION ALL SELECT p.k, w.root, w.steps + 1 FROM p JOIN w ON p.up = w.k)
SELECT k AS p_partkey, root, CAST(steps AS BIGINT) AS steps FROM w""")
def keeper_chains(t: Tables) -> DataFrame:
    """Where each dropped copy's chain of keepers ends."""
    up = F.when((F.col("p_size") % 4 > 0) & (F.col("p_partkey") >= F.col("p_size")), F.col("p_partkey") - F.col("p_size") % 4)
    return E.roots(t.part.select("p_partkey", up.alias("up")), "p_partkey", "up")


@query("""WITH b AS (SELECT o_orderkey AS k, md5(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS digest FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0),
n AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN md5('x') ELSE md5(o_orderstatus || CAST(o_custkey AS VARCHAR)) END AS digest FROM orders WHERE o_orderkey % 7 <> 0),
g AS (SELECT digest FROM b WHERE k NOT IN (SELECT k FROM n) GROUP BY digest HAVING count(*) = 1), w AS (SELECT digest FROM n WHERE k NOT IN (SELECT k FROM b) AND digest IS NOT NULL GROUP BY digest HAVING count(*) = 1), m AS (SELECT digest FROM g JOIN w USING (digest)),
s AS (SELECT CASE WHEN b.k IS NULL AND n.digest IS NULL THEN 'unreadable' WHEN b.k IS NULL AND n.digest IN (SELECT digest FROM m) THEN 'moved' WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL AND b.digest IN (SELECT digest FROM m) THEN 'moved away' WHEN n.k IS NULL THEN 'missing' WHEN n.digest IS NULL THEN 'unreadable' WHEN b.digest <> n.digest THEN 'changed' ELSE 'known' END AS outcome FROM b FULL JOIN n ON b.k = n.k)
SELECT outcome, count(*) AS n FROM s GROUP BY outcome""")
def import_outcomes(t: Tables) -> DataFrame:
    """How many files an import found new, known, changed, unreadable, moved and missing."""
    old, new = two_releases(t)
    alone = lambda a, b: a.join(b.select("k"), "k", "left_anti").where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("digest")
    moved = alone(old, new).join(alone(new, old), "digest").select("digest", F.lit(True).alias("_moved"))
    both = D.outer(old, new, "k").select(F.col("o.digest").alias("was"), F.col("n.digest").alias("now"), F.col("o").isNull().alias("fresh"), F.col("n").isNull().alias("gone"))
    rows = both.withColumn("digest", F.when(F.col("fresh"), F.col("now")).when(F.col("gone"), F.col("was"))).join(moved, "digest", "left")
    outcome = (
        F.when(~F.col("gone") & F.col("now").isNull(), "unreadable")
        .when(F.col("fresh"), F.when(F.col("_moved"), "moved").otherwise("new"))
        .when(F.col("gone"), F.when(F.col("_moved"), "moved away").otherwise("missing"))
        .when(F.col("was") != F.col("now"), "changed")
        .otherwise("known")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


BARS_SQL = "[1, 2, 4, 8, 16]"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS s, CASE WHEN l_returnflag = 'R' THEN 60.0 + l_suppkey % 100 END AS named, CASE WHEN l_linestatus = 'O' THEN CAST(80 + l_partkey % 60 AS DOUBLE) END AS acid FROM lineitem),
c AS (SELECT *, list_filter([named, named * 2, named / 2], lambda b: b BETWEEN 50 AND 250 AND s * b / 60.0 / 4.0 >= 0.5 AND abs(s * b / 60.0 / 4.0 - round(s * b / 60.0 / 4.0)) <= 0.02)[1] AS fit,
list_filter([240.0 * x / s FOR x IN {BARS_SQL}], lambda b: b BETWEEN 60 AND 200) AS able FROM m), d AS (SELECT *, list_sort([{{'off': abs(log2(b / 120.0)), 'bpm': b}} FOR b IN able])[1].bpm AS own FROM c)
SELECT l_orderkey, l_linenumber, round(coalesce(fit, acid, own), 6) AS bpm, CASE WHEN fit IS NOT NULL THEN 'name' WHEN acid IS NOT NULL THEN 'acid' WHEN own IS NOT NULL THEN 'length' END AS src FROM d""")
def tempo_fallbacks(t: Tables) -> DataFrame:
    """A tempo by name where it makes whole bars, else what the file states, else what its length suggests."""
    named = F.when(F.col("l_returnflag") == "R", F.lit(60.0) + F.col("l_suppkey") % 100)
    acid = F.when(F.col("l_linestatus") == "O", (80 + F.col("l_partkey") % 60).cast("double"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", T.tempo_with_fallbacks(F.col("l_quantity") / 5, [("name", named)], [("acid", acid)]).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.round("x.bpm", 6).alias("bpm"), F.col("x.src").alias("src"))


@query("""SELECT 'quantity' AS name, avg(l_quantity) AS mean, CASE WHEN stddev_pop(l_quantity) < 1e-9 THEN 1.0 ELSE round(stddev_pop(l_quantity), 6) END AS deviation, count(l_quantity) AS n FROM lineitem UNION ALL
SELECT 'discount', round(avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 9), round(stddev_pop(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 6), count(CASE WHEN l_returnflag <> 'R' THEN 1 END) FROM lineitem UNION ALL SELECT 'flat', 1.0, 1.0, count(*) FROM lineitem""")
def standardizer(t: Tables) -> DataFrame:
    """Mean and population deviation of each measure; nulls don't count, and what never varies is divided by one."""
    some = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    each = F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in (("quantity", F.col("l_quantity")), ("discount", some), ("flat", F.lit(1.0)))))
    rows = t.lineitem.select(F.explode(each).alias("e")).select("e.*").groupBy("name")
    found = rows.agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("d"), F.count("x").alias("n"))
    return found.select("name", "mean", F.when(F.col("d") < 1e-9, 1.0).otherwise(F.col("d")).alias("deviation"), "n")


@query(f"""WITH a AS ({ANCHORS}), s AS (SELECT vec_id, label, category, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding::DOUBLE[], anchor) DESC, category) AS r FROM embeddings, a), n AS (SELECT label, count(*) AS members FROM embeddings GROUP BY label)
SELECT s.label, s.category AS phrase, round(count(*) / CAST(members AS DOUBLE), 6) AS support FROM s JOIN n ON n.label = s.label WHERE r <= 3 GROUP BY s.label, s.category, members""")
def phrase_shares(t: Tables) -> DataFrame:
    """For each family, the share of members that have a phrase among their three nearest."""
    table = anchors(t).agg(F.collect_list(F.struct("category", "anchor")).alias("_all"))
    scored = F.transform("_all", lambda a: F.struct((-V.dot(F.col("embedding"), a["anchor"])).alias("s"), a["category"].alias("c")))
    top = t.embeddings.crossJoin(F.broadcast(table)).select("label", F.explode(F.slice(F.array_sort(scored), 1, 3)).alias("x"))  # ten anchors
    members = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    counts = top.groupBy("label", F.col("x.c").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(members, "label").select("label", "phrase", F.round(F.col("n") / F.col("members"), 6).alias("support"))


@query("""WITH c AS (SELECT * FROM embeddings WHERE vec_id % 4 = 0), s AS (SELECT e.vec_id, e.label, max(list_dot_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))) AS near FROM embeddings e JOIN c ON c.vec_id <> e.vec_id GROUP BY e.vec_id, e.label)
SELECT label, count(*) AS n, count(*) FILTER (near < 0.3) AS blind, round(avg(near), 5) AS mean_near, round(min(near), 5) AS farthest FROM s GROUP BY label""")
def audit_by_label(t: Tables) -> DataFrame:
    """How well a chosen set covers each label: blind spots, mean and farthest nearness."""
    near = R.nearest_to_set(t.embeddings, t.embeddings.where("vec_id % 4 = 0"), "embedding", "vec_id").join(t.embeddings.select("vec_id", "label"), "vec_id")
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nearest") < 0.3).alias("blind"), F.round(F.avg("nearest"), 5).alias("mean_near"), F.round(F.min("nearest"), 5).alias("farthest"))


@query("""WITH i AS (SELECT p_partkey, p_brand, p_size, p_retailprice > 908 AS pin, p_partkey % 5 = 0 AS held FROM part), g AS (SELECT p_brand, greatest(0, 12 - count(*) FILTER (pin)) AS room FROM i GROUP BY p_brand),
h AS (SELECT i.*, room, row_number() OVER (PARTITION BY i.p_brand ORDER BY p_partkey) AS r FROM i JOIN g ON g.p_brand = i.p_brand WHERE NOT pin AND held), k AS (SELECT p_brand, least(count(*), max(room)) AS taken FROM h GROUP BY p_brand),
o AS (SELECT i.p_partkey, room - coalesce(taken, 0) AS free, row_number() OVER (PARTITION BY i.p_brand ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY i.p_brand) AS n FROM i JOIN g ON g.p_brand = i.p_brand LEFT JOIN k ON k.p_brand = i.p_brand WHERE NOT pin AND NOT held)
SELECT p_partkey, 'pin' AS why FROM i WHERE pin UNION ALL SELECT p_partkey, 'held' FROM h WHERE r <= room UNION ALL SELECT p_partkey, 'spread' FROM o WHERE n <= free OR (r * free) // n <> ((r - 1) * free) // n""")
def set_cap_whole(t: Tables) -> DataFrame:
    """A set's cap: all pins, then what was in before, then the rest evenly spaced over the register."""
    rows = t.part.select("p_partkey", "p_brand", "p_size", (F.col("p_retailprice") > 908).alias("pin"), (F.col("p_partkey") % 5 == 0).alias("held"))
    room = rows.groupBy("p_brand").agg(F.greatest(F.lit(0), 12 - F.count_if("pin")).alias("room"))
    held = ranked(rows.where("NOT pin AND held"), "p_brand", [F.col("p_partkey")]).join(room, "p_brand").where("_r <= room")
    taken = held.groupBy("p_brand").agg(F.count(F.lit(1)).alias("taken"))
    rest = rows.where("NOT pin AND NOT held")
    sizes = rest.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).join(room, "p_brand").join(taken, "p_brand", "left").select("p_brand", "n", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("free"))
    step = lambda r: F.floor(r * F.col("free") / F.col("n"))
    spread = ranked(rest, "p_brand", [F.col("p_size"), F.col("p_partkey")]).join(sizes, "p_brand").where((F.col("n") <= F.col("free")) | (step(F.col("_r")) != step(F.col("_r") - 1)))
    why = lambda df, name: df.select("p_partkey", F.lit(name).alias("why"))
    return why(rows.where("pin"), "pin").unionByName(why(held, "held")).unionByName(why(spread, "spread"))


@query("""WITH o AS (SELECT vec_id AS k, label AS a, CAST(label * 2 AS BIGINT) AS b FROM embeddings WHERE vec_id % 6 <> 1), n AS (SELECT vec_id AS k, CASE WHEN vec_id % 9 = 0 THEN label + 1 ELSE label END AS a, CAST(CASE WHEN vec_id % 8 = 0 THEN NULL ELSE label * 2 END AS BIGINT) AS b FROM embeddings WHERE vec_id % 5 <> 2)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' WHEN n.a IS DISTINCT FROM o.a OR (n.b IS NOT NULL AND n.b IS DISTINCT FROM o.b) THEN 'update' ELSE 'same' END AS action FROM o FULL JOIN n ON o.k = n.k""")
def vendor_upsert(t: Tables) -> DataFrame:
    """A vendor's rows upserted: what it does not say stays, and only what differs is an update."""
    base = t.embeddings.select(F.col("vec_id").alias("k"), F.col("label").alias("a"), (F.col("label") * 2).cast("long").alias("b"))
    old = base.where("k % 6 <> 1")
    new = base.where("k % 5 <> 2").select("k", F.when(F.col("k") % 9 == 0, F.col("a") + 1).otherwise(F.col("a")).alias("a"), F.when(F.col("k") % 8 != 0, F.col("b")).alias("b"))
    both = D.outer(old, new, "k")
    differs = ~F.col("n.a").eqNullSafe(F.col("o.a")) | (F.col("n.b").isNotNull() & ~F.col("n.b").eqNullSafe(F.col("o.b")))
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "keep").when(differs, "update").otherwise("same")
    return both.select("k", F.coalesce("n.a", "o.a").alias("a"), F.coalesce("n.b", "o.b").alias("b"), action.alias("action"))


@query(f"""WITH f AS (SELECT {PATH_SQL} AS path, regexp_extract({PATH_SQL}, '([^/]+)/*$', 1) AS stem FROM pages), c AS (SELECT stem, count(*) AS n, min(path) AS path FROM f GROUP BY stem) SELECT stem, path FROM c WHERE n = 1""")
def stem_map(t: Tables) -> DataFrame:
    """Stems that name one file only, and its path."""
    path = path_of(F.col("url"))
    rows = t.pages.select(path.alias("path"), F.regexp_extract(path, "([^/]+)/*$", 1).alias("stem"))
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1").select("stem", "path")


KEPT_SQL = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, coalesce((SELECT list(a) FROM p WHERE p.b = vec_id), []) AS better FROM embeddings),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.r, CASE WHEN list_has_any(o.better, s.kept) THEN s.kept ELSE list_append(s.kept, o.vec_id) END FROM s JOIN o ON o.r = s.i + 1),
k AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM s ORDER BY i DESC LIMIT 1))"""


@query(f"""WITH RECURSIVE {KEPT_SQL}, x AS (SELECT a AS d, b AS q, s FROM p UNION ALL SELECT b, a, s FROM p), l AS (SELECT d, max(s) AS near FROM x JOIN k ON k.id = q WHERE d NOT IN (SELECT id FROM k) GROUP BY d),
f AS (SELECT d, row_number() OVER (ORDER BY near, d) AS r FROM l) SELECT vec_id, vec_id IN (SELECT id FROM k) AS kept, coalesce(r <= (SELECT count(*) * 9 // 10 FROM embeddings) - (SELECT count(*) FROM k), false) AS back FROM embeddings LEFT JOIN f ON d = vec_id""")
def pruned_to_floor(t: Tables) -> DataFrame:
    """Near copies pruned, and the least alike back until nine tenths of all are kept."""
    pairs = R.close_pairs(t.embeddings, "embedding", "vec_id", "label", 0.25)
    state = C.pruned(t.embeddings.select("vec_id"), pairs.select("a", "b"), "vec_id", "vec_id", lambda df: written(df, "pruning"))
    return C.refilled(state, pairs, "vec_id", t.embeddings.count() * 9 // 10).select("vec_id", "kept", "back")
