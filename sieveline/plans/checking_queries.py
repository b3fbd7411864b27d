"""Checks, explanations, plans, traits and reports over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import checks as Q
from ..operators import selection as S
from ..operators.written import written
from .registry import Tables, query


def level(name: str, status: str, bad: str) -> str:
    """SQL of one check over a query of (w)."""
    return f"SELECT '{name}' AS \"check\", CASE WHEN count(*) = 0 THEN 'PASS' ELSE '{status}' END AS status, count(*) AS n, min(CAST(w AS VARCHAR)) AS example FROM ({bad}) x{name}"


MANIFEST_SQL = " UNION ALL ".join(
    [
        level("names", "FAIL", "SELECT concat_ws('|', p_brand, lower(p_name), CAST(p_size AS VARCHAR)) AS w FROM part GROUP BY 1 HAVING count(*) > 1"),
        level("sources", "FAIL", "SELECT l_partkey AS w FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"),
        level("orders", "FAIL", "SELECT l_orderkey AS w FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 3)"),
        level("budgets", "WARN", "SELECT p_type AS w FROM part GROUP BY p_type HAVING count(*) > 340 OR count(*) < 10"),
        level("bands", "WARN", "SELECT p_partkey AS w FROM part WHERE p_size NOT BETWEEN 1 AND 50"),
        level("lengths", "FAIL", "SELECT p_partkey AS w FROM part WHERE length(p_brand || '/' || p_name) > 19"),
    ]
)


@query(f"""WITH c AS ({MANIFEST_SQL}) SELECT * FROM c UNION ALL SELECT 'all', CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END, count(*) FILTER (status <> 'PASS'), NULL FROM c""")
def verify_manifest(t: Tables) -> DataFrame:
    """Names, references, budgets, bands and lengths of a build, and the verdict over all."""
    size = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return Q.verified(
        Q.check("names", "FAIL", Q.repeated(t.part, F.col("p_brand"), F.lower("p_name"), F.col("p_size").cast("string")), F.col("k")),
        Q.check("sources", "FAIL", Q.absent(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey"), F.col("l_partkey")),
        Q.check("orders", "FAIL", Q.absent(t.lineitem, t.orders.where("o_orderkey % 50 <> 3").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"), F.col("l_orderkey")),
        Q.check("budgets", "WARN", Q.outside(t.part, ["p_type"], F.lit(10), F.lit(340), size.select("p_type")), F.col("p_type")),
        Q.check("bands", "WARN", t.part.where("p_size NOT BETWEEN 1 AND 50"), F.col("p_partkey")),
        Q.check("lengths", "FAIL", t.part.where(F.length(F.concat_ws("/", "p_brand", "p_name")) > 19), F.col("p_partkey")),
    )


RATED_SQL = " UNION ALL ".join(
    [
        level("dropped_kept", "FAIL", "SELECT d.doc_id AS w FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1"),
        level("keeps_gone", "FAIL", "SELECT doc_id AS w FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)"),
        level("copies", "WARN", "SELECT md5(text) || '' AS w FROM documents GROUP BY 1 HAVING count(*) > 1"),
        level("routing", "WARN", "SELECT md5(text) AS w FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1"),
        level("lengths", "FAIL", "SELECT doc_id AS w FROM documents WHERE n_chars IS DISTINCT FROM length(text)"),
    ]
)


@query(f"""WITH c AS ({RATED_SQL}) SELECT * FROM c UNION ALL SELECT 'all', CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END, count(*) FILTER (status <> 'PASS'), NULL FROM c""")
def verify_ratings(t: Tables) -> DataFrame:
    """Ratings, copies, routing and measured lengths against the build."""
    docs = t.documents.select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"), F.length("text").alias("n"))
    rated = docs.join(t.labels, "doc_id")
    homes = docs.groupBy("digest").agg(F.count_distinct("lang").alias("n")).where("n > 1")
    return Q.verified(
        Q.check("dropped_kept", "FAIL", rated.where("toxic = 1"), F.col("doc_id")),
        Q.check("keeps_gone", "FAIL", Q.absent(t.labels.where("quality = 1"), docs, "doc_id"), F.col("doc_id")),
        Q.check("copies", "WARN", Q.repeated(docs, F.col("digest")), F.col("k")),
        Q.check("routing", "WARN", homes, F.col("digest")),
        Q.check("lengths", "FAIL", docs.where("NOT (n_chars <=> n)"), F.col("doc_id")),
    )


@query("""SELECT page_id, CASE WHEN length(url) > 60 THEN 'too long' WHEN regexp_matches(url, '[?#]') THEN 'signs' WHEN octet_length(encode(html)) > 20000 THEN 'too large' END AS violation FROM pages""")
def render_violations(t: Tables) -> DataFrame:
    """What a device refuses of what was written: path length, signs, size; the first that holds."""
    rows = S.gated(t.pages, ("too long", F.length("url") > 60), ("signs", F.col("url").rlike("[?#]")), ("too large", F.octet_length("html") > 20000))
    return rows.select("page_id", F.col("reason").alias("violation"))


GATES_SQL = """CASE WHEN n_chars < 50 THEN 'short' WHEN toxic = 1 THEN 'dropped' WHEN quality = 0 AND n_chars > 2000 THEN 'poor' WHEN md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) THEN 'copy' WHEN source = 'src3' THEN 'style' WHEN NOT (lang = 'en' OR lang = 'de') THEN 'window' END"""


def excluded(t: Tables) -> DataFrame:
    digest = t.documents.withColumn("digest", F.md5("text")).join(t.labels, "doc_id", "left")
    twice = digest.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", F.lit(True).alias("twice"))
    rows = digest.join(twice, "digest", "left")
    gates = [("short", F.col("n_chars") < 50), ("dropped", F.col("toxic") == 1), ("poor", (F.col("quality") == 0) & (F.col("n_chars") > 2000)), ("copy", F.col("twice")), ("style", F.col("source") == "src3"), ("window", ~F.col("lang").isin("en", "de"))]
    return S.gated(rows, *gates).select("doc_id", "source", "lang", "n_chars", "reason")


@query(f"""WITH e AS (SELECT d.*, {GATES_SQL} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, reason, CASE reason WHEN 'short' THEN 'only ' || n_chars || ' characters' WHEN 'copy' THEN 'its bytes are elsewhere, too' WHEN 'style' THEN 'the style of ' || source || ' is left out' ELSE reason END AS sentence FROM e WHERE reason IS NOT NULL""")
def exclusion_sentences(t: Tables) -> DataFrame:
    """Why each item was left out, in words."""
    rows = excluded(t).where("reason IS NOT NULL")
    short = Q.sentences(rows, "reason", {"short": "only %s characters", "copy": "its bytes are elsewhere, too"}, "n_chars")
    both = Q.sentences(short.withColumn("_said", F.col("sentence")), "reason", {"style": "the style of %s is left out"}, "source")
    return both.select("doc_id", "reason", F.when(F.col("reason") == "style", F.col("sentence")).otherwise(F.col("_said")).alias("sentence"))


@query(f"""WITH e AS (SELECT d.*, {GATES_SQL} AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS left_out, max(n_chars) FILTER (reason IS NULL) AS longest, mode_reason AS chief_reason FROM e LEFT JOIN (
SELECT lang AS g, arg_min(reason, (-n, reason)) AS mode_reason FROM (SELECT lang, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY lang) ON g = lang GROUP BY lang, mode_reason""")
def report_rows(t: Tables) -> DataFrame:
    """What a report shows of each category: kept, left out, the longest, the chief reason."""
    rows = excluded(t)
    counts = rows.where("reason IS NOT NULL").groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n"))
    chief = counts.groupBy("lang").agg(F.min_by("reason", F.struct((-F.col("n")).alias("m"), "reason")).alias("chief_reason"))
    out = rows.groupBy("lang").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("left_out"), F.max(F.when(F.col("reason").isNull(), F.col("n_chars"))).alias("longest"))
    return out.join(chief, "lang", "left")


@query("""WITH g AS (SELECT p_type, count(*) AS n, sum(p_size) AS size, sum(p_retailprice / 1000) AS seconds FROM part GROUP BY p_type) SELECT p_type, n, CAST(size AS BIGINT) AS size, round(seconds, 6) AS seconds, round(greatest(max(seconds) OVER (), sum(seconds) OVER () / 4), 6) AS wall FROM g""")
def dry_run(t: Tables) -> DataFrame:
    """Counts, sizes and times that a build would take."""
    plan = Q.planned(t.part, "p_type", F.col("p_size"), F.col("p_retailprice") / 1000, 4)
    return plan.select("p_type", "n", "size", F.round("seconds", 6).alias("seconds"), F.round("wall", 6).alias("wall"))


@query("""WITH f AS (SELECT p_type, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS VARCHAR))), 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM part GROUP BY p_type)
SELECT p_type, n, fingerprint FROM f""")
def build_fingerprints(t: Tables) -> DataFrame:
    """A digest of each category's inputs."""
    return Q.fingerprints(t.part, "p_type", ["p_partkey", "p_name", "p_size"])


@query("SELECT DISTINCT p_type, p_type <> 'PROMO' AS reuse FROM part")
def resumed(t: Tables) -> DataFrame:
    """Which finished categories can be reused: one changed since, the others did not."""
    now = Q.fingerprints(t.part, "p_type", ["p_partkey", "p_size"])
    before = Q.fingerprints(t.part.withColumn("p_size", F.when(F.col("p_type") == "PROMO", F.col("p_size") + 1).otherwise(F.col("p_size"))), "p_type", ["p_partkey", "p_size"])
    return Q.reusable(now, written(before, "finished"), "p_type")


@query("""WITH m AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL), b AS (SELECT p_brand, arg_min(p_type, (-c, p_type)) AS mode_p_type, max(c) AS c FROM m GROUP BY p_brand)
SELECT p.p_brand, count(*) AS n, round(avg(p_size), 6) AS mean_p_size, round(avg(p_retailprice), 6) AS mean_p_retailprice, median(p_size) AS median_p_size, min(p_retailprice) AS low_p_retailprice, max(p_retailprice) AS high_p_retailprice, mode_p_type, round(max(b.c) / count(*), 6) AS share_p_type FROM part p JOIN b ON b.p_brand = p.p_brand GROUP BY p.p_brand, mode_p_type""")
def cluster_traits(t: Tables) -> DataFrame:
    """Means, medians, ranges and the dominant type of each cluster."""
    found = Q.traits(t.part, "p_brand", ["p_size", "p_retailprice"], ["p_size"], ["p_retailprice"], ["p_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_p_size", "mean_p_retailprice", "share_p_type")})


@query("SELECT count(DISTINCT p_type) AS categories, count(*) AS files, count(*) FILTER (p_size > 40) AS set_files FROM part")
def manifest_counts(t: Tables) -> DataFrame:
    return t.part.agg(F.count_distinct("p_type").alias("categories"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("p_size") > 40).alias("set_files"))


@query("SELECT count(l.doc_id) AS labelled, count(DISTINCT source) FILTER (l.doc_id IS NOT NULL) AS packs, count(*) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def label_availability(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return rows.agg(F.count("has").alias("labelled"), F.count_distinct(F.when(F.col("has"), F.col("source"))).alias("packs"), F.count(F.lit(1)).alias("total"))


@query("""WITH p AS (SELECT vec_id, CAST(label AS INTEGER) AS model, CAST(quality * 5 AS INTEGER) AS home FROM embeddings JOIN labels ON doc_id = vec_id), a AS (SELECT *, row_number() OVER (PARTITION BY model, home ORDER BY vec_id) AS r FROM p WHERE model <> home)
SELECT model, home, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id) FILTER (r <= 3), ',') AS examples FROM a GROUP BY model, home""")
def model_disagreements(t: Tables) -> DataFrame:
    """Where the model and the home differ, how often, and the first examples."""
    rows = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id")).select("vec_id", F.col("label").cast("int").alias("model"), (F.col("quality") * 5).cast("int").alias("home"))
    return Q.confusions(rows, "model", "home", "vec_id", 3)


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3 = 0 DESC, CASE WHEN p_partkey % 3 = 0 THEN p_name END, p_size DESC, p_partkey) AS place FROM part""")
def naming_order(t: Tables) -> DataFrame:
    """Items that had a name come first, in its order, so that names stay where they are."""
    had = F.col("p_partkey") % 3 == 0
    order = Window.partitionBy("p_brand").orderBy(had.desc(), F.when(had, F.col("p_name")).asc_nulls_last(), F.desc("p_size"), "p_partkey")
    return t.part.select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'keep' END, CASE WHEN regexp_matches(source, '[13579]$') THEN 'odd' END) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def training_labels(t: Tables) -> DataFrame:
    """Ratings override what names say."""
    rated = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "keep")
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(rated, F.when(F.col("source").rlike("[13579]$"), "odd")).alias("label"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), c AS (SELECT p_type, count(*) AS size FROM part GROUP BY p_type)
SELECT p_type, size, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS picks FROM r JOIN c USING (p_type) GROUP BY p_type, size""")
def build_by_category(t: Tables) -> DataFrame:
    """Every category built on its own, all in one job: its size and its five dearest items."""
    sizes = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("size"))
    best = t.part.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("r <= 5")
    picks = best.groupBy("p_type").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))), lambda x: x["p_partkey"].cast("string"))).alias("picks"))
    return sizes.join(picks, "p_type")


@query("""WITH v AS (SELECT DISTINCT doc_id, 'a' AS s, lang AS c FROM documents UNION SELECT doc_id, 'b', CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'en' WHEN source = 'src4' THEN 'fr' END FROM documents), u AS (SELECT * FROM v WHERE c IS NOT NULL),
n AS (SELECT doc_id, c, count(*) AS support FROM u GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, c DESC) AS r FROM n), h AS (SELECT doc_id, count(DISTINCT s) AS heard FROM u GROUP BY doc_id),
p AS (SELECT b.c AS home, support, heard >= 2 AND support < 2 AS conflict FROM b JOIN h USING (doc_id) WHERE r = 1) SELECT home, support, conflict, count(*) AS n FROM p GROUP BY ALL""")
def resolution_counts(t: Tables) -> DataFrame:
    """Homes with support and conflict, stored, and how many are corroborated or contradicted."""
    from ..operators import routing as G

    own = t.documents.select("doc_id", F.lit("a").alias("source"), F.col("lang").alias("category"))
    folder = F.when(F.col("source").isin("src0", "src1", "src2"), "en").when(F.col("source") == "src4", "fr")
    votes = own.unionByName(t.documents.select("doc_id", F.lit("b").alias("source"), folder.alias("category"))).where("category IS NOT NULL")
    stored = written(G.homes(votes, "doc_id", 2), "resolution")
    return stored.groupBy("home", "support", "conflict").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT p_partkey AS k, p_brand AS fam FROM part WHERE p_size > 5), n AS (SELECT p_partkey AS k, CASE WHEN p_size > 45 THEN 'big' ELSE p_brand END AS fam FROM part WHERE p_size < 48),
j AS (SELECT coalesce(o.k, n.k) AS k, o.fam AS was, n.fam AS now FROM o FULL JOIN n ON o.k = n.k) SELECT k, CASE WHEN was IS NULL THEN '+ ' || now WHEN now IS NULL THEN '- ' || was ELSE was || ' > ' || now END AS line FROM j WHERE was IS DISTINCT FROM now""")
def changelog_lines(t: Tables) -> DataFrame:
    """A change log's lines, written as text and read again."""
    k = F.col("p_partkey").alias("k")
    old = t.part.where("p_size > 5").select(k, F.col("p_brand").alias("was"))
    new = t.part.where("p_size < 48").select(k, F.when(F.col("p_size") > 45, "big").otherwise(F.col("p_brand")).alias("now"))
    both = old.join(new, "k", "full_outer").where("NOT (was <=> now)")
    line = F.when(F.col("was").isNull(), F.concat(F.lit("+ "), "now")).when(F.col("now").isNull(), F.concat(F.lit("- "), "was")).otherwise(F.concat_ws(" > ", "was", "now"))
    return written(both.select("k", line.alias("line")), "changelog")
