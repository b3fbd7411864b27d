"""Catalog, label, feature and tempo queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import names as N
from ..functions import tempo as T
from ..operators import labels as L
from ..operators import nearness as V
from . import registry
from .registry import Tables, query

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

#: A query vector for the top-k queries: the first components of one axis each.
PROBE = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}" for x in PROBE) + "]::DOUBLE[]"
DOT = "list_dot_product(embedding::DOUBLE[], {})"


@query(f"""
WITH vectors AS (SELECT vec_id, {DOT.format(PROBE_SQL)} AS score FROM embeddings)
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, round(v.score, 6) AS score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN vectors v ON v.vec_id = d.doc_id
WHERE d.n_chars BETWEEN 200 AND 5000 AND d.lang IN ('en', 'de') AND coalesce(l.toxic, 0) = 0
ORDER BY v.score DESC, d.doc_id LIMIT 50""")
def catalog_search(t: Tables) -> DataFrame:
    """Filters and left joins, then vector top-k among what is allowed."""
    docs = t.documents.where(F.col("n_chars").between(200, 5000) & F.col("lang").isin("en", "de")).select("doc_id", "lang", "source")
    allowed = docs.join(t.labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    top = V.top_k(t.embeddings, "embedding", PROBE, 50, "vec_id", allowed.select(F.col("doc_id").alias("vec_id")))
    found = allowed.join(F.broadcast(top), F.col("doc_id") == F.col("vec_id"))  # 50 rows
    return found.select("doc_id", "lang", "source", "quality", "toxic", F.round("score", 6).alias("score"))


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) m ON m.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def sample_select(t: Tables) -> DataFrame:
    """Chosen fields of every marked item: one inner join to the marker, one left join for all descriptors."""
    marker = t.labels.select("doc_id").distinct()
    return t.documents.select("doc_id", "source").join(marker, "doc_id").join(t.labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query(f"SELECT vec_id, round({DOT.format(PROBE_SQL)}, 6) AS score FROM embeddings ORDER BY {DOT.format(PROBE_SQL)} DESC, vec_id LIMIT 20")
def vector_topk(t: Tables) -> DataFrame:
    return V.top_k(t.embeddings, "embedding", PROBE, 20, "vec_id").withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round({DOT.format(PROBE_SQL)}, 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {DOT.format(PROBE_SQL)} DESC, vec_id LIMIT 20")
def vector_topk_allowed(t: Tables) -> DataFrame:
    allowed = t.labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return V.top_k(t.embeddings, "embedding", PROBE, 20, "vec_id", allowed).withColumn("score", F.round("score", 6))


def part_labels(t: Tables) -> DataFrame:
    return L.exploded(t.part.withColumn("words", F.split("p_type", " ")), "p_partkey", "words", "name", "type")


PART_LABELS = "(SELECT p_partkey, 'name' AS provider, 'type' AS kind, unnest(string_split(p_type, ' ')) AS label, unnest(range(len(string_split(p_type, ' ')))) AS rank FROM part)"
MAPPING = [("PROMO", "offer"), ("ECONOMY", "plain"), ("STANDARD", "plain"), ("BRASS", "metal"), ("STEEL", "metal"), ("TIN", "metal"), ("COPPER", "metal"), ("NICKEL", "metal")]
MAPPING_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MAPPING) + ") AS m(label, canonical)"


def mapping(t: Tables) -> DataFrame:
    return F.broadcast(t.spark.createDataFrame(MAPPING, "label string, canonical string"))  # a fixed table


@query(f"SELECT p_partkey, provider, kind, CAST(rank AS INTEGER) AS rank, label FROM {PART_LABELS}")
def labels_explode_rank(t: Tables) -> DataFrame:
    return part_labels(t)


@query(f"SELECT p_partkey, canonical, CAST(min(rank) AS INTEGER) AS rank FROM {PART_LABELS} AS l JOIN {MAPPING_SQL} ON m.label = l.label GROUP BY p_partkey, canonical")
def labels_canonical_min_rank(t: Tables) -> DataFrame:
    return L.canonical(part_labels(t), mapping(t), "p_partkey")


@query(f"SELECT kind, label, count(*) AS n FROM {PART_LABELS} AS l WHERE label NOT IN (SELECT m.label FROM {MAPPING_SQL}) GROUP BY kind, label")
def labels_unmapped(t: Tables) -> DataFrame:
    return L.unmapped(part_labels(t), mapping(t))


@query(f"""SELECT p.p_partkey, CASE WHEN p.p_size > 25 THEN NULL ELSE coalesce(l.labels, '') END AS labels
FROM part p LEFT JOIN (SELECT l.p_partkey, string_agg(l.label, '|' ORDER BY rank) AS labels FROM {PART_LABELS} AS l JOIN {MAPPING_SQL} ON m.label = l.label GROUP BY l.p_partkey) l ON l.p_partkey = p.p_partkey""")
def labels_nested(t: Tables) -> DataFrame:
    """Ordered lists: empty where covered without labels, null where the provider never saw the item."""
    some = part_labels(t).join(mapping(t), "label", "left_semi")
    out = L.nested(t.part.select("p_partkey"), some, "p_partkey", t.part.where("p_size <= 25"))
    return out.select("p_partkey", F.when(F.col("labels").isNotNull(), F.array_join("labels", "|")).alias("labels"))


@query("SELECT doc_id, CAST(max(quality) AS DOUBLE) AS quality, CAST(max(toxic) AS DOUBLE) AS toxic FROM labels GROUP BY doc_id")
def descriptor_pivot(t: Tables) -> DataFrame:
    long = t.labels.select("doc_id", F.expr("stack(2, 'quality', double(quality), 'toxic', double(toxic)) AS (name, value)"))
    return L.widened(long, "doc_id", ["quality", "toxic"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_type ILIKE '%promo%' OR p_type ILIKE '%econ%')")
def list_member_semi(t: Tables) -> DataFrame:
    return L.having_any(t.part.select("p_partkey", "p_name"), part_labels(t), "p_partkey", F.col("label").ilike("%promo%") | F.col("label").ilike("%econ%"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 5 <> 0),
j AS (SELECT a.doc_id AS ka, b.doc_id AS kb, a.quality AS qa, b.quality AS qb, a.toxic AS ta, b.toxic AS tb FROM labels a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT f.field, CAST(sum(CASE WHEN ka IS NOT NULL AND kb IS NOT NULL AND ((f.field = 'quality' AND qa IS DISTINCT FROM qb) OR (f.field = 'toxic' AND ta IS DISTINCT FROM tb)) THEN 1 ELSE 0 END) AS BIGINT) AS differs,
CAST(sum(CASE WHEN kb IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS source_only, CAST(sum(CASE WHEN ka IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS stored_only
FROM j CROSS JOIN (VALUES ('quality'), ('toxic')) AS f(field) GROUP BY f.field""")
def null_safe_parity(t: Tables) -> DataFrame:
    stored = t.labels.where("doc_id % 5 <> 0").withColumn("quality", F.when(F.col("doc_id") % 7 != 0, F.col("quality")))
    return L.parity(t.labels, stored, "doc_id", ["quality", "toxic"])


@query("""WITH s AS (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 4 = 1 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels)
SELECT coalesce(a.doc_id, s.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'delete' ELSE 'relabel' END AS action
FROM labels a FULL JOIN s ON a.doc_id = s.doc_id WHERE a.doc_id IS NULL OR s.doc_id IS NULL OR a.quality <> s.quality""")
def stamp_plan(t: Tables) -> DataFrame:
    """What to relabel and delete, by stamps of version and source row."""
    old = t.labels.select(F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 4 == 1, (1 - F.col("quality")).cast(t.labels.schema["quality"].dataType)).otherwise(F.col("quality")).alias("quality"), "toxic")
    return L.stale(t.labels, old.withColumn("stamp", F.xxhash64(F.lit(1), "quality", "toxic")), "doc_id", ["quality", "toxic"], 1)


MEASURED = "(SELECT l_orderkey, l_linenumber, l_discount * 10 AS h, l_tax * 10 AS b, l_quantity / 5.0 AS crest, l_quantity / 50.0 AS dur, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity / 50.0 END AS conf FROM lineitem)"


def measured(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("h"), (F.col("l_tax") * 10).alias("b"), (q / 5.0).alias("crest"), (q / 50.0).alias("dur"), F.when(F.col("l_linenumber") % 3 != 0, q / 50.0).alias("conf"))


@query(f"""SELECT l_orderkey, l_linenumber, h * (1.0 - b) AS sub_weight, least(crest / 8.0, 1.0) AS transient, (1.0 - b) / (b + 0.05) AS balance,
CASE WHEN conf IS NULL THEN h > 0.7 ELSE h > 0.6 AND conf > 0.5 END AS pitched,
CASE WHEN sqrt(0.0 + b * b + h * h) > 0 THEN b / sqrt(0.0 + b * b + h * h) ELSE 0.0 END AS unit_b FROM {MEASURED}""")
def derived_features(t: Tables) -> DataFrame:
    h, b = F.col("h"), F.col("b")
    return measured(t).select("l_orderkey", "l_linenumber", X.sub_weight(h, b).alias("sub_weight"), X.transient_score(F.col("crest")).alias("transient"), X.spectral_balance(b).alias("balance"), X.is_pitched(h, F.col("conf")).alias("pitched"), X.timbral_unit(b, h)[0].alias("unit_b"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN dur < 0.08 AND crest >= 8 THEN 'snap' WHEN crest < 3 AND dur > 0.5 THEN 'swell' WHEN crest >= 3 AND dur <= 0.5 THEN 'punch' ELSE 'swell' END AS attack FROM {MEASURED}""")
def attack_class(t: Tables) -> DataFrame:
    return measured(t).select("l_orderkey", "l_linenumber", X.attack_class(F.col("crest"), F.col("dur")).alias("attack"))


@query(f"""SELECT l_orderkey, l_linenumber, greatest(0.0, 1.0 - CASE WHEN crest > 9 THEN 0.5 ELSE 0.0 END - CASE WHEN b > 0.02 THEN least(0.35, (b - 0.02) * 12.0) ELSE 0.0 END - CASE WHEN conf < 0.1 THEN 0.35 ELSE 0.0 END) AS quality FROM {MEASURED}""")
def quality_score(t: Tables) -> DataFrame:
    return measured(t).select("l_orderkey", "l_linenumber", X.quality(F.col("crest") > 9, F.col("b"), F.col("conf") * 0.04).alias("quality"))


@query("SELECT event_id, CASE WHEN x <= 0 THEN NULL WHEN x < 60 THEN x * pow(2.0, ceil(log2(60.0 / x))) WHEN x > 200 THEN x / pow(2.0, ceil(log2(x / 200.0))) ELSE x END AS bpm FROM (SELECT event_id, value * 10 + 1 AS x FROM events)")
def tempo_fold(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.fold_closed(F.col("value") * 10 + 1).alias("bpm"))


def _off(m: float, b: int) -> str:
    return f"abs(dur * bpm / 60.0 * {m} - 4.0 * {b})"


OFFS = ", ".join(_off(m, b) for m in (1.0, 2.0, 0.5) for b in T.BARS)


@query(f"SELECT p_partkey, CASE WHEN dur > 0 AND bpm > 0 THEN greatest(0.0, 1.0 - least({OFFS}) / 0.5) END AS confidence FROM (SELECT p_partkey, p_size / 4.0 AS dur, 60.0 + p_partkey % 140 AS bpm FROM part)")
def tempo_confidence(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") / 4.0).alias("dur"), (F.lit(60.0) + F.col("p_partkey") % 140).alias("bpm"))
    return rows.select("p_partkey", T.tempo_confidence(F.col("dur"), F.col("bpm")).alias("confidence"))


def _chain_sql() -> str:
    out = []
    for name, col in (("name", "n"), ("vendor", "v")):
        for m in (1.0, 2.0, 0.5):
            x = f"({col} * {m})"
            bars = f"(dur * {x} / 60.0 / 4.0)"
            out.append(f"WHEN {bars} >= 0.5 AND abs({bars} - round({bars})) <= 0.02 AND {x} BETWEEN 50 AND 250 THEN {{'bpm': {x}, 'src': '{name}'}}")
    return "CASE " + " ".join(out) + " END"


@query(f"SELECT p_partkey, c.bpm AS bpm, c.src AS src FROM (SELECT p_partkey, {_chain_sql()} AS c FROM (SELECT p_partkey, p_size / 2.0 AS dur, 60.0 + p_partkey % 90 AS n, 61.0 + p_partkey % 70 AS v FROM part))")
def tempo_chain(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    found = t.part.select("p_partkey", T.tempo_chain(F.col("p_size") / 2.0, ("name", F.lit(60.0) + k % 90), ("vendor", F.lit(61.0) + k % 70)).alias("c"))
    return found.select("p_partkey", "c.bpm", "c.src")


@query("""SELECT p_partkey, abs(a * 1.0 - b) <= 0.02 * b OR abs(a * 2.0 - b) <= 0.02 * b OR abs(a * 0.5 - b) <= 0.02 * b AS agree,
CAST(least((x - y + 120) % 12, 12 - (x - y + 120) % 12) AS BIGINT) AS semitones, CAST((126 - x) % 12 - 6 AS BIGINT) AS shift
FROM (SELECT p_partkey, 60.0 + p_partkey % 90 AS a, 60.0 + p_size * 2 AS b, p_partkey % 12 AS x, p_size % 12 AS y FROM part)""")
def pitch_agreement(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select("p_partkey", T.tempos_agree(F.lit(60.0) + k % 90, F.lit(60.0) + s * 2).alias("agree"), T.pitch_distance(k % 12, s % 12).cast("long").alias("semitones"), T.retune_shift(k % 12).cast("long").alias("shift"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS words, string_split(p_type, ' ')[1] AS pack FROM part""")
def name_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(N.words(F.col("p_name")), " ").alias("words"), N.pack_of(F.regexp_replace("p_type", " ", "/")).alias("pack"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(60 + s_suppkey % 100 AS INTEGER) END AS bpm, CASE WHEN s_suppkey % 2 = 0 THEN CAST(12 * (3 + 2) + 6 AS INTEGER) END AS note FROM supplier""")
def name_numbers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.col("s_name"), F.when(k % 3 == 0, F.concat(F.lit(" loop "), (60 + k % 100).cast("string"), F.lit("bpm"))).otherwise(F.lit("")), F.when(k % 2 == 0, F.lit(" F#3")).otherwise(F.lit("")))
    return t.supplier.select("s_suppkey", T.named_bpm(name).alias("bpm"), N.note_of(name).alias("note"))
