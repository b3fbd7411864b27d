"""Op 8 [native]: canonical exact digest.

Texts are canonical after Unicode compatibility composition (NFKC), full case folding, composition again and folding
of white-space runs to one space without ends; both Unicode steps are ICU's, called on the JVM. The fingerprint is
256 bits of XXH64 with four seeds. `groups` gives classes of equal canonical texts: equal fingerprints make a bucket,
and within a bucket of several rows bytes are compared by partial minima and maxima, so that no bucket's rows meet in
one task; a bucket whose bytes differ (a collision) is told apart by the bytes themselves. As an exact digest, likeness
is 0 or 1: two texts are alike if they are of one class.

Null text is empty. Rows with a repeated or null doc_id are documents of their own, in the order of (doc_id, text), null
first. Columns of other names are not read. Empty tables give empty results; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C


def canonical(text: Column) -> Column:
    def composed(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    def folded(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    return F.trim(F.regexp_replace(composed(folded(composed(text))), r"[\s\p{Z}]+", " "))


def fingerprint(canon: Column) -> Column:
    """64 hex digits: XXH64 under four seeds."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in range(4))))


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(_row, t), one row for each document in the order of _row, and (_row, doc_id); None where _row is the doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows, plain = C.numbered(rows, "doc_id", "t")
    return rows.select("_row", "t"), None if plain else rows.select("_row", "doc_id")


def _named(found: DataFrame, ids: DataFrame | None) -> DataFrame:
    """found with doc_id and class_id for _row and class_row."""
    if ids is None:
        return found.withColumnsRenamed({"_row": "doc_id", "class_row": "class_id"})
    first = ids.select(F.col("_row").alias("class_row"), F.col("doc_id").alias("class_id"))
    return found.join(ids, "_row").join(first, "class_row").drop("_row", "class_row")


def classes(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (_row, t) and marks (_row, fingerprint) -> _row, class_row (the least of the class), n (rows of the class)."""
    buckets = C.materialize(marks.groupBy("fingerprint").agg(F.min("_row").alias("class_row"), F.count(F.lit(1)).alias("n")), "buckets")
    alone = buckets.where("n = 1").select(F.col("class_row").alias("_row"), "class_row", "n")
    many = marks.join(buckets.where("n > 1"), "fingerprint")
    texts = rows.join(many.select("_row", "fingerprint"), "_row").select("_row", "fingerprint", canonical(F.col("t")).alias("canon"))
    ends = texts.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    told = C.materialize(ends.select("fingerprint", (F.col("lo") == F.col("hi")).alias("same")), "told")
    same = many.join(told.where("same"), "fingerprint", "left_semi").select("_row", "class_row", "n")
    found = alone.unionByName(same)
    if told.where("NOT same").isEmpty():
        return found
    clash = texts.join(told.where("NOT same"), "fingerprint", "left_semi")
    parts = clash.groupBy("fingerprint", "canon").agg(F.min("_row").alias("class_row"), F.count(F.lit(1)).alias("n"))
    return found.unionByName(clash.join(parts, ["fingerprint", "canon"]).select("_row", "class_row", "n"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id (doc_id of the first row of the same canonical text), n (rows of the class)."""
    rows, ids = _rows(docs)
    marks = C.materialize(rows.select("_row", fingerprint(canonical(F.col("t"))).alias("fingerprint")), "marks")
    return _named(classes(rows, marks).join(marks, "_row"), ids).select("doc_id", "fingerprint", "class_id", "n")


def neighbours(rows: DataFrame) -> DataFrame:
    """rows (_row, n) -> _row, before, half: the row before it (before the first: the last), and half of that one's n.

    Rows are dealt by ranges of _row and looked at within their range; of the ranges only the last rows meet, one for
    each shuffle partition. No texts travel here.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = C.materialize(rows.select("_row", "n").repartitionByRange(parts, "_row").withColumn("part", F.spark_partition_id()), "ranges")
    one = F.struct("_row", "n")
    lasts = dealt.groupBy("part").agg(F.max(one).alias("last"))
    ahead = lasts.withColumn("l", F.lag("last").over(Window.orderBy("part")))
    whole = lasts.agg(F.max_by("last", "part").alias("turn"))
    ahead = ahead.crossJoin(F.broadcast(whole)).select("part", F.coalesce("l", "turn").alias("far"))
    near = dealt.withColumn("near", F.lag(one).over(Window.partitionBy("part").orderBy("_row")))
    found = near.join(F.broadcast(ahead), "part").select("_row", F.coalesce("near", "far").alias("x"))
    return found.select("_row", F.col("x._row").alias("before"), F.floor(F.col("x.n") / 2).cast("int").alias("half"))


def edited(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (_row, t) -> _row, t, edited: the last half of t replaced by as much of the next row's text."""
    heads = rows.join(links, "_row").select(F.col("before").alias("to"), F.substring(F.col("t"), F.lit(1), F.col("half")).alias("head"))
    n = F.length("t")
    kept = F.substring(F.col("t"), F.lit(1), n - F.floor(n / 2).cast("int"))
    return rows.join(heads, F.col("_row") == F.col("to")).select("_row", "t", F.concat(kept, "head").alias("edited"))


def op8_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids = _rows(C.table(spark, sf_dir, "documents"))
    links = C.materialize(neighbours(rows.select("_row", F.length("t").alias("n"))), "neighbours")
    found = edited(rows, links).withColumns({"ca": canonical(F.col("t")), "ce": canonical(F.col("edited"))})
    found = found.withColumns({"fa": fingerprint(F.col("ca")), "fe": fingerprint(F.col("ce"))})
    like = F.when((F.col("fa") == F.col("fe")) & (F.col("ca") == F.col("ce")), 1.0).otherwise(0.0)
    found = found.select("_row", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fa").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"), like.alias("near_edited"))
    found = C.materialize(found, "digests")
    of = C.materialize(classes(rows, found.select("_row", "fingerprint")).select("_row", "class_row"), "classes")
    after = links.join(of, "_row").select(F.col("before").alias("_row"), F.col("class_row").alias("class_next"))
    near = F.when(F.col("class_row") == F.col("class_next"), 1.0).otherwise(0.0)
    out = found.join(of, "_row").join(after, "_row").withColumn("near_next", near)
    return _named(out, ids).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
