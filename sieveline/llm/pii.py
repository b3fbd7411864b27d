"""Op 6 [native]: information-theoretic sanitisation.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and non-overlapping per kind.
Their strings are the protected entities. The corpus then says how strongly other terms reveal them: for a term t
(a word outside all base spans) and an entity e, over all N documents,

    IC(e) = log2(N / n(e)),   PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))

where n counts documents and n(t, e) those that hold both, wherever in the text. A term with PMI >= DISCLOSES * IC(e)
tells the entity almost as well as naming it, also where both stand in one text only; it becomes a span of kind `term`
at each of its occurrences in the documents that hold e. `sanitize` generalises base spans to their kind and removes
terms.

Only SQL functions. Positions come from the lengths of what lies between matches, in code points. Null text is empty;
null ids and repeated rows are judged by (id, text), and each row counts as a document; an empty table gives an empty
result. Term statistics are partial counts over all documents. As PMI >= DISCLOSES * IC(e) is the same as
n(t) <= n(t, e) * (N / n(e))^(1 - DISCLOSES), terms that stand in more documents than that for each of their entities
(all usual words) leave before pairs are joined to their counts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: A run is tried once, from its beginning: possessive, as nothing after a run can also be part of it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"[\p{L}][\p{L}\p{N}]{2,}"
DISCLOSES = 0.9


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: starts, ends (exclusive, code points) and strings of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:long,e:long,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    match = span["m"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `spans_<kind>` for each kind: array<struct<s, e, m>>."""
    t = F.col(text)
    none = F.array().cast("array<struct<s:long,e:long,m:string>>")
    for kind in KINDS:
        hint = t.contains(HINTS[kind]) if kind in HINTS else t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        docs = docs.withColumn(f"spans_{kind}", F.when(hint, F.filter(spans_of(t, PATTERNS[kind]), partial(valid, kind))).otherwise(none))
    return docs


def _every(tag) -> Column:
    """All base spans, in order."""
    return F.array_sort(F.concat(*(F.transform(f"spans_{k}", partial(tag, k)) for k in KINDS)))


def outside(text: Column, every: Column) -> Column:
    """The text with base spans blanked: the same positions, without their words."""

    def step(acc: Column, x: Column) -> Column:
        s = F.greatest(acc["at"], x["s"])
        e = F.greatest(acc["at"], x["e"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(" "), (e - s).cast("int")))
        return F.struct(e.alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    blank = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(every) == 0, text).otherwise(blank)


def words_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _of_kind(kind: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), F.lower(x["m"])).alias("entity"))


def _tagged(tag: str, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(tag).alias("tag"))


def _revealing(mentions: DataFrame, n_e: DataFrame, n_t: DataFrame, documents: int) -> DataFrame:
    """(entity, term) pairs whose co-occurrence discloses the entity."""
    n = F.lit(float(documents))
    seen = mentions.groupBy("entity", "term").agg(F.sum("rows").alias("docs")).join(n_e, "entity")
    pairs = C.materialize(seen.withColumn("most", F.col("docs") * F.pow(n / F.col("n_e"), F.lit(1 - DISCLOSES))), "pairs")
    # a little more than the bound, so that rounding loses no term; the rule itself decides below
    rare = pairs.groupBy("term").agg(F.max("most").alias("bound")).join(n_t, "term").where(F.col("n_t") <= F.col("bound") * 1.000001)
    known = pairs.join(rare.select("term", "n_t"), "term")
    pmi = F.log2(n * F.col("docs") / (F.col("n_t") * F.col("n_e")))
    ic = F.log2(n / F.col("n_e"))
    return known.where((ic > 0) & (pmi >= DISCLOSES * ic)).select("entity", "term")


def _places(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """id, th, terms: where the terms of hits (id, th, term) stand in texts (id, th, t)."""
    some = hits.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows = texts.join(some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    found, gaps = F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.split("t", TERM, -1)
    pieces = F.filter(F.arrays_zip(found.alias("w"), F.transform(gaps, F.length).alias("g")), lambda x: x["w"].isNotNull())
    rows = rows.select("id", "th", F.posexplode(pieces).alias("i", "x"))
    rows = rows.select("id", "th", "i", F.lower("x.w").alias("word"), F.length("x.w").alias("n"), F.col("x.g").alias("g"))
    ends = F.sum((F.col("g") + F.col("n")).cast("long")).over(Window.partitionBy("id", "th").orderBy("i"))
    rows = rows.withColumn("e", ends).select("id", "th", "word", (F.col("e") - F.col("n")).alias("s"), "e")
    named = hits.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "term").distinct()
    rows = rows.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("word") == F.col("term")), "left_semi")
    return rows.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("terms"))


def disclosing_spans(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> id, th, spans of terms: array<struct<s, e>>, one row for each (id, text) that has some."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = base_spans(rows.withColumn("th", F.xxhash64("t")), "t").withColumn("every", _every(_of_kind))
    found = found.select("id", "th", outside(F.col("t"), F.col("every")).alias("t"), F.array_distinct(F.transform("every", lambda x: x["entity"])).alias("entities"))
    held = found.where(F.size("entities") > 0).groupBy("id", "th").agg(F.min(F.struct("t", "entities")).alias("x"), F.count(F.lit(1)).alias("rows"))
    held = C.materialize(held.select("id", "th", "x.t", "x.entities", "rows"), "held")
    if held.isEmpty():
        return spark.createDataFrame([], "id long, th long, terms array<struct<s:long,e:long>>")
    named = held.select("id", "th", "rows", "t", F.explode("entities").alias("entity"))
    mentions = named.select("id", "th", "rows", "entity", F.explode(words_of(F.col("t"))).alias("term"))
    n_e = named.groupBy("entity").agg(F.sum("rows").alias("n_e"))
    n_t = found.select(F.explode(words_of(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    pairs = C.materialize(_revealing(mentions, n_e, n_t, rows.count()), "revealing")
    hits = C.materialize(mentions.join(pairs, ["entity", "term"]).select("id", "th", "term").distinct(), "hits")
    return _places(held.select("id", "th", "t"), hits)


def _found(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), t (null: empty), spans_<kind> and terms (array<struct<s, e>>)."""
    terms = C.materialize(disclosing_spans(docs), "terms").select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("terms").alias("_terms"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t"))
    rows = base_spans(rows.withColumn("th", F.xxhash64("t")), "t")
    joined = rows.join(terms, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.withColumn("terms", F.coalesce("_terms", F.array().cast("array<struct<s:long,e:long>>"))).drop("_id", "_th", "_terms", "id", "th")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans_<kind> (array<struct<s, e, m>>) and terms (array<struct<s, e>>) of every row."""
    return _found(docs).select("row.doc_id", "row.text", *(f"spans_{k}" for k in KINDS), "terms")


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with the text's base spans generalised to [EMAIL], [IP], [CARD], [PHONE] and its terms removed.

    Where spans overlap, the first by start counts and the rest of the later one goes with it. Null text stays null.
    Columns of any name pass as they are.
    """
    tagged = [F.transform(f"spans_{k}", partial(_tagged, f"[{k.upper()}]")) for k in KINDS]
    tagged.append(F.transform("terms", partial(_tagged, "")))
    t = F.col("t")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        more = F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), x["tag"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("every", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    found = _found(docs).withColumn("every", F.array_sort(F.concat(*tagged)))
    found = found.withColumn("clean", F.when(F.size("every") == 0, F.col("row.text")).otherwise(clean))
    return found.select(*(F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*(written(k, F.col(f"spans_{k}")) for k in KINDS))
    every = F.concat(base, written("term", F.col("terms")))
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"))
