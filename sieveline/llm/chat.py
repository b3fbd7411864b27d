"""Op 10 [native]: tool calls linked to their results, as canonical JSON.

`link` hash-joins calls and results by identifier, orders them topologically, validates the calls' arguments against
a schema and writes every message as one canonical JSON object (keys sorted, no white space, nulls left out).

Order: a message's place is (anchor, step, its own turn). A plain message or call is anchored at its own turn, a result
at its call's, a step later, so that it stands after its call even where it came before it. Calls may name the results
they need (`needs`, identifiers of calls of the same conversation): where a needed result would stand behind its call,
the call moves behind it, round by round, each round a join over the edges that are still out of order. A call that
moves on past as many calls as there are stands on a cycle, or behind one: it is flagged, stays, and holds up nobody. Places are sort keys, not ranks, so that no conversation has to fit in one task.

A result without call, all but the first result of a call (by turn, then by hash of the body), a call without result
and a repeated call identifier are flagged. Rows that equal another result of their call in turn and body cannot be told
apart, so none of them is the first. A null kind is plain; a call or result without conversation or identifier has no
identifier. Schemas name the arguments with their type (string, number, boolean, array, object), whether they are
required and the most characters of a string. Null or unparsable arguments are invalid; unknown arguments are, too.
Columns of other names are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: tool -> argument -> (type, required, most characters)
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {"reply": {"prompt": ("string", True, 4000), "words": ("number", True, None)}}
KINDS = {"string": "^STRING$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def valid(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether a JSON object of arguments satisfies the schema of its tool."""
    v = F.try_parse_json(arguments)
    out = F.lit(False)
    for name, fields in schemas.items():
        ok = F.schema_of_variant(v).rlike("^OBJECT")
        names = F.json_object_keys(arguments)
        ok &= F.size(F.array_except(names, F.array(*(F.lit(f) for f in fields)).cast("array<string>"))) == 0
        ok &= F.size(names) == F.size(F.array_distinct(names))
        for field, (kind, required, most) in fields.items():
            value = F.try_variant_get(v, f"$.{field}", "variant")
            right = F.schema_of_variant(value).rlike(KINDS[kind])
            if most is not None:
                right &= F.length(F.try_variant_get(v, f"$.{field}", "string")) <= most
            ok &= F.coalesce(right, F.lit(not required))
        out = F.when(tool == name, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical(arguments: Column) -> Column:
    """The JSON with sorted keys and without white space; null if it does not parse."""
    return F.to_json(F.try_parse_json(arguments))


def _identified(rows: DataFrame) -> DataFrame:
    """conv_id, call_id, call_turn, n_calls, n_results, first (turn and hash of the first result) and same (rows equal to it)."""
    each = rows.where("kind <> 'plain' AND conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id", "kind", "turn", "h").agg(F.count(F.lit(1)).alias("n"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    return each.groupBy("conv_id", "call_id").agg(
        F.min(F.when(is_call, F.col("turn"))).alias("call_turn"),
        F.coalesce(F.sum(F.when(is_call, F.col("n"))), F.lit(0)).alias("n_calls"),
        F.coalesce(F.sum(F.when(is_result, F.col("n"))), F.lit(0)).alias("n_results"),
        F.min(F.when(is_result, F.struct(F.col("turn").isNull().alias("late"), "turn", "h", "n"))).alias("first"),
    )


def _moved(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, needs) -> conv_id, call_id, at, depth, cyclic of those that move or lie on a cycle."""
    keys = ["conv_id", "call_id"]
    place = C.materialize(calls.select(*keys, F.col("turn").alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic")), "places")
    needs = calls.select(*keys, F.explode(F.array_distinct("needs")).alias("need")).where("need IS NOT NULL")
    sizes = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("most"))
    edges = C.materialize(needs.join(sizes, "conv_id"), "needs")
    while True:
        of = place.where("NOT cyclic").select("conv_id", F.col("call_id").alias("need"), F.struct("at", "depth").alias("before"))
        now = place.where("NOT cyclic").select(*keys, F.struct("at", "depth").alias("now"))
        late = edges.join(of, ["conv_id", "need"]).join(now, keys).where(F.col("before") >= F.col("now"))
        late = C.materialize(late.groupBy(*keys).agg(F.max("before").alias("before"), F.max("most").alias("most")), "late")
        if late.isEmpty():
            return place.where("cyclic OR depth > 0")
        # no path of calls is longer than there are calls: who moves further stands on or behind a cycle
        new = place.join(late, keys, "left")
        moves = F.col("before").isNotNull()
        lost = moves & (F.col("before.depth") >= F.col("most"))
        place = C.materialize(new.select(*keys, F.when(moves, F.col("before.at")).otherwise(F.col("at")).alias("at"), F.when(moves, F.col("before.depth") + 1).otherwise(F.col("depth")).alias("depth"), (F.col("cyclic") | lost).alias("cyclic")), "places")


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """messages (conv_id, turn, kind: call / result / plain, call_id, tool, body, perhaps needs) -> one row for each, with place and json."""
    kind = F.when(F.col("kind").isin("call", "result"), F.col("kind")).otherwise("plain")
    rows = messages.select("conv_id", "turn", kind.alias("kind"), "call_id", "tool", "body", *(["needs"] if "needs" in messages.columns else [])).withColumn("h", F.xxhash64("body"))
    ids = _identified(rows)
    if "needs" in messages.columns:
        single = ids.where("n_calls = 1").select("conv_id", "call_id")
        calls = rows.where("kind = 'call'").join(single, ["conv_id", "call_id"]).select("conv_id", "call_id", "turn", "needs")
        ids = ids.join(_moved(calls), ["conv_id", "call_id"], "left")
    else:
        ids = ids.select("*", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("boolean").alias("cyclic"))
    rows = rows.join(ids.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.coalesce((is_call & (F.col("n_results") > 0)) | (is_result & (F.col("n_calls") > 0)), F.lit(False))
    mine = F.struct(F.col("turn").isNull().alias("late"), "turn", "h")
    first = mine.eqNullSafe(F.struct("first.late", "first.turn", "first.h")) & (F.col("first.n") == 1)
    cyclic = F.coalesce("cyclic", F.lit(False))
    state = (
        F.when(F.col("kind") == "plain", F.lit(None).cast("string"))
        .when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no identifier")
        .when(is_call & (F.col("n_calls") > 1), "repeated call")
        .when(is_call & cyclic, "cyclic")
        .when(is_call & ~linked, "no result")
        .when(is_result & ~linked, "no call")
        .when(is_result & ~first, "repeated result")
        .otherwise("linked")
    )
    moved = F.col("at").isNotNull() & ~cyclic
    anchor = F.when((is_call | is_result) & moved, F.col("at")).when(is_result & linked, F.col("call_turn")).otherwise(F.col("turn"))
    step = is_result.cast("int") + F.when((is_call | is_result) & moved, 2 * F.col("depth")).otherwise(0)
    rows = rows.withColumns({"state": state, "anchor": anchor, "step": step, "valid": F.when(is_call, valid(F.col("tool"), F.col("body"), schemas))})
    text = F.struct(
        F.when(is_call, canonical(F.col("body"))).alias("arguments"),
        F.col("call_id").alias("call_id"),
        F.when(~is_call, F.col("body")).alias("content"),
        F.col("kind").alias("kind"),
        F.col("tool").alias("tool"),
    )
    return rows.select("conv_id", "turn", "kind", "call_id", "state", "valid", "anchor", "step", F.to_json(text, {"ignoreNullFields": "true"}).alias("json"))


def turns(conversations: DataFrame) -> DataFrame:
    """A conversation table as messages: a user turn calls `reply`, the assistant turn after it is its result."""
    text, role = F.col("text").cast("string"), F.col("role")
    kind = F.when(role == "user", "call").when(role == "assistant", "result").otherwise("plain")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    body = F.when(role == "user", F.when(text.isNotNull(), F.to_json(F.struct(words.alias("words"), text.alias("prompt"))))).otherwise(text)
    call = F.when(role == "user", F.col("turn")).when(role == "assistant", F.col("turn") - 1)
    call_id = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), call.cast("string"))
    return conversations.select("conv_id", "turn", F.coalesce(kind, F.lit("plain")).alias("kind"), call_id.alias("call_id"), F.when(role.isin("user", "assistant"), "reply").alias("tool"), body.alias("body"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(turns(C.table(spark, sf_dir, "conversations")))


OP10_SQL = """
WITH m AS (
  SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'plain' END AS kind,
         'call_' || conv_id || '_' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id,
         len(list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')) AS words
  FROM conversations),
k AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (kind = 'result') AS n_results
  FROM m WHERE call_id IS NOT NULL GROUP BY conv_id, call_id)
SELECT m.conv_id, m.turn, m.kind, m.call_id,
       CASE WHEN m.kind = 'plain' THEN NULL WHEN m.call_id IS NULL THEN 'no identifier' WHEN m.kind = 'call' AND n_calls > 1 THEN 'repeated call'
            WHEN m.kind = 'call' AND n_results = 0 THEN 'no result' WHEN m.kind = 'result' AND n_calls = 0 THEN 'no call'
            WHEN m.kind = 'result' AND n_results > 1 THEN 'repeated result' ELSE 'linked' END AS state,
       CASE WHEN m.kind = 'call' THEN coalesce(length(text) <= 4000, false) END AS valid,
       CASE WHEN m.kind = 'result' AND n_calls > 0 THEN call_turn ELSE m.turn END AS anchor,
       CASE WHEN m.kind = 'result' THEN 1 ELSE 0 END AS step,
       '{' || concat_ws(',',
         CASE WHEN m.kind = 'call' AND text IS NOT NULL THEN '"arguments":' || CAST(to_json('{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '}') AS VARCHAR) END,
         CASE WHEN m.call_id IS NOT NULL THEN '"call_id":"' || m.call_id || '"' END,
         CASE WHEN m.kind <> 'call' AND text IS NOT NULL THEN '"content":' || CAST(to_json(text) AS VARCHAR) END,
         '"kind":"' || m.kind || '"',
         CASE WHEN m.kind <> 'plain' THEN '"tool":"reply"' END) || '}' AS json
FROM m LEFT JOIN k ON m.conv_id = k.conv_id AND m.call_id = k.call_id
"""
