"""Chat formatting: tool-call linking.

Method: results are reduced to one for each call of a conversation (the first by turn), then hash-joined to the calls by
conversation and identifier; calls are ordered topologically by what they come after; arguments are validated against the
tool's schema; every linked call is serialised as canonical JSON (keys sorted, no spaces, UTF-8 as it is).

A call's level is 0 if it waits for no other call of its conversation, else one more than the highest level it waits for; (level, turn,
identifier) is a topological order of a conversation. The waits of a conversation are counted: up to ``MOST_WAITS``, which one task
surely holds, they are sorted in one go; longer conversations are found in rounds of joins, one for each level, and are never
gathered. Both give the same levels. One JSON text is made for each call, not for each conversation. The order comes from a range
sort on (conversation, level, turn), which splits a hot conversation.

Defined cases: a call without a result has status ``no_result``, a result without a call is a row of status ``no_call``
with null level and arguments. Identifiers are of one conversation: two conversations may use the same. A call with a null
identifier or conversation links to nothing and has level 0. Of several results the first by (turn, content) counts, and n_results
says how many there were; calls that repeat an identifier each get it. Identifiers that nobody has, and null ones, are not
waited for. Calls in a cycle, and those that wait for one, have a null level. Arguments that are null (a JSON null too), not JSON or not to the schema
have args_valid false; they are serialised as null if they are not JSON. Numbers out of a double's range, NaN and integers of more than
4300 digits are not JSON here. A lone surrogate stays as its escape. An unknown tool has no valid arguments. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import append_columns, cut, table

#: Waits of a conversation that are sorted in one task.
MOST_WAITS = 50_000

#: The tools of ``op7_chat_format``.
SCHEMAS = {
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}, "additionalProperties": False},
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    },
}

_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def same(a, b) -> bool:
    """Whether two JSON values are equal: true and false equal no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def valid(value, schema: dict) -> bool:
    """Whether ``value`` is to a JSON schema of type, enum, const, bounds, lengths, properties, required and items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds and not any(
        (k == "number" and number) or (k == "integer" and number and (isinstance(value, int) or value.is_integer())) or isinstance(value, _TYPES.get(k, ())) for k in kinds
    ):
        return False
    if "enum" in schema and not any(same(value, v) for v in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return False
    if number and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return False
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf) and all(valid(v, schema.get("items", {})) for v in value)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        return (
            all(k in value for k in schema.get("required", []))
            and (schema.get("additionalProperties", True) or all(k in own for k in value))
            and all(valid(v, own[k]) for k, v in value.items() if k in own)
        )
    return True


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _reject(_):
    raise ValueError("not JSON")


def _finite(digits: str) -> float:
    x = float(digits)
    return x if math.isfinite(x) else _reject(digits)


def parsed(arguments: str | None):
    """The value of a JSON text, None if it isn't one."""
    try:
        return None if arguments is None else json.loads(arguments, parse_constant=_reject, parse_float=_finite)
    except (ValueError, RecursionError):
        return None


def sorted_levels(waits: list[tuple[str, str]]) -> dict[str, int | None]:
    """The level of every identifier that waits for another one, from (identifier, what it waits for); None in or behind a cycle."""
    behind, left = {}, {}
    for call, dep in waits:
        behind.setdefault(dep, []).append(call)
        left[call] = left.get(call, 0) + 1
    level = dict.fromkeys(left)
    ready = [(dep, 0) for dep in behind if dep not in left]
    for dep, n in ready:  # grows as it goes: by level, since what is freed stands one above what frees it last
        for call in behind.get(dep, ()):
            left[call] -= 1
            if not left[call]:
                level[call] = n + 1
                ready.append((call, n + 1))
    return level


def levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of every identifier that waits for another one of its conversation; null in or behind a cycle."""
    own = calls.filter("conv_id is not null and call_id is not null")
    known = own.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("dep")).distinct()
    waits = own.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), F.explode("after").alias("dep")).distinct()
    waits = cut(waits.join(known, ["conv", "dep"], "left_semi").select("conv", "id", "dep"), "chat-waits")
    long = cut(waits.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_WAITS).select("conv"), "chat-long")
    some_long = not long.isEmpty()
    short = waits.join(long, "conv", "left_anti") if some_long else waits
    gathered = short.groupBy("conv").agg(F.collect_list(F.struct("id", "dep")).alias("waits"))

    def make():
        def fn(found):
            got = [sorted_levels([(w["id"], w["dep"]) for w in waits]) for waits in found]
            return [list(g) for g in got], [list(g.values()) for g in got]

        return fn

    rows = append_columns(gathered, "waits", make, [("ids", "strings"), ("levels", "ints")], ["waits"])
    out = rows.select("conv", F.explode(F.arrays_zip("ids", "levels")).alias("l")).select("conv", F.col("l.ids").alias("id"), F.col("l.levels").alias("level"))
    return out.unionByName(level_rounds(waits.join(long, "conv", "left_semi"), known)) if some_long else out


def level_rounds(waits: DataFrame, known: DataFrame) -> DataFrame:
    """As ``levels``, by joins alone: each round frees the calls that wait for none but those freed before."""
    ids = waits.select("conv", "id").distinct()
    ready = known.withColumnRenamed("dep", "id").join(ids, ["conv", "id"], "left_anti")
    done, level = None, 0
    while not waits.isEmpty():
        level += 1
        left = cut(waits.join(ready.withColumnRenamed("id", "dep"), ["conv", "dep"], "left_anti"), "chat-waits")
        freed = waits.select("conv", "id").distinct().join(left.select("conv", "id").distinct(), ["conv", "id"], "left_anti")
        freed = cut(freed.withColumn("level", F.lit(level)), "chat-levels")
        if freed.isEmpty():
            freed, left = waits.select("conv", "id").distinct().withColumn("level", F.lit(None).cast("int")), left.limit(0)
        done = freed if done is None else done.unionByName(freed)
        ready, waits = freed.select("conv", "id"), left
    return done if done is not None else ids.withColumn("level", F.lit(None).cast("int"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, call_id, level, status, args_valid, n_results and json of every call and unclaimed result.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (identifiers). ``results``: conv_id, turn,
    call_id, content. In topological order: sorted by conv_id, level, turn, call_id.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "name", "arguments", "after")
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content"))
    named = results.filter("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").alias("__conv"), F.col("call_id").alias("__id"))
    first = named.agg(F.min(F.struct("turn", "content")).alias("__first"), F.count(F.lit(1)).alias("n_results"))
    level = levels(calls).withColumnsRenamed({"conv": "__level_conv", "id": "__level_id"})
    same = lambda conv, name: (F.col("conv_id") == F.col(conv)) & (F.col("call_id") == F.col(name))
    linked = calls.join(first, same("__conv", "__id"), "left").join(level, same("__level_conv", "__level_id"), "left")
    linked = linked.select(
        "conv_id",
        "turn",
        "call_id",
        F.when(F.col("__level_id").isNull(), 0).otherwise(F.col("level")).cast("int").alias("level"),
        F.when(F.col("__id").isNull(), "no_result").otherwise("linked").alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "name",
        "arguments",
        F.col("__first.content").alias("content"),
    )
    ids = calls.select(F.col("conv_id").alias("__conv"), F.col("call_id").alias("__id")).distinct()
    orphans = results.join(ids, same("__conv", "__id"), "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("int").alias("level"), F.lit("no_call").alias("status"), F.lit(1).cast("long").alias("n_results"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content",
    )

    def make():
        def fn(ids, levels, names, arguments, contents, statuses):
            good, out = [], []
            for call_id, lev, name, args, content, status in zip(ids, levels, names, arguments, contents, statuses, strict=True):
                value = parsed(args)
                ok = args is not None and value is not None and name in schemas and valid(value, schemas[name])
                good.append(None if status == "no_call" else ok)
                out.append(canonical({"arguments": value, "id": call_id, "level": lev, "name": name, "result": content, "valid": good[-1]}))
            return good, out

        return fn

    inputs = ["call_id", "level", "name", "arguments", "content", "status"]
    rows = append_columns(linked.unionByName(orphans), inputs, make, [("args_valid", "boolean"), ("json", "string")], drop=["name", "arguments", "content"])
    return rows.orderBy("conv_id", "level", "turn", "call_id")


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of (conv_id, turn, role, text): a user's message calls ``reply``, a system message
    ``configure``; an assistant's message is the result of the call one turn before. A user's call waits for a
    system message one turn before. Messages of another role, or of none, are neither calls nor results and give no row."""
    at = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    own = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), at(F.col("turn")))
    before = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), at(F.col("turn") - 1))
    user = F.col("role") == "user"
    arguments = F.to_json(F.struct("text", F.when(user, F.col("turn")).alias("turn")))
    asked = messages.filter(F.col("role").isin("user", "system"))
    # Only system calls are waited for: they have their own form of identifier.
    call_id = F.when(user, own).otherwise(F.concat(own, F.lit(":system")))
    after = F.when(user & before.isNotNull(), F.array(F.concat(before, F.lit(":system")))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", "turn", call_id.alias("call_id"), F.when(user, "reply").otherwise("configure").alias("name"), arguments.alias("arguments"), after.alias("after"))
    answered = messages.filter(F.col("role") == "assistant")
    return calls, answered.select("conv_id", "turn", before.alias("call_id"), F.col("text").alias("content"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results)


OP7_SQL = """
WITH calls AS (
  SELECT conv_id, turn, role, text,
         conv_id || ':' || turn || CASE WHEN role = 'system' THEN ':system' ELSE '' END AS call_id
  FROM conversations WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content
  FROM conversations WHERE role = 'assistant'
), firsts AS (
  SELECT call_id, min({'turn': turn, 'content': content}) AS f, count(*) AS n FROM results GROUP BY call_id
), linked AS (
  SELECT c.conv_id, c.turn, c.call_id,
         CAST(CASE WHEN s.call_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS level,
         CASE WHEN f.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         coalesce(f.n, 0) AS n_results,
         c.text IS NOT NULL AND (c.role = 'system' OR (c.text <> '' AND length(c.text) <= 2000 AND c.turn >= 0)) AS args_valid,
         CASE WHEN c.role = 'user' THEN 'reply' ELSE 'configure' END AS name,
         CASE WHEN c.text IS NULL THEN '{' ELSE '{"text":' || CAST(to_json(c.text) AS VARCHAR) || CASE WHEN c.role = 'user' THEN ',' ELSE '' END END
           || CASE WHEN c.role = 'user' THEN '"turn":' || c.turn ELSE '' END || '}' AS arguments,
         f.f.content AS content
  FROM calls c LEFT JOIN firsts f ON f.call_id = c.call_id
  LEFT JOIN (SELECT DISTINCT call_id FROM calls WHERE role = 'system') s
    ON c.role = 'user' AND s.call_id = c.conv_id || ':' || (c.turn - 1) || ':system'
  UNION ALL
  SELECT r.conv_id, r.turn, r.call_id, NULL, 'no_call', 1, NULL, NULL, NULL, r.content
  FROM results r WHERE r.call_id NOT IN (SELECT call_id FROM calls WHERE call_id IS NOT NULL)
)
SELECT conv_id, turn, call_id, level, status, n_results, args_valid,
       '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null')
       || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || coalesce('"' || name || '"', 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
       || ',"valid":' || coalesce(CAST(args_valid AS VARCHAR), 'null') || '}' AS json
FROM linked
"""
