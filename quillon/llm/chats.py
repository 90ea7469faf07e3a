"""Chat formatting with linked tool calls, in DataFrame functions alone.

Messages are rows (conv_id, turn, role, text). An assistant message with tool calls is a JSON object {"content", "tool_calls": [{"id",
"name", "arguments"}]}, a tool's answer one of {"tool_call_id", "content"}; any other text is content as it stands. Calls and answers
are hash-joined on (conv_id, identifier). An argument that is as a whole the string "$other", where `other` is a call of the same
conversation, refers to that call's answer; calls are ordered topologically by these references, level by level. Arguments are
validated against schemas (name, parameter, type, required). Every message is serialised as canonical JSON: keys in order, no white
space, further fields kept. Output stays one row a message, so a conversation of any length needs no task of its own.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import clashing, written

#: Types a schema may name, and how the types of JSON values begin.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
SCHEMA = "name string, parameter string, type string, required boolean"
#: A JSON string that is a value, not a key, and begins with "$".
REFERENCE = r'(?<!\\)"\$([^"\\]+)"(?=[,\]}])'
#: Rounds of ordering after which the levels found so far are written as one table, so that the plan doesn't grow with the chain.
GATHERED = 16
#: A message; `row` tells apart rows that share conversation and turn.
MESSAGE = ["conv_id", "turn", "row"]
CALL = [*MESSAGE, "k"]


def messages(conversations: DataFrame) -> DataFrame:
    """conversations with `row` (a hash of role and text), `said` (map of the fields of a message of ours, else null), `answers_to` (a
    tool message's call) and `made` (array of an assistant message's calls)."""
    rows = clashing(conversations, "conv_id", "turn", "role", "text").withColumn("row", F.xxhash64("role", "text"))
    parsed = rows.withColumn("v", F.when(F.col("role").isin("assistant", "tool") & F.col("text").startswith("{"), F.expr("try_parse_json(text)")))
    made = F.when(F.col("role") == "assistant", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"))
    answers = F.when(F.col("role") == "tool", F.expr("try_variant_get(v, '$.tool_call_id', 'string')"))
    found = parsed.select("conv_id", "turn", "row", "role", "text", F.expr("try_cast(v as map<string, variant>)").alias("said"), made.alias("made"), answers.alias("answers_to"))
    return found.withColumn("said", F.when(F.col("made").isNotNull() | F.col("answers_to").isNotNull(), F.col("said")))


def calls(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, row, k, id, name, arguments variant, node): each call once, though its row be repeated. `node` names it in the order:
    its identifier, or its place where it has none."""
    once = parsed.where("made is not null").select(*MESSAGE, "made").groupBy(*MESSAGE).agg(F.first("made").alias("made"))
    each = once.select(*MESSAGE, F.posexplode("made").alias("k", "c"))
    field = lambda name, kind: F.expr(f"try_variant_get(c, '$.{name}', '{kind}')")
    found = each.select(*CALL, field("id", "string").alias("id"), field("name", "string").alias("name"), field("arguments", "variant").alias("arguments"))
    return found.withColumn("node", F.coalesce("id", F.concat_ws("\u0001", F.lit(""), "turn", "row", "k")))


def validated(made: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, row, k, n_errors): missing required parameters, wrong types and parameters or names that no schema knows."""
    kinds = F.expr("transform_values(try_cast(arguments as map<string, variant>), (k, v) -> schema_of_variant(v))")
    given = made.select(*CALL, "name", F.explode_outer(kinds).alias("parameter", "kind"))
    pattern = F.lit("^$")
    for name, begins in TYPES.items():
        pattern = F.when(F.col("type") == name, F.lit(f"^({begins})")).otherwise(pattern)
    rules = schemas.select("name", "parameter", "required", pattern.alias("pattern")).dropDuplicates(["name", "parameter"])
    checked = given.where("parameter is not null").join(rules, ["name", "parameter"], "left")
    wrong = checked.where(F.col("pattern").isNull() | ~F.coalesce(F.rlike("kind", "pattern"), F.lit(False))).select(*CALL)
    needed = made.select(*CALL, "name").join(rules.where("required"), "name").select(*CALL, "parameter")
    missing = needed.join(given.select(*CALL, "parameter"), [*CALL, "parameter"], "left_anti").select(*CALL)
    unknown = made.join(rules.select("name").distinct(), "name", "left_anti").select(*CALL)
    broken = made.where("arguments is null or schema_of_variant(arguments) not like 'OBJECT%'").select(*CALL)
    return wrong.unionByName(missing).unionByName(unknown).unionByName(broken).groupBy(*CALL).agg(F.count("*").alias("n_errors"))


def ordered(made: DataFrame) -> DataFrame:
    """(conv_id, node, level int): 0 for calls that refer to no other, else one more than the highest they refer to; null where the
    references run in a circle. Calls of one identifier share a level. Ends when a round finds no new level, however long the chain."""
    nodes = made.select("conv_id", "node").distinct()
    refs = made.select("conv_id", "node", F.explode(F.regexp_extract_all(F.to_json("arguments"), F.lit(REFERENCE), F.lit(1))).alias("ref")).distinct()
    known = made.where("id is not null").select("conv_id", F.col("id").alias("ref")).distinct()
    uses = written(refs.join(known, ["conv_id", "ref"]), "chat-uses")
    if uses.isEmpty():
        return nodes.select("conv_id", "node", F.lit(0).alias("level"))
    at = ["conv_id", "node"]
    wanted = uses.groupBy(*at).agg(F.count("*").alias("n"))
    done = written(nodes.join(wanted, at, "left_anti").select(*at, F.lit(0).alias("level")), "chat-level")
    for level in itertools.count(1):
        met = uses.join(done.select("conv_id", F.col("node").alias("ref")), ["conv_id", "ref"])
        ready = met.groupBy(*at).agg(F.count("*").alias("m")).join(wanted, at).where("m = n")
        new = written(ready.join(done, at, "left_anti").select(*at, F.lit(level).alias("level")), "chat-level")
        if new.isEmpty():
            break
        done = done.unionByName(new)
        if level % GATHERED == 0:
            done = written(done, "chat-level")
    return nodes.join(done, at, "left")


def _sorted(fields: Column) -> Column:
    order = lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields), order)))


def _line() -> Column:
    """Canonical JSON of a message: an object of ours with its role and a content, or content and role of any other."""
    role = F.create_map(F.lit("role"), F.expr("cast(role as variant)"))
    blank = F.when(F.map_contains_key("said", F.lit("content")), F.expr("cast(map() as map<string, variant>)")).otherwise(F.create_map(F.lit("content"), F.expr("parse_json('null')")))
    ours = F.map_concat(F.map_filter("said", lambda k, v: k != "role"), blank, role)
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    return F.when(F.col("said").isNotNull(), _sorted(ours)).otherwise(plain)


def formatted(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_errors, level, status, line), one row a message.

    n_linked counts calls that a later message answers; level is the topological level of an assistant message's highest call, 0
    otherwise; status is "ok", "orphan" (an answer without an earlier call), "unordered" (a call in a circle of references), "invalid"
    (arguments against the schemas; not looked at without schemas) or "unanswered" (a call without a later answer), the first in this
    order that holds. A call may be answered more than once. Null texts are null content; texts that are no JSON of ours are content
    whatever they look like and however long; repeated rows stay repeated with their calls counted once, other rows of the same turn
    are messages of their own; null identifiers link with nothing, and messages without turn or conversation count no calls; an empty table gives no rows; further
    columns are ignored.
    """
    parsed = messages(conversations)
    made = written(calls(parsed), "chat-calls")
    answers = parsed.where("answers_to is not null").groupBy("conv_id", F.col("answers_to").alias("id")).agg(F.max("turn").alias("last"))
    told = made.join(answers, ["conv_id", "id"], "left").join(ordered(made), ["conv_id", "node"], "left")
    if schemas is None:
        told = told.withColumn("n_errors", F.lit(0).cast("long"))
    else:
        told = told.join(validated(made, schemas), CALL, "left")
    summed = told.groupBy(*MESSAGE).agg(F.count("*").alias("n_calls"), F.count_if(F.col("last") > F.col("turn")).alias("n_linked"), F.sum(F.coalesce("n_errors", F.lit(0))).alias("n_errors"), F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("circles"))
    firsts = made.groupBy("conv_id", F.col("id").alias("answers_to")).agg(F.min("turn").alias("asked"))
    rows = parsed.join(summed, MESSAGE, "left").join(firsts, ["conv_id", "answers_to"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    orphan = F.col("answers_to").isNotNull() & ~F.coalesce(F.col("asked") < F.col("turn"), F.lit(False))
    status = F.when(orphan, "orphan").when(count("circles") > 0, "unordered").when(count("n_errors") > 0, "invalid").when(count("n_calls") > count("n_linked"), "unanswered").otherwise("ok")
    return rows.select("conv_id", "turn", "role", *[count(c).alias(c) for c in ("n_calls", "n_linked", "n_errors")], F.coalesce("level", F.lit(0)).alias("level"), status.alias("status"), _line().alias("line"))


#: Of the query: the calls derived from the conversations, and the schema of the tool they call.
TOOL = [("lookup", "query", "string", True), ("lookup", "size", "integer", True)]


def with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations, and each again under the number -1 - conv_id with tool calls: assistants call a tool `lookup` and users answer
    the turn before. By the length of its text a call is valid, lacks a parameter, has one of another type or refers to the call two
    turns before; the order has so chains, and answers to nobody where roles don't alternate."""
    n = F.char_length("text")
    query = F.when(n % 4 == 3, F.concat(F.lit("$c"), (F.col("turn") - 2).cast("string"))).otherwise(F.concat(F.lit("q"), n.cast("string")))
    named = lambda arguments: F.to_json(F.struct(F.lit("lookup").alias("name"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), arguments))
    full, short, other = F.struct(F.lit(5).alias("size"), query.alias("query")), F.struct(query.alias("query")), F.struct(F.lit(7).alias("query"), F.lit(5).alias("size"))
    call = F.when(n % 4 == 1, named(short.alias("arguments"))).when(n % 4 == 2, named(other.alias("arguments"))).otherwise(named(full.alias("arguments")))
    quoted = F.to_json(F.struct(F.col("text").alias("content")))
    asks = F.concat(F.lit('{"tool_calls":['), call, F.lit('],"note":1,'), F.substring(quoted, F.lit(2), F.char_length(quoted)))
    gives = F.concat(F.lit('{"tool_call_id":"c'), (F.col("turn") - 1).cast("string"), F.lit('",'), F.substring(quoted, F.lit(2), F.char_length(quoted)))
    calling, answering = (F.col("role") == "assistant") & F.col("text").isNotNull(), (F.col("role") == "user") & (F.col("turn") > 0) & F.col("text").isNotNull()
    rows = conversations.select("conv_id", "turn", "role", "text")
    derived = rows.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", F.when(answering, "tool").otherwise(F.col("role")).alias("role"), F.when(calling, asks).when(answering, gives).otherwise(F.col("text")).alias("text"))
    return rows.unionByName(derived)


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as they are (they hold no calls), and all once more with derived calls, so that linking, order and validation work
    on every row."""
    return formatted(with_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), spark.createDataFrame(TOOL, SCHEMA))


_JSON = "CAST(to_json({}) AS VARCHAR)"
#: Written from the rules above, not from the operator: calls by turn, errors by case, levels by recursion along the chain.
ORACLE = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
c AS (SELECT DISTINCT conv_id, turn, n % 4 AS kind FROM m WHERE role = 'assistant' AND text IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, turn FROM c),
e AS (SELECT DISTINCT c.conv_id, c.turn FROM c JOIN ids b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 WHERE c.kind = 3),
lv(conv_id, turn, level) AS (SELECT i.conv_id, i.turn, 0 FROM ids i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = i.conv_id AND e.turn = i.turn)
  UNION ALL SELECT e.conv_id, e.turn, lv.level + 1 FROM lv JOIN e ON e.conv_id = lv.conv_id AND e.turn = lv.turn + 2),
a AS (SELECT DISTINCT conv_id, turn - 1 AS call FROM m WHERE role = 'user' AND turn > 0 AND text IS NOT NULL),
p AS (SELECT conv_id, turn, role, 0 AS n_calls, 0 AS n_linked, 0 AS n_errors, 0 AS level, 'ok' AS status, '{{"content":' || coalesce({_JSON.format('text')}, 'null') || ',"role":' || coalesce({_JSON.format('role')}, 'null') || '}}' AS line FROM m),
q AS (SELECT m.*, a.call IS NOT NULL AS answered, coalesce(lv.level, 0) AS level,
        CASE WHEN n % 4 = 1 THEN '{{"query":"q' || n || '"}}' WHEN n % 4 = 2 THEN '{{"query":7,"size":5}}' WHEN n % 4 = 3 THEN '{{"query":"$c' || (m.turn - 2) || '","size":5}}' ELSE '{{"query":"q' || n || '","size":5}}' END AS arguments
      FROM m LEFT JOIN a ON a.conv_id = m.conv_id AND a.call = m.turn LEFT JOIN lv ON lv.conv_id = m.conv_id AND lv.turn = m.turn WHERE role = 'assistant' AND text IS NOT NULL),
x AS (SELECT -1 - conv_id AS conv_id, turn, role, 1 AS n_calls, CAST(answered AS INTEGER) AS n_linked, CASE WHEN n % 4 IN (1, 2) THEN 1 ELSE 0 END AS n_errors, level,
        CASE WHEN n % 4 IN (1, 2) THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
        '{{"content":' || {_JSON.format('text')} || ',"note":1,"role":"assistant","tool_calls":[{{"arguments":' || arguments || ',"id":"c' || turn || '","name":"lookup"}}]}}' AS line FROM q),
y AS (SELECT -1 - m.conv_id AS conv_id, m.turn, 'tool' AS role, 0 AS n_calls, 0 AS n_linked, 0 AS n_errors, 0 AS level, CASE WHEN i.turn IS NULL THEN 'orphan' ELSE 'ok' END AS status,
        '{{"content":' || {_JSON.format('text')} || ',"role":"tool","tool_call_id":"c' || (m.turn - 1) || '"}}' AS line
      FROM m LEFT JOIN ids i ON i.conv_id = m.conv_id AND i.turn = m.turn - 1 WHERE m.role = 'user' AND m.turn > 0 AND m.text IS NOT NULL)
SELECT conv_id, turn, role, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, CAST(n_errors AS BIGINT) AS n_errors, CAST(level AS INTEGER) AS level, status, line
FROM (SELECT * FROM p UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y
  UNION ALL SELECT -1 - conv_id, turn, role, 0, 0, 0, 0, 'ok', '{{"content":' || coalesce({_JSON.format('text')}, 'null') || ',"role":' || coalesce({_JSON.format('role')}, 'null') || '}}' FROM m
    WHERE NOT coalesce(text IS NOT NULL AND (role = 'assistant' OR role = 'user' AND turn > 0), FALSE))"""
