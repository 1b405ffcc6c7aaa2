"""Linking tool calls to their results in conversations (operator 9). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored

# How a value of each declared kind may look to the parser.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
BLOCK = 1024


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def messages(conversations: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) in the form that ``link`` takes.

    An assistant text that is an object with ``tool_call`` (id, name,
    arguments, after) is a call, a text of role ``tool`` with ``tool_call_id``
    its result. In plain conversations a user turn calls ``reply`` after the
    user turn two before it, and the assistant turn that follows is the result.
    All else is a message.
    """
    outer = F.from_json("text", "tool_call struct<id:string,name:string,arguments:string,after:array<string>>, tool_call_id string, content string")
    looks = F.ltrim("text").startswith("{")
    call = F.when(looks & (F.col("role") == "assistant"), outer["tool_call"])
    result = F.when(looks & (F.col("role") == "tool"), outer["tool_call_id"])
    own = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id"), turn)
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    kind = F.when(F.col("call.id").isNotNull() | user, "call").when(F.col("result").isNotNull() | answer, "result").otherwise("message")
    arguments = F.to_json(F.struct("turn", F.col("text").alias("prompt")))
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("call", call)
        .withColumn("result", result)
        .withColumn("kind", kind)
        .select(
            "conv_id",
            "turn",
            "role",
            "kind",
            F.when(F.col("kind") == "call", F.coalesce("call.id", own(F.col("turn"))))
            .when(F.col("kind") == "result", F.coalesce("result", own(F.col("turn") - 1)))
            .alias("call_id"),
            F.when(F.col("kind") == "call", F.coalesce("call.name", F.lit("reply"))).alias("name"),
            F.when(F.col("kind") == "call", F.when(F.col("call.id").isNotNull(), F.col("call.arguments")).otherwise(arguments)).alias("arguments"),
            F.when(F.col("call.id").isNotNull(), F.coalesce("call.after", F.array().cast("array<string>")))
            .when(F.col("kind") == "call", F.filter(F.array(F.when(F.col("turn") >= 2, own(F.col("turn") - 2))), lambda x: x.isNotNull()))
            .otherwise(F.array().cast("array<string>"))
            .alias("after"),
            F.when(F.col("result").isNotNull(), outer["content"]).otherwise(F.col("text")).alias("content"),
        )
    )


def chains(singles: DataFrame) -> DataFrame:
    """(conv_id, call_id, head, steps) of calls with one call before them (conv_id, call_id, head): where their chain begins.

    Pointers double each round, so a chain of n calls takes log n rounds. A
    pointer that still leads into a chain after as many steps as there are
    calls runs in a circle, and its row is left out.
    """
    jumps = stored(singles.select("conv_id", "call_id", "head", F.lit(1).alias("steps")), "chains")
    most, reach = jumps.count(), 1
    while True:
        onward = jumps.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        met = jumps.join(onward, ["conv_id", "head"], "left")
        inside = F.col("next").isNotNull()
        if reach > most or met.filter(inside).isEmpty():
            return met.filter(~inside).select("conv_id", "call_id", "head", "steps")
        longer = met.select("conv_id", "call_id", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        jumps, reach = stored(longer, "chains"), reach * 2


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls (conv_id, call_id, after): one more than the deepest call before it.

    Calls with one predecessor are first gathered into chains, see ``chains``.
    Calls with several are then levelled from the heads of the chains before
    them, in as many rounds as such calls follow one another. Predecessors that
    do not exist are ignored. Calls on or behind a cycle keep a null level.
    """
    keys = ["conv_id", "call_id"]
    ids = calls.select(*keys)
    edges = calls.select(*keys, F.explode(F.array_distinct("after")).alias("before"))
    known = ids.select("conv_id", F.col("call_id").alias("before"))
    edges = stored(edges.join(known, ["conv_id", "before"]), "edges")
    counted = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("before").alias("head"))
    nodes = stored(ids.join(counted, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "head"), "nodes")
    chained = stored(chains(nodes.filter("n = 1").select(*keys, "head")), "chained")

    several = edges.join(nodes.filter("n > 1").select(*keys), keys)
    heads = nodes.select("conv_id", F.col("call_id").alias("before"), "n").join(
        chained.select("conv_id", F.col("call_id").alias("before"), "head", "steps"), ["conv_id", "before"], "left"
    )
    # A call before that begins a chain or has several before it is its own head; one in a circle has none.
    heads = heads.select("conv_id", "before", F.when(F.col("n") == 1, F.col("head")).otherwise(F.col("before")).alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"))
    several = stored(several.join(heads, ["conv_id", "before"]).select(*keys, "head", "steps"), "several")

    state, open_before = nodes.filter("n <> 1").select(*keys, F.when(F.col("n") == 0, 0).alias("level")), -1
    state = stored(state, "levels")
    while True:
        still = state.filter("level IS NULL").count()
        before = state.select("conv_id", F.col("call_id").alias("head"), "level")
        if still in (0, open_before):
            behind = chained.join(before, ["conv_id", "head"], "left").select(*keys, (F.col("level") + F.col("steps")).alias("level"))
            circles = nodes.filter("n = 1").join(chained, keys, "left_anti").select(*keys, F.lit(None).cast("int").alias("level"))
            return state.unionByName(behind).unionByName(circles)
        open_before = still
        ready = several.join(before, ["conv_id", "head"], "left").groupBy(*keys)
        ready = ready.agg((F.max(F.col("level") + F.col("steps")) + 1).alias("next"), F.every(F.col("level").isNotNull()).alias("all")).filter("all")
        state = stored(state.join(ready, keys, "left").select(*keys, F.coalesce("level", "next").alias("level")), "levels")


def checked(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``wrong``: what is amiss with the arguments of calls against the declared parameters of their tool."""
    declared = schemas.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("parameter", "kind", "required"))).alias("declared"))
    parsed = F.from_json("arguments", "map<string,variant>")
    kinds = F.transform_values(parsed, lambda _, v: F.schema_of_variant(v))
    fits = lambda kind, seen: F.coalesce(
        *[F.when(kind == name, seen.rlike(f"^(?:{pattern})$")) for name, pattern in KINDS.items()], F.lit(False)
    )
    one = lambda p: F.when(
        F.try_element_at("_kinds", p["parameter"]).isNull(), F.when(p["required"], F.concat(F.lit("missing "), p["parameter"]))
    ).when(~fits(p["kind"], F.try_element_at("_kinds", p["parameter"])), F.concat(F.lit("wrong kind of "), p["parameter"]))
    unknown = F.transform(
        F.array_except(F.map_keys("_kinds"), F.transform("declared", lambda p: p["parameter"])), lambda k: F.concat(F.lit("unknown "), k)
    )
    wrong = (
        F.when(F.col("declared").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("_kinds").isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.concat(F.filter(F.transform("declared", one), lambda x: x.isNotNull()), unknown))
    )
    none = F.array().cast("array<string>")
    return rows.join(declared, "name", "left").withColumn("_kinds", kinds).withColumn("wrong", F.when(F.col("kind") == "call", wrong).otherwise(none))


def link(items: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: its place after all that it depends on, its link, faults and canonical JSON.

    ``items`` as from ``messages``; ``schemas``: (name, parameter, kind,
    required). Calls and results meet by (conv_id, call_id). Of calls with one
    id the first turn is the call, of results the first is linked; the others
    are ``repeated``. ``status``: linked, unanswered (call), orphan (result),
    repeated, cyclic, unplaced (no conv_id or turn), message.

    ``position`` counts from 0 within the conversation by (level, turn, rows
    alike in any order): a call precedes its result and follows the calls it
    names. Cyclic rows come last. Rows without conv_id or turn have no position.
    Long conversations are numbered in blocks of turns, never in one task.
    """
    keys = ["conv_id", "call_id"]
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    items = items.withColumn("_content", F.xxhash64("kind", "content"))
    # Rows without a place meet nothing and are not numbered: they are added at the end as they are.
    columns = items.columns
    unplaced = items.filter(~placed).select(*columns, F.lit("unplaced").alias("status"), F.lit(None).cast("long").alias("position"))
    items = items.filter(placed)
    known = items.filter(F.col("call_id").isNotNull())
    calls = known.filter("kind = 'call'").groupBy(*keys).agg(F.min(F.struct("turn", "_content", "after")).alias("c"))
    calls = calls.select(*keys, F.col("c.turn").alias("call_turn"), F.col("c._content").alias("call_content"), F.col("c.after").alias("after"))
    results = known.filter("kind = 'result'").groupBy(*keys).agg(F.min(F.struct("turn", "_content")).alias("r"))
    results = results.select(*keys, F.col("r.turn").alias("result_turn"), F.col("r._content").alias("result_content"))
    both = calls.drop("after").join(results, keys, "full").join(levels(stored(calls, "calls").select(*keys, "after")), keys, "left")
    rows = items.join(stored(both, "links"), keys, "left")

    call, result = F.col("kind") == "call", F.col("kind") == "result"
    mine = F.when(call, (F.col("turn") == F.col("call_turn")) & (F.col("_content") == F.col("call_content"))).when(
        result, (F.col("turn") == F.col("result_turn")) & (F.col("_content") == F.col("result_content"))
    )
    exists = F.col("call_turn").isNotNull()
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(result & ~exists, "orphan")
        .when(~F.coalesce(mine, F.lit(False)), "repeated")
        .when(F.col("level").isNull(), "cyclic")
        .when(call & F.col("result_turn").isNull(), "unanswered")
        .otherwise("linked")
    )
    last = F.lit(2**31 - 1)
    depth = F.when(F.col("kind") == "message", 0).when(exists & F.col("level").isNotNull(), F.col("level") * 2 + result.cast("int"))
    depth = F.when(result & ~exists, 0).otherwise(F.coalesce(depth, last))
    rows = rows.withColumn("status", status).withColumn("depth", depth).withColumn("_block", F.floor(F.col("turn") / BLOCK))

    # Totals of stretches of depths first, then places inside a stretch: no window spans a long conversation.
    tally = rows.groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("_stretch"), "depth", "_block").agg(F.count("*").alias("_n"))
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = tally.groupBy("conv_id", "_stretch").agg(F.sum("_n").alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(before(["conv_id"], "_stretch")), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(before(["conv_id", "_stretch"], "depth", "_block")), F.lit(0))
    starts = tally.withColumn("_inside", inside).join(stretches.select("conv_id", "_stretch", earlier.alias("_earlier")), ["conv_id", "_stretch"])
    starts = starts.select("conv_id", "depth", "_block", (F.col("_earlier") + F.col("_inside")).alias("_start"))
    within = Window.partitionBy("conv_id", "depth", "_block").orderBy("turn", "kind", "call_id", "_content")
    rows = rows.join(starts, ["conv_id", "depth", "_block"]).withColumn("position", F.col("_start") + F.row_number().over(within) - 1)
    rows = checked(rows.select(*columns, "status", "position").unionByName(unplaced), schemas)
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    quoted = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    json = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            field("arguments", F.when(call, arguments)),
            field("content", F.when(~call & F.col("content").isNotNull(), quoted(F.col("content")))),
            field("id", F.when(F.col("call_id").isNotNull(), quoted(F.col("call_id")))),
            field("name", F.when(F.col("name").isNotNull(), quoted(F.col("name")))),
            field("role", F.when(F.col("role").isNotNull(), quoted(F.col("role")))),
        ),
        F.lit("}"),
    )
    return rows.select(
        "conv_id", "turn", "role", "kind", "call_id", "status", "position", F.array_join("wrong", "; ").alias("problems"), json.alias("json")
    )


def reply_schema(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('reply', 'prompt', 'string', true), ('reply', 'turn', 'integer', true) AS t(name, parameter, kind, required)"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(messages(load(spark, sf_dir, "conversations")), reply_schema(spark))


def oracle() -> str:
    """Plain conversations: levels by counting the unbroken run of user turns before a turn."""
    return r"""
    WITH c AS (
        SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations
    ), u AS (
        SELECT conv_id, turn, turn % 2 AS side, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c WHERE kind = 'call'
    ), v AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, side, run ORDER BY turn) - 1 AS level FROM u
    ), r AS (
        SELECT c.*, CASE c.kind WHEN 'call' THEN 'call:' || c.conv_id || ':' || c.turn WHEN 'result' THEN 'call:' || c.conv_id || ':' || (c.turn - 1) END AS call_id,
               own.level AS own_level, answered.level AS answered_level, a.turn AS answer_turn
        FROM c LEFT JOIN v own ON c.kind = 'call' AND own.conv_id = c.conv_id AND own.turn = c.turn
               LEFT JOIN v answered ON c.kind = 'result' AND answered.conv_id = c.conv_id AND answered.turn = c.turn - 1
               LEFT JOIN (SELECT conv_id, turn FROM c WHERE kind = 'result') a ON c.kind = 'call' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1
    ), s AS (
        SELECT *, CASE kind WHEN 'call' THEN own_level * 2 WHEN 'result' THEN coalesce(answered_level * 2 + 1, 0) ELSE 0 END AS depth,
               CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'call' THEN CASE WHEN answer_turn IS NULL THEN 'unanswered' ELSE 'linked' END
                    WHEN answered_level IS NULL THEN 'orphan' ELSE 'linked' END AS status
        FROM r
    )
    SELECT conv_id, turn, role, kind, call_id, status, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) - 1 AS position, '' AS problems,
           '{' || CASE WHEN kind = 'call' THEN '"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' ELSE '"content":' || to_json(text)::VARCHAR END
           || CASE WHEN call_id IS NULL THEN '' ELSE ',"id":"' || call_id || '"' END || CASE WHEN kind = 'call' THEN ',"name":"reply"' ELSE '' END
           || ',"role":"' || role || '"}' AS json
    FROM s
    """
