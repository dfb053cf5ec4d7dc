"""Chat formatting with linked tool calls. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

SCHEMA_FIELDS = "array<struct<field:string,type:string,required:boolean>>"


def schemas_of(spark: SparkSession, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Argument schemas as rows (name, fields) from {name: {field: (JSON type, required)}}."""
    rows = [(name, [(f, t, r) for f, (t, r) in sorted(fields.items())]) for name, fields in tools.items()]
    return spark.createDataFrame(rows, f"name string, fields {SCHEMA_FIELDS}")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no space between tokens; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _argument_problems(arguments: Column, fields: Column) -> Column:
    """What is wrong with the arguments of a call, sorted: not an object, missing, unknown or mistyped fields."""
    parsed = F.try_parse_json(arguments)
    given = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.try_cast("map<string,variant>"))

    def mistyped(x: Column) -> Column:
        kind = F.schema_of_variant(given[x["field"]])
        ok = (
            F.when(x["type"] == "string", kind == "STRING")
            .when(x["type"] == "integer", kind == "BIGINT")
            .when(x["type"] == "number", kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
            .when(x["type"] == "boolean", kind == "BOOLEAN")
            .when(x["type"] == "object", kind.startswith("OBJECT"))
            .when(x["type"] == "array", kind.startswith("ARRAY"))
            .when(x["type"] == "null", kind == "VOID")
            .otherwise(F.lit(False))
        )
        return F.array_contains(F.map_keys(given), x["field"]) & ~F.coalesce(ok, F.lit(False))

    say = lambda word, xs: F.transform(xs, lambda x: F.concat(F.lit(word + " "), x))
    names = F.transform(fields, lambda x: x["field"])
    missing = F.array_except(F.transform(F.filter(fields, lambda x: x["required"]), lambda x: x["field"]), F.map_keys(given))
    wrong = F.transform(F.filter(fields, mistyped), lambda x: x["field"])
    unknown = F.array_except(F.map_keys(given), names)
    found = F.concat(say("missing", missing), say("mistyped", wrong), say("unknown", unknown))
    return F.when(fields.isNull(), F.array(F.lit("no schema"))).when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(found))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls in the conversations that `edges` belong to; level -1 lies on or after a cycle.

    Round after round, the calls without a level that wait for none without a level get the next one. Each round is
    written once; it gives levels to some calls or is the last.
    """
    waits, level = cut(edges), 0
    state = cut(nodes.withColumn("level", F.lit(None).cast("int")))
    while True:
        open_ = state.where("level IS NULL").select("conv_id", F.col("call_id").alias("needs"))
        blocked = waits.join(open_, ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct().withColumn("blocked", F.lit(True))
        ready = F.col("level").isNull() & F.col("blocked").isNull()
        state = cut(state.join(blocked, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(ready, F.lit(level)).otherwise(F.col("level")).alias("level")))
        if not state.where(F.col("level") == level).take(1):
            return state.withColumn("level", F.coalesce("level", F.lit(-1)))
        level += 1


def _placed(rows: DataFrame, *last: str) -> DataFrame:
    """`rows` with their position in the conversation; ties are broken by the columns `last`.

    Rows are cut into ranges over all conversations and numbered within (range, conversation); a conversation's
    counts in the ranges before give the offset. A conversation with a third of all rows spreads over the ranges.
    """
    order = ["stuck", "level", F.asc_nulls_last("turn"), F.asc_nulls_last("call_id"), "k", F.col("kind") != "call", *last]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a range partitioning that is computed twice may draw other bounds
    ranged = cut(rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    ahead = counts.select("part", F.col("conv_id").alias("of"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("ahead"))
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    found = numbered.withColumnRenamed("part", "p").join(ahead, (F.col("p") == F.col("part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    return found.withColumn("position", (F.col("ahead") + F.col("nth")).cast("int"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result that answers no call, in an order in which each call follows what it needs.

    `calls`: conv_id, turn, call_id, name, arguments (JSON text), needs (ids of calls whose results it uses).
    `results`: conv_id, turn, call_id, content. `schemas`: name, fields (see `schemas_of`).
    Returns conv_id, position, turn, kind ("call" or "result"), call_id, name, result_turn, problems, json.

    Calls and results meet in a shuffled hash join on (conv_id, call_id, k): the k-th call with an identifier, by
    turn, meets the k-th result with it. Within a conversation calls stand by level, then turn (a null turn comes
    last), then identifier: the level is 0 where every need stands at an earlier turn, so that turns already are a
    topological order; only conversations that break this are peeled level by level. Problems name unanswered calls, results without
    call, results before their call, needs that don't exist, cycles, and arguments that the schema refuses. A
    cycle's calls stand last, by turn. `json` has sorted keys, canonical arguments (null if they are no JSON).

    Rows with a null conv_id or call_id link with nothing and stand alone; null arguments are no object; null
    content is null; null needs are none. Empty inputs give no rows; other columns are ignored.
    """
    return _placed(_linked(calls, results, schemas)).select("conv_id", "position", "turn", "kind", "call_id", "name", "result_turn", "problems", "json")


def _linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """The rows of `link_tool_calls` with stuck, level and k, by which they are placed."""
    alone = lambda t: F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.xxhash64("turn", t))  # noqa: E731  (these link with nothing: no group)
    nth = lambda t: F.row_number().over(Window.partitionBy("conv_id", "call_id", alone(t)).orderBy(F.asc_nulls_first("turn"), t))
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    c = cut(c.withColumn("k", nth(F.xxhash64("name", "arguments"))))  # read by the join and by the needs
    r = results.select("conv_id", F.col("turn").alias("result_turn"), "call_id", "content")
    r = r.withColumnRenamed("result_turn", "turn").withColumn("k", nth(F.xxhash64("content"))).withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True))
    linked = c.withColumn("called", F.lit(True)).join(r.hint("shuffle_hash"), ["conv_id", "call_id", "k"], "full_outer").join(schemas.select("name", "fields"), "name", "left")

    at = c.where("k = 1").select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"), F.lit(True).alias("exists"))
    need = c.where(F.size("needs") > 0).select("conv_id", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need")).join(at, ["conv_id", "need"], "left")
    lacking = need.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.when(F.col("exists").isNull(), F.concat(F.lit("needs unknown "), "need")))).alias("lacking"))
    earlier = F.col("need_turn").isNotNull() & (F.col("turn").isNull() | (F.col("need_turn") < F.col("turn")))  # null turns stand last
    late = cut(need.where(F.col("exists") & ~earlier).select("conv_id").distinct())
    peeled = _levels(
        c.where("k = 1").join(late, "conv_id", "left_semi").select("conv_id", "call_id"),
        need.where("exists").join(late, "conv_id", "left_semi").select("conv_id", "call_id", F.col("need").alias("needs")).distinct(),
    ) if late.take(1) else None
    out = linked.join(lacking, ["conv_id", "call_id"], "left")
    out = out.join(peeled, ["conv_id", "call_id"], "left") if peeled is not None else out.withColumn("level", F.lit(0))

    is_call = F.coalesce("called", F.lit(False))
    say = lambda when, what: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    problems = F.concat(
        say(is_call & F.col("answered").isNull(), "no result"),
        say(~is_call, "no call"),
        say(is_call & (F.col("result_turn") < F.col("turn")), "result before call"),
        say(F.col("level") < 0, "cycle"),
        F.coalesce("lacking", F.array().cast("array<string>")),
        F.when(is_call, _argument_problems(F.col("arguments"), F.col("fields"))).otherwise(F.array().cast("array<string>")),
    )
    turn = F.coalesce("turn", "result_turn")
    record = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", F.col("content").alias("content"), "name", F.col("problems").alias("problems")), {"ignoreNullFields": "false"})
    level = F.coalesce("level", F.lit(0))
    out = out.withColumn("problems", problems)
    return out.select("conv_id", turn.alias("turn"), F.when(is_call, "call").otherwise("result").alias("kind"), "call_id", "name", "result_turn", "problems", record.alias("json"), (level < 0).alias("stuck"), level.alias("level"), "k")


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages whose text is JSON.

    An assistant's {"tool_calls": [{"id", "name", "arguments", "needs"}]} makes calls, a tool's
    {"tool_call_id", "content"} a result; other messages are left alone.
    """
    v = F.try_parse_json("text")
    call = "array<struct<id:string,name:string,arguments:variant,needs:array<string>>>"
    made = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", F.explode(F.try_variant_get(v, "$.tool_calls", call)).alias("c"))
    calls = made.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", F.to_json("c.arguments").alias("arguments"), "c.needs")
    told = conversations.where(F.col("role") == "tool").select("conv_id", "turn", F.try_variant_get(v, "$.tool_call_id", "string").alias("call_id"), F.try_variant_get(v, "$.content", "string").alias("content"))
    return calls, told.where("call_id IS NOT NULL")


def exchanges_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads plain conversations as calls: a user's turn asks tool `reply`, the next turn by the assistant answers.

    The identifier is conv_id:turn of the request, and a request needs the one two turns before it.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    t = F.col("turn")
    arguments = F.to_json(F.struct(t.alias("turn"), F.col("text").alias("prompt")))
    calls = conversations.where(F.col("role") == "user").select("conv_id", "turn", name(t).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(t >= 2, F.array(name(t - 2))).alias("needs"))
    results = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", name(t - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def chat_messages(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every message of the table: linked exchanges and tool calls, and a row of its own for any other message.

    Returns the columns of `link_tool_calls` and role. A user's and an assistant's message are read as by
    `exchanges_as_calls`, an assistant's tool calls and a tool's results as by `tool_messages`; their identifiers
    are prefixed with `exchange:` and `tool:`, so that neither is taken for the other. All other messages (system,
    other roles, no role, a tool's without an identifier) are rows of kind "message" with their role, and with
    role and content as json; they stand at their turn, after the calls that begin there.
    """
    def named(frame: DataFrame, origin: str) -> DataFrame:
        say = lambda c: F.concat(F.lit(f"{origin}:"), c)
        out = frame.withColumn("call_id", say(F.col("call_id")))
        return out.withColumn("needs", F.transform("needs", say)) if "needs" in out.columns else out

    asked, answered = exchanges_as_calls(conversations)
    called, returned = tool_messages(conversations)
    linked = _linked(named(asked, "exchange").unionByName(named(called, "tool")), named(answered, "exchange").unionByName(named(returned, "tool")), schemas)
    result = (F.col("role") == "tool") & F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string").isNotNull()
    rest = conversations.where(~F.coalesce(F.col("role").isin("user", "assistant") | result, F.lit(False)))
    record = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    others = rest.select("conv_id", "turn", F.lit("message").alias("kind"), "role", F.array().cast("array<string>").alias("problems"), record.alias("json"), F.lit(False).alias("stuck"), F.lit(0).alias("level"), F.lit(0).alias("k"))
    rows = _placed(linked.unionByName(others, allowMissingColumns=True), "json")
    return rows.select("conv_id", "position", "turn", "kind", "role", "call_id", "name", "result_turn", "problems", "json")
