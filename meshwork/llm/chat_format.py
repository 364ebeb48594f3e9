"""Chat formatting: messages as canonical JSON, with tool calls linked to their results and put in order.

A message of the assistant whose text is a JSON object with ``tool_calls`` (a list of ``id``, ``name``, ``arguments``) makes
calls; a message of role ``tool`` whose text is an object with ``tool_call_id`` is a result.  An argument that is an object
``{"$result": "<id>"}`` needs the result of another call.

Results are joined to calls by conversation and id.  Order: a result comes after its call, a call after the results it
needs; levels are found in rounds, each taking what needs nothing that is open, and calls that wait for each other
in a ring stay where they are.  Arguments are checked against a table of parameters (name, param, type, required).
Every message becomes one line of canonical JSON (sorted keys, no spaces, null left out), so a conversation is a sorted run
of lines and is never gathered in one row.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, checkpoint, ranked

_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
# fixed values: names of JSON types and how Spark names the types of variants that fit
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}
PARAMETERS = "name string, param string, type string, required boolean"


def no_parameters(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PARAMETERS.split(", ")))


def parameter_table(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """A table of parameters, of literals."""
    names = [x.split()[0] for x in PARAMETERS.split(", ")]
    items = [F.struct(*(F.lit(v).alias(c) for c, v in zip(names, r, strict=True))) for r in rows]
    return spark.range(1).select(F.inline(F.array(*items))) if rows else no_parameters(spark)


def _object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)^\s*\{"), F.lit(False))


def calls_of(messages: DataFrame) -> DataFrame:
    """The calls in messages that have __id, conv, turn, role, text: (__id, conv, turn, seq, id, name, arguments)."""
    made = messages.filter((F.col("role") == "assistant") & _object(F.col("text")))
    parsed = made.select("__id", "conv", "turn", F.from_json("text", _CALLS).alias("x")).filter(F.size("x.tool_calls") > 0)
    return parsed.select("__id", "conv", "turn", F.posexplode("x.tool_calls").alias("seq", "c")).select("__id", "conv", "turn", "seq", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First call of each id of a conversation, with the __id of its first result; and results with the call's __id."""
    key = F.struct("turn", "__id", "seq")
    first = calls.filter(F.col("id").isNotNull()).groupBy("conv", "id").agg(F.min_by(F.struct("__id", "seq", "turn", "name", "arguments"), key).alias("call"))
    answer = results.groupBy("conv", "id").agg(F.min_by("__id", F.struct("turn", "__id")).alias("result"))
    linked = first.join(answer, ["conv", "id"], "left").select("conv", "id", "call", "result")
    back = results.join(first, ["conv", "id"], "left").select(results["__id"], "conv", "id", F.col("call.__id").alias("call_message"))
    return linked, back


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(__id, level, turn): how many messages a message waits for in a row, and the latest turn among them and itself.

    nodes: (__id, turn); edges: (before, after).  Messages in a ring, and those behind them, keep level 0 and their turn.
    A round takes the messages of which nothing is open any more and tells those behind them; only what is still open is written
    again, and the levels are put together once.
    """
    scratch = Scratch(nodes.sparkSession)
    edges = scratch.write(edges)
    needs = edges.groupBy(F.col("after").alias("__id")).agg(F.count("*").alias("open"))
    touched = edges.select(F.col("before").alias("__id")).unionAll(edges.select("after")).distinct()
    state = scratch.write(nodes.join(touched, "__id").join(needs, "__id", "left").select("__id", "turn", F.coalesce("open", F.lit(0).cast("long")).alias("open"), F.lit(0).alias("level")))
    parts, waiting = [], state
    while (new := waiting.filter("open = 0").select("__id", "turn", "level")).head(1):
        parts.append(new)
        told = edges.join(new.select(F.col("__id").alias("before"), F.col("turn").alias("t"), (F.col("level") + 1).alias("l")), "before")
        told = told.groupBy(F.col("after").alias("__id")).agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max("l").alias("l"))
        after = waiting.filter("open > 0").join(told, "__id", "left")
        waiting = scratch.write(after.select("__id", F.greatest("turn", "t").alias("turn"), (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("level", "l").alias("level")))
        if len(parts) == 32:  # the plan of a long chain stays small
            parts = [scratch.write(reduce(DataFrame.unionAll, parts))]
    found = reduce(DataFrame.unionAll, parts).withColumnRenamed("turn", "at") if parts else waiting.limit(0).select("__id", F.col("turn").alias("at"), "level")
    done = checkpoint(nodes.join(found, "__id", "left").select("__id", F.coalesce("at", "turn").alias("turn"), F.coalesce("level", F.lit(0)).alias("level")))
    scratch.clear()
    return done


def check_arguments(linked: DataFrame, parameters: DataFrame) -> DataFrame:
    """(conv, id, problems): what is wrong with the arguments of each call, sorted; an empty list if all is well.

    A tool that the table does not have at all is a problem; an empty table checks nothing but that arguments are objects.
    """
    p = parameters.select(*(F.col(x.split()[0]).alias(f"p_{x.split()[0]}") for x in PARAMETERS.split(", ")))
    calls = linked.select("conv", "id", F.col("call.name").alias("name"), F.expr("try_parse_json(coalesce(call.arguments, '{}'))").alias("v"))
    calls = calls.withColumn("is_object", F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)))
    given = calls.filter("is_object").select("conv", "id", "name", F.explode(F.expr("cast(v as map<string, variant>)")).alias("param", "value"))
    given = given.withColumn("kind", F.expr("schema_of_variant(value)"))
    fits = reduce(lambda c, x: c.when(F.col("p_type") == x[0], F.col("kind").rlike(x[1])), TYPES.items(), F.when(F.lit(False), F.lit(False))).otherwise(True)
    waits = F.col("kind").rlike(r"^OBJECT<`?\$result")
    typed = given.join(p, (F.col("name") == F.col("p_name")) & (F.col("param") == F.col("p_param")), "left")
    wrong = typed.select("conv", "id", F.when(F.col("p_param").isNull(), F.concat(F.lit("unknown "), "param")).when(~fits & ~waits, F.concat(F.lit("type of "), "param")).alias("problem"))
    needed = calls.join(p.filter("p_required"), F.col("name") == F.col("p_name")).select("conv", "id", F.col("p_param").alias("param"))
    missing = needed.join(given.select("conv", "id", "param"), ["conv", "id", "param"], "left_anti").select("conv", "id", F.concat(F.lit("missing "), "param").alias("problem"))
    tools = p.select(F.col("p_name").alias("name")).distinct()
    strange = calls.join(tools, "name", "left_anti").select("conv", "id", F.lit("unknown tool").alias("problem"))
    shapeless = calls.filter(~F.col("is_object")).select("conv", "id", F.lit("arguments are no object").alias("problem"))
    problems = reduce(DataFrame.unionByName, [wrong.filter("problem is not null"), missing, strange, shapeless]).groupBy("conv", "id").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    return calls.select("conv", "id").join(problems, ["conv", "id"], "left").select("conv", "id", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def format_chats(messages: DataFrame, parameters: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, place (from 0 in each conversation), role, json, status of each message.

    status: null for plain messages; for messages with calls ``ok``, ``unanswered`` (a call has no result) or ``invalid`` (arguments
    do not fit); for results ``linked`` or ``orphan``.  Equal turns are ordered by role, then text; null conversations are one
    conversation; a null turn comes first; a null role or text is left out of the JSON; repeated rows stay.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    m = checkpoint(ranked(rows.withColumn("hash", F.xxhash64("text")), "conv", "turn", "role", "hash", name="__id"))
    # joins below are on conv: a struct is not null, so calls and results of null conversations meet too
    keyed = m.withColumn("conv", F.struct(F.col("conv").isNull().alias("none"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv")))
    calls = checkpoint(calls_of(keyed))
    answers = keyed.filter((F.col("role") == "tool") & _object(F.col("text"))).select("__id", "conv", "turn", F.from_json("text", _RESULT).alias("x")).select("__id", "conv", "turn", F.col("x.tool_call_id").alias("id")).filter("id is not null")
    answers = checkpoint(answers)
    content, calls_json, call_id, status, place = F.col("text"), F.lit(None).cast("array<variant>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("__id")
    if not calls.head(1) and not answers.head(1):
        out = m
    else:
        linked, back = link(calls, answers)
        linked = checkpoint(linked)
        problems = check_arguments(linked, parameters if parameters is not None else no_parameters(m.sparkSession))
        if parameters is None:
            problems = problems.withColumn("problems", F.filter("problems", lambda x: ~x.startswith("unknown")))
        needs = linked.select("conv", F.col("call.__id").alias("after"), F.explode(F.expr(r"regexp_extract_all(call.arguments, '\\{\\s*\"\\$result\"\\s*:\\s*\"([^\"]*)\"\\s*\\}', 1)")).alias("id"))
        needs = needs.join(linked.select("conv", "id", F.col("result").alias("before")).filter("before is not null"), ["conv", "id"]).select("before", "after")
        edges = checkpoint(back.filter("call_message is not null").select(F.col("call_message").alias("before"), F.col("__id").alias("after")).unionByName(needs).filter("before <> after").distinct())
        order = levels(m.select("__id", "turn"), edges).select("__id", F.col("turn").alias("__at"), "level")
        one = calls.join(linked.select("conv", "id", F.col("call.__id").alias("first"), F.col("call.seq").alias("first_seq"), "result"), ["conv", "id"], "left").join(problems, ["conv", "id"], "left")
        item = F.expr("try_parse_json(to_json(named_struct('arguments', try_parse_json(coalesce(arguments, '{}')), 'id', id, 'name', name)))")
        own = (F.col("first") == F.col("__id")) & (F.col("first_seq") == F.col("seq"))
        state = F.when(~F.coalesce(own, F.lit(False)) | (F.size("problems") > 0), 2).when(F.col("result").isNull(), 1).otherwise(0)
        per_message = one.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(item).alias("j")))), lambda x: x["j"]).alias("__calls"), F.max(state).alias("__state"))
        replies = back.select("__id", F.col("id").alias("__call"), F.col("call_message").isNotNull().alias("__linked"))
        out = m.join(order, "__id").join(per_message, "__id", "left").join(replies, "__id", "left")
        out = ranked(out, "conv", "__at", "level", "__id", name="__place")
        place = F.col("__place")
        calls_json = F.transform("__calls", F.parse_json)
        call_id = F.col("__call")
        content = F.when(F.col("__calls").isNotNull(), F.from_json("text", _CALLS)["content"]).when(F.col("__call").isNotNull(), F.from_json("text", _RESULT)["content"]).otherwise(F.col("text"))
        status = F.when(F.col("__state") == 2, "invalid").when(F.col("__state") == 1, "unanswered").when(F.col("__state") == 0, "ok").when(F.col("__linked"), "linked").when(~F.col("__linked"), "orphan")
    json = F.to_json(F.struct(content.alias("content"), F.col("role").alias("role"), call_id.alias("tool_call_id"), calls_json.alias("tool_calls")))
    done = out.select("conv", "turn", place.alias("__place"), "role", json.alias("json"), status.alias("status"))
    starts = done.groupBy(F.col("conv").alias("__conv")).agg(F.min("__place").alias("__first"))
    placed = done.join(starts, F.col("conv").eqNullSafe(F.col("__conv")))
    return placed.select(F.col("conv").alias(conv), F.col("turn").alias(turn), (F.col("__place") - F.col("__first")).alias("place"), F.col("role").alias(role), "json", "status")
