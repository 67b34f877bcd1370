"""Tool calls and their results in chats, with DataFrame functions alone.

Calls and results are joined by conversation and identifier.  A call depends on others
(its `after` list); the order that follows is topological: where every dependency points
to an earlier turn it is that of turns, else levels are found by rounds of joins in which
chains are halved.
Arguments are checked against the tool's schema and serialised as canonical JSON: keys
sorted, no spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import forget, numbered_within, saved

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = "name string, argument string, type string, required boolean"


def canonical(json):
    """Canonical text of JSON; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text):
    """A string as JSON; null for null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `problems`, an array of strings: empty where the arguments fit the tool's schema.

    Types are string, integer, number, boolean, object, array and null.  Arguments that
    the schema doesn't name, missing required ones and other types are problems, as are
    unknown tools and arguments that aren't a JSON object.  Repeated rows of a schema count
    once, rows with a null tool or argument not at all, and a null type admits none.
    """
    # of several rows for an argument the first by type counts, and it is required if one says so
    one = schemas.where("name is not null and argument is not null").groupBy("name", "argument").agg(F.min("type").alias("type"), F.coalesce(F.max("required"), F.lit(False)).alias("required"))
    known = one.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("argument", F.struct("type", "required")))).alias("schema"))
    given = calls.withColumn("parsed", F.try_parse_json("arguments")).withColumn("kind", F.schema_of_variant("parsed"))
    given = given.withColumn("object", F.col("kind").startswith("OBJECT"))
    given = given.withColumn("given", F.when(F.col("object"), F.expr("cast(parsed as map<string, variant>)")))
    given = given.join(known, "name", "left")
    raw = F.expr("transform(map_keys(given), k -> struct(k as argument, schema_of_variant(given[k]) as found, schema[k].type as wanted))")
    typed = given.withColumn("pairs", raw)
    wrong = F.expr("""transform(filter(pairs, x -> not coalesce(case
        when x.wanted = 'string' then x.found = 'STRING'
        when x.wanted = 'integer' then x.found = 'BIGINT'
        when x.wanted = 'number' then x.found in ('BIGINT', 'DOUBLE', 'FLOAT') or x.found like 'DECIMAL%'
        when x.wanted = 'boolean' then x.found = 'BOOLEAN'
        when x.wanted = 'object' then x.found like 'OBJECT%'
        when x.wanted = 'array' then x.found like 'ARRAY%'
        when x.wanted = 'null' then x.found = 'VOID' end, false)),
        x -> concat(if(x.wanted is null, 'unknown argument ', 'wrong type of '), x.argument))""")
    missing = F.expr("transform(filter(map_keys(schema), k -> schema[k].required and not array_contains(map_keys(given), k)), k -> concat('missing argument ', k))")
    problems = (
        F.when(F.col("schema").isNull(), F.array(F.lit("unknown tool")))
        .when(~F.coalesce("object", F.lit(False)), F.array(F.lit("arguments are no object")))
        .otherwise(F.array_sort(F.concat(wrong, missing)))
    )
    return typed.withColumn("problems", problems).drop("parsed", "kind", "object", "given", "schema", "pairs")


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): how many calls stand behind each other below it, for calls that no cycle is below.

    nodes: conv_id, call_id; needs: conv_id, call_id, needed.  A round settles the calls
    whose needs are settled, and lets every need on a call that waits for one alone point
    behind it, so a chain takes as many rounds as its length has binary digits.  Rounds grow
    with the depth of calls that wait for several.  What is settled no more is on a cycle
    or behind one.
    """
    key = ["conv_id", "call_id"]
    left = saved(needs.distinct().withColumn("w", F.lit(1).cast("long")), "open")
    waiting = left.select(*key).distinct()
    front = saved(nodes.join(waiting, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    # the least level of what still waits, by what is settled
    least = saved(waiting.withColumn("level", F.lit(0).cast("long")), "least")
    done = front
    while not front.isEmpty():
        met = left.join(front.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("at")), ["conv_id", "needed"], "left")
        gain = met.where("at is not null").groupBy(*key).agg(F.max(F.col("at") + F.col("w")).alias("gain"))
        rest = saved(met.where("at is null").select(*key, "needed", "w"), "open")
        now = saved(least.join(gain, key, "left").select(*key, F.greatest("level", "gain").alias("level")), "least")
        waiting = rest.select(*key).distinct()
        front = saved(now.join(waiting, key, "left_anti"), "level")
        done = done.unionByName(front)
        # needs on what waits for one call go to that call; a cycle would add up without end
        one = rest.groupBy(*key).agg(F.count("*").alias("n"), F.first("needed").alias("next"), F.first("w").alias("more")).where("n = 1").join(now, key)
        one = one.select("conv_id", F.col("call_id").alias("needed"), "next", "more", F.col("level").alias("floor"))
        jumped = saved(rest.join(one, ["conv_id", "needed"], "left").withColumn("by", F.col("floor") + F.col("w")), "jumped")
        forget(left, least)
        left = saved(jumped.groupBy(*key, F.coalesce("next", "needed").alias("needed")).agg(F.max(F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(1 << 40))).alias("w")), "open")
        raised = jumped.groupBy(*key).agg(F.max("by").alias("by"))
        least = saved(now.join(raised, key).select(*key, F.least(F.greatest("level", "by"), F.lit(1 << 40)).alias("level")), "least")
        forget(rest, now, jumped)
    forget(left, least)
    return done


def ordered(calls: DataFrame) -> DataFrame:
    """calls with topo_order: a call's place among its conversation's calls, from 0, behind all that it depends on.

    Where every dependency of a conversation points to an earlier turn the calls go by
    turn; else by levels, of calls that need nothing left, and then by turn.  Calls of one
    level and turn go by identifier, name and arguments, repeated rows have places of their
    own; calls on a cycle, and behind one, have null.  Dependencies on identifiers that no
    call has are left out.
    """
    rows = calls.select("conv_id", "turn", "call_id", F.explode("after").alias("needed"))
    own = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("needed_turn")).withColumnRenamed("call_id", "needed")
    edges = saved(rows.join(own, ["conv_id", "needed"]).select("conv_id", "call_id", "turn", "needed", "needed_turn"), "needs")
    odd = edges.where("needed_turn >= turn").select("conv_id").distinct()
    leveled = calls.withColumn("level", F.lit(0).cast("long"))
    if odd.limit(1).count():
        odd = saved(odd, "odd")
        some = calls.where("call_id is not null").join(odd, "conv_id", "left_semi").select("conv_id", "call_id").distinct()
        level = levels(some, edges.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "needed").where("call_id is not null"))
        flagged = calls.join(odd.withColumn("is_odd", F.lit(True)), "conv_id", "left").join(level.select("conv_id", "call_id", "level"), ["conv_id", "call_id"], "left")
        # an identifier that is null needs nothing and is needed by nothing
        free = F.col("is_odd").isNull() | F.col("call_id").isNull()
        leveled = flagged.withColumn("level", F.when(free, F.lit(0).cast("long")).otherwise(F.col("level"))).drop("is_odd")
    placed = numbered_within(leveled, "topo_order", "conv_id", F.asc_nulls_last("level"), F.asc("turn"), F.asc("call_id"), F.asc("name"), F.asc("arguments"))
    forget(edges)
    return placed.withColumn("topo_order", F.when(F.col("level").isNotNull(), F.col("topo_order") - 1)).drop("level")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without one: conv_id, call_id, turn, status, topo_order, problems, valid, record.

    status is linked, unanswered (a call without a result) or orphan (a result without a
    call).  Of several results the earliest counts, then the smallest text; of several
    calls with an identifier each gets the result.  record is canonical JSON of name,
    arguments, identifier and result; arguments that aren't JSON stand as a string.
    Null identifiers link with nothing.  Empty tables give an empty one.
    """
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"))
    asked = checked(ordered(calls), schemas)
    both = asked.join(first, ["conv_id", "call_id"], "left")
    arguments = F.coalesce(canonical("arguments"), quoted(F.col("arguments")), F.lit("null"))
    record = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.when(F.col("result.content").isNull(), F.lit("null")).otherwise(quoted(F.col("result.content"))), F.lit("}"),
    )
    out = both.select(
        "conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("result").isNull(), "unanswered").otherwise("linked").alias("status"), "topo_order",
        F.array_join("problems", "; ").alias("problems"), (F.size("problems") == 0).alias("valid"), record.alias("record"),
    )
    orphans = results.join(calls.select("conv_id", "call_id").where("call_id is not null").distinct(), ["conv_id", "call_id"], "left_anti")
    lone = F.concat(F.lit('{"id":'), F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.lit(',"result":'), F.coalesce(quoted(F.col("content")), F.lit("null")), F.lit("}"))
    return out.unionByName(
        orphans.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("topo_order"), F.lit("").alias("problems"), F.lit(False).alias("valid"), lone.alias("record"))
    )


def from_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain chats (conv_id, turn, role, text).

    A user's turn is a call of the tool `reply` with its text as `prompt` and its turn;
    the assistant's next turn is the result with that call's identifier.  A call comes
    after the user's turn before it.  System turns are calls of `instruct`, which has no
    result.  A null text is a null prompt, which the schema doesn't admit.
    """
    spark = messages.sparkSession
    m = messages.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "cast(text as string) text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    asks = m.where("role in ('user', 'system')")
    prompt = F.when(F.col("text").isNull(), F.lit("null")).otherwise(quoted(F.col("text")))
    arguments = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"prompt":'), prompt, F.lit("}"))
    calls = asks.select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.array(name(F.col("turn") - 1), name(F.col("turn") - 2)).alias("after"),
    )
    results = m.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    rows = [(t, a, k, True) for t in ("reply", "instruct") for a, k in (("prompt", "string"), ("turn", "integer"))]
    return calls, results, spark.createDataFrame(rows, SCHEMAS)
