"""Chat formatting: tool calls are linked to results, ordered, checked, serialised.

Calls and results meet in a hash join on (conversation, identifier), so a long
conversation is dealt out by its identifiers and never gathered. The topological
order is the level of each call: chains are shortened by pointer doubling, then
rounds settle every call all of whose dependencies are settled; the loop ends
when a round settles none, and what is left lies on or behind a cycle. Arguments are
checked against the tools' schemas and each message becomes one line of
canonical JSON: keys sorted, no spaces, UTF-8, no NaN.

Defined results: the first row (lowest turn, then text) counts where an
identifier repeats, and one row of status ``repeated`` tells how many calls or
results came after it; calls without conversation or identifier are
``unidentified``; calls without a
result ``unanswered``; results without a call ``orphan``; calls in a cycle
``cycle`` with a null level; arguments that aren't a JSON object of the schema
``invalid``, with the reason in ``problem``. A dependency that no call defines is
ignored. Results without conversation or identifier are orphans.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, gathered, map_rows, stored

#: Halves of surrogate pairs, which JSON may escape but UTF-8 can't hold.
_HALVES = re.compile("[\ud800-\udfff]")
#: JSON types by schema name. A bool isn't a number here.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical_json(value) -> str:
    """Keys sorted, no spaces, characters as they are but for lone surrogates, which stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _HALVES.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def same_json(a, b) -> bool:
    """Equality of JSON values: 1 equals 1.0, true isn't 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return a == b


def _is(value, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES[kind])


def schema_problem(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` departs from a schema with type, enum,
    required, properties, additionalProperties, items, minLength, maxLength,
    minimum and maximum; None if it conforms. ``type`` may be a list; a type that
    JSON doesn't have is a problem of the schema and told as such."""
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    for kind in kinds:
        if kind not in TYPES:
            return f"{at}: the schema's type {kind} is unknown"
    if kinds and not any(_is(value, kind) for kind in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and not any(same_json(value, x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}: too small"
        if value > schema.get("maximum", value):
            return f"{at}: too large"
    if isinstance(value, dict):
        for key in schema.get("required", ()):
            if key not in value:
                return f"{at}: {key} is missing"
        known = schema.get("properties", {})
        for key in sorted(value):
            if key in known:
                if found := schema_problem(value[key], known[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}: {key} is unknown"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := schema_problem(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, steps): from calls with one dependency to the first
    call of another kind behind them. Pointers double their reach each round;
    calls that still point at one of their own kind after enough rounds for all
    of them run in a circle and are left out."""
    chains, rounds = stored(single.select("conv_id", "call_id", F.col("needed").alias("to"), F.lit(1).alias("steps"))), 0
    most = chains.count().bit_length() + 1
    while True:
        ahead = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        if chains.join(ahead, ["conv_id", "to"], "left_semi").isEmpty():
            return chains
        if rounds == most:
            return chains.join(ahead, ["conv_id", "to"], "left_anti")
        far = chains.join(ahead, ["conv_id", "to"], "left")
        chains = stored(far.select("conv_id", "call_id", F.coalesce("__to", "to").alias("to"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")))
        rounds += 1


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls with ``depends_on``; the level
    is 0 without dependencies, else one more than the highest among them. Calls
    in or behind a cycle are missing.

    Chains of calls with one dependency each are shortened first, so the rounds
    grow with how often several dependencies meet and not with a chain's length.
    What rounds settle goes to one folder, so the plan doesn't grow with them.
    """
    done = folder(calls.sparkSession)
    nodes = calls.select("conv_id", "call_id")
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needed"))
    edges = stored(needs.join(nodes.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_semi"))
    degree = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"))
    chains = _chains(edges.join(degree.where("n = 1"), ["conv_id", "call_id"]))
    settled = stored(nodes.join(degree, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), done)
    tops = chains.select("conv_id", F.col("call_id").alias("needed"), "to", "steps")
    empty = F.lit(None).cast("int").alias("level")
    meet = edges.join(degree.where("n > 1"), ["conv_id", "call_id"]).join(tops, ["conv_id", "needed"], "left")
    waiting = stored(meet.select("conv_id", "call_id", F.coalesce("to", "needed").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), empty))
    freed = settled
    while not waiting.isEmpty():
        # only calls that the last round settled are new; what waits shrinks with every round
        new = freed.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("__level"))
        told = waiting.join(new, ["conv_id", "to"], "left").withColumn("level", F.coalesce("level", "__level")).drop("__level")
        told = stored(told)
        found = told.groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), (F.count("level") == F.count(F.lit(1))).alias("all"))
        freed = stored(found.where("all").select("conv_id", "call_id", "level"), done)
        if freed.isEmpty():
            break
        waiting = told.join(freed, ["conv_id", "call_id"], "left_anti").select(waiting.columns)
    all_settled = gathered(calls.sparkSession, done, settled.schema)
    known = all_settled.withColumnRenamed("call_id", "to")
    return all_settled.unionByName(chains.join(known, ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], messages: DataFrame | None = None) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments JSON, depends_on array) and
    results (conv_id, call_id, turn, content) as one row a call or result that
    stands alone: conv_id, turn, call_id, name, level, status, problem, line.
    ``messages`` (conv_id, turn, name, content) are neither and pass as
    ``message``.

    Order a conversation by (level, turn, call_id) to replay it.
    """
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "arguments", "name", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n"))
    once = stored(first.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", "c.*"))
    replies = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n"))
    linked = (
        once.join(levels(once), ["conv_id", "call_id"], "left")
        .join(replies.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered")), ["conv_id", "call_id"], "left")
        .select("conv_id", "turn", "call_id", "name", "level", F.when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("linked").alias("status"), "arguments", "content")
    )
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    named = "conv_id is not null and call_id is not null"
    later = F.concat(F.lit("repeats: "), F.col("n") - 1).alias("content")
    told = lambda df, status, content: df.select("conv_id", "turn", "call_id", "name", no("int", "level"), F.lit(status).alias("status"), no("string", "arguments"), content)
    repeats = told(first.where(f"n > 1 and {named}").select("conv_id", "call_id", "n", "c.*"), "repeated", later)
    answered = replies.where(f"n > 1 and {named}").join(once.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    repeats = repeats.unionByName(told(answered.select("conv_id", "call_id", "n", "r.turn", no("string", "name")), "repeated", later))
    repeats = repeats.unionByName(told(calls.where(f"not ({named})"), "unidentified", no("string", "content")))
    orphans = results.join(once.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"), F.lit(None).cast("string").alias("arguments"), "content"
    )

    def each():
        def one(call, name, level, status, arguments, content):
            problem, value = None, None
            if status in ("linked", "unanswered", "cycle"):
                try:
                    value = json.loads(arguments)
                    problem = "no such tool" if name not in schemas else schema_problem(value, schemas[name])
                except (TypeError, ValueError, RecursionError):
                    problem = "arguments aren't JSON"
            told = {"call_id": call, "name": name, "arguments": value, "level": level, "result": content}
            try:
                line = canonical_json({k: v for k, v in told.items() if v is not None})
            except ValueError:
                problem, line = "arguments hold NaN", canonical_json({k: v for k, v in told.items() if v is not None and k != "arguments"})
            return "invalid" if problem and status == "linked" else status, problem, line

        def work(conv, turn, call, name, level, status, arguments, content):
            made = [one(*x) for x in zip(call, name, level, status, arguments, content)]
            status, problem, line = (list(x) for x in zip(*made)) if made else ([], [], [])
            return {"conv_id": conv, "turn": turn, "call_id": call, "name": name, "level": level, "status": status, "problem": problem, "line": line}

        return work

    rows = linked.unionByName(repeats).unionByName(orphans)
    if messages is not None:
        plain = messages.select("conv_id", "turn", no("string", "call_id"), "name", no("int", "level"), F.lit("message").alias("status"), no("string", "arguments"), "content")
        rows = rows.unionByName(plain)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_rows(rows, f"conv_id {kind}, turn long, call_id string, name string, level int, status string, problem string, line string", each, *rows.columns)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations without tools as calls of one: a user's turn asks ``reply``
    and needs the reply before it; an assistant's turn answers the turn before;
    turns of all other roles are messages. Turns without a number have no
    identifier."""
    key = lambda back: F.when(F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), F.concat_ws(":", F.col("conv_id"), F.col("turn") - back))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")))
    calls = conversations.where("role = 'user'").select("conv_id", key(0).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(key(2)).alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", key(1).alias("call_id"), "turn", F.col("text").alias("content"))
    others = conversations.where("role is null or role not in ('user', 'assistant')")
    return calls, results, others.select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content"))
