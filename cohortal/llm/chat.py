"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join by conversation and identifier. A call may
refer to the results of others; calls are ordered topologically by their level, in
joins over the whole table that follow chains of any length in a few rounds. Arguments
are validated against the tool's schema, and each call is written as canonical JSON:
keys sorted, no spaces, one number form. Only the texts pass through Python.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut

#: Conversations of up to so many references among calls with several of them are ordered in a task each.
LOCAL_REFS = 50_000

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        ok = isinstance(value, int | float) and not isinstance(value, bool)
        return ok and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, required, properties, additionalProperties, items, bounds of size."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    out = [] if "enum" not in schema or value in schema["enum"] else [f"{at}: enum"]
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in props:
                out += violations(value[k], props[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [x for k, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{k}]")]
    size = value if _is(value, "number") else len(value) if isinstance(value, str | list) else None
    for least, most in (("minimum", "maximum"), ("minLength", "maxLength"), ("minItems", "maxItems")):
        fits = _is(value, "number") if least == "minimum" else isinstance(value, str if least == "minLength" else list)
        if fits and size < schema.get(least, -math.inf):
            out.append(f"{at}: {least}")
        if fits and size > schema.get(most, math.inf):
            out.append(f"{at}: {most}")
    return out


def _plain(value: object) -> object:
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("JSON has no such number")
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _jumped(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, up, d): where the chain of single references above each call ends, and after how many steps.

    Chains double their reach in each round, so a chain of n calls takes log n of
    them. ``up`` is null on a cycle, and above one: its steps outnumber all calls.
    """
    single = edges.groupBy("conv_id", "call_id").agg(F.min("ref").alias("ref"), F.count("*").alias("n")).where("n = 1").drop("n")
    most = calls.count()
    state = cut(
        calls.join(single, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", F.coalesce("ref", "call_id").alias("up"), F.when(F.col("ref").isNotNull(), 1).otherwise(0).cast("long").alias("d")
        )
    )
    while True:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"))
        total = F.col("d") + F.col("_d")
        state = cut(state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.when(total <= most, F.col("_up")).alias("up"), total.alias("d"), "_d"))
        if not state.where("_d > 0 and up is not null").limit(1).count():
            return state.select("conv_id", "call_id", "up", "d")
        state = state.drop("_d")


def _settled(waiting: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with several references, each conversation in one task.

    ``waiting`` has conv_id, call_id, up and w: the call stands at least ``w`` above
    ``up``, which has level 0 unless it waits itself. Calls that a cycle keeps waiting give no row.
    """
    kinds = waiting.select("conv_id", "call_id").schema

    def solve(group: pa.Table) -> pa.Table:
        calls, ups, steps = (group.column(c).to_pylist() for c in ("call_id", "up", "w"))
        open_refs, above, level = Counter(calls), defaultdict(list), dict.fromkeys(calls, 0)
        ready = []
        for call, up, step in zip(calls, ups, steps, strict=True):
            if up in level:
                above[up].append((call, step))
            elif up is not None:
                level[call], open_refs[call] = max(level[call], step), open_refs[call] - 1
                if not open_refs[call]:
                    ready.append(call)
        for call in ready:  # grows as it is read
            for other, step in above[call]:
                level[other], open_refs[other] = max(level[other], level[call] + step), open_refs[other] - 1
                if not open_refs[other]:
                    ready.append(other)
        conv = pa.array([group.column("conv_id")[0].as_py()] * len(ready), group.schema.field("conv_id").type)
        return pa.table({"conv_id": conv, "call_id": pa.array(ready, pa.string()), "level": pa.array([level[c] for c in ready], pa.int64())})

    return waiting.groupBy("conv_id").applyInArrow(solve, f"conv_id {kinds['conv_id'].dataType.simpleString()}, call_id string, level long")


def levels(calls: DataFrame, local_refs: int = LOCAL_REFS) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that refer to none, else one more than the highest they refer to.

    Calls on a cycle, or above one, have a null level. A reference to a call that
    is not there counts as met. Chains of single references are followed by
    doubling. Calls with several references are then ordered in one task for each
    conversation of up to ``local_refs`` such references; larger conversations take
    one round of joins for each level among these calls. Nothing is gathered.
    """
    nodes = cut(calls.select("conv_id", "call_id").distinct())
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).where("ref is not null").distinct()
    edges = cut(edges.join(nodes.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left_semi"))
    jumped = _jumped(nodes, edges)
    key = ["conv_id", "call_id"]
    several = edges.groupBy(*key).count().where("count > 1").select(*key)
    ends = jumped.select("conv_id", F.col("call_id").alias("ref"), F.col("up"), F.col("d"))
    waiting = cut(edges.join(several, key, "left_semi").join(ends, ["conv_id", "ref"]).select(*key, "up", (F.col("d") + 1).alias("w")))
    done = nodes.join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    large = cut(waiting.groupBy("conv_id").count().where(F.col("count") > local_refs).select("conv_id"))
    done = cut(done.unionByName(_settled(waiting.join(large, "conv_id", "left_anti"))))
    waiting = cut(waiting.join(large, "conv_id", "left_semi"))
    while not waiting.isEmpty():
        known = done.select("conv_id", F.col("call_id").alias("up"), "level")
        ready = waiting.join(known, ["conv_id", "up"], "left").groupBy(*key)
        ready = ready.agg(F.max(F.col("level") + F.col("w")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        front = cut(ready.select(*key, "level"))
        if front.isEmpty():
            break
        waiting = cut(waiting.join(front.select(*key), key, "left_anti"))
        done = cut(done.unionByName(front))
    top = done.select("conv_id", F.col("call_id").alias("up"), "level")
    return jumped.join(top, ["conv_id", "up"], "left").select(*key, (F.col("d") + F.col("level")).alias("level"))


def _first_and_rest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with a conversation and an identifier the least of each pair of them, and all the others, repeated ones as often as they occur."""
    key = ["conv_id", "call_id"]
    rest = [c for c in rows.columns if c not in key]
    counted = cut(rows.where("conv_id is not null and call_id is not null").groupBy(*rows.columns).agg(F.count("*").alias("n")))
    first = cut(counted.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first")))
    both = counted.join(first, key).withColumn("n", F.col("n") - F.struct(*rest).eqNullSafe(F.col("first")).cast("int")).where("n > 0")
    others = both.select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")
    return first.select(*key, "first.*"), others


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """(canonical JSON, errors) of a call's arguments; what cannot be read or written as JSON of finite numbers has no JSON."""
    try:
        value = json.loads(arguments)
        text = canonical(value)
        text.encode()  # a lone surrogate has no UTF-8
        return text, violations(value, schemas[name]) if name in schemas else ["$: no schema"]
    except (TypeError, ValueError, OverflowError, RecursionError):
        return None, ["$: not JSON"]


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], local_refs: int = LOCAL_REFS) -> DataFrame:
    """One row for each call and for each result without one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), refs (call ids).
    ``results``: conv_id, call_id, turn, content.
    Returned: conv_id, call_id, turn, level, status, errors, json. status is
    ``linked``, ``pending`` (no result), ``early`` (its result stands before it),
    ``orphan`` (a result alone), ``cyclic``, ``invalid`` (schema; wins over the
    others) or ``duplicate``.

    Of calls, or results, with one conversation and identifier the one of the
    lowest turn counts, then the least text; each other one returns a row of its
    own as a duplicate, which links with nothing. Null identifiers link with
    nothing: such calls are pending, such results orphans. Arguments that are
    null, malformed, nested too deeply to read, or hold what JSON cannot write
    (infinite numbers, lone surrogates) are invalid; a tool without a schema is
    invalid. Texts may have any length; ids of 64 bits stay exact. Other columns
    are not read; no rows give no rows.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    (named, more_calls), (answered, more_results) = _first_and_rest(calls), _first_and_rest(results)
    named, answered = cut(named.withColumn("is_call", F.lit(True))), answered.withColumn("is_result", F.lit(True))
    joined = named.join(answered, ["conv_id", "call_id"], "full_outer").join(levels(named, local_refs), ["conv_id", "call_id"], "left")
    loose = F.col("conv_id").isNull() | F.col("call_id").isNull()
    loose_calls = calls.where(loose).withColumns({"is_call": F.lit(True), "level": F.lit(0).cast("long")})
    twice = {"duplicate": F.lit(True)}
    every = joined
    for part in (loose_calls, results.where(loose), more_calls.withColumns(twice | {"is_call": F.lit(True)}), more_results.withColumns(twice)):
        every = every.unionByName(part, allowMissingColumns=True)
    is_call = F.coalesce("is_call", F.lit(False))
    status = (
        F.when(F.col("duplicate"), "duplicate")
        .when(~is_call, "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("is_result").isNull(), "pending")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    shaped = every.select("conv_id", "call_id", F.when(is_call, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"), "level", status.alias("status"), is_call.alias("is_call"), "name", "arguments", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            statuses, errors, texts = [], [], []
            for call_id, status, is_call, name, arguments, content in zip(*(c.to_pylist() for c in batch.select(["call_id", "status", "is_call", "name", "arguments", "content"]).columns), strict=True):
                shown, wrong = checked(name, arguments, schemas) if is_call else (None, [])
                statuses.append("invalid" if wrong and status != "duplicate" else status)
                errors.append(wrong)
                plain = {k: json.dumps(v, ensure_ascii=False) for k, v in (("call", call_id), ("name", name), ("result", content)) if v is not None}
                parts = ({} if shown is None else {"arguments": shown}) | plain
                texts.append("{" + ",".join(f'"{k}":{v}' for k, v in parts.items()) + "}")
            columns = [batch.column("conv_id"), batch.column("call_id"), batch.column("turn"), batch.column("level"), pa.array(statuses, pa.string())]
            columns += [pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "call_id", "turn", "level", "status", "errors", "json"])

    kinds = {c: shaped.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return shaped.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, level long, status string, errors array<string>, json string")


#: The tool that stands for a request in plain conversations.
RESPOND = {
    "respond": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}},
    }
}


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations (conv_id, turn, role, text) as calls and results.

    A user's turn calls ``respond`` and refers to the call before it; the
    assistant's next turn is its result. System turns are neither. A null role,
    conversation or turn makes a row no turn.
    """
    said = turns.where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    asked = said.where("role = 'user'")
    earlier = asked.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    asked = asked.join(earlier, ["conv_id", "turn"], "left")
    before = F.when(F.col("follows"), name(F.col("turn") - 2))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", before.alias("after")))
    refs = F.when(before.isNotNull(), F.array(before))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("respond").alias("name"), arguments.alias("arguments"), refs.alias("refs"))
    replies = said.where("role = 'assistant'")
    results = replies.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
