"""Tool calls of chats: linking, ordering, validation and canonical JSON.

Calls and results meet in a hash join on their identifier within a conversation.
Calls are ordered topologically by (level, turn, call_id): level is the largest
number of dependencies on a later turn along any path to the call, so calls
whose dependencies all lie in earlier turns keep the order of turns without any
iteration, and only conversations with backward dependencies are gone through,
in pieces of bounded size, round by round.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, fresh, materialise, task

#: Schema of the calls that plain chats are read as.
ASK_SCHEMA = {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "role": {"enum": ["user"]}}, "required": ["prompt", "turn"], "additionalProperties": False}

_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """Paths and rules that ``value`` breaks: type, enum, bounds, lengths, required, properties, additionalProperties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: type"]
    out = []
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        out.append(f"{path}: enum")
    if _is(value, "number"):
        out += [f"{path}: {rule}" for rule, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{path}: {rule}" for rule, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], f"{path}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{name}: required" for name in schema.get("required", []) if name not in value]
        for name, x in value.items():
            if name in known:
                out += schema_errors(x, known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{name}: additionalProperties")
    return out


def canonical(value) -> str:
    """Sorted keys, no spaces, whole floats as integers; numbers that JSON lacks become null."""

    def plain(x):
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return valid(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def valid(text: str) -> str:
    """``text`` with lone surrogates, which no encoding of Unicode holds, as U+FFFD."""
    return _SURROGATE.sub("\ufffd", text)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """(value, broken rules) of a call's arguments. What is no JSON, or nested more deeply than Python's parser goes, stays text and is an error."""
    try:
        value = json.loads(arguments if arguments is not None else "null")
        canonical(value)
        return value, [valid(e) for e in schema_errors(value, schemas[name])] if name in schemas else [f"{name}: unknown tool"]
    except RecursionError:
        return arguments, ["$: too deep"]
    except ValueError:
        return arguments, ["$: not JSON"]


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments, needs) and results (conv_id, turn, call_id, content) of chats.

    A text that is a JSON object with ``tool_calls`` (id, name, arguments,
    depends_on) makes those calls; one with ``tool_call_id`` is a result. Any
    other user turn is a call of the tool ``ask`` that needs the one two turns
    before it, and any other assistant turn the result of the call one turn
    before it. Null texts are empty prompts; null roles are neither.
    """
    call = "struct<id:string,name:string,arguments:string,depends_on:array<string>>"
    told = F.when(F.substring("text", 1, 1) == "{", F.from_json("text", f"tool_calls array<{call}>, tool_call_id string, content string"))
    rows = conversations.select("conv_id", F.col("turn").cast("long"), "role", F.col("text").cast("string"), told.alias("told"))
    has_calls, is_result = F.coalesce(F.size("told.tool_calls") > 0, F.lit(False)), F.col("told.tool_call_id").isNotNull()
    plain = ~has_calls & ~is_result
    given = rows.where(has_calls).select("conv_id", "turn", F.explode("told.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("needs"))
    asked = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn", "role"))
    number = lambda x: F.concat(F.lit("ask-"), x.cast("string"))
    needs = F.when(F.col("turn") >= 2, F.array(number(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    asks = rows.where(plain & (F.col("role") == "user")).select("conv_id", "turn", number(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"), asked.alias("arguments"), needs.alias("needs"))
    results = rows.where(is_result).select("conv_id", "turn", F.col("told.tool_call_id").alias("call_id"), F.coalesce("told.content", F.lit("")).alias("content"))
    answers = rows.where(plain & (F.col("role") == "assistant")).select("conv_id", "turn", number(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return given.unionByName(asks), results.unionByName(answers)


def as_tool_chats(conversations: DataFrame) -> DataFrame:
    """Plain chats told as tool calls: (conv_id, turn, role, text), the same in every run.

    A user turn calls the tool ``ask`` with its text; the next turn's answer is
    the result. A call needs the one two turns before it, but for turns 2, 8, 14
    and so on, which need the call two turns after them (that one then needs
    none): their results have to be ordered against the turns.
    """
    turn = F.col("turn").cast("long")
    number = lambda x: F.concat(F.lit("call-"), x.cast("string"))
    needs = F.when(turn % 6 == 2, F.array(number(turn + 2))).when((turn % 6 == 4) | (turn < 2), F.array().cast("array<string>")).otherwise(F.array(number(turn - 2)))
    asked = F.to_json(F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("prompt"), turn.alias("turn"), "role"))
    call = F.to_json(F.struct(F.array(F.struct(number(turn).alias("id"), F.lit("ask").alias("name"), asked.alias("arguments"), needs.alias("depends_on"))).alias("tool_calls")))
    result = F.to_json(F.struct(number(turn - 1).alias("tool_call_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content")))
    return conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))


def settled(call_ids: list, needs: list, back: list[int], known: list) -> dict:
    """Levels of the calls that can be ordered: a row a link (call, need, 1 if the need is on a later turn, level of a need that is known)."""
    waiting, needed_by, level = Counter(call_ids), defaultdict(list), dict.fromkeys(call_ids, 0)
    ready = []

    def arrive(call, at):
        level[call] = max(level[call], at)
        waiting[call] -= 1
        if not waiting[call]:
            ready.append(call)

    for call, need, step, at in zip(call_ids, needs, back, known, strict=True):
        if at is None:
            needed_by[need].append((call, step))
        else:
            arrive(call, at + step)
    done = {}
    while ready:
        call = ready.pop()
        done[call] = level[call]
        for other, step in needed_by[call]:
            arrive(other, level[call] + step)
    return done


def skipped(links: DataFrame, longer: DataFrame) -> DataFrame:
    """``links`` where each call with one need, in the conversations of ``longer`` (c, n links), needs the end of its chain instead.

    Steps double: a chain is gone after log2 of its length rounds, and its
    ``back`` is the sum of those on the way. What still moves after as many
    rounds as the largest conversation can need runs in a circle.
    """
    rounds = int(longer.agg(F.max("n")).first()[0]).bit_length() + 1
    inside = links.join(longer.select("c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    one = inside.groupBy("conv_id", "call_id").agg(F.count("*").alias("k")).where("k = 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"))
    one = materialise(one)
    mine = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n"))
    chains = materialise(links.join(one, mine, "left_semi"))
    for _ in range(rounds):
        ahead = chains.where("need <> call_id").select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("need").alias("next"), F.col("back").alias("more"))
        moved = chains.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("n")), "left")
        moved = materialise(moved.select(*links.columns, "next", "more"))
        if not moved.where("next IS NOT NULL").head(1):
            break
        chains = moved.withColumns({"need": F.coalesce("next", "need"), "back": F.least(F.col("back").cast("long") + F.coalesce("more", F.lit(0)), F.lit(1 << 30)).cast("int")}).drop("next", "more")
    return materialise(links.join(one, mine, "left_anti").unionByName(chains))


def levels(calls: DataFrame, links_per_piece: int = 10_000) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of distinct calls; needs that name no call of the conversation are left out.

    Only conversations with a link to a later turn are gone through, each cut by
    turn (and, where one turn has very many calls, by identifier) into pieces of
    about ``links_per_piece`` links. In a round every piece orders what it can
    from the levels known before, so a conversation of one piece takes one
    round. In longer ones calls with one need skip along it first
    (``skipped``), so a round is needed only where a path through calls with
    several needs changes pieces. What no round can order is on a cycle or
    needs one.
    """
    nodes = calls.select("conv_id", "call_id", "turn")
    there = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("known"), F.col("turn").alias("t"))
    links = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need"))
    links = links.join(there, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("known"))).select("conv_id", "call_id", "turn", "need", F.coalesce(F.col("t") >= F.col("turn"), F.lit(False)).cast("int").alias("back"))
    links = materialise(links)
    odd = materialise(links.groupBy("conv_id").agg(F.max("back").alias("turned"), F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high")).where("turned = 1").withColumnRenamed("conv_id", "c"))
    if not odd.head(1):
        return nodes.select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    ranges = 1 + F.floor(F.col("n") / links_per_piece)
    place = F.coalesce(F.floor((F.col("turn") - F.col("low")) * ranges / (F.col("high") - F.col("low") + 1)), F.lit(0)).cast("int")
    own = links.join(odd, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("range", place).select("conv_id", "call_id", "need", "back", "range")
    size = own.groupBy("conv_id", "range").agg((1 + F.floor(F.count("*") / (4 * links_per_piece))).cast("int").alias("salts")).select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "salts")
    own = materialise(own.join(size, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).withColumn("salt", F.pmod(F.xxhash64("call_id"), F.col("salts")).cast("int")).drop("c", "r", "salts"))
    longer = odd.where(F.col("n") > links_per_piece).select("c", "n")
    if longer.head(1):
        own = skipped(own, longer)
    kind = calls.schema["conv_id"].dataType.simpleString()

    def order(table):
        done = settled(*(table[c].to_pylist() for c in ("call_id", "need", "back", "level")))
        return pa.table([table["conv_id"].take(pa.array(np.zeros(len(done), np.int64))), pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int32())], names=["conv_id", "call_id", "level"])

    inside = links.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n")).distinct()
    first = nodes.join(odd.select(F.col("c").alias("o")), F.col("conv_id").eqNullSafe(F.col("o"))).join(inside, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n")), "left_anti")
    known = materialise(first.select("conv_id", "call_id", F.lit(0).alias("level")))
    while True:
        of = known.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), "level")
        asked = own.join(of.drop("level"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n")), "left_anti").join(of, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("n")), "left").drop("c", "n")
        found = materialise(asked.groupBy("conv_id", "range", "salt").applyInArrow(order, f"conv_id {kind}, call_id string, level int"))
        if not found.head(1):
            break
        known = known.union(found)
    found = known.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("level").alias("l"))
    out = nodes.join(odd.select(F.col("c").alias("o"), F.lit(True).alias("through")), F.col("conv_id").eqNullSafe(F.col("o")), "left")
    out = out.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n")), "left")
    return out.select("conv_id", "call_id", F.coalesce("l", F.lit(0)).alias("level"), (F.col("through").isNotNull() & F.col("l").isNull()).alias("cyclic"))


def firsts(rows: DataFrame, *rest: str) -> tuple[DataFrame, DataFrame | None]:
    """(first row of each identifier by turn, then by a hash of ``rest``; the other rows, None where no identifier is used again).

    Which row is first is found without the texts. They are joined only where
    some identifier is used again: a plain join, which the adaptive planner can
    split however often one is. Equal rows are one row and a count on the way.
    """
    hashed, key = fresh("hash"), ["conv_id", "call_id"]
    own = rows.where("call_id IS NOT NULL").withColumn(hashed, F.xxhash64(*rest))
    place = F.struct("turn", hashed)
    counted = own.groupBy(*key, "turn", hashed).agg(F.count("*").alias("times"))
    least = materialise(counted.groupBy(*key).agg(F.min(place).alias("m"), F.min_by("times", place).alias("m_times"), F.sum("times").alias("all")))
    if not least.where("all > 1").head(1):
        return own.drop(hashed), None
    known = least.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), "m", "m_times")
    found = own.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n")))
    same = place.eqNullSafe(F.col("m"))
    one, several = found.where(same & (F.col("m_times") == 1)), found.where(same & (F.col("m_times") > 1)).dropDuplicates(key)
    again = several.withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), F.col("m_times"))))
    return one.unionByName(several).select(rows.columns), found.where(~same).select(rows.columns).unionByName(again.select(rows.columns))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call with its result, if any, and for each other result: every call and result is in one row.

    (conv_id, call_id, call_turn, result_turn, status, level, errors, message):
    status is linked, missing_result, early_result (its turn isn't after the
    call's), cyclic (on a cycle of needs, or needing one) or orphan_result;
    errors are the broken rules of the arguments, null for rows without a call;
    message is canonical JSON. Of calls or results with one identifier the first
    by turn (then by a hash of the content) is linked; each other one is a
    duplicate_call or duplicate_result of its own, at level 0. Null identifiers
    never link: those calls and results are missing_id. Null conversations are
    one conversation; empty tables give an empty result.
    """

    def alone(df, status, is_call):
        null = lambda kind: F.lit(None).cast(kind)
        turn = F.col("turn").cast("long")
        turns = (turn, null("long")) if is_call else (null("long"), turn)
        rest = ("name", "arguments", null("string").alias("content")) if is_call else (null("string").alias("name"), null("string").alias("arguments"), "content")
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", turns[0].alias("call_turn"), turns[1].alias("result_turn"), F.lit(status).alias("status"), F.lit(0).alias("level"), *rest, F.lit(is_call).alias("is_call"))

    c, more_calls = firsts(calls, "name", "arguments", "needs")
    first_results, more_results = firsts(results, "content")
    r = first_results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rid"), F.col("turn").alias("result_turn"), "content")
    lv = levels(materialise(c.select("conv_id", "call_id", "turn", "needs"))).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("lid"), "level", "cyclic")
    known = c.join(lv, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("lid")), "left")
    both = known.join(r, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rid")), "full")
    status = F.when(F.col("call_id").isNull(), "orphan_result").when(F.col("cyclic"), "cyclic").when(F.col("rid").isNull(), "missing_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("linked")
    rows = both.select(F.coalesce("conv_id", "rc").cast("long").alias("conv_id"), F.coalesce("call_id", "rid").alias("call_id"), F.col("turn").alias("call_turn"), "result_turn", status.alias("status"), F.coalesce("level", F.lit(0)).alias("level"), "name", "arguments", "content", F.col("call_id").isNotNull().alias("is_call"))
    for df, why, is_call in ((more_calls, "duplicate_call", True), (more_results, "duplicate_result", False), (calls.where("call_id IS NULL"), "missing_id", True), (results.where("call_id IS NULL"), "missing_id", False)):
        if df is not None:
            rows = rows.unionByName(alone(df, why, is_call))
    schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("call_turn", pa.int64()), ("result_turn", pa.int64()), ("status", pa.string()), ("level", pa.int32()), ("errors", pa.list_(pa.string())), ("message", pa.string())])

    def write(batches):
        for batch in batches:
            errors, out = [], []
            for name, arguments, content, call_id, is_call in zip(*(batch.column(x).to_pylist() for x in ("name", "arguments", "content", "call_id", "is_call")), strict=True):
                message = {"id": call_id}
                wrong = None
                if is_call:
                    value, wrong = checked(name, arguments, schemas)
                    message |= {"name": name, "arguments": value}
                if content is not None:
                    message["result"] = content
                errors.append(wrong)
                out.append(canonical(message))
            yield batch_of(schema, *(batch.column(i) for i in range(6)), errors, out)

    return rows.mapInArrow(task(write), "conv_id long, call_id string, call_turn long, result_turn long, status string, level int, errors array<string>, message string")
