"""Chat formatting: linking tool calls to results.

Calls and results meet in a hash join on (conversation, identifier). A call may name
one earlier call whose result it uses (``after``); calls are ordered topologically by the
length of that chain, then by position. Chains are resolved by pointer jumping: each round joins
every call with the call it points to and doubles the distance, so a chain of n calls takes log2 n rounds
whatever conversation holds it, and what still points on after that hangs on a cycle.
Arguments are validated against the tool's schema and each call is serialised as canonical
JSON (sorted keys, no spaces, no escapes beyond the required).

Ranks within a conversation come from counts per (conversation, depth, block of positions), so
no conversation is gathered in one task.

Defined results: of calls with one identifier in a conversation the first by position is the call, the
others are reported as duplicates without a result; of several results the first by position
counts and ``n_results`` tells how many there are; calls without a result are 'unanswered', results
without a call 'orphan' (no order); an unknown ``after`` starts a chain ('dangling'); calls on a
cycle come last. Null identifiers link with nothing; unknown tools, null and malformed arguments
are invalid with a reason (so is text with half a surrogate pair); a schema with an unsupported keyword is an error; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, table, written

BLOCK = 512
#: Schemas of the registered query: a subset of JSON Schema.
SCHEMAS = {
    "lookup": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "summarise": {"required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1}}},
    "translate": {"required": ["text", "to"], "properties": {"text": {"type": "string"}, "to": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Keywords by the types they speak of ("" for any); a schema with another keyword is refused when the query is built.
_KEYWORDS = {"": {"type", "enum", "description"}, "string": {"minLength", "maxLength", "pattern"}, "number": {"minimum", "maximum"},
             "array": {"items", "minItems", "maxItems"}, "object": {"properties", "required"}}


def check_schema(schema: dict, at: str = "schema") -> None:
    """Raises for keywords and types that ``problems`` doesn't know, so that nothing counts as valid unchecked."""
    if unknown := set(schema).difference(*_KEYWORDS.values()):
        raise ValueError(f"{at}: unsupported keywords {sorted(unknown)}")
    if unknown := set(_kinds(schema)) - set(_TYPES):
        raise ValueError(f"{at}: unknown types {sorted(unknown)}")
    re.compile(schema.get("pattern", ""))
    for k, rule in schema.get("properties", {}).items():
        check_schema(rule, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _kinds(schema: dict) -> list[str]:
    kind = schema.get("type", [])
    return [kind] if isinstance(kind, str) else kind


def _is(v: object, kind: str) -> bool:
    return isinstance(v, _TYPES[kind]) and (kind == "boolean" or not isinstance(v, bool))


def _value_problems(v: object, rule: dict, name: str) -> list[str]:
    """What is wrong with one value; bounds count only for values of the type they speak of."""
    kinds = _kinds(rule)
    if kinds and not any(_is(v, k) for k in kinds):
        return [f"{name} is no {' or '.join(kinds)}"]
    if "enum" in rule and not any(type(v) is type(x) and v == x for x in rule["enum"]):
        return [f"{name} not allowed"]
    out = []
    if _is(v, "number"):
        out += [f"{name} too small"] * (v < rule.get("minimum", v)) + [f"{name} too large"] * (v > rule.get("maximum", v))
    elif isinstance(v, str):
        out += [f"{name} too short"] * (len(v) < rule.get("minLength", 0)) + [f"{name} too long"] * (len(v) > rule.get("maxLength", len(v)))
        out += [f"{name} has another form"] * ("pattern" in rule and not re.search(rule["pattern"], v))
    elif isinstance(v, list):
        out += [f"{name} has too few items"] * (len(v) < rule.get("minItems", 0)) + [f"{name} has too many items"] * (len(v) > rule.get("maxItems", len(v)))
        out += [p for i, x in enumerate(v) for p in _value_problems(x, rule.get("items", {}), f"{name}[{i}]")]
    elif isinstance(v, dict) and ("properties" in rule or "required" in rule):
        out += _object_problems(v, rule, f"{name}.")
    return out


def _object_problems(arguments: dict, schema: dict, at: str = "") -> list[str]:
    out = [f"missing {at}{k}" for k in schema.get("required", []) if k not in arguments]
    for k, v in sorted(arguments.items()):
        rule = schema.get("properties", {}).get(k)
        out += [f"unexpected {at}{k}"] if rule is None else _value_problems(v, rule, f"{at}{k}")
    return out


def problems(arguments: object, schema: dict | None) -> list[str]:
    """What is wrong with ``arguments``; properties a schema doesn't list aren't allowed."""
    if schema is None:
        return ["unknown tool"]
    return _object_problems(arguments, schema) if isinstance(arguments, dict) else ["not an object"]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _no_constant(x: str):
    raise ValueError(x)


def parsed(text: str | None) -> tuple[object, str]:
    """(value, why it is no JSON or ""); NaN and infinities aren't JSON, nor are numbers that become one, nor text with half of a
    surrogate pair, which is no Unicode text and can't be stored."""
    if text is None:
        return None, "no arguments"
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=lambda x: v if math.isfinite(v := float(x)) else _no_constant(x))
        canonical(value).encode()
        return value, ""
    except UnicodeEncodeError:
        return text, "not Unicode"
    except (ValueError, RecursionError):
        return text, "not JSON"


def depths(calls: DataFrame) -> DataFrame:
    """``(conv, call, depth, topology)`` of ``calls(conv, call, after)`` with unique (conv, call)."""
    known = calls.select(F.col("conv").alias("p_conv"), F.col("call").alias("p_call"))
    state = calls.join(known, (F.col("conv") == F.col("p_conv")) & (F.col("after") == F.col("p_call")), "left").select(
        "conv", "call", F.col("p_call").alias("up"), F.when(F.col("p_call").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        (F.col("after").isNotNull() & F.col("p_call").isNull()).alias("dangling"))
    state = written(state, "calls-0")
    rounds = max(1, state.count()).bit_length() + 1
    for k in range(rounds):
        if state.filter("up is not null").isEmpty():
            break
        parent = state.select(F.col("conv").alias("p_conv"), F.col("call").alias("p_call"), F.col("up").alias("p_up"), F.col("depth").alias("p_depth"))
        state = written(state.join(parent, (F.col("conv") == F.col("p_conv")) & (F.col("up") == F.col("p_call")), "left").select(
            "conv", "call", F.col("p_up").alias("up"), (F.col("depth") + F.coalesce("p_depth", F.lit(0))).alias("depth"), "dangling"), f"calls-{k + 1}")
    topology = F.when(F.col("up").isNotNull(), "cycle").when(F.col("dangling"), "dangling").otherwise("ok")
    return state.select("conv", "call", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), topology.alias("topology"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``calls(conv_id, call_id, name, arguments, after, position)`` and ``results(conv_id,
    call_id, content, position)`` to one row per call and per identifier of orphan results:
    ``conv_id, call_id, order_no, depth, topology, status, valid, errors, n_results, json``."""
    session(calls)
    for name, schema in schemas.items():
        check_schema(schema, name)
    c = written(calls.select(
        F.monotonically_increasing_id().alias("uid"), F.col("conv_id").cast("long").alias("conv"), F.col("call_id").cast("string").alias("call"),
        F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"),
        F.col("after").cast("string").alias("after"), F.col("position").cast("long").alias("position")), "calls")
    first = c.groupBy("conv", "call").agg(F.min(F.struct(F.col("position").isNull().alias("n"), "position", "uid", "after")).alias("f"))
    first = first.filter("conv is not null and call is not null").select("conv", "call", F.col("f.uid").alias("first_uid"), F.col("f.after").alias("after"))
    level = depths(first.select("conv", "call", "after")).withColumnsRenamed({"conv": "d_conv", "call": "d_call"})
    r = (results.select(F.col("conv_id").cast("long").alias("r_conv"), F.col("call_id").cast("string").alias("r_call"),
                        F.struct(F.col("position").isNull().alias("n"), F.col("position").cast("long").alias("position"),
                                 F.col("content").cast("string").alias("content")).alias("x"))
         .groupBy("r_conv", "r_call").agg(F.min("x").alias("x"), F.count("*").alias("n_results"))
         .select("r_conv", "r_call", F.col("x.content").alias("content"), "n_results"))
    ids = first.select(F.col("conv").alias("f_conv"), F.col("call").alias("f_call"), "first_uid")
    full = (c.join(ids, (F.col("conv") == F.col("f_conv")) & (F.col("call") == F.col("f_call")), "left")
            .join(level, (F.col("conv") == F.col("d_conv")) & (F.col("call") == F.col("d_call")), "left")
            .withColumn("own", F.coalesce(F.col("uid") == F.col("first_uid"), F.lit(False)))
            .join(r, (F.col("conv") == F.col("r_conv")) & (F.col("call") == F.col("r_call")) & F.col("own"), "left"))
    full = full.withColumn("depth", F.when(F.col("own"), F.col("depth"))).withColumn(
        "key", F.struct(F.col("depth").isNull().alias("late"), "depth", F.expr(f"position div {BLOCK}").alias("block")))
    status = (F.when(F.col("conv").isNull() | F.col("call").isNull(), "unidentified").when(~F.col("own"), "duplicate")
              .when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
    full = written(full.select("uid", "conv", "call", "name", "arguments", "after", "position", "depth", "key", "content", status.alias("status"),
                               F.when(F.col("own"), F.col("topology")).otherwise("none").alias("topology"),
                               F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results")), "calls-linked")
    block = full.groupBy("conv", "key").agg(F.count("*").alias("m"))
    ahead = block.withColumn("ahead", F.sum("m").over(Window.partitionBy("conv").orderBy("key")) - F.col("m")).select(
        F.col("conv").alias("a_conv"), F.col("key").alias("a_key"), "ahead")
    rank = F.row_number().over(Window.partitionBy("conv", "key").orderBy("position", "call", "uid"))
    ranked = full.withColumn("rank", rank).join(ahead, F.col("conv").eqNullSafe(F.col("a_conv")) & F.col("key").eqNullSafe(F.col("a_key")))

    def finish(batches):
        for p in batches:
            valid, errors, text = [], [], []
            for row in p.itertuples(index=False):
                value, why = parsed(_plain(row.arguments))
                wrong = [why] if why else problems(value, schemas.get(row.name))
                item = {"id": _plain(row.call), "name": _plain(row.name), "arguments": value, "after": _plain(row.after)}
                if row.status == "linked":
                    item["result"] = _plain(row.content)
                valid.append(not wrong)
                errors.append("; ".join(wrong))
                text.append(canonical(item))
            yield pd.DataFrame({"conv_id": p["conv"], "call_id": p["call"], "order_no": p["order_no"], "depth": p["depth"].astype("Int64"),
                                "topology": p["topology"], "status": p["status"], "valid": valid, "errors": errors, "n_results": p["n_results"], "json": text})

    schema = "conv_id long, call_id string, order_no long, depth long, topology string, status string, valid boolean, errors string, n_results long, json string"
    done = ranked.select("conv", "call", "name", "arguments", "after", "content", "depth", "topology", "status", "n_results",
                         (F.col("ahead") + F.col("rank")).cast("long").alias("order_no")).mapInPandas(finish, schema)
    orphan = r.join(ids, (F.col("r_conv") == F.col("f_conv")) & (F.col("r_call") == F.col("f_call")), "left_anti").select(
        F.col("r_conv").alias("conv_id"), F.col("r_call").alias("call_id"), F.lit(None).cast("long").alias("order_no"),
        F.lit(None).cast("long").alias("depth"), F.lit("none").alias("topology"), F.lit("orphan").alias("status"), F.lit(False).alias("valid"),
        F.lit("no call").alias("errors"), F.col("n_results").cast("long").alias("n_results"), F.lit(None).cast("string").alias("json"))
    return done.unionByName(orphan)


def _plain(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations stand for (they hold none themselves): every assistant turn
    calls one of three tools with its text, depends on an assistant turn about half way back, and the next user turn is
    its result. By word count, some arguments have a number as text, a property too many or no text."""
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    parity = F.pmod("turn", F.lit(2))
    before = F.expr("(turn - pmod(turn, 2)) div 4") * 2 + parity
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    number = F.when(words % 5 == 0, F.to_json(F.struct(words.cast("string").alias("v")))).otherwise(F.to_json(F.struct(words.alias("v"))))
    number = F.regexp_extract(number, r'^\{"v":(.*)\}$', 1)
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    extra = F.when(words % 7 == 0, F.lit(', "note": null')).otherwise(F.lit(""))
    body = (F.when(kind == 0, F.concat(F.lit('"query": '), quoted, F.lit(', "limit": '), number))
            .when(kind == 1, F.concat(F.lit('"words": '), number, F.when(words % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(', "text": '), quoted))))
            .otherwise(F.concat(F.lit('"to": "'), F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "xx"])), (words % 5 + 1).cast("int")),
                                F.lit('", "text": '), quoted)))
    tool = F.element_at(F.array(*map(F.lit, ["lookup", "summarise", "translate"])), (kind + 1).cast("int"))
    calls = t.filter("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), tool.alias("name"), F.concat(F.lit("{"), body, extra, F.lit("}")).alias("arguments"),
        F.when((before < F.col("turn")) & (before > 0), name(before)).alias("after"), F.col("turn").alias("position"))
    results = t.filter("role = 'user' and turn > 0").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("position"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of(table(spark, sf_dir, "conversations")))
