"""Tool-call linking: calls and results joined by identifier, topologically ordered, validated, in canonical JSON.

Messages are (conv_id, turn, role, text). An `assistant` text that is a JSON object with `tool_calls` (a list of
{"id", "name", "arguments"}) makes calls; a `tool` text with `tool_call_id` and `content` makes a result. Arguments may
be an object or its JSON text. An argument value {"$ref": id} depends on another call of the conversation.

* Calls and results are joined by (conv_id, call id). Of calls that repeat an id, the first by turn, place and JSON
  counts, so do results; `n_calls` and `n_results` tell how many there were. A conversation of any size is only ever
  grouped by call id, by partial aggregation.
* `level` is 0 for calls that depend on no call, else one more than the highest level depended on; (level, turn, seq,
  call_id) is a topological order. Calls on a cycle, and those that need them, have no level and the error "cycle".
  Chains of single references are walked by doubled pointers; each round is one join, written to the shared folder.
* `status`: linked, early (the result's turn isn't after the call's), pending (no result), orphan (no call).
* `valid`: known name, arguments that meet its schema (a subset of JSON Schema, see `violations`), known references.
* `canonical`: sorted keys (by UTF-16 code units), no white space, shortest numbers.
* Messages that aren't such JSON, null roles and null texts make no rows. Null conv_ids are one conversation; null
  turns come first. Very long texts are parsed whole, one message at a time. An empty table gives an empty result;
  further columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import materialize, ship

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_EVENT = (
    "conv_id long, turn long, seq int, kind string, call_id string, name string, body string, refs array<string>, errors array<string>"
)


def canonical(value: object) -> str:
    """Canonical JSON of a parsed value; numbers that aren't finite raise ValueError."""
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number isn't finite")
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        mantissa, _, power = repr(value).partition("e")
        return mantissa + (f"e{'-' if power[0] == '-' else '+'}{power.lstrip('+-0')}" if power else "")
    return json.dumps(value, ensure_ascii=False)


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, required, properties, additionalProperties, items, minLength,
    maxLength, minimum, maximum."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = lambda k: number if k == "number" else number and float(value).is_integer() if k == "integer" else isinstance(value, _TYPES[k])
    if kinds and not any(fits(k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, str):
        out += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{path}: too long"] * (len(value) > schema.get("maxLength", math.inf))
    if number:
        out += [f"{path}: too small"] * (value < schema.get("minimum", -math.inf)) + [f"{path}: too large"] * (value > schema.get("maximum", math.inf))
    if isinstance(value, list) and "items" in schema:
        out += [x for k, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    return out


def references(value: object) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [str(value["$ref"])]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _strict(text: str) -> object:
    """Parsed JSON that has a canonical form; ValueError or RecursionError (too deep) otherwise."""

    def refuse(x: str) -> None:
        raise ValueError(f"not JSON: {x}")

    value = json.loads(text, parse_constant=refuse)
    canonical(value)
    return value


def _whole(x: str | None) -> str | None:
    """A string that UTF-8 can hold: lone surrogates, which JSON can escape, become question marks."""
    return x if x is None else x.encode("utf-8", "replace").decode()


def events_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(seq, kind, call_id, name, body, refs, errors) of one message."""
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return []
    try:
        message = _strict(text)
    except (ValueError, RecursionError):
        return []
    if role == "tool":
        if message.get("tool_call_id") is None:
            return []
        return [(0, "result", str(message["tool_call_id"]), None, canonical(message.get("content")), [], [])]
    calls = message.get("tool_calls")
    out = []
    for seq, call in enumerate(calls if isinstance(calls, list) else []):
        if not isinstance(call, dict) or call.get("id") is None:
            continue
        name, args, errors = call.get("name"), call.get("arguments", {}), []
        if isinstance(args, str):
            try:
                args = _strict(args)
            except (ValueError, RecursionError):
                errors.append("$: not JSON")
        if not isinstance(name, str) or name not in schemas:
            errors.append("unknown tool")
        elif not errors:
            errors += violations(args, schemas[name])
        refs = sorted(set(references(args)))
        out.append((seq, "call", str(call["id"]), name if isinstance(name, str) else None, canonical(args), refs, errors))
    return out


def extract(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    ship(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (conv, turn, seq, kind, *map(_whole, named), [*map(_whole, refs)], [*map(_whole, errors)])
                for conv, turn, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True)
                for seq, kind, *named, refs, errors in events_of(role, text, schemas)
            ]
            names = [x.strip().split()[0] for x in _EVENT.split(",")]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, _EVENT)


def _jumps(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, off): where the only references of calls lead, `off` steps on, before a call that doesn't
    have exactly one. Pointers double in each round, so rounds are the logarithm of the longest chain; what still
    moves after that many is on a cycle, or leads into one, and is left out."""
    now = materialize(single.select("conv_id", "call_id", F.col("dep").alias("at"), F.lit(1).cast("long").alias("off"), F.lit(False).alias("still")), "tool-jumps")
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("at").alias("to"), F.col("off").alias("more"), F.col("still").alias("ends"))
        open_ = now.filter("not still")
        moved = open_.join(step, open_["conv_id"].eqNullSafe(step["c"]) & (open_["at"] == step["i"]), "left")
        moved = moved.select("conv_id", "call_id", F.coalesce("to", "at").alias("at"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), (F.col("i").isNull() | F.col("ends")).alias("still"))
        now = materialize(now.filter("still").unionByName(moved), "tool-jumps")
        if now.filter("not still").isEmpty():
            break
    return now.filter("still").drop("still")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for calls that have one. edges: (conv_id, call_id, dep), dep being a call.

    Chains of calls with one reference each are jumped along; then calls with several get a level once all that they
    lead to has one, a round for each such call on the longest path.
    """
    key = ["conv_id", "call_id"]
    edges = materialize(edges.distinct(), "tool-edges")
    need = materialize(edges.groupBy(*key).agg(F.count("*").alias("deps"), F.min("dep").alias("dep")), "tool-need")
    met_by = lambda a, b, x, y: a["conv_id"].eqNullSafe(b[x]) & (a[y] == b["i"])
    named = need.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "deps")
    roots = calls.join(named, met_by(calls, named, "c", "call_id"), "left_anti").select(*key, F.lit(0).cast("long").alias("level"))
    last = found = materialize(roots, "tool-level")
    jumps = _jumps(need.filter("deps = 1").drop("deps"))
    # edges of calls with several references, over the chains that they lead to
    many = edges.join(named.filter("deps > 1"), met_by(edges, named, "c", "call_id")).select(*key, "dep", "deps")
    ones = need.filter("deps = 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.lit(True).alias("one"))
    many = many.join(ones, met_by(many, ones, "c", "dep"), "left").drop("c", "i")
    far = jumps.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("at").alias("to"), F.col("off").alias("more"))
    many = many.join(far, met_by(many, far, "c", "dep"), "left")
    many = many.filter("one is null or to is not null").select(*key, "deps", F.coalesce("to", "dep").alias("at"), (F.coalesce("more", F.lit(0)) + 1).alias("off"))
    many = materialize(many, "tool-many")
    met, rounds = None, 0
    while not many.isEmpty() and not last.isEmpty():
        rounds += 1
        reached = last.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "level")
        fresh = many.join(reached, met_by(many, reached, "c", "at")).groupBy(*key, "deps")
        fresh = fresh.agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("off")).alias("level"))
        met = fresh if met is None else met.unionByName(fresh).groupBy(*key, "deps").agg(F.sum("met").alias("met"), F.max("level").alias("level"))
        met = materialize(met, "tool-met")
        last = materialize(met.filter("met = deps").select(*key, "level"), "tool-level")
        met = met.filter("met < deps")
        found = found.unionByName(last) if rounds % 16 else materialize(found.unionByName(last), "tool-found")
    ends = found.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "level")
    along = jumps.join(ends, met_by(jumps, ends, "c", "at")).select(*key, (F.col("level") + F.col("off")).alias("level"))
    return found.unionByName(along).withColumn("level", F.col("level").cast("int"))


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call id of a conversation, and for each orphan result."""
    events = materialize(extract(messages, schemas), "tool-events")
    key = ["conv_id", "call_id"]
    first = lambda *cols: F.min(F.struct("turn", "seq", *cols))
    calls = events.filter("kind = 'call'").groupBy(*key).agg(first("body", "name", "refs", "errors").alias("call"), F.count("*").alias("n_calls"))
    calls = materialize(calls, "tool-calls")
    results = events.filter("kind = 'result'").groupBy(*key).agg(first("body").alias("result"), F.count("*").alias("n_results"))
    results = results.withColumnsRenamed({"conv_id": "c", "call_id": "i"}).hint("shuffle_hash")
    both = calls.join(results, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "full")
    refs = calls.select(*key, F.explode("call.refs").alias("dep"))
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    marked = materialize(
        refs.join(ids, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("dep") == F.col("i")), "left").select(*key, "dep", F.col("i").isNotNull().alias("known")),
        "tool-refs",
    )
    level = levels(calls.select(*key), marked.filter("known").select(*key, "dep")).withColumnsRenamed({"conv_id": "lc", "call_id": "li"})
    lost = marked.filter("not known").groupBy(*key).agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown reference "), "dep"))).alias("lost"))
    lost = lost.withColumnsRenamed({"conv_id": "xc", "call_id": "xi"})
    rows = both.withColumn("id", F.coalesce("call_id", "i")).withColumn("conv", F.when(F.col("call_id").isNull(), F.col("c")).otherwise(F.col("conv_id")))
    rows = rows.join(level, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("id") == F.col("li")), "left")
    rows = rows.join(lost, F.col("conv").eqNullSafe(F.col("xc")) & (F.col("id") == F.col("xi")), "left")
    has, got = F.col("call").isNotNull(), F.col("result").isNotNull()
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("call.errors", none), F.coalesce("lost", none), F.when(has & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce("call.body", F.lit("null")), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'),
        F.when(F.col("call.name").isNull(), "null").otherwise(quoted(F.col("call.name"))), F.lit(',"result":'), F.coalesce("result.body", F.lit("null")), F.lit("}"),
    )
    late = F.coalesce(F.col("result.turn"), F.lit(-1)) > F.coalesce(F.col("call.turn"), F.lit(-1))
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), F.coalesce("call.turn", "result.turn").alias("turn"),
        F.coalesce("call.seq", "result.seq").alias("seq"), F.col("call.name").alias("name"), "level",
        F.when(~has, "orphan").when(~got, "pending").when(late, "linked").otherwise("early").alias("status"),
        (has & (F.size(errors) == 0)).alias("valid"), F.array_join(errors, "; ").alias("errors"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), text.alias("canonical"),
    )


#: What a turn of plain text asks, as a call.
ASK = {
    "ask": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}


def as_tool_messages(turns: DataFrame) -> DataFrame:
    """Plain turns as tool messages: a user's turn is a call `ask` (after the user's turn before it, if it has one), an
    assistant's turn the result of the turn before it. Turns that are tool JSON already, and others, stay."""
    name = lambda t: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), t.cast("string"))
    json_text = F.coalesce(F.col("text"), F.lit("")).rlike(r'(?s)^\s*\{.*"tool_call')
    after = F.when(F.col("turn") >= 2, F.struct(name(F.col("turn") - 2).alias("$ref")))
    call = F.struct(name(F.col("turn")).alias("id"), F.lit("ask").alias("name"), F.struct("text", "turn", after.alias("after")).alias("arguments"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    answered = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user, answer = ~json_text & (F.col("role") == "user"), ~json_text & (F.col("role") == "assistant")
    return turns.select(
        "conv_id", "turn",
        F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, asked).when(answer, answered).otherwise(F.col("text")).alias("text"),
    )


def link_conversations(turns: DataFrame) -> DataFrame:
    return link(as_tool_messages(turns), ASK)
