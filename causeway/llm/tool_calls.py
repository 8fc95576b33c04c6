"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, release

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)

#: Arguments nested deeper are reported, not read: readers of JSON stop somewhere, and this place is the same everywhere.
DEPTH = 400


def _escaped(text: str) -> str:
    """``text`` without lone surrogates, which no UTF-8 text can hold: their JSON escapes take their place."""
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def _number(value) -> str:
    """Equal numbers have one text: plain below 1e21 and from 1e-7 on, else with an exponent."""
    sign, digits, power = Decimal(repr(value) if isinstance(value, float) else value).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    short = digits.rstrip("0")
    if not short:
        return "0"
    power += len(digits) - len(short)
    top = len(short) + power  # digits before the point
    if top > 21 or top < -5:
        text = short[0] + ("." + short[1:] if len(short) > 1 else "") + f"e{top - 1:+d}"
    elif power >= 0:
        text = short + "0" * power
    elif top > 0:
        text = f"{short[:top]}.{short[top:]}"
    else:
        text = "0." + "0" * -top + short
    return "-" * sign + text


def canonical(value) -> str:
    """One text per JSON value: keys sorted by UTF-16 code units, no spaces, one text per number, only needed escapes.

    Values of any depth are walked with a list of what is left to write.
    """
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Text):
            out.append(v)
        elif isinstance(v, dict):
            keys, inner = sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass")), []
            for k in keys:
                inner += [_Text("," if inner else ""), _Text(_escaped(json.dumps(k, ensure_ascii=False)) + ":"), v[k]]
            todo += [_Text("}"), *reversed(inner), _Text("{")]
        elif isinstance(v, list):
            inner = [x for i, e in enumerate(v) for x in ((_Text(","), e) if i else (e,))]
            todo += [_Text("]"), *reversed(inner), _Text("[")]
        elif isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            out.append(_number(v))
        else:
            out.append(_escaped(json.dumps(v, ensure_ascii=False)))
    return "".join(out)


class _Text(str):
    """A piece of finished text among values still to be written."""


def _deep(text: str) -> bool:
    """Whether brackets outside strings nest deeper than ``DEPTH``."""
    if text.count("[") + text.count("{") <= DEPTH:
        return False
    depth = 0
    for c in _BRACKETS.findall(text):
        if c in "[{":
            depth += 1
            if depth > DEPTH:
                return True
        elif c in "]}":
            depth -= 1
    return False


def parsed(text: str | None):
    """The value of a JSON text; ``ValueError`` for anything that isn't one.

    Repeated keys, numbers beyond doubles, numbers that are no JSON and values
    nested deeper than ``DEPTH`` are refused. Fractions come as exact decimals.
    """

    def once(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("repeated key")
        return out

    def finite(text):
        if float(text) in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        try:
            return Decimal(text)
        except ArithmeticError as e:
            raise ValueError("number out of range") from e

    def refuse(name):
        raise ValueError(name)

    if text is None:
        raise ValueError("no text")
    if _deep(text):
        raise ValueError("nested too deeply")
    return json.loads(text, object_pairs_hook=once, parse_constant=refuse, parse_float=finite)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Places where a value breaks a schema of types, ranges, lengths, choices, items and properties."""
    out, todo = [], [(value, schema, at)]
    while todo:
        value, schema, at = todo.pop()
        kind = schema.get("type")
        number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
        if kind in ("integer", "number"):
            if not number or kind == "integer" and value != int(value):
                out.append(f"{at}: not {kind}")
                continue
        elif kind and (not isinstance(value, _KINDS[kind])):
            out.append(f"{at}: not {kind}")
            continue
        if "enum" in schema and not any(canonical(value) == canonical(v) for v in schema["enum"]):
            out.append(f"{at}: not one of the choices")
        if isinstance(value, (str, list)):
            short, long = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
            if len(value) < schema.get(short, 0):
                out.append(f"{at}: too short")
            if len(value) > schema.get(long, len(value)):
                out.append(f"{at}: too long")
        if number:
            if value < schema.get("minimum", value):
                out.append(f"{at}: too small")
            if value > schema.get("maximum", value):
                out.append(f"{at}: too large")
        if isinstance(value, list) and "items" in schema:
            todo += [(v, schema["items"], f"{at}[{i}]") for i, v in enumerate(value)]
        if isinstance(value, dict):
            known = schema.get("properties", {})
            out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
            for k, v in value.items():
                if k in known:
                    todo.append((v, known[k], f"{at}.{k}"))
                elif schema.get("additionalProperties") is False:
                    out.append(f"{at}.{k}: unknown")
    return [_escaped(e) for e in out]


def references(value) -> list[str]:
    """Identifiers of the calls whose results a value refers to, as ``{"$ref": id}``."""
    stack, found = [value], []
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if len(v) == 1 and isinstance(v.get("$ref"), str):
                found.append(v["$ref"])
            else:
                stack += v.values()
        elif isinstance(v, list):
            stack += v
    return sorted({_escaped(r) for r in found})


def _checked(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, refs, texts = [], [], []
            for call_id, name, arguments in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                try:
                    value = parsed(arguments)
                    bad = violations(value, schemas[name]) if name in schemas else ["$: unknown tool"]
                    ref = references(value)
                except ValueError as e:
                    value, bad, ref = arguments, ["$: nested too deeply" if str(e) == "nested too deeply" else "$: not JSON"], []
                errors.append(sorted(bad))
                refs.append(ref)
                texts.append(canonical({"arguments": value, "id": call_id, "name": name, "type": "call"}))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, lists), pa.array(refs, lists), pa.array(texts, pa.string())], [*batch.schema.names, "errors", "refs", "message"])

    return run


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [canonical({"content": c, "id": i, "type": "result"}) for i, c in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], [*batch.schema.names[:3], "message"])


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest chain of references below each call; calls on or behind a cycle get none.

    ``nodes(c, i)``, ``edges(c, i, on)``. One round per level settles all calls
    whose references are settled, in all conversations at once.
    """
    done = cut(nodes.join(edges.select("c", "i").distinct(), ["c", "i"], "left_anti").withColumn("level", F.lit(0)))
    todo, all_done, level = cut(edges), done, 0
    while not todo.isEmpty():
        left = todo.join(done.select("c", F.col("i").alias("on")), ["c", "on"], "left_anti").select("c", "i", "on")
        left = cut(left)
        level += 1
        done = cut(todo.select("c", "i").distinct().join(left.select("c", "i").distinct(), ["c", "i"], "left_anti").withColumn("level", F.lit(level)))
        release(todo)
        todo = left
        if done.isEmpty():
            break
        all_done = all_done.union(done)
    return all_done


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Events in topological order: ``conv_id, call_id, kind, turn, level, status, errors, message``.

    ``calls(conv_id, call_id, turn, name, arguments)``, ``results(conv_id,
    call_id, turn, content)``; both joined by conversation and identifier.
    Sorting by ``level, turn, call_id, kind`` within a conversation puts each
    call after all calls it refers to and each result after its call.

    A call is ``linked`` or ``unanswered``; of calls with one identifier that
    differ, all but the least are ``duplicate``. A result is ``linked`` or
    ``orphan``. Rows with a null conversation or identifier are
    ``unidentified``. Arguments that are null, no JSON, or break the schema
    of their tool are reported in ``errors``; a reference to an identifier
    unknown in the conversation is an error too. ``level`` is null for
    results without call and for calls on or behind a cycle of references.
    ``message`` is canonical JSON. Repeated rows stay; other columns are
    ignored. Rounds grow with the depth of references, not with the length
    of a conversation.
    """
    key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    asked = calls.select(F.col("conv_id").cast("string"), F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("name").cast("string"), F.col("arguments").cast("string"))
    asked = cut(asked.mapInArrow(_checked(schemas), "conv_id string, call_id string, turn long, name string, arguments string, errors array<string>, refs array<string>, message string"))
    given = results.select(F.col("conv_id").cast("string"), F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("content").cast("string"))
    given = cut(given.mapInArrow(_written, "conv_id string, call_id string, turn long, message string"))

    first = cut(asked.filter(key).groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.min(F.struct("turn", "message")).alias("first")))
    answers = given.filter(key).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).distinct().withColumn("answered", F.lit(True))
    edges = cut(asked.filter(key).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.explode("refs").alias("on")).distinct())
    names = first.select("c", F.col("i").alias("on"), F.lit(True).alias("there"))
    checked = cut(edges.join(names, ["c", "on"], "left"))
    unknown = checked.filter("there is null").groupBy("c", "i").agg(F.array_sort(F.collect_set(F.concat(F.lit("$: unknown reference "), F.col("on")))).alias("more"))
    levels = cut(_levels(first.select("c", "i"), checked.filter("there").select("c", "i", "on")))

    on = [F.col("conv_id") == F.col("c"), F.col("call_id") == F.col("i")]
    facts = first.join(levels, ["c", "i"], "left").join(answers, ["c", "i"], "left").join(unknown, ["c", "i"], "left")
    linked = asked.join(facts, on, "left")
    status = (F.when(~key, "unidentified").when(F.struct("turn", "message") != F.col("first"), "duplicate").when(F.col("answered"), "linked").otherwise("unanswered"))
    a = linked.select("conv_id", "call_id", F.lit("call").alias("kind"), "turn", "level", status.alias("status"),
                      F.concat("errors", F.coalesce("more", F.array().cast("array<string>"))).alias("errors"), "message")
    back = given.join(first.select("c", "i", F.lit(True).alias("there")).join(levels, ["c", "i"], "left"), on, "left")
    b = back.select("conv_id", "call_id", F.lit("result").alias("kind"), "turn", "level", F.when(~key, "unidentified").when(F.col("there"), "linked").otherwise("orphan").alias("status"),
                    F.array().cast("array<string>").alias("errors"), "message")
    return a.union(b)


#: How turns count as calls in plain conversations.
TURN_SCHEMAS = {
    "configure": {"type": "object", "required": ["instructions"], "additionalProperties": False, "properties": {"instructions": {"type": "string", "minLength": 1}}},
    "respond": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
                "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "setup": {"type": "object"}, "turn": {"type": "integer", "minimum": 0}}},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain ``turns(conv_id, turn, role, text)`` stand for.

    A system turn calls ``configure``, a user turn ``respond`` and refers to
    the first system turn of its conversation, if there is one before it. Any
    other turn is the result of the turn right before it. Identifiers are
    conversation and turn.
    """
    t = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ident = lambda turn: F.concat(F.col("conv_id"), F.lit("-"), turn.cast("string"))
    first = t.filter("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("system"))
    user = t.filter("role = 'user'").join(first, "conv_id", "left").withColumn("setup", F.when(F.col("system") < F.col("turn"), ident(F.col("system"))))
    options = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), options)
    with_setup = F.to_json(F.struct(F.col("text").alias("prompt"), F.struct(F.col("setup").alias("$ref")).alias("setup"), "turn"), options)
    calls = (t.filter("role = 'system'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit("configure").alias("name"), F.to_json(F.struct(F.col("text").alias("instructions")), options).alias("arguments"))
             .union(user.select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.lit("respond").alias("name"), F.when(F.col("setup").isNull(), plain).otherwise(with_setup).alias("arguments"))))
    results = t.filter("role is null or role not in ('system', 'user')").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
