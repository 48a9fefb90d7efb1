"""Tool-call linking: calls and results of conversations joined by identifier, ordered, validated, in canonical JSON.

Messages of role assistant may hold {"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}, those of role tool
{"tool_call_id", "content"}. Calls and results meet by a hash join on (conversation, identifier). Calls of a conversation are
ordered topologically by ``after``: by the length of the longest chain before them, then turn and identifier. Conversations
of up to ``LIMIT`` calls get these lengths in one pass each. In longer ones chains are shortened by doubling, with joins, so
the rounds grow with the logarithm of a chain and with the number of joints that wait for other joints. Positions come from a
sort by ranges, so no task holds an unbounded conversation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width

LIMIT = 10_000

CALL = pa.struct([("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("after", pa.list_(pa.string()))])
RESULT = pa.struct([("call_id", pa.string()), ("content", pa.string())])


def _plain(x):
    """Whole floats as integers, so that equal numbers are written alike."""
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return int(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


LONE = re.compile("[\ud800-\udfff]")


def clean(text: str) -> str:
    """Half characters, which no text can hold, as their escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(x) -> str:
    """JSON with sorted keys, no blanks, characters as they are (half characters as escapes)."""
    return clean(json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("no number of JSON that can be written again")
    return x


def parsed(text: str | None):
    """The value, or None for anything that is not JSON, holds what JSON lacks (NaN), or a number beyond all doubles."""
    try:
        return _plain(json.loads(text or "", parse_constant=lambda c: 1 / 0, parse_float=_finite))
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords that say nothing about a value.
NOTES = {"title", "description", "default", "examples", "format", "$schema", "$id", "$comment"}


def _is(x, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and (kind == "number" or x.is_integer()))
    return isinstance(x, KINDS[kind])


def _number(test):
    return lambda x, limit: not _is(x, "number") or test(x, limit)


def _size(kind, test):
    return lambda x, limit: not isinstance(x, kind) or test(len(x), limit)


#: What each keyword asks of a value.
ASKS = {
    "type": lambda x, kinds: any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)),
    "enum": lambda x, values: canonical(x) in map(canonical, values),
    "const": lambda x, value: canonical(x) == canonical(value),
    "minimum": _number(lambda x, limit: x >= limit),
    "maximum": _number(lambda x, limit: x <= limit),
    "exclusiveMinimum": _number(lambda x, limit: x > limit),
    "exclusiveMaximum": _number(lambda x, limit: x < limit),
    "minLength": _size(str, lambda n, limit: n >= limit),
    "maxLength": _size(str, lambda n, limit: n <= limit),
    "pattern": lambda x, rx: not isinstance(x, str) or re.search(rx, x) is not None,
    "minItems": _size(list, lambda n, limit: n >= limit),
    "maxItems": _size(list, lambda n, limit: n <= limit),
    "items": lambda x, s: not isinstance(x, list) or all(conforms(v, s) for v in x),
    "properties": lambda x, of: not isinstance(x, dict) or all(conforms(v, of[k]) for k, v in x.items() if k in of),
    "required": lambda x, names: not isinstance(x, dict) or all(k in x for k in names),
    "anyOf": lambda x, schemas: any(conforms(x, s) for s in schemas),
    "allOf": lambda x, schemas: all(conforms(x, s) for s in schemas),
    "oneOf": lambda x, schemas: sum(conforms(x, s) for s in schemas) == 1,
    "not": lambda x, s: not conforms(x, s),
}


def conforms(x, schema) -> bool:
    """Whether a value is as a JSON schema of the keywords in ASKS and additionalProperties says."""
    if isinstance(schema, bool):
        return schema
    if not all(ASKS[k](x, v) for k, v in schema.items() if k in ASKS):
        return False
    more = schema.get("additionalProperties", True)
    return not isinstance(x, dict) or all(conforms(v, more) for k, v in x.items() if k not in schema.get("properties", {}))


def refuse_unknown(schema) -> None:
    """Raises on a schema with a keyword or type that ``conforms`` would pass over."""
    if isinstance(schema, bool):
        return
    if odd := set(schema) - set(ASKS) - NOTES - {"additionalProperties"}:
        raise ValueError(f"schema keywords without support: {sorted(odd)}")
    kinds = schema.get("type", [])
    if odd := {kinds} - {*KINDS, "integer", "number"} if isinstance(kinds, str) else set(kinds) - {*KINDS, "integer", "number"}:
        raise ValueError(f"unknown types: {sorted(odd)}")
    below = [*schema.get("properties", {}).values(), *(s for k in ("anyOf", "allOf", "oneOf") for s in schema.get(k, ())), *(schema[k] for k in ("items", "not", "additionalProperties") if k in schema)]
    for s in below:
        refuse_unknown(s)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        calls, results = [], []
        for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
            x = parsed(text) if role in ("assistant", "tool") else None
            x = x if isinstance(x, dict) else {}
            mine = x.get("tool_calls") if role == "assistant" else None
            calls.append([{"call_id": clean(c["id"]), "name": clean(str(c.get("name") or "")), "arguments": clean(c["arguments"]) if isinstance(c.get("arguments"), str) else canonical(c.get("arguments")), "after": [clean(a) for a in c["after"] if isinstance(a, str)] if isinstance(c.get("after"), list) else []} for c in mine if isinstance(c, dict) and isinstance(c.get("id"), str)] if isinstance(mine, list) else [])
            content = x.get("content")
            results.append({"call_id": clean(x["tool_call_id"]), "content": clean(content) if isinstance(content, str) else None if content is None else canonical(content)} if role == "tool" and isinstance(x.get("tool_call_id"), str) else None)
        yield pa.record_batch({"conv_id": b.column("conv_id"), "turn": b.column("turn"), "calls": pa.array(calls, pa.list_(CALL)), "result": pa.array(results, RESULT)})


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text). What is not in the form above is no call and no result."""
    kinds = "conv_id long, turn long, calls array<struct<call_id string, name string, arguments string, after array<string>>>, result struct<call_id string, content string>"
    both = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(_extract, kinds)
    return both.select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", "c.*"), both.where("result is not null").select("conv_id", "turn", "result.*")


def levels(after: dict[str, list[str]]) -> dict[str, int]:
    """Longest chain before each call; calls on a cycle or behind one have none. Identifiers without a call do not count."""
    waits = {c: {a for a in before if a in after} for c, before in after.items()}
    behind: dict[str, list[str]] = {}
    for c, before in waits.items():
        for a in before:
            behind.setdefault(a, []).append(c)
    out, now, level = {}, [c for c, before in waits.items() if not before], 0
    while now:
        out |= dict.fromkeys(now, level)
        free = []
        for a in now:
            for c in behind.get(a, ()):
                waits[c].discard(a)
                if not waits[c]:
                    free.append(c)
        now, level = free, level + 1
    return out


def _level_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows):
        depth = levels({r["call_id"]: r["after"] or [] for r in rows})
        return pa.record_batch({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "call_id": pa.array([r["call_id"] for r in rows]), "level": pa.array([depth.get(r["call_id"]) for r in rows], pa.int32())})

    rows, now = [], None
    for b in batches:
        for r in b.to_pylist():
            if rows and r["conv_id"] != now:
                yield done(rows)
                rows = []
            rows.append(r)
            now = r["conv_id"]
    if rows:
        yield done(rows)


LEVELS = "conv_id long, call_id string, level int"


def _level_large(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """Levels by joins. A node's level is the greatest of a constant c and of level(on) + w over its edges.

    A node with one edge points through others of its kind to where they end, by doubling; such functions join to one of the
    same form. Edges to nodes with a known level become constants. What waits for other joints goes on to the next turn; what
    a turn leaves as it was lies on a cycle or behind one.
    """
    tag = F.coalesce(F.col("conv_id").cast("string"), F.lit("n"))
    nodes = scratch.write(calls.select("conv_id", "call_id", F.concat(tag, F.lit(":"), "call_id").alias("node"), F.coalesce("turn", F.lit(-1)).alias("turn"), "after", tag.alias("tag")), "nodes")
    turns = nodes.select("node", "turn")
    edges = nodes.select("node", "turn", F.explode("after").alias("a"), "tag").select("node", "turn", F.concat("tag", F.lit(":"), "a").alias("on")).distinct()
    edges = scratch.write(edges.join(turns.select(F.col("node").alias("on"), F.col("turn").alias("on_turn")), "on").withColumn("back", F.col("on_turn") < F.col("turn")), "edges")
    # of edges that go back in turns, those that the latest one's node has too are shorter ways; the others hold all cycles
    latest = edges.where("back").groupBy("node").agg(F.max(F.struct("on_turn", "on")).alias("m")).select("node", F.col("m.on").alias("via"))
    known_by = edges.where("back").select(F.col("node").alias("via"), "on")
    shorter = edges.where("back").join(latest, "node").join(known_by, ["via", "on"], "left_semi").select("node", "on")
    edges = scratch.write(edges.join(shorter, ["node", "on"], "left_anti").select("node", "on", F.lit(1).alias("w")), "edges_0")
    open_, known, turn, before = nodes.select("node", F.lit(0).alias("c")), None, 0, None
    while True:
        turn += 1
        free = scratch.write(open_.join(edges, "node", "left_anti").select("node", F.col("c").alias("level")), f"free_{turn}")
        known = free if known is None else known.unionByName(free)
        left = edges.count()
        if not left or (left == before and not free.limit(1).count()):
            break
        before = left
        # edges to known nodes become constants
        done = edges.join(free.withColumnRenamed("node", "on"), "on")
        raised = done.groupBy("node").agg(F.max(F.col("level") + F.col("w")).alias("up"))
        open_ = scratch.write(open_.join(free, "node", "left_anti").join(raised, "node", "left").select("node", F.greatest("c", F.coalesce("up", F.lit(0))).alias("c")), f"open_{turn}_0")
        edges = scratch.write(edges.join(free.select(F.col("node").alias("on")), "on", "left_anti"), f"edges_{turn}_0")
        single = edges.groupBy("node").agg(F.count("*").alias("n"), F.first("on").alias("on"), F.first("w").alias("w")).where("n = 1").join(open_, "node").select("node", "on", "w", "c")
        points, step = scratch.write(single, f"points_{turn}_0"), 0
        most = points.count()
        while most and points.alias("p").join(points.select(F.col("node").alias("on")), "on", "left_semi").limit(1).count() and 1 << step <= 2 * most:
            step += 1
            far = points.select(F.col("node").alias("on"), F.col("on").alias("on2"), F.col("w").alias("w2"), F.col("c").alias("c2"))
            two = points.join(far, "on", "left")
            points = scratch.write(two.select("node", F.coalesce("on2", "on").alias("on"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("c", F.coalesce(F.col("c2") + F.col("w"), F.lit(0))).alias("c")), f"points_{turn}_{step}")
            scratch.drop(f"points_{turn}_{step - 1}")
        joints = edges.join(points, "node", "left_anti")
        far = points.select(F.col("node").alias("on"), F.col("on").alias("on2"), F.col("w").alias("w2"), F.col("c").alias("c2"))
        moved = joints.join(far, "on", "left")
        raised = moved.groupBy("node").agg(F.max(F.col("c2") + F.col("w")).alias("up")).unionByName(points.select("node", F.col("c").alias("up")))
        open_ = scratch.write(open_.join(raised, "node", "left").select("node", F.greatest("c", F.coalesce("up", F.lit(0))).alias("c")), f"open_{turn}")
        moved = moved.select("node", F.coalesce("on2", "on").alias("on"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).unionByName(points.select("node", "on", "w"))
        edges = scratch.write(moved.groupBy("node", "on").agg(F.max("w").alias("w")), f"edges_{turn}")
    return nodes.join(known, "node", "left").select("conv_id", "call_id", "level")


def numbered(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Adds position: of each row in the order of its conversation. A sort by ranges spreads a conversation over tasks; rows
    are numbered in their range, and the ranges' counts are added up."""
    order = ["conv_id", F.col("level").isNull(), "level", "turn", "call_id"]
    placed = scratch.write(rows.repartitionByRange(width, *order).withColumn("range", F.spark_partition_id()), "placed")
    inner = Window.partitionBy("conv_id", "range").orderBy(*order[1:])
    counts = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    above = counts.select("conv_id", "range", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("before"))
    both = placed.withColumn("nth", F.row_number().over(inner)).alias("p").join(above.alias("a"), F.expr("p.conv_id <=> a.conv_id AND p.range = a.range"))
    return both.select(*(f"p.{c}" for c in rows.columns), F.when(F.col("p.level").isNotNull(), F.col("nth") + F.col("before") - 1).cast("int").alias("position"))


def _finish(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, text = [], []
            for r in b.to_pylist():
                x = parsed(r["arguments"])
                schema = schemas.get(r["name"])
                valid.append(isinstance(x, dict) and schema is not None and conforms(x, schema))
                text.append(canonical({"arguments": r["arguments"] if x is None else x, "id": r["call_id"], "name": r["name"], "result": r["content"]}))
            yield b.drop_columns(["arguments", "content", "name"]).append_column("valid", pa.array(valid, pa.bool_())).append_column("json", pa.array(text, pa.string()))

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], limit: int = LIMIT) -> DataFrame:
    """conv_id, call_id, position (from 0), linked, valid, json: a row for each call of a conversation.

    Of calls with one identifier the earliest counts (turn, then name and arguments), of results too; so repeated rows are
    one. A call without a result has linked = false and result null; a result without a call is left out. valid: arguments
    are an object that its name's schema admits (no schema: false). Calls on a cycle, or behind one, have a null position. A
    null conversation is one of its own; calls with a null identifier do not count. Empty tables give no rows. Other columns
    of either table are ignored. Schemas with keywords that are not supported are refused.
    """
    for schema in schemas.values():
        refuse_unknown(schema)
    scratch, width = Scratch(calls.sparkSession), shuffle_width(calls.sparkSession)
    by = ["conv_id", "call_id"]
    first = calls.where("call_id is not null").groupBy(*by).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select(*by, "c.*")
    first = scratch.write(first, "calls")
    of = first.groupBy("conv_id").agg(F.count("*").alias("_n"))
    size = first.alias("f").join(of.alias("o"), F.expr("f.conv_id <=> o.conv_id")).select("f.*", "_n")
    small = size.where(F.col("_n") <= limit).select(*by, "after").repartition(width, "conv_id").sortWithinPartitions("conv_id")
    depth = small.mapInArrow(_level_small, LEVELS)
    if of.where(F.col("_n") > limit).limit(1).count():
        depth = depth.unionByName(_level_large(size.where(F.col("_n") > limit), scratch))
    depth = scratch.write(depth, "levels")
    same = lambda a, b: F.expr(f"{a}.conv_id <=> {b}.conv_id AND {a}.call_id = {b}.call_id")
    placed = numbered(first.alias("f").join(depth.alias("d"), same("f", "d")).select("f.*", "level"), width, scratch)
    got = results.where("call_id is not null").groupBy(*by).agg(F.min(F.struct("turn", "content")).alias("r"))
    both = placed.alias("p").join(got.hint("shuffle_hash").alias("g"), same("p", "g"), "left")
    both = both.select("p.conv_id", "p.call_id", "position", F.col("r").isNotNull().alias("linked"), "name", "arguments", F.col("r.content").alias("content"))
    return both.mapInArrow(_finish(schemas), "conv_id long, call_id string, position int, linked boolean, valid boolean, json string")


#: What the query takes for tools. The conversations hold no calls, so every turn of an assistant is told as a call of
#: "answer" and the user's next turn as its result; in every third conversation a call waits for the next one.
SCHEMAS = {"answer": {"type": "object", "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": 5}, "query": {"type": "string", "minLength": 1}}, "required": ["limit", "query"], "additionalProperties": False}}


def told_as_calls(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls and tool results, made from all turns."""
    text = F.coalesce("text", F.lit(""))
    wait = F.concat(F.lit("c"), F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 2).otherwise(F.col("turn") - 2).cast("string"))
    call = F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("answer").alias("name"), F.struct((F.length(text) % 7).alias("limit"), text.alias("query")).alias("arguments"), F.array(wait).alias("after"))
    calls = conversations.where("role = 'assistant'").select("conv_id", "turn", "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), text.alias("content"))
    return calls.unionByName(conversations.where("role = 'user'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(result).alias("text")))


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(text, '') t FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, coalesce(text, '') t FROM conversations WHERE role = 'user'),
d AS (SELECT *, sum(CASE WHEN p IS NULL OR turn <> p + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) run FROM
  (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) p FROM c)),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END) lvl FROM d)
SELECT l.conv_id, 'c' || l.turn AS call_id, (row_number() OVER (PARTITION BY l.conv_id ORDER BY lvl, l.turn, 'c' || l.turn) - 1)::INTEGER AS position,
  u.t IS NOT NULL AS linked, length(l.t) % 7 BETWEEN 1 AND 5 AND length(l.t) > 0 AS valid,
  '{"arguments":{"limit":' || length(l.t) % 7 || ',"query":' || to_json(l.t)::VARCHAR || '},"id":"c' || l.turn || '","name":"answer","result":' || coalesce(to_json(u.t)::VARCHAR, 'null') || '}' AS json
FROM l LEFT JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 1
"""
