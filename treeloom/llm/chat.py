"""Chat formatting with linked tool calls.

A message's text may be a JSON object: of an assistant with `tool_calls` (each with id, name or function.name,
arguments as an object or as JSON text, and optionally `after`, the ids of calls it builds on), of a tool with
`tool_call_id`. Calls and results are hash-joined by conversation and identifier, arguments are validated against
JSON-schema-like schemas, and each message is put in topological order: a call after the calls it builds on, a result
after its call. The order is (anchor, depth, turn): anchor is the latest turn that must come before, depth the number
of steps after it. Messages come out as canonical JSON: sorted keys, no blanks, UTF-8.

Turns of calls and what they build on make a graph for each conversation. Conversations of at most EDGES edges are
ordered whole, each as one row; larger ones by rounds over tables, as long as anything changes.

Defined results: texts that are no such object are plain content, and so are objects with NaN, infinite numbers or
more nesting than the parser takes; lone surrogates are written as \\udXXX; null or empty texts are empty content; a
result without its call is an orphan; of repeated results for a call the first turn is linked; repeated messages are
kept, and each has the counts of its own calls; null conversations are one conversation, null turns come first and
keep a null anchor; calls that lie on a cycle keep the order of their turns and are counted as cyclic, those that only
build on one are not; a call with unknown tool or arguments that do not fit is invalid; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import arrow, drop_kept, keep, read

#: Schemas of the known tools: parameters by JSON schema's type, properties, required, enum, items.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "method": {"type": "string", "enum": ["GET", "HEAD"]}}, "required": ["url"]},
}
#: Edges up to which a conversation is ordered as one row.
EDGES = 50_000
#: The turn that a null one counts as.
FIRST = -(1 << 62)
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_CALLS = "array<struct<id: string, name: string, after: array<string>, valid: boolean, error: string>>"
_SURROGATE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    return x


def loads(text: str):
    """JSON only: no NaN, no infinite numbers."""
    return json.loads(text, parse_float=_finite, parse_constant=_finite)


def fault(value, schema: dict, at: str = "$") -> str | None:
    """What first keeps a value from fitting a schema, None if it fits."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        if isinstance(value, bool) or not isinstance(value, int | float) or kind == "integer" and not whole:
            return f"{at}: not of type {kind}"
    elif kind in _TYPES and not isinstance(value, _TYPES[kind]):
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not among the allowed values"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := fault(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _object(text) -> dict | None:
    if not isinstance(text, str) or not text.lstrip().startswith("{"):
        return None
    try:
        found = loads(text)
        canonical(found)  # nested deeper than it could be written
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def parse(role: str | None, text: str | None, schemas: dict) -> tuple[str, list[dict], str | None]:
    """The message as canonical JSON, its calls, and the id of the call that it answers."""
    found = _object(text)
    message: dict = {"role": role or "", "content": text or ""}
    calls: list[dict] = []
    answers = None
    if found and isinstance(found.get("tool_calls"), list):
        message = {"role": role or "", "content": found.get("content") or "", "tool_calls": []}
        for raw in found["tool_calls"]:
            if not isinstance(raw, dict):
                continue
            inner = raw["function"] if isinstance(raw.get("function"), dict) else raw
            name, given = plain(str(inner.get("name") or "")), inner.get("arguments")
            arguments, error = given, None
            if isinstance(given, str):
                try:
                    arguments = loads(given)
                    canonical(arguments)
                except (ValueError, RecursionError):
                    arguments, error = given, "$: no JSON"
            arguments = {} if arguments is None else arguments
            if not error:
                error = fault(arguments, schemas[name]) if name in schemas else f"unknown tool {name}"
            after = raw.get("after") if isinstance(raw.get("after"), list) else []
            calls.append({"id": None if raw.get("id") is None else plain(str(raw["id"])), "name": name, "after": [plain(str(x)) for x in after], "valid": error is None, "error": error and plain(error)})
            message["tool_calls"].append({"id": raw.get("id"), "type": "function", "function": {"name": name, "arguments": arguments}})
    elif found and found.get("tool_call_id") is not None:
        answers = plain(str(found["tool_call_id"]))
        message = {"role": role or "", "tool_call_id": answers, "content": found.get("content") or ""}
    return canonical(message), calls, answers


def _parsed(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    calls_type = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("after", pa.list_(pa.string())), ("valid", pa.bool_()), ("error", pa.string())]))
    for batch in batches:
        rows = [parse(r, t, schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        made = [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], calls_type), pa.array([x[2] for x in rows], pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *made], ["conv_id", "turn", "role", "json", "calls", "answers"])


# ---- order


def on_cycles(edges: list[tuple[int, int]]) -> set[int]:
    """Nodes that lie on a cycle: the strongly connected sets of more than one node, by Tarjan's method without recursion."""
    nexts: dict[int, list[int]] = {}
    for a, b in edges:
        nexts.setdefault(a, []).append(b)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    inside: set[int] = set()
    out: set[int] = set()
    for start in nexts:
        if start in number:
            continue
        work = [(start, iter(nexts[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        inside.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    inside.add(to)
                    work.append((to, iter(nexts.get(to, ()))))
                    break
                if to in inside:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while True:
                        own.append(stack.pop())
                        inside.discard(own[-1])
                        if own[-1] == node:
                            break
                    if len(own) > 1:
                        out.update(own)
    return out


def placed(edges: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """(turn, anchor, depth, cyclic) of each turn that builds on another one; edges go from what is built on."""
    cyclic = on_cycles(edges)
    needs: dict[int, list[int]] = {}
    users: dict[int, list[int]] = {}
    for a, b in edges:
        if b not in cyclic:
            needs.setdefault(b, []).append(a)
            users.setdefault(a, []).append(b)
    place: dict[int, tuple[int, int]] = {}
    open_ = {b: len(a) for b, a in needs.items()}
    todo = [a for a in {a for a, _ in edges} | cyclic if a not in open_]
    while todo:
        node = todo.pop()
        place[node] = max([(node, 0), *((place[a][0], place[a][1] + 1) for a in needs.get(node, ()))])
        for b in users.get(node, ()):
            open_[b] -= 1
            if not open_[b]:
                todo.append(b)
    return [(t, *place[t], t in cyclic) for t in sorted({b for _, b in edges})]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, rows = [], []
        for c, pairs in zip(batch.column("conv").to_pylist(), batch.column("pairs").to_pylist()):
            own = placed([(p["from"], p["to"]) for p in pairs])
            conv += [c] * len(own)
            rows += own
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["conv", "t", "anchor", "depth", "cyclic"])


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that cannot lie on a cycle: from nodes that nothing leads to, or to nodes that lead nowhere."""
    n = edges.count()
    while n:
        into, out = edges.select("conv", F.col("to").alias("from")).distinct(), edges.select("conv", F.col("from").alias("to")).distinct()
        after = keep(edges.join(into, ["conv", "from"], "left_semi").join(out, ["conv", "to"], "left_semi").select("conv", "from", "to"), "trimmed")
        m = after.count()
        edges = after
        if m == n:
            break
        n = m
    return edges


def _spread(values: DataFrame, edges: DataFrame, grow) -> DataFrame:
    """(conv, t, v) after values have gone along the edges until nothing changes; grow(v) is what arrives, the largest stays."""
    while True:
        sent = values.join(edges.withColumnRenamed("from", "t"), ["conv", "t"]).select("conv", F.col("to").alias("t"), grow(F.col("v")).alias("v"))
        after = keep(values.union(sent).groupBy("conv", "t").agg(F.max("v").alias("v")), "spread")
        same = after.join(values, ["conv", "t", "v"], "left_anti").isEmpty()
        values = after
        if same:
            return values


def _cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(conv, t) on cycles, over tables: of the trimmed graph, colours are the largest node that reaches one, and what
    leads back to a colour's own node within it is one strongly connected set; then the same without these sets.
    """
    edges, found = _trimmed(edges), None
    while not edges.isEmpty():
        nodes = edges.select("conv", F.explode(F.array("from", "to")).alias("t")).distinct()
        colours = _spread(nodes.select("conv", "t", F.col("t").alias("v")), edges, lambda v: v)
        at = lambda end, name: colours.select("conv", F.col("t").alias(end), F.col("v").alias(name))
        inner = keep(edges.join(at("from", "a"), ["conv", "from"]).join(at("to", "b"), ["conv", "to"]).where("a = b").select("conv", "from", "to"), "inner")
        back = inner.select("conv", F.col("to").alias("from"), F.col("from").alias("to"))
        own = _spread(colours.where("t = v"), back, lambda v: v)
        sizes = own.groupBy("conv", "v").count().where("count > 1").select("conv", "v")
        cyclic = keep(own.join(sizes, ["conv", "v"], "left_semi").select("conv", "t"), "cyclic")
        found = cyclic if found is None else found.union(cyclic)
        done = own.select("conv", "t")
        left = edges.join(done.withColumnRenamed("t", "from"), ["conv", "from"], "left_anti").join(done.withColumnRenamed("t", "to"), ["conv", "to"], "left_anti")
        edges = _trimmed(keep(left.select("conv", "from", "to"), "edges"))
    return edges.select("conv", F.col("from").alias("t")) if found is None else found


def places(needs: DataFrame, most: int = EDGES) -> DataFrame:
    """(conv, t, anchor, depth, cyclic) for each turn that builds on another one, from edges (conv, from, to)."""
    sizes = needs.groupBy("conv").count()
    large = keep(sizes.where(F.col("count") > most).select("conv"), "large")  # a share of 1 / most of the edges at most
    rest = needs if large.isEmpty() else needs.join(large, "conv", "left_anti")
    pairs = rest.groupBy("conv").agg(F.collect_list(F.struct("from", "to")).alias("pairs"))
    out = arrow(pairs, _ordered, "conv string, t long, anchor long, depth long, cyclic boolean")
    if large.isEmpty():
        return out
    edges = keep(needs.join(large, "conv", "left_semi").select("conv", "from", "to"), "large-edges")
    cyclic = keep(_cyclic_nodes(edges), "cyclic")
    open_ = edges.join(cyclic.withColumnRenamed("t", "to"), ["conv", "to"], "left_anti")
    nodes = edges.select("conv", F.explode(F.array("from", "to")).alias("t")).distinct()
    start = nodes.select("conv", "t", F.struct(F.col("t").alias("anchor"), F.lit(0).cast("long").alias("depth")).alias("v"))
    at = _spread(start, open_.select("conv", "from", "to"), lambda v: F.struct(v["anchor"].alias("anchor"), (v["depth"] + 1).alias("depth")))
    marked = at.join(cyclic.withColumn("cyclic", F.lit(True)), ["conv", "t"], "left").select("conv", "t", "v.anchor", "v.depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    return out.union(marked.join(edges.select("conv", F.col("to").alias("t")).distinct(), ["conv", "t"], "left_semi"))


def link(messages: DataFrame, schemas: dict | None = None, most: int = EDGES) -> DataFrame:
    """One row for each message: conv_id, turn, role, anchor, depth, json, n_calls, n_linked, n_valid, n_cyclic, orphan."""
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    schemas = SCHEMAS if schemas is None else schemas
    rows = arrow(messages.select("conv_id", "turn", "role", "text"), lambda b: _parsed(b, schemas), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, json string, calls {_CALLS}, answers string")
    conv = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = keep(rows.withColumn("conv", conv).withColumn("t", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST))).withColumn("m", F.monotonically_increasing_id()), "messages")
    tools = rows.where(F.size("calls") > 0)
    results = rows.where(F.col("answers").isNotNull())
    calls = keep(tools.select("conv", "t", "m", F.explode("calls").alias("x")).select("conv", "t", "m", "x.id", "x.after").where("id IS NOT NULL OR size(after) > 0"), "calls")
    owners = keep(calls.where("id IS NOT NULL").groupBy("conv", "id").agg(F.min("t").alias("from")), "owners")
    answered = results.groupBy("conv", F.col("answers").alias("id")).agg(F.min("t").alias("answered"))
    needs = calls.select("conv", F.col("t").alias("to"), F.explode("after").alias("id")).join(owners, ["conv", "id"]).select("conv", "from", "to").where("`from` <> `to`").distinct()
    at = keep(places(keep(needs, "needs"), most), "places")
    linked = calls.join(answered, ["conv", "id"]).groupBy("m").agg(F.count("*").alias("n_linked"))
    home = owners.join(at.withColumnRenamed("t", "from"), ["conv", "from"], "left").select("conv", F.col("id").alias("answers"), F.coalesce("anchor", "from").alias("call_anchor"), F.coalesce("depth", F.lit(0)).cast("long").alias("call_depth"))
    out = rows.join(linked, "m", "left").join(at, ["conv", "t"], "left").join(home, ["conv", "answers"], "left")
    is_call, is_result = F.size("calls") > 0, F.col("answers").isNotNull()
    late = F.col("t") > F.col("call_anchor")
    zero = F.lit(0).cast("long")
    n_calls = F.size("calls").cast("long")
    anchor = F.when(is_call, F.coalesce("anchor", "t")).when(is_result & ~late, F.col("call_anchor")).otherwise(F.col("t"))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.when(anchor != FIRST, anchor).cast(kinds["turn"]).alias("anchor"),
        F.when(is_call, F.coalesce("depth", zero)).when(is_result & ~late, F.col("call_depth") + 1).otherwise(zero).alias("depth"),
        "json",
        n_calls.alias("n_calls"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.size(F.filter("calls", lambda x: x["valid"])).cast("long").alias("n_valid"),
        F.when(is_call & F.col("cyclic"), n_calls).otherwise(zero).alias("n_cyclic"),
        (is_result & F.col("call_anchor").isNull()).alias("orphan"),
    )


def op4_chat(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat": op4_chat}
ORACLE: dict[str, str] = {}
