"""Chat formatting with linked tool calls.

Messages come as (conv_id, turn, role, text). A call is a JSON object in an assistant's text, alone or
between ``<tool_call>`` and ``</tool_call>``: {"id", "name", "arguments"[, "after": [ids]]}; a list under
"tool_calls" holds several. A result is the text of a tool's message: {"tool_call_id", "content"}.

Calls and results are joined by (conversation, identifier), a hash join. Calls are ordered topologically:
level 0 waits for nothing, and a call is one level above the last call that its "after" names; calls on a
circle, or after an unknown one, get no level. Arguments are checked against JSON schemas (type,
required, properties, enum, items, additionalProperties): those that a system message of the conversation
declares, {"tools": [{"name", "parameters"}]} (each maybe inside {"function": ...}; the first declaration
of a name holds), else those given to format_chat. Everything is written as canonical JSON: sorted keys,
no white space, no escapes that aren't needed.

Cases: null text counts as empty, a null role as "user"; JSON that can't be read is plain text; text
beside calls, and bodies not read in full or with repeated identifiers, stay verbatim as content; a
repeated identifier counts once, its first call by turn; results without a call, and calls without a
result, are marked. Calls belong to their row, so rows that share conversation and turn keep their own.
Null is a conversation like any other; null turns come first. A schema that is no object checks nothing,
nor does a type or a required name that isn't a string; a list of types holds if one does. Truth values are
no numbers, 1.0 is an integer. Lone halves of surrogate pairs are no identifiers or names, stay escapes in
arguments, and are U+FFFD in content; arguments that JSON can't write (infinite numbers, or nested too deep)
are null and not valid. Other columns play no part.

Scale: one row a message. Conversations with up to ``TOGETHER`` calls that wait for others are ordered
each in one group of that bounded size; in longer ones, of any length, levels cost one join each.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import Workspace, arrow_rows, ship_package, table

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


TOGETHER = 10_000  # waits of a conversation that are ordered in one group


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON; halves of surrogate pairs, which UTF-8 can't hold, stay escapes."""
    written = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub(lambda half: f"\\u{ord(half.group()):04x}", written)


def _text(value: str) -> str:
    """A string as UTF-8 can hold it: lone halves of surrogate pairs become U+FFFD."""
    return _LONE.sub("\ufffd", value)


def _name(value) -> bool:
    """Whether a value can name something: a string that UTF-8 can hold."""
    return isinstance(value, str) and not _LONE.search(value)


def same(a, b) -> bool:
    """Whether two JSON values are equal: truth values are no numbers, 1 and 1.0 are one number."""
    open_ = [(a, b)]
    while open_:
        a, b = open_.pop()
        if isinstance(a, bool) or isinstance(b, bool):
            if a is not b:
                return False
        elif isinstance(a, dict) and isinstance(b, dict):
            if a.keys() != b.keys():
                return False
            open_ += [(a[k], b[k]) for k in a]
        elif isinstance(a, list) and isinstance(b, list):
            if len(a) != len(b):
                return False
            open_ += zip(a, b)
        elif a != b:
            return False
    return True


def _is(value, kind) -> bool:
    """Whether a value is of a JSON type; anything but the name of a type holds for all values."""
    if isinstance(kind, list):
        return any(_is(value, k) for k in kind if isinstance(k, str)) or not any(isinstance(k, str) for k in kind)
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return not isinstance(kind, str) or kind not in _KINDS or isinstance(value, _KINDS[kind])


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a JSON schema (the keywords named above), in the order of the value."""
    out, open_ = [], [((value,), schema, path)]
    while open_:
        value, schema, path = open_.pop()
        if isinstance(value, str):  # an error, ready to be told
            out.append(path)
            continue
        value, inner = value[0], []
        if not isinstance(schema, dict):
            continue
        kind = schema.get("type")
        if not _is(value, kind):
            out.append(f"{path}: not {' or '.join(k for k in kind if isinstance(k, str)) if isinstance(kind, list) else kind}")
            continue
        if isinstance(schema.get("enum"), list) and not any(same(value, e) for e in schema["enum"]):
            out.append(f"{path}: not in enum")
        if isinstance(value, dict):
            known = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
            required = schema["required"] if isinstance(schema.get("required"), list) else []
            out += [f"{path}.{k}: missing" for k in required if isinstance(k, str) and k not in value]
            for k, v in value.items():
                if k in known:
                    inner.append(((v,), known[k], f"{path}.{k}"))
                elif schema.get("additionalProperties") is False:
                    inner.append(("", None, f"{path}.{k}: unknown"))
        if isinstance(value, list) and "items" in schema:
            inner += [((v,), schema["items"], f"{path}[{i}]") for i, v in enumerate(value)]
        open_ += reversed(inner)
    return [_text(e) for e in out]


def declared_tools(text: str) -> list[dict]:
    """Names and schemas (as JSON) that a system message declares."""
    if not text.lstrip().startswith("{"):
        return []
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    listed = value.get("tools")
    out = []
    for tool in listed if isinstance(listed, list) else []:
        tool = tool.get("function", tool) if isinstance(tool, dict) else {}
        if isinstance(tool, dict) and _name(tool.get("name")):
            try:
                out.append({"name": tool["name"], "schema": json.dumps(tool.get("parameters"))})
            except RecursionError:
                out.append({"name": tool["name"], "schema": "null"})
    return out


def _objects(text: str) -> tuple[list[dict], list[dict]]:
    """Call objects of an assistant's text, and its pieces: verbatim text, and the calls that say all of it (none: it stays content)."""
    parts = [(text, text if text.lstrip().startswith("{") else None)]
    if "<tool_call>" in text:
        head, *rest = text.split("<tool_call>")
        parts = [(head, None)]
        for piece in rest:
            body, end, after = piece.partition("</tool_call>")
            parts += [("<tool_call>" + body + end, body), (after, None)]
    out, pieces, seen = [], [], set()
    for verbatim, body in parts:
        try:
            value = json.loads(body) if body is not None else None
        except (ValueError, RecursionError):
            value = None
        listed = value.get("tool_calls", [value]) if isinstance(value, dict) else []
        listed = listed if isinstance(listed, list) else []
        good = [c for c in listed if isinstance(c, dict) and _name(c.get("id")) and _name(c.get("name"))]
        ids = {c["id"] for c in good}
        pieces.append({"text": verbatim, "ids": sorted(ids) if len(ids) == len(listed) and not ids & seen else []})
        if isinstance(value, dict) and "tool_calls" in value and isinstance(value.get("content"), str) and pieces[-1]["ids"]:
            pieces.append({"text": _text(value["content"]), "ids": []})
        seen |= ids
        out += good
    return out, pieces


_PARSED = "row long, conv_id long, turn long, role string, content string, calls array<struct<id:string,name:string,arguments:string,finite:boolean,after:array<string>>>, result_of string, pieces array<struct<text:string,ids:array<string>>>, tools array<struct<name:string,schema:string>>"


def parse_messages(messages: DataFrame) -> DataFrame:
    """One row a message: row (its number), conv_id, turn, role, content, calls, result_of, pieces of its text, tools it declares."""
    ship_package(messages.sparkSession)
    arrow_rows(messages.sparkSession)
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("finite", pa.bool_()), ("after", pa.list_(pa.string()))])
    piece = pa.struct([("text", pa.string()), ("ids", pa.list_(pa.string()))])
    tool = pa.struct([("name", pa.string()), ("schema", pa.string())])

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            roles, contents, calls, results, split, tools = [], [], [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                role, text = role or "user", text or ""
                found, result_of, pieces = [], None, []
                tools.append(declared_tools(text) if role == "system" else [])
                if role == "assistant":
                    objects, pieces = _objects(text)
                    found = [_call(c) for c in objects]
                elif role == "tool":
                    try:
                        value = json.loads(text)
                    except (ValueError, RecursionError):
                        value = None
                    if isinstance(value, dict) and _name(value.get("tool_call_id")):
                        result_of, content = value["tool_call_id"], value.get("content", "")
                        text = _text(content) if isinstance(content, str) else _result(content)
                roles.append(role)
                contents.append(text)
                calls.append(found)
                results.append(result_of)
                split.append(pieces if found else [])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(contents, pa.string()), pa.array(calls, pa.list_(call)), pa.array(results, pa.string()), pa.array(split, pa.list_(piece)), pa.array(tools, pa.list_(tool))],
                names=["row", "conv_id", "turn", "role", "content", "calls", "result_of", "pieces", "tools"],
            )
            row += n

    picked = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").alias("text"))
    return picked.mapInArrow(run, _PARSED)


def _result(content) -> str:
    """A result that is no string, as JSON; numbers that JSON lacks are written as Python writes them."""
    try:
        return canonical(content)
    except RecursionError:
        return ""
    except ValueError:
        return _text(json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _call(c: dict) -> dict:
    arguments = c.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except (ValueError, RecursionError):
            pass
    try:
        written, finite = canonical(arguments), True
    except (ValueError, RecursionError):
        written, finite = "null", False
    after = c.get("after") if isinstance(c.get("after"), list) else []
    return {"id": c["id"], "name": c["name"], "arguments": written, "finite": finite, "after": [_text(a) for a in after if isinstance(a, str)]}


def _conv() -> Column:
    """The conversation as text, null as empty: a key that joins null with null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")


def validate(calls: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """calls (with a column schema: JSON or null) with errors: what the arguments break; schemas hold for names without one."""
    known = schemas or {}
    every = list(calls.columns)
    columns = [c for c in every if c not in ("schema", "finite")]

    def run(batches):
        for batch in batches:
            named = {c: batch.column(i) for i, c in enumerate(every)}
            errors = []
            for name, arguments, schema, finite in zip(*(named[c].to_pylist() for c in ("name", "arguments", "schema", "finite"))):
                schema = json.loads(schema) if schema is not None else known.get(name, {})
                errors.append(schema_errors(json.loads(arguments), schema) if finite else ["$: can't be written as JSON"])
            yield pa.RecordBatch.from_arrays([*(named[c] for c in columns), pa.array(errors, pa.list_(pa.string()))], names=[*columns, "errors"])

    kinds = dict(calls.dtypes)
    return calls.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", errors array<string>")


def call_levels(calls: DataFrame, work: Workspace, together: int = TOGETHER) -> DataFrame:
    """(conv, call_id, level) of all calls that have a level; calls: (conv, call_id, after)."""
    edges = calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("on"))
    free = calls.where(F.size("after") == 0).select("conv", "call_id", F.lit(0).alias("level"))
    per_call = F.count(F.lit(1)).over(Window.partitionBy("conv", "call_id"))
    few = work.write(edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "waiting")

    def ordered(t: pa.Table) -> pa.Table:
        conv, waits = t.column("conv")[0].as_py(), {}
        for call, on, level in zip(t.column("call_id").to_pylist(), t.column("on").to_pylist(), t.column("level").to_pylist()):
            waits.setdefault(call, []).append((on, level))
        level, users, open_ = {}, {}, {}
        for call, on in waits.items():
            for other, done in on:
                if done is not None:
                    level[other] = done
                users.setdefault(other, []).append(call)
            open_[call] = len(on)
        ready, most = list(level), {}
        while ready:
            other = ready.pop()
            for call in users.get(other, ()):
                most[call] = max(most.get(call, 0), level[other] + 1)
                open_[call] -= 1
                if not open_[call]:
                    level[call] = most[call]
                    ready.append(call)
        out = [c for c in waits if c in level]
        return pa.table({"conv": pa.array([conv] * len(out), pa.string()), "call_id": pa.array(out, pa.string()), "level": pa.array([level[c] for c in out], pa.int32())})

    small = edges.join(few.where(F.col("n") <= together).select("conv"), "conv", "left_semi")
    known = small.join(free.withColumnRenamed("call_id", "on"), ["conv", "on"], "left").select("conv", "call_id", "on", "level")
    done = free.unionByName(known.groupBy("conv").applyInArrow(ordered, "conv string, call_id string, level int"))
    if few.where(F.col("n") > together).isEmpty():
        return done
    large = few.where(F.col("n") > together).select("conv")
    edges = work.write(edges.join(large, "conv", "left_semi").withColumn("waits", per_call), "edges-0")
    new = work.write(free.join(large, "conv", "left_semi"), "level-0")
    met, levels, turn = None, new, 0
    while not new.isEmpty():  # every round hands a level on to the calls whose last open wait it was
        turn += 1
        hit = edges.join(new.withColumnRenamed("call_id", "on"), ["conv", "on"]).groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("got"), F.max("level").alias("most"), F.first("waits").alias("waits"))
        met = hit if met is None else met.unionByName(hit).groupBy("conv", "call_id").agg(F.sum("got").alias("got"), F.max("most").alias("most"), F.first("waits").alias("waits"))
        met = work.write(met, f"met-{turn}")
        new = work.write(met.where("got = waits").select("conv", "call_id", (F.col("most") + 1).cast("int").alias("level")), f"level-{turn}")
        met = met.where("got < waits")
        levels = work.write(levels.unionByName(new), f"levels-{turn}")
        if turn > 1:
            work.drop(f"met-{turn - 1}", f"level-{turn - 1}", f"levels-{turn - 1}")
    return done.join(large, "conv", "left_anti").unionByName(levels)


def call_table(parsed: DataFrame, work: Workspace, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv, call_id, row, name, arguments, errors, level): every call, the first of each identifier. conv: the conversation as text, null as empty."""
    each = parsed.where(F.size("calls") > 0).select(_conv(), "row", "turn", F.posexplode("calls").alias("pos", "c"))
    first = Window.partitionBy("conv", "c.id").orderBy("turn", "pos", "c.name", "c.arguments", "row")
    calls = each.withColumn("r", F.row_number().over(first)).where("r = 1").select("conv", F.col("c.id").alias("call_id"), "row", "c.name", "c.arguments", "c.finite", "c.after")
    told = parsed.where(F.size("tools") > 0).select(_conv(), "turn", "row", F.posexplode("tools").alias("pos", "t"))
    earliest = Window.partitionBy("conv", "t.name").orderBy("turn", "pos", "t.schema")
    tools = told.withColumn("r", F.row_number().over(earliest)).where("r = 1").select("conv", "t.name", "t.schema")
    checked = work.write(validate(calls.join(tools, ["conv", "name"], "left").select("conv", "call_id", "row", "name", "arguments", "finite", "after", "schema"), schemas), "calls")
    return checked.drop("after").join(call_levels(checked, work), ["conv", "call_id"], "left")


def quoted(text: Column) -> Column:
    """A string as canonical JSON: escapes for quotes, backslashes and control characters only, hexadecimal ones in small letters."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in "\n\t\r":
        out = F.replace(out, F.lit(c), F.lit(json.dumps(c)[1:-1]))
    rare = out
    for c in (chr(i) for i in range(32) if chr(i) not in "\n\t\r"):
        rare = F.replace(rare, F.lit(c), F.lit(json.dumps(c)[1:-1]))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None, label: str = "chat") -> DataFrame:
    """One row a message: conv_id, turn, role, n_calls, n_valid, n_answered, level, result_of, linked, message (canonical JSON).

    level: the topological level of the message's calls (the largest), or one above that of the call a
    result belongs to; linked: whether a result has its call (null for other messages).
    """
    work = Workspace(messages.sparkSession, label)
    parsed = work.write(parse_messages(messages), "parsed")
    calls = call_table(parsed, work, schemas)
    results = parsed.where(F.col("result_of").isNotNull()).select(_conv(), F.col("result_of").alias("call_id")).distinct().withColumn("answered", F.lit(True))
    linked = calls.join(results, ["conv", "call_id"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "call_id", "name", "arguments", F.size("errors").alias("bad"), F.coalesce("answered", F.lit(False)).alias("answered"))))
    by_row = linked.groupBy("row").agg(order.alias("own"), F.max("level").alias("own_level"))
    parents = calls.select("conv", F.col("call_id").alias("result_of"), F.col("level").alias("parent_level"), F.lit(True).alias("has_call"))
    answers = parsed.where(F.col("result_of").isNotNull()).select("row", _conv(), "result_of")
    whole = parsed.join(by_row, "row", "left").join(answers.join(parents, ["conv", "result_of"]).select("row", "parent_level", "has_call"), "row", "left")
    has = F.col("own").isNotNull()
    said = lambda p: (F.size(p["ids"]) > 0) & (F.size(F.array_except(p["ids"], F.transform("own", lambda x: x["call_id"]))) == 0)
    beside = F.array_join(F.transform(F.filter("pieces", lambda p: ~said(p)), lambda p: p["text"]), "")
    each_call = F.transform("own", lambda x: F.concat(F.lit('{"arguments":'), x["arguments"], F.lit(',"id":'), quoted(x["call_id"]), F.lit(',"name":'), quoted(x["name"]), F.lit("}")))
    body = F.concat(F.lit('{"content":'), quoted(F.when(has, beside).otherwise(F.col("content"))), F.lit(',"role":'), quoted(F.col("role")))
    own_calls = F.concat(F.lit(',"tool_calls":['), F.array_join(each_call, ","), F.lit("]}"))
    answer = F.concat(F.lit(',"tool_call_id":'), quoted(F.col("result_of")), F.lit("}"))
    tail = F.when(has, own_calls).when(F.col("result_of").isNotNull(), answer).otherwise(F.lit("}"))
    count = lambda test: F.when(has, F.size(F.filter("own", test))).otherwise(0).cast("long")
    return whole.select(
        "conv_id",
        "turn",
        "role",
        count(lambda x: F.lit(True)).alias("n_calls"),
        count(lambda x: x["bad"] == 0).alias("n_valid"),
        count(lambda x: x["answered"]).alias("n_answered"),
        F.coalesce(F.when(has, F.col("own_level")), F.col("parent_level") + 1, F.lit(0)).cast("long").alias("level"),
        "result_of",
        F.when(F.col("result_of").isNotNull(), F.coalesce("has_call", F.lit(False))).alias("linked"),
        F.concat(body, tail).alias("message"),
    )


def op4_chat_format(spark, sf_dir):
    """Every message of conversations, its calls linked, as canonical JSON."""
    return format_chat(table(spark, sf_dir, "conversations"))


#: For tables without tool calls, which hold no control characters but line ends and tabs.
OP4_SQL = """
SELECT conv_id, turn, coalesce(role, 'user') AS role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_answered, CAST(0 AS BIGINT) AS level,
  CAST(NULL AS VARCHAR) AS result_of, CAST(NULL AS BOOLEAN) AS linked,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || '}' AS message
FROM conversations
"""
