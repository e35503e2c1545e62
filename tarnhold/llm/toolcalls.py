"""Chat formatting: tool-call linking (DataFrame functions only).

Calls and results meet by a hash join on conversation and identifier.  Calls are put in an order in
which each follows those it depends on, arguments are checked against JSON schemas, and call and
result are written as canonical JSON (keys in order, no blanks; the variant type keeps objects that way).

Relations:

* calls: conv_id, turn, idx, call_id, name, arguments (JSON text), after (ids it depends on)
* results: conv_id, turn, call_id, content

The order of a conversation is (level, turn, idx).  A call's level is its depth: 0 without dependencies, else one more
than the highest level of the calls it depends on, wherever they stand.  Calls on a cycle, or behind one, have none.
Levels come in rounds that take away what is solved; a run of calls that each wait for one other is shortened by half
in every step (pointer jumping), so a chain of n calls takes about log n steps.

Nothing is grouped by conversation: every key holds the identifier too, so a conversation with a third of all
rows is as well spread as any other.

Defined cases: a result whose id has no call is a row of status ``orphan_result``; the first of equal ids is the
call (earliest turn and idx), later ones are ``duplicate``; of several results the earliest is linked; a call
without result is ``unanswered``; null ids link with nothing; arguments that are not a JSON object are invalid;
exactly repeated rows count once.  Empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

_KIND = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}
_CALL = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
_RESULT = "tool_call_id string, content string"


def _type_is(kind: Column, wanted: str) -> Column:
    if wanted == "number":
        return kind.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z")
    if wanted in ("object", "array"):
        return kind.startswith(wanted.upper() + "<")
    return kind == _KIND[wanted]


#: Keywords of a schema that say something of a value, and those that say nothing.
_KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "properties", "required", "additionalProperties", "items"}
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
_TYPES = {*_KIND, "number", "object", "array"}


def _check_schema(schema: dict, at: str = "") -> None:
    """Raises on what ``errors`` does not check."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at or 'schema'}: not an object")
    if unknown := set(schema) - _KEYWORDS - _NOTES:
        raise ValueError(f"{at or 'schema'}: keywords not supported: {sorted(unknown)}")
    if "type" in schema and (not isinstance(schema["type"], str) or schema["type"] not in _TYPES):
        raise ValueError(f"{at or 'schema'}: type not supported: {schema['type']}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at or 'schema'}: additionalProperties must be true or false")
    for name, rule in schema.get("properties", {}).items():
        _check_schema(rule, f"{at}.{name}" if at else name)
    if "items" in schema:
        _check_schema(schema["items"], f"{at}[]")


def _wrong(value: Column, schema: dict, at: str = "") -> Column:
    """What is wrong with a variant (null: not there) under a schema; ``at`` is its name in messages."""
    found: list[Column] = []
    none = F.array().cast("array<string>")
    say = lambda bad, what: found.append(F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(what))).otherwise(none))
    kind = F.schema_of_variant(value)
    if at:
        if "type" in schema:
            say(value.isNotNull() & ~_type_is(kind, schema["type"]), f"{at}: not {schema['type']}")
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        isnumber = _type_is(kind, "number")
        for key, bad in (
            ("enum", lambda v: value.isNotNull() & ~text.isin([str(x) for x in v])),
            ("minimum", lambda v: isnumber & (number < v)),
            ("maximum", lambda v: isnumber & (number > v)),
            ("minLength", lambda v: (kind == "STRING") & (F.length(text) < v)),
            ("maxLength", lambda v: (kind == "STRING") & (F.length(text) > v)),
            ("pattern", lambda v: (kind == "STRING") & ~text.rlike(v)),
        ):
            if key in schema:
                say(bad(schema[key]), f"{at}: {key}")
    isobject = kind.startswith("OBJECT<")
    properties = schema.get("properties", {})
    for name in sorted({*properties, *schema.get("required", [])}):
        path, part = f"{at}.{name}" if at else name, F.try_variant_get(value, f"$['{name}']", "variant")
        if name in schema.get("required", []):
            say(isobject & part.isNull(), f"{path}: missing")
        if name in properties:
            found.append(_wrong(part, properties[name], path))
    if "items" in schema:
        items = F.when(kind.startswith("ARRAY<"), F.try_variant_get(value, "$", "array<variant>"))
        inner = F.flatten(F.transform(items, lambda x: _wrong(x, schema["items"], f"{at}[]")))
        found.append(F.coalesce(F.array_distinct(inner), none))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.when(isobject, F.try_variant_get(value, "$", "map<string,variant>")))
        extra = F.array_except(keys, F.array(*[F.lit(n) for n in sorted(properties)]).cast("array<string>"))
        say(F.size(extra) > 0, f"{at}: unknown properties" if at else "unknown properties")
    return F.concat(*found) if found else none


def errors(arguments: Column, schema: dict) -> Column:
    """Array of what is wrong with a variant under a JSON schema, to the schema's depth (types, required, enum, bounds,
    lengths, pattern, additionalProperties, items).  A keyword that is not checked raises ``ValueError``."""
    _check_schema(schema)
    return _wrong(arguments, schema)


def _calls_of() -> Column:
    """The calls of an assistant's text, null where it has none that can be read."""
    made = F.from_json("text", _CALL)["tool_calls"]
    return F.when((F.col("role") == "assistant") & F.col("text").rlike(r'(?s)\A\s*\{.*"tool_calls"') & (F.size(made) > 0), made)


def _result_of() -> Column:
    """The result in a tool's text; without an id if it cannot be read."""
    return F.when((F.col("role") == "tool") & F.col("text").rlike(r'(?s)\A\s*\{.*"tool_call_id"'), F.from_json("text", _RESULT))


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages (conv_id, turn, role, text) hold as JSON.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` has calls, a tool's text
    ``{"tool_call_id", "content"}`` a result.  Other texts have neither, nor has an assistant's whose JSON is broken.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    c = m.select("conv_id", "turn", F.posexplode(_calls_of()).alias("idx", "c"))
    calls = c.select("conv_id", "turn", F.col("idx").cast("bigint"), F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    r = m.withColumn("r", _result_of()).where("r IS NOT NULL")
    return calls, r.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), "r.content")


def from_dialogue(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogue as calls and results: a user's or system's turn asks, the turn after it answers.

    A user's turn t is a call ``t`` of ``reply`` that depends on the turn two before, if that is a user's too; a
    system's turn is a call of ``configure``, on which a user's turn right after it depends.  An assistant's turn is
    the result of call t - 1.
    """
    m = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    asks = m.where(F.col("role").isin("user", "system"))
    name = F.when(F.col("role") == "user", "reply").otherwise("configure")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"), words.alias("words")))
    calls = asks.select("conv_id", "turn", F.lit(0).cast("bigint").alias("idx"), F.col("turn").cast("string").alias("call_id"), name.alias("name"), arguments.alias("arguments"), "role")
    known = asks.select(F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), F.col("role").alias("k_role")).distinct()
    back = F.explode(F.array(F.lit(1), F.lit(2)))
    tied = calls.where("role = 'user'").select("conv_id", "turn", back.alias("by")).distinct()
    tied = tied.join(known, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("turn") - F.col("by") == F.col("k_turn")))
    tied = tied.where("(by = 1 AND k_role = 'system') OR (by = 2 AND k_role = 'user')")
    after = tied.groupBy(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn")).agg(F.array_sort(F.collect_set(F.col("k_turn").cast("string"))).alias("after"))
    calls = calls.join(after, (F.col("role") == "user") & F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left")
    calls = calls.select("conv_id", "turn", "idx", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = m.where(F.col("role") == "assistant").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _jumped(one: DataFrame) -> DataFrame:
    """conv, id, dep, least, more: runs of calls that wait for one other, shortened until ``dep`` waits for none or several.

    A call's level is the greater of ``least`` and the level of ``dep`` plus ``more``.  Runs that never end are cycles and
    are left out.
    """
    moving, ended = materialize(one), None
    for _ in range(moving.count().bit_length() + 1):
        all_ = moving if ended is None else moving.unionByName(ended)
        ahead = all_.select("conv", F.col("id").alias("dep"), F.col("dep").alias("n_dep"), F.col("least").alias("n_least"), F.col("more").alias("n_more"))
        met = materialize(moving.join(ahead, ["conv", "dep"], "left"))
        here = met.where("n_dep IS NULL").select("conv", "id", "dep", "least", "more")
        ended = here if ended is None else ended.unionByName(here)
        moving = met.where("n_dep IS NOT NULL").select("conv", "id", F.col("n_dep").alias("dep"), F.greatest(F.col("least"), F.col("n_least") + F.col("more")).alias("least"), (F.col("more") + F.col("n_more")).alias("more"))
        if moving.isEmpty():
            break
    return moving.limit(0) if ended is None else ended


def _levels(edges: DataFrame) -> DataFrame:
    """conv, id, level of the calls in ``edges`` (conv, id, dep; dep null for a call without any); null on or behind a cycle."""
    nodes = materialize(edges.select("conv", "id").distinct())
    left = materialize(edges.where("dep IS NOT NULL").select("conv", "id", "dep").distinct().withColumn("least", F.lit(0).cast("bigint")))
    done = materialize(nodes.join(left, ["conv", "id"], "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    while not left.isEmpty():
        known = done.select("conv", F.col("id").alias("dep"), "level")
        met = left.join(known, ["conv", "dep"], "left")
        # of each call: how many it still waits for, one of them, and the level that the solved ones ask for
        waits = F.count(F.when(F.col("level").isNull(), 1))
        state = materialize(met.groupBy("conv", "id").agg(waits.alias("waits"), F.min(F.when(F.col("level").isNull(), F.col("dep"))).alias("dep"), F.max(F.greatest(F.col("least"), F.coalesce(F.col("level") + 1, F.lit(0)))).alias("least")))
        runs = _jumped(state.where("waits = 1").select("conv", "id", "dep", "least", F.lit(1).cast("bigint").alias("more")))
        solved = state.where("waits = 0").select("conv", "id", F.col("least").alias("level"))
        ends = materialize(done.select("conv", "id", "level").unionByName(solved))
        ran = runs.join(ends.select("conv", F.col("id").alias("dep"), "level"), ["conv", "dep"]).select("conv", "id", F.greatest(F.col("least"), F.col("level") + F.col("more")).alias("level"))
        fresh = materialize(solved.unionByName(ran))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
        lower = state.select("conv", "id", F.col("least").alias("s_least"))
        rest = left.join(fresh.select("conv", "id"), ["conv", "id"], "left_anti").join(known.select("conv", "dep"), ["conv", "dep"], "left_anti")
        left = materialize(rest.join(lower, ["conv", "id"]).select("conv", "id", "dep", F.greatest("least", "s_least").alias("least")))
    return nodes.join(done, ["conv", "id"], "left")


LINKED = ["conv_id", "call_id", "turn", "idx", "level", "name", "status", "valid", "errors", "canonical"]


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``LINKED``: one row per call and per orphan result."""
    calls = materialize(calls.select("conv_id", "turn", "idx", "call_id", "name", "arguments", "after").distinct())
    heads = calls.groupBy(F.col("conv_id").alias("h_conv"), F.col("call_id").alias("h_id")).agg(F.min(F.struct("turn", "idx")).alias("head"))
    heads = materialize(heads)
    answers = results.select("conv_id", "turn", "call_id", "content").groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id")).agg(F.min(F.struct("turn", "content")).alias("answer"))
    c = calls.join(heads, _same("conv_id", "h_conv") & (F.col("call_id") == F.col("h_id")), "left")
    c = c.withColumn("first", F.coalesce(F.col("head") == F.struct("turn", "idx"), F.lit(False)))

    deps = c.select("conv_id", "call_id", "turn", "idx", F.explode("after").alias("dep"), "first")
    deps = deps.join(heads.select(F.col("h_conv").alias("d_conv"), F.col("h_id").alias("d_id")), _same("conv_id", "d_conv") & (F.col("dep") == F.col("d_id")), "left")
    deps = materialize(deps.select("conv_id", "call_id", "turn", "idx", "dep", "first", F.col("d_id").isNotNull().alias("there")))
    missing = deps.where("NOT there").groupBy(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_id"), F.col("turn").alias("m_turn"), F.col("idx").alias("m_idx")).agg(F.array_sort(F.collect_set(F.concat(F.col("dep"), F.lit(": no such call")))).alias("missing"))
    c = c.join(missing, _same("conv_id", "m_conv") & _same("call_id", "m_id") & _same("turn", "m_turn") & _same("idx", "m_idx"), "left")
    conv = lambda of: F.to_json(F.struct(F.col(of).alias("v")))  # noqa: E731  null conversations too have a key
    tied = deps.where("first AND there").select(conv("conv_id").alias("conv"), F.col("call_id").alias("id"), "dep")
    needed = tied.select("conv", F.col("dep").alias("id")).distinct().withColumn("dep", F.lit(None).cast("string"))
    levels = _levels(tied.unionByName(needed)).select(F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), F.col("level").alias("found"), F.lit(True).alias("l_there"))
    c = c.join(levels, (conv("conv_id") == F.col("l_conv")) & (F.col("call_id") == F.col("l_id")), "left")
    c = c.withColumn("level", F.when(F.col("l_there"), F.col("found")).otherwise(F.lit(0).cast("bigint"))).drop("l_conv", "l_id", "found", "l_there")

    c = c.join(answers, F.col("first") & _same("conv_id", "r_conv") & (F.col("call_id") == F.col("r_id")), "left")
    c = c.withColumn("v", F.try_parse_json("arguments"))
    none = F.array().cast("array<string>")
    rules = reduce(lambda rest, x: F.when(F.col("name") == x[0], errors(F.col("v"), x[1])).otherwise(rest), sorted(schemas.items()), F.array(F.lit("no such tool")))
    isobject = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))
    wrong = F.concat(F.when(~isobject, F.array(F.lit("arguments: not an object"))).otherwise(rules), F.coalesce("missing", none))
    c = c.withColumn("wrong", wrong)
    status = F.when(~F.col("first"), F.when(F.col("call_id").isNull(), "unanswered").otherwise("duplicate")).when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    whole = F.to_json(F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")))
    out = c.select("conv_id", "call_id", "turn", "idx", "level", "name", status.alias("status"), (F.size("wrong") == 0).alias("valid"), F.array_join("wrong", "; ").alias("errors"), whole.alias("canonical"))

    orphans = answers.join(heads, _same("r_conv", "h_conv") & (F.col("r_id") == F.col("h_id")), "left_anti")
    lone = F.to_json(F.struct(F.col("r_id").alias("id"), F.col("answer.content").alias("result")))
    null = lambda t: F.lit(None).cast(t)
    return out.unionByName(orphans.select(F.col("r_conv").alias("conv_id"), F.col("r_id").alias("call_id"), F.col("answer.turn").alias("turn"), null("bigint").alias("idx"), null("bigint").alias("level"), null("string").alias("name"), F.lit("orphan_result").alias("status"), F.lit(False).alias("valid"), F.lit("no such call").alias("errors"), lone.alias("canonical")))


#: A prompt has words and fits a turn's budget of characters.
_ASK = {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1024}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 4}}, "required": ["prompt", "turn", "words"], "additionalProperties": False}
#: What dialogue turns must look like as calls.
DIALOGUE = {"reply": _ASK, "configure": {**_ASK, "properties": {**_ASK["properties"], "turn": {"type": "integer", "maximum": 0}}}}


def conversation_links(messages: DataFrame) -> DataFrame:
    """``LINKED`` of a table of conversations: calls and results in their texts, and their dialogue as calls."""
    calls, results = from_messages(messages)
    more_calls, more_results = from_dialogue(messages.where(_calls_of().isNull() & _result_of().isNull()))
    return link(calls.unionByName(more_calls), results.unionByName(more_results), DIALOGUE)
