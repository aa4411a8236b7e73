"""Chat formatting: tool calls linked to their results (DataFrame functions only).

Calls and results are hash-joined by (conversation, identifier), each first reduced to one row per identifier, so the side
that is hashed is as even as its keys. Dependencies are joined by the same key. Calls whose dependencies, and theirs in
turn, are on earlier calls are in order already; those with a dependency on a later call, and the calls that wait for
them, follow in rounds that place all whose dependencies are placed: as many rounds as the longest such chain has calls.
Arguments are checked against the tool's schema and written, like the whole message, as canonical JSON: keys sorted, no
blanks, nulls written out.

Defined results: of calls (results) that repeat an identifier the first by position stays and the others are counted;
a call without a result and a result without a call stay, marked by ``status``; a null identifier or conversation joins
with nothing and gives no row; arguments that are null or no JSON object, or an object that repeats a key, give the error ``not_an_object``
and are quoted as they are; whole numbers of more than 38 digits are written as doubles; an unknown tool or none gives
``unknown_tool``; a dependency that does not exist is counted in ``missing_deps`` and holds nothing up; calls on
a cycle come last, in their given order, with ``cyclic``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, materialise, running_rank

#: For each JSON type the types that a variant's schema may name.
JSON_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}
Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with JSON ``arguments`` under ``schemas``: tool -> parameter -> (type, required)."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT"), F.lit(False))
    errors = F.array(F.lit("unknown_tool"))
    for tool, params in schemas.items():
        checks = []
        for param, (kind, required) in params.items():
            value = F.try_variant_get(parsed, f"$.{param}", "variant")
            absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
            checks.append(F.when(absent, F.lit(f"missing:{param}") if required else F.lit(None)).when(~F.schema_of_variant(value).rlike(JSON_TYPES[kind]), F.lit(f"type:{param}")))
        errors = F.when(name == tool, F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")).otherwise(errors)
    return F.when(~is_object, F.array(F.lit("not_an_object"))).otherwise(errors)


def topological_rounds(edges: DataFrame) -> DataFrame:
    """(conv, call_id, round, cyclic) of calls with a dependency on a later call and of those that wait for them.

    ``edges``: conv, call_id, seq, dep, dep_seq, a row for each dependency that exists.
    """
    edges = materialise(edges, "topo-all")
    fresh = materialise(edges.where("dep_seq >= seq").select("conv", "call_id").distinct(), "topo-late")
    late = fresh
    while not fresh.isEmpty():
        behind = edges.join(fresh.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_semi").select("conv", "call_id").distinct()
        fresh = materialise(behind.join(late, ["conv", "call_id"], "left_anti"), "topo-late")
        late = late.unionByName(fresh)
    waiting = materialise(late, "topo-calls")
    open_edges = materialise(
        edges.join(waiting, ["conv", "call_id"], "left_semi").join(waiting.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_semi").select("conv", "call_id", "dep"),
        "topo-edges",
    )
    done, step = waiting.limit(0).withColumn("round", F.lit(0)).withColumn("cyclic", F.lit(False)), 1
    while not waiting.isEmpty():
        ready = waiting.join(open_edges.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
        placed = materialise(ready.withColumn("round", F.lit(step)).withColumn("cyclic", F.lit(False)), "topo-ready")
        if placed.isEmpty():
            return done.unionByName(waiting.withColumn("round", F.lit(step)).withColumn("cyclic", F.lit(True)))
        done = done.unionByName(placed)
        gone = placed.select("conv", F.col("call_id").alias("dep"))
        waiting = materialise(waiting.join(placed, ["conv", "call_id"], "left_anti"), "topo-calls")
        open_edges = materialise(open_edges.join(gone, ["conv", "dep"], "left_anti"), "topo-edges")
        step += 1
    return done


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Calls (conv, call_id, seq, name, arguments, depends_on) and results (conv, call_id, seq, content), linked.

    One row per identifier of either: conv, call_id, seq, result_seq, name, n_calls, n_results, status, errors,
    missing_deps, cyclic, topo_order (from 1 within the conversation; null for a result without a call), message.
    """
    first_call = calls.groupBy("conv", "call_id").agg(F.min(F.struct("seq", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    known = materialise(first_call.where("conv is not null and call_id is not null").select("conv", "call_id", "c.*", "n_calls"), "chat-calls")
    first_result = results.where("conv is not null and call_id is not null").groupBy("conv", "call_id").agg(
        F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")
    )
    edges = (
        known.select("conv", "call_id", "seq", F.explode(F.array_distinct("depends_on")).alias("dep"))
        .join(known.select("conv", F.col("call_id").alias("dep"), F.col("seq").alias("dep_seq")), ["conv", "dep"], "left")
    )
    missing = edges.where(F.col("dep_seq").isNull()).groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("missing_deps"))
    found = edges.where(F.col("dep_seq").isNotNull())
    ordered = known.select("conv", "call_id", "seq")
    rounds = ordered.join(topological_rounds(found), ["conv", "call_id"], "left").na.fill({"round": 0}).withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    # a long conversation is ranked in parts of 64 positions
    part = F.col("round").cast("long") * 2**40 + F.floor(F.coalesce(F.col("seq"), F.lit(0)) / 64).cast("long")
    ranked = running_rank(materialise(rounds.withColumn("part", part), "chat-order"), ["conv"], "part", [F.col("seq").asc_nulls_first(), "call_id"], "topo_order").select("conv", "call_id", "cyclic", "topo_order")

    linked = (
        known.join(first_result.hint("shuffle_hash"), ["conv", "call_id"], "full")
        .join(missing, ["conv", "call_id"], "left")
        .join(ranked, ["conv", "call_id"], "left")
    )
    has_call, has_result = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("unparsed")), {"ignoreNullFields": "false"}))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1), F.lit("null"))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    message = F.concat(
        F.lit('{"arguments":'), F.when(has_call, canonical).otherwise(F.lit("null")), F.lit(',"id":'), text(F.col("call_id")),
        F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("r.content")), F.lit("}"),
    )
    return linked.select(
        "conv", "call_id", "seq", F.col("r.seq").alias("result_seq"), "name",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(~has_call, "orphan_result").when(~has_result, "unanswered").otherwise("linked").alias("status"),
        F.when(has_call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.coalesce("missing_deps", F.lit(0)).alias("missing_deps"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        "topo_order", message.alias("message"),
    )


#: The tools of a plain conversation, see ``turns_as_calls``.
TURN_SCHEMAS: Schemas = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True)},
    "note": {"text": ("string", True), "turn": ("integer", True)},
    "system": {"text": ("string", True)},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of (conv_id, turn, role, text); t is a turn and n the bytes of its text.

    * A user's turn t calls ``reply`` as ``conv:t``, which the assistant's turn t + 1 answers; it waits for the call two
      turns before it, if that was answered.
    * An assistant's turn t makes a note of itself as ``conv:t:note``, which the user's turn t + 1 answers. Notes are as
      faulty as a model's calls are: by n % 5 they lack their turn (1), give it as text (2), or are no object (3); where
      n % 7 is 0 the tool is ``memo``, which there is not. A note waits for the next note if n % 3 is 0, for the one
      before if it is 1.
    * A turn of any other role, or none, is a call of a tool of that name.

    Rows without a conversation or turn are left out; a null text is an empty one.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("seq"), "role", clean_text(F.col("text")).alias("content")
    )
    ident = lambda seq, *more: F.concat_ws(":", F.col("conv").cast("string"), seq.cast("string"), *more)
    none, seq, n, is_note = F.array().cast("array<string>"), F.col("seq"), F.octet_length("content"), F.lit("note")
    by_assistant, by_user = rows.where("role = 'assistant'"), rows.where("role = 'user'")
    results = by_assistant.select("conv", ident(seq - 1).alias("call_id"), "seq", "content").unionByName(
        by_user.where("seq > 0").select("conv", ident(seq - 1, is_note).alias("call_id"), "seq", "content")
    )
    asked = by_user.select("conv", "seq", "content", ident(seq).alias("call_id"))
    earlier = asked.select("conv", (seq + 2).alias("seq"), F.col("call_id").alias("dep"), seq.alias("_before")).distinct()
    answered = by_assistant.select("conv", (seq - 1).alias("_before")).distinct()
    deps = earlier.join(answered, ["conv", "_before"], "left_semi").select("conv", "seq", "dep")
    replies = asked.join(deps, ["conv", "seq"], "left").select(
        "conv", "call_id", "seq", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("content").alias("prompt"), seq.alias("turn"))).alias("arguments"),
        F.when(F.col("dep").isNotNull(), F.array("dep")).otherwise(none).alias("depends_on"),
    )
    text = F.col("content").alias("text")
    notes = by_assistant.select(
        "conv", ident(seq, is_note).alias("call_id"), "seq", F.when(n % 7 == 0, "memo").otherwise("note").alias("name"),
        F.when(n % 5 == 1, F.to_json(F.struct(text))).when(n % 5 == 2, F.to_json(F.struct(text, seq.cast("string").alias("turn"))))
        .when(n % 5 == 3, F.to_json(F.array(seq))).otherwise(F.to_json(F.struct(text, seq.alias("turn")))).alias("arguments"),
        F.when(n % 3 == 0, F.array(ident(seq + 2, is_note))).when(n % 3 == 1, F.array(ident(seq - 2, is_note))).otherwise(none).alias("depends_on"),
    )
    other = rows.where("role is null or role not in ('user', 'assistant')").select(
        "conv", ident(seq, F.coalesce("role", F.lit(""))).alias("call_id"), "seq", F.col("role").alias("name"), F.to_json(F.struct(text)).alias("arguments"), none.alias("depends_on")
    )
    return replies.unionByName(notes).unionByName(other), results
