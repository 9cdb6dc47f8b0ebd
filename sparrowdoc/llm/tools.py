"""Tool-call linking: calls meet their results by identifier, in topological order, checked and serialised.

Calls (conv_id, call_id, turn, name, arguments as JSON) and results (conv_id, call_id, turn, content) are hash-joined
by ``call_id``. Arguments of type ``call`` name other calls whose results a call needs; ``level`` is the length of the
longest chain of needs below it, so that every call stands above all it needs. Chains are measured by doubling: pairs of
calls 2**k needs apart come from a join of the pairs half as far apart, so rounds grow with the logarithm of the longest
chain and no conversation is collected. Arguments are checked against the schema of the call's name: required keys and
JSON types, no others. The record is canonical JSON: sorted keys, no blanks, UTF-8.

Defined cases: of calls or results that share an identifier the first counts (by turn, then content) and n_calls and
n_results say how many there were; null identifiers link with nothing: such a call is ``open``, such a result ``orphan``,
each a row of its own. A call without a result is ``open``, a result without a call ``orphan`` (without a level), one that
stands before its call ``early``; calls that need themselves, over others or not, are ``cyclic`` without a level; needs
of unknown identifiers are counted in n_missing and don't order anything; arguments that aren't a JSON object are invalid.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize

_TYPES = {"string": str, "call": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
#: The schemas under which plain turns are linked: a user turn calls ``reply``, any other but an assistant's ``note``.
TURNS = {
    "reply": {"required": ["prompt", "turn"], "properties": {"prompt": "string", "turn": "integer", "after": "call"}},
    "note": {"required": ["role", "text"], "properties": {"role": "string", "text": "string"}},
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def valid(name: str | None, arguments, schemas: dict) -> bool:
    schema = schemas.get(name)
    if schema is None or not isinstance(arguments, dict):
        return False
    properties = schema.get("properties", {})
    if any(k not in arguments for k in schema.get("required", ())) or any(k not in properties for k in arguments):
        return False
    return all(isinstance(v, _TYPES[properties[k]]) and not (isinstance(v, bool) and properties[k] in ("integer", "number")) for k, v in arguments.items())


def levels(needs: DataFrame, nodes: int) -> DataFrame:
    """(node, level): the longest chain of ``needs`` (node, need) below each node that needs any; null on or above a cycle."""
    steps = [materialize(needs.distinct(), "needs")]
    while not steps[-1].isEmpty() and 1 << len(steps) <= 2 * nodes:
        last = steps[-1]
        steps.append(materialize(last.join(last.select(F.col("node").alias("need"), F.col("need").alias("far")), "need").select("node", F.col("far").alias("need")).distinct(), "needs"))
    at = materialize(needs.select("node").distinct().select("node", F.col("node").alias("here"), F.lit(0).cast("long").alias("level")), "levels")
    for k, step in reversed([*enumerate(steps)]):
        ahead = at.join(step.select(F.col("node").alias("here"), "need"), "here").select("node", F.col("need").alias("here"), (F.col("level") + (1 << k)).alias("level")).distinct()
        ahead = materialize(ahead, "levels")
        nxt = materialize(ahead.unionByName(at.join(ahead.select("node").distinct(), "node", "left_anti")), "levels")
        drop(at, ahead)
        at = nxt
    drop(*steps)
    return at.groupBy("node").agg(F.max("level").alias("level")).select("node", F.when(F.col("level") < nodes, F.col("level")).alias("level"))


def _needs(name, arguments, schemas: dict):
    """Identifiers that the arguments of type ``call`` hold."""
    held = F.from_json(arguments, "map<string,string>")
    out = F.array().cast("array<string>")
    for kind, schema in schemas.items():
        keys = [k for k, t in schema.get("properties", {}).items() if t == "call"]
        if keys:
            out = F.when(name == kind, F.array_distinct(F.filter(F.array(*[F.try_element_at(held, F.lit(k)) for k in keys]), lambda x: x.isNotNull()))).otherwise(out)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row for each identifier, and for each row without: conv_id, call_id, turn, n_calls, n_results, n_missing,
    status, valid, level, record."""
    pick = lambda df, *cols: df.groupBy("call_id").agg(F.count("*").alias("n"), F.min(F.struct("turn", *cols)).alias("x"))
    side = {"c": ["turn", "name", "arguments", "conv_id"], "r": ["turn", "content", "conv_id"]}
    c = pick(calls.where("call_id is not null"), *side["c"][1:]).select("call_id", F.col("n").alias("n_calls"), F.col("x").alias("c"))
    r = pick(results.where("call_id is not null"), *side["r"][1:]).select("call_id", F.col("n").alias("n_results"), F.col("x").alias("r"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    open_ = calls.where("call_id is null").select("call_id", one.alias("n_calls"), F.struct(*side["c"]).alias("c"), zero.alias("n_results"), F.lit(None).cast(r.schema["r"].dataType).alias("r"))
    lone = results.where("call_id is null").select("call_id", zero.alias("n_calls"), F.lit(None).cast(c.schema["c"].dataType).alias("c"), one.alias("n_results"), F.struct(*side["r"]).alias("r"))
    both = c.join(r, "call_id", "full").unionByName(open_).unionByName(lone)
    both = materialize(both.withColumn("needs", _needs(F.col("c.name"), F.col("c.arguments"), schemas)), "calls")

    known = both.where("call_id is not null and c is not null")
    asked = known.select(F.col("call_id").alias("node"), F.explode("needs").alias("need"))
    met = asked.join(known.select(F.col("call_id").alias("need")), "need").select("node", "need")
    found = levels(met, max(known.count(), 1)).select(F.col("node").alias("call_id"), F.col("level").alias("_level"), F.lit(True).alias("_met"))
    missing = asked.groupBy(F.col("node").alias("call_id")).agg(F.count("*").alias("_asked")).join(met.groupBy(F.col("node").alias("call_id")).agg(F.count("*").alias("_found")), "call_id", "left")
    rows = both.join(found, "call_id", "left").join(missing, "call_id", "left")
    cyclic = F.col("_met") & F.col("_level").isNull()
    status = F.when(F.col("c").isNull(), "orphan").when(cyclic, "cyclic").when(F.col("r").isNull(), "open").when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked")
    level = F.when(F.col("c").isNotNull() & ~F.coalesce(cyclic, F.lit(False)), F.coalesce("_level", zero))
    flat = rows.select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), "call_id", F.coalesce("c.turn", "r.turn").alias("turn"), F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_results", zero).alias("n_results"),
        (F.coalesce("_asked", zero) - F.coalesce("_found", zero)).alias("n_missing"), status.alias("status"), level.alias("level"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"),
    )
    schema = T.StructType([f for f in flat.schema.fields if f.name not in ("name", "arguments", "content")] + [T.StructField("valid", T.BooleanType()), T.StructField("record", T.StringType())])

    def run(batches):
        for b in batches:
            ok, records = [], []
            for key, state, name, text, content in zip(*(b.column(x).to_pylist() for x in ("call_id", "status", "name", "arguments", "content")), strict=True):
                try:
                    arguments = json.loads(text) if text is not None else None
                except ValueError:
                    arguments = text
                ok.append(valid(name, arguments, schemas))
                records.append(canonical({"arguments": arguments, "id": key, "name": name, "result": content, "status": state}))
            own = [b.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ok, pa.bool_()), pa.array(records, pa.string())], names=schema.names)

    return flat.mapInArrow(run, schema)


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain turns: an assistant turn is the result of the turn before it, every other turn a call.

    A user turn needs the reply to the turn two before it, if that is a call.
    """
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    key = lambda back: F.when(known, F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string")))
    ours = F.coalesce(F.col("role") == "assistant", F.lit(False))
    reply = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.when(F.col("turn") >= 2, key(2)).alias("after")))
    note = F.to_json(F.struct("role", "text"))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    calls = conversations.where(~ours).select("conv_id", key(0).alias("call_id"), "turn", F.when(user, "reply").otherwise("note").alias("name"), F.when(user, reply).otherwise(note).alias("arguments"))
    results = conversations.where(ours).select("conv_id", key(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
