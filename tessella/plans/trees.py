"""Queries on JSON documents (families B, K and M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from .registry import query
from .tables import table


def _json(spark, d):
    """Records as JSON whose keys stand in no order, with composed and decomposed letters, line ends of all kinds and numbers of all forms."""
    number = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit('{"tags": [{"z": 1.0, "a": 1e3, "10": -0.0, "9": 0.00000123}, [], {}, "cafe\\u0301\\r\\nx\\ry"], "b\\u0301": null, "Z": {"name": '),
        F.to_json(F.struct(F.col("p_name").alias("v"))),
        F.lit(', "id": '), number, F.lit('}, "a": 1.50, "big": 12345678901234567890, "size": '), F.col("p_size").cast("string"), F.lit("}"),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("json"))


_CANONICAL = """'{"Z":{"id":' || p_partkey || ',"name":{"v":' || to_json(p_name)::varchar || '}},"a":1.5,"big":12345678901234567000,"b' || chr(769) || '":null,"size":' || p_size || ',"tags":[{"9":0.00000123,"10":0,"a":1000,"z":1},[],{},"caf' || chr(233) || '\\nx\\ny"]}'"""


@query(f"with c as (select p_partkey, {_CANONICAL} as json from part) select p_partkey, json, sha256(json) as hash, 'lrv_' || substr(sha256('[\"' || p_partkey || '\",' || to_json(json)::varchar || ']'), 1, 24) as id from c")
def canonical_documents(spark, d):
    """K2, M4, B1: JSON with its keys in order at every level, strings in NFC with line feeds alone; its hash, and an id of it."""
    c = _json(spark, d).select("p_partkey", canonical.canonical_json(F.col("json")).alias("json"))
    return c.select("p_partkey", "json", F.sha2("json", 256).alias("hash"), canonical.stable_id("lrv", F.col("p_partkey").cast("string"), F.col("json")).alias("id"))


NAMES = ["local_path", "api_key", "prompt"]
#: Forbidden names as keys at several depths, and as texts within values, which are allowed.
_EVENT = """case event_id % 4 when 0 then '{"meta": {"local_path": 1, "note": "\\"api_key\\": 2"}, "p": ' || props || '}' when 1 then '[{"x": [{"prompt": {"api_key": []}}]}, "prompt"]' when 2 then '{"api_key" : ' else '{"event": "prompt", "p": ' || props || '}' end"""


@query(
    f"with j as (select event_id, {_EVENT} as j from events), ok as (select event_id, j from j where json_valid(j))"
    f" select event_id, t.key as name, regexp_replace(substr(t.fullkey, case when t.fullkey like '$[%' then 2 else 3 end), '\\[(\\d+)\\]', '.\\1', 'g') as path from ok, json_tree(ok.j) t where t.key in ({', '.join(repr(n) for n in NAMES)}) and t.fullkey like '%.' || t.key"
)
def forbidden_paths(spark, d):
    """M6: forbidden names as keys, with their paths; names within values are none."""
    n = F.col("event_id") % 4
    j = F.when(n == 0, F.concat(F.lit('{"meta": {"local_path": 1, "note": "\\"api_key\\": 2"}, "p": '), "props", F.lit("}"))).when(n == 1, F.lit('[{"x": [{"prompt": {"api_key": []}}]}, "prompt"]')).when(n == 2, F.lit('{"api_key" : ')).otherwise(F.concat(F.lit('{"event": "prompt", "p": '), "props", F.lit("}")))
    found = canonical.forbidden(table(spark, d, "events").select("event_id", j.alias("j")), "event_id", "j", NAMES)
    return found.select("event_id", "name", F.when(F.col("path").rlike("^[0-9]"), F.concat(F.lit("."), "path")).otherwise(F.col("path")).alias("path"))
