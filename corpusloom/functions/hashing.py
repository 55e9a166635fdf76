"""Canonical JSON, digests, signed ids and walks through nested JSON."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import nfc
from corpusloom.registry import query


def _canonical(value):
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dict):
        return {unicodedata.normalize("NFC", k): _canonical(v) for k, v in value.items()}
    return [_canonical(v) for v in value] if isinstance(value, list) else value


def _strict(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key comes twice")
    return dict(pairs)


def _constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def load_strict(text: str):
    """Parse JSON; a key that comes twice, NaN or Infinity raises ValueError."""
    return json.loads(text, object_pairs_hook=_strict, parse_constant=_constant)


def _on_json(kind: str, each):
    """A function of parsed JSON over a column; null where the text is null or not strict JSON."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return each(load_strict(text))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def canonical_json(c: Column) -> Column:
    """Sorted keys, no spaces, NFC."""
    return _on_json("string", lambda x: json.dumps(_canonical(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))(c)


def json_sha256(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def is_strict_json(c: Column) -> Column:
    return F.coalesce(_on_json("boolean", lambda x: True)(c), F.lit(False))


def _walk(value, depth=1):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k, depth
            yield from _walk(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, depth)


def json_keys(c: Column) -> Column:
    """(key, depth) of every object member, at any depth."""
    return _on_json("array<struct<key:string,depth:int>>", lambda x: [{"key": k, "depth": d} for k, d in _walk(x)])(c)


def _leaves(value) -> int:
    if isinstance(value, dict):
        return sum(map(_leaves, value.values()))
    return sum(map(_leaves, value)) if isinstance(value, list) else 1


def leaf_count(c: Column) -> Column:
    return _on_json("int", _leaves)(c)


def candidate_records(c: Column, needed: list[str]) -> Column:
    """Objects at any depth that have all the needed members, as canonical JSON."""

    def found(x):
        if isinstance(x, dict):
            if all(k in x for k in needed):
                yield json.dumps(_canonical(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            for v in x.values():
                yield from found(v)
        elif isinstance(x, list):
            for v in x:
                yield from found(v)

    return _on_json("array<string>", lambda x: list(found(x)))(c)


def forbidden_keys(c: Column, names: list[str]) -> Column:
    """Forbidden members at any depth, sorted and distinct."""
    return _on_json("array<string>", lambda x: sorted({k for k, _ in _walk(x)} & set(names)))(c)


def embedded_objects(c: Column, key: str) -> Column:
    """JSON objects inside free text that have a member ``key``, the outermost first."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder(object_pairs_hook=_strict)

        def one(text):
            out, at = [], 0
            while text is not None and (at := text.find("{", at)) >= 0:
                try:
                    value, end = decoder.raw_decode(text, at)
                except (ValueError, RecursionError):
                    at += 1
                    continue
                if isinstance(value, dict) and key in value:
                    out.append(text[at:end])
                    at = end
                else:
                    at += 1
            return out

        return texts.map(one)

    return run(c)


def stable_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(c, 256))


def group_id(kind: str, c: Column) -> Column:
    """``kind:`` and the digest of the value in canonical composition."""
    return F.concat(F.lit(kind + ":"), F.sha2(nfc(c), 256))


def signed_id(kind: str, c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the kind and the value with a zero byte between, so kinds can't be mixed up."""

    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else f"{kind}_{hmac.new(key, f'{kind}\0{x}'.encode(), hashlib.sha256).hexdigest()}")

    return sign(c)


def message_signature(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, signature): SHA-256 of the ordered roles and normalised contents."""
    from corpusloom.functions.text import collapse

    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\x1f", "role", F.lower(collapse("text"))).alias("t"))))
    return turns.groupBy(key).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "\x1e"), 256).alias("signature"))


@query("jsn_01_canonical", "SELECT event_id, props AS canonical FROM (SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events)")
def _(t):
    return t.events.select("event_id", canonical_json(F.col("props")).alias("canonical"))


@query("jsn_02_json_sha256", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS h FROM events")
def _(t):
    return t.events.select("event_id", json_sha256(F.col("props")).alias("h"))


@query("jsn_03_stable_id", "SELECT doc_id, 'doc_' || sha256(text) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", stable_id("doc_", F.col("text")).alias("id"))


@query("jsn_04_signed_id")
def _(t):
    return t.documents.select("doc_id", signed_id("document", F.col("doc_id").cast("string"), b"not a secret: a key for tests").alias("id"))


@query("jsn_05_group_id", "SELECT doc_id, 'text:' || sha256(nfc_normalize(text)) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", group_id("text", F.col("text")).alias("id"))


@query("jsn_06_message_signature", "SELECT conv_id, sha256(string_agg(role || chr(31) || lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g'))), chr(30) ORDER BY turn)) AS signature FROM conversations GROUP BY conv_id")
def _(t):
    return message_signature(t.conversations)


@query("jsn_07_content_hash", "SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') || chr(0) || coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '')) AS h FROM conversations GROUP BY conv_id")
def _(t):
    from corpusloom.operators.projections import joined_content, messages

    return messages(t.conversations).select("conv_id", F.sha2(F.concat(joined_content("assistant", False), F.lit("\0"), joined_content("assistant")), 256).alias("h"))


@query("jsn_08_key_walk", "SELECT 'k' AS key, 2 AS depth, count(*) AS n FROM events UNION ALL SELECT 'inner', 1, count(*) FROM events UNION ALL SELECT 'list', 1, count(*) FROM events")
def _(t):
    nested = F.concat(F.lit('{"inner":'), F.col("props"), F.lit(',"list":[1,2]}'))
    return t.events.select(F.explode(json_keys(nested)).alias("x")).groupBy("x.key", "x.depth").agg(F.count("*").alias("n"))


@query("jsn_09_candidate_records", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS record FROM events")
def _(t):
    nested = F.concat(F.lit('{"rows":[{"x":1},'), F.col("props"), F.lit("]}"))
    return t.events.select("event_id", F.explode(candidate_records(nested, ["k"])).alias("record"))


@query("jsn_10_leaf_count", "SELECT event_id, 3 AS n FROM events")
def _(t):
    return t.events.select("event_id", leaf_count(F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":[1,{"c":null}]}'))).alias("n"))


@query("jsn_11_typed_json", "SELECT event_id, event_type || ':' || json_extract_string(props, '$.k') AS signature FROM events")
def _(t):
    return t.events.select("event_id", F.concat_ws(":", "event_type", F.from_json("props", "k int")["k"].cast("string")).alias("signature"))


@query("jsn_12_forbidden_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'secret' ELSE '' END AS found FROM events")
def _(t):
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":[{"secret":'), F.col("props"), F.lit("}]}"))).otherwise(F.col("props"))
    return t.events.select("event_id", F.array_join(forbidden_keys(value, ["secret", "token"]), ",").alias("found"))


@query("jsn_13_embedded_objects", "SELECT event_id, props AS object FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(t):
    free = F.concat(F.lit("see {this} and "), F.col("props"), F.lit(' or {"other": 1}.'))
    return t.events.select("event_id", F.explode(embedded_objects(free, "k")).alias("object"))


@query("src_11_strict_json", "SELECT event_id, event_id % 4 <> 0 AS strict FROM events")
def _(t):
    twice = F.when(F.col("event_id") % 4 == 0, F.lit('{"k":1,"k":2}')).otherwise(F.col("props"))
    return t.events.select("event_id", is_strict_json(twice).alias("strict"))
