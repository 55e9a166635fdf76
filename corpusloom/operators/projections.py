"""Record shapes: messages, nested fields and allow-listed columns."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.registry import query

MESSAGES = "array<struct<turn:bigint,role:string,content:string>>"


def messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation with its messages in the order of turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(ordered.alias("messages"))


def joined_content(role: str, wanted: bool = True) -> Column:
    """The contents of messages of a role, or of all others, one to a line."""
    chosen = F.filter("messages", lambda m: (m["role"] == role) if wanted else (m["role"] != role))
    return F.array_join(F.transform(chosen, lambda m: m["content"]), "\n")


def role_length(role: str | None = None) -> Column:
    """Code points of messages of a role, or of all messages."""
    chosen = F.filter("messages", lambda m: m["role"] == role) if role else F.col("messages")
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))


def make_record(docs: DataFrame, task: str, revision: str) -> DataFrame:
    """The common record: identity, provenance, messages, quality flags and derived measures."""
    content = F.sha2("text", 256)
    return docs.select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "source", F.col("lang").alias("variant"), F.lit(task).alias("task"), F.lit(revision).alias("revision"),
        F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.substring("text", 1, 80).alias("content")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.struct(F.col("text").isNotNull().alias("parse_ok"), (F.length("text") > 8192).alias("over_length")).alias("flags"),
        F.struct(content.alias("content_sha256"), F.array(F.concat(F.lit("text:"), content), F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).alias("groups")).alias("meta"),
        F.array(F.lit("import"), F.lit("normalise")).alias("steps"),
    )


def upgrade_record(records: DataFrame, step: str) -> DataFrame:
    """A new version: the step is added once, groups are sorted and distinct, lengths and hash are made anew."""
    meta = F.col("meta").withField("groups", F.array_sort(F.array_distinct("meta.groups"))).withField("total_chars", role_length()).withField("content_sha256", F.sha2(joined_content("assistant"), 256))
    return records.withColumns({"steps": F.array_distinct(F.array_append("steps", step)), "meta": meta})


def project(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Only allow-listed dotted paths, in their order; a missing one raises."""
    return df.select(*(F.col(p).alias(p.replace(".", "_")) for p in allowed))


def same_projection(left: DataFrame, right: DataFrame, key: str, paths: Iterable[str]) -> DataFrame:
    """For each path the number of keys whose values differ, nulls being equal."""
    both = left.alias("l").join(right.alias("r"), key)
    counts = [F.count_if(~F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))).alias(p) for p in paths]
    row = both.agg(*counts)
    return row.select(F.explode(F.create_map(*(x for p in paths for x in (F.lit(p), F.col(f"`{p}`")))))).toDF("path", "n_different")


def compare_and_set(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Apply patches (key, expected, replacement): only where the value is the expected one.

    ``outcome`` is applied, conflict, or unchanged. Patches of unknown keys are not in
    the result; see ``unmatched_patches``.
    """
    both = df.join(patches.select(key, "expected", "replacement"), key, "left")
    hit = F.col("replacement").isNotNull()
    same = F.col(column).eqNullSafe(F.col("expected"))
    outcome = F.when(hit & same, "applied").when(hit, "conflict").otherwise("unchanged")
    return both.select(*(F.when(hit & same, F.col("replacement")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns), outcome.alias("outcome"))


def unmatched_patches(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    return patches.join(df.select(key), key, "left_anti")


def flatten_json(value: str) -> Column:
    """(path, scalar) pairs of a JSON text; arrays give [i], text that is not JSON null."""
    @F.pandas_udf("array<struct<path:string,value:string>>")
    def flat(texts: pd.Series) -> pd.Series:
        def walk(x, path):
            if isinstance(x, dict):
                for k in sorted(x):
                    yield from walk(x[k], f"{path}.{k}" if path else k)
            elif isinstance(x, list):
                for i, y in enumerate(x):
                    yield from walk(y, f"{path}[{i}]")
            else:
                yield {"path": path, "value": x if isinstance(x, str) else json.dumps(x)}

        def one(text):
            try:
                return list(walk(json.loads(text), "")) if text is not None else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return flat(F.col(value))


def leaf_paths(df: DataFrame) -> list[str]:
    """Dotted paths of all leaves of a table's schema."""
    from pyspark.sql.types import StructType

    def walk(kind, path):
        for f in kind:
            own = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, own)
            else:
                yield own

    return list(walk(df.schema, ""))


def numbered_turns(content: Column, prefix: str) -> Column:
    """Values of a map under keys like HS01, HS02, in the order of their numbers; blank ones go."""
    chosen = F.filter(F.map_entries(content), lambda e: e["key"].rlike(f"^{prefix}0*[1-9][0-9]*$") & (F.trim(e["value"]) != ""))
    ordered = F.array_sort(F.transform(chosen, lambda e: F.struct(F.regexp_extract(e["key"], "([0-9]+)$", 1).cast("int").alias("n"), F.trim(e["value"]).alias("value"))))
    return F.transform(ordered, lambda e: e["value"])


def first_pairs(turns: DataFrame, pairs: int, key: str = "conv_id") -> DataFrame:
    """The turns of the first question-and-answer pairs."""
    return turns.where(F.col("turn") < 2 * pairs)


@query("prj_01_make_record", "SELECT source || ':' || doc_id AS id, source, lang AS variant, length(text) > 8192 AS over_length, sha256(text) AS content, length(substring(text, 1, 80))::INT AS n_user FROM documents")
def _(t):
    r = make_record(t.documents, "write", "r1")
    return r.select("id", "source", "variant", F.col("flags.over_length").alias("over_length"), F.col("meta.content_sha256").alias("content"), F.length(r.messages[0]["content"]).alias("n_user"))


@query("prj_02_upgrade_record", "SELECT source || ':' || doc_id AS id, 'id:' || doc_id || ' text:' || sha256(text) AS groups, length(text) + length(substring(text, 1, 80)) AS total_chars, 'import normalise' AS steps FROM documents")
def _(t):
    r = upgrade_record(make_record(t.documents, "write", "r1"), "normalise")
    return r.select("id", F.array_join("meta.groups", " ").alias("groups"), F.col("meta.total_chars").alias("total_chars"), F.array_join("steps", " ").alias("steps"))


@query("prj_03_message_lengths", "SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS n_input, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS n_assistant, sum(length(text))::BIGINT AS n_total FROM conversations GROUP BY conv_id")
def _(t):
    size, own = F.length("text"), F.col("role") == "assistant"
    return t.conversations.groupBy("conv_id").agg(F.sum(F.when(~own, size).otherwise(0)).alias("n_input"), F.sum(F.when(own, size).otherwise(0)).alias("n_assistant"), F.sum(size).alias("n_total"))


@query("prj_04_assistant_text", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id")
def _(t):
    return messages(t.conversations).select("conv_id", joined_content("assistant").alias("answer"))


@query("prj_05_input_text", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS prompt FROM conversations GROUP BY conv_id")
def _(t):
    return messages(t.conversations).select("conv_id", joined_content("assistant", False).alias("prompt"))


@query("prj_06_numbered_turns", "SELECT conv_id, string_agg(trim(text), '|' ORDER BY turn) FILTER (role = 'user' AND trim(text) <> '') AS turns FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND trim(text) <> '') > 0")
def _(t):
    key = F.concat(F.when(F.col("role") == "user", "HS").otherwise("SS"), F.lpad((F.col("turn") + 1).cast("string"), 3, "0"))
    maps = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("text").alias("v")))).alias("content"))
    rows = maps.select("conv_id", numbered_turns(F.col("content"), "HS").alias("turns")).where(F.size("turns") > 0)
    return rows.select("conv_id", F.array_join("turns", "|").alias("turns"))


@query("prj_07_source_projection", "SELECT 'documents' AS origin, doc_id AS id, length(text)::INT AS n FROM documents UNION ALL SELECT 'pages', page_id, length(html)::INT FROM pages")
def _(t):
    docs = project(t.documents, ["doc_id", "text"]).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return docs.unionByName(project(t.pages, ["page_id", "html"]).select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.length("html").alias("n")))


@query("prj_08_same_projection", "SELECT * FROM (SELECT 'lang' AS path, 0::BIGINT AS n_different UNION ALL SELECT 'text', count(*) FROM documents WHERE text <> upper(text))")
def _(t):
    return same_projection(t.documents, t.documents.withColumn("text", F.upper("text")), "doc_id", ["lang", "text"])


@query("prj_09_leaf_paths", "SELECT * FROM (VALUES ('id'), ('source'), ('variant'), ('task'), ('revision'), ('messages'), ('flags.parse_ok'), ('flags.over_length'), ('meta.content_sha256'), ('meta.groups'), ('steps')) v(path)")
def _(t):
    paths = leaf_paths(make_record(t.documents, "write", "r1"))
    return t.spark.createDataFrame([(p,) for p in paths], "path string")


@query("prj_10_nested_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("prj_11_12_patches", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 7 <> 0 THEN 'unchanged' WHEN d.lang = 'en' THEN 'applied' ELSE 'conflict' END AS outcome FROM documents d) GROUP BY outcome")
def _(t):
    patches = t.documents.where("doc_id % 7 = 0").select("doc_id", F.lit("en").alias("expected"), F.lit("eng").alias("replacement"))
    return compare_and_set(t.documents, patches, "doc_id", "lang").groupBy("outcome").agg(F.count("*").alias("n"))


@query("prj_12_unmatched_patches", "SELECT item_id AS doc_id FROM benchmark WHERE item_id + 990 NOT IN (SELECT doc_id FROM documents)")
def _(t):
    patches = t.benchmark.select((F.col("item_id") + 990).alias("doc_id"))
    return unmatched_patches(t.documents, patches, "doc_id").select((F.col("doc_id") - 990).alias("doc_id"))


@query("prj_13_visible_fields", "SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(t):
    nested = t.conversations.select("conv_id", F.struct("turn", "text", "role").alias("m"))
    visible = nested.withColumn("m", F.col("m").dropFields("text", "role"))
    return visible.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("m.turn").alias("last_turn"))


@query("prj_14_flatten_json", "SELECT 'k' AS path, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2")
def _(t):
    pairs = t.events.select(F.explode(flatten_json("props")).alias("x"))
    return pairs.groupBy("x.path", "x.value").agg(F.count("*").alias("n"))


@query("prj_15_training_fields", "SELECT doc_id, text FROM documents")
def _(t):
    return project(t.documents, ["doc_id", "text"])


@query("prj_16_manifest", "SELECT doc_id AS id, source AS axis, sha256(text) AS record_sha256, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS candidate_rank, len(string_split_regex(trim(text, chr(32) || chr(10)), '[ \\n]+'))::INT AS n_words FROM documents")
def _(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    words = F.size(F.split(F.btrim("text", F.lit(" \n")), "[ \\n]+"))
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("axis"), F.sha2("text", 256).alias("record_sha256"), rank.alias("candidate_rank"), words.alias("n_words"))


@query("prj_17_first_pairs", "SELECT conv_id, turn, role FROM conversations WHERE turn < 4")
def _(t):
    return first_pairs(t.conversations, 2).select("conv_id", "turn", "role")
