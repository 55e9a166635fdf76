"""Line deduplication by a sharded minimal perfect hash of repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._store import materialise
from corpusloom.llm._text import chunks, texts
from corpusloom.llm.perfect_hash import PerfectHash

#: Repeated lines of one shard, and bytes of arrays that may be broadcast.
SHARD_LINES, BROADCAST_BYTES = 1 << 18, 64 << 20
#: Requests to one shard that one task answers.
GROUP_DOCS = 500_000

_SPACE = b" \t\n\v\f\r"
_NO_ID = -(1 << 63)
_ARRAYS = "shard long, levels array<binary>, fingerprints binary, counts binary, values binary"


def line_keys(raw: bytes) -> list[bytes]:
    """The key of every line: ASCII white space stripped, A-Z lower-cased."""
    return [line.strip(_SPACE) for line in raw.lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least)


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two independent 64-bit numbers for each key: its hash and its fingerprint."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _line_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            keys, n = [], []
            for text in texts(batch, "text").cast(pa.large_binary()):
                own = {k for k in line_keys(text.as_py()) if _long_enough(k, least)}
                keys += own
                n.append(len(own))
            found = _digests(keys).view(np.int64)
            ids = np.repeat(batch.column("doc_id").fill_null(_NO_ID).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(ids)], names=["line", "fingerprint", "doc_id"])

    return run


def _build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
    arrays = [lines[c].to_numpy() for c in ("line", "fingerprint", "n_docs", "last_doc")]
    built = PerfectHash.build(arrays[0].view(np.uint64), arrays[1].view(np.uint64), *arrays[2:])
    return pd.DataFrame([{"shard": key[0]} | built.to_row()])


def line_index(docs: DataFrame, least: int = 20, min_docs: int = 3, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The arrays of each shard for lines found in ``min_docs`` rows at least, and the shards' number."""
    rows = docs.mapInArrow(_line_rows(least), "line long, fingerprint long, doc_id long")
    repeated = rows.groupBy("line", "fingerprint").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs)
    repeated = materialise(repeated, "lines")
    shards = max(1, -(-repeated.count() // shard_lines))
    dealt = repeated.withColumn("shard", F.pmod("line", F.lit(shards)))
    return materialise(dealt.groupBy("shard").applyInPandas(_build, _ARRAYS), "line-arrays"), shards


class _Probe:
    """Drops from one text the lines that ``min_docs`` rows hold, a later document among them."""

    def __init__(self, rows, shards: int, min_docs: int):
        self.hashes, self.shards, self.min_docs = {r["shard"]: PerfectHash.from_row(r) for r in rows}, shards, min_docs

    def drops(self, found: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line, by digest and its document's id, goes."""
        out = np.zeros(len(found), bool)
        shard = found[:, 0].view(np.int64) % self.shards
        for s in np.unique(shard).tolist():
            if s in self.hashes:
                own, at = self.hashes[s], np.flatnonzero(shard == s)
                member, place = own.look_up(found[at, 0].copy(), found[at, 1])
                if member.any():
                    out[at] = member & (own.counts[place] >= self.min_docs) & (own.values[place] > ids[at])
        return out


def _cut(batch: pa.RecordBatch, carry: list[str], raws: list[bytes], places: list[list[int]], drop: np.ndarray) -> pa.RecordBatch:
    """The batch without the lines to drop."""
    kept, n_lines, n_dropped, at = [], [], [], 0
    for raw, own in zip(raws, places):
        lines = raw.split(b"\n")
        gone = {i for i, d in zip(own, drop[at : at + len(own)].tolist()) if d}
        at += len(own)
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else raw)
    columns = [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in carry)], names=["doc_id", "text", "n_lines", "n_dropped", *carry])


def _eligible(raws: list[bytes], least: int) -> tuple[list[list[int]], np.ndarray]:
    """Each text's lines that are long enough, and the digests of all of them."""
    places, keys = [], []
    for raw in raws:
        own = [(i, k) for i, k in enumerate(line_keys(raw)) if _long_enough(k, least)]
        places.append([i for i, _ in own])
        keys += [k for _, k in own]
    return places, _digests(keys)


def _probe_all(arrays, shards: int, least: int, min_docs: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(arrays.value, shards, min_docs)
        for batch in chunks(batches, "text"):
            raws = [x.as_py() for x in texts(batch, "text").cast(pa.large_binary())]
            places, found = _eligible(raws, least)
            ids = np.repeat(batch.column("doc_id").fill_null(_NO_ID).to_numpy(), [len(x) for x in places])
            yield _cut(batch, carry, raws, places, probe.drops(found, ids))

    return run


def _requests(shards: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            for doc_id, content, raw in zip(batch.column("doc_id").fill_null(_NO_ID).to_pylist(), batch.column("content").to_pylist(), texts(batch, "text").cast(pa.large_binary())):
                found = _eligible([raw.as_py()], least)[1]
                shard = found[:, 0].view(np.int64) % shards
                out += [(s, doc_id, content, np.unique(found[shard == s], axis=0).tobytes()) for s in np.unique(shard).tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["shard", "id", "content", "asked"])

    return run


def _answer(shards: int, min_docs: int):
    def run(key: tuple, asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        probe, out = _Probe(arrays.to_dict("records"), shards, min_docs), []
        for doc_id, content, raw in zip(asked.id, asked.content, asked.asked):
            found = np.frombuffer(raw, "<u8").reshape(-1, 2)
            if len(gone := found[probe.drops(found, np.full(len(found), doc_id))]):
                out.append((doc_id, content, gone.tobytes()))
        return pd.DataFrame(out, columns=["id", "content", "gone"])

    return run


def _apply(least: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raws = [x.as_py() for x in texts(batch, "text").cast(pa.large_binary())]
            places, found = _eligible(raws, least)
            drop, at = np.zeros(len(found), bool), 0
            for own, gone in zip(places, batch.column("gone").to_pylist()):
                if gone:
                    lost = set(map(tuple, np.frombuffer(b"".join(gone), "<u8").reshape(-1, 2).tolist()))
                    drop[at : at + len(own)] = [tuple(x) in lost for x in found[at : at + len(own)].tolist()]
                at += len(own)
            yield _cut(batch, carry, raws, places, drop)

    return run


def dedup_lines(
    docs: DataFrame, least: int = 20, min_docs: int = 3, carry: tuple[str, ...] = (), broadcast_bytes: int = BROADCAST_BYTES,
    shard_lines: int = SHARD_LINES, group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, carried columns) for each row of ``docs``.

    Lines whose key has ``least`` code points and is found in ``min_docs`` rows stay
    only where doc_id is the largest that holds the key; all their copies there stay.
    Distinct keys of repeated lines are put, by shards, into minimal perfect hashes
    with arrays of fingerprints, counts and last documents. If the arrays take at most
    ``broadcast_bytes``, every task probes them; beyond it, each document's digests
    go to the shards instead and the answers come back by document.

    A null or empty text is one empty line and is returned empty. A null doc_id
    counts as the smallest. Every row counts as a document, so rows of one doc_id
    count apart, and as ties all keep the line. Columns not carried are left out.
    """
    spark = docs.sparkSession
    kept = [c for c in carry if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    index, shards = line_index(rows.select("doc_id", "text"), least, min_docs, shard_lines)
    size = index.select(F.sum(F.octet_length("fingerprints") * 3 + F.aggregate("levels", F.lit(0), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    schema = T.StructType([*rows.select("doc_id", "text").schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *rows.select(*kept).schema])
    if size <= broadcast_bytes:
        arrays = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
        return rows.mapInArrow(_probe_all(arrays, shards, least, min_docs, kept), schema)
    salts = max(1, -(-rows.count() // group_docs))
    keyed = rows.withColumn("content", F.xxhash64("text"))
    asked = keyed.select("doc_id", "content", "text").mapInArrow(_requests(shards, least), "shard long, id long, content long, asked binary")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "content"), F.lit(salts)))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    answers = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_answer(shards, min_docs), "id long, content long, gone binary")
    answers = answers.groupBy("id", "content").agg(F.collect_list("gone").alias("gone"))
    told = keyed.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(answers, ["id", "content"], "left")
    return told.select("doc_id", "text", "gone", *kept).mapInArrow(_apply(least, kept), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows by joins of lines.
SQL = r"""
WITH lines AS (
    SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each_line AS (
    SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM lines
), keyed AS (
    SELECT doc_id, row_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each_line
), common AS (
    SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT row_id) >= 3
), told AS (
    SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id, row_id
"""
