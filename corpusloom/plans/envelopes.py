"""Sealed records: a data key for each, wrapped by a key-encryption key that can be replaced."""

from __future__ import annotations

import secrets
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.artifacts import artifact_hashes
from corpusloom.plans.scratch import new_path
from corpusloom.registry import query


def _random_keys(c: Column) -> Column:
    """256 random bits for each row, from the operating system's source."""

    @F.pandas_udf(T.BinaryType())
    def keys(ids: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_bytes(32) for _ in range(len(ids))])

    return keys.asNondeterministic()(c)


def _encrypt(c: Column, key: Column, about: Column) -> Column:
    return F.aes_encrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), about)


def _decrypt(c: Column, key: Column, about: Column) -> Column:
    return F.try_aes_decrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"), about)


class EnvelopeStore:
    """Records and their wrapped keys as two tables under ``path``.

    ``records`` has (id, sealed), each payload encrypted with its own data key, and
    ``keys/<n>`` (id, key_id, wrapped), the data keys encrypted with the key-encryption
    key of that id. Ids and key ids are authenticated with them, so neither a payload
    nor a key opens in another row's place. Rotation writes a new table of keys and
    deletes the old one; records aren't read. Ids are unique and not null.
    """

    def __init__(self, spark: SparkSession, path: str, context: str):
        self.spark, self.path, self.context = spark, path, context

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _about(self, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(self.context), *(p.cast("string") for p in parts)).cast("binary")

    def generation(self) -> int:
        place, fs = self._fs(f"{self.path}/keys")
        return max(int(s.getPath().getName()) for s in fs.listStatus(place))

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys/{self.generation()}")

    def write(self, rows: DataFrame, id_column: str, payload: str, key: Column, key_id: str) -> None:
        """Seal each row's payload (text; null stays null) with a fresh data key; both tables come from one pass."""
        own = rows.select(F.col(id_column).alias("id"), F.col(payload).alias("p")).withColumn("k", _random_keys(F.col("id").cast("string")))
        sealed = own.select("id", _encrypt(F.col("p").cast("binary"), F.col("k"), self._about(F.col("id"))).alias("sealed"), _encrypt(F.col("k"), key, self._about(F.col("id"), F.lit(key_id))).alias("wrapped"))
        row = lambda kind, sealed, name, wrapped: F.struct(F.lit(kind).alias("kind"), sealed.cast("binary").alias("sealed"), name.cast("string").alias("key_id"), wrapped.cast("binary").alias("wrapped"))
        kinds = F.array(row("records", F.col("sealed"), F.lit(None), F.lit(None)), row("keys", F.lit(None), F.lit(key_id), F.col("wrapped")))
        sealed.select("id", F.explode(kinds).alias("x")).select("id", "x.*").write.mode("errorifexists").partitionBy("kind").parquet(f"{self.path}/both")
        for kind, target in (("records", "records"), ("keys", "keys/0")):
            source, fs = self._fs(f"{self.path}/both/kind={kind}")
            to = self._fs(f"{self.path}/{target}")[0]
            fs.mkdirs(to.getParent())
            if not fs.rename(source, to):
                raise OSError(f"{source} can't be moved")

    def _unwrapped(self, keys: Mapping[str, Column]) -> Column:
        """The data key by the key-encryption key of the row's key id; null if that isn't given or doesn't fit."""
        out = F.lit(None).cast("binary")
        for name, key in keys.items():
            out = F.when(F.col("key_id") == name, _decrypt(F.col("wrapped"), key, self._about(F.col("id"), F.col("key_id")))).otherwise(out)
        return out

    def rotate(self, keys: Mapping[str, Column], new_key: Column, new_id: str) -> int:
        """Wrap all data keys with a new key-encryption key; how many could not be unwrapped, in which case nothing is changed."""
        now = self.generation()
        opened = self.keys().withColumn("k", self._unwrapped(keys))
        lost = opened.where("k IS NULL").count()
        if lost:
            return lost
        fresh = opened.select("id", F.lit(new_id).alias("key_id"), _encrypt(F.col("k"), new_key, self._about(F.col("id"), F.lit(new_id))).alias("wrapped"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/draft")
        (source, fs), (target, _) = self._fs(f"{self.path}/draft"), self._fs(f"{self.path}/keys/{now + 1}")
        if not fs.rename(source, target):
            raise OSError("the new keys can't be moved")
        fs.delete(self._fs(f"{self.path}/keys/{now}")[0], True)
        return 0

    def open(self, keys: Mapping[str, Column]) -> DataFrame:
        """(id, payload): null where the keys don't open a record."""
        data_keys = self.keys().select("id", self._unwrapped(keys).alias("k"))
        return self.records().join(data_keys, "id", "left").select("id", _decrypt(F.col("sealed"), F.col("k"), self._about(F.col("id"))).cast("string").alias("payload"))


def _key(n: int) -> Column:
    """A key for queries and tests; real ones come from a secret store."""
    return F.unhex(F.sha2(F.lit(f"key-encryption key {n} for tests"), 256))


@query("snk_12_envelopes", "SELECT doc_id, sha256(text) AS opened, TRUE AS old_key_fails, TRUE AS swapped_fails, TRUE AS records_untouched FROM documents")
def _(t):
    """All texts sealed, the key replaced, and opened again; a sealed payload under another row's id doesn't open."""
    store = EnvelopeStore(t.spark, new_path(t.spark, "envelopes"), "documents")
    store.write(t.documents, "doc_id", "text", _key(1), "one")
    files = lambda: artifact_hashes(t.spark, f"{store.path}/records").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "n_bytes", "sha256")).alias("x")).first()
    before = files()
    store.rotate({"one": _key(1)}, _key(2), "two")
    old = store.open({"one": _key(1), "two": _key(1)}).select("id", F.col("payload").isNull().alias("b"))
    keys = store.keys().select("id", store._unwrapped({"two": _key(2)}).alias("k"))
    swapped = store.records().join(keys, "id").select("id", _decrypt(F.col("sealed"), F.col("k"), store._about(F.col("id") + 1)).isNull().alias("c"))
    told = store.open({"two": _key(2)}).join(old, "id").join(swapped, "id")
    return told.select(F.col("id").alias("doc_id"), F.sha2("payload", 256).alias("opened"), F.col("b").alias("old_key_fails"), F.col("c").alias("swapped_fails"), F.lit(before == files()).alias("records_untouched"))
