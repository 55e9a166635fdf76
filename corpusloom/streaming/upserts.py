"""A table of last writes that a stream fills, and that a repeated batch doesn't change."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import new_path
from corpusloom.registry import query
from corpusloom.streaming.ordered import arrivals, run_through


class LastWrites:
    """The last write of each key, by ``order``, in buckets of keys, with a ledger of the batches that made it.

    A batch rewrites the buckets that it touches into a folder of its own, and counts once
    its entry is in the ledger, which appears whole or not at all. A batch whose entry is
    there does nothing; one that was cut off before it writes its folder anew. So a
    restart from a checkpoint, which repeats a batch, leaves the table as it is. An entry
    names the folder of every bucket, so the newest one is the table; readers of an older
    one keep their files until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, values: Sequence[str], schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.values, self.schema, self.buckets = spark, path, key, order, list(values), schema, buckets

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        place, fs = self._fs(f"{self.path}/ledger")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _entry(self, batch: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/ledger/{batch:020d}.json", wholetext=True).first()
        return json.loads(rows.value)

    def table(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table of the newest entry, or some of its buckets."""
        entries = self._entries()
        held = self._entry(entries[-1]) if entries else {}
        places = [f"{self.path}/{place}" for b, place in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Take a batch's rows in; whether they were new."""
        if batch in self._entries():
            return False
        last = F.max_by(F.struct(self.order, *self.values), F.struct(self.order, *self.values)).alias("w")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        new = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(last).select(self.key, "w.*")
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]  # at most self.buckets numbers
        whole = new.unionByName(self.table(touched).select(self.key, self.order, *self.values)).groupBy(self.key).agg(last).select(self.key, "w.*")
        whole.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        entries = self._entries()
        held = self._entry(entries[-1]) if entries else {}
        self.commit(batch, held | {str(b): f"data/{batch}/bucket={b}" for b in touched})
        return True

    def commit(self, batch: int, held: dict[str, str]) -> None:
        """Write the batch's entry beside its place and move it there."""
        draft, fs = self._fs(f"{self.path}/ledger/{batch:020d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/ledger/{batch:020d}.json")[0]):
            raise FileExistsError(f"batch {batch} is in the ledger already")

    def vacuum(self) -> int:
        """Delete folders of batches that the newest entry doesn't name; how many."""
        entries = self._entries()
        used = {place.split("/")[1] for place in self._entry(entries[-1]).values()} if entries else set()
        gone = [b for b in entries if str(b) not in used]
        removed = [fs.delete(place, True) for place, fs in (self._fs(f"{self.path}/data/{b}") for b in gone) if fs.exists(place)]
        return sum(removed)


@query("stm_11_stream_upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t):
    """Events as a stream of four parts, out of order, and its first part once more under its batch's number."""
    base, schema = new_path(t.spark, "upserts"), "user_id long, event_id long, event_type string"
    sink = LastWrites(t.spark, f"{base}/table", "user_id", "event_id", ["event_type"], schema)
    arrivals(t.events.select("user_id", "event_id", "event_type"), [f"event_id % 4 = {i}" for i in (2, 0, 3, 1)], f"{base}/in")
    run_through(t.spark, f"{base}/in", schema, lambda s: s, base, sink.merge)
    sink.merge(t.events.select("user_id", "event_id", "event_type").where("event_id % 4 = 2"), 0)
    return sink.table()
