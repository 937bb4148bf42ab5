"""A state of items that a batch changes where it touches it.

Items lie in buckets by id; beside them lie the hashes of their keys in buckets by hash, each with the
id, and a bitmap for each bucket of keys. A batch writes what it changes as further files of the buckets,
and a log entry makes them count; the newest row of an id is the item. Keys only lead to items: what
they find is compared again, so a key that an item no longer has does no harm. Buckets of many files
are written anew as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import bitmaps, identity, state
from inkwell.sources.shared import stored

LOG = "version long, batch long, kind string, bucket int, folder string, base boolean, top long"
SCHEMAS = {
    "items": T.StructType([*state.ITEMS.fields, T.StructField("_version", T.LongType())]),
    "keys": T.StructType([T.StructField(n, T.LongType()) for n in ("key", "id", "_version")]),
    "maps": T.StructType([T.StructField(n, T.LongType()) for n in ("word", "bits", "_version")]),
}
#: Buckets of items and of keys; bits of a bucket's bitmap; files of a bucket before it is written anew.
BUCKETS, MAP_BITS, FILES = 64, 18, 8


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        if not self._exists(f"{root}/log"):
            self._commit([(0, None, None, None, None, False, 0)])

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _commit(self, entries: list[tuple]) -> None:
        """One file of the log: all of its entries count, or none."""
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").json(f"{self.root}/log")

    def log(self) -> list:
        """The entries that count, a few for each bucket: a bucket that was written anew begins with that."""
        rows = self.spark.read.schema(LOG).json(f"{self.root}/log")
        start = F.max(F.when(F.col("base"), F.col("version"))).over(Window.partitionBy("kind", "bucket"))
        return rows.withColumn("_start", start).where(F.col("kind").isNull() | F.col("_start").isNull() | (F.col("version") >= F.col("_start"))).collect()

    def _read(self, log: list, kind: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a kind in some buckets, or in all, with the bucket."""
        asked = None if buckets is None else set(buckets)
        paths = sorted({f"{e['folder']}/bucket={e['bucket']}" for e in log if e["kind"] == kind and (asked is None or e["bucket"] in asked)})
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[kind]).withColumn("bucket", F.lit(0))
        rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*paths)
        return rows.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int"))

    def _write(self, rows: DataFrame, kind: str, version: int, batch: int | None, base: bool, top: int) -> list[tuple]:
        """Writes rows (with bucket) as files of their own, and gives the entries that make them count."""
        folder = f"{self.root}/{kind}/{version:012d}-{uuid.uuid4().hex}"
        out = rows if "_version" in rows.columns else rows.withColumn("_version", F.lit(version).cast("long"))
        out.select(*SCHEMAS[kind].names, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(folder)
        if not self._exists(f"{folder}/_SUCCESS"):
            raise RuntimeError(f"{folder} is not whole")
        found = self.spark.read.schema("bucket int").parquet(folder).select("bucket").distinct().collect()
        return [(version, batch, kind, r["bucket"], folder, base, top) for r in found]

    def _bucket(self, c) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _keyed(self, rows: DataFrame, carried: str) -> DataFrame:
        """key, bucket and the carried column, for each key of rows that applies."""
        keys = F.array(*(identity.key_hash(kind, names) for kind, names in identity.KEYS))
        return rows.select(carried, F.explode(F.array_compact(keys)).alias("key")).withColumn("bucket", self._bucket("key"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_version")))
        return rows.withColumn("_n", n).where("_n = 1").drop("_n")

    def items(self) -> DataFrame:
        """All items as they are."""
        return self._newest(self._read(self.log(), "items")).select(*state.ITEMS.names)

    def found(self, incoming: DataFrame, log: list) -> DataFrame:
        """The stored items that share a key with incoming, and few others.

        Only keys that the bitmaps of their buckets let pass are looked up, in their buckets only, and
        only the buckets of what they find are read.
        """
        asked = stored(self._keyed(incoming, "seq").select("key", "bucket").distinct())
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        maps = self._read(log, "maps", touched).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        probe = asked.withColumn("word", bitmaps.word_of(F.xxhash64("key"), MAP_BITS)).join(maps, ["bucket", "word"])
        known = stored(probe.where(F.col("bits").bitwiseAND(bitmaps.bit_of(F.xxhash64("key"), MAP_BITS)) != 0).select("key", "bucket"))
        ids = self._read(log, "keys", [r["bucket"] for r in known.select("bucket").distinct().collect()]).join(known.select("key"), "key", "left_semi")
        ids = stored(ids.select("id").distinct().withColumn("bucket", self._bucket("id")))
        rows = self._read(log, "items", [r["bucket"] for r in ids.select("bucket").distinct().collect()]).join(ids.select("id"), "id", "left_semi")
        return self._newest(rows).select(*state.ITEMS.names)

    def merge(self, incoming: DataFrame, batch: int, now: str) -> bool:
        """Merges a batch (item columns and seq), once: a number that the log has is not merged again.

        Of rows of the batch that share an id and column, or a content hash, only the first by seq
        counts; of those that share an address the last. Nothing is asked of other batches' numbers.
        """
        log = self.log()
        if any(e["batch"] == batch for e in log):
            return False
        version, top = max(e["version"] for e in log) + 1, max(e["top"] for e in log)
        for names in (["item_key", "column_name"], ["content_hash"]):
            incoming = identity.mark_repeats(incoming, names).where("not duplicate").drop("duplicate")
        incoming = stored(incoming)
        known = stored(self.found(incoming, log))
        changes = stored(identity.resolve(incoming, known).drop("match_kind"))
        met = known.join(changes.select(F.col("existing_id").alias("id")), "id", "left_semi")
        changed = stored(state.upsert(met, changes, now, top).withColumn("bucket", self._bucket("id")))
        last = changed.agg(F.max("id")).first()[0]
        keys = stored(self._keyed(changed, "id"))
        maps = bitmaps.bitmap(keys.withColumn("h", F.xxhash64("key")), "h", MAP_BITS, ("bucket",))
        top = max(top, last or 0)
        entries = [(version, batch, None, None, None, False, top)]
        for kind, rows in (("items", changed), ("keys", keys), ("maps", maps)):
            entries += self._write(rows, kind, version, batch, False, top)
        self._commit(entries)
        return True

    def compact(self, files: int = FILES) -> int:
        """Writes buckets of more than `files` files anew, with the newest row of each item; gives how many there were."""
        log, count, entries = self.log(), 0, []
        version, top = max(e["version"] for e in log) + 1, max(e["top"] for e in log)
        for kind in SCHEMAS:
            buckets = [e["bucket"] for e in log if e["kind"] == kind]
            full = sorted({b for b in buckets if buckets.count(b) > files})
            if not full:
                continue
            rows = self._read(log, kind, full)
            if kind == "items":
                rows = self._newest(rows)
            elif kind == "keys":
                rows = rows.groupBy("bucket", "key", "id").agg(F.max("_version").alias("_version"))
            else:
                rows = rows.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
            entries += self._write(rows, kind, version, None, True, top)
            count += len(full)
        if entries:
            self._commit(entries)
        return count


def ingest(spark: SparkSession, source: str, schema, root: str, now: str, checkpoint: str, buckets: int = BUCKETS):
    """Reads what is new under source, and merges it batch by batch into the store at root.

    Duplicates are told by the stored items, not by operator state, so nothing expires. A batch that
    is run again after a failure is merged again, or left out if it was merged.
    """

    def each(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root, buckets)
        store.merge(batch, number, now)
        store.compact()

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


