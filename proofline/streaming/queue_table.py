"""The processing queue as a table of key buckets, kept up to date by a stream.

The table is copy-on-write: rows lie in ``data/v=<batch>/bucket=<n>``, and a small manifest ``manifest/v=<batch>`` names
the version of every bucket after that batch. A micro-batch reads and rewrites only the buckets whose keys it holds, so
what it writes follows the batch and not the table. A repeated batch starts from the manifest before it and replaces its
own folders, so a restart changes nothing. Versions that none of the newest manifests names are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import queue
from ..sources import derive

SCHEMA = "image_id bigint, status string, ts timestamp, event_id bigint, value double"
MANIFEST = "bucket int, version bigint"
BUCKETS = 64
KEEP = 2


class _Folder:
    """Folders of the table through Hadoop's file system, so any shared storage will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self, name: str) -> list[int]:
        path = self._path(name)
        found = [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []
        return sorted(int(n[2:]) for n in found if n.startswith("v="))

    def finished(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{name}/_SUCCESS"))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _manifest(spark: SparkSession, root: str, below: int | None = None) -> dict[int, int]:
    """Bucket to version, from the newest finished manifest (before batch ``below``); at most one row a bucket."""
    folder = _Folder(spark, root)
    done = [v for v in folder.versions("manifest") if (below is None or v < below) and folder.finished(f"manifest/v={v}")]
    if not done:
        return {}
    return {r.bucket: r.version for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={done[-1]}").collect()}


def _rows(spark: SparkSession, root: str, places: dict[int, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{root}/data/v={v}/bucket={b}" for b, v in sorted(places.items())])


def current(spark: SparkSession, root: str) -> DataFrame:
    """The queue after the last finished micro-batch; empty before the first one."""
    return _rows(spark, root, _manifest(spark, root))


def merge(changes: DataFrame, root: str, version: int, buckets: int = BUCKETS, keep: int = KEEP) -> None:
    """Writes version ``version``: the newest row of every key, in the buckets that ``changes`` touches."""
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    before = _manifest(spark, root, version)
    newest = queue.latest(changes.select(*[c.split()[0] for c in SCHEMA.split(", ")])).withColumn("bucket", bucket)
    work = f"{root}/changes/v={version}"
    newest.write.mode("overwrite").parquet(work)  # used twice: for its buckets and its rows
    newest = spark.read.schema(SCHEMA + ", bucket int").parquet(work)
    touched = sorted(r.bucket for r in newest.select("bucket").distinct().collect())
    old = _rows(spark, root, {b: v for b, v in before.items() if b in touched})
    merged = queue.latest(old.unionByName(newest.drop("bucket"))).withColumn("bucket", bucket)
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={version}")
    after = before | {b: version for b in touched}
    spark.createDataFrame(sorted(after.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version}")
    _expire(spark, root, keep)


def _expire(spark: SparkSession, root: str, keep: int) -> None:
    """Removes what none of the ``keep`` newest manifests names (at least two: a batch may be repeated)."""
    folder = _Folder(spark, root)
    manifests = folder.versions("manifest")
    kept = manifests[-max(2, keep):]
    needed = [spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={v}") for v in kept]
    named = {(r.version, r.bucket) for m in needed for r in m.collect()}
    for v in folder.versions("data"):
        parts = [s.getPath().getName() for s in folder.fs.listStatus(folder._path(f"data/v={v}"))]
        mine = [p for p in parts if p.startswith("bucket=")]
        gone = [p for p in mine if (v, int(p[7:])) not in named]
        if v < kept[-1] and len(gone) == len(mine):
            folder.remove(f"data/v={v}")
        elif v < kept[-1]:
            for p in gone:
                folder.remove(f"data/v={v}/{p}")
    for v in manifests[:-len(kept)]:
        folder.remove(f"manifest/v={v}")
    for v in folder.versions("changes"):
        folder.remove(f"changes/v={v}")


def queue_upserts(events: DataFrame, root: str, buckets: int = BUCKETS, keep: int = KEEP, repeats_within: str | None = None) -> StreamingQuery:
    """Keeps the latest status per image of a stream of events; :func:`current` reads the table.

    Repeated and late events change nothing or lose against newer ones. ``repeats_within`` takes out repeats of an event id
    before the merge, in keyed state that is given up after that time; Spark then also drops events older than the
    watermark, so it is off unless asked for. ``buckets`` must stay the same for one table.
    """
    if repeats_within:
        events = events.withWatermark("ts", repeats_within).dropDuplicatesWithinWatermark(["event_id"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge(derive.queue_event_columns(batch), root, batch_id, buckets, keep)

    return (events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())
