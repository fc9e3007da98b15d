"""Result cache in a bucketed table: looking up and adding never shuffles the history.

The table is hash-bucketed by ``cache_key``. A lookup brings the distinct keys of the requests to the buckets, where they
meet the history in place; the answers, at most one per distinct key, then join the requests under adaptive execution, so
a key that a third of all requests share is split. New results are appended to the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "cache_key"


def open_cache(spark: SparkSession, name: str, path: str, columns: str, buckets: int = 256) -> None:
    """Creates or names again the cache at ``path``, a folder all executors share; ``columns`` declares the results.

    The number of buckets is fixed when the cache is made; take the number of cores or of shuffle partitions.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({KEY} STRING, {columns}) USING parquet "
              f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")


def answers(keys: DataFrame, name: str) -> DataFrame:
    """The cache's rows for the keys, each once; the history is read where it lies."""
    return keys.select(KEY).filter(F.col(KEY).isNotNull()).distinct().join(keys.sparkSession.table(name), KEY)


def lookup(requests: DataFrame, name: str) -> DataFrame:
    """Requests with the cached results and ``cached``; results are null where there are none.

    A request without key is not cached; repeated requests each have their answer. A result column replaces a column of
    that name in the requests.
    """
    found = answers(requests, name)
    plain = requests.drop(*[c for c in found.columns if c != KEY], "cached")
    return plain.join(found.withColumn("cached", F.lit(True)), KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def add_results(results: DataFrame, name: str, order: str) -> None:
    """Appends results whose key the cache has not yet; of several for a key, the one with the least ``order``.

    The first result of a key stays: a batch that is added again changes nothing. One writer at a time.
    """
    spark = results.sparkSession
    table = spark.table(name)
    rest = [c for c in table.columns if c != KEY]
    first = results.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(KEY, "_r.*")
    new = first.join(answers(first, name).select(KEY), KEY, "left_anti")
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()["data_type"])
    # the same hash as the buckets': one file a bucket
    new.repartition(buckets, KEY).select(*table.columns).write.insertInto(name)
