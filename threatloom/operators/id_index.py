"""Which ids an event table holds: a table of ids in hash buckets, kept beside the events.

A batch reads the buckets that its ids fall in, whatever days the events have, so its cost
follows the ids' own volume per bucket and never the width or number of the stored days. The
index lies in `_ids` below the table, a name that readers of the table pass over. It has
generations: `rebuild` writes the next one with one set of files per bucket, and a generation
counts once its mark is written, so a build that fails half-way is never read.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed for a table once its index exists. More buckets mean less to read for a small batch, and more files.
BUCKETS = 64
_HELD = "event_id string, generation int, bucket int"


def bucket(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int")


def newest(spark: SparkSession, table: str) -> int | None:
    """The generation to read, or None where the table has no index."""
    try:
        marks = spark.read.schema("generation int").parquet(f"{table}/_ids/complete")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return marks.agg(F.max("generation")).first()[0]


def _write(ids: DataFrame, table: str, generation: int, mode: str) -> None:
    dealt = ids.select("event_id", bucket(F.col("event_id")).alias("bucket")).hint("rebalance", "bucket")
    path = f"{table}/_ids/held/generation={generation}"
    dealt.sortWithinPartitions("bucket", "event_id").write.mode(mode).partitionBy("bucket").parquet(path)


def rebuild(ids: DataFrame, table: str) -> int:
    """Write `ids` (event_id) as the next generation and make it the one to read; also how many small files become few."""
    spark = ids.sparkSession
    generation = (newest(spark, table) or 0) + 1
    _write(ids.distinct(), table, generation, "overwrite")
    spark.range(1).select(F.lit(generation).alias("generation")).write.mode("append").parquet(f"{table}/_ids/complete")
    return generation


def held(spark: SparkSession, table: str, generation: int, ids: DataFrame) -> DataFrame:
    """Those of `ids` (event_id) that the index has; only their buckets are opened."""
    buckets = ids.select(bucket(F.col("event_id")).alias("bucket")).distinct()
    chosen = [row[0] for row in buckets.filter("bucket IS NOT NULL").collect()]  # BUCKETS numbers at most
    try:
        every = spark.read.schema(_HELD).parquet(f"{table}/_ids/held")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER" not in str(missing):
            raise
        every = spark.createDataFrame([], _HELD)
    opened = every.filter((F.col("generation") == generation) & F.col("bucket").isin(chosen))
    return opened.select("event_id").join(ids.select("event_id"), "event_id", "left_semi")


def add(ids: DataFrame, table: str, generation: int) -> None:
    """Enter ids (event_id); entering one again does no harm."""
    _write(ids, table, generation, "append")
