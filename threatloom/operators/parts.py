"""A batch laid out in files, in parts that each hold all rows of some of its event ids.

Steps that shuffle whole events take one part after the other, so what lies on disk for their
shuffles follows a part and not the batch. Rows that several steps read lie in compressed files,
a fraction of what Spark's cache takes for them; steps that need few columns read only these.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.scalars import floor_div
from threatloom.operators.id_index import BUCKETS, bucket

PART = "part_of_batch"


def part_of(event_id: Column, parts: int) -> Column:
    """The part an id falls in; `parts` is a power of two up to `BUCKETS`, so a part is a range of the id index's buckets."""
    return floor_div(bucket(event_id), BUCKETS // parts).cast("int")


def lay_out(rows: DataFrame, path: str, event_id: Column, parts: int) -> DataFrame:
    """Write rows to `path`, replacing what is there, and read them back with the column `PART`."""
    untyped = [field.name for field in rows.schema if field.dataType == T.NullType()]
    rows = rows.withColumns({name: F.col(name).cast("string") for name in untyped})
    dealt = rows.withColumn(PART, part_of(event_id, parts))
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(PART).parquet(path)
    return read_back(rows, path)


def lay_out_parts(made: list[DataFrame], path: str) -> DataFrame:
    """The same for rows that are made part by part, each from what it needs alone."""
    for k, rows in enumerate(made):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{PART}={k}")
    return read_back(made[0], path)


def read_back(like: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField(PART, T.IntegerType())])
    return like.sparkSession.read.schema(schema).parquet(path)


def split(laid_out: DataFrame, parts: int) -> list[DataFrame]:
    return [laid_out.filter(F.col(PART) == k).drop(PART) for k in range(parts)]
