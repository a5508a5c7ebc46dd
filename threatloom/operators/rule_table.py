"""Maintenance of the scoring-rule table.

`write_rules` replaces the whole stored set by a new version. `edit_rules` records single changes beside it, each edit in
a folder of its own, so writers that do not know of each other lose nothing: `load_rules` takes the last edit of each id.
"""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.predicates import OPERATORS
from threatloom.functions.scalars import is_blank, trimmed
from threatloom.schema import SCORING_RULE
from threatloom.sources.tables import SCORING_TYPE, default_rules

_COLUMNS = SCORING_RULE.names
#: An edit's rows: a rule or the id of one that is gone, the version it was made on, its turn, and its own name.
_EDIT = T.StructType(
    [
        *SCORING_RULE.fields,
        T.StructField("gone", T.BooleanType()),
        T.StructField("base", T.IntegerType()),
        T.StructField("turn", T.LongType()),
        T.StructField("edit", T.StringType()),
    ]
)
_VERSION = re.compile(r"/version=(\d+)/")


def violations(*checks: tuple[Column, str, str]) -> Column:
    """Array of (field, message) for the checks that hold, in the order given."""
    found = [F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for bad, f, m in checks]
    return F.array_compact(F.array(*found))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Trim the text fields and add `violations`; a fact key that names nothing is allowed."""
    # Messages that callers match on.
    checks = [(is_blank(F.col(c)), c, "must not be blank") for c in ("title", "fact_key", "operand")]
    unknown = F.col("operator").isNull() | ~F.col("operator").isin(OPERATORS)
    return rules.withColumn("violations", violations(*checks, (unknown, "operator", "invalid operator"))).withColumns(
        {c: trimmed(F.col(c)) for c in ("title", "fact_key", "operand")}
    )


def upsert_rules(table: DataFrame, changes: DataFrame, order: str = "change_order") -> DataFrame:
    """The table after the changes: the newest row per id wins, a blank id gets a new one.

    Ranking keeps one row per id on each map side before the shuffle, so an id edited many
    times is no hot spot.
    """
    # The random id is drawn per row and never compared with another draw.
    named = changes.withColumn("id", F.when(is_blank(F.col("id")), F.uuid()).otherwise(F.col("id")))
    every = table.select(*_COLUMNS, F.lit(None).cast("bigint").alias("_order")).unionByName(
        named.select(*_COLUMNS, F.col(order).cast("bigint").alias("_order"))
    )
    newest = Window.partitionBy("id").orderBy(F.col("_order").desc_nulls_last())
    return every.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").select(*_COLUMNS)


def delete_rules(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti").select(*_COLUMNS)


def seed_rules(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The default rules where no scoring rule exists yet, else the table as it is."""
    if table.filter(F.col("type") == SCORING_TYPE).isEmpty():
        return table.unionByName(default_rules(spark))
    return table


def write_rules(rules: DataFrame, path: str) -> None:
    """Replace the stored rule table; the rows may come from the same folder.

    A rule set is a handful of rows, so they are written as one file in the folder of a new
    version, also when no rule is left, and readers pick the newest version. Edits of earlier
    versions no longer count.
    """
    version = _latest_version(rules.sparkSession, path) + 1
    rules.select(*_COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def edit_rules(path: str, changes: DataFrame | None = None, gone: DataFrame | None = None, order: str = "change_order") -> None:
    """Record changed rules, and ids of deleted ones, beside the stored table.

    Of several changes of an id the newest by `order` counts, and a deletion counts after them; a blank id gets a new
    one. An edit's turn is one above all it can see, so it wins over them. Edits made at the same moment share a turn:
    those of different rules all stand, and of the same rule the one with the greater name stands for every reader.
    An edit is one file in a folder of its own, seen whole or not at all. It holds until `write_rules` replaces the
    version it was made on, which also folds it in where the new rows come from `load_rules`.
    """
    if changes is None and gone is None:
        return
    spark = (gone if changes is None else changes).sparkSession
    rows = spark.createDataFrame([], SCORING_RULE)
    if changes is not None:
        rows = upsert_rules(rows, changes, order)
    rows = rows.withColumn("gone", F.lit(False))
    if gone is not None:
        ids = gone.select("id").filter("id IS NOT NULL").distinct()
        rows = rows.join(ids, "id", "left_anti").unionByName(ids.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    base = _latest_version(spark, path)
    edits = _edits(spark, path)
    turn = 1 + ((edits.agg(F.max("turn")).first()[0] or 0) if edits is not None else 0)
    stamped = rows.select(*_COLUMNS, "gone", F.lit(base).alias("base"), F.lit(turn).cast("long").alias("turn"))
    stamped.coalesce(1).write.parquet(f"{path}/_edits/made/edit={uuid.uuid4().hex}")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest version written by `write_rules`, with the edits made on it."""
    version = _latest_version(spark, path)
    rules = _stored(spark, path).filter(F.col("version") == version).select(*_COLUMNS)
    edits = _edits(spark, path)
    if edits is None:
        return rules
    unedited = [F.lit(None).cast(f.dataType).alias(f.name) for f in _EDIT.fields[len(_COLUMNS) :]]
    every = rules.select(*_COLUMNS, *unedited).unionByName(edits.filter(F.col("base") >= version))
    last = Window.partitionBy("id").orderBy(F.col("turn").desc_nulls_last(), F.col("edit").desc_nulls_last())
    newest = every.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1")
    return newest.filter("gone IS NOT TRUE").select(*_COLUMNS)


def _edits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_EDIT).parquet(f"{path}/_edits/made")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _stored(spark: SparkSession, path: str) -> DataFrame:
    versioned = T.StructType([*SCORING_RULE.fields, T.StructField("version", T.IntegerType())])
    return spark.read.schema(versioned).parquet(path)


def _latest_version(spark: SparkSession, path: str) -> int:
    """The highest version among the stored files' folders; a version without rows has a file too."""
    try:
        files = _stored(spark, path).inputFiles()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0
    return max((int(found[1]) for found in map(_VERSION.search, files) if found), default=0)
