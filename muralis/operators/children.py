"""Children of parents, stored in a partition per parent, so that those of one parent are replaced without touching the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

#: False in the one row that stands for a parent without children.
MARK = "is_child"


def replace_children(incoming: DataFrame, parents: DataFrame, path: str, parent: str) -> None:
    """Store ``incoming`` at ``path`` as all the children that ``parents`` (column ``parent``) have from now on.

    Partitions of other parents keep their files, and a parent of ``parents`` without incoming rows has no children afterwards. Spark
    stages the new files and moves them when all tasks are done, so a job that fails before changes nothing; lost executors only
    repeat tasks. Repeated parents count once; rows of parents that are null or not among ``parents`` are left out. Partitions are
    written by as many tasks as their size asks for, so one parent may hold most of the rows. Parents must not be blank strings.
    """
    named = parents.select(parent).filter(F.col(parent).isNotNull()).distinct()
    rows = named.join(incoming.withColumn(MARK, F.lit(True)), parent, "left").withColumn(MARK, F.coalesce(MARK, F.lit(False)))
    rows = rows.select(*(c for c in rows.columns if c != parent), parent).hint("rebalance", parent)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def stored_children(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The children at ``path``, with the columns of ``schema``."""
    return spark.read.schema(StructType([*schema.fields]).add(MARK, BooleanType())).parquet(path).filter(MARK).select(*schema.names)
