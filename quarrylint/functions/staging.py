"""Cutting lineage and numbering rows without one task per group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else the session's warehouse folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return configured.rstrip("/")


def work_partitions(spark: SparkSession) -> int:
    """Number of partitions for rows that are small but stand for much work, such as file names.

    Given as a number, because adaptive execution would merge such partitions by their bytes.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, 2 * spark.sparkContext.defaultParallelism)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result has no lineage into ``df``: a lost executor re-reads files, and later readers
    get column and nested-field pruning.
    """
    spark = df.sparkSession
    target = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of staged tables, on whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(
    df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "seq", folder: str | None = None
) -> DataFrame:
    """Exact ``row_number()`` of ``order`` inside each ``within`` group, for groups of any size.

    A plain window would put a whole group into one task. Here the rows are range-partitioned
    and sorted by (within, order) and written with their place in their partition, which is
    fixed from then on. What is left is to add the number of rows of the group in the partitions
    before: one small row per group and partition. ``order`` has to be total within a group.
    """
    keys = list(within)
    ranged = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ranged = stage(ranged, "numbered", folder).withColumn("_slot", F.shiftright("_place", 33))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_slot")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(*keys, "_slot", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranged.join(offsets, [*keys, "_slot"])
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .drop("_slot", "_place", "_first", "_before")
    )


def running_total(
    df: DataFrame, within: Sequence[str], order: Sequence[str], weight: str, name: str, folder: str | None = None
) -> DataFrame:
    """Exact sum of ``weight`` over the rows of a group before each row, for groups of any size.

    As ``numbered``: partitions are sorted ranges, a group's total in each of them is one small row. What
    is summed up in one piece is a group's part of one partition.
    """
    keys = list(within)
    ranged = (
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ranged = stage(ranged, "summed", folder).withColumn("_slot", F.shiftright("_place", 33))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_slot").agg(F.sum(weight).alias("_sum")).select(
        *keys, "_slot", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(offsets, [*keys, "_slot"])
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_slot", "_place", "_inside", "_before")
    )


def cut_by_weight(
    df: DataFrame, weight: Column, order: Sequence[str], least: int = 1 << 20, folder: str | None = None
) -> DataFrame:
    """``df`` in partitions of about equal weight, none above the limit and the weight of one row.

    The limit is ``spark.sql.files.maxPartitionBytes``, or less if there are fewer such shares than
    cores. Rows are range-partitioned by ``order`` and sorted, so a running sum needs one small sum per
    partition; its value says which partition a row goes to.
    """
    spark = df.sparkSession
    ranged = (
        df.withColumn("_weight", weight).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    ranged = stage(ranged, "weighed", folder).withColumn("_slot", F.shiftright("_place", 33))
    sums = sorted(map(tuple, ranged.groupBy("_slot").agg(F.sum("_weight")).collect()))
    total = sum(n for _, n in sums)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    limit = max(1, min(most, max(least, -(-total // work_partitions(spark)))))
    before, rows = 0, []
    for slot, n in sums:
        rows.append((slot, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(rows, "_slot bigint, _before bigint"))
    ahead = F.sum("_weight").over(Window.partitionBy("_slot").orderBy("_place")) - F.col("_weight")
    share = F.floor((F.col("_before") + ahead) / limit).cast("int")
    placed = ranged.join(offsets, "_slot").withColumn("_share", share)
    return placed.repartitionById(max(1, -(-total // limit)), F.col("_share")).select(*df.columns)


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, hot: int = 1000
) -> DataFrame:
    """Inner join of ``rows`` to one-row-per-key ``groups`` that survives hot keys.

    The ``hot`` largest groups (a fixed number of rows, so safe to broadcast) are matched map
    side. Any other group is smaller than every one of those, hence below 1/hot of all rows,
    and takes the ordinary shuffle join.
    """
    keys = list(keys)
    largest = groups.orderBy(F.desc(size), *keys).limit(hot)
    hot_keys = F.broadcast(largest.select(*keys))
    return rows.join(F.broadcast(largest), keys).unionByName(
        rows.join(hot_keys, keys, "left_anti").join(
            groups.join(hot_keys, keys, "left_anti"), keys
        )
    )


def semi_join_spread(rows: DataFrame, keys: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``; one key's rows go to ``salts`` partitions by a hash of ``by``."""
    salted = keys.select(key).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
        .join(salted, [key, "_salt"], "left_semi")
        .drop("_salt")
    )
