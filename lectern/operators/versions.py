"""Newest rows per key, queues in order, pages and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, n: int = 1, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The ``n`` newest rows of each key with their ``rank``; ties go to the higher ``tie``.

    Null times count as oldest. A null key is a key like others. Spark limits the groups before it shuffles.
    """
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def latest(df: DataFrame, key: str, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key."""
    return newest(df, key, 1, time, tie).drop("rank")


def latest_by_aggregate(df: DataFrame, key: str, columns: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key by a combining aggregate: a hot key is one partial row per task."""
    stamp = F.struct(F.col(time).isNotNull(), F.col(time), F.col(tie))
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), stamp).alias("_row")).select(key, "_row.*")


def in_order(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in a total order (a top-k, not a sort)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of a total order."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def pages(rows: Column | str, size: int) -> Column:
    """How many pages so many rows take: one at least."""
    return F.greatest(F.ceil((F.col(rows) if isinstance(rows, str) else rows) / F.lit(size)), F.lit(1)).cast("long")


def clamped_page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number``, or the first or last one where it lies outside of the pages there are."""
    last = df.agg(pages(F.count(F.lit(1)), size).alias("n")).first()["n"]
    return page(df, min(max(number, 1), last), size, *order)


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that the table has, in the order asked for."""
    return [c for c in columns if c in df.columns]


def page_after(df: DataFrame, size: int, time: str, tie: str, last_time: object = None, last_tie: object = None) -> DataFrame:
    """The next page, newest first, after the last row seen: the depth of the page costs nothing."""
    if last_time is not None:
        after = (F.col(time) < F.lit(last_time)) | ((F.col(time) == F.lit(last_time)) & (F.col(tie) < F.lit(last_tie)))
        df = df.where(after)
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()).limit(size)


def numbered(df: DataFrame, *order: Column, out: str = "position", parts: int | None = None) -> DataFrame:
    """Rows with their place (from 0) in a total order, without one task seeing all rows.

    The rows are ranged over partitions; a partition's place is its own row number plus the rows of earlier partitions.
    """
    from lectern.session import cut

    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = cut(ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))  # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_before") + F.col("_local") - F.col("_first")).drop("_part", "_local", "_first", "_before")


def in_batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Rows with ``batch_no``: consecutive runs of ``size`` rows of a total order."""
    return numbered(df, *order).withColumn("batch_no", F.floor(F.col("position") / F.lit(size)).cast("long"))


def running_total(df: DataFrame, value: str, *order: Column, out: str = "running") -> DataFrame:
    """Sum of ``value`` up to and with each row of a total order, without one task seeing all rows."""
    from lectern.session import cut

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id()))
    own = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_own", F.sum(value).over(own)).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_before") + F.col("_own")).drop("_part", "_local", "_own", "_before")
