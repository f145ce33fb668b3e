"""Ranks and running totals over all rows of a table in one order, and samples of an exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletop.session import working_folder

RANGES = 200


def with_global_ranks(df: DataFrame, order: str, total: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` of every row in the order of one column, and with
    ``running_total``, the sum of ``total`` over all rows up to and including equal ones.

    Rows are summed up by value first, so equal ones need no order among them and one value that fills a third of the table is one row.
    The different values are dealt to sorted ranges; sums of whole ranges, a bounded number of rows, give what stands before
    each range, and inside of a range a window adds up. No window runs over the whole table. Nulls come last and are equal. Columns of these names are replaced.
    """
    spark = df.sparkSession
    added = ["rank", "dense_rank", "percent_rank", "cume_dist", *(["running_total"] if total else [])]
    value = F.sum(F.col(total)) if total else F.lit(None).cast("double")
    values = df.groupBy(F.col(order).alias("_key")).agg(F.count("*").alias("_n"), value.alias("_sum"))
    path = working_folder(spark, "ranges")
    dealt = values.repartitionByRange(ranges, F.col("_key").asc_nulls_last())
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    values = spark.read.parquet(path)
    whole = values.groupBy("_range").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_keys"), F.sum("_sum").alias("_total"))
    # At most as many rows as there are ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    nothing = lambda column: F.coalesce(column, F.lit(0))
    whole = whole.select("_range", *[
        nothing(F.sum(name).over(before)).alias(f"{name}_before") for name in ("_rows", "_keys", "_total")],
        F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    up_to = Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(whole, "_range").select(
        "_key", "_all", (F.col("_rows_before") + F.sum("_n").over(up_to)).alias("_last"), "_n",
        (F.col("_keys_before") + F.count("*").over(up_to)).alias("dense_rank"),
        (F.col("_total_before") + nothing(F.sum("_sum").over(up_to))).alias("running_total"))
    first = F.col("_last") - F.col("_n") + 1
    placed = placed.select(
        "_key", first.alias("rank"), "dense_rank",
        F.when(F.col("_all") > 1, (first - 1) / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        (F.col("_last") / F.col("_all")).alias("cume_dist"), "running_total")
    rows = df.drop(*added)
    return rows.join(placed, rows[order].eqNullSafe(placed["_key"])).select(*[f"`{name}`" for name in rows.columns], *added)


def group_sample(df: DataFrame, groups: list[str], n: int, key: str) -> DataFrame:
    """``n`` rows of every group (all, if it has fewer), the same ones in every run: those whose ``key`` has the smallest md5 digest.

    Each task keeps its ``n`` best rows of a group before they are shuffled, so a hot group moves no more than that. Rows with equal
    keys are taken in the order of the key's text; a null key counts as the empty text.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    order = Window.partitionBy(*groups).orderBy(F.md5(text.cast("binary")), text)
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")
