"""Exact percentiles of columns with very many different values, without a map of all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletop.session import working_folder

ACCURACY = 10_000
RANGES = 200


def _bracketed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of ``bounds`` (``_group``, ``_fraction``, ``_low``, ``_high``) with the values inside counted one by one (``_value``, ``_n``)
    and those below counted together under a null value. Either bound may be null, which leaves that side open."""
    lists = bounds.groupBy("_group").agg(F.collect_list(F.struct("_fraction", "_low", "_high")).alias("_bounds"))
    x = F.col("_x")
    kept = F.filter("_bounds", lambda b: b["_high"].isNull() | (x <= b["_high"]))
    parts = F.transform(kept, lambda b: F.struct(
        b["_fraction"].alias("_fraction"), F.when(b["_low"].isNull() | (x >= b["_low"]), x).alias("_value")))
    found = rows.join(lists, rows["_group"] == lists["_group"]).select(lists["_group"], F.inline(parts))
    return found.groupBy("_group", "_fraction", "_value").agg(F.count("*").alias("_n"))


def exact_percentiles(df: DataFrame, groups: list[str], column: str, fractions: list[float],
                      accuracy: int = ACCURACY, ranges: int = RANGES) -> DataFrame:
    """``groups``, ``fraction``, ``rows`` and ``percentile``: of every group and fraction the exact, interpolated percentile of ``column``.

    A sketch per group, merged from bounded ones of the tasks, brackets each percentile. A second pass counts what lies below a bracket
    and the values within it, equal ones together, so a value that fills a third of the table is one row. These are dealt to sorted
    ranges; the sums of ranges tell which of them holds the rank, and only that one is gone through in order. The counts also prove that a
    bracket holds its rank; one that does not is opened to both sides and counted again, so results do not depend on the sketch.

    Nulls and NaN take no part and groups without a value are left out; a null in ``groups`` is a group of its own.
    """
    if not fractions or any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("fractions must lie between 0 and 1")
    spark, fractions = df.sparkSession, sorted({float(f) for f in fractions})
    x = F.col(column)
    usable = x.isNotNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        usable = usable & ~F.isnan(x)
    rows = df.where(usable).select(F.struct(*[F.col(name) for name in groups], F.lit(0).alias("_all")).alias("_group"), x.alias("_x"))
    margin = 4 / accuracy
    ends = sorted({min(max(end, 0.0), 1.0) for f in fractions for end in (f - margin, f + margin)})
    sketch = rows.groupBy("_group").agg(
        F.count("*").alias("_rows"), F.percentile_approx("_x", ends, accuracy).alias("_ends"))
    end = lambda f: F.element_at("_ends", ends.index(min(max(f, 0.0), 1.0)) + 1)

    def bound(f: float) -> Column:
        low = F.lit(None) if f - margin <= 0 else end(f - margin)
        high = F.lit(None) if f + margin >= 1 else end(f + margin)
        return F.struct(F.lit(f).alias("_fraction"), low.alias("_low"), high.alias("_high"))

    path = working_folder(spark, "brackets")
    listed = sketch.select("_group", "_rows", F.inline(F.array(*[bound(f) for f in fractions])))
    place = F.col("_fraction") * (F.col("_rows") - 1)
    kind = rows.schema["_x"].dataType
    listed.withColumns({
        "_low": F.col("_low").cast(kind), "_high": F.col("_high").cast(kind),
        "_lower": F.floor(place), "_upper": F.ceil(place), "_part": place - F.floor(place),
    }).write.parquet(path)
    bounds = spark.read.parquet(path)

    values = _stored(_bracketed(rows, bounds), "values")
    sums = values.groupBy("_group", "_fraction").agg(
        F.sum(F.when(F.col("_value").isNull(), F.col("_n")).otherwise(0)).alias("_below"), F.sum("_n").alias("_up_to"))
    held = (F.col("_below") <= F.col("_lower")) & (F.col("_upper") < F.col("_up_to"))
    missed = _stored(bounds.join(sums, ["_group", "_fraction"], "left").where(~F.coalesce(held, F.lit(False))).select(
        "_group", "_fraction", F.lit(None).cast(kind).alias("_low"), F.lit(None).cast(kind).alias("_high")), "missed")
    if not missed.isEmpty():
        again = _bracketed(rows, missed)
        values = values.join(missed.select("_group", "_fraction"), ["_group", "_fraction"], "left_anti").unionByName(again)

    dealt = values.repartitionByRange(ranges, "_group", "_fraction", F.col("_value").asc_nulls_first())
    dealt = _stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_group", "_fraction", "_range").agg(F.sum("_n").alias("_size"))
    # At most as many rows of a group and fraction as there are ranges.
    in_order = Window.partitionBy("_group", "_fraction").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumn("_start", F.sum("_size").over(in_order) - F.col("_size"))
    whole = whole.join(bounds.drop("_low", "_high"), ["_group", "_fraction"]).where(
        (F.col("_start") <= F.col("_upper")) & (F.col("_lower") < F.col("_start") + F.col("_size")))
    up_to = Window.partitionBy("_group", "_fraction", "_range").orderBy(F.col("_value").asc_nulls_first())
    up_to = up_to.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(whole, ["_group", "_fraction", "_range"]).withColumn("_after", F.col("_start") + F.sum("_n").over(up_to))
    at = lambda rank: F.max(F.when(
        (F.col("_after") - F.col("_n") <= F.col(rank)) & (F.col(rank) < F.col("_after")), F.col("_value"))).cast("double")
    picked = placed.groupBy("_group", "_fraction").agg(
        F.first("_rows").alias("rows"), F.first("_part").alias("_part"), at("_lower").alias("_from"), at("_upper").alias("_to"))
    between = F.when(F.col("_from") == F.col("_to"), F.col("_from")).otherwise(
        F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("_part"))
    names = [F.col("_group")[name].alias(name) for name in groups]
    return picked.select(*names, F.col("_fraction").alias("fraction"), "rows", between.alias("percentile"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = working_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
