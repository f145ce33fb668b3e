"""Joins that SQL text users of other engines write and Spark has no syntax or no equi key for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletop.functions.time import grain_number

# Grains of one width that an interval may touch before wider ones are taken.
_SPREAD = 64


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    grain: str | int = "day",
) -> DataFrame:
    """Every left row with ``values`` of the latest right row of the same key that is not later; nulls if there is none.

    Both sides are cut by key and ``grain`` (minute, hour, day, week or a width in seconds), so a key that fills a third
    of the data is spread over as many tasks as there are days (or hours) in it. Within a cut the right row is found by
    an ordered window; what comes from an earlier cut is carried over from a summary with one row per key and cut. Of
    right rows with equal time the one with the largest ``values`` counts. ``on`` names one key column or several; none of
    ``values`` may be named like a left column.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clashing = {v.lower() for v in values} & {c.lower() for c in left.columns}
    if clashing:
        raise ValueError(f"both sides have columns named {', '.join(sorted(clashing))}; rename those of the right side")
    key = F.struct(*[F.col(f"`{name}`") for name in keys]) if len(keys) > 1 else F.col(f"`{keys[0]}`")

    def usable(time: str):
        found = F.col(f"`{time}`").isNotNull()
        for name in keys:
            found &= F.col(f"`{name}`").isNotNull()
        return found

    payload = F.struct(*[F.col(f"`{v}`") for v in values])
    rights = right.where(usable(right_time)).select(
        key.alias("_key"),
        grain_number(F.col(right_time), right.schema[right_time].dataType, grain).alias("_cut"),
        F.col(right_time).alias("_time"),
        payload.alias("_value"),
    )
    # A null key or time matches nothing; such rows go past the shuffle, where they would all meet in one task.
    can_match = usable(left_time)
    lefts = left.where(can_match).select(
        key.alias("_key"),
        grain_number(F.col(left_time), left.schema[left_time].dataType, grain).alias("_cut"),
        F.col(left_time).alias("_time"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"),
    )
    no_time = F.lit(None).cast(rights.schema["_time"].dataType)
    no_value = F.lit(None).cast(rights.schema["_value"].dataType)
    no_row = F.lit(None).cast(lefts.schema["_row"].dataType)

    # For every key and cut with left rows, what the latest earlier cut with right rows ended with.
    ends = rights.groupBy("_key", "_cut").agg(F.max(F.struct("_time", "_value")).getField("_value").alias("_value"))
    wanted = lefts.select("_key", "_cut").distinct()
    by_cut = wanted.select("_key", "_cut", no_value.alias("_value"), F.lit(0).alias("_side")).unionByName(
        ends.withColumn("_side", F.lit(1))
    )
    earlier = Window.partitionBy("_key").orderBy("_cut", "_side").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_cut.withColumn("_value", F.last("_value", ignorenulls=True).over(earlier)).where(
        (F.col("_side") == 0) & F.col("_value").isNotNull()
    )

    together = (
        carried.select("_key", "_cut", no_time.alias("_time"), F.lit(0).alias("_side"), "_value", no_row.alias("_row"))
        .unionByName(rights.select("*", F.lit(1).alias("_side"), no_row.alias("_row")))
        .unionByName(lefts.select("*", F.lit(2).alias("_side"), no_value.alias("_value")))
    )
    within = (
        Window.partitionBy("_key", "_cut")
        .orderBy(F.col("_time").asc_nulls_first(), "_side", "_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = together.withColumn("_value", F.last("_value", ignorenulls=True).over(within)).where("_side = 2")
    matched = filled.select("_row.*", *[F.col(f"_value.`{v}`").alias(v) for v in values])
    nothing = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    return matched.union(left.where(~can_match).select("*", *nothing))


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    start: str,
    end: str,
    grain: str | int = "day",
    how: str = "inner",
) -> DataFrame:
    """Each point with the intervals ``start <= point < end`` that hold it.

    Intervals are listed under every ``grain`` (minute, hour, day, week or a width in seconds) they touch, which gives
    the join an equality: it is hashed or sorted by grain instead of comparing every point with every interval. Choose
    the grain near the usual length of an interval. An interval that would touch more than 64 grains is listed under
    grains 64 times as wide, or wider still, so that none is listed more than 65 times however long it is; there is one
    join for each width that occurs.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")

    def grain_of(df: DataFrame, name: str):
        return grain_number(F.col(name), df.schema[name].dataType, grain)

    clashing = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if clashing:
        raise ValueError(f"both sides have columns named {', '.join(sorted(clashing))}; rename those of one side")
    first, last = grain_of(intervals, start), grain_of(intervals, end)
    level = F.lit(0)
    for step in range(1, 11):
        level = F.when(last - first >= _SPREAD**step, step).otherwise(level)
    levelled = intervals.where(F.col(start) < F.col(end)).withColumns({"_first": first, "_last": last, "_level": level})
    levels = sorted(row[0] for row in levelled.select("_level").distinct().collect()) or [0]

    found, alone = [], points
    for step in levels:
        width = F.lit(_SPREAD**step)
        touched = F.sequence(F.floor(F.col("_first") / width), F.floor(F.col("_last") / width))
        listed = levelled.where(F.col("_level") == step).withColumn("_grain", F.explode(touched))
        listed = listed.drop("_first", "_last", "_level")

        def match(df: DataFrame, listed: DataFrame = listed):
            return (df["_at"] == listed["_grain"]) & (df[point] >= listed[start]) & (df[point] < listed[end])

        placed = points.withColumn("_at", F.floor(grain_of(points, point) / width))
        found.append(placed.join(listed, match(placed), "inner").drop("_at", "_grain"))
        if how == "left":
            rest = alone.withColumn("_at", F.floor(grain_of(alone, point) / width))
            alone = rest.join(listed, match(rest), "left_anti").drop("_at")
    if how == "left":
        nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in intervals.schema]
        found.append(alone.select("*", *nothing))
    return reduce(DataFrame.union, found)
