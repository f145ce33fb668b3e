"""Join of intervals with the intervals they overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.time import GRAINS, epoch_seconds

# An interval touches at most one grain more than this on its own level; each level's grains are so many times as wide.
_SPREAD = 4
_LEVELS = 31


def _number(value: Column, data_type: T.DataType) -> Column:
    """A number or a time as a double; later values never have a smaller one."""
    return (value if isinstance(data_type, T.NumericType) else epoch_seconds(value, data_type)).cast("double")


def _grain(number: Column, width: float) -> Column:
    """Number of the grain that holds a number."""
    return F.floor(number / F.lit(float(width))).cast("bigint")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    grain: str | float = "day",
    on: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """All pairs of rows whose intervals ``[start, end)``, of numbers or times, have something in common.

    ``grain`` is the usual length of an interval: minute, hour, day, week or a width in seconds or in units of the number.
    Every interval has a level by its length, so that it touches at most 5 grains there; on wider levels that either side has
    it touches hardly more than one. Both sides are listed under all these grains and joined by level and grain,
    which is one equality join. A pair is reported on the wider of its two levels, in the grain in which the later of
    its intervals begins, and nowhere else: nothing is doubled, nothing has to be made distinct. Two intervals that are both short for
    a level do not meet there: the key also tells whether the left one is. ``on`` names pairs of
    columns that must be equal too. A crowded grain is a hot key that adaptive execution splits.

    Intervals that are empty, turned or lack an end overlap nothing. Equal rows count each. The two sides have no column names in
    common.
    """
    clashing = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clashing:
        raise ValueError(f"both sides have columns named {', '.join(sorted(clashing))}; rename those of one side")
    width = GRAINS[grain] if isinstance(grain, str) else float(grain)
    if not width > 0:
        raise ValueError("grain is more than 0")

    def levelled(df: DataFrame, interval: tuple[str, str], name: str) -> DataFrame:
        # Columns of their own, as each is used many times.
        numbers = {
            f"{name}_{i}": _number(F.col(column), df.schema[column].dataType) for i, column in enumerate(interval)}
        start, end = interval
        rows = df.where(F.col(start) < F.col(end)).withColumns(numbers)
        rows = rows.withColumn(f"{name}_steps", _grain(F.col(f"{name}_1"), width) - _grain(F.col(f"{name}_0"), width))
        steps = F.col(f"{name}_steps")
        level = reduce(lambda found, step: F.when(steps >= _SPREAD**step, step).otherwise(found), range(1, _LEVELS), F.lit(0))
        return rows.withColumn(name, level)

    def levels(df: DataFrame, name: str) -> list[int]:
        return [row[0] for row in df.select(name).distinct().collect()]

    def listed(df: DataFrame, name: str, others: list[int], side: str) -> DataFrame:
        """A row for each level, from the row's own on, that either side has, and each grain the interval touches there.

        On wider levels than its own, a left row meets only right rows of that level: these are listed for both kinds of left rows.
        """
        kind = f"struct<{side}level: int, {side}grain: bigint, {side}short: boolean>"
        def grains(level: int) -> Column:
            size = width * _SPREAD**level
            touched = F.sequence(_grain(F.col(f"{name}_0"), size), _grain(F.col(f"{name}_1"), size))
            short = F.col(name) < level

            def here(is_short: Column) -> Column:
                return F.transform(touched, lambda number: F.struct(
                    F.lit(level).alias(f"{side}level"), number.alias(f"{side}grain"), is_short.alias(f"{side}short")))

            if side == "_l":
                found = here(short)
            else:
                found = F.when(short, here(F.lit(False))).otherwise(F.concat(here(F.lit(False)), here(F.lit(True))))
            return F.when(F.col(name) <= level, found).otherwise(F.array().cast(f"array<{kind}>"))

        return df.select("*", F.inline(F.concat(*map(grains, others))))

    lefts, rights = levelled(left, left_interval, "_left"), levelled(right, right_interval, "_right")
    both = sorted({*levels(lefts, "_left"), *levels(rights, "_right")}) or [0]
    lefts = listed(lefts, "_left", both, "_l")
    rights = listed(rights, "_right", both, "_r")
    (a, b), (c, d) = left_interval, right_interval
    later = reduce(
        lambda found, level: F.when(F.col("_llevel") == level, F.greatest(
            _grain(F.col("_left_0"), width * _SPREAD**level),
            _grain(F.col("_right_0"), width * _SPREAD**level))).otherwise(found),
        both, F.lit(None).cast("bigint"))
    condition = [F.col("_llevel") == F.col("_rlevel"), F.col("_lgrain") == F.col("_rgrain"), F.col("_lshort") == F.col("_rshort")]
    condition += [lefts[x] == rights[y] for x, y in on]
    condition += [F.col(a) < F.col(d), F.col(c) < F.col(b), F.col("_lgrain") == later]
    found = lefts.join(rights, reduce(lambda x, y: x & y, condition))
    return found.select(*[f"`{name}`" for name in (*left.columns, *right.columns)])
