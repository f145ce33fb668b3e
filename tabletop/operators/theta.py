"""Joins by two inequalities, both sides large."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HOLDS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ACCURACY = 10_000
Inequality = tuple[str, str, str]
# Nodes of one level are told from those of the next by this distance.
_LEVEL = 1 << 32


def theta_join(
    left: DataFrame,
    right: DataFrame,
    first: tuple[str, str, str],
    second: tuple[str, str, str],
    ranges: int = 64,
) -> DataFrame:
    """All pairs of rows for which two inequalities hold, each given as left column, ``<``, ``<=``, ``>`` or ``>=``, right column.

    Both attributes are cut into ranges at quantiles of both sides, a value at a border being a range of its own, and the ranges
    are the leaves of a binary tree. The ranges above that of a left row are the right neighbours of the nodes on its way to the
    root, at most one a level, so a left row is listed under these and a right row under the nodes it lies in: the two
    meet in one node exactly, if at all. With a tree for each inequality the pair of nodes is the key of an equality join, which
    adaptive execution may split. What meets in inner nodes is a result; only rows of one range are compared in vain, about
    one in ``ranges`` of the pairs for which the other inequality holds. More ranges compare less and list a row more often: about
    (log2 of ``ranges`` / 2 + 1) squared times.

    The attributes are numbers, dates or timestamps, both of an inequality of one of these kinds. Rows without one of them match nothing, nor do rows outside the
    bounds of the other side, which are left out before anything is listed. Repeated rows match each on their own, ties as
    the operator says. NaN is above all numbers and equal to itself. Both sides must not have columns of one name.
    """
    clashing = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clashing:
        raise ValueError(f"both sides have columns named {', '.join(sorted(clashing))}; rename those of one side")
    conditions = [first, second]
    cuts: list = []
    sides = bounded(left, right, first, second, ranges // 2, cuts)
    if sides is None:
        return left.limit(0).join(right.limit(0), F.lit(True), "cross")
    left, right = sides
    # Ranges are told before anything is listed, once a row.
    levels = []
    for place, (mine, _, other) in enumerate(conditions):
        # NaN is no border: what is not told apart by borders is compared.
        borders = sorted({b for side in (0, 1) for b in cuts[side][place][2] if b == b})
        levels.append(max(1, (2 * len(borders)).bit_length()))
        left = left.withColumn(f"_left_{place}", _range(F.col(f"`{mine}`"), borders))
        right = right.withColumn(f"_right_{place}", _range(F.col(f"`{other}`"), borders))
    for place, (_, sign, _) in enumerate(conditions):
        left = left.withColumn(f"_left_{place}", F.explode(_listed(F.col(f"_left_{place}"), levels[place], sign, True)))
        right = right.withColumn(f"_right_{place}", F.explode(_listed(F.col(f"_right_{place}"), levels[place], sign, False)))
    meets = (F.col("_left_0") == F.col("_right_0")) & (F.col("_left_1") == F.col("_right_1"))
    for mine, sign, other in conditions:
        meets &= _HOLDS[sign](F.col(f"`{mine}`"), F.col(f"`{other}`"))
    # Spark takes what is listed for as small as what it is listed from.
    return left.join(right.hint("merge"), meets).drop("_left_0", "_left_1", "_right_0", "_right_1")


def bounded(
    left: DataFrame, right: DataFrame, first: Inequality, second: Inequality, cuts: int = 0, facts: list | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """Both sides without the rows that match nothing by the bounds of the other side; None if one has no rows. ``facts`` gets what
    was found out about both."""
    for _, sign, _ in (first, second):
        if sign not in _HOLDS:
            raise ValueError(f"not an inequality: {sign!r}")
    conditions = [first, second]
    left = left.where(" AND ".join(f"`{mine}` IS NOT NULL" for mine, _, _ in conditions))
    right = right.where(" AND ".join(f"`{other}` IS NOT NULL" for _, _, other in conditions))
    found = [_facts(left, [mine for mine, _, _ in conditions], cuts),
             _facts(right, [other for _, _, other in conditions], cuts)]
    if None in found:
        return None
    for place, (mine, sign, other) in enumerate(conditions):
        (left_least, left_most, _), (right_least, right_most, _) = found[0][place], found[1][place]
        limit, other_limit = (right_most, left_least) if sign[0] == "<" else (right_least, left_most)
        left = left.where(_HOLDS[sign](F.col(f"`{mine}`"), F.lit(limit)))
        right = right.where(_HOLDS[sign](F.lit(other_limit), F.col(f"`{other}`")))
    if facts is not None:
        facts += found
    return left, right


def _facts(df: DataFrame, columns: list[str], cuts: int) -> list[tuple] | None:
    """Least and greatest value and quantiles of each of ``columns``; None if there are no rows."""
    fractions = [i / (cuts + 1) for i in range(1, cuts + 1)] or [0.5]
    row = df.agg(F.count("*"), *[
        found for name in columns for value in [F.col(f"`{name}`")]
        for found in (F.min(value), F.max(value), F.percentile_approx(value, fractions, _ACCURACY))]).first()
    return [tuple(row[1 + 3 * i:4 + 3 * i]) for i in range(len(columns))] if row[0] else None


def _range(value: Column, borders: list) -> Column:
    """Number of the range of a value: an odd one for a border, an even one for what lies between two."""
    at = F.array(*[F.lit(border) for border in borders])
    return F.size(F.filter(at, lambda b: b < value)) * 2 + F.exists(at, lambda b: b == value).cast("int")


def _listed(number: Column, levels: int, sign: str, is_left: bool) -> Column:
    """The nodes under which a row of a range is listed.

    Left rows are listed under the neighbours of their nodes on the side where partners lie, right rows under those of their nodes
    that are such neighbours of others, which the last bit of the number tells; both under their range as well.
    """
    # With partners above, neighbours are the odd nodes and the left row stands in the even ones.
    odd = int((sign[0] == "<") != is_left)
    step = (1 if sign[0] == "<" else -1) if is_left else 0
    nodes = [
        F.when(F.shiftright(number, level) % 2 == odd, F.lit((level + 1) * _LEVEL) + F.shiftright(number, level) + step)
        for level in range(levels)
    ]
    # All values of a range with an odd number are equal.
    own = number.cast("bigint") if "=" in sign else F.when(number % 2 == 0, number.cast("bigint"))
    return F.array_compact(F.array(own, *nodes))
