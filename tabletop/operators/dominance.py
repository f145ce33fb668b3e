"""Sums over the rows that a join by inequalities or overlaps would meet, without the pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.time import epoch_seconds
from tabletop.operators.ordered import with_global_ranks
from tabletop.operators.theta import Inequality, _listed, bounded
from tabletop.session import working_folder

# An order is cut into the square of so many parts.
_PARTS = 16
_ACCURACY = 10_000


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = working_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _number(value: Column, data_type: T.DataType) -> Column:
    """A double that is never smaller for a later value."""
    return (value if isinstance(data_type, T.NumericType) else epoch_seconds(value, data_type)).cast("double")


def _borders(dfs: Sequence[DataFrame], column: str) -> list[list[float]]:
    """Borders of even parts of all values, in lists of ``_PARTS``; the driver sees these quantiles only."""
    count = _PARTS * _PARTS
    values = reduce(DataFrame.union, [df.select(_number(F.col(column), df.schema[column].dataType).alias("v")) for df in dfs])
    found = values.agg(F.percentile_approx("v", [i / count for i in range(1, count)], _ACCURACY)).first()[0] or []
    borders = sorted({border for border in found if border == border})
    return [borders[start:start + _PARTS] for start in range(0, len(borders), _PARTS)]


def _part(number: Column, borders: list[list[float]]) -> Column:
    """How many borders lie below a number, told by the list it falls into and its place there."""
    if not borders:
        return F.lit(0)
    firsts = F.array(*[F.lit(some[0]) for some in borders])
    place = F.size(F.filter(firsts, lambda border: border < number))
    lists = F.array(*[F.array(*[F.lit(border) for border in some]) for some in borders])
    inside = F.size(F.filter(F.element_at(lists, F.greatest(place, F.lit(1))), lambda border: border < number))
    return F.greatest(place - 1, F.lit(0)) * _PARTS + inside


def _summed(entries: DataFrame, points: DataFrame, sign: str, peaks: Sequence[str]) -> DataFrame:
    """``points`` with ``_n`` and the ``peaks`` of the entries of their ``_node`` whose ``_y`` stands in relation ``sign`` to theirs.

    Both have ``_node``, ``_y`` and ``_part``, the number of the part of the order that ``_y`` lies in; entries have ``_n``, to be summed up, and
    ``peaks``, of which the greatest counts. What lies in whole parts is known from sums, at most one row a node and part; a
    window runs over one part of one node.
    """
    upward = sign[0] == "<"
    own = [name for name in points.columns if name not in ("_node", "_y", "_part")]
    # Of equal values, a strict inequality meets points first.
    first, second = (0, 1) if "=" in sign else (1, 0)
    kinds = {name: entries.schema[name].dataType for name in peaks}
    empty = [F.lit(None).cast(points.schema[name].dataType).alias(name) for name in own]
    listed = entries.select("_node", "_part", "_y", F.lit(first).alias("_turn"), "_n", *peaks, *empty)
    asked = points.select("_node", "_part", "_y", F.lit(second).alias("_turn"), F.lit(0).cast("bigint").alias("_n"),
                          *[F.lit(None).cast(kinds[name]).alias(name) for name in peaks], *own)
    rows = listed.unionByName(asked)
    order = (lambda name: F.col(name).asc()) if upward else (lambda name: F.col(name).desc())
    sums = lambda over: [F.sum("_n").over(over).alias("_n"), *[F.max(name).over(over).alias(name) for name in peaks]]
    whole = rows.groupBy("_node", "_part").agg(F.sum("_n").alias("_n"), *[F.max(name).alias(name) for name in peaks])
    before = Window.partitionBy("_node").orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("_node", "_part", *sums(before)).where("_n IS NOT NULL")
    carried = carried.withColumns({"_y": F.lit(None).cast(rows.schema["_y"].dataType), "_turn": F.lit(-1)})
    rows = rows.unionByName(carried, allowMissingColumns=True)
    nulls_first = F.col("_y").asc_nulls_first() if upward else F.col("_y").desc_nulls_first()
    up_to = Window.partitionBy("_node", "_part").orderBy(nulls_first, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("_node", "_y", "_turn", *own, *sums(up_to)).where(F.col("_turn") == second).drop("_turn")


def theta_sums(left: DataFrame, right: DataFrame, first: Inequality, second: Inequality, peaks: Sequence[str] = ()) -> DataFrame:
    """Rows of ``right`` that ``theta_join`` would pair with any of ``left``, with ``matches``, the number of these, and the greatest value
    among them of each of ``peaks``, columns of ``left``, as ``most_<name>``.

    No pair is made, so the work does not grow with them. Left rows equal in both attributes are one. The different values of the first
    attribute are ranked, and the ranks are the leaves of a binary tree: a left row is listed under the right neighbours of the
    nodes on its way to the root, a right row under its nodes, and the two meet in one at most, log2 of the values / 2 times a row. In a node
    the second attribute is put in order, by parts of even size, and sums run along it. Nulls, ties, repeated rows and NaN are as in
    ``theta_join``.
    """
    (x, sign, other_x), (y, other_sign, other_y) = first, second
    sides = bounded(left, right, first, second)
    if sides is None:
        found = right.limit(0).withColumn("matches", F.lit(0).cast("bigint"))
        return found.withColumns({f"most_{name}": F.lit(None).cast(left.schema[name].dataType) for name in peaks})
    left, right = sides
    names = [f"_peak{i}" for i in range(len(peaks))]
    summed = left.groupBy(F.col(f"`{x}`").alias("_x"), F.col(f"`{y}`").alias("_y")).agg(
        F.count("*").alias("_n"), *[F.max(f"`{peak}`").alias(name) for peak, name in zip(peaks, names)])
    summed = _stored(summed, "sums")
    asked = _stored(right.select(F.col(f"`{other_x}`").alias("_x"), F.col(f"`{other_y}`").alias("_y")).distinct(), "asked")
    values = summed.select("_x").union(asked.select("_x")).distinct()
    ranks = _stored(with_global_ranks(values, "_x").select(F.col("_x").alias("_value"), "dense_rank"), "ranks")
    count = ranks.count()
    kinds = {name: summed.select(name).union(asked.select(name)).schema[name].dataType for name in ("_x", "_y")}
    summed, asked = (df.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()}) for df in (summed, asked))
    borders = _borders([summed, asked], "_y")
    part = _part(_number(F.col("_y"), kinds["_y"]), borders).alias("_part")
    # An odd number is a range of one value.
    number, levels = F.col("dense_rank") * 2 + 1, (2 * count + 1).bit_length()

    def listed(df: DataFrame, is_left: bool, *kept: str) -> DataFrame:
        placed = df.join(ranks, df["_x"] == ranks["_value"]).select("_y", "dense_rank", part, *kept)
        return placed.withColumn("_node", F.explode(_listed(number, levels, sign, is_left)))

    entries = listed(summed, True, "_n", *names).drop("dense_rank")
    points = listed(asked, False)
    found = _summed(entries, points, other_sign, names)
    found = found.groupBy("dense_rank", "_y").agg(F.sum("_n").alias("matches"), *[
        F.max(name).alias(f"most_{peak}") for peak, name in zip(peaks, names)]).where("matches > 0")
    found = found.join(ranks, "dense_rank")
    rows = right.join(found, (F.col(f"`{other_x}`") == found["_value"]) & (F.col(f"`{other_y}`") == found["_y"]))
    return rows.select(*[right[f"`{name}`"] for name in right.columns], "matches", *[f"most_{peak}" for peak in peaks])


def overlap_counts(left: DataFrame, right: DataFrame, left_interval: tuple[str, str], right_interval: tuple[str, str], by: str) -> DataFrame:
    """``by``, the columns of ``right`` and ``matches``: for each value of the column ``by`` of ``left`` and each row of ``right``, with how many rows
    of that value ``overlap_join`` would pair it; none where there is no such row.

    No pair is made: an interval meets those that start before its end, but for those that end by its start, and both are counted along
    the order of starts and of ends. Rows of equal intervals are counted together. The result has at most as many
    rows as there are values of ``by`` times rows of ``right``. What takes part is as in ``overlap_join``.
    """
    if by.lower() in {c.lower() for c in right.columns}:
        raise ValueError(f"both sides have columns named {by.lower()}; rename those of one side")
    (a, b), (c, d) = [[f"`{name}`" for name in some] for some in (left_interval, right_interval)]
    held = left.where(F.col(a) < F.col(b)).groupBy(F.col(f"`{by}`").alias("_node"), F.col(a).alias("_start"), F.col(b).alias("_end"))
    held = _stored(held.agg(F.count("*").alias("_n")), "held")
    right = right.where(F.col(c) < F.col(d))
    asked = right.select(F.col(c).alias("_c"), F.col(d).alias("_d")).distinct()
    asked = _stored(asked.crossJoin(held.select("_node").distinct()), "asked")

    def counted(end: str, limit: str, sign: str, factor: int) -> DataFrame:
        entries = held.select("_node", F.col(end).alias("_y"), (F.col("_n") * factor).alias("_n"))
        points = asked.select("_node", F.col(limit).alias("_y"), "_c", "_d")
        kind = entries.select("_y").union(points.select("_y")).schema["_y"].dataType
        entries, points = (df.withColumn("_y", F.col("_y").cast(kind)) for df in (entries, points))
        borders = _borders([entries, asked.select(F.col(limit).cast(kind).alias("_y"))], "_y")
        part = _part(_number(F.col("_y"), kind), borders)
        return _summed(entries.withColumn("_part", part), points.withColumn("_part", part), sign, []).drop("_y")

    # An interval that ends by the start of another starts before its end.
    both = counted("_start", "_d", "<", 1).unionByName(counted("_end", "_c", "<=", -1))
    both = both.groupBy("_node", "_c", "_d").agg(F.sum("_n").alias("matches")).where("matches > 0")
    rows = right.join(both, (F.col(c) == both["_c"]) & (F.col(d) == both["_d"]))
    return rows.select(both["_node"].alias(by), *[right[f"`{name}`"] for name in right.columns], "matches")
