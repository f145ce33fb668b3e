"""Keys and references that lake tables have although nobody declared them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sketches of 2^14 registers for columns and 2^11 for pairs: standard errors of about 0.8 and 2.3 percent.
_COLUMN_REGISTERS, _PAIR_REGISTERS = 14, 11
# A column is ruled out only where the estimate falls short of the row count by many standard errors.
_COLUMN_SHARE, _PAIR_SHARE = 0.9, 0.8

# One value combination in so many is looked at first: repeated ones among them rule a candidate out.
_FILTER = 64
# Bounds of texts are compared by their first characters; longer values meet as digests.
_BOUND_CHARS, _LONG_TEXT = 64, 80
# So many sketches of pairs are made in one pass over a table.
_PAIRS_A_PASS = 200

_TEXT_ORDERED = {"string", "date", "timestamp", "timestamp_ntz"}

# Per table the keys, each a tuple of column names.
Found = dict[str, list[tuple[str, ...]]]


def candidate_keys(primary: Column, unique: Column) -> Column:
    """Columns of the primary key and of unique constraints, each once, sorted."""
    return F.array_sort(F.array_union(primary, unique))


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType, T.NullType))


def _narrow(df: DataFrame, column: str) -> Column:
    """A column's value, long texts as digests: what is grouped crosses the network."""
    value = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, T.StringType):
        return value
    return F.when(F.length(value) > _LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


def _without_repeats(tables: Mapping[str, DataFrame], candidates: Found, share: int) -> Found:
    """Those candidates whose value combinations are all different, all tables checked in one job.

    Only combinations whose hash is divisible by ``share`` are looked at, all rows of each. Equal ones are counted with
    partial sums before the shuffle, so a value that fills a third of the table costs one row per task; of each candidate
    at most one repeated combination is reported.
    """
    def repeated(i: int, name: str, columns: tuple[str, ...]) -> DataFrame:
        df = tables[name]
        values = [_narrow(df, column).alias(f"c{j}") for j, column in enumerate(columns)]
        names = [f"c{j}" for j in range(len(columns))]
        rows = df.select(*values)
        if share > 1:
            rows = rows.where(F.pmod(F.xxhash64(*names), F.lit(share)) == 0)
        counted = rows.groupBy(*names).agg(F.count("*").alias("copies"))
        return counted.where("copies > 1").limit(1).select(F.lit(i).alias("candidate"))

    listed = [(name, columns) for name, wanted in candidates.items() for columns in wanted]
    ruled_out = set()
    if listed:
        found = reduce(DataFrame.union, [repeated(i, name, columns) for i, (name, columns) in enumerate(listed)])
        ruled_out = {row["candidate"] for row in found.collect()}
    return {
        table: [columns for i, (name, columns) in enumerate(listed) if name == table and i not in ruled_out]
        for table in candidates
    }


def discover_keys(tables: Mapping[str, DataFrame], max_width: int = 2) -> Found:
    """Columns, or where no single one does pairs of columns, that tell all rows apart and are never null.

    One aggregation per table estimates the distinct values of every column and rules most columns out; what is left is
    checked exactly. Pairs are looked at only where no column is a key, and only if their distinct values could
    suffice. Each step is one job for all tables; the driver sees a few numbers per column. ``max_width`` is 1 or 2.
    """
    if max_width not in (1, 2):
        raise ValueError("max_width is 1 or 2: wider keys are not looked for")
    found: Found = {name: [] for name in tables}
    names = {name: [f.name for f in df.schema if _orderable(f.dataType)] for name, df in tables.items()}
    if not any(names.values()):
        return found
    facts = reduce(
        DataFrame.union,
        [
            df.agg(
                F.lit(name).alias("table"),
                F.count("*").alias("total"),
                F.array(*[_estimate([column], _COLUMN_REGISTERS) for column in names[name]]).alias("distinct"),
                F.array(*[F.count_if(F.col(f"`{column}`").isNull()) for column in names[name]]).alias("nulls"),
            )
            for name, df in tables.items()
            if names[name]
        ],
    ).collect()
    totals = {row["table"]: row["total"] for row in facts if row["total"]}
    filled = {
        row["table"]: {
            column: distinct
            for column, distinct, nulls in zip(names[row["table"]], row["distinct"], row["nulls"])
            if nulls == 0
        }
        for row in facts
        if row["total"]
    }
    found |= _checked_keys(
        tables,
        {
            name: [(column,) for column, distinct in columns.items() if distinct >= totals[name] * _COLUMN_SHARE]
            for name, columns in filled.items()
        },
    )
    if max_width < 2:
        return found

    pairs = {
        name: [
            (a, b) for a, b in combinations(columns, 2) if columns[a] * columns[b] >= totals[name] * _COLUMN_SHARE
        ]
        for name, columns in filled.items()
        if not found[name]
    }
    sketched = [
        tables[name].agg(
            F.lit(name).alias("table"), F.lit(start).alias("start"),
            F.array(*[_estimate(pair, _PAIR_REGISTERS) for pair in wanted[start:start + _PAIRS_A_PASS]]).alias("distinct"),
        )
        for name, wanted in pairs.items()
        for start in range(0, len(wanted), _PAIRS_A_PASS)
    ]
    if sketched:
        likely: Found = {name: [] for name in pairs}
        for row in reduce(DataFrame.union, sketched).collect():
            name, some = row["table"], pairs[row["table"]][row["start"]:]
            likely[name] += [pair for pair, n in zip(some, row["distinct"]) if n >= totals[name] * _PAIR_SHARE]
        found |= _checked_keys(tables, likely)
    return found


def _checked_keys(tables: Mapping[str, DataFrame], candidates: Found) -> Found:
    """Keys among the candidates: a part of the values is looked at first, what that leaves is checked on all rows."""
    return _without_repeats(tables, _without_repeats(tables, candidates, _FILTER), 1)


def _estimate(columns: Sequence[str], registers: int) -> Column:
    """Estimated number of distinct values, from a sketch of a few KB per task."""
    value = F.xxhash64(*[F.col(f"`{name}`") for name in columns])
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, registers))


def check_reference(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: ``child_rows`` with a value, ``orphan_rows`` and ``orphan_values`` that the parent lacks.

    The child is counted per value before the join: each value crosses the network once per task, however often it
    occurs, and the join sees it once.
    """
    values = (
        child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("copies"))
    )
    known = parent.select(F.col(parent_column).alias("value")).distinct().withColumn("known", F.lit(True))
    joined = values.join(known, "value", "left")
    orphan = F.col("known").isNull()
    return joined.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("copies"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_values"),
    )


def discover_references(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]]) -> DataFrame:
    """Columns all of whose values occur in a key column of another table: candidates for foreign keys.

    ``keys`` names single key columns per table. Every table is read twice: for the smallest and largest value of its
    columns, which rule most columns out, and for the different values of the others. Those values, each once per
    column, meet in one shuffle; a value's group holds at most one entry per column. A child is contained in a parent
    if the parent has as many of the child's values as the child itself.
    """
    spark = next(iter(tables.values())).sparkSession
    bounds = _bounds(tables)
    parents = [(name, column) for name, columns in keys.items() for column in columns if (name, column) in bounds]
    pairs = [
        (child, parent)
        for child, facts in bounds.items()
        for parent in parents
        if child[0] != parent[0] and _may_contain(bounds[parent], facts)
    ]
    schema = "child_table string, child_column string, parent_table string, parent_column string, child_rows bigint"
    if not pairs:
        return spark.createDataFrame([], schema)

    places = sorted({place for pair in pairs for place in pair})
    numbers = {place: i for i, place in enumerate(places)}
    values = reduce(
        DataFrame.union,
        [
            _column_values(df, {column: number for (table, column), number in numbers.items() if table == name})
            for name, df in tables.items()
            if any(table == name for table, _ in places)
        ],
    )
    distinct = values.groupBy("family", "number", "text", "place").agg(F.count("*").alias("copies"))
    entry = F.struct("place", "copies")
    holders = distinct.groupBy("family", "number", "text").agg(F.collect_list(entry).alias("holders"))
    # Per child, the places of the parents it could have and its own: only these pairs are listed.
    wanted: dict[int, list[int]] = {}
    for child, parent in pairs:
        wanted.setdefault(numbers[child], [numbers[child]]).append(numbers[parent])
    possible = F.create_map(*[
        F.lit(x) if isinstance(x, int) else F.array(*[F.lit(p) for p in x]) for item in wanted.items() for x in item])
    shared = (
        holders.select(F.explode("holders").alias("own"), "holders")
        .where(F.col("own.place").isin(sorted(wanted)))
        .select(
            F.col("own.place").alias("child"),
            F.col("own.copies").alias("copies"),
            F.explode(F.array_intersect("holders.place", F.try_element_at(possible, F.col("own.place")))).alias("parent"),
        )
    )
    counted = shared.groupBy("child", "parent").agg(F.count("*").alias("common"), F.sum("copies").alias("child_rows"))
    # One row per pair of columns. The child is among its own holders: (child, child) counts its values.
    counts = {(row["child"], row["parent"]): (row["common"], row["child_rows"]) for row in counted.collect()}
    rows = []
    for child, parent in pairs:
        own = numbers[child]
        if counts.get((own, numbers[parent]), (0,))[0] == counts[own, own][0]:
            rows.append((*child, *parent, counts[own, own][1]))
    return spark.createDataFrame(rows, schema)


def _column_values(df: DataFrame, numbered: Mapping[str, int]) -> DataFrame:
    """The values of the numbered columns below each other: ``family``, the value, ``place``; one scan.

    Whole numbers stay such in ``number``, anything else is ``text``; long texts stand for themselves by their SHA-256
    digest, to keep the shuffle narrow.
    """
    entries = []
    for column, number in numbered.items():
        value, family = F.col(f"`{column}`"), _family(df.schema[column].dataType)
        if family == "integer":
            as_number, as_text = value.cast("bigint"), F.lit(None).cast("string")
        else:
            text = value.cast("string")
            as_number = F.lit(None).cast("bigint")
            as_text = F.when(F.length(text) > _LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
        entries.append(
            F.struct(
                F.lit(family).alias("family"),
                as_number.alias("number"),
                as_text.alias("text"),
                F.lit(number).alias("place"),
            )
        )
    return df.select(F.inline(F.array(*entries))).where("number IS NOT NULL OR text IS NOT NULL")


def _bounds(tables: Mapping[str, DataFrame]) -> dict[tuple[str, str], tuple]:
    """(table, column) → family, smallest and largest value; columns without values are left out.

    Whole numbers are compared as such, dates and texts by their text, texts by its start; of other types only the family
    counts.
    """
    def facts(name: str, df: DataFrame) -> DataFrame:
        entries = []
        for field in df.schema:
            if not _orderable(field.dataType):
                continue
            column, family = F.col(f"`{field.name}`"), _family(field.dataType)
            # The starts of texts bound them well enough, and keep what the driver sees small.
            bound = F.substring(column, 1, _BOUND_CHARS) if family == "string" else column
            low, high = F.min(bound), F.max(bound)
            no_number, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
            is_number, is_text = family == "integer", family in _TEXT_ORDERED
            entries.append(
                F.struct(
                    F.lit(name).alias("table"),
                    F.lit(field.name).alias("column"),
                    F.lit(family).alias("family"),
                    (F.count(column) > 0).alias("has_values"),
                    (low.cast("bigint") if is_number else no_number).alias("low"),
                    (high.cast("bigint") if is_number else no_number).alias("high"),
                    (low.cast("string") if is_text else no_text).alias("first"),
                    (high.cast("string") if is_text else no_text).alias("last"),
                )
            )
        return df.agg(F.array(*entries).alias("entries")).select(F.inline("entries"))

    rows = reduce(DataFrame.union, [facts(name, df) for name, df in tables.items()]).where("has_values").collect()
    return {
        (row["table"], row["column"]): (row["family"], row["low"], row["high"], row["first"], row["last"]) for row in rows
    }


def _may_contain(parent: tuple, child: tuple) -> bool:
    family, low, high, first, last = parent
    if family != child[0]:
        return False
    if low is not None:
        return low <= child[1] and child[2] <= high
    if first is not None:
        # Python orders texts by code point, as Spark does by UTF-8 bytes.
        return first <= child[3] and child[4] <= last
    return True


def _family(data_type: T.DataType) -> str:
    whole = isinstance(data_type, T.IntegralType) or (
        isinstance(data_type, T.DecimalType) and data_type.scale == 0 and data_type.precision <= 18)
    return "integer" if whole else data_type.simpleString()
