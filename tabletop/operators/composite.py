"""Keys and references of several columns that lake tables have although nobody declared them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletop.operators.keys import Found, _estimate, _family, _orderable, discover_references
from tabletop.session import working_folder

# Sketches of 2^14 registers have a standard error of about 0.8 percent; a candidate falls only many errors below the row count.
_REGISTERS, _SHARE = 14, 0.9
# One value combination in so many is looked at: repeated ones among them rule a candidate out before all rows are.
_SHARES = (64, 1)
# Combinations that repeat in at most this part of the rows are worth it to look for wider keys in those rows only.
_BASE_SHARE = 0.1
# So many digests of a row are made in one pass over a table.
_DIGESTS_A_PASS = 24

Columns = tuple[str, ...]


def _digest(values: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits ``a`` and ``b`` that stand for a combination of values."""
    return F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("second"), *values).alias("b")


def _canonical(df: DataFrame, column: str) -> Column:
    """A value that is equal wherever the values of two columns of one family are."""
    value = F.col(f"`{column}`")
    family = _family(df.schema[column].dataType)
    return value.cast("bigint") if family == "integer" else value.cast("string")


def _hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two hashes of every column, named by its place: what digests of combinations are made of, so that a long text is read once a row."""
    found = []
    for i, column in enumerate(columns):
        found += [F.xxhash64(f"`{column}`").alias(f"a{i}"), F.xxhash64(F.lit("second"), f"`{column}`").alias(f"b{i}")]
    return df.select(*found)


def _combined(columns: Sequence[str], some: Columns) -> tuple[Column, Column]:
    """128 bits ``a`` and ``b`` of a combination, from rows of ``_hashed``."""
    places = [list(columns).index(column) for column in some]
    return F.xxhash64(*[f"a{i}" for i in places]).alias("a"), F.xxhash64(F.lit("second"), *[f"b{i}" for i in places]).alias("b")


def _repeats(parts: Sequence[tuple[DataFrame, Sequence[str], Mapping[int, Columns], int]]) -> DataFrame | None:
    """``candidate``, ``a``, ``b``, ``count`` of each digest that two rows of a part share, all parts in one job.

    A part has hashed rows, the columns they stand for, numbered combinations, and in how many values one is looked at; it is read once
    for some combinations at a time. What crosses the network is a digest for each looked-at row and combination, summed up in every
    task before, so that one that fills a third of the table is one row a task.
    """
    def entry(columns: Sequence[str], i: int, some: Columns, share: int) -> Column:
        a, b = _combined(columns, some)
        found = F.struct(F.lit(i).alias("candidate"), a, b)
        return found if share == 1 else F.when(F.pmod(a, F.lit(share)) == 0, found)

    listed = []
    for rows, columns, numbered, share in parts:
        numbers = sorted(numbered)
        for start in range(0, len(numbers), _DIGESTS_A_PASS):
            entries = [entry(columns, i, numbered[i], share) for i in numbers[start:start + _DIGESTS_A_PASS]]
            listed.append(rows.select(F.inline(F.array(*entries))).where("candidate is not null"))
    if not listed:
        return None
    return reduce(DataFrame.union, listed).groupBy("candidate", "a", "b").count().where("count > 1")


def _repeated_rows(repeats: DataFrame | None) -> dict[int, int]:
    """Number of rows that share a digest with another, by number of the combination; none for those without."""
    if repeats is None:
        return {}
    return {row["candidate"]: row["n"] for row in repeats.groupBy("candidate").agg(F.sum("count").alias("n")).collect()}


class _Lattice:
    """Tables under search for minimal keys: which combinations are known to repeat, and in how many rows."""

    def __init__(self, tables: Mapping[str, DataFrame], columns: Found, distinct: Mapping[tuple[str, str], int], totals: Mapping[str, int]):
        self.columns, self.distinct, self.totals = columns, distinct, totals
        self.tables = tables
        self.hashed = {name: _hashed(tables[name], some) for name, some in columns.items() if some}
        # Rows that repeat a combination: estimated ones, and exact ones with the folder that holds the repeated digests.
        self.estimated: dict[tuple[str, Columns], int] = {}
        self.exact: dict[tuple[str, Columns], tuple[int, str]] = {}

    def _sampled_by(self, name: str, some: Columns, share: int) -> str | None:
        """The column of most values, if a part of its values is an even part of the table."""
        column = max(some, key=lambda column: (self.distinct[name, column], column))
        return column if self.distinct[name, column] >= share * share else None

    def sample(self, likely: Found, share: int) -> Found:
        """``likely`` without what repeats among one in ``share`` of the values of a column of its own, or of its own values.

        Equal rows are all in or all out either way; by a column, rows are left out before anything is made of them.
        """
        numbered = [(name, some) for name, wanted in likely.items() for some in wanted]
        groups: dict[tuple[str, str | None], dict[int, Columns]] = {}
        for i, (name, some) in enumerate(numbered):
            groups.setdefault((name, self._sampled_by(name, some, share)), {})[i] = some
        parts = []
        for (name, column), some in groups.items():
            if column is None:
                parts.append((self.hashed[name], self.columns[name], some, share))
            else:
                rows = self.tables[name].where(F.pmod(F.xxhash64(f"`{column}`"), F.lit(share)) == 0)
                parts.append((_hashed(rows, self.columns[name]), self.columns[name], some, 1))
        seen = {numbered[i]: n * share for i, n in _repeated_rows(_repeats(parts)).items()}
        self.estimated.update(seen)
        return _without(likely, seen)

    def _whole(self, wanted: Sequence[tuple[str, Columns]]) -> None:
        """Checks combinations on all rows; of those that repeat, the repeated digests are kept."""
        if not wanted:
            return
        parts = [
            (self.hashed[name], self.columns[name], {i: some for i, (table, some) in enumerate(wanted) if table == name}, 1)
            for name in dict.fromkeys(name for name, _ in wanted)
        ]
        spark = parts[0][0].sparkSession
        folder = working_folder(spark, "repeats")
        _repeats(parts).write.partitionBy("candidate").parquet(folder)
        stored = spark.read.schema("a bigint, b bigint, count bigint, candidate int").parquet(folder)
        for i, n in _repeated_rows(stored).items():
            self.exact[wanted[i]] = n, f"{folder}/candidate={i}"

    def _base(self, name: str, some: Columns) -> Columns | None:
        """The part of ``some`` that repeats in the fewest rows, of those checked on all rows."""
        known = [part for width in range(1, len(some)) for part in combinations(some, width)
                 if (name, part) in self.exact and self.exact[name, part][0] <= _BASE_SHARE * self.totals[name]]
        return min(known, key=lambda part: (self.exact[name, part][0], part), default=None)

    def _worth_checking(self, name: str, wanted: Sequence[Columns]) -> list[Columns]:
        """Combinations to check on all rows so that each of ``wanted`` is one or has a part among them that repeats in few rows."""
        few = _BASE_SHARE * self.totals[name]
        left, chosen = set(wanted), []
        held: dict[Columns, set[Columns]] = {}
        for some in wanted:
            for width in range(1, len(some)):
                for part in combinations(some, width):
                    if self.estimated.get((name, part), few + 1) <= few and (name, part) not in self.exact:
                        held.setdefault(part, set()).add(some)
        while held:
            part = max(sorted(held), key=lambda part: (len(held[part] & left), -self.estimated[name, part]))
            if len(held[part] & left) < 2:
                break
            chosen.append(part)
            left -= held.pop(part)
        return chosen + sorted(left)

    def keys(self, likely: Found) -> Found:
        """Those of ``likely`` of which no two rows agree, each told on all rows that may.

        Rows that agree on a combination agree on all parts of it. So once the repeated rows of a part are known, only these can
        repeat the whole, and they are few: one check of all rows serves all combinations with that part.
        """
        wanted = {name: [some for some in found if not self._base(name, some)] for name, found in likely.items()}
        whole = [(name, some) for name, found in wanted.items() for some in self._worth_checking(name, found)]
        self._whole(whole)
        checked, parts = set(whole), {}
        rest = [(name, some) for name, found in likely.items() for some in found if (name, some) not in checked]
        direct = []
        for i, (name, some) in enumerate(rest):
            if base := self._base(name, some):
                parts.setdefault((name, base), {})[i] = some
            else:
                direct.append((name, some))
        self._whole(direct)
        found = _repeated_rows(_repeats([
            (self._rows_of(name, base), self.columns[name], some, 1) for (name, base), some in parts.items()]))
        gone = set(self.exact) | {rest[i] for i in found}
        return _without(likely, gone)

    def _rows_of(self, name: str, base: Columns) -> DataFrame:
        """Hashed rows of a table that repeat a combination."""
        rows = self.hashed[name]
        a, b = _combined(self.columns[name], base)
        repeated = rows.sparkSession.read.schema("a bigint, b bigint").parquet(self.exact[name, base][1])
        return rows.withColumns({"a": a, "b": b}).join(repeated, ["a", "b"], "left_semi")


def _without(candidates: Found, gone: Iterable[tuple[str, Columns]]) -> Found:
    gone = set(gone)
    return {name: [columns for columns in some if (name, columns) not in gone] for name, some in candidates.items()}


def minimal_keys(tables: Mapping[str, DataFrame], max_width: int = 4) -> Found:
    """All combinations of up to ``max_width`` columns that tell the rows apart and of which no part does.

    The lattice of combinations is searched by width. A candidate is made of combinations that are no keys, never of one that holds
    a key. It is ruled out if the distinct values of its columns, estimated by sketches, cannot suffice, or if two rows of a part
    of its values agree. Of the rest, a few parts that nearly are keys are checked on all rows, by digests of 128 bits; what holds such
    a part is checked on the rows that repeat it, as no others can agree. The driver sees some numbers per column and candidate.
    Columns with nulls and those that have no order are in no key; a table without rows has none.
    """
    if max_width < 1:
        raise ValueError("max_width is 1 at least")
    found: Found = {name: [] for name in tables}
    names = {name: [f.name for f in df.schema if _orderable(f.dataType)] for name, df in tables.items()}
    counted = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("total"),
               F.array(*[F.count_if(F.col(f"`{column}`").isNull()) for column in names[name]]).alias("nulls"),
               F.array(*[_estimate([column], _REGISTERS) for column in names[name]]).alias("distinct"))
        for name, df in tables.items() if names[name]
    ]
    if not counted:
        return found
    facts = {row["table"]: row for row in reduce(DataFrame.union, counted).collect() if row["total"]}
    distinct = {
        (name, column): n for name, row in facts.items()
        for column, n, nulls in zip(names[name], row["distinct"], row["nulls"]) if nulls == 0
    }
    columns = {name: [column for column in names[name] if (name, column) in distinct] for name in facts}
    candidates: Found = {name: [(column,) for column in some] for name, some in columns.items()}
    lattice = _Lattice(tables, columns, distinct, {name: row["total"] for name, row in facts.items()})
    for width in range(1, max_width + 1):
        likely = {
            name: [some for some in wanted if prod(distinct[name, c] for c in some) >= _SHARE * facts[name]["total"]]
            for name, wanted in candidates.items()
        }
        for share in _SHARES:
            likely = lattice.sample(likely, share) if share > 1 else lattice.keys(likely)
        for name, some in likely.items():
            found[name] += some
        candidates = {
            name: _wider(columns[name], [some for some in wanted if some not in set(likely[name])], width)
            for name, wanted in candidates.items()
        }
    return found


def _wider(columns: list[str], non_keys: list[Columns], width: int) -> list[Columns]:
    """Combinations with one more column, all parts of which are in ``non_keys``."""
    place, known = {column: i for i, column in enumerate(columns)}, set(non_keys)
    made = ((*some, column) for some in non_keys for column in columns[place[some[-1]] + 1:])
    return [some for some in made if all(part in known for part in combinations(some, width))]


def check_composite_reference(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """One row: ``child_rows`` with a value in every column, ``orphan_rows`` and ``orphan_values`` that the parent lacks.

    Rows with a null in any of the columns refer to nothing, as in SQL. The child is counted per combination before the join.
    """
    if len(columns) != len(parent_columns) or not columns:
        raise ValueError("as many parent columns as columns, and at least one")
    names = [f"c{i}" for i in range(len(columns))]
    whole = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in names])
    values = child.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)]).where(whole)
    values = values.groupBy(*names).agg(F.count("*").alias("copies"))
    known = parent.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(parent_columns, names)]).distinct()
    orphan = F.col("known").isNull()
    return values.join(known.withColumn("known", F.lit(True)), names, "left").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("copies"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_values"))


def discover_composite_references(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[Columns]]) -> DataFrame:
    """Combinations of columns all of whose values occur in a key of several columns of another table.

    ``child_table``, ``child_columns``, ``parent_table``, ``parent_columns`` and ``child_rows``, the rows without a null in these columns.
    ``keys`` are those of ``minimal_keys``; keys of one column are left to ``discover_references``. Combinations are built only from
    columns that are each contained in their parent column. All combinations of all tables then meet in one shuffle by digests of
    their values, every one once; the group of a digest holds at most one entry per combination. Combinations without any row are
    no candidates.
    """
    spark = next(iter(tables.values())).sparkSession
    wide = {name: [tuple(key) for key in some if len(key) > 1] for name, some in keys.items()}
    schema = "child_table string, child_columns array<string>, parent_table string, parent_columns array<string>, child_rows bigint"
    singles = {name: sorted({column for key in some for column in key}) for name, some in wide.items() if some}
    if not singles:
        return spark.createDataFrame([], schema)
    inside: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for row in discover_references(tables, singles).collect():
        inside.setdefault((row["child_table"], row["parent_table"]), set()).add((row["child_column"], row["parent_column"]))
    pairs = []
    for (child, parent), held in inside.items():
        own = sorted({column for column, _ in held})
        pairs += [
            ((child, columns), (parent, key)) for key in wide[parent] for columns in permutations(own, len(key))
            if all(pair in held for pair in zip(columns, key))
        ]
    if not pairs:
        return spark.createDataFrame([], schema)
    places = sorted({place for pair in pairs for place in pair})
    numbers = {place: i for i, place in enumerate(places)}

    def digests(name: str) -> DataFrame:
        df, entries = tables[name], []
        for table, columns in places:
            if table == name:
                values = [_canonical(df, column) for column in columns]
                whole = reduce(lambda a, b: a & b, [value.isNotNull() for value in values])
                entries.append(F.when(whole, F.struct(F.lit(numbers[table, columns]).alias("place"), *_digest(values))))
        return df.select(F.inline(F.array(*entries))).where("place is not null")

    rows = reduce(DataFrame.union, [digests(name) for name in tables if any(table == name for table, _ in places)])
    once = rows.groupBy("a", "b", "place").agg(F.count("*").alias("copies"))
    holders = once.groupBy("a", "b").agg(F.collect_list(F.struct("place", "copies")).alias("holders"))
    wanted: dict[int, list[int]] = {}
    for child, parent in pairs:
        wanted.setdefault(numbers[child], [numbers[child]]).append(numbers[parent])
    listed = F.create_map(*[x for child, some in wanted.items() for x in (F.lit(child), F.array(*map(F.lit, some)))])
    shared = holders.select(F.explode("holders").alias("own"), "holders").select(
        F.col("own.place").alias("child"), F.col("own.copies").alias("copies"),
        F.explode(F.array_intersect("holders.place", F.try_element_at(listed, F.col("own.place")))).alias("parent"))
    counted = shared.groupBy("child", "parent").agg(F.count("*").alias("common"), F.sum("copies").alias("child_rows"))
    counts = {(row["child"], row["parent"]): (row["common"], row["child_rows"]) for row in counted.collect()}
    found = []
    for child, parent in pairs:
        own = counts.get((numbers[child], numbers[child]))
        if own and counts.get((numbers[child], numbers[parent]), (0,))[0] == own[0]:
            found.append((child[0], list(child[1]), parent[0], list(parent[1]), own[1]))
    return spark.createDataFrame(found, schema)
