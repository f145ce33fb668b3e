"""Column expressions for sizes, names and text forms of values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIB, MIB, GIB = 1024, 1024**2, 1024**3


def size_text(size: Column) -> Column:
    """Byte count as text: whole bytes, one digit for KB and MB, two digits for GB.

    ``bround`` first, because ``format_string`` alone rounds exact ties up instead of to the even digit.
    """
    size = size.cast("bigint")

    def scaled(unit: int, digits: int, name: str) -> Column:
        return F.format_string(f"%.{digits}f {name}", F.bround(size / F.lit(float(unit)), digits))

    return (
        F.when(size < KIB, F.format_string("%d B", size))
        .when(size < MIB, scaled(KIB, 1, "KB"))
        .when(size < GIB, scaled(MIB, 1, "MB"))
        .when(size.isNotNull(), scaled(GIB, 2, "GB"))
    )


def clean_names(names: Iterable[str], reserved: Iterable[str] = ()) -> list[str]:
    """Trimmed names, blanks as ``_``, reserved words with suffix ``_col``; clashes are an error."""
    words = {word.upper() for word in reserved}
    cleaned = [str(name).strip().replace(" ", "_") for name in names]
    cleaned = [f"{name}_col" if name.upper() in words else name for name in cleaned]
    lowered = [name.lower() for name in cleaned]
    clashes = sorted({name for name in lowered if lowered.count(name) > 1})
    if clashes:
        raise ValueError(f"column names clash after cleaning: {', '.join(clashes)}")
    return cleaned


def value_kind(schema_text: Column) -> Column:
    """Top-level type of a document value, from the text ``schema_of_variant`` gives.

    Nested shapes are folded to ``dict`` / ``list`` so that the set of kinds stays small whatever the data holds.
    """
    # Type names shown to the user, which users know from Python.
    kinds = [
        ("VOID", "NoneType"),
        ("BOOLEAN", "bool"),
        ("BIGINT", "int"),
        ("DECIMAL", "float"),
        ("DOUBLE", "float"),
        ("FLOAT", "float"),
        ("STRING", "str"),
        ("ARRAY", "list"),
        ("OBJECT", "dict"),
        ("DATE", "date"),
        ("TIMESTAMP", "datetime"),
        ("BINARY", "bytes"),
    ]
    head = F.regexp_extract(schema_text, "^([A-Z]+)", 1)
    pairs = F.create_map(*[F.lit(text) for pair in kinds for text in pair])
    return F.coalesce(F.try_element_at(pairs, head), F.lower(head))


def plain_text(name: str, data_type: T.DataType) -> Column:
    """A column as plain text for row exports; nested values become JSON text."""
    value = F.col(f"`{name}`")
    if isinstance(data_type, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(value)
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    return value.cast("string")
