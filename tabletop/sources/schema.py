"""Types of text columns, found from the data, and tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletop.functions.text import clean_names

# The words that ANSI mode of Spark SQL can reserve.
RESERVED_WORDS = """
    ALL AND ANY AS AUTHORIZATION BOTH CALL CASE CAST CHECK COLLATE COLLATION COLUMN CONSTRAINT CREATE
    CROSS CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER DISTINCT ELSE END ESCAPE EXCEPT
    EXECUTE FALSE FETCH FILTER FOR FOREIGN FROM FULL GRANT GROUP HAVING IN INNER INTERSECT INTO IS JOIN
    LATERAL LEADING LEFT NATURAL NOT NULL OFFSET ON ONLY OR ORDER OUTER OVERLAPS PRIMARY RECURSIVE
    REFERENCES RIGHT SELECT SESSION_USER SOME SQL TABLE THEN TIME TO TRAILING UNION UNIQUE UNKNOWN USER
    USING WHEN WHERE WITH WITHIN
""".split()

# Tried in this order; the first type that keeps every value wins.
_TYPES = [
    T.LongType(), T.DecimalType(38, 0), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.TimestampType()
]
_LONG, _WHOLE, _DOUBLE, _BOOLEAN, _DATE, _TIMESTAMP, _MOMENT = (1 << i for i in range(len(_TYPES)))


def _fitting_types(text: Column) -> Column:
    """Bit set of the types that keep a text's value. Its shape tells which casts to try: one that fails is costly.

    Leading zeros and signs that a number would lose, digits that a double cannot hold, more than six digits of a second
    and the empty text keep a column text; a moment with an offset is no local time.
    """
    def fits(kind: str, bits: int) -> Column:
        return F.when(text.try_cast(kind).isNotNull(), bits).otherwise(0)

    day, time = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{2}(:\d{1,2}(\.\d{1,6})?)?"
    digits = F.length(F.regexp_replace(F.regexp_replace(text, r"[eE].*$|[-.]", ""), r"^0+", ""))
    kept = (digits <= 15) | (text.try_cast("double").cast("string") == text)
    return (
        F.when(text.rlike(r"^(0|-?[1-9]\d{0,14})$"), F.lit(_LONG | _WHOLE | _DOUBLE))
        .when(text.rlike(r"^-?[1-9]\d{0,37}$"), F.lit(_WHOLE).bitwiseOR(fits("bigint", _LONG)))
        .when(text.rlike(r"^-?(0|[1-9]\d*)?(\.\d+|(\.\d*)?[eE][+-]?\d+)$"), F.when(kept, F.lit(_DOUBLE)).otherwise(0))
        .when(F.lower(text).isin("true", "false"), F.lit(_BOOLEAN))
        .when(text.rlike(f"^{day}$"), fits("date", _DATE | _TIMESTAMP))
        .when(text.rlike(rf"^{day}[ T]{time}$"), fits("timestamp_ntz", _TIMESTAMP))
        .when(text.rlike(rf"^{day}[ T]{time} ?(Z|[+-]\d{{2}}(:?\d{{2}})?)$"), fits("timestamp", _MOMENT))
        .otherwise(F.lit(0))
    )


def infer_schema(df: DataFrame) -> T.StructType:
    """Column names fit for a table and, for text columns, the narrowest type that keeps every value.

    One aggregation over the whole input decides all columns.
    """
    names = clean_names(df.columns, RESERVED_WORDS)
    texts = [i for i, field in enumerate(df.schema.fields) if isinstance(field.dataType, T.StringType)]
    facts = {}
    if texts:
        # One row per value: the check is compiled once, however many columns there are.
        values = df.select(F.posexplode(F.array(*[F.col(f"`{df.columns[i]}`") for i in texts])).alias("column", "text"))
        filled = values.where("text is not null").select("column", _fitting_types(F.col("text")).alias("bits"))
        found = filled.groupBy("column").agg(F.bit_and("bits").alias("bits")).collect()
        facts = {texts[row["column"]]: row["bits"] for row in found}

    fields = []
    for i, (name, field) in enumerate(zip(names, df.schema.fields)):
        data_type = field.dataType
        if facts.get(i):
            data_type = next(typ for bit, typ in enumerate(_TYPES) if facts[i] >> bit & 1)
        fields.append(T.StructField(name, T.StringType() if isinstance(data_type, T.NullType) else data_type))
    return T.StructType(fields)


def create_table(spark: SparkSession, name: str, schema: T.StructType, using: str | None = "parquet") -> None:
    """An empty table; ``using=None`` for a table of an attached database, where the vendor decides the format."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    spark.sql(f"CREATE TABLE {name} ({columns})" + (f" USING {using}" if using else ""))
