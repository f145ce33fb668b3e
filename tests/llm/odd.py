"""Documents that are hard to handle: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox of the old house is in a garden by the sea " * 4000
ROWS = [
    (1, "The cat is on the mat and it is happy there with the dog.", "en", "a", 57),
    (2, "The cat is on the mat and it is happy there with the dog.", "en", "a", 57),
    (3, "Der Hund ist in dem Haus und die Katze ist nicht da, sagt er.", "de", "b", 61),
    (3, "Der Hund ist in dem Haus und die Katze ist nicht da, sagt er.", "de", "b", 61),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t ", None, "c", 4),
    (7, "12345 !!! ???", "de", None, 13),
    (8, LONG, "en", "a", len(LONG)),
    (9, "x", None, "c", 1),
    (None, "La casa es de la familia y el perro es de los vecinos.", "es", "c", 54),
    (11, "<|endoftext|> ΑΣ ﬁ é 🙂 don't", "en", "d", 29),
    (12, "El gato de la casa es de los vecinos y la familia.", "es", "c", 50),
]
CLASHING = [
    "score", "held_out", "ids", "decoded", "n_tokens", "n_words", "lang_pred", "lang_score", "statistics", "fingerprint",
    "n_spots", "class_id", "n_links", "size", "taken", "target", "block", "digest", "log_prob", "mean_log_prob", "part",
]


def documents(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit("other").alias(name) for name in CLASHING])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
