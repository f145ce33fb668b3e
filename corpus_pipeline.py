"""From raw documents to token ids: each stage's result is written as Parquet and is the next one's input.

Documents of low quality, of no clear language, and all but one of each class of near duplicates go; the rest is mixed by
source, and every text of the mix is encoded. Without labels the first stage keeps everything, without known languages the
second stage keeps nothing it cannot tell. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.llm import bpe, jaccard_join, language_id, mixing, quality
from tabletop.llm.common import stored
from tabletop.llm.queries import VOCABULARY
from tabletop.plans.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is predicted as 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    # Statistics are narrow: labels meet them instead of the texts.
    known = stored(quality.with_statistics(docs.select("doc_id", "text")).drop("text"), "quality")
    rules = quality.train(known.join(labels, "doc_id"))
    scored = quality.with_statistics(docs, column="_statistics")
    return scored.where(rules.score("_statistics") >= 0.5).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of at least one half; those without a letter go."""
    model = language_id.train(docs)
    found = language_id.identify(docs, model, lang="_lang", score="_score")
    return found.where((F.col("_lang") != language_id.UNDETERMINED) & (F.col("_score") >= 0.5)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, the one with the smallest id."""
    return jaccard_join.first_of_class(docs, jaccard_join.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, a row for each pass in which a document is taken."""
    _, taken = mixing.mix(docs)
    return mixing.mixed_texts(docs, taken)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
