"""Chat transcripts: recent history, reply parts, reassembled replies, token rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletop.functions.time import seconds_between

# Fixed value: messages that a conversation keeps.
HISTORY_LENGTH = 20
_CHUNKS_PER_PIECE = 10_000
_SHARES = 256


def last_messages(
    messages: DataFrame, n: int = HISTORY_LENGTH, key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The last ``n`` messages of every conversation.

    The rank is bounded, so each task passes on at most ``n`` messages per conversation; one huge conversation does
    not meet in one task. Spark bounds ranks that way up to a setting; a larger ``n`` is first cut down in shares of
    each conversation, which are ranked in tasks of their own.
    """
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    if n > int(messages.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        share = Window.partitionBy(key, "_share").orderBy(F.col(order).desc())
        messages = messages.withColumn("_share", F.pmod(F.xxhash64(order), F.lit(_SHARES)))
        messages = messages.withColumn("_rank", F.row_number().over(share)).where(F.col("_rank") <= n).drop("_rank", "_share")
    return messages.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")


_BLANKS = " \t\r\n"


def _tagged(text: Column, tag: str) -> Column:
    """Contents of every closed ``<tag>`` and, if one is left open after them, what follows it so far."""
    block = rf"<{tag}>([\s\S]*?)</{tag}>"
    closed = F.regexp_extract_all(text, F.lit(block), F.lit(1))
    left_open = F.regexp_extract_all(F.regexp_replace(text, block, ""), F.lit(rf"<{tag}>([\s\S]*)$"), F.lit(1))
    return F.concat(closed, left_open)


def _without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "</?(query|comment)>", "")


def split_reply(replies: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``query`` and ``comment``, the parts of a reply so tagged; null where the tag does not occur.

    A reply that is still being written may lack a closing tag: its text so far counts. Further blocks of one reply
    follow in the same column after a blank line. Stray tags are removed from the parts.
    """
    whole = F.col(text)

    def part(tag: str) -> Column:
        return F.reduce(
            _tagged(whole, tag),
            F.lit(None).cast("string"),
            lambda before, block: F.concat_ws("\n\n", before, F.trim(_without_tags(block), F.lit(_BLANKS))),
        )

    return replies.withColumns({"query": part("query"), "comment": part("comment")})


def assemble(
    chunks: DataFrame,
    keys: list[str],
    order: str = "seq",
    token: str = "token",
    chunks_per_piece: int = _CHUNKS_PER_PIECE,
) -> DataFrame:
    """Chunks of a reply joined in order: one row per reply with its ``text``.

    ``order`` counts the chunks of a reply in integers. Runs of them are joined first, so that a reply with very many
    chunks is sorted in many tasks and only its pieces meet.
    """
    piece = F.floor(F.col(order) / F.lit(chunks_per_piece)).alias("_piece")
    joined = F.expr(f"listagg(`{token}`) WITHIN GROUP (ORDER BY `{order}`)")
    pieces = chunks.groupBy(*keys, piece).agg(joined.alias("_text"))
    return pieces.groupBy(*keys).agg(F.expr("listagg(_text) WITHIN GROUP (ORDER BY _piece)").alias("text"))


def token_rate(chunks: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Per reply ``tokens_generated``, ``time_seconds`` and ``tokens_per_second`` (the count where no time passed)."""
    counted = chunks.groupBy(*keys).agg(
        F.count("*").alias("tokens_generated"), F.min(time).alias("_first"), F.max(time).alias("_last")
    )

    elapsed = seconds_between(F.col("_first"), F.col("_last"))
    rate = F.when(elapsed > 0, F.round(F.col("tokens_generated") / elapsed, 1)).otherwise(
        F.col("tokens_generated").cast("double")
    )
    return counted.select(
        *keys, "tokens_generated", F.round(elapsed, 2).alias("time_seconds"), rate.alias("tokens_per_second")
    )
