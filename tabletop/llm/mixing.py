"""Mixing sources to target weights, in DataFrame operations only.

The words of a source form one stream, document after document, and the stream is packed into blocks of fixed length. A
source's target is its share of the mix by weight, limited to ``max_repeats`` times its size. It is met by whole passes
over its blocks and one partial pass; each pass goes through the blocks by a pseudorandom permutation of their indices
(multiplication by a number without a common divisor, and a shift), so the partial pass is an even draw. Every slot of a
source is dealt to one of the output shards by an even hash: the counts of a source over the shards are one multinomial
draw whose sum is the source's target. Slots then meet the blocks by index.

A source may hold most rows: its stream positions are sums within buckets of rows, shifted by sums over the buckets, and
its slots are listed in chunks. Only tables with one row a source or bucket pass through one task.

Defined results: a null text has size 0; null sources are one source, last in order; a document without words takes part
in nothing and takes 0. Repeated rows are separate documents. Rows with the same id are ordered by a hash of the text.
Positions follow a hash of id and text, hence reruns agree whatever the order of the rows. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletop.llm.common import stored

BLOCK_WORDS = 1024
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
_ROWS_A_BUCKET = 2000
_SLOTS_A_CHUNK = 4096
_CHUNKS_A_TASK = 64
# Primes from which the multiplier of a permutation is taken; at least one of them does not divide the number of blocks.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def word_count(text: Column) -> Column:
    """Number of stretches without blank or the control characters 9 to 13; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but maps and variants, which Spark cannot hash."""
    kept = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{name}`") for name in kept])


def measured(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id``, ``source``, ``size`` in words, hashes of the text and of the row; texts are read once."""
    return stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("text_hash"), row_hash(docs).alias("row_hash")), "mix")


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: ``source``, ``source_size`` and ``target``, the words the mix should take of it.

    Sources by code point, null last, have the weights in turn. A source is full if its share, were all sources with less
    room for their weight full too, is above its limit; the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "rank")
    below = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(below), F.lit(0.0)))
    return stored(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("limit", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("level", level / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
        .select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), "limit").alias("target"),
                F.col("rank").cast("bigint").alias("source_no")), "mix")


def positions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with what is known of the source, a row number ``row_no`` within bucket and the ``start`` in the stream."""
    buckets = max(1, sizes.count() // _ROWS_A_BUCKET)
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "size", "row_hash")
    rows = rows.withColumns({
        "row_no": F.row_number().over(within),
        "start": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    })
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = stored(sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("held").over(along) - F.col("held")).alias("shift")), "mix")
    rows = rows.join(sums, rows.source.eqNullSafe(sums.s) & (rows.bucket == sums.b)).drop("s", "b")
    named = sources.withColumnRenamed("source", "s")
    rows = rows.join(named, rows.source.eqNullSafe(named.s)).drop("s")
    return rows.withColumn("start", F.col("start") + F.col("shift")).drop("shift")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The parts of every document by block: ``block``, ``offset`` in the block, ``first`` word and ``words``."""
    size = F.lit(block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / size)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / size), last))
    low = F.greatest("start", F.col("block") * size)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    return placed.select("*", F.explode_outer(blocks).alias("block")).withColumns({
        "offset": low - F.col("block") * size, "first": low - F.col("start"), "words": high - low})


def slots(sources: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: ``shard``, ``source_no``, ``pass``, ``slot``, ``block`` and how many words it ``takes``."""
    size = F.lit(block_words).cast("bigint")
    blocks_of = lambda words: F.floor((words + size - 1) / size)
    facts = sources.where("source_size > 0").withColumns({
        "goal": F.round("target").cast("bigint"), "full": F.floor(F.col("source_size") / size)})
    facts = facts.withColumns({
        "whole": F.floor(F.col("goal") / F.col("source_size")), "left": F.col("goal") % F.col("source_size")})
    total = F.sum(F.col("whole") * blocks_of(F.col("source_size")) + blocks_of(F.col("left"))).over(Window.partitionBy())
    facts = facts.withColumn("shards", F.greatest(F.lit(1), F.floor(total / shard_slots)))
    passes = facts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).alias("pass"))
    passes = passes.withColumn("goal", F.when(F.col("pass") < F.col("whole"), F.col("source_size")).otherwise(F.col("left")))
    usable = F.filter(F.array(*[F.lit(p).cast("bigint") for p in _PRIMES]), lambda p: F.col("full") % p != 0)
    key = F.xxhash64(F.lit(seed), "source_no", "pass")
    passes = passes.where("goal > 0").withColumns({
        "factor": F.when(F.col("full") > 0, F.element_at(usable, (F.pmod(key, F.size(usable)) + 1).cast("int")) % F.col("full")),
        "shift": F.when(F.col("full") > 0, F.pmod(F.xxhash64(key), F.col("full"))),
        "slots": blocks_of(F.col("goal")),
    })
    chunk = F.lit(_SLOTS_A_CHUNK).cast("bigint")
    chunks = passes.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / chunk))).alias("chunk"))
    # A stated number of partitions: small rows that grow in the next step would else be merged into one task.
    words = sources.agg(F.sum("target")).first()[0] or 0
    tasks = 1 + int(words / block_words / (_SLOTS_A_CHUNK * _CHUNKS_A_TASK))
    chunks = chunks.repartition(tasks, "source_no", "pass", "chunk")
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * chunk) - 1
    dealt = chunks.select("*", F.explode(F.sequence(F.col("chunk") * chunk, last)).alias("slot"))
    mapped = (F.col("factor").cast("decimal(19,0)") * F.col("slot") + F.col("shift")) % F.col("full")
    return dealt.select(
        F.pmod(F.xxhash64(F.lit(seed), "source_no", "pass", "slot"), F.col("shards")).alias("shard"),
        "source_no", "pass", "slot",
        # The block that is not full stays last.
        F.when(F.col("slot") < F.col("full"), mapped.cast("bigint")).otherwise(F.col("full")).alias("block"),
        F.least(size, F.col("goal") - F.col("slot") * size).alias("takes"),
    )


def shard_counts(dealt: DataFrame) -> DataFrame:
    """Slots of every source in every output shard."""
    return dealt.groupBy("shard", "source_no").agg(F.count("*").alias("slots"))


def spans(placed: DataFrame, dealt: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes: a row for every part of a document and slot, with ``first`` word and number of ``words``.

    Parts that no slot takes have a null ``shard`` and 0 words, so that every document stays in sight.
    """
    parts = pieces(placed, block_words)
    inside = F.greatest(F.lit(0), F.least("words", F.col("takes") - F.col("offset")))
    # Spark takes what explodes from a few rows for small; the slots grow with the input and must not be broadcast.
    dealt = dealt.hint("merge")
    used = F.when(F.col("takes").isNotNull() & F.col("words").isNotNull(), inside).otherwise(0)
    return parts.join(dealt, ["source_no", "block"], "left").withColumn("words", used.cast("bigint"))


def mix(docs: DataFrame, seed: int = 7, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their positions and targets, and the spans that the mix takes of them."""
    sizes = measured(docs, **columns)
    sources = targets(sizes)
    placed = positions(sizes, sources)
    return placed, spans(placed, slots(sources, seed))


def taken_words(taken: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``size``, ``source_size``, ``target`` and the words ``taken``, repeats counted."""
    return taken.groupBy("source_no", "bucket", "row_no", "doc_id", "size", "source_size", "target").agg(
        F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The texts of the mix with the columns of ``docs``: one row for each pass in which a document is taken.

    A document that a pass takes in full keeps its text; of others the words taken are joined by blanks. Repeated rows are
    taken each on its own. Rows of one id and text that differ in other columns (maps and variants aside) keep their own.
    """
    key = ["doc_id", "text_hash", "row_hash"]
    parts = taken.where("words > 0").groupBy(*key, "size", "bucket", "row_no", "source_no", "pass").agg(
        F.sum("words").alias("_taken"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_parts"))
    parts = parts.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("row_hash").alias("_row"),
        F.col("size").alias("_size"), "_taken", "_parts")
    # One shuffle of the texts, by one key, serves both the removal of repeated rows and the join.
    parts = parts.withColumn("_key", F.xxhash64("_id", "_hash", "_row"))
    unique = docs.withColumns({"_text_hash": F.xxhash64("text"), "_row_hash": row_hash(docs)})
    unique = unique.withColumn("_row_key", F.xxhash64("doc_id", "_text_hash", "_row_hash"))
    unique = unique.repartition("_row_key").dropDuplicates(["_row_key", "doc_id", "_text_hash", "_row_hash"])
    # Not as equalities: the join would ask for a shuffle by all of them.
    same = (unique._row_key == parts._key) & (unique._text_hash.bitwiseXOR(parts._hash) == 0)
    same &= (unique._row_hash.bitwiseXOR(parts._row) == 0) & (F.coalesce(F.try_subtract(unique.doc_id, parts._id), F.lit(0)) == 0)
    rows = unique.join(parts.hint("merge"), same)
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    some = F.array_join(F.flatten(F.transform(
        "_parts", lambda part: F.slice(words, (part["first"] + 1).cast("int"), part["words"].cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
