"""Fingerprints of documents by spot signatures.

A spot is a common word (an anchor) with the chain of content words that follow it; anchors inside the chain are passed
over. The set of a text's hashed spots is its fingerprint: it depends on the prose around common words and not on layout.
Fingerprints are compared by the Jaccard similarity of their sets. ``similar`` finds all similar documents: sets are dealt to
partitions by length, so that two similar ones share a partition. Within it, the rarest spots of a set, as many as two
similar sets cannot both lack, list it; sets that share a list are compared, in blocks of bounded size, after lengths and
the places of the shared spot have pruned pairs that cannot reach the threshold.

``with_next`` walks documents by descending id. Rows are dealt to ranges of ids, each sorted by Spark and read as a stream;
the first row of a range is also sent to the end of the range before it, so that no row lacks its successor. Only the ends
of the ranges reach the driver, at most ``MAX_RANGES``.

Defined results: a null text is empty. Words are runs of letters and digits, lower-cased. A text without anchors has each
word as a spot; one without words has one spot, the text itself; the empty text has none, and its fingerprint is the empty
string. Equal texts have likeness 1, an empty and another one 0. Documents with equal ids follow each other by text; null
ids come last. A single document is its own successor. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import connected_components, portions, stored
from tabletop.llm.shingles import mixed, word_hashes

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au avec ce dans de du elle est et il la le les par pas pour que sur un une "
    "con del el en las lo los no por se su y"
).split()
CHAIN = 3
MAX_RANGES = 10_000
_ROWS_A_RANGE = 8000
_PORTION = 500_000


@cache
def _inner() -> np.ndarray:
    return np.array([chr(code).isalnum() for code in range(0x110000)])


@cache
def _anchors() -> np.ndarray:
    return np.sort(word_hashes(list(ANCHORS), _inner())[0])


def spot_sets(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted set of hashed spots of each text."""
    words, counts = word_hashes([text.lower() for text in texts], _inner())
    sets = []
    if len(words):
        anchors = _anchors()
        anchor = anchors[np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)] == words
        owner = np.repeat(np.arange(len(texts)), counts)
        content, content_owner = words[~anchor], owner[~anchor]
        at = np.flatnonzero(anchor)
        following = np.cumsum(~anchor)[at]
        spots = words[at]
        for step in range(chain):
            place = following + step
            within = place < len(content)
            place = np.minimum(place, max(0, len(content) - 1))
            if len(content):
                within &= content_owner[place] == owner[at]
                spots = mixed(spots * np.uint64(31) + np.where(within, content[place], np.uint64(0)))
        alone = np.bincount(owner[at], minlength=len(texts))[owner] == 0
        keys = np.concatenate([owner[at], owner[alone]]).astype(np.uint64) << np.uint64(32)
        hashes = (np.concatenate([spots, words[alone]]) >> np.uint64(32))
        sorted_keys = np.unique(keys | hashes)
        ends = np.searchsorted(sorted_keys >> np.uint64(32), np.arange(len(texts) + 1).astype(np.uint64))
        low = (sorted_keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        sets = [low[ends[i]:ends[i + 1]] for i in range(len(texts))]
    else:
        sets = [np.zeros(0, np.uint32)] * len(texts)
    for row, text in enumerate(texts):
        if text and not len(sets[row]):
            whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4]
            sets[row] = np.frombuffer(whole, ">u4").astype(np.uint32)
    return sets


def fingerprint(spots: np.ndarray) -> str:
    """The set as text: eight hexadecimal digits a spot, in order."""
    return spots.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 if their lengths alone keep it below ``least``. Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``fingerprint`` and ``n_spots``; every other column passes."""
    docs = docs.drop("fingerprint", "n_spots")
    schema = docs.select("*", F.lit("").alias("fingerprint"), F.lit(0).cast("bigint").alias("n_spots")).schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [value or "" for value in frame.column(text).to_pylist()]
            for start, end in portions(texts, _PORTION):
                sets = spot_sets(texts[start:end])
                more = [pa.array([fingerprint(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*frame.slice(start, end - start).columns, *more], schema.names)

    return docs.mapInArrow(run, schema)


def _pairs(rows: list[tuple], split: int, part: int, spot: int, least: float) -> Iterator[tuple[int, int]]:
    """Places of similar sets: the first ``split`` rows with the others or, if these are all, with later ones.

    A row has its bin, its prefix (rarest spots first) and its spots. A pair that shares several lists counts in the list of
    its first shared prefix spot, and of two partitions in that of the longer set.
    """
    for a in range(split):
        bin_a, prefix_a, spots_a = rows[a]
        for b in range(a + 1 if split == len(rows) else split, len(rows)):
            bin_b, prefix_b, spots_b = rows[b]
            if max(bin_a, bin_b) != part or min(len(spots_a), len(spots_b)) < least * max(len(spots_a), len(spots_b)) - 1e-9:
                continue
            common = set(prefix_b)
            if next(s for s in prefix_a if s in common) != spot:
                continue
            # Rarer spots than the shared one are not shared: what is left bounds the intersection.
            left = min(len(spots_a) - prefix_a.index(spot), len(spots_b) - prefix_b.index(spot))
            if left < least * (len(spots_a) + len(spots_b) - left) - 1e-9:
                continue
            if likeness(spots_a, spots_b) >= least - 1e-12:
                yield a, b


def similar(docs: DataFrame, least: float = 0.8, block_rows: int = 1000) -> DataFrame:
    """One row a document: ``doc_id``, ``class_id`` (the smallest id reached by links) and ``n_links``.

    Documents whose fingerprints are at least that similar are linked, those with equal ones always. Documents with the
    empty text, or a null id, link with nothing; the class of a null id is null.
    """
    rows = fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text")
    rows = stored(rows, "prints")
    unique = stored(rows.where("n_spots > 0 and doc_id is not null").groupBy("fingerprint").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_spots").alias("size")), "prints")
    spot = F.explode(F.transform(
        F.sequence(F.lit(0), (F.col("size") - 1).cast("int")),
        lambda i: F.conv(F.substring(F.col("fingerprint"), i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")))
    listed = stored(unique.select("rep", "size", spot.alias("spot")), "spots")
    often = stored(listed.groupBy("spot").agg(F.count("*").alias("often")), "spots")
    needed = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    prefix = listed.join(often.where("often > 1"), "spot", "right").groupBy("rep", "size").agg(
        F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("shared"))
    # Spots that no other set has come first and list nothing.
    alone = F.col("size") - F.size("shared")
    prefix = prefix.select("rep", "size", F.transform(
        F.slice("shared", 1, F.greatest(F.lit(0), needed - alone).cast("int")), lambda s: s["spot"]).alias("prefix"))
    bin_ = F.floor(F.log("size") / F.log(F.lit(1 / least)) + 1e-9)
    keyed = prefix.where(F.size("prefix") > 0).select(
        "rep", "prefix", bin_.alias("bin"), F.explode(F.array(bin_, bin_ + 1)).alias("part"))
    keyed = stored(keyed.select("*", F.explode("prefix").alias("spot")), "keyed")
    counts = keyed.groupBy("part", "spot").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = stored(counts.select("part", "spot", F.ceil(F.col("rows") / block_rows).alias("blocks")), "keyed")
    held = keyed.join(counts, ["part", "spot"]).join(unique.select("rep", "n", "fingerprint"), "rep")
    held = held.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    held = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    held = held.select("part", "spot", "rep", "n", "bin", "prefix", "fingerprint", "block",
                       F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(group: pa.Table) -> pa.Table:
        names = ("block", "rep", "n", "bin", "prefix", "fingerprint")
        members = sorted(zip(*(group.column(name).to_pylist() for name in names)))
        part, spot, x, y = (group.column(name)[0].as_py() for name in ("part", "spot", "x", "y"))
        sets = [(m[3], m[4], np.frombuffer(bytes.fromhex(m[5]), ">u4").astype(np.uint32)) for m in members]
        split = len(members) if x == y else sum(m[0] == x for m in members)
        links, roots = [0] * len(members), list(range(len(members)))

        def root(node: int) -> int:
            while roots[node] != node:
                roots[node] = roots[roots[node]]
                node = roots[node]
            return node

        for a, b in _pairs(sets, split, part, spot, least) if x == y or split < len(members) else ():
            links[a], links[b] = links[a] + members[b][2], links[b] + members[a][2]
            low, high = sorted((root(a), root(b)), key=lambda i: members[i][1])
            roots[high] = low
        linked = [i for i, count in enumerate(links) if count]
        return pa.table({
            "rep": pa.array([members[i][1] for i in linked], pa.int64()),
            "root": pa.array([members[root(i)][1] for i in linked], pa.int64()),
            "links": pa.array([links[i] for i in linked], pa.int64())})

    found = stored(held.groupBy("part", "spot", "x", "y").applyInArrow(compare, "rep bigint, root bigint, links bigint"), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = unique.join(counted, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    facts = stored(facts.select(
        F.col("fingerprint").alias("same"), F.coalesce("component", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "facts")
    able = F.col("doc_id").isNotNull() & (F.col("n_spots") > 0)
    joined = rows.join(facts, able & (rows.fingerprint == facts.same), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                         F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` with a range number ``part``, and copies (``is_copy``) of each range's first row in the range before."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    ranges = min(MAX_RANGES, ids.count() // _ROWS_A_RANGE + 1)
    # Bounds only spread the rows: a rough one does no harm.
    cuts = ids.where("doc_id is not null").stat.approxQuantile(
        "doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=bounds, inputCol="_key", outputCol="_part") if len(bounds) > 2 else None

    def numbered(df: DataFrame) -> DataFrame:
        df = df.withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
        df = cut.transform(df) if cut else df.withColumn("_part", F.lit(0))
        part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_part").cast("int"))
        return df.withColumn("part", part).drop("_key", "_part")

    firsts = [tuple(row) for row in numbered(ids).groupBy("part").agg(F.max("doc_id")).collect()]
    firsts.sort(reverse=True, key=lambda row: row[0])
    before = {part: firsts[place - 1][0] for place, (part, _) in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame(
        [(first, before[part]) for part, first in firsts], "head bigint, part int")
    # One row for each range: at most MAX_RANGES rows of two numbers are broadcast.
    copies = rows.join(F.broadcast(heads), rows.doc_id.eqNullSafe(heads["head"]))
    copies = copies.groupBy("part").agg(F.min("text").alias("text"))
    whole = numbered(rows).select("doc_id", "text", "part", F.lit(False).alias("is_copy"))
    return whole.unionByName(copies.select(
        F.lit(None).cast("bigint").alias("doc_id"), "text", "part", F.lit(True).alias("is_copy")))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and how alike they and the next document's are.

    Columns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    placed = _in_ranges(docs).repartition("part").sortWithinPartitions(
        F.col("part").desc(), "is_copy", F.col("doc_id").desc_nulls_last(), "text")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        """Ids of successive documents, and their texts with that of the successor of the last."""
        ids: list = []
        texts: list[str] = []
        held = 0
        for frame in frames:
            for doc_id, text, copy in zip(*(frame.column(name).to_pylist() for name in ("doc_id", "text", "is_copy"))):
                texts.append(text)
                held += len(text)
                if copy:
                    yield ids, texts
                    ids, texts, held = [], [], 0
                elif held > _PORTION and ids:
                    yield ids, texts
                    ids, texts, held = [doc_id], [text], len(text)
                else:
                    ids.append(doc_id)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in runs(frames):
            changed = [edited(text, after) for text, after in zip(texts, texts[1:])]
            own, other = spot_sets(texts), spot_sets(changed)
            same = [a == b for a, b in zip(texts, texts[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([len(text) for text in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in changed], pa.string()),
                pa.array([fingerprint(spots) for spots in own[:-1]], pa.string()),
                pa.array([fingerprint(spots) for spots in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([1.0 if equal else likeness(a, b) for equal, a, b in zip(same, own, own[1:])], pa.float64()),
            ], schema=schema)

    return placed.mapInArrow(run, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))
