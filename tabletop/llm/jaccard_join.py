"""Join of documents by the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

Equal texts are one. The signature of a text is cut into trees; in each tree a signature is a path of hash values, and
two texts are candidates if they share a prefix of the path in some tree. The prefix starts at the full depth and is
shortened, level by level, until the probability that a pair at the threshold shares one reaches the target recall; more
similar pairs are found with a higher one. The nodes of the sorted tries at that depth are groups of equal prefixes, and
texts connected by them form a family. Within a family every pair is verified on its whole sets of n-grams: a family is
cut into blocks of bounded weight and each pair of blocks is one group of Spark's; small families travel together. A
group returns no pairs, only the number of links of each text and a spanning set of edges, from which Spark finds classes.

Defined results: words end at blanks and the characters 9 to 13, and count as they are written. A text of fewer words
than the n-gram has one n-gram, all its words. Null and empty texts, and texts without a word, link with nothing, and so do
rows with a null id, whose class is null. Repeated rows count as separate documents. A similarity at the threshold links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletop.llm.common import batches, connected_components, stored
from tabletop.llm.shingles import mixed, shingle_hashes

TREES = 20
DEPTH = 6
RECALL = 0.9999
BLOCK_SHINGLES = 300_000


def found_share(similarity: float, trees: int, prefix: int) -> float:
    """Probability that two texts share a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that reaches the target recall at the threshold, searched from the full depth down."""
    prefix = depth
    while prefix > 1 and found_share(threshold, trees, prefix) < recall:
        prefix -= 1
    if found_share(threshold, trees, prefix) < recall:
        raise ValueError("more trees are needed for this threshold and recall")
    return prefix


def _seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(count, 2)


def trie_nodes(texts: list[str | None], width: int, trees: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the hashed prefix in every tree, and the number of its n-grams."""
    shingles, counts = shingle_hashes(texts, width)
    nodes = np.zeros((len(texts), trees), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return nodes.view(np.int64), counts
    starts = (np.cumsum(counts) - counts)[filled]
    seeds = _seeds(trees * prefix)
    for tree in range(trees):
        path = np.full(len(filled), tree + 1, np.uint64)
        for level in range(prefix):
            factor, shift = seeds[tree * prefix + level]
            least = np.minimum.reduceat((shingles * (factor | np.uint64(1)) + shift) >> np.uint64(24), starts)
            path = mixed(path * np.uint64(0x9E3779B97F4A7C15) + least)
        nodes[filled, tree] = path
    return nodes.view(np.int64), counts


def signed(docs: DataFrame, width: int, trees: int, prefix: int) -> DataFrame:
    """``doc_id``, ``digest`` of the text, number of ``shingles`` and trie ``nodes``, for every document."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, "text", 1_000_000):
            nodes, counts = trie_nodes(frame.column("text").to_pylist(), width, trees, prefix)
            lists = pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, trees, dtype=np.int32), nodes.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), frame.column("digest"), pa.array(counts, pa.int64()), lists],
                ["doc_id", "digest", "shingles", "nodes"])

    return rows.mapInArrow(run, "doc_id bigint, digest string, shingles bigint, nodes array<bigint>")


def _intersections(sets: list[np.ndarray], first: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the first sets: how many elements it shares with every set. Elements of one set only are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, bit = owner[keep], number[inverse[keep]]
    bits = np.zeros((len(sets), max(1, -(-int(shared.sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    for row in range(first):
        filled = np.flatnonzero(bits[row])
        if len(filled) * 4 < bits.shape[1]:
            yield row, np.bitwise_count(bits[:, filled] & bits[row, filled]).sum(axis=1, dtype=np.int64)
        else:
            yield row, np.bitwise_count(bits & bits[row]).sum(axis=1, dtype=np.int64)


def verified(sets: list[np.ndarray], split: int, threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later ones that are similar enough; of two blocks, the first ``split`` sets with the others."""
    sizes = np.array([len(s) for s in sets])
    for row, shared in _intersections(sets, split):
        union = sizes + sizes[row] - shared
        similar = shared * threshold.denominator >= union * threshold.numerator
        similar[:row + 1 if split == len(sets) else split] = False
        yield row, np.flatnonzero(similar)


def _root(parents: list[int], node: int) -> int:
    while parents[node] != node:
        parents[node] = parents[parents[node]]
        node = parents[node]
    return node


def links(docs: DataFrame, families: DataFrame, width: int, threshold: float, block_shingles: int) -> DataFrame:
    """``rep``, ``root`` and ``links``, a row for each text that has links in a group.

    ``families`` has ``rep``, the ``first`` id and ``digest`` of its text, ``n`` copies, ``shingles`` and ``family``.
    """
    weights = families.groupBy("family").agg(F.sum("shingles").alias("weight"))
    weights = stored(weights.select(
        "family", F.ceil(F.col("weight") / block_shingles).alias("blocks"), "weight"), "families")
    total = weights.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    bundles = max(1, -(-total // block_shingles))
    members = families.join(weights, "family").select(
        "rep", "first", "digest", "n", "family", "blocks", F.pmod(F.xxhash64("rep"), "blocks").alias("block"))
    members = stored(members, "families")
    texts = docs.select(F.col("doc_id").alias("first"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    # Nothing bounds the members, so they are never broadcast: one way at every size.
    held = members.hint("merge").join(texts, ["first", "digest"])
    held = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    groups = held.select(
        "rep", "n", "family", "block", "text",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bundles))).otherwise(F.col("family")).alias("g"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("x"),
        F.greatest("block", "other").alias("y"))
    exact = Fraction(threshold).limit_denominator(1_000_000)

    def verify(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(name).to_pylist() for name in ("family", "block", "rep", "n", "text"))), key=lambda r: r[:3])
        rows = [row for row, before in zip(rows, [None, *rows]) if before is None or row[:3] != before[:3]]
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        hashes, counts = shingle_hashes([row[4] for row in rows], width)
        sets = [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]
        found, parents = [0] * len(rows), list(range(len(rows)))
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][0] == rows[start][0]:
                end += 1
            own = end - start
            alone = x < 0 or x == y
            split = own if alone else sum(row[1] == x for row in rows[start:end])
            # Of two blocks one may be empty; the other is compared with itself elsewhere.
            if alone and own > 1 or 0 < split < own:
                copies = np.array([row[3] for row in rows[start:end]])
                for row, others in verified(sets[start:end], split, exact):
                    if len(others):
                        found[start + row] += int(copies[others].sum())
                        for other in others.tolist():
                            found[start + other] += int(copies[row])
                            a, b = _root(parents, start + row), _root(parents, start + other)
                            parents[max(a, b)] = min(a, b)
            start = end
        linked = [i for i, count in enumerate(found) if count]
        return pa.table({
            "rep": pa.array([rows[i][2] for i in linked], pa.int64()),
            "root": pa.array([rows[_root(parents, i)][2] for i in linked], pa.int64()),
            "links": pa.array([found[i] for i in linked], pa.int64())})

    return groups.groupBy("g", "x", "y").applyInArrow(verify, "rep bigint, root bigint, links bigint")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
    block_shingles: int = BLOCK_SHINGLES, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id``, ``class_id`` (the smallest id reached by links) and ``n_links``."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    prefix = prefix_length(threshold, trees, depth, recall)
    rows = stored(signed(docs, width, trees, prefix), "signed")
    worded = rows.where("shingles > 0 and doc_id is not null")
    # Different texts may have one id, so a text is known by a number of its own, given once in files.
    unique = stored(worded.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("shingles").alias("shingles"),
        F.max("nodes").alias("nodes")).withColumn("rep", F.monotonically_increasing_id()), "unique")
    listed = unique.select("rep", F.explode("nodes").alias("node"))
    met = stored(listed.groupBy("node").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "nodes")
    edges = listed.join(met, "node").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    families = connected_components(edges, "families")
    families = families.union(families.select(F.col("component").alias("node"), "component").distinct())
    families = stored(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    members = unique.drop("nodes").join(families, "rep")
    found = stored(links(docs, members, width, threshold, block_shingles), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "classes")
    groups = groups.union(groups.select(F.col("component").alias("node"), "component").distinct())
    groups = stored(groups.withColumnRenamed("node", "rep").join(unique.select("rep", "first"), "rep"), "classes")
    lowest = stored(groups.groupBy("component").agg(F.min("first").alias("class_id")), "classes")
    groups = stored(groups.join(lowest, "component").select("rep", "class_id"), "classes")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = unique.drop("nodes").join(counted, "rep", "left").join(groups, "rep", "left")
    facts = stored(facts.select(
        F.col("digest").alias("same"), F.coalesce("class_id", "first").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "facts")
    able = (F.col("shingles") > 0) & F.col("doc_id").isNotNull()
    joined = rows.select("doc_id", "digest", "shingles").join(facts, able & (F.col("digest") == F.col("same")), "left")
    return joined.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def first_of_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class: the rows of ``docs`` whose id is the class, each once; rows with a null id all stay.

    What goes and what is there more than once is told by ids alone; the texts meet only those ids.
    """
    told = stored(classes.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("class_id") == F.col("doc_id")).alias("first"), F.count("*").alias("rows")), "classes")
    odd = stored(told.where("not first or rows > 1").select(F.col("doc_id").alias("_odd")), "classes")
    again = stored(told.where("first and rows > 1").select(F.col("doc_id").alias("_again")), "classes")
    once = docs.join(odd, docs.doc_id == odd["_odd"], "left_anti")
    repeated = docs.join(again, docs.doc_id == again["_again"], "left_semi")
    repeated = repeated.withColumn("_digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return once.union(repeated.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))
