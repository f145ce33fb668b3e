import random

import odd
import pytest

from tabletop.llm import jaccard_join as J
from tabletop.llm import shingles


def sets(texts, width=5):
    found = []
    for text in texts:
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        found.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return found


def brute(docs, threshold=0.8):
    """Class and links of every (id, text) by comparing all pairs of whole sets."""
    grams = sets([text for _, text in docs])
    links, groups = [0] * len(docs), [{i} for i in range(len(docs))]
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12 and None not in (docs[i][0], docs[j][0]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                joined = groups[i] | groups[j]
                for k in joined:
                    groups[k] = joined
    return sorted(((d[0], min((docs[k][0] for k in groups[i]), key=lambda x: (x is None, x)), links[i]) for i, d in enumerate(docs)), key=repr)


def corpus():
    source = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(30):
        text = [source.choice(words) for _ in range(source.randint(8, 120))]
        for _ in range(source.randint(1, 8)):
            copy = list(text)
            for _ in range(source.choice([0, 0, 1, 1, 2, 3])):
                copy[source.randrange(len(copy))] = source.choice(words)
            docs.append((len(docs), " ".join(copy)))
    return docs


def found(spark, docs, **options):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, family string")
    return sorted(map(tuple, J.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("block_shingles", [60, 300_000])
def test_against_brute_force(spark, block_shingles):
    """Families in one group and, with small blocks, in many."""
    docs = corpus()
    assert found(spark, docs, block_shingles=block_shingles) == brute(docs)


@pytest.mark.parametrize("block_shingles", [60, 300_000])
def test_different_texts_of_one_id(spark, block_shingles):
    """Each text keeps its links; ids say only what the class is called."""
    docs = [(i // 3, text) for i, (_, text) in enumerate(corpus())]
    assert len(set(docs)) > len({i for i, _ in docs})
    assert found(spark, docs, block_shingles=block_shingles) == brute(docs)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = J.near_duplicates(docs)
    assert sorted(map(tuple, rows.collect()), key=repr) == brute([row[:2] for row in odd.ROWS])
    kept = J.first_of_class(docs, rows)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 11, 12, 3, 4, 5, 6, 7, 8, 9, None]
    assert J.near_duplicates(odd.nothing(spark)).count() == 0


def test_prefix_length():
    for trees, depth, threshold in ((20, 6, 0.8), (50, 10, 0.8), (30, 8, 0.9)):
        prefix = J.prefix_length(threshold, trees, depth)
        assert J.found_share(threshold, trees, prefix) >= J.RECALL
        assert prefix == depth or J.found_share(threshold, trees, prefix + 1) < J.RECALL
    with pytest.raises(ValueError):
        J.prefix_length(0.1)


def test_share_of_found_pairs_is_as_promised():
    source, met = random.Random(1), 0
    for _ in range(60):
        common = [f"c{source.random()}" for _ in range(90)]
        texts = [" ".join(common), " ".join(common[:82] + ["x", "y", "z"])]
        nodes, _ = J.trie_nodes(texts, 5, 8, 4)
        met += bool((nodes[0] == nodes[1]).any())
    a, b = sets(texts)
    assert met / 60 > J.found_share(len(a & b) / len(a | b), 8, 4) - 0.1


def test_shingles():
    texts = ["a b c d e f", "a b c d e", None, "", " a  b\tc\nd e ", "f", "a b", " x y"] + ["q " * 50]
    hashes, counts = shingles.shingle_hashes(texts, 5)
    assert counts.tolist() == [2, 1, 0, 0, 1, 1, 1, 1, 46]
    assert hashes[0] == hashes[2] == hashes[3] and len(set(hashes.tolist())) == 6
    alone = [h for text in texts for h in shingles.shingle_hashes([text], 5)[0].tolist()]
    assert alone == hashes.tolist()
