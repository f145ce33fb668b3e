import random
import re

import odd
import pytest
from checker import compare, connect
from pyspark.sql import functions as F

from tabletop.llm import phrase_index as P
from tabletop.llm.queries import CHECKS, op11_decontamination

ITEMS = "item_id bigint, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda letter: letter.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, width=10, slack=2):
    """Words hit, items and items nearby, by looking at every place of every text."""
    rows = []
    for doc_id, text in docs:
        own, hit, exact, near = words(text), set(), set(), set()
        for item, phrase in items:
            test = words(phrase)
            span, name = min(width, len(test)), "" if item is None else str(item)
            for at in range(len(test) - span + 1) if test else ():
                window = test[at:at + span]
                for start in range(-slack, len(own) + slack):
                    if own[max(start, 0):start + span] == window and start >= 0:
                        hit |= set(range(start, start + span))
                        exact.add(name)
                    if all(word in own[max(start + k - slack, 0):max(start + k + slack + 1, 0)] for k, word in enumerate(window)):
                        near.add(name)
        rows.append((doc_id, len(own), len(hit), sorted(exact), sorted(near)))
    return sorted(rows, key=repr)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(*doc, "x") for doc in docs], "doc_id bigint, text string, segment string")
    items = spark.createDataFrame([(*item, "x") for item in items], ITEMS + ", term string")
    return sorted(map(tuple, P.contamination(docs, items, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"width": 4, "slack": 0}, {"width": 3, "slack": 1, "segment_chars": 200, "part_words": 30}])
def test_against_brute_force(spark, options):
    random.seed(len(options))
    text = lambda most: " ".join(random.choice("a b c d the of É 7".split()) for _ in range(random.randrange(most)))
    items = [(i, text(25)) for i in range(20)] + [(None, "the of the"), (3, "the of the"), (50, ""), (51, None), (52, "É, A! \x00 b")]
    docs = [(i // 2, text(40)) for i in range(60)] + [(None, text(30)), (None, text(30)), (7, None), (7, ""), (8, "... !")]
    docs += [(100 + i, f"{text(9)} {items[i][1]} {text(9)}".upper()) for i in range(20)] * 2
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("width", 10), options.get("slack", 2))


def test_words_moved_by_little_are_near(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = [(1, phrase), (2, phrase.replace("three four", "four three")), (3, phrase.replace("five", "and five so")),
            (4, phrase.replace("five", "a b c d e five")), (5, "two " + phrase[8:]), (6, "ten nine eight seven six five four three two one")]
    rows = {row[0]: (row[2], row[3], row[4]) for row in found(spark, docs, [(9, phrase)])}
    assert rows[1] == (10, ["9"], ["9"]) and rows[2] == (0, [], ["9"]) and rows[3] == (0, [], ["9"])
    assert rows[4] == rows[5] == rows[6] == (0, [], [])
    with pytest.raises(ValueError):
        P.matches(None, None, slack=32)


def test_matches_tell_their_places(spark):
    index = P.stored(P.build(spark.createDataFrame([(1, "x a b c d y"), (2, "a b c")], "doc_id bigint, text string")), "index")
    items = spark.createDataFrame([(1, "a b c d"), (2, "b")], ITEMS)
    rows = P.matches(index, items, width=3, slack=0).where("not near").join(P.texts_of(index), ["segment", "place"])
    assert sorted((r.doc_id, r.item, r.start, r.end) for r in rows.collect()) == [(1, "1", 1, 5), (1, "2", 2, 3), (2, "1", 0, 3), (2, "2", 1, 2)]
    listed = index.where("term is not null")
    assert {bytes(r.term): r.n for r in listed.groupBy("term").agg(F.sum("n").alias("n")).collect()}[b"a"] == 2


def test_odd_tables(spark, small):
    docs, nothing = odd.documents(spark), spark.createDataFrame([], ITEMS)
    rows = P.contamination(docs, nothing).collect()
    assert len(rows) == len(odd.ROWS) and all(row.n_hit == 0 and row["items"] == [] for row in rows)
    items = spark.createDataFrame([(1, odd.ROWS[0][1]), (1, odd.ROWS[0][1]), (2, odd.LONG), (3, " . ")], ITEMS)
    by_id = {row.doc_id: row for row in P.contamination(docs, items).collect()}
    assert by_id[8].n_hit == by_id[8].n_words == 15 * 4000 and by_id[1]["items"] == ["1"] and by_id[4].n_words == 0
    assert P.contamination(odd.nothing(spark), items).collect() == []


def test_query(spark, small):
    result = op11_decontamination(spark, small).toArrow()
    assert compare(result, connect(small).sql(CHECKS["op11_decontamination"]).to_arrow_table()) == []
    assert sum(result.column("contaminated").to_pylist()) >= 3
