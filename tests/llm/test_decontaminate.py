import random

import pytest
from brute import hits, near_places, words

from lakestrata.llm.decontaminate import (
    clean_documents, decontaminate, index_postings, is_contaminated, proximity_matches, query_blocks, term_counts,
)
from lakestrata.llm.common import new_folder
from pyspark.sql import functions as F

WORDS = ["the", "of", "Été", "x1", "and", "red", "blue", "Fox", "runs", "tree"]


def sample(seed):
    random.seed(seed)
    speak = lambda n: " ".join(random.choice(WORDS) + random.choice(["", ",", "."]) for _ in range(n))
    items = [(i, speak(random.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (3, "again " + speak(20))]
    docs = []
    for i in range(60):
        text = speak(random.randrange(0, 60))
        if i % 3 == 0:
            item = words(random.choice(items)[1])
            at = random.randrange(0, max(1, len(item) - 12))
            text += " " + " ".join(item[at : at + random.randrange(10, 30)]).upper() + " " + speak(10)
        docs.append((i, text))
    return docs + [(70, None), (71, ""), (72, speak(40) + " " + items[9][1] + " " + speak(20_000)), (5, docs[5][1]), (5, "other"), (None, items[5][1])], items


@pytest.mark.parametrize("seed,block_words", [(1, 1 << 21), (2, 40)])
def test_as_brute_force(spark, seed, block_words):
    docs, items = sample(seed)
    df = spark.createDataFrame([(d, t, 1, "m") for d, t in docs], "doc_id long, text string, position int, mark string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(df, bench, block_words=block_words).collect()), key=repr)
    assert found == sorted([(d, *hits(t, items)) for d, t in docs], key=repr)


@pytest.mark.parametrize("seed,block_words,slop", [(3, 1 << 21, 2), (4, 40, 0), (5, 100, 5)])
def test_proximity_as_brute_force(spark, seed, block_words, slop):
    docs, items = sample(seed)
    docs = [(d, t) for d, t in docs if len(t or "") < 20_000]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, slop=slop)
    places = near_places([t for _, t in docs], items, slop)
    expected = [(d, *hits(t, items), len(near), sorted({name for name, _ in near})) for (d, t), near in zip(docs, places)]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.n_near, list(r.near_items)) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert any(len(near) for near in places)


def test_clean_documents_stay_whole(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, item), (2, item + " filler" * 300), (3, "clean"), (4, None), (4, item)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, bad_id string")
    kept = clean_documents(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([docs[1], docs[2], docs[3]], key=repr)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c")]), ([(1, "a b c")], []), ([(1, "a b c")], [(1, None)]), ([], [])])
def test_empty_tables(spark, docs, items):
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()] == [(d, 3, 0, []) for d, _ in docs]
    assert found.filter(is_contaminated()).count() == 0


def test_proximity_matches(spark):
    item = "rare1 the the of rare2"
    docs = [(1, "a rare1 the of rare2"), (2, "rare1 the the of rare2"), (3, "rare1 " + "the " * 30 + "rare2"), (4, "the of")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("mark", F.xxhash64("text")).select("doc_id", "mark", "text")
    (queries,) = query_blocks(spark.createDataFrame([(9, item)], "item_id long, text string"), 13, 1000, "item_id", "text")
    counts = term_counts(rows, queries.known)
    indexed = [True] * (len(queries.known) + 1)
    import numpy as np

    index = index_postings(rows, queries.known, np.array(indexed), 13, new_folder(spark, "test-index"))
    found = {r.doc_id: (r.item_id, abs(r.off)) for r in proximity_matches(index, queries, counts, slop=2).collect()}
    assert found == {1: ("9", 1), 2: ("9", 0)}
