import random

import numpy as np
import pytest
from brute import classes, near_links, shingles, words

from lakestrata.llm.components import components
from lakestrata.llm.ngram_join import common_counts, drop_near_copies, least_matches, likely_pairs, ngram_join, sketches


def sample(seed, groups=6, size=9):
    random.seed(seed)
    docs, i = [], 0
    for g in range(groups):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([30, 80, 200]))]
        for _ in range(size):
            own = list(base)
            for _ in range(random.randrange(0, 5)):
                own[random.randrange(len(own))] = f"n{random.randrange(10**6)}"
            docs.append((i, " ".join(own)))
            i += 1
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(i + k, passage + " " + " ".join(f"q{random.randrange(10**6)}" for _ in range(40))) for k in range(12)]
    return docs


EDGES = [
    (900, None), (901, ""), (902, "..."), (903, "one two"), (904, "ONE, two!"), (905, "one two three"), (906, "long " + "a b c d e f g " * 9000),
    (907, "LONG " + "a b c d e f g " * 9000), (908, "five words are one shingle"), (909, "Five words are one shingle"),
]


def expected(docs):
    texts = [text for _, text in docs]
    links = near_links(texts)
    root = classes(len(docs), links)
    degree = [0] * len(docs)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    largest = {}
    for k, (doc, _) in enumerate(docs):
        largest[root[k]] = max(largest.get(root[k], -1), doc)
    same = [sum(shingles(t) == shingles(text) for t in texts) if words(text) else 1 for text in texts]
    return sorted((doc, largest[root[k]], same[k], degree[k]) for k, (doc, _) in enumerate(docs))


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4)])
def test_as_brute_force(spark, seed, block):
    docs = sample(seed) + EDGES
    df = spark.createDataFrame([(d, t, 5, b"x") for d, t in docs], "doc_id long, text string, copies int, sketch binary").repartition(5)
    found = ngram_join(df, block=block)
    assert sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in found.collect()) == expected(docs)
    kept = [r.doc_id for r in found.filter("kept").collect()]
    assert sorted(kept) == sorted({x[1] for x in expected(docs)})


def test_one_of_each_class_stays(spark):
    docs = sample(3, groups=2, size=4) + EDGES
    rows = [(d, t, "s", 1) for d, t in docs] + [(908, "five words are one shingle", "s", 1)] * 2 + [(None, "null id text of seven whole words")]
    rows = [row if len(row) == 4 else (*row, "s", 1) for row in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, row1 string, one int")
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({*(x[1] for x in expected(docs)), None}, key=repr)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_group_of_copies_of_a_third_of_all_rows(spark):
    docs = [(i, "the same seven words in every copy" if i % 3 == 0 else " ".join(f"u{i}x{k}" for k in range(12))) for i in range(600)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[i] == ((597, 199) if i % 3 == 0 else (i, 0)) for i in range(600))


def test_components_as_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)] + [(0, k) for k in range(500, 700)]
    parent = list(range(800))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges for x in e if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_limits_of_the_posterior():
    limits = least_matches(0.8, 1e-9)
    assert [n for n, _ in limits] == [*range(16, 200, 16), 200]
    for n, least in limits:  # the mass of Beta(m + 1, n - m + 1) at and above 0.8, by sums
        x = np.linspace(0, 1, 200_001)
        for m, kept in ((least, True), (least - 1, False)):
            if m >= 0:
                log = m * np.log(np.maximum(x, 1e-300)) + (n - m) * np.log(np.maximum(1 - x, 1e-300))
                y = np.exp(log - log.max())
                assert (y[x >= 0.8].sum() / y.sum() >= 1e-9) == kept


def test_pruning_keeps_similar_pairs():
    random.seed(6)
    sets = []
    for _ in range(30):
        base = np.array(random.sample(range(1 << 60), 300), np.uint64)
        other = base.copy()
        other[:30] = np.array(random.sample(range(1 << 60), 30), np.uint64)
        sets += [base, other]
    values = np.concatenate([np.sort(x) for x in sets])
    first = np.arange(0, len(values) + 1, 300)
    from lakestrata.llm.words import mix

    sketch = sketches(mix(values), first)
    x, y = likely_pairs(sketch, sketch, True, least_matches(0.8, 1e-9))
    assert set(zip(x.tolist(), y.tolist())) == {(2 * k, 2 * k + 1) for k in range(30)}


def test_common_counts_both_ways():
    random.seed(7)
    sets = [np.unique(np.array([random.randrange(500) for _ in range(120)], np.uint64)) for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    true = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(x, y)]
    assert common_counts(x, y, sets, sets).tolist() == true  # many pairs: by matrices
    assert common_counts(x[:5], y[:5], sets, sets).tolist() == true[:5]
