import math
import random

import pytest
from brute import words

from lakestrata.llm.licenses import ANCHORS, BASE, TEMPLATES, Template, base, license_scan

SCHEMA = "doc_id long, text string, words string, hits int"


def brute(docs, templates=TEMPLATES, anchors=ANCHORS):
    own = [words(text) for _, text, *_ in docs]
    weight = {}
    for word in {w for t in templates for w in t.words}:
        weight[word] = math.floor(1000 * math.log((len(docs) + 1) / (sum(word in set(x) for x in own) + 1))) + 1
    out = []
    for (doc, *_), said in zip(docs, own):
        places, bases, labels, score = [], set(), set(), 0
        for t in templates:
            order = sorted(range(len(t.words)), key=lambda i: (-weight[t.words[i]], i))[: None if t.base else anchors]
            total = sum(weight[t.words[i]] for i in order)
            for shift in range(-len(t.words), len(said)):
                met = sum(weight[t.words[i]] for i in order if 0 <= shift + i < len(said) and said[shift + i] == t.words[i])
                if not met:
                    continue
                share = 1_000_000 * met // total
                score = max(score, share)
                key = t.key_words
                at = shift + t.key_place
                whole = at >= 0 and said[at : at + len(key)] == key
                if whole and t.base:
                    places.append(shift)
                    bases.add(t.label)
                if whole and (t.base or share >= 500_000):
                    labels.add(t.label)
        out.append((doc, len(said), len(places), min(places, default=None), max(places, default=None), sorted(bases), sorted(labels), score / 1e6))
    return sorted(out, key=repr)


def told(df):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def sample(seed, n=150):
    random.seed(seed)
    pool = [t.text for t in TEMPLATES] + ["licensed under", "the", "license", "Some other words", "CC-BY", "apache  License,", "mit\nlicense", "gnu general public", "日本 é"]
    docs = [(i, " ".join(random.choice(pool) for _ in range(random.randrange(0, 6))), "x", 1) for i in range(n)]
    docs += [(900, None, "x", 1), (901, "", "x", 1), (902, "cc by " * 3000 + "cc cc by by", "x", 1), (903, "public license version 3", "x", 1)]
    docs += [(None, "MIT License", None, None), (None, "MIT License", None, None), (3, docs[3][1], "x", 1), (904, "by license", "x", 1), (905, "general public license version 3 x gnu", "x", 1)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    docs = sample(seed)
    assert told(license_scan(spark.createDataFrame(docs, SCHEMA).repartition(4))) == brute(docs)


@pytest.mark.parametrize("anchors", [1, 2])
def test_few_anchors(spark, anchors):
    docs = sample(3, 60)
    assert told(license_scan(spark.createDataFrame(docs, SCHEMA), anchors=anchors)) == brute(docs, anchors=anchors)


def test_repeated_words_in_a_phrase(spark):
    own = (base("aa", "a a"), base("aba", "a b a"), Template("t", "x a a y a", "a y a"))
    docs = [(i, text, "", 0) for i, text in enumerate(["a a a a", "a b a b a", "x a a y a", "a y a", "b", "x a a y", ""])]
    assert told(license_scan(spark.createDataFrame(docs, SCHEMA), own)) == brute(docs, own)


def test_empty_table_and_no_templates(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_license_in_a_third_of_all_rows(spark):
    docs = [(i, "Released under the MIT License." if i % 3 == 0 else f"word {i}", "", 0) for i in range(600)]
    assert told(license_scan(spark.createDataFrame(docs, SCHEMA).repartition(3), BASE)) == brute(docs, BASE)


def test_no_python_in_the_plan(spark):
    found = license_scan(spark.createDataFrame(sample(1, 10), SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
