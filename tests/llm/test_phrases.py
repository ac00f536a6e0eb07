import random
from collections import Counter, defaultdict

import pytest
from brute import lower
from pyspark.sql import functions as F

from lakestrata.llm.phrases import best, collocations, phrase_counts, scored, without_absorbed

BREAKS = ".,;:!?\n\x0b\x0c\r"
SCHEMA = "doc_id long, lang string, text string, phrase string, n int"


def pieces(text):
    text = lower(text)
    for sign in BREAKS:
        text = text.replace(sign, "\n")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in text.split("\n")]


def brute(docs, top=2000, least=5, percent=100, most=5):
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text, *_ in docs:
        lang = "und" if lang is None else lang
        for own in pieces(text):
            totals[lang] += len(own)
            for n in range(1, most + 1):
                counts[lang].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, own in counts.items():
        found = []
        frequent = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed, n=120):
    random.seed(seed)
    words = ["New", "york", "straße", "日本", "a", "b\x00", "c-d", "ünï", "e'f", " x"]
    docs = []
    for i in range(n):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", " ;", " "]) for _ in range(random.randrange(0, 25)))
        if i % 4 == 0:
            text += " One Fixed passage of many words "
        docs.append((i, random.choice(["en", "en", "de", None, "und", ""]), text, "x", 7))
    docs += [(500, "en", None, "x", 7), (501, None, "", "x", 7), (502, "en", " \t ...", "x", 7), (3, *docs[3][1:]), (None, "de", "new york new york", None, None)]
    docs.append((503, "en", "a b " * 20_000, "x", 7))
    return docs


@pytest.mark.parametrize("bits", [64, 9])
def test_as_brute_force(spark, bits):
    # with fingerprints of 9 bits nearly all phrases share theirs with others
    docs = sample(1)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert told(collocations(df, least_count=5, fingerprint_bits=bits)) == brute(docs)


def test_small_bitmaps_and_other_parameters(spark):
    docs = sample(2)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert told(collocations(df, top=4, percent=60, least_count=3, most_words=3, bits=8)) == brute(docs, top=4, least=3, percent=60, most=3)


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, "en", None, "", 1), (2, "en", "", "", 1)], SCHEMA)).collect() == []


def test_copies_and_a_word_of_a_third_of_all_rows(spark):
    docs = [(i, "en", "same words in all of these" if i % 3 else f"same words {i} and others {i}", "", 0) for i in range(300)]
    docs += [(1, "en", "same words in all of these", "", 0)] * 100
    assert told(collocations(spark.createDataFrame(docs, SCHEMA).repartition(4), least_count=20)) == brute(docs, least=20)


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_tasks_that_pass_on_early(spark, held):
    docs = sample(3)
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    expected = {(r.lang, r.phrase, r.n) for r in phrase_counts(df, least_count=5, most_held=held).collect()}
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text, *_ in docs:
        for own in pieces(text):
            totals[lang or ("und" if lang is None else "")] += len(own)
            for n in range(1, 6):
                counts["und" if lang is None else lang].update(" ".join(own[i : i + n]) for i in range(len(own) - n + 1))
    assert expected == {(lang, p, n) for lang, own in counts.items() for p, n in own.items() if n >= 5} | {(lang, "", n) for lang, n in totals.items() if n}


def test_products_beyond_64_bits_are_exact(spark):
    big = 4_000_000_000_000
    rows = [("en", "", 0, 9 * big), ("en", "x", 1, big + 7), ("en", "y", 1, big + 11), ("en", "x y", 2, big + 1)]
    found = scored(spark.createDataFrame(rows, "lang string, phrase string, words long, n long")).collect()
    assert [r.score for r in found] == [1000 * (big + 1) * 9 * big // ((big + 7) * (big + 11))]


def test_ties_of_cuts_and_ranks(spark):
    rows = [("en", "", 0, 1000), *(("en", w, 1, 10) for w in "abcd"), ("en", "a b", 2, 10), ("en", "b c", 2, 10), ("en", "a b c", 3, 10), ("en", "c d", 2, 10)]
    found = scored(spark.createDataFrame(rows, "lang string, phrase string, words long, n long"))
    kept = best(without_absorbed(found)).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in kept] == [(1, "a b c"), (2, "c d")]
    assert [r.l for r in found.filter(F.col("phrase") == "a b c").collect()] == [10]
