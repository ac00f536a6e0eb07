import random
import re

import numpy as np
import pytest

from lakestrata.llm.toxicity import BASE_SCORE, DISGUISED, labelled_rows, learn_lexicon, letter_model, precision, remember_for, restore, restored_words, toxicity
from pyspark.sql import functions as F

BAD = ["idiot", "moron", "scum", "worthless", "vermin"]
PLAIN = "the of and window garden letter paper river stone little house again under water summer winter music".split()


def speak(n):
    return " ".join(random.choice(PLAIN) for _ in range(n))


def corpus(seed, n=400):
    random.seed(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        own = speak(random.randrange(8, 60)).split()
        if toxic:
            own.insert(random.randrange(len(own)), random.choice(BAD))
        docs.append((i, " ".join(own) + f" own{i}"))
        labels.append((i, int(toxic)))
    return docs, labels


DISGUISES = ["id1ot", "1d10t", "m0r0n", "m o r o n", "m.o.r.o.n", "sc*m", "w0rthle$$", "moooorooon", "IDIIIIOT", "v3rm1n", "t h e g a r d e n m o r o n w a t e r", " ".join("thegardenletterpaperriverstonelittlehousemoronagainwater")]


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus(1)
    more = [(1000 + k, f"{speak(12)} {x} {speak(9)}") for k, x in enumerate(DISGUISES)]
    edges = [
        (2000, None), (2001, ""), (2002, "!!! 123 a-b c3po x86 10.0.0.1 e3b3ed3cc8 +1 (638) 555"), (2003, speak(50_000)),
        (2004, speak(40_000) + " moron"), (None, "moron"), (0, docs[0][1]), (2005, "a b c d e f g h"),
    ]
    rows = [(d, t, "x", 0.5) for d, t in docs + more + edges]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, text_to_score double").repartition(3)
    known = spark.createDataFrame(labels + [(5000, 1), (None, 1), (2001, None)], "doc_id long, toxic int")
    result = toxicity(df, known)
    assert result.columns == [*df.columns, "score"]
    return docs, dict(labels), result.collect()


def test_plain_words_on_held_out_rows(scored, spark):
    _, labels, rows = scored
    from zlib import crc32

    held = [r for r in rows if r.doc_id in labels and crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80
    assert all((r.score >= 0.7) == bool(labels[r.doc_id]) for r in held)


def test_disguised_words_are_found_and_clean_text_is_not(scored):
    rows = {r.doc_id: r.score for r in scored[2]}
    assert [x for k, x in enumerate(DISGUISES) if rows[1000 + k] < 0.7] == []
    assert all(rows[k] < 0.7 for k in (2000, 2001, 2002, 2003, 2005)) and rows[2004] >= 0.7 and rows[None] >= 0.7
    assert rows[2000] == rows[2001] == pytest.approx(BASE_SCORE)
    assert len(scored[2]) == 400 + len(DISGUISES) + 8


def test_viterbi_is_the_best_of_all_ways(spark):
    texts = spark.createDataFrame([(speak(30) + " ".join(BAD),) for _ in range(20)], "text string")
    model = letter_model(texts)
    from itertools import product

    from lakestrata.llm.toxicity import code, lattice

    for stretch in ("m0r0n", "1d1ot", "s c u m", "mooron", "$c*m"):
        best = None
        for way in product(*lattice(stretch)):
            word, cost = "".join(w for w, _ in way), sum(c for _, c in way)
            a = b = 0
            score = -cost
            for letter in word:
                score, a, b = score + model[a, b, code(letter)], b, code(letter)
            score += model[a, b, 0]
            best = max(best or (score, word), (score, word), key=lambda x: x[0])
        assert restore(stretch, model) == best[1]


def test_spelt_sentences_fall_into_words(spark):
    random.seed(9)
    texts = spark.createDataFrame([(speak(60) + " idiot moron",) for _ in range(50)], "text string")
    model = letter_model(texts)
    remember_for(model)
    said = "the house under water moron river stone garden music summer little again the house"
    spelt = " ".join(said.replace(" ", ""))
    assert len(spelt) > 64 and "moron" in restored_words("x " + spelt + ". y", model)
    assert restored_words("e3b3ed3cc8548923d6" * 9, model) == []


def test_letter_model_counts_all_rows(spark):
    texts = spark.createDataFrame([("ab",)] * 3 + [("Ab c",), (None,), ("",)], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    model = letter_model(texts.repartition(2))
    assert model.shape == (29, 29, 29) and np.allclose(np.exp(model).sum(2), 1)
    assert model[0, 1, 2] > model[0, 1, 3]


def test_labels_held_out_or_null_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(60)] + [(1, 0)], "doc_id long, toxic int")
    from zlib import crc32

    ids = [i for i in range(60) if i % 5 and crc32(str(i).encode()) % 3 != 1]
    rows = labelled_rows(docs, labels, "toxic", 1000, "doc_id", "text")
    assert sorted((r.doc_id, r.label) for r in rows.collect()) == [(i, i % 2) for i in ids]
    assert labelled_rows(docs, labels, "toxic", 7, "doc_id", "text").count() == 7


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [pytest.approx(BASE_SCORE)]
    assert toxicity(docs.limit(0), none).collect() == []


def test_copies_count_once(spark):
    """A word that only many copies of one toxic text share is not a toxic word."""
    random.seed(3)
    base = speak(40) + " moron zebra"
    rows = [(i, 1, base) for i in range(30)] + [(100 + i, 1, speak(30) + " moron") for i in range(30)] + [(200 + i, 0, speak(30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    model = letter_model(df.select("text"))
    hashes, _ = learn_lexicon(df, model)
    import pyarrow as pa

    from lakestrata.llm.words import words_of

    known = set(hashes.tolist())
    assert words_of(pa.array(["moron"])).hashes[0] in known
    assert words_of(pa.array(["zebra"])).hashes[0] not in known


def test_precision_is_a_lower_bound():
    assert precision(np.array([3.0]), np.array([0.0]))[0] < precision(np.array([50.0]), np.array([0.0]))[0] < 1
    assert precision(np.array([5.0]), np.array([5.0]))[0] < 0.5


def test_stretches():
    assert [m[0] for m in DISGUISED.finditer("m o r o n! l33t normal sooooo 2024 a1")] == ["m o r o n", "l33t", "sooooo"]
    remember_for(np.zeros((29, 29, 29)))
    assert restored_words("plain words only", np.zeros((29, 29, 29))) == []


MIXED = [
    "m 0 r o n", "m o r 0 n", "m.0.r.0.n", "1 d 1 0 t", "m o o o o r o n", "moOoOron", "mmoorroonn", "mooron", "m_o_r_o_n", "mm oo rr oo nn",
    "m  -  0  -  r o n", "mo0oron", "id1i1ot", "1D10000t", "$ c u m", "w 0 r t h l e $ $", "5 m o r o n", "m o r o n !", "M 0 0 0 R 0 N", "v 3 R r m 1 n",
]


def test_mixed_disguises_are_found(spark):
    docs, labels = corpus(1)
    more = [(1000 + k, f"{speak(12)} {x} {speak(9)}") for k, x in enumerate(MIXED)]
    clean = [(3000 + k, f"{speak(12)} {x} {speak(9)}") for k, x in enumerate(["little letter", "1 2 3 4", "a 1 b 2 c 3", "10.0.0.1", "o o o o o", "$ 5 ! 5 !"])]
    df = spark.createDataFrame(docs + more + clean, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [x for k, x in enumerate(MIXED) if rows[1000 + k] < 0.7] == []
    assert [text for doc, text in clean if rows[doc] >= 0.7] == []


def test_viterbi_is_the_best_of_all_ways_of_mixed_disguises(spark):
    from itertools import product

    from lakestrata.llm.toxicity import code, lattice

    texts = spark.createDataFrame([(speak(30) + " ".join(BAD),) for _ in range(20)], "text string")
    model = letter_model(texts)
    for stretch in (x for x in MIXED if len(x) < 16):
        for words in (False, True):
            scores = {}
            for way in product(*lattice(stretch, words)):
                word, score, a, b = "".join(w for w, _ in way), -sum(c for _, c in way), 0, 0
                for letter in word:
                    score, a, b = score + model[a, b, code(letter)], b, code(letter)
                scores[word] = max(scores.get(word, score + model[a, b, 0]), score + model[a, b, 0])
            found = restore(stretch, model, words)
            assert scores[found] == pytest.approx(max(scores.values()))


LONG = [
    "mor" + "o" * 60 + "n", "m0r0n" + "!" * 60, "!" * 60 + "m0r0n", "m0r0n" + "!1$" * 40, "$cum" + "1!" * 50, "m" + "0" * 500 + "r0n", "mo" + "o" * 9000 + "ron",
    "m" + " " * 50 + "0" + " " * 50 + "r o n", "m o r" + " 0" * 60 + " n",
]


def test_long_stretches_are_decoded_too(spark):
    docs, labels = corpus(1)
    more = [(1000 + k, f"{speak(12)} {x} {speak(9)}") for k, x in enumerate(LONG)]
    clean = [(3000 + k, f"{speak(12)} {x} {speak(9)}") for k, x in enumerate(["e3b3ed3cc8548923d6" * 9, "ab1" * 3000, "house" + "!" * 100])]
    df = spark.createDataFrame(docs + more + clean, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [x[:20] for k, x in enumerate(LONG) if rows[1000 + k] < 0.7] == []
    assert [text for doc, text in clean if rows[doc] >= 0.7] == []


def test_a_long_stretch_keeps_the_beginning_of_its_word(spark):
    docs, _ = corpus(1)
    model = letter_model(spark.createDataFrame(docs, "doc_id long, text string"))
    remember_for(model)
    glued = "m0r0n" + "river5stone5house5river5s" * 8
    assert [word[:5] for word in restored_words(f"x {glued}.", model)] == ["moron"]


def test_every_disguise_reaches_the_decoder():
    import pyarrow as pa

    from lakestrata.llm.toxicity import LETTER, disguise_possible
    from lakestrata.llm.words import words_of

    random.seed(6)
    texts = ["id€ot", "£iar", "mor¡n", "m  o  r  o  n", "m - o - r - o - n", "mm oo rr", "ééé", "ÉéÉ", "é é é", "“m 0 n”", "m£ o£ r£", "x\n", "m 0 n"]
    for alphabet in ("mo0 -", "aé€£ .", "a1!*_ é", "Éé -x“", "$a\n 5b"):
        texts += ["".join(random.choice(alphabet) for _ in range(random.randrange(1, 9))) for _ in range(3000)]
    wanted = np.array([any(re.search(LETTER, m[0]) for m in DISGUISED.finditer(text)) for text in texts])
    for glue in ("", "x"):
        words = words_of(pa.array([glue + "x", *texts], pa.large_string()))
        assert 1000 < wanted.sum() < len(texts) - 1000
        assert [text for text, a, b in zip(texts, wanted, disguise_possible(words.data, words.begins)[1:]) if a and not b] == []


def test_length_switches_nothing(spark):
    """Spelt stretches are read as one word and as several, short and long ones alike; what is no word is not read at any length."""
    docs, _ = corpus(1)
    model = letter_model(spark.createDataFrame(docs, "doc_id long, text string"))
    remember_for(model)
    glued = " ".join("moronriverstonehouse" * 6)
    assert any(word.startswith("moron") for word in restored_words(f"x, {glued}.", model))
    assert "moron" in restored_words("x, m o r o n.", model) and "the" in restored_words("x, t h e.", model)
    for times in (1, 4, 40):
        assert restored_words("q7x9z2" * times, model) == []
        spelt = " ".join("theriver" * times + "moron")
        assert "moron" in restored_words(f"x, {spelt}.", model), times
