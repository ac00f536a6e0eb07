import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from lakestrata.llm import token_counts as T  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello world, it's  fine\n\n x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "é" * 3, "日本語 текст 123 ½",
    "a\x1cb\x85c d　e", "word " * 40_000, "x" * 30_000, "'s 'T we'll", "   leading", "trailing   ", "😀😀 á",
]


def brute(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_as_the_library(spark):
    rows = [(i, text, 1, 2) for i, text in enumerate(TEXTS)] + [(1, TEXTS[4], 1, 2), (None, "null id", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes int").repartition(3)
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH).collect()), key=repr)
    expected = [(row[0], len((row[1] or "").encode()), n) for row, n in zip(rows, brute([row[1] for row in rows]))]
    assert found == sorted(expected, key=repr)


@pytest.mark.parametrize("table_size", [1, 3])
def test_any_table_gives_the_same(spark, table_size):
    df = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in T.token_counts(df, PATH, table_size=table_size).collect()}
    assert [found[i] for i in range(len(TEXTS))] == brute(TEXTS)


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_small_cache(monkeypatch):
    monkeypatch.setattr(T, "CACHE_SIZE", 3)
    texts = [t or "" for t in TEXTS]
    assert T.Counts(PATH).count(texts, {"a": 1}) == brute(texts)


def test_a_warm_cache_and_a_batch_beyond_it(monkeypatch):
    # the cache holds some of what a batch needs, and is emptied because the batch brings more than fits
    monkeypatch.setattr(T, "CACHE_SIZE", 40)
    monkeypatch.setattr(T, "ENCODED", 7)
    counts = T.Counts(PATH)
    for n in (30, 300, 35, 41, 1000):
        texts = [" ".join(f"word{k}x{n % 7}" for k in range(at, at + n)) for at in (0, 20)]
        assert counts.count(texts, {" word1": 1}) == brute(texts)
        assert len(counts.cache) <= 40


def test_pre_tokens_split_like_the_library_for_every_code_point():
    counts = T.Counts(PATH)
    step = 97  # a prime: over some runs all classes of characters are met
    points = [k for k in range(0, 0x110000, step) if not 0xD800 <= k < 0xE000]
    points += [k for k in range(0x3100) if regex.match(r"\s", chr(k)) or k < 0x400]
    texts = [f"a{chr(k)}b {chr(k)}{chr(k)} 1{chr(k)}2  {chr(k)}" for k in points]
    assert counts.count(texts, {}) == brute(texts)


def test_units_are_whole_pre_tokens():
    counts = T.Counts(PATH)
    spaces = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2000\u200b\u2028\u202f\u205f\u3000"
    assert all((regex.match(r"\p{White_Space}", chr(k)) is None) == (T.re.match(f"[{T.SPACE}]", chr(k)) is None) for k in range(0x110000))
    texts = [f"it's{a}{b}x,{b}{a}'s{a}{a}{a}!{b}1{a}" for a in spaces for b in spaces]
    for text in texts:
        assert [x for unit in counts.units(text)[0] for x in counts.pattern.findall(unit)] == counts.pattern.findall(text)
    assert counts.count(texts, {}) == brute(texts)


def test_frequent_ones_come_from_all_rows(spark):
    df = spark.createDataFrame([(i, "aa bb" if i % 2 else "aa cc aa") for i in range(40)], "doc_id long, text string").repartition(4)
    assert T.frequent_pre_tokens(df.select(F.col("text")), PATH, 2)[0] in ("aa", " aa")
