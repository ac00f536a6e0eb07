"""The whole pipeline over small tables, stage by stage against plain Python."""

import os
import random

import pytest
from brute import classes, dedup_lines, hits, lower, near_links

import corpus_pipeline
from lakestrata.llm import queries

PLAIN = "the of and window garden letter paper river stone little house again under water summer winter music".split()
LINE = "This notice is repeated at the end of very many documents."


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables and the documents in it."""
    random.seed(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    speak = lambda n: " ".join(f"{random.choice(PLAIN)}{random.randrange(30)}" for _ in range(n))
    item = speak(40)
    docs, labels = [], []
    for i in range(240):
        text = speak(random.randrange(20, 60))
        if i % 6 == 0:
            text += " " + random.choice(["moron", "vermin"]) + " " + speak(5)
        if i % 5 == 0:
            text += "\n" + LINE
        if i % 16 == 1:
            text += " " + item
        labels.append((i, int(i % 3 > 0), int(i % 6 == 0)))
        docs.append((i, text))
    docs += [(300 + k, docs[7][1].replace("7", "8", 1)) for k in range(4)] + [(310, docs[8][1].upper()), (311, None), (312, ""), (313, speak(9000))]
    rows = [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, speak(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_every_stage(spark, small):
    folder, item = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, folder)
        if name == "packing":
            assert {r.doc_id for r in result.collect()} == set(before)
            break
        assert result.columns == docs.columns
        rows = result.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(after) and all(r.n_chars == len(r.text or "") for r in rows)
        if name == "toxicity":
            expected = {d: t for d, t in before.items() if not {"moron", "vermin"} & set(lower(t).split())}
        elif name == "line_dedup":
            expected = {d: t for d, t, _, _ in dedup_lines(list(before.items()))}
        elif name == "ngram_join":
            own = sorted(before.items())
            root = classes(len(own), near_links([t for _, t in own]))
            expected = {d: t for k, (d, t) in enumerate(own) if root[k] == k}
        else:
            expected = {d: t for d, t in before.items() if not (h := hits(t, bench))[1] or 20 * h[1] < h[0]}
        assert {d: t or "" for d, t in after.items()} == {d: t or "" for d, t in expected.items()}
        assert len(after) < len(before) or name == "line_dedup"
        path = os.path.join(folder, f"stage-{k}")
        result.write.parquet(path)
        docs, before = spark.read.parquet(path), after


def test_run_returns_the_last_stage(spark, small):
    result = corpus_pipeline.run(spark, small[0])
    assert result.columns == ["doc_id", "piece", "begin", "length", "bin_id", "bin_offset"]
    assert 0 < result.select("doc_id").distinct().count() < 248


def test_stages_and_queries():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "packing"]
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
