import random

import pytest
from brute import dedup_lines

from lakestrata.llm.line_dedup import LineRuns, counted, drop_repeated_lines, hash_of, key_of, line_hashes
from pyspark.sql import functions as F

LINE = "A line that is long enough to be looked at, "


def sample(seed, n=60):
    random.seed(seed)
    docs = []
    for i in range(n):
        lines = [random.choice([f"{LINE}{random.randrange(8)}", f"\t {LINE.upper()}{random.randrange(8)} \r", "short", "", f"{LINE}own {i}"])
                 for _ in range(random.randrange(0, 9))]
        docs.append((i, "\n".join(lines)))
    long = "\n".join(f"{LINE}{k % 3}" for k in range(5000))
    return docs + [(100, None), (101, ""), (102, long), (103, "\n"), (None, f"{LINE}1\n{LINE}2"), (None, f"{LINE}1"), (5, docs[5][1]), (5, f"{LINE}3")]


def told(df, counts):
    return sorted(((r.doc_id, r.text or "", r[counts[0]], r[counts[1]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    docs = sample(seed)
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, lost string, line_count int").repartition(4)
    found = drop_repeated_lines(df)
    assert found.columns == ["doc_id", "text", "lost", "line_count", "_line_count", "lines_dropped"]
    assert {(r.lost, r.line_count) for r in found.collect()} == {("x", 7)}
    assert told(found, ("_line_count", "lines_dropped")) == sorted(dedup_lines(docs), key=repr)


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_line_of_a_third_of_all_documents(spark):
    docs = [(i, f"{LINE}common" if i % 3 == 0 else f"{LINE}{i}") for i in range(900)]
    found = drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert told(found, ("line_count", "lines_dropped")) == sorted(dedup_lines(docs), key=repr)


def batch_of(spark, docs):
    return line_hashes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 40)


def counts_of(runs):
    return {(r.h1, r.h2): (r.documents, r.largest) for r in runs.all().collect()}


BATCHES = [[(10 * b + i, f"{LINE}{(b + i) % 7}\n{LINE}{b}x{i}") for i in range(6)] for b in range(5)]


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_are_levelled_and_share_no_key(spark, fanout):
    runs = LineRuns(spark, fanout=fanout, buckets=4)
    for batch in BATCHES:
        runs.add(batch_of(spark, batch))
        assert all(len(level) < fanout for levels in runs.levels.values() for level in levels)
    keys = [(r.h1, r.h2) for run in runs.runs() for r in run.collect()]
    assert len(keys) == len(set(keys)) == 7 + 30
    found = counts_of(runs)
    for k in range(7):
        own = [d for batch in BATCHES for d, text in batch if f"{LINE}{k}\n" in text]
        h = spark.range(1).select(*hash_of(key_of(F.lit(f"{LINE}{k}")))).first()
        assert found[tuple(h)] == (len(own), max(own))


@pytest.mark.parametrize("session", ["same", "new"])
def test_a_reopened_folder_goes_on_where_it_was_left(spark, tmp_path, session):
    folder = str(tmp_path / "runs")
    whole = LineRuns(spark, fanout=2, buckets=4)
    whole.add(batch_of(spark, [doc for batch in BATCHES for doc in batch]))
    for batch in BATCHES:
        own = spark.newSession() if session == "new" else spark
        LineRuns(own, folder, fanout=2, buckets=4).add(batch_of(own, batch))
    again = LineRuns(spark, folder, fanout=2)
    assert counts_of(again) == counts_of(whole) and again.version == 5 and again.buckets == 4


def test_a_batch_that_died_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    LineRuns(spark, folder, buckets=4).add(batch_of(spark, BATCHES[0]))
    with monkeypatch.context() as broken:
        broken.setattr(LineRuns, "_save", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            LineRuns(spark, folder, buckets=4).add(batch_of(spark, BATCHES[1]))
    runs = LineRuns(spark, folder, buckets=4)
    runs.add(batch_of(spark, BATCHES[1]))
    whole = LineRuns(spark, buckets=4)
    whole.add(batch_of(spark, BATCHES[0] + BATCHES[1]))
    assert counts_of(runs) == counts_of(whole)


def test_joins_with_runs_exchange_nothing(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        runs = LineRuns(spark, fanout=3, buckets=4)
        for batch in BATCHES[:2]:
            runs.add(batch_of(spark, batch))
        said = runs._table(runs._write(counted(batch_of(spark, BATCHES[2]))))
        for found in (runs.fresh(said), runs.known(said)):
            tree = found._jdf.queryExecution().executedPlan().toString()
            assert tree.count("SortMergeJoin") == 2 and "Exchange" not in tree
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
