import random
from collections import defaultdict

import numpy as np
import pytest

from lakestrata.llm.packing import best_fit, bit_numbers, pack
from pyspark.sql import functions as F


def slow(lengths, conflicts, capacity):
    bins, out = [], []
    for length, own in zip(lengths, conflicts):
        fits = [(capacity - b["used"], k) for k, b in enumerate(bins) if capacity - b["used"] >= length and capacity > b["used"]
                and not any(x is not None and x in b["own"][n] for n, x in enumerate(own))]
        if fits:
            least = min(left for left, _ in fits)
            k = [k for left, k in fits if left == least]
        else:
            bins.append({"used": 0, "own": [set(), set()]})
            least, k = None, [len(bins) - 1]
        out.append((least, set(k)))
        yield out[-1], bins


@pytest.mark.parametrize("seed", range(4))
def test_each_piece_goes_to_a_tightest_compatible_bin(seed):
    random.seed(seed)
    capacity = 50
    lengths = sorted((random.randrange(0, 51) for _ in range(150)), reverse=True)
    sources = [random.choice(["a", "a", "b", None, f"s{random.randrange(90)}"]) for _ in lengths]
    clusters = [random.randrange(70) for _ in lengths]
    bins, places = best_fit(np.array(lengths), [bit_numbers(np.array(sources, object)), bit_numbers(np.array(clusters))], capacity)
    state = slow(lengths, zip(sources, clusters), capacity)
    for i, length in enumerate(lengths):
        (least, allowed), made = next(state)
        k = int(bins[i])
        assert k in allowed and places[i] == made[k]["used"]
        made[k]["used"] += length
        for n, x in enumerate((sources[i], clusters[i])):
            if x is not None:
                made[k]["own"][n].add(x)


def check(docs, found, capacity):
    """Every word once, no bin too full, no two of a source or of copies together."""
    from brute import lower

    size = defaultdict(list)
    for doc, text, _ in docs:
        size[doc].append(len((text or "").split()))
    got, bins = defaultdict(list), defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.begin, r.length))
        bins[r.bin_id].append(r)
    for doc, sizes in size.items():
        expected = sorted((k, min(capacity, n - k)) for n in sizes for k in range(0, max(n, 1), capacity))
        assert sorted(got[doc]) == expected
    source = {doc: s for doc, _, s in docs}
    text = {doc: lower(t) for doc, t, _ in docs}
    for rows in bins.values():
        rows.sort(key=lambda r: (r.bin_offset, r.length))
        assert all(a.bin_offset + a.length == b.bin_offset for a, b in zip(rows, rows[1:])) and rows[0].bin_offset == 0
        assert rows[-1].bin_offset + rows[-1].length <= capacity
        own = [source[r.doc_id] for r in rows if source[r.doc_id] is not None]
        assert len(own) == len(set(own))
        own = [text[r.doc_id] for r in rows if text[r.doc_id]]
        assert len(own) == len(set(own))


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_invariants(spark, shard_rows):
    random.seed(8)
    docs = [(i, " ".join(["w"] * random.randrange(0, 130)) + f" x{i % 17}", random.choice(["hot", f"s{i % 40}", None])) for i in range(200)]
    docs += [(300, None, "s1"), (301, "", None), (302, "long " * 5000, None), (303, "only", "s2")]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, source string, bin_id string, cluster int").repartition(3)
    check(docs, pack(df, capacity=100, shard_rows=shard_rows).collect(), 100)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    found = pack(df, capacity=10).collect()
    assert len(found) == 3 and len({r.bin_id for r in found if r.doc_id == 1}) == 2


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_own_clusters(spark):
    df = spark.createDataFrame([(i, f"t {i}", f"s{i}", i % 2) for i in range(6)], "doc_id long, text string, source string, class_id int")
    found = pack(df, capacity=100, cluster=F.col("class_id")).collect()
    bins = defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r.doc_id % 2)
    assert len(bins) == 3 and all(sorted(x) == [0, 1] for x in bins.values())
