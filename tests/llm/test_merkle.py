import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakestrata.llm.merkle import leaf_of, lower_cased, merkle_manifest, proofs

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level string, at int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in FIELDS))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Levels of digests, from the given ones to a single one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        at //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in own])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = climb([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for at, row in enumerate(groups[lang]):
            sides = way(trees[lang], at) + way(top, k)
            bad = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded = leaf({**row, "text": lower(row["text"])} if bad else row)
            for left, right in sides:
                folded = sha(left, folded, right)
            out.append((row["doc_id"], leaf(row), trees[lang][-1][0], top[-1][0], sha(*(x for side in sides for x in side)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def told(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def as_rows(items):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars", "level", "at"), (*item, "x", 1))) for item in items]


def sample(n):
    out = [(i * 7 % 1000, None if i % 11 == 0 else f"Text {i} É", ["en", "en", "en", "de", None, "", "é"][i % 7], None if i % 5 == 0 else "s", None if i % 6 == 0 else i) for i in range(n)]
    return out + [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (7, "Twice", "de", "s", 1), (7, "Twice", "de", "s", 1), (7, "Other", "de", "s", 2), (5, "X" * 300_000, "solo", None, None)]


@pytest.mark.parametrize("items", [sample(600), sample(30), [(1, "A", "en", "s", 1)], [(i, f"T{i}", "en", "s", 1) for i in range(9)], [(1, "A", "a", "s", 1), (2, "B", "b", "s", 1)], [(i, "A", f"l{i}", "s", 1) for i in range(70)]])
def test_as_brute_force(spark, items, most_broadcast=1000):
    rows = as_rows(items)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    found = proofs(merkle_manifest(df, tampered=lower_cased(), most_broadcast=most_broadcast))
    assert told(found) == brute(rows)


def test_joins_without_broadcast(spark):
    test_as_brute_force(spark, sample(600), 0)


def test_empty_table(spark):
    assert proofs(merkle_manifest(spark.createDataFrame([], SCHEMA), tampered=lower_cased())).collect() == []


def test_untampered_rows_all_verify(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in as_rows(sample(200))], SCHEMA)
    assert {r.verified for r in proofs(merkle_manifest(df)).collect()} == {True}


def test_fields_are_told_apart(spark):
    one = spark.range(1).select(leaf_of([F.lit("a"), F.lit("1:b")]).alias("a"), leaf_of([F.lit("a1"), F.lit(":b")]).alias("b"), leaf_of([F.lit("-"), F.lit(None)]).alias("c"), leaf_of([F.lit(None), F.lit("-")]).alias("d")).first()
    assert len(set(one)) == 4


def test_no_window_holds_a_group(spark):
    rows = [(i, "t", "en", "s", 1, "x", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = merkle_manifest(df)
    assert found.count() == 3000 and {len(r.way) for r in found.collect()} == {4}
