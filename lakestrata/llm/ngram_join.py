"""N-gram Jaccard self-join of documents: MinHash bands propose, a Bayesian test prunes, shingle sets decide.

1. Every text becomes its set of word 5-grams and a MinHash sketch. Texts of equal sets are one class of copies;
   only a representative of a class is compared, so copies never make pairs.
2. Bands of the sketch propose: representatives that share a band key are linked to the least of them (a
   star, not all pairs), and the components of these links say who may be similar to whom.
3. Components are cut into blocks of `block` representatives, and pairs of blocks go to tasks, so no
   task or row grows with a component. There MinHash values are compared 16 at a time: after each step, pairs go whose posterior
   probability of a similarity of `threshold` or more (uniform prior, binomial likelihood) is below `tolerance`. What is left is
   verified exactly on the shingle sets. A task returns the number of links of each
   representative and a spanning forest of its links, never the pairs.
4. Links give the classes: documents connected by links share a class id.

With 40 bands of 5 values, a pair of similarity 0.8 is missed with probability 1.2e-7, one of 0.9 with 1e-16.

Defined results: texts without words have no shingles, no links, and a class of their own. Texts of fewer than five words,
but not none, have one shingle of all their words. Null ids form rows like others; of a class the
largest id names it. Repeated rows are copies of each other. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import new_folder, stored, whole_text
from lakestrata.llm.components import components
from lakestrata.llm.words import chunks, mix, powers, shingles, words_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
TOLERANCE = 1e-9
STEP = 16
BLOCK = 1024
GROUP = 4096

_seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
MULTIPLIERS = (_seeds[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
ADDENDS = (_seeds[VALUES:] >> np.uint64(32)).astype(np.uint32)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each text's shingles; texts without shingles get none (rows are left at the maximum)."""
    out = np.full((len(first) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        begins = first[full]
        for k in range(VALUES):
            x = low * MULTIPLIERS[k] + ADDENDS[k]
            x ^= x >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(x * MULTIPLIERS[-1 - k], begins)
    return out


def set_keys(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, independent of order."""
    keys = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt))])
        keys.append(mix((sums[first[1:]] - sums[first[:-1]]) ^ salt).view(np.int64))
    return keys[0], keys[1]


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each sketch."""
    bands = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(values), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ bands[:, :, k])
    return key


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = VALUES) -> list[tuple[int, int]]:
    """For each number of compared values the fewest matches with which a pair stays.

    With a uniform prior, the posterior of a similarity s after m of n matches is Beta(m + 1, n - m + 1), and its
    mass at or above t equals the chance of at most m successes in n + 1 trials of probability t.
    """
    found = []
    for n in [*range(step, total, step), total]:
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)
            )
        found.append((n, m))
    return found


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of sketches that no step of the Bayesian test drops."""
    first = limits[0][0]
    rows, columns = [], []
    for i in range(len(a)):  # the first step, a row against a block
        begin = i + 1 if same else 0
        matches = (b[begin:, :first] == a[i, :first]).sum(1)
        found = np.flatnonzero(matches >= limits[0][1]) + begin
        if len(found):
            rows.append(np.full(len(found), i))
            columns.append(found)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(rows), np.concatenate(columns)
    kept_x, kept_y = [], []
    for at in range(0, len(x), 1 << 16):
        p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        matches = (a[p, :first] == b[q, :first]).sum(1)
        before = first
        for n, least in limits[1:]:
            matches = matches + (a[p, before:n] == b[q, before:n]).sum(1)
            stay = matches >= least
            p, q, matches, before = p[stay], q[stay], matches[stay], n
        kept_x.append(p)
        kept_y.append(q)
    return np.concatenate(kept_x), np.concatenate(kept_y)


def common_counts(x: np.ndarray, y: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets, all exact."""
    if len(x) <= 4 * (len(sets_a) + len(sets_b)):
        return np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    use_a, use_b = np.unique(x), np.unique(y)
    every = np.concatenate([sets_a[i] for i in use_a] + [sets_b[j] for j in use_b])
    _, number = np.unique(every, return_inverse=True)
    numbers = np.split(number, np.cumsum([len(sets_a[i]) for i in use_a] + [len(sets_b[j]) for j in use_b])[:-1])
    place_a = np.concatenate([np.full(len(v), k) for k, v in enumerate(numbers[: len(use_a)])])
    place_b = np.concatenate([np.full(len(v), k) for k, v in enumerate(numbers[len(use_a) :])])
    flat_a, flat_b = np.concatenate(numbers[: len(use_a)]), np.concatenate(numbers[len(use_a) :])
    shared = np.intersect1d(flat_a, flat_b)  # the others add nothing
    at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    ok_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
    ok_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
    at_a, place_a, at_b, place_b = at_a[ok_a], place_a[ok_a], at_b[ok_b], place_b[ok_b]
    total = np.zeros((len(use_a), len(use_b)), np.float32)
    width = 4096
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, place_a, at_b, place_b = at_a[order_a], place_a[order_a], at_b[order_b], place_b[order_b]
    for begin in range(0, len(shared), width):
        m = np.zeros((len(use_a), width), np.float32)
        n = np.zeros((len(use_b), width), np.float32)
        s, e = np.searchsorted(at_a, [begin, begin + width])
        m[place_a[s:e], at_a[s:e] - begin] = 1
        s, e = np.searchsorted(at_b, [begin, begin + width])
        n[place_b[s:e], at_b[s:e] - begin] = 1
        total += m @ n.T
    return total[np.searchsorted(use_a, x), np.searchsorted(use_b, y)].astype(np.int64)


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given ones connect, without cycles."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            kept.append((i, j))
    return kept


def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool, words: int, threshold: float, limits) -> tuple[dict, list]:
    """Number of linked rows by rid (copies counted) and a forest of the links between two blocks."""
    sketch_a = np.frombuffer(b"".join(a["sketch"]), np.uint32).reshape(-1, VALUES)
    sketch_b = sketch_a if same else np.frombuffer(b"".join(b["sketch"]), np.uint32).reshape(-1, VALUES)
    x, y = likely_pairs(sketch_a, sketch_b, same, limits)
    if not len(x):
        return {}, []

    def sets(block: pd.DataFrame, used: np.ndarray) -> list[np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(block)
        texts = pa.array(block["text"].to_numpy()[used], pa.large_string())
        for at, part in chunks(texts):
            values, first = shingles(words_of(part), words)
            for k in range(len(part)):
                found[used[at + k]] = values[first[k] : first[k + 1]]
        return found

    if same:
        sets_a = sets_b = sets(a, np.unique(np.concatenate([x, y])))
    else:
        sets_a, sets_b = sets(a, np.unique(x)), sets(b, np.unique(y))
    common = common_counts(x, y, sets_a, sets_b)
    sizes = np.array([len(sets_a[i]) for i in x]) + np.array([len(sets_b[j]) for j in y]) - common
    linked = common / np.maximum(sizes, 1) >= threshold
    x, y = x[linked], y[linked]
    rid_a, rid_b = a["rid"].to_numpy(), b["rid"].to_numpy()
    links: dict[int, int] = {}
    for own, other, i, j in ((rid_a, b["copies"].to_numpy(), x, y), (rid_b, a["copies"].to_numpy(), y, x)):
        for k, n in zip(*_sums(i, other[j])):
            links[int(own[k])] = links.get(int(own[k]), 0) + int(n)
    return links, forest(rid_a[x], rid_b[y])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, values)
    return found, sums


def row_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", row1: str = "row1", row2: str = "row2") -> DataFrame:
    """`docs` with 128 bits of each row's id and text in two columns."""
    text = whole_text(text_column)
    return docs.withColumns({row1: F.xxhash64(F.col(id_column), text), row2: F.xxhash64(text, F.lit("row"), F.col(id_column))})


def sketched(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, row1, row2, key1, key2, n (distinct shingles) and sketch of each row (doc_id, row1, row2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, texts = batch.columns
            for at, part in chunks(texts):
                values, first = shingles(words_of(part), words)
                key1, key2 = set_keys(values, first)
                counts = np.diff(first)
                found = [x.tobytes() if n else None for x, n in zip(sketches(values, first), counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(at, len(part)) for x in names), pa.array(key1), pa.array(key2), pa.array(counts), pa.array(found, pa.binary())],
                    ["doc_id", "row1", "row2", "key1", "key2", "n", "sketch"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row1 long, row2 long, key1 long, key2 long, n long, sketch binary")


def band_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sketch = batch.columns
            for at in range(0, len(rid), 1024):
                values = np.frombuffer(b"".join(sketch.slice(at, 1024).to_pylist()), np.uint32).reshape(-1, VALUES)
                keys = band_keys(values).view(np.int64)
                own = np.repeat(np.asarray(rid.slice(at, 1024)), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(own)], ["band", "rid"])

    return classes.select("rid", "sketch").mapInArrow(run, "band long, rid long")


def ngram_join(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, row1 and row2 (see `row_keys`), class_id, kept, n_copies and n_links of every row.

    n_links counts the other rows whose similarity is at least `threshold`, copies among them. class_id is the largest
    id among the rows connected by links, and `kept` marks the row that carries it.
    """
    spark = docs.sparkSession
    rows = row_keys(docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")))
    rows = rows.select("doc_id", "row1", "row2", "text")
    every = stored(sketched(rows, words), new_folder(spark, "sketches"))
    full = every.filter("n > 0")
    grouped = full.groupBy("key1", "key2").agg(
        F.max(F.struct("doc_id", "row1", "row2")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")
    )
    classes = stored(
        grouped.select("key1", "key2", "one.doc_id", "one.row1", "one.row2", "copies", "sketch", F.monotonically_increasing_id().alias("rid")),
        new_folder(spark, "classes"),
    )

    bands = band_rows(classes)
    stars = bands.groupBy("band").agg(F.min("rid").alias("v"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    proposed = bands.join(stars, "band").filter("rid <> v").select(F.col("rid").alias("u"), "v").distinct()
    near = components(proposed, "proposed")
    members = near.unionByName(near.select(F.col("root").alias("u"), "root").distinct())
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    placed = members.join(sizes, "root").select(
        F.col("u").alias("rid"), "root", parts.alias("parts"), F.pmod(F.xxhash64("u"), parts).cast("int").alias("part")
    )
    candidates = classes.select("rid", "row1", "row2", "copies", "sketch").join(placed, "rid")
    texts = rows.select("row1", "row2", "text").join(candidates.select("row1", "row2"), ["row1", "row2"], "left_semi")
    candidates = candidates.join(texts.dropDuplicates(["row1", "row2"]), ["row1", "row2"]).drop("row1", "row2")
    candidates = stored(candidates, new_folder(spark, "candidates"))
    total = candidates.count()
    groups = max(1, -(-total // GROUP))
    # a component of one block goes to a group of small ones, a larger one to each pair of its blocks
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")),
        )
    )
    dealt = candidates.withColumn("pair", F.explode(pairs)).select(
        "*", "pair.i", "pair.j", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(-1 - F.col("root")).alias("task")
    )
    limits = least_matches(threshold, tolerance)

    def links_of(group: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        i, j, parts = int(group["i"].iloc[0]), int(group["j"].iloc[0]), int(group["parts"].iloc[0])
        if parts == 1:
            for _, own in group.groupby("root"):
                found, some = compare(own, own, True, words, threshold, limits)
                counts.update(found)
                edges += some
        else:
            a = group[group["part"] == i]
            found, some = compare(a, a if i == j else group[group["part"] == j], i == j, words, threshold, limits)
            counts, edges = found, some
        return pd.DataFrame(
            {
                "u": [*counts, *(a for a, _ in edges)],
                "v": pd.array([None] * len(counts) + [b for _, b in edges], "Int64"),
                "n": [*counts.values(), *([0] * len(edges))],
            }
        ).astype({"u": "int64", "n": "int64"})

    columns = ["task", "i", "j", "root", "rid", "parts", "part", "copies", "sketch", "text"]
    found = dealt.select(*columns).groupBy("task", "i", "j").applyInPandas(links_of, "u long, v long, n long")
    found = stored(found, new_folder(spark, "links"))
    linked = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    roots = components(found.filter("v is not null").select("u", "v"), "linked")

    named = classes.select("key1", "key2", F.struct("doc_id", "row1", "row2").alias("one"), "copies", "rid")
    named = named.join(roots.withColumnRenamed("u", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = named.join(linked.withColumnRenamed("u", "rid"), "rid", "left")
    largest = named.groupBy("root").agg(F.max("one").alias("top"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = stored(
        named.join(largest, "root").select("key1", "key2", "top", F.col("copies").alias("n_copies"), links.alias("n_links")),
        new_folder(spark, "named"),
    )
    found = full.join(named, ["key1", "key2"]).select(
        "doc_id", "row1", "row2", F.col("top.doc_id").alias("class_id"),
        (F.struct("doc_id", "row1", "row2") == F.col("top")).alias("kept"), "n_copies", "n_links",
    )
    alone = every.filter("n = 0").select(
        "doc_id", "row1", "row2", F.col("doc_id").alias("class_id"),
        F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"),
    )
    return found.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of `docs` without those that another row of their class stands for: the one of the largest id stays.

    Rows without words all stay, but of repeated rows (one id and text) one.
    """
    joined = ngram_join(docs, id_column=id_column, text_column=text_column, **parameters)
    names = ["row1", "row2"]
    while set(names) & set(docs.columns):
        names = [f"_{name}" for name in names]
    kept = joined.filter("kept").select(F.col("row1").alias(names[0]), F.col("row2").alias(names[1])).distinct()
    with_keys = row_keys(docs, id_column, text_column, names[0], names[1])
    return with_keys.join(kept, names[:2], "left_semi").dropDuplicates(names[:2]).select(*docs.columns)
