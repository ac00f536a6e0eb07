"""Benchmark decontamination over a distributed positional inverted index.

The index holds postings (term, document, position, the terms around it) of the training documents. Which
terms it needs follows from the benchmark: every window of 13 item words is found through its two rarest terms,
rarest by counts over all documents. A window can only occur where both lists, shifted by the places of
the terms in the item, meet in one document; the terms stored around a posting then decide
whether the whole phrase is there. With `slop`, the same lists also tell where the two terms stand about as far apart as in
the window (`proximity_matches`), whether or not the phrase is there.

The benchmark is read in blocks of at most `block_words` words on average, so what is broadcast has a bound that
does not grow with either table. Postings are written and never shuffled by term; matches are grouped by document.
A term or passage in a third of all documents costs rows in proportion to its occurrences, spread by document.

Defined results: null and empty texts have no words, hits or items. Items without words match nothing; items of fewer than
13 words are one window. Repeated rows give repeated results (a row is known by its id and a hash of its
text), null ids stay null, repeated items count by their ids. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.common import new_folder, stored, whole_text
from lakestrata.llm.words import chunks, words_of

WINDOW = 13
BLOCK_WORDS = 1 << 21
#: A row of documents is known by these: rows equal in both have equal results.
ROW = ["doc_id", "mark"]


@dataclass
class Queries:
    """The items of one block: term numbers of their words, item by item, and their windows' anchors."""

    ids: list
    first: np.ndarray  # where the words of each item begin
    terms: np.ndarray  # a number for each word
    known: np.ndarray  # sorted hashes of the terms
    window: int

    def windows(self) -> Iterator[tuple[int, int, int]]:
        """Item, first word and length of each window."""
        for i in range(len(self.ids)):
            n = int(self.first[i + 1] - self.first[i])
            size = min(n, self.window)
            for start in range(n - size + 1 if n else 0):
                yield i, start, size

    def anchors(self, counts: np.ndarray) -> dict[tuple[int, int], int]:
        """The places (item, word) of the two rarest words of each window, and how many of them are needed."""
        needed: dict[tuple[int, int], int] = {}
        for i, start, size in self.windows():
            own = counts[self.terms[self.first[i] + start : self.first[i] + start + size]]
            for place in np.argsort(own, kind="stable")[:2]:
                needed[(i, start + int(place))] = min(size, 2)
        return needed

    def pairs(self, counts: np.ndarray) -> set[tuple[int, int, int, int]]:
        """Item, terms of the two anchors and their distance, for each window."""
        found = set()
        for i, start, size in self.windows():
            at = self.first[i] + start
            own = self.terms[at : at + size]
            if size > 1:
                a, b = np.argsort(counts[own], kind="stable")[:2]
                found.add((i, int(own[a]), int(own[b]), int(b - a)))
        return found


def hashed_words(texts: DataFrame) -> DataFrame:
    """The columns of `texts`, with the last one (a text) as an array of word hashes."""
    *others, last = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(batch.num_columns - 1)):
                words = words_of(part)
                lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hashes.view(np.int64)))
                kept = [batch.column(k).slice(at, len(part)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, lists], [*others, "words"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{kinds}, words array<long>")


def query_blocks(benchmark: DataFrame, window: int, block_words: int, id_column: str, text_column: str) -> Iterator[Queries]:
    """The benchmark's items, in blocks whose size does not grow with the benchmark."""
    items = hashed_words(benchmark.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text")))
    items = stored(items.filter(F.size("words") > 0), new_folder(benchmark.sparkSession, "benchmark-words"))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == block).distinct().collect()
        rows.sort(key=lambda row: (str(row.id), row.words))
        words = [np.array(row.words, np.int64).view(np.uint64) for row in rows]
        every = np.concatenate(words) if words else np.zeros(0, np.uint64)
        known, terms = np.unique(every, return_inverse=True)
        yield Queries([row.id for row in rows], np.cumsum([0, *map(len, words)]), terms, known, window)


def numbers_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The number of each word among the known terms, or -1."""
    if not len(known):
        return np.full(len(hashes), -1, np.int32)
    places = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[places] == hashes, places, -1).astype(np.int32)


def term_counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each known term occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                found = numbers_of(words_of(part).hashes, shared.value)
                counts += np.bincount(found[found >= 0], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(known), np.int64)
    for term, n in sums.toPandas().itertuples(index=False):
        counts[term] = n
    return counts


def index_postings(docs: DataFrame, known: np.ndarray, indexed: np.ndarray, window: int, path: str) -> DataFrame:
    """Write and read the index: term, doc_id, mark, position, near; and term -1 with each row's number of words."""
    shared = docs.sparkSession.sparkContext.broadcast((known, indexed))
    reach = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, indexed = shared.value
        for batch in batches:
            ids, marks, texts = batch.columns
            for at, part in chunks(texts):
                words = words_of(part)
                numbers, owner = numbers_of(words.hashes, known), words.owner
                hits = np.flatnonzero((numbers >= 0) & indexed[numbers]) if len(known) else np.zeros(0, np.int64)
                # the terms around each hit, -1 beyond the ends of its document
                around = hits[:, None] + np.arange(-reach, reach + 1)[None, :]
                low, high = words.first[owner[hits]][:, None], words.first[owner[hits] + 1][:, None]
                near = np.where(
                    (around >= low) & (around < high), numbers[np.clip(around, 0, max(0, len(numbers) - 1))] if len(numbers) else -1, -1
                ).astype(np.int32)
                row = np.concatenate([np.arange(len(part)), owner[hits]]) + at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(part), -1, np.int32), numbers[hits]])),
                        ids.take(pa.array(row)),
                        marks.take(pa.array(row)),
                        pa.array(np.concatenate([words.counts, hits - words.first[owner[hits]]]).astype(np.int64)),
                        pa.array([None] * len(part) + [x.tobytes() for x in near], pa.binary()),
                    ],
                    ["term", "doc_id", "mark", "position", "near"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    postings = docs.mapInArrow(run, f"term int, doc_id {kind}, mark long, position long, near binary")
    return stored(postings.sortWithinPartitions("term", "doc_id", "position"), path)


def phrase_matches(index: DataFrame, queries: Queries, counts: np.ndarray) -> DataFrame:
    """doc_id, mark, item_id and the spans [begin, end) of document words inside occurring windows."""
    spark = index.sparkSession
    anchors = [
        (int(queries.terms[queries.first[item] + place]), item, place, needed)
        for (item, place), needed in queries.anchors(counts).items()
    ]
    lists = F.broadcast(spark.createDataFrame(anchors, "term int, item int, place int, needed int"))  # bounded by the block
    shifted = index.filter("term >= 0").join(lists, "term").withColumn("shift", F.col("position") - F.col("place"))
    met = (
        shifted.groupBy(*ROW, "item", "shift")
        .agg(F.collect_list(F.struct("place", "near")).alias("found"), F.max("needed").alias("needed"))
        .filter(F.size("found") >= F.col("needed"))
    )
    shared = spark.sparkContext.broadcast(queries)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        reach = queries.window - 1
        for batch in batches:
            rows, items, begins, ends = [], [], [], []
            for k, (item, shift, found) in enumerate(
                zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ):
                own = queries.terms[queries.first[item] : queries.first[item + 1]]
                size = min(len(own), queries.window)
                equal = np.zeros(len(own), bool)
                for one in found:
                    near, place = np.frombuffer(one["near"], np.int32), one["place"]
                    low, high = max(0, place - reach), min(len(own), place + reach + 1)
                    equal[low:high] |= near[low - place + reach : high - place + reach] == own[low:high]
                sums = np.concatenate([[0], np.cumsum(equal)])
                whole = np.flatnonzero(sums[size:] - sums[:-size] == size)  # windows that occur here
                if len(whole):
                    breaks = np.flatnonzero(np.diff(whole) > size) + 1
                    for run in np.split(whole, breaks):
                        rows.append(k)
                        items.append(item)
                        begins.append(shift + int(run[0]))
                        ends.append(shift + int(run[-1]) + size)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(items, pa.int32()),
                 pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                [*ROW, "item", "begin", "end"],
            )

    kind = index.schema["doc_id"].dataType.simpleString()
    spans = met.select(*ROW, "item", "shift", "found").mapInArrow(
        verify, f"doc_id {kind}, mark long, item int, begin long, end long"
    )
    return spans.join(item_names(spark, queries), "item").drop("item")


def item_names(spark: SparkSession, queries: Queries) -> DataFrame:
    names = [(i, None if name is None else str(name)) for i, name in enumerate(queries.ids)]
    return F.broadcast(spark.createDataFrame(names, "item int, item_id string"))  # bounded by the block


def proximity_matches(index: DataFrame, queries: Queries, counts: np.ndarray, slop: int) -> DataFrame:
    """doc_id, mark, item_id, position, off: the two rarest terms of a window stand up to `slop` words from their distance in it.

    Lists are joined by document and stretch of 2 * slop + 1 positions, so a term that is everywhere in a long document meets the
    neighbours of each place only. A place is no neighbour of itself; windows of one word have no neighbours.
    """
    spark, width = index.sparkSession, 2 * slop + 1
    pairs = F.broadcast(spark.createDataFrame(sorted(queries.pairs(counts)), "item int, term int, other int, distance int"))  # bounded by the block
    target = F.col("position") + F.col("distance")
    stretches = F.array_distinct(F.array(F.floor((target - slop) / width), F.floor((target + slop) / width)))
    first = index.filter("term >= 0").select("term", *ROW, "position").join(pairs, "term").select("*", F.explode(stretches).alias("stretch"))
    second = index.filter("term >= 0").select(
        F.col("term").alias("term2"), F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("position").alias("there"),
        F.floor(F.col("position") / width).alias("stretch2"),
    )
    off = F.col("there") - F.col("position") - F.col("distance")
    same = (F.col("other") == F.col("term2")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    near = (F.col("stretch") == F.col("stretch2")) & (F.abs(off) <= slop) & (F.col("there") != F.col("position"))
    met = first.join(second, same & near)
    return met.select(*ROW, "item", "position", off.alias("off")).distinct().join(item_names(spark, queries), "item").drop("item")


def covered(spans: DataFrame) -> DataFrame:
    """Per document row: how many words the spans cover together, and the items' ids as sorted strings."""
    grouped = spans.groupBy(*ROW).agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(state, span):
        to = F.greatest(state["to"], span["end"])
        return F.struct((state["n"] + to - F.greatest(state["to"], F.least(span["begin"], to))).alias("n"), to.alias("to"))

    return grouped.select(*ROW, F.aggregate("spans", start, step, lambda state: state["n"]).alias("n_hit"), "items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    slop: int | None = None,
) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, n_hit and items (sorted ids as strings) of every row of `docs`.

    With `slop` also n_near and near_items: in how many places (of an item and a word) the two rarest words of a window stand within
    `slop` words of their distance in it, phrases included, and of which items.
    """
    spark = docs.sparkSession
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    words = spans = near = None
    for queries in query_blocks(benchmark, window, block_words, item_column, item_text):
        counts = term_counts(rows, queries.known)
        indexed = np.zeros(len(queries.known) + 1, bool)  # one more, for -1
        for item, place in queries.anchors(counts):
            indexed[queries.terms[queries.first[item] + place]] = True
        index = index_postings(rows, queries.known, indexed, window, new_folder(spark, "postings"))
        words = words or index.filter("term = -1").select(*ROW, F.col("position").alias("n_words"))
        found = phrase_matches(index, queries, counts)
        spans = found if spans is None else spans.unionByName(found)
        if slop is not None:
            close = proximity_matches(index, queries, counts, slop).select(*ROW, "item_id", "position")
            near = close if near is None else near.unionByName(close)
    hits = covered(spans)
    none = F.array().cast("array<string>")
    result = (
        words.join(
            hits.withColumnsRenamed({"doc_id": "d", "mark": "m"}),
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")),
            "left",
        )
        .select(*ROW, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    )
    if near is None:
        return result
    close = near.distinct().groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    close = close.agg(F.count(F.lit(1)).alias("n_near"), F.array_sort(F.collect_set("item_id")).alias("near_items"))
    return result.join(close, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select(
        *result.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("near_items", none).alias("near_items")
    )


def is_contaminated() -> Column:
    """At least a twentieth of the words, and at least one, lie inside occurring windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    found = decontaminate(docs, benchmark, id_column=id_column, text_column=text_column, **parameters).filter(is_contaminated())
    names = ["bad_id", "bad_mark"]
    while set(names) & set(docs.columns):
        names = [f"_{name}" for name in names]
    bad = found.select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1])).distinct()
    same = docs[id_column].eqNullSafe(bad[names[0]]) & (F.xxhash64(whole_text(text_column)) == bad[names[1]])
    return docs.join(bad, same, "left_anti")
