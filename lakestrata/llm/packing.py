"""Best-fit packing of documents into bins of fixed capacity, under conflicts of source and of copies.

Documents are cut into pieces of at most `capacity` words. Pieces are dealt by a hash of their document into shards of
about `shard_rows` pieces, and each shard is packed on its own, longest pieces first: open bins stand in order of
what is left in them, the search begins at the smallest residual that is large enough (the successor) and goes
on until a bin is compatible, the tightest such bin. Every bin carries a bitmap of sources and
one of duplicate clusters; a piece is compatible if its bits are in neither. Nothing is dropped or capped: a piece
without a compatible bin opens one.

Shards do not follow source or cluster, so a source or group of copies that holds a third of all rows is spread over all
of them. What it costs is space: each bin takes one piece of a source, so there are at least as many bins in a shard as it
has pieces of its commonest source.

Defined results: null and empty texts are one empty piece of length 0. Null sources never conflict; null clusters
neither. Rows with equal id and text are packed like others. Columns other than id, text, source and cluster are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import ascii_lower, whole_text

CAPACITY = 2048
SHARD_ROWS = 4096


def bit_numbers(values: np.ndarray) -> np.ndarray:
    """A bit for each value that occurs more than once, -1 for the others and for missing ones."""
    numbers, _ = pd.factorize(values)
    seen = np.bincount(numbers[numbers >= 0]) if (numbers >= 0).any() else np.zeros(1, np.int64)
    bits = np.cumsum(seen > 1) - 1
    return np.where((numbers >= 0) & (seen[numbers] > 1), bits[numbers], -1)


def best_fit(lengths: np.ndarray, bits: list[np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it for each piece, in the given order; `bits` has the conflict bit of each piece, or -1, per bitmap."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    words = [max(1, int(own.max(initial=-1)) // 64 + 1) for own in bits]
    maps = [np.zeros((len(lengths) + 1, n), np.uint64) for n in words]
    residual = np.empty(len(lengths), np.int64)  # of open bins, ascending
    number = np.empty(len(lengths), np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    open_bins = made = 0
    for i, length in enumerate(lengths.tolist()):
        own = [(m, int(b[i]) // 64, np.uint64(1) << np.uint64(int(b[i]) % 64)) for m, b in zip(maps, bits) if b[i] >= 0]
        at = int(np.searchsorted(residual[:open_bins], length))
        found, reach = -1, 16
        while at < open_bins:  # onwards from the successor, in growing strides
            some = number[at : at + reach if at + reach < open_bins else open_bins]
            free = np.ones(len(some), bool)
            for m, word, bit in own:
                free &= (m[some, word] & bit) == 0
            first = int(free.argmax())
            if free[first]:
                found = at + first
                break
            at, reach = at + len(some), reach * 4
        if found < 0:
            chosen, left = made, capacity - length
            made += 1
        else:
            chosen, left = int(number[found]), int(residual[found]) - length
            residual[found : open_bins - 1] = residual[found + 1 : open_bins]
            number[found : open_bins - 1] = number[found + 1 : open_bins]
            open_bins -= 1
        bins[i], places[i] = chosen, used[chosen]
        used[chosen] += length
        for m, word, bit in own:
            m[chosen, word] |= bit
        if left > 0:  # a full bin is closed, for empty pieces too
            at = int(np.searchsorted(residual[:open_bins], left))
            residual[at + 1 : open_bins + 1] = residual[at:open_bins].copy()
            number[at + 1 : open_bins + 1] = number[at:open_bins].copy()
            residual[at], number[at] = left, chosen
            open_bins += 1
    return bins, places


def copy_cluster(text_column: str = "text") -> Column:
    """Rows of equal text, but for the case of A-Z, are one cluster; empty texts are in none."""
    text = ascii_lower(whole_text(text_column))
    return F.when(F.length(text) > 0, F.xxhash64(text))


def pieces_of(docs: DataFrame, capacity: int, id_column: str, text_column: str, source: Column, cluster: Column) -> DataFrame:
    words = F.regexp_count(whole_text(text_column), F.lit(r"\S+"))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), source.cast("string").alias("source"), cluster.alias("cluster"), words.cast("long").alias("n_words")
    )
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n_words") - 1) / capacity))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("begin"),
        F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("piece") * capacity).alias("length"),
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    source: Column | None = None,
    cluster: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, begin and length (words of the document), bin_id, bin_offset.

    `source` and `cluster` say what may not meet in a bin; by default the column source, and exact copies.
    """
    source = F.col("source") if source is None else source
    cluster = copy_cluster(text_column) if cluster is None else cluster
    cut = pieces_of(docs, capacity, id_column, text_column, source, cluster)
    total = docs.count()
    shards = max(1, -(-total // shard_rows))
    # the piece's number spreads a document of very many pieces
    shard = F.pmod(F.xxhash64("doc_id", F.floor(F.col("piece") / 64)), F.lit(shards))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["length", "doc_id", "piece", "cluster", "source"], ascending=[False] + [True] * 4, kind="stable")
        sources = order["source"].to_numpy(object)
        bins, places = best_fit(order["length"].to_numpy(), [bit_numbers(sources), bit_numbers(order["cluster"].to_numpy())], capacity)
        number = int(group["shard"].iloc[0])
        return order[["doc_id", "piece", "begin", "length"]].assign(bin_id=[f"{number}-{x}" for x in bins], bin_offset=places)

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(
        run, f"doc_id {kind}, piece long, begin long, length long, bin_id string, bin_offset long"
    )
