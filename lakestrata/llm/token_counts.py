"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens have together.
Tier 1 is a hash table from frequent pre-tokens to their token counts, broadcast once; it has at most
`table_size` entries of at most 64 characters, so some megabytes. Tier 2 encodes what the table misses, once per
worker, and remembers it in a bounded cache that outlives tasks.

A pre-token holds white space at its beginning only, or is white space alone, so a text is first cut at white space into
units, each of one or more whole pre-tokens. A unit that both tiers know needs no further split; others are split into
their pre-tokens, once a batch, and remembered beside these.

What is frequent is taken from the whole corpus: each task counts the words of its texts, splits each distinct one into
pre-tokens and passes on its most frequent ones, at most `TASK_SIZE`, and Spark adds these up. That choice bears on speed
alone; every count is exact.

Defined results: null and empty texts have 0 bytes and 0 tokens. Special strings inside a text are one token each, as the
tokenizer has them by default. Other columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import whole_text

#: Fixed values of the byte-level pre-tokenizer: the contractions and classes that split a text.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The characters of the property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
TABLE_SIZE = 1 << 16
CACHE_SIZE = 1 << 19
TASK_SIZE = 1 << 13
LONG_CHARS = 256  # longer pre-tokens are not remembered
ENCODED = 1 << 16  # pre-tokens encoded in one call

_workers: dict[str, "Counts"] = {}


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [token["content"] for token in json.load(file)["added_tokens"] if token["special"]]


class Counts:
    """Token counts of pre-tokens in one worker: the broadcast table first, then the cache, then the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PRE_TOKENS)
        self.unit = re.compile(UNITS)
        special = special_tokens(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "Counts":
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def units(self, text: str) -> tuple[list[str], int]:
        """Units between special strings, and the number of special strings."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.unit.findall(text), 0
        return [x for part in self.special.split(text) for x in self.unit.findall(part)], len(found)

    def known(self, wanted: Iterable[str], frequent: dict[str, int]) -> tuple[dict[str, int], list[str]]:
        """What the table or the cache knows, and what neither does."""
        lengths, missing = {}, []
        for x in wanted:
            n = frequent.get(x)
            if n is None:
                n = self.cache.get(x)
            if n is None:
                missing.append(x)
            else:
                lengths[x] = n
        return lengths, missing

    def learn(self, counts: dict[str, int]) -> None:
        """Remember short pre-tokens, in an empty cache if they would not fit, and no more than fit."""
        short = [x for x in counts if len(x) <= LONG_CHARS][:CACHE_SIZE]
        if len(self.cache) + len(short) > CACHE_SIZE:
            self.cache.clear()
        self.cache.update((x, counts[x]) for x in short)

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        split = [self.units(text) for text in texts]
        # what this batch needs stays at hand until it is counted, whatever the cache forgets
        lengths, new = self.known(set().union(*(units for units, _ in split)), frequent)
        tokens = {unit: self.pattern.findall(unit) for unit in new}
        parts, missing = self.known(set().union(*tokens.values()), frequent)
        fresh: dict[str, int] = {}
        for at in range(0, len(missing), ENCODED):
            part = missing[at : at + ENCODED]
            fresh.update(zip(part, map(len, self.tokenizer.encode_batch(part, add_special_tokens=False))))
        parts.update(fresh)
        fresh.update((unit, sum(map(parts.__getitem__, found))) for unit, found in tokens.items())
        lengths.update((unit, fresh[unit]) for unit in tokens)
        out = [special + sum(map(lengths.__getitem__, units)) for units, special in split]
        self.learn(fresh)
        return out


def frequent_pre_tokens(texts: DataFrame, path: str, table_size: int) -> list[str]:
    """The most frequent pre-tokens of a column `text`, from counts that each task combines."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, pattern = Counter(), Counter(), Counts.of(path).pattern
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(text.split())
            if len(words) > 8 * table_size:  # a bounded summary: rare ones give way
                words = Counter(dict(words.most_common(2 * table_size)))
        for word, n in words.items():
            if n > 1:
                for x in pattern.findall(f" {word}"):
                    counts[x] += n
        found = [(x, n) for x, n in counts.most_common(TASK_SIZE) if len(x) <= 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["token", "n"]
        )

    totals = texts.select("text").mapInArrow(top, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [row.token for row in totals.orderBy(F.desc("n"), "token").limit(table_size).collect()]


def token_counts(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, by the tokenizer in the file `path` (which executors can open)."""
    texts = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    frequent = frequent_pre_tokens(texts, path, table_size)
    spark = docs.sparkSession
    known = Counts.of(path)
    lengths = dict(zip(frequent, map(len, known.tokenizer.encode_batch(frequent, add_special_tokens=False))))
    shared = spark.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, table = Counts.of(path), shared.value
        for batch in batches:
            ids, column, sizes = batch.columns
            numbers = []
            for at in range(0, len(column), 64):
                numbers += counts.count(column.slice(at, 64).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
