"""Phrase collocations from Rabin-Karp fingerprints.

Texts are cut into pieces, and pieces into words. Prefix polynomials over the word hashes give the 64-bit fingerprint of every
n-gram by one subtraction. Each task sums what is equal, and the shuffle adds up (fingerprint, count, checks, pointer):
`checks` sums, over the occurrences, `CHECK_BITS` bits of a second, independent polynomial, and the pointer is one occurrence (a
hash of its document, the word's position, the length). Only fingerprints that reach the least count are followed to a text:

* the phrase is read at its pointer. If its fingerprint is the one and its check, times the count, is the sum, all occurrences
  are that phrase;
* otherwise several phrases share the fingerprint. Their occurrences are read again and counted by their text.

N-grams are counted level by level: words, then pairs of frequent words, then longer ones whose pairs are all frequent, as no phrase
is more frequent than its parts. What a level passes on is a bitmap of fixed size (`BITS`): a fingerprint it lets through wrongly is
counted like any other and falls below the least count, so a full bitmap costs time and changes nothing.

Skew: a phrase of any frequency is one row of each task before the shuffle. Ranks are taken in buckets of phrases first, so a
language that holds most phrases is no single sort. Identical documents have pointers of their own and are read once.

Defined results: null and empty texts have no words; a null language counts as `und`, together with documents that say so. Repeated
rows count as often as they are there. Other columns are not read. Phrases that are equal in fingerprint and check count as one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakestrata.llm.common import new_folder, stored, whole_text
from lakestrata.llm.words import BASE, INVERSE, LOWER, buffers, chunks, hash_spans, mix, powers

LEAST_COUNT = 100
MOST_WORDS = 5
TOP = 2000
ABSORBED_PERCENT = 100
NO_LANGUAGE = "und"
#: log2 of the bits of a level's bitmap: 16 MB, whatever the corpus.
BITS = 27
#: N-grams that a task holds before it sums them.
HELD = 1 << 21
BUCKETS = 32
#: Totals of so many languages are broadcast; more are joined as Spark finds best.
MOST_LANGUAGES = 10_000

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False

OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)
OTHER_INVERSE = np.uint64(pow(int(OTHER_BASE), -1, 1 << 64))

LENGTH_BITS, POSITION_BITS, CHECK_BITS = 4, 28, 16
MOST_POSITION = 1 << POSITION_BITS


def fingerprints(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
    """Of the n words from each start on, in the language whose hash is `salt`."""
    return mix(hash_spans(sums, down, starts, starts + n) ^ salt ^ mix(np.array([n], np.uint64)))


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CHECK_BITS)).astype(np.int64)


@dataclass
class Pieces:
    """The words of some texts with prefix polynomials over their hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # where the words of each text begin
    piece: np.ndarray  # of each word
    owner: np.ndarray
    salt: np.ndarray  # of each text
    main: tuple[np.ndarray, np.ndarray]
    check: tuple[np.ndarray, np.ndarray]
    mask: np.uint64

    @classmethod
    def of(cls, texts: pa.Array, langs: np.ndarray, mask: np.uint64) -> Pieces:
        raw, begins = buffers(texts)
        data = LOWER[raw]
        inside = IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[begins] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        cuts = np.cumsum(BREAK[data] | edge[:-1])
        first = np.searchsorted(starts, begins)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        polynomials = []
        for base, inverse in ((BASE, INVERSE), (OTHER_BASE, OTHER_INVERSE)):
            digits = (data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data))
            hashes = hash_spans(np.concatenate([np.zeros(1, np.uint64), np.cumsum(digits, dtype=np.uint64)]), powers(inverse, len(data) + 1), starts, ends)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)])
            polynomials.append((sums, powers(inverse, len(hashes) + 1)))
        return cls(data, starts, ends, first, cuts[starts], owner, mix(langs), *polynomials, mask)

    def grams(self, n: int, known: np.ndarray | None = None, part: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of all n-grams within pieces, of those with known parts of `part` words if `known` is given."""
        size = len(self.starts) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = self.piece[:size] == self.piece[n - 1 :]
        if known is not None:
            fit = np.zeros(len(self.starts), bool)
            at, own = self.grams(part)
            fit[at] = in_bitmap(own, known)
            for k in range(n - part + 1):
                whole &= fit[k : k + size]
        starts = np.flatnonzero(whole)
        return starts, fingerprints(*self.main, starts, n, self.salt[self.owner[starts]]) & self.mask

    def checks(self, starts: np.ndarray, n: int) -> np.ndarray:
        return short(fingerprints(*self.check, starts, n, self.salt[self.owner[starts]]))

    def phrase(self, start: int, n: int) -> str:
        return " ".join(self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace") for k in range(start, start + n))


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() - 1 + 6
    top = values >> np.uint64(64 - bits)
    return (bitmap[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(values: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which of the 2^bits ranges the column `fp` hits; at most 2^(bits - 6) rows reach the driver."""
    top = F.shiftrightunsigned("fp", 64 - bits)
    words = (
        values.select(top.alias("top"))
        .groupBy(F.shiftrightunsigned("top", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(top & 63 AS INT)))").alias("held"))
    )
    found = words.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found["word"].to_numpy().astype(np.int64)] = found["held"].to_numpy().astype(np.int64).view(np.uint64)
    return bitmap


SUMMED = "fp long, n long, checks long, pointer long"


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of (fp, n, checks, pointer), one per fingerprint."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0])]
    new = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])) if rows.shape[1] else np.zeros(0, np.int64)
    if not len(new):
        return rows
    kinds = (np.add, np.add, np.minimum)
    return np.stack([rows[0, new], *(kind.reduceat(row, new) for kind, row in zip(kinds, rows[1:]))])


def batches_of(rows: np.ndarray, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.shape[1], size):
        yield pa.RecordBatch.from_arrays([pa.array(row[at : at + size]) for row in rows], ["fp", "n", "checks", "pointer"])


def level_of(words: Column) -> Column:
    return F.when(words < 2, 1).when(words == 2, 2).otherwise(3)


def counted(docs: DataFrame, sizes: Sequence[int], known: np.ndarray | None, part: int, least: int, mask: np.uint64, most_held: int) -> DataFrame:
    """Fingerprints of n-grams of the given sizes that reach the least count; size 0 is the number of words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            marks, langs = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for at, texts in chunks(batch.column(2)):
                own = langs[at : at + len(texts)].view(np.uint64)
                pieces = Pieces.of(texts, own, mask)
                counts = np.diff(pieces.first)
                if counts.max(initial=0) > MOST_POSITION:
                    raise ValueError(f"a text of more than {MOST_POSITION} words")
                prefix = (marks[at : at + len(texts)] >> np.int64(32)) << np.int64(32)
                for n in sizes:
                    if n:
                        starts, fps = pieces.grams(n, shared.value, part)
                        checks, ones = pieces.checks(starts, n), np.ones(len(starts), np.int64)
                    else:  # the empty phrase, once per word
                        starts = np.flatnonzero(counts > 0)
                        fps, ones = mix(pieces.salt[starts]) & mask, counts[starts].astype(np.int64)
                        checks = short(pieces.salt[starts]) * ones
                    owner = pieces.owner[starts] if n else starts
                    place = starts - pieces.first[:-1][owner] if n else np.zeros(len(starts), np.int64)
                    pointer = prefix[owner] | place << np.int64(LENGTH_BITS) | np.int64(n)
                    rows = combined([np.stack([fps.view(np.int64), ones, checks, pointer])])
                    held.append(rows)
                    total += rows.shape[1]
                if total > most_held:
                    held = [combined(held)]
                    total = held[0].shape[1]
                    if total > most_held // 2:
                        yield from batches_of(held[0])
                        held, total = [], 0
        if held:
            yield from batches_of(combined(held))

    rows = docs.select("mark", "lang_hash", "text").mapInArrow(run, SUMMED)
    # in this order what is random lies together, and the rest of a row is like that of the row before: it shuffles in fewer bytes
    sums = rows.groupBy("fp").agg(F.min("pointer").alias("pointer"), F.sum("checks").alias("checks"), F.sum("n").alias("n"))
    size = F.col("pointer").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
    frequent = sums.filter((F.col("n") >= least) | (size == 0)).withColumn("level", level_of(F.lit(max(sizes))))
    return stored(frequent, new_folder(docs.sparkSession, "phrase-counts"))


def read_at_pointers(docs: DataFrame, found: DataFrame, mask: np.uint64, bits: int) -> DataFrame:
    """fp, level, lang, phrase, words and n of the fingerprints of one phrase each, read at their pointers."""
    spark = docs.sparkSession
    prefix = F.shiftright("pointer", 32)
    wanted = found.groupBy(prefix.alias("prefix")).agg(F.collect_list(F.struct("fp", "level", "checks", "n", "pointer")).alias("wanted"))
    wanted = stored(wanted, new_folder(spark, "phrase-pointers"))
    held = spark.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64("prefix").alias("fp")), bits))

    def may_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(in_bitmap(keys.view(np.uint64), held.value)))

    keyed = docs.select("mark", "lang", "lang_hash", "text", F.xxhash64(F.shiftright("mark", 32)).alias("key"))
    few = keyed.mapInArrow(may_hold, keyed.schema).select("lang", "lang_hash", "text", "mark", F.shiftright("mark", 32).alias("prefix"))
    # dealt out once, for repeated rows and for the join
    few = few.repartition("prefix").groupBy("prefix", "mark").agg(*(F.any_value(name).alias(name) for name in ("lang", "lang_hash", "text")))
    joined = few.join(wanted, "prefix").select("lang", "lang_hash", "text", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2)
            for i in range(batch.num_rows):
                pieces = Pieces.of(texts.slice(i, 1).cast(pa.large_string()), hashes[i : i + 1].view(np.uint64), mask)
                asked = batch.column(3)[i].values.flatten()
                fp, level, checks, n, pointer = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in asked)
                size = pointer & np.int64((1 << LENGTH_BITS) - 1)
                place = pointer >> np.int64(LENGTH_BITS) & np.int64(MOST_POSITION - 1)
                out = []
                for words in np.unique(size):
                    of_size = np.flatnonzero((size == words) & (place + words <= len(pieces.starts)))
                    if words:
                        seen = fingerprints(*pieces.main, place[of_size], int(words), pieces.salt[[0]]) & mask
                        check = pieces.checks(place[of_size], int(words))
                    else:
                        seen, check = mix(pieces.salt) & mask, short(pieces.salt)
                    same = (seen.view(np.int64) == fp[of_size]) & (check * n[of_size] == checks[of_size])
                    out += [(int(fp[k]), int(level[k]), pieces.phrase(place[k], int(words)), int(words), int(n[k])) for k in of_size[same]]
                if out:
                    fps, levels, phrases, words, counts = zip(*out)
                    columns = [pa.array(fps), pa.array(levels, pa.int32()), pa.repeat(names[i], len(out)), pa.array(phrases), pa.array(words), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["fp", "level", "lang", "phrase", "words", "n"])

    read_there = joined.mapInArrow(read, "fp long, level int, lang string, phrase string, words long, n long")
    # documents whose hashes begin alike may hold the same phrase there
    return stored(read_there.dropDuplicates(["fp", "level"]), new_folder(spark, "phrase-texts"))


def read_by_text(docs: DataFrame, shared_by_many: DataFrame, least: int, most_words: int, mask: np.uint64, bits: int) -> DataFrame:
    """The same for fingerprints of several phrases: their occurrences are counted by their text."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(shared_by_many.select("fp"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in chunks(batch.column(2)):
                pieces = Pieces.of(texts, langs[at : at + len(texts)].view(np.uint64), mask)
                counts: dict[tuple, int] = {}
                sizes = np.diff(pieces.first)
                for i in np.flatnonzero((sizes > 0) & in_bitmap(mix(pieces.salt) & mask, held.value)).tolist():
                    counts[(int((mix(pieces.salt[[i]]) & mask).view(np.int64)[0]), at + i, 0, "")] = int(sizes[i])
                for n in range(1, most_words + 1):
                    starts, fps = pieces.grams(n)
                    hit = in_bitmap(fps, held.value)
                    for start, fp in zip(starts[hit].tolist(), fps[hit].view(np.int64).tolist()):
                        key = (fp, at + int(pieces.owner[start]), n, pieces.phrase(start, n))
                        counts[key] = counts.get(key, 0) + 1
                if counts:
                    fps, rows, sizes, phrases = zip(*counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps), batch.column(0).take(pa.array(rows)), pa.array(phrases), pa.array(sizes), pa.array(list(counts.values()))],
                        ["fp", "lang", "phrase", "words", "n"],
                    )

    rows = docs.select("lang", "lang_hash", "text").mapInArrow(run, "fp long, lang string, phrase string, words long, n long")
    known = rows.withColumn("level", level_of(F.col("words"))).join(shared_by_many.select("fp", "level"), ["fp", "level"], "left_semi")
    sums = known.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return sums.filter((F.col("n") >= least) | (F.col("words") == 0)).select("lang", "phrase", "words", "n")


def phrase_counts(
    docs: DataFrame,
    least_count: int = LEAST_COUNT,
    most_words: int = MOST_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    bits: int = BITS,
    fingerprint_bits: int = 64,
    most_held: int = HELD,
) -> DataFrame:
    """lang, phrase (joined by spaces), words and n of every phrase of up to `most_words` words that occurs often enough.

    The phrase of no words stands for the number of all words of its language.
    """
    if not 1 < most_words < 1 << LENGTH_BITS:
        raise ValueError(f"phrases have 2 to {(1 << LENGTH_BITS) - 1} words")
    spark = docs.sparkSession
    mask = np.uint64((1 << 64) - 1 >> 64 - fingerprint_bits << 64 - fingerprint_bits)
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col(id_column).alias("id"), lang.alias("lang"), whole_text(text_column).alias("text"))
    rows = rows.select("lang", "text", F.xxhash64("id", "lang", "text").alias("mark"), F.xxhash64("lang").alias("lang_hash"))
    levels, known, part = [], None, 1
    for sizes in [(0, 1), (2,), tuple(range(3, most_words + 1))]:
        if sizes:
            levels.append(counted(rows, sizes, known, part, least_count, mask, most_held))
            known, part = bitmap_of(levels[-1].select("fp"), bits), max(sizes)
    found = reduce(DataFrame.unionByName, levels)
    read = read_at_pointers(rows, found, mask, bits)
    phrases = read.drop("fp", "level")
    doubtful = found.join(read, ["fp", "level"], "left_anti")
    if not doubtful.isEmpty():
        phrases = phrases.unionByName(read_by_text(rows, doubtful, least_count, most_words, mask, bits))
    return stored(phrases, new_folder(spark, "phrases"))


def scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with the cut of the lowest score: lang, phrase, words, a, l, r, n, score."""
    parts = counts.filter("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    own = F.split("phrase", " ")
    cuts = (
        counts.filter("words > 1")
        .select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k"))
        .withColumns({"left": F.array_join(F.slice(own, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(own, F.col("k") + 1, F.col("words").cast("int")), " ")})
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(1000BD * {wide('a')} * {wide('total')}) DIV ({wide('l')} * {wide('r')})").alias("score")
    few = counts.filter("words = 0").count() <= MOST_LANGUAGES
    lowest = cuts.join(F.broadcast(totals) if few else totals, "lang").withColumn("score", score)
    return (
        lowest.groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "words", "a", F.col("total").alias("n"))).alias("cut"))
        .select("lang", "phrase", *(F.col(f"cut.{name}").alias(name) for name in ("words", "a", "l", "r", "n", "score")))
    )


def without_absorbed(candidates: DataFrame, percent: int = ABSORBED_PERCENT) -> DataFrame:
    """Drop phrases inside a longer one, if that occurs in at least `percent` of a hundred of their occurrences."""
    own = F.split("phrase", " ")
    size = F.col("words").cast("int")
    inner = (
        candidates.filter("words > 2")
        .select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
        .select("lang", "phrase", "words", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
        .select("lang", F.array_join(F.slice(own, F.col("at"), F.col("m")), " ").alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    rest = candidates.join(inner, ["lang", "phrase"], "left")
    return rest.filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a"), F.lit(True))).drop("longer")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by score, count and phrase, with their rank from 1 on."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    within = candidates.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    few = within.filter(F.col("rank") <= top).drop("rank", "bucket")  # at most top times BUCKETS of a language
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, top: int = TOP, percent: int = ABSORBED_PERCENT, **counting) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n and score of each language's best phrases; `counting` goes to `phrase_counts`."""
    found = scored(phrase_counts(docs, **counting))
    return best(without_absorbed(found, percent), top).select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
