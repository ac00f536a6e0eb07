"""Toxicity scores: a noisy channel restores disguised words, then the restored text is scored.

Language model. Letter trigrams are counted over all documents; each task counts in one array, Spark adds the
cells up. The model has at most 29 ** 3 cells whatever the corpus.

Channel. Only stretches that look disguised are decoded: letters with digits or signs between them, letters spelt out with
spaces or punctuation (single letters and signs may be mixed), letters repeated twice or more in either case. Each becomes a
lattice - a sign is itself lost, or one of the letters it can stand for; a run of one letter, also over separators and signs that
stand for it alone, is one or two of it - and the Viterbi path under the model and the costs of the channel is the restored word. Stretches of single letters are decoded once more with a way to
end a word at each gap, so spelt-out sentences fall into words again. Stretches are decoded alike at every length, with and without
the signs at their ends. A stretch read as one word counts if a beginning of it is likelier than letters drawn evenly, which keys and the like
are not. Only stretches of up to `REMEMBERED_CHARS` characters are kept for the next text.

Scores. Units are whole words and their first 4, 5 and 6 bytes. From the labelled training rows a lexicon is
learnt by covering: units are taken in order of the lower bound of their precision, and each must explain toxic
rows that no earlier one did; copies count once (rows are counted by a MinHash of their word 5-grams). A text's score is a noisy-or over its distinct
words, original and restored, of the precision of their best unit.

The fit reads at most `most_labelled` labelled rows, those of the smallest hash, a stated bound. All else covers all data.

Defined results: null and empty texts get the base score, as do all texts if no row is labelled toxic or clean. Null labels are left out; with several labels
for an id the largest counts. Repeated rows get equal scores. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import fold, new_folder, stored, whole_text
from lakestrata.llm.words import LOWER, Words, buffers, chunks, shingles, words_of

MOST_LABELLED = 20_000
BASE_SCORE = 0.02
Z = 1.64
LEAST_ROWS = 3
LEAST_PRECISION = 0.5
PREFIXES = (4, 5, 6)

#: Fixed values of the channel: the letters that a sign can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SIGNS = "".join(LEET)
SEPARATORS = " .-_*~'/\\"
SUBSTITUTE, DOUBLE, BREAK = 1.0, 0.7, 0.5
#: What it costs to lose a sign: marks of punctuation come beside words more often than digits and currencies do.
LOSE = {sign: 4.5 if sign in "!|+(<*¡" else 9.0 for sign in LEET}
#: Longer stretches are decoded each time they come, so that what a worker remembers is bounded in bytes.
REMEMBERED_CHARS = 64

LETTERS = 29  # a-z, beyond ASCII, digits, and the edge of a word


def letter_classes() -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[ord("a") : ord("z") + 1] = np.arange(1, 27)
    found[128:] = 27
    found[ord("0") : ord("9") + 1] = 28
    return found


CLASSES = letter_classes()
ANY = re.escape(SIGNS)
LETTER = r"[^\W\d_]"
MARK = re.escape("".join(sign for sign in SIGNS if not sign.isdigit()))
GAPS = "".join(sign for sign in SEPARATORS if sign not in SIGNS)
GAP = re.escape(GAPS)
BETWEEN = rf"[{re.escape(SEPARATORS)}{MARK}]++"
DISGUISED = re.compile(
    # s p 3 l t: single letters, digits and signs, each of them also repeated
    rf"(?<![^\W_])(?<![{ANY}])(?:[{MARK}]++[{GAP}]*+)?([^\W_])(?i:\1)*+{BETWEEN}([^\W_])(?i:\2)*+(?![^\W_])"
    rf"(?:(?:{BETWEEN}([^\W_])(?i:\3)*+(?![^\W_]))+(?:[{GAP}]+[{MARK}]+(?!\w))*|(?:[{GAP}]+[{MARK}]+(?!\w))+)"
    rf"|(?<![\w{ANY}])(?:"
    rf"[\w{ANY}]*(?:{LETTER}[{ANY}]+{LETTER}|[{ANY}]{LETTER}+)[\w{ANY}]*"  # l3tters and signs
    rf"|\w*({LETTER})(?i:\4)(?i:\4)+\w*"  # repeeeated
    rf")(?![\w])"
)
TWICE = re.compile(rf"({LETTER})\1")


def letter_model(texts: DataFrame) -> np.ndarray:
    """Log-probabilities of a letter class after two others, from all rows of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                raw, _ = buffers(part)
                seen = CLASSES[LOWER[raw]]
                seen = seen[np.concatenate([[True], (seen[1:] != 0) | (seen[:-1] != 0)])] if len(seen) else seen
                seen = np.concatenate([[0, 0], seen, [0]])
                counts += np.bincount(seen[:-2] * LETTERS**2 + seen[1:-1] * LETTERS + seen[2:], minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    sums = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(LETTERS**3)
    for cell, n in sums.toPandas().itertuples(index=False):
        counts[cell] = n
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    bi = tri.sum(0) + 0.5
    back = bi / bi.sum(1, keepdims=True)
    strength = 5.0
    return np.log((tri + strength * back[None]) / (tri.sum(2, keepdims=True) + strength))


def may_be(char: str) -> str:
    return char if char.isalpha() else LEET.get(char, "")


def runs(stretch: str) -> Iterator[tuple[list[str], int, bool]]:
    """Runs that may be one letter, also over separators: their characters, their length, whether separators stand in them."""
    found = [(run[1], len(run[0])) for run in re.finditer(r"(.)\1*", stretch.lower(), re.S)]
    at = 0
    while at < len(found):
        char, n = found[at]
        chars, gaps, to = [char], False, at + 1
        while char not in SEPARATORS:
            after = to
            while after < len(found) and found[after][0] in GAPS:
                after += 1
            if after == len(found):
                break
            other, more = found[after]
            if other in SEPARATORS or other != char and (len(may_be(char)) != 1 or may_be(other) != may_be(char)):
                break
            chars, n, gaps, to = [*chars, other] if other not in chars else chars, n + more, gaps or after > to, after + 1
        yield chars, n, gaps
        at = to


def lattice(stretch: str, words: bool = False) -> list[list[tuple[str, float]]]:
    """For each sign or run of letters, what it may have been and at which cost; with `words`, gaps may end words."""
    steps: list[list[tuple[str, float]]] = []
    folded = list(runs(stretch))
    solid = [chars[0] for chars, _, _ in folded if chars[0] not in GAPS]
    place = -1
    for chars, n, gaps in folded:
        char, ways = chars[0], []
        place += char not in GAPS
        signs = [c for c in chars if not c.isalpha()]
        cost = SUBSTITUTE if signs else 0.0
        for letter in may_be(char):
            ways.append((letter, cost + (2 * DOUBLE if n == 2 else 0.0)))
            if n > 1:
                ways.append((letter * 2, cost + (DOUBLE if n > 2 else 0.0)))
            if words and gaps:
                ways.append((f"{letter} {letter}", cost + BREAK))
                if n > 2:
                    ways += [(f"{letter * 2} {letter}", cost + DOUBLE + BREAK), (f"{letter} {letter * 2}", cost + DOUBLE + BREAK)]
        if len(signs) == len(chars):
            lose = 0.0 if char in SEPARATORS else sum(LOSE.get(c, 0.0) for c in signs)
            beside = solid[max(place - 1, 0) : place] + solid[place + 1 : place + 2] if char in LEET else []
            if len(may_be(char)) > 1 and any(may_be(c) and may_be(c) in may_be(char) for c in beside if c != char):
                lose = min(lose, SUBSTITUTE + 2 * DOUBLE)  # it repeats the letter beside it
            ways.append(("", lose))
            if words and (char in SEPARATORS or gaps):
                ways.append((" ", lose + BREAK))
        steps.append(ways)
    return steps


def code(letter: str) -> int:
    return int(CLASSES[ord(letter)]) if ord(letter) < 128 else 27


def restore(stretch: str, model: np.ndarray, words: bool = False) -> str:
    """The likeliest word (or words) behind a stretch: Viterbi over its lattice, with the last two letters as state."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice(stretch, words):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in paths.items():
            for letters, cost in ways:
                total, p, q = score - cost, a, b
                for letter in letters:
                    r = code(letter)
                    total += model[p, q, r]
                    p, q = q, r
                if (p, q) not in after or after[p, q][0] < total:
                    after[p, q] = (total, (path, letters) if letters else path)
        paths = after
    (a, b), (_, path) = max(paths.items(), key=lambda x: x[1][0] + model[x[0][0], x[0][1], 0])
    found = []
    while path:
        path, letters = path
        found.append(letters)
    return "".join(reversed(found))


_restored: dict[str | int, list[str]] = {}  # by stretch or hash of a word, under the model of that mark
_restored_under: list[float] = []


def remember_for(model: np.ndarray) -> None:
    """Forget what was restored under another model."""
    mark = float(model.sum())
    if _restored_under != [mark]:
        _restored.clear()
        _restored_under[:] = [mark]


def likely(word: str, model: np.ndarray) -> bool:
    """Whether one of the beginnings of a word that are units, or a word shorter than those, is likelier than letters drawn evenly."""
    score, a, b = 0.0, 0, 0
    for n, letter in enumerate(word[: max(PREFIXES)], 1):
        score, a, b = score + model[a, b, code(letter)], b, code(letter)
        if (n in PREFIXES or n == len(word) < min(PREFIXES)) and score > -n * math.log(LETTERS):
            return True
    return False


def readings(stretch: str, model: np.ndarray) -> list[str]:
    """The words that a stretch may have been, other than itself; with and without the signs at its ends."""
    spelt = any(sign in SEPARATORS for sign in stretch)
    ends = SIGNS + SEPARATORS
    words = set()
    for part in {stretch, stretch.lstrip(ends), stretch.rstrip(ends), stretch.strip(ends)}:
        if re.search(LETTER, part) and likely(word := restore(part, model), model):
            words.add(word)
    if spelt:
        words.update(restore(stretch, model, True).split())
    return sorted(words - {"", stretch.lower()})


def restored_words(text: str, model: np.ndarray) -> list[str]:
    found = []
    for match in DISGUISED.finditer(text):
        stretch = match[0]
        if not re.search(LETTER, stretch):
            continue
        words = _restored.get(stretch)
        if words is None:
            if len(_restored) > 200_000:
                _restored.clear()
            words = readings(stretch, model)
            if len(stretch) <= REMEMBERED_CHARS:
                _restored[stretch] = words
        found += words
    return found


def doubled(words: Words, model: np.ndarray) -> tuple[list[int], list[str]]:
    """Owners and restored words of the words that hold a letter twice in a row; each distinct word is decoded once."""
    data = words.data
    hit = np.zeros(len(data) + 1, np.int64)
    hit[2:] = (data[1:] == data[:-1]) & (data[1:] >= 97) & (data[1:] <= 122)
    high = data >= 128
    hit[4:] |= high[3:] & high[2:-1] & high[1:-2] & high[:-3]  # two letters beyond ASCII
    counts = np.cumsum(hit)
    found = np.flatnonzero(counts[words.ends] > counts[words.starts + 1])
    hashes, first, which = np.unique(words.hashes[found], return_index=True, return_inverse=True)
    restored = []
    for value, i in zip(hashes.tolist(), found[first].tolist()):
        ways = _restored.get(value)
        if ways is None:
            word = words.text(i)
            ways = readings(word, model) if TWICE.search(word.lower()) else []
            if len(_restored) > 200_000:
                _restored.clear()
            if len(word) <= REMEMBERED_CHARS:
                _restored[value] = ways
        restored.append(ways)
    owners, extra = [], []
    some = np.array([bool(ways) for ways in restored], bool)[which]
    for value, owner in zip(which[some].tolist(), words.owner[found[some]].tolist()):
        owners += [owner] * len(restored[value])
        extra += restored[value]
    return owners, extra


def disguise_possible(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which texts hold a sign before a letter, a letter three times, or a letter, once or repeated, that stands alone.

    In texts of ASCII alone a letter that stands alone counts only beside another such letter or digit. Every text in which
    `DISGUISED` finds letters is among them; what is beyond ASCII counts as a letter and as an end of one.
    """
    if not len(data):
        return np.zeros(len(begins) - 1, bool)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in SIGNS if ord(c) < 128]] = True
    signs, high = sign[data], data >= 128
    hit = np.zeros(len(data), bool)
    hit[:-1] |= signs[:-1] & letter[1:]
    for other in (c.encode() for c in SIGNS if ord(c) >= 128):
        found = data[len(other) - 1 :] == other[-1]
        for k, byte in enumerate(other[:-1]):
            found &= data[k : len(data) - len(other) + 1 + k] == byte
        hit[len(other) - 1 :] |= found
    hit[5:] |= np.logical_and.reduce([high[k : max(len(high) - 5, 0) + k] for k in range(6)])  # three letters beyond ASCII
    hit[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    word = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    before[begins[:-1][begins[:-1] < len(data)]] = False
    after[begins[1:][begins[1:] > 0] - 1] = False
    lone = letter & ~before & (~after | high)
    lone[1:] |= letter[1:] & (data[1:] == data[:-1]) & ~before[:-1] & ~after[1:]
    beyond = np.searchsorted(np.flatnonzero(high), begins)
    hit |= lone & np.repeat(beyond[1:] > beyond[:-1], np.diff(begins))
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    alone = (data[starts] == data[np.minimum(starts + 1, ends)]) & (data[starts] == data[ends])  # or nearly so
    pairs = alone[:-1] & alone[1:] & (letter[starts[:-1]] | letter[starts[1:]])
    owner = np.searchsorted(begins, starts, "right")
    hit[starts[:-1][pairs & (owner[:-1] == owner[1:])]] = True
    counts = np.concatenate([[0], np.cumsum(hit)])
    return counts[begins[1:]] > counts[begins[:-1]]


def units(texts: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text's distinct words, original and restored: the text's number, the word's hash, and its units' hashes."""
    words = words_of(texts)
    owner, levels = words.owner, [words.hashes, *(words.prefix(n) for n in PREFIXES)]
    remember_for(model)
    extra_owner, extra = doubled(words, model)
    for i in np.flatnonzero(disguise_possible(words.data, words.begins)):
        own = restored_words(texts[int(i)].as_py(), model)
        extra += own
        extra_owner += [int(i)] * len(own)
    if extra:
        more = words_of(pa.array(extra, pa.large_string()))
        owner = np.concatenate([owner, np.array(extra_owner)[more.owner]])
        levels = [np.concatenate([a, b]) for a, b in zip(levels, [more.hashes, *(more.prefix(n) for n in PREFIXES)])]
    order = np.lexsort((levels[0], owner))
    owner, table = owner[order], np.stack(levels, 1)[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (table[1:, 0] != table[:-1, 0])
    return owner[new], table[new, 0], table[new]


def precision(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Lower bound of the share of toxic rows (Wilson)."""
    n = np.maximum(toxic + clean, 1)
    p = toxic / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_column: str, text_column: str) -> DataFrame:
    """id, label and text of at most `most` labelled rows that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    spark = docs.sparkSession
    known = spark.createDataFrame(known.collect(), known.schema)  # at most `most` rows of two numbers
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    return stored(rows.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text"), new_folder(spark, "labelled"))


def signature(texts: pa.Array) -> np.ndarray:
    """The MinHash value of each text's word 5-grams: near copies mostly agree in it, other texts do not."""
    values, first = shingles(words_of(texts), 5)
    least = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        least[full] = np.minimum.reduceat(values, first[full])
    return least


def learn_lexicon(rows: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit hashes and their precision, from labelled rows (label, text)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                owner, _, table = units(part, shared.value)
                kind = signature(part)[owner]
                for level in range(table.shape[1]):
                    use = table[:, level] != 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(table[use, level].view(np.int64)),
                            pa.array(kind[use].view(np.int64)),
                            pa.array(np.full(int(use.sum()), level, np.int32)),
                        ],
                        ["unit", "kind", "level"],
                    )

    said = "unit long, kind long, level int"
    toxic = stored(rows.filter("label = 1").select("text").mapInArrow(pairs, said).distinct(), new_folder(spark, "toxic-units"))
    often = toxic.groupBy("unit").agg(F.count(F.lit(1)).alias("toxic"), F.min("level").alias("level")).filter(F.col("toxic") >= LEAST_ROWS)
    often = stored(often, new_folder(spark, "often"))
    clean = rows.filter("label = 0").select("text").mapInArrow(pairs, said).join(often.select("unit"), "unit", "left_semi").distinct()
    clean = clean.groupBy("unit").agg(F.count(F.lit(1)).alias("clean"))
    counted = often.join(clean, "unit", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    # by the bound on labelled rows a bounded number of units
    table = counted.filter(F.col("toxic") > F.col("clean")).toPandas()
    bound = precision(table["toxic"].to_numpy(float), table["clean"].to_numpy(float))
    good = bound >= LEAST_PRECISION
    chosen = dict(zip(table["unit"][good].tolist(), bound[good].tolist()))
    levels = dict(zip(table["unit"].tolist(), table["level"].tolist()))
    clean_rows = dict(zip(table["unit"].tolist(), table["clean"].tolist()))
    where = defaultdict(set)
    if chosen:
        wanted = spark.createDataFrame([(unit,) for unit in chosen], "unit long")
        for unit, kind in toxic.join(F.broadcast(wanted), "unit").select("unit", "kind").toPandas().itertuples(index=False):
            where[unit].add(kind)
    covered: set = set()
    lexicon = {}
    # of units that tell the same, whole words come before beginnings
    for unit, _ in sorted(chosen.items(), key=lambda x: (-x[1], -len(where[x[0]]), levels[x[0]], x[0])):
        fresh = len(where[unit] - covered)
        left = float(precision(np.array([float(fresh)]), np.array([float(clean_rows[unit])]))[0])
        if fresh >= LEAST_ROWS and left >= LEAST_PRECISION:
            lexicon[unit] = chosen[unit]
            covered |= where[unit]
    hashes = np.array(sorted(lexicon), np.int64).view(np.uint64)
    order = np.argsort(hashes)
    weights = np.array([lexicon[unit] for unit in sorted(lexicon)])
    return hashes[order], weights[order]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most_labelled: int = MOST_LABELLED,
    id_column: str = "doc_id",
    text_column: str = "text",
    score: str = "score",
) -> DataFrame:
    """`docs` with a column of scores from 0 to 1; labels of held-out ids are not read."""
    spark = docs.sparkSession
    model = letter_model(docs.select(whole_text(text_column).alias("text")))
    hashes, weights = learn_lexicon(labelled_rows(docs, labels, label, most_labelled, id_column, text_column), model)
    shared = spark.sparkContext.broadcast((model, hashes, weights))
    whole = "text_to_score"
    while whole in docs.columns:
        whole = f"_{whole}"
    schema = docs.select("*", F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, weights = shared.value
        for batch in batches:
            for at, part in chunks(batch.column(batch.num_columns - 1)):
                missed = np.full(len(part), math.log1p(-BASE_SCORE))
                if len(hashes):
                    owner, _, table = units(part, model)
                    place = np.minimum(np.searchsorted(hashes, table), len(hashes) - 1)
                    best = np.where(hashes[place] == table, weights[place], 0.0).max(1) if len(table) else np.zeros(0)
                    np.add.at(missed, owner, np.log1p(-np.minimum(best, 0.999)))
                kept = [batch.column(k).slice(at, len(part)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(-np.expm1(missed))], [f.name for f in schema.fields])

    return docs.withColumn(whole, whole_text(text_column)).mapInArrow(run, schema)
