"""License scans over a positional index of rare licence words, in DataFrame functions alone.

A template is a licence text with a label and a mandatory key phrase. The index holds a posting (template, place, weight) for the
`ANCHORS` words of each template with the highest IDF, counted over all documents. Each file's words are looked up in it: what
is found are the file's highest-IDF licence words. A hit of a template's word shifted by its place in the template is where that
template would begin; postings that meet in one shift stand in the same relative position. The weight of the words that
meet there, over that of all the template's anchors, is the evidence. A template is labelled where that is at least `LEAST_SHARE`
and the key phrase stands at its place from the shift on, word by word.

Base phrases are templates that are their own key phrase: a place of theirs is a shift with the whole phrase behind it. All words of a base
phrase are anchors, so all places are found, overlapping ones too.

Skew: hits stay in the row of their text until only (row, template, shift, word) is left of them; that is grouped by row, template and
shift, so a template that a third of all files carry is dealt out. Texts are never shuffled. The index is part of the plan as literals; it
has at most `ANCHORS` postings for each template and one for each word of a base phrase.

Defined results: null and empty texts have no words, no places, no labels and a score of 0. Repeated rows (equal in id and text) have equal
results each, null ids too. Other columns are not read. A template without words matches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.common import ascii_lower, new_folder, stored, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 6
LEAST_SHARE = 0.5
ROW = ["doc_id", "mark"]


@dataclass(frozen=True)
class Template:
    """A licence text; `key` is the phrase of it that must be there, the whole text if it is a base phrase."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_place(self) -> int:
        own, key = self.words, self.key_words
        return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


def base(label: str, phrase: str) -> Template:
    return Template(label, phrase, phrase, base=True)


# The base phrases with their labels, and short notices of common licences.
BASE = (
    base("gpl", "gnu general public license"),
    base("apache", "apache license"),
    base("cc-by", "cc by"),
    base("mit", "mit license"),
)
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "under the terms of the gnu general public license",
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit-release", "released under the mit license", "released under the mit license"),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
)
TEMPLATES = BASE + NOTICES


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(WORD), F.lit(0))


def rows_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, mark (a hash of the text) and words of every row."""
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(whole_text(text_column)).alias("mark"), words_of(text_column).alias("words"))


def places_of(wanted: Sequence[str]) -> Column:
    """Places of the wanted words in the array `words`."""
    marked = F.transform("words", lambda word, i: F.when(word.isin(*wanted), i))
    return F.filter(marked, lambda place: place.isNotNull())


def weights(rows: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """The IDF of each licence word over all documents, in whole thousandths; as many rows as the vocabulary reach the driver."""
    own = F.array_distinct(F.filter("words", lambda word: word.isin(*vocabulary)))
    counts = rows.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    words = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, vocabulary)).cast("array<string>")).alias("word"))
    known = words.join(counts, "word", "left")
    idf = F.floor(1000 * F.log((F.lit(total) + 1.0) / (F.coalesce("n", F.lit(0)) + 1.0))) + 1
    return {row.word: row.weight for row in known.select("word", idf.alias("weight")).collect()}


def postings(templates: Sequence[Template], weight: dict[str, int], anchors: int) -> list[tuple[int, int, int, int]]:
    """(template, place, weight, weight of all its anchors) of the heaviest words of each template, the first ones among equals."""
    out = []
    for t, template in enumerate(templates):
        most = len(template.words) if template.base else anchors
        best = sorted(range(len(template.words)), key=lambda i: (-weight[template.words[i]], i))[:most]
        total = sum(weight[template.words[i]] for i in best)
        out += [(t, i, weight[template.words[i]], total) for i in sorted(best)]
    return out


def evidence(templates: Sequence[Template], index: Sequence[tuple[int, int, int, int]]) -> Column:
    """For each hit of a row: template, shift, place and weight of the posting, and whether the key phrase stands there."""
    by_word: dict[str, list[Column]] = {}
    for t, place, weight, _ in index:
        word = templates[t].words[place]
        by_word.setdefault(word, []).append((t, place, weight))

    def entries(hit: Column) -> Column:
        found = F.array().cast("array<struct<template:int,shift:int,place:int,weight:int,whole:boolean>>")
        for word, own in sorted(by_word.items()):
            met = []
            for t, place, weight in own:
                key, shift = templates[t].key_words, hit - place
                begin = shift + templates[t].key_place + 1
                at_place = F.when(begin > 0, F.slice("words", F.greatest(begin, F.lit(1)), F.lit(len(key))) == F.array(*map(F.lit, key))).otherwise(False)
                met.append(F.struct(F.lit(t).alias("template"), shift.alias("shift"), F.lit(place).alias("place"), F.lit(weight).alias("weight"), at_place.alias("whole")))
            found = F.when(F.get("words", hit) == word, F.array(*met)).otherwise(found)
        return found

    return F.flatten(F.transform("hits", entries))


def license_scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    anchors: int = ANCHORS,
    least_share: float = LEAST_SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, mark, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score.

    The score is the largest share of a template's weight that meets in one place of the text.
    """
    spark = docs.sparkSession
    templates = [template for template in templates if template.words]
    rows = rows_of(docs, id_column, text_column)
    vocabulary = sorted({word for template in templates for word in template.words})
    index = postings(templates, weights(rows, vocabulary), anchors)
    rare = sorted({templates[t].words[place] for t, place, _, _ in index})
    hits = rows.select(*ROW, F.size("words").cast("long").alias("n_words"), "words", places_of(rare).alias("hits"))
    met = F.when(F.size("hits") > 0, evidence(templates, index))
    found = stored(hits.select(*ROW, "n_words", met.alias("met")), new_folder(spark, "license-hits"))

    totals = {t: total for t, _, _, total in index}
    by_template = lambda values, kind: F.element_at(F.array(*(F.lit(value).cast(kind) for value in values)), F.col("template") + 1)
    # repeated rows say the same, so what meets is taken as a set
    agreed = (
        found.filter("met IS NOT NULL")
        .select(*ROW, F.inline("met"))
        .groupBy(*ROW, "template", "shift")
        .agg(F.collect_set(F.struct("place", "weight")).alias("own"), F.max("whole").alias("whole"))
        .withColumn("met", F.aggregate("own", F.lit(0).cast("long"), lambda held, one: held + one["weight"]))
        .withColumn("total", by_template([totals.get(t, 1) for t in range(len(templates))], "long"))
        .withColumn("share", F.expr("1000000 * met DIV total"))  # in millionths
        .withColumns({"label": by_template([x.label for x in templates], "string"), "base": by_template([x.base for x in templates], "boolean")})
    )
    place = F.when(F.col("base") & F.col("whole"), F.col("shift")).cast("long")
    labelled = F.col("whole") & (F.col("base") | (F.col("share") >= round(1_000_000 * least_share)))
    said = agreed.groupBy(*ROW).agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base") & F.col("whole"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(labelled, F.col("label")))).alias("labels"),
        F.max("share").alias("score"),
    )
    none = F.array().cast("array<string>")
    own = found.drop("met").alias("own").join(
        said.withColumnsRenamed({"doc_id": "d", "mark": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left"
    )
    return own.select(
        *ROW, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        (F.coalesce("score", F.lit(0)) / 1_000_000.0).alias("score"),
    )
