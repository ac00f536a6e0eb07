"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A run holds the keys that one batch was the first to bring, with what that batch said of them (in how many
documents, the largest id). What a new batch says is merge-anti-joined with all runs: keys that none holds become the batch's own run of
level 0, so runs never share a key; what it says of keys that some run holds is an addition to them, kept beside the runs. Once a level
has `fanout` runs they are merged into one of the next level, and so are additions.

Runs and additions are tables bucketed and sorted by hash, so the joins of a batch with them move none of their rows. They lie in one folder
together with a manifest of the levels, which is written last: another session opens the folder and goes on with later batches, and what a
run that died has left half-written is not in the manifest.

Skew: counts are combined within tasks before they are shuffled, and documents are counted by (key, id), so a
line that a third of the documents share is dealt out by id. Texts are shuffled once, by document, beside the
list of hashes that the document loses, and only if that list is too long to broadcast.

Defined results: null and empty texts are one empty line. A document is what carries one id; repeated
rows of an id count as one document and lose the same lines. Rows with null id are one document, smaller than
any other. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.common import ascii_lower, new_folder, stored, whole_text
from lakestrata.sources.storage import Files

WHITE = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def hash_of(key: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_hashes(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """h1, h2 and id of every line with a key of at least `least_chars` code points."""
    lines = docs.select(F.col(id_column).alias("id"), F.explode(F.split(whole_text(text_column), "\n")).alias("line"))
    return (
        lines.filter(F.char_length("line") >= least_chars)
        .select("id", key_of(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= least_chars)
        .select("id", *hash_of(F.col("key")))
    )


def counted(lines: DataFrame) -> DataFrame:
    """Documents and largest id per hash; a null id is a document too."""
    pairs = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("largest"))


RUN = "h1 BIGINT, h2 BIGINT, documents BIGINT, largest {}"
KEY = ["h1", "h2"]


class LineRuns:
    """Levelled sorted runs and additions in files under one folder; an existing folder is opened as it was left."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.fanout, self.id_type = spark, fanout, id_type
        # one bucket for each task of a shuffle, so that a task writes one file
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or new_folder(spark, "line-runs")
        self.levels: dict[str, list[list[str]]] = {"run": [], "addition": []}
        self.version = 0
        found = [path for path in Files(spark).glob(f"{self.folder}/manifest-*/_SUCCESS")]
        if found:
            self.version = max(int(path.rsplit("/", 2)[1].split("-")[1]) for path in found)
            for row in spark.read.parquet(f"{self.folder}/manifest-{self.version}").orderBy("place").collect():
                levels, self.buckets = self.levels[row.kind], row.buckets
                levels += [[] for _ in range(row.level + 1 - len(levels))]
                levels[row.level].append(row.name)

    def _table(self, name: str) -> DataFrame:
        """A stored run; a session that did not write it registers its files first."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({RUN.format(self.id_type)}) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
            )
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        sorted_rows = rows.select("h1", "h2", "documents", "largest").repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        sorted_rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _of(self, kind: str) -> list[DataFrame]:
        return [self._table(name) for level in self.levels[kind] for name in level]

    def runs(self) -> list[DataFrame]:
        return self._of("run")

    def additions(self) -> list[DataFrame]:
        return self._of("addition")

    def fresh(self, said: DataFrame) -> DataFrame:
        """What is said of keys that no run holds."""
        return reduce(lambda rest, run: rest.join(run.select(*KEY), KEY, "left_anti"), self.runs(), said)

    def known(self, said: DataFrame) -> DataFrame | None:
        """What is said of keys that some run holds; only one does."""
        parts = [said.join(run.select(*KEY), KEY, "left_semi") for run in self.runs()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def add(self, batch: DataFrame) -> DataFrame:
        """Fold in one batch of (id, h1, h2), whose ids no earlier batch has; returns its run."""
        said = self._table(self._write(counted(batch)))
        run, known = self._write(self.fresh(said)), self.known(said)
        if known is not None:
            self._push("addition", self._write(known), 0)
        self._push("run", run, 0)
        self._save()
        return self._table(run)

    def _push(self, kind: str, name: str, level: int) -> None:
        levels = self.levels[kind]
        if len(levels) == level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) == self.fanout:
            together = reduce(DataFrame.unionByName, map(self._table, levels[level]))
            compacted = self._write(together if kind == "run" else summed(together))
            levels[level] = []
            self._push(kind, compacted, level + 1)

    def _save(self) -> None:
        rows = [(kind, k, name) for kind, levels in self.levels.items() for k, level in enumerate(levels) for name in level]
        numbered = [(place, *row, self.buckets) for place, row in enumerate(rows)]
        self.version += 1
        manifest = self.spark.createDataFrame(numbered, "place int, kind string, level int, name string, buckets int").coalesce(1)
        manifest.write.parquet(f"{self.folder}/manifest-{self.version}")

    def all(self) -> DataFrame:
        """Every key with its documents and largest id: the keys of all runs, which have none in common, and what was added to them."""
        keys = reduce(DataFrame.unionByName, self.runs())
        if not self.additions():
            return keys
        more = summed(reduce(DataFrame.unionByName, self.additions())).withColumnsRenamed({"documents": "more", "largest": "later"})
        both = keys.join(more, KEY, "left")
        return both.select(*KEY, (F.col("documents") + F.coalesce("more", F.lit(0))).alias("documents"), F.greatest("largest", "later").alias("largest"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.max("largest").alias("largest"))


def repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
) -> tuple[DataFrame, DataFrame]:
    """h1, h2 and the largest id of keys found in at least `least_documents` documents; and id, h1, h2 of all lines."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(F.lit("batch"), "id"), F.lit(batches))
    lines = line_hashes(docs, id_column, text_column, least_chars).withColumn("batch", batch)
    path = new_folder(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, id_type=lines.schema["id"].dataType.simpleString())
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number).drop("batch"))
    repeated = runs.all().filter(F.col("documents") >= least_documents).select("h1", "h2", "largest")
    return stored(repeated, new_folder(spark, "line-repeated")), lines.drop("batch")


def drop_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES,
) -> DataFrame:
    """The documents with their text rewritten, and columns line_count (before) and lines_dropped.

    These two are prefixed with `_` as often as needed to differ from the columns of `docs`.
    """
    repeated, lines = repeated_lines(docs, id_column, text_column, least_chars, least_documents, batches)
    lost = (
        lines.join(repeated, KEY)
        .filter(~F.col("id").eqNullSafe(F.col("largest")))
        .groupBy("id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    )
    taken = set(docs.columns)
    mark = "lost"
    while mark in taken:
        mark = f"_{mark}"
    counts = []
    for name in ("line_count", "lines_dropped"):
        while name in taken:
            name = f"_{name}"
        counts.append(name)
    right = lost.select(F.col("id").alias(f"{mark}_id"), F.col("lost").alias(mark))
    joined = docs.join(right, docs[id_column].eqNullSafe(right[f"{mark}_id"]), "left").drop(f"{mark}_id")
    split = F.split(whole_text(text_column), "\n")

    def stays(line: Column) -> Column:
        key = key_of(line)
        return (F.char_length(key) < least_chars) | ~F.array_contains(F.col(mark), F.struct(*hash_of(key)))

    rest = F.when(F.col(mark).isNotNull(), F.filter(split, stays))
    return joined.withColumns({counts[0]: F.size(split).cast("long"), f"{mark}_rest": rest}).select(
        *[
            (F.when(F.col(f"{mark}_rest").isNotNull(), F.concat_ws("\n", f"{mark}_rest")).otherwise(F.col(text_column))).alias(c)
            if c == text_column
            else F.col(c)
            for c in docs.columns
        ],
        counts[0],
        F.when(F.col(f"{mark}_rest").isNotNull(), F.col(counts[0]) - F.size(f"{mark}_rest")).otherwise(0).cast("long").alias(counts[1]),
    )
