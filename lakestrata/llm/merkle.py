"""Merkle manifest of a table: every row is a leaf, and gets the proof that leads from it to one root.

A leaf is the digest of a row's fields. The leaves of a group (a language) stand in order of their id; runs of `ARITY` consecutive
nodes are one node of the next level, until one is left, and the last nodes of the groups, in order of the group, go on likewise
up to the root. Each level is one grouping by run, written to the shared folder.

Proofs come by pointer jumping. A node holds a pointer to an ancestor (first its parent) and the siblings on the way there, level by
level, those left and right of the path. One self-join puts the pointer's own pointer and siblings behind a node's, so
the distance doubles each time and a tree of height h is done after about log2(h) joins. Leaves jump last, onto the finished
way of their parent: they are seven eighths of all nodes, and so carry no half-done ways through the joins.

Order: rows are ranked by a range partitioning on (group, id, leaf, position in its task) and the number of rows in the ranges
before, so no window holds a whole group and a group of a third of all rows is dealt out. Joins: a leaf's parent has at most
`ARITY` children; between inner nodes one ancestor serves `ARITY`^d nodes at distance d, of which there are as many times fewer, and up to
`MOST_BROADCAST` of them are broadcast.

Defined results: null fields are `-` in a leaf, null groups come first, null ids come first in their group. Equal ids are ordered by
leaf, and repeated rows have leaves of their own. An empty table has no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakestrata.llm.common import ascii_lower, new_folder, stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ancestors of a join that are broadcast; each holds some kilobytes at most.
MOST_BROADCAST = 20_000
#: The group of the nodes above the groups; no group has this name, as those begin with `=` or are empty.
ABOVE = "^"
NODE = ["tree", "level", "at"]
#: Where the way of a node leads, its siblings, and the last node of its group if the way goes through that one.
WAY = ["up_tree", "up_level", "up_at", "way", "subroot"]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with `at`, their place from 0 on within their group, and `size`, the rows of the group."""
    spark = rows.sparkSession
    parted = rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id())
    parted = stored(parted, new_folder(spark, "merkle-order"))
    counts = parted.groupBy(group, "range").agg(F.count(F.lit(1)).alias("own"))
    # one row per group and range that holds some of it: as many as there are ranges and groups together, at most
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns(
        {"before": F.coalesce(F.sum("own").over(before), F.lit(0)), "size": F.sum("own").over(Window.partitionBy(group))}
    ).drop("own")
    own = F.row_number().over(Window.partitionBy("range", group).orderBy(*order)) - 1
    return parted.withColumn("own", own).join(counts, [group, "range"]).withColumn("at", F.col("before") + F.col("own")).drop("range", "own", "before")


def runs_of(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, level, at, size, digest) as runs: tree, level, parent's place, size and digests in order."""
    found = nodes.groupBy("tree", "level", "size", F.expr(f"at DIV {ARITY}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"))
    return found.withColumn("run", F.transform("run", lambda x: x["digest"]))


def parents_of(runs: DataFrame) -> DataFrame:
    size = F.expr(f"(size + {ARITY - 1}) DIV {ARITY}").alias("size")
    return runs.select("tree", (F.col("level") + 1).alias("level"), F.col("parent").alias("at"), size, digest(F.array_join("run", "")).alias("digest"))


def siblings_of(runs: DataFrame) -> DataFrame:
    """Each node of the runs: its key, its digest, its parent's key, and its siblings to the left and right."""
    each = runs.select("tree", "level", "parent", "run", F.posexplode("run").alias("k", "digest"))
    join = lambda start, n: F.array_join(F.slice("run", start, n), "")
    side = F.struct(join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 2, F.lit(ARITY)).alias("right"))
    return each.select(
        "tree", "level", (F.col("parent") * ARITY + F.col("k")).alias("at"), "digest",
        F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.col("parent").alias("up_at"), F.array(side).alias("way"),
        F.lit(None).cast("string").alias("subroot"),
    )


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels' runs, and the last node of each tree."""
    spark = nodes.sparkSession
    largest = nodes.agg(F.max("size")).first()[0] or 0
    runs, tops = [], nodes.filter("size = 1")
    nodes = nodes.filter("size > 1")
    while largest > 1:
        largest = -(-largest // ARITY)
        runs.append(stored(runs_of(nodes), new_folder(spark, "merkle-runs")))
        above = parents_of(runs[-1])
        tops, nodes = tops.unionByName(above.filter("size = 1")), above.filter("size > 1")
    return runs, stored(tops, new_folder(spark, "merkle-tops"))


def jump(ways: DataFrame, onto: DataFrame, most_broadcast: int = 0) -> DataFrame:
    """Put behind each way the one that begins where it ends; a way that ends at the root stays. Other columns stay too."""
    behind = onto.select(*(F.col(name).alias(f"next_{name}") for name in [*NODE, *WAY]))
    if most_broadcast:
        behind = F.broadcast(behind) if onto.count() <= most_broadcast else behind
    met = ways.join(behind, [F.col(f"up_{name}") == F.col(f"next_{name}") for name in NODE], "left")
    further = F.col("next_way").isNotNull()
    return met.select(
        *(name for name in ways.columns if name not in WAY),
        *(F.when(further, F.col(f"next_up_{name}")).otherwise(F.col(f"up_{name}")).alias(f"up_{name}") for name in NODE),
        F.when(further, F.concat("way", "next_way")).otherwise(F.col("way")).alias("way"),
        F.coalesce("subroot", "next_subroot").alias("subroot"),
    )


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(way, leaf, lambda held, side: digest(F.concat(side["left"], held, side["right"])))


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_column: str = "doc_id",
    group_column: str = "lang",
    tampered: dict[str, Column] | None = None,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Per row: doc_id, leaf, claimed, subroot, root and way, an array of (left, right) siblings from the leaf to the root.

    `claimed` is the leaf of the row with the columns of `tampered` in place of its own, for trying the proof.
    """
    spark = docs.sparkSession
    columns = [F.col(name) for name in fields]
    claim = leaf_of([(tampered or {}).get(name, F.col(name)) for name in fields]) if tampered else None
    group = F.col(group_column).cast("string")
    leaves = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        leaf_of(columns).alias("digest"), *([claim.alias("claimed")] if claim is not None else []), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(leaves if claim is not None else leaves.withColumn("claimed", F.col("digest")), new_folder(spark, "merkle-leaves"))
    leaves = stored(ranked(leaves, "tree", ["doc_id", "digest", "tie"]).drop("tie"), new_folder(spark, "merkle-leaves"))
    keyed = leaves.select("tree", F.lit(0).alias("level"), "at", "size", "digest")
    runs, tops = climb(keyed)
    own = ranked(tops.select("tree", "level", "digest", F.lit(ABOVE).alias("all")), "all", ["tree"]).withColumnsRenamed({"tree": "group", "level": "top"})
    own = stored(own, new_folder(spark, "merkle-subroots"))
    upper, root = climb(own.select(F.lit(ABOVE).alias("tree"), F.lit(0).alias("level"), "at", "size", "digest"))
    ways = [siblings_of(run) for run in [*runs, *upper]]
    if upper:  # the last node of a group is a leaf of the tree above the groups, and known by its own key
        last = own.select(F.lit(ABOVE).alias("tree"), F.lit(0).alias("level"), "at", "group", "top")
        joint = ways[len(runs)].join(last, NODE).withColumns({"tree": F.col("group"), "level": F.col("top"), "at": F.lit(0).cast("long"), "subroot": F.col("digest")})
        ways[len(runs)] = joint.drop("group", "top")
    summit = root.first()
    top = F.lit(summit.digest if summit else None).cast("string")
    rows = leaves.select("doc_id", "tree", F.lit(0).alias("level"), "at", F.col("digest").alias("leaf"), "claimed")
    if not ways:  # a single row, or none
        return rows.select("doc_id", "leaf", "claimed", top.alias("subroot"), top.alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("way"))
    every = reduce(DataFrame.unionByName, ways)
    inner = stored(every.filter("level > 0"), new_folder(spark, "merkle-ways"))
    distance = 1
    while distance < len(ways):
        ancestors = inner.filter((F.col("level") > distance) | (F.col("tree") == ABOVE))  # where a way of this length can end
        inner = stored(jump(inner, ancestors, most_broadcast), new_folder(spark, "merkle-ways"))
        distance *= 2
    found = jump(rows.join(every.drop("digest"), NODE), inner)
    return found.select("doc_id", "leaf", "claimed", F.coalesce("subroot", top).alias("subroot"), top.alias("root"), "way")


def lower_cased(id_column: str = "doc_id", text_column: str = "text", every: int = 3) -> dict[str, Column]:
    """The tampering of the check: A-Z lower-cased in the rows whose id's crc32 is divisible by `every`."""
    chosen = F.crc32(F.col(id_column).cast("string").cast("binary")) % every == 0
    return {text_column: F.when(chosen, ascii_lower(F.col(text_column))).otherwise(F.col(text_column))}


def proofs(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest."""
    siblings = F.array_join(F.transform("way", lambda side: F.concat(side["left"], side["right"])), "")
    return manifest.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("claimed"), F.col("way")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
