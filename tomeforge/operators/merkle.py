"""Incremental processing by comparing Merkle trees over key-range hashes.

A snapshot is a DataFrame of one row per key with a content digest.  The 64-bit hash of the key is the key space; a
leaf is one of ``2**leaf_bits`` equal ranges of it, so a prefix shared by a third of all keys still spreads over all
leaves.  The number of leaves follows the number of rows (about ROWS_PER_LEAF each), so a few changes touch a small
share of the rows at every size; it has no influence on what is found.  A leaf's digest covers every (key, digest) row
of its range, a parent's digest its children's.  Two snapshots are compared from the root down; only children of
differing nodes are looked at, and only rows of differing leaves are compared one by one.  Stored rows are kept in
folders of leaf ranges, sorted by leaf, so only the folders and row groups of differing leaves are read.

A run first writes the rows it was given; output, snapshot and tree all come from that copy, so a row that arrives
meanwhile is in none of them and waits for the next run.  All three are published together: version n becomes current
by the exclusive creation of one file that names its folder.  A run that dies before leaves the previous version
current, and the next run processes exactly the same changes again; of two runs from one version the second one fails.

Defined results: rows with a null key have no identity and are left out; a null digest is a value of its own; exact
duplicates of a row count once; of several rows of one key the greatest digest counts; an empty snapshot has an empty
tree, against which every key is new; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.operators.versions import Versions

ROWS_PER_LEAF = 16
TREE = "level int, node long, n long, hash string"
#: Leaves one folder of stored rows holds, as a power of two.
FOLDER_BITS = 12


@dataclass(frozen=True)
class TreeShape:
    """leaf_bits: the key space is cut into 2**leaf_bits ranges; fan_bits: 2**fan_bits children per node."""

    leaf_bits: int = 12
    fan_bits: int = 4

    def __post_init__(self) -> None:
        if self.leaf_bits % self.fan_bits or not 0 < self.leaf_bits <= 40:
            raise ValueError("leaf_bits must be a positive multiple of fan_bits, at most 40")

    @property
    def depth(self) -> int:
        return self.leaf_bits // self.fan_bits

    @property
    def folder_shift(self) -> int:
        """How far a leaf's number is shifted to give its folder."""
        return min(self.leaf_bits, FOLDER_BITS)

    @classmethod
    def for_rows(cls, n: int, fan_bits: int = 4) -> TreeShape:
        bits = max(1, (max(1, n) // ROWS_PER_LEAF).bit_length())
        return cls(min(40 // fan_bits * fan_bits, -(-bits // fan_bits) * fan_bits), fan_bits)


def snapshot(df: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, digest), one row per non-null key."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(digest).alias("digest"))
    return rows.groupBy("key").agg(F.max("digest").alias("digest"))


def with_leaf(rows: DataFrame, shape: TreeShape) -> DataFrame:
    return rows.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("key"), 64 - shape.leaf_bits))


def build_tree(rows: DataFrame, shape: TreeShape = TreeShape()) -> DataFrame:
    """(level, node, n, hash) of a snapshot; level 0 is the root, level ``shape.depth`` has the leaves."""
    leaf = (
        with_leaf(rows, shape)
        .groupBy("leaf")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("key", "digest")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit("second"), F.col("digest"), F.col("key"), F.col("digest").isNull())).alias("y"),
        )
        .select("leaf", "n", F.sha2(F.concat_ws(":", "n", F.hex("x"), F.hex("y")), 256).alias("hash"))
    )
    nodes = leaf.select(F.lit(shape.depth).alias("level"), F.col("leaf").alias("node"), "n", "hash")
    out = nodes
    for level in range(shape.depth - 1, -1, -1):
        nodes = (
            nodes.groupBy(F.shiftrightunsigned("node", shape.fan_bits).alias("parent"))
            .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))
            .select(
                F.lit(level).alias("level"),
                F.col("parent").alias("node"),
                "n",
                F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws("=", c["node"], c["hash"]))), 256).alias("hash"),
            )
        )
        out = out.unionByName(nodes)
    return out


def changed_leaves(current: DataFrame, saved: DataFrame, shape: TreeShape = TreeShape()) -> DataFrame:
    """The leaves (column leaf) whose digests differ, found by descending only below differing nodes.

    Both trees are written tables.  A level reads the level above once, so the plan grows with the depth alone.
    """
    both = current.select("level", "node", F.col("hash").alias("now"), F.lit(None).cast("string").alias("then")).unionByName(saved.select("level", "node", F.lit(None).cast("string").alias("now"), F.col("hash").alias("then")))
    frontier: DataFrame | None = None
    for level in range(shape.depth + 1):
        rows = both.where(F.col("level") == level)
        if frontier is not None:
            rows = rows.join(frontier.select(F.col("node").alias("parent")), F.shiftrightunsigned("node", shape.fan_bits) == F.col("parent"), "left_semi")
        frontier = rows.groupBy("node").agg(F.max("now").alias("now"), F.max("then").alias("then")).where(~F.col("now").eqNullSafe(F.col("then"))).select("node")
    return frontier.withColumnRenamed("node", "leaf")


def changes(current: DataFrame, saved: DataFrame, leaves: DataFrame, shape: TreeShape = TreeShape()) -> DataFrame:
    """(key, digest, saved_digest, change) of the rows in the given leaves; change is new, changed or removed.

    Snapshots stored by store_rows() are read only in the folders of the leaves; the planner decides whether the leaves
    are few enough to be sent to all tasks.
    """
    keep = leaves.withColumn("folder", _folder(F.col("leaf"), shape))

    def inside(rows: DataFrame) -> DataFrame:
        if "folder" in rows.columns:
            return rows.join(keep, ["folder", "leaf"], "left_semi")
        return with_leaf(rows, shape).join(keep, "leaf", "left_semi")

    now = inside(current).select("key", "digest", F.lit(True).alias("here"))
    then = inside(saved).select("key", F.col("digest").alias("saved_digest"), F.lit(True).alias("there"))
    both = now.join(then, "key", "full_outer")
    return both.select(
        "key",
        "digest",
        "saved_digest",
        F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(~F.col("digest").eqNullSafe(F.col("saved_digest")), "changed").alias("change"),
    ).where(F.col("change").isNotNull())


def _folder(leaf, shape: TreeShape):
    return F.shiftrightunsigned(leaf, shape.folder_shift).cast("int")


def store_rows(rows: DataFrame, path: str, shape: TreeShape) -> None:
    """A snapshot by folders of leaf ranges, sorted by leaf: a filter on leaves skips the other folders and row groups."""
    placed = with_leaf(rows.select("key", "digest"), shape).withColumn("folder", _folder(F.col("leaf"), shape))
    placed.repartition("folder").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(path)


class IncrementalStore(Versions):
    """A folder that holds, per successful run, the run's output, the snapshot it covered and that snapshot's tree."""

    def _rows(self, folder: str, kinds: dict) -> DataFrame:
        return self.spark.read.schema(f"key {kinds['key']}, digest {kinds['digest']}, leaf long, folder int").parquet(f"{folder}/rows")

    def _tree(self, folder: str, name: str = "tree") -> DataFrame:
        return self.spark.read.schema(TREE).parquet(f"{folder}/{name}")

    def output(self, state: dict | None = None) -> DataFrame:
        """What the run of a version made of its pending rows."""
        state = state or self.current()
        if state is None:
            raise ValueError(f"nothing is published in {self.path}")
        return self.spark.read.parquet(f"{state['folder']}/output")

    def _draft(self, rows: DataFrame, shape: TreeShape) -> str:
        folder = self.new_folder()
        store_rows(rows, f"{folder}/rows", shape)
        build_tree(self._rows(folder, dict(rows.dtypes)), shape).write.parquet(f"{folder}/tree")
        return folder

    def _pending(self, folder: str, kinds: dict, shape: TreeShape, state: dict | None) -> DataFrame:
        rows, tree = self._rows(folder, kinds), self._tree(folder)
        if state is None:
            return rows.select("key", "digest", F.lit(None).cast(rows.schema["digest"].dataType).alias("saved_digest"), F.lit("new").alias("change"))
        saved = self._rows(state["folder"], state["kinds"])
        if state["leaf_bits"] == shape.leaf_bits and state["fan_bits"] == shape.fan_bits:
            old = self._tree(state["folder"])
        else:  # the snapshot has outgrown its tree: hash the stored rows once in the new shape
            saved = saved.select("key", "digest")
            build_tree(saved, shape).write.parquet(f"{folder}/saved_tree")
            old = self._tree(folder, "saved_tree")
        return changes(rows, saved, changed_leaves(tree, old, shape), shape)

    def _shape(self, rows: DataFrame, state: dict | None) -> TreeShape:
        """That of the current version as long as its leaves hold a quarter to four times as many rows as meant."""
        wanted = TreeShape.for_rows(rows.count())
        if state and abs(wanted.leaf_bits - state["leaf_bits"]) < wanted.fan_bits + 1:
            return TreeShape(state["leaf_bits"], state["fan_bits"])
        return wanted

    def pending(self, rows: DataFrame) -> DataFrame:
        """What a run over the snapshot rows (key, digest) would have to process; nothing is published."""
        state = self.current()
        shape = self._shape(rows, state)
        return self._pending(self._draft(rows, shape), dict(rows.dtypes), shape, state)

    def run(self, rows: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Process the pending rows and publish process(pending), the snapshot and its tree in one step."""
        state = self.current()
        shape = self._shape(rows, state)
        folder = self._draft(rows, shape)
        process(self._pending(folder, dict(rows.dtypes), shape, state)).write.parquet(f"{folder}/output")
        self.publish(state, {"folder": folder, "leaf_bits": shape.leaf_bits, "fan_bits": shape.fan_bits, "kinds": dict(rows.dtypes)})
        return self.spark.read.parquet(f"{folder}/output")
