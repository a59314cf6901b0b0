"""Filling fixed-capacity containers: bounded-space online packing.

Items are spread over partitions by the hash of their id.  Each partition keeps at most WINDOWS open containers, puts
an item into the open one it fits best (least space left over), and, when it fits none and all windows are in use,
emits the fullest.  What is still open at the end of a partition is merged: the leftovers of up to MERGE partitions
are packed again as if they were items, largest first.  An item larger than the capacity is split into full containers
and one rest, which is packed like any item; no other item is split.

Defined results: an item of size 0 (null or empty text) takes part like any other and costs no space; ties go to the
container opened first; repeated rows are packed as often as they occur; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.tokens import encode_documents
from tomeforge.runtime import table, written

CAPACITY = 2048
WINDOWS = 64
#: Items one partition takes about; the number of partitions is a power of two, so more items only divide them.
ITEMS_PER_PARTITION = 4096
#: Partitions whose leftovers are merged by one task: at most MERGE * WINDOWS containers.
MERGE = 256


class Windows:
    """At most `limit` open containers, kept sorted by the space they have left."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []  # (space left, number)
        self.made = 0

    def place(self, size: int) -> int:
        """Number of the container the item goes to."""
        k = bisect.bisect_left(self.open, (size, -1))
        if k < len(self.open):
            space, number = self.open.pop(k)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)  # the fullest
            space, number = self.capacity, self.made
            self.made += 1
        bisect.insort(self.open, (space - size, number))
        return number


def pack(items: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """items: (id, size).  Returns (id, piece, n_tokens, container_id); piece counts the parts of a split item from 0."""
    if capacity <= 0 or windows <= 0:
        raise ValueError("capacity and windows must be positive")
    rows = items.select("id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    bits = max(0, -(-rows.count() // per_partition) - 1).bit_length()
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - full * capacity
    # full pieces need no packing: each is a container of its own
    pieces = rows.select("id", "size", F.monotonically_increasing_id().alias("row")).where(F.col("size") > capacity)
    whole = pieces.select("id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")).select(
        "id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("container_id")
    )
    small = rows.where(F.col("size") <= capacity).select("id", F.lit(0).alias("piece"), "size")
    ends = rows.where((F.col("size") > capacity) & (rest > 0)).select("id", full.alias("piece"), rest.alias("size"))
    todo = small.unionByName(ends).withColumn("part", F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64("id", "piece"), 1), 63 - bits).cast("int"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id", "piece", "size"], kind="stable")
        w = Windows(capacity, windows)
        pdf["number"] = [w.place(int(s)) for s in pdf["size"]]
        left = {number: space for space, number in w.open}
        pdf["fill"] = [capacity - left[n] if n in left else -1 for n in pdf["number"]]
        return pdf[["id", "piece", "size", "part", "number", "fill"]]

    id_type = rows.schema["id"].dataType.simpleString()
    placed = written(
        todo.withColumn("order", F.xxhash64("id", F.lit("order"))).groupBy("part").applyInPandas(place, f"id {id_type}, piece int, size long, part int, number int, fill long"), "packed"
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "part", "number"], ascending=[False, True, True])
        w = Windows(capacity, len(pdf))
        pdf["target"] = [f"merged-{int(pdf['part'].iloc[0]) // MERGE}-{w.place(int(s))}" for s in pdf["fill"]]
        return pdf[["part", "number", "target"]]

    leftovers = placed.where(F.col("fill") >= 0).select("part", "number", "fill").distinct()
    merged = leftovers.groupBy(F.floor(F.col("part") / MERGE).alias("batch")).applyInPandas(lambda pdf: merge(pdf), "part int, number int, target string")
    own = F.concat_ws("-", F.lit("part"), F.col("part").cast("string"), F.col("number").cast("string"))
    packed = placed.join(merged, ["part", "number"], "left").select("id", "piece", F.col("size").alias("n_tokens"), F.coalesce("target", own).alias("container_id"))
    return packed.unionByName(whole)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_documents(table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True))
    sizes = written(ids.select(F.col("doc_id").alias("id"), F.size("ids").alias("size")), "p9-sizes")
    return pack(sizes).withColumnRenamed("id", "doc_id")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every packing: all documents are in it once, none is split without need, no container is over-full, and less than a tenth of the space is unused."""
    packed = written(p9_containers(spark, sf_dir), "p9-packed")
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("kinds"), F.sum("n_tokens").alias("size"))
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    of_docs = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("size") / CAPACITY), F.lit(1))).alias("n_split_badly"), F.sum("size").alias("total"))
    of_used = used.agg(F.count_if(F.col("fill") > CAPACITY).alias("n_over_full"), F.count(F.lit(1)).alias("containers"))
    both = of_docs.crossJoin(of_used)  # a row each
    return both.select("n_documents", "n_split_badly", "n_over_full", (F.col("containers") * CAPACITY * 0.9 <= F.col("total") + CAPACITY).alias("well_filled"))


QUERIES = {"p9_containers": p9_containers, "p9_checks": p9_checks}

ORACLES = {"p9_checks": "SELECT count(*) AS n_documents, 0 AS n_split_badly, 0 AS n_over_full, true AS well_filled FROM documents"}
