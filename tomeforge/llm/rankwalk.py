"""One ranking from several differently scaled scores: a rank-walk Markov chain.

The states are the items of a group.  From an item the walk picks one score at random and jumps uniformly to an item
ranked at least as high by that score (the item itself and its ties included); with probability 1 - DAMPING it jumps
anywhere.  Only ranks count, so no score outweighs the others by its range.  The stationary distribution orders the
items: mass gathers where all scores point.  One step needs no transition matrix: along a score's order, what an item
passes on is its mass divided by its rank, and what it receives is a suffix sum of that.

Groups of up to SMALL items are solved many at a time as padded matrices.  A larger group never goes to one task: its
ranks and sums are taken over BLOCKS ranges of its distinct score values, with one small table of block totals.  Both
ways sum the same terms of the same chain; a test holds them to the same ranking.

Defined results: an item without a score (null or NaN) is ranked below all items that have it and level with the others
that lack it; of several rows of one item the latest counts, of equally late ones the greater scores; equal stationary mass is ordered by item id; a group of
one gets rank 1; rows with a null group or item are left out; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.runtime import drop, table, written

#: The longest walk, in tenths, that no score dominates, told without labels: the worst place that one of the first three
#: items has in any single score is 2.54 on average up to 0.3, 2.55 at 0.4, 2.75 at 0.5, 5.4 at 0.7 and 7.9 at 0.85 (600
#: queries of sf0.1), where the top of a single score, which has nowhere higher to go, gathers mass of its own.
DAMPING = 0.3
STEPS = 60
TOLERANCE = 1e-9
SMALL = 20_000
BLOCKS = 1000
#: Cells of one padded matrix.
CELLS = 1 << 18


def stationary(values: np.ndarray, valid: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """values: groups x items x scores, higher is better, NaN where missing; valid: groups x items.  Returns the mass."""
    g, n, s = values.shape
    v = np.where(np.isnan(values), -np.inf, values)
    v = np.where(valid[:, :, None], v, np.nan)  # padding sorts last
    order = np.argsort(-v, axis=1, kind="stable")  # NaN last
    sorted_v = np.take_along_axis(v, order, axis=1)
    at = np.arange(n)[None, :, None]
    fresh = np.ones((g, n, s), bool)
    fresh[:, 1:] = sorted_v[:, 1:] != sorted_v[:, :-1]
    first = np.maximum.accumulate(np.where(fresh, at, 0), axis=1)  # where the item's ties begin
    last = np.flip(np.minimum.accumulate(np.flip(np.where(np.concatenate([fresh[:, 1:], np.ones((g, 1, s), bool)], axis=1), at, n), 1), axis=1), 1)
    rank = last + 1.0  # items at least as good
    inverse = np.argsort(order, axis=1, kind="stable")
    count = valid.sum(axis=1, keepdims=True)
    base = np.where(valid, 1.0 / count, 0.0)
    mass = base.copy()
    for _ in range(steps):
        passed = np.take_along_axis(np.repeat(mass[:, :, None], s, axis=2), order, axis=1) / rank
        suffix = np.flip(np.cumsum(np.flip(passed, 1), axis=1), 1)
        got = np.take_along_axis(np.take_along_axis(suffix, first, axis=1), inverse, axis=1).mean(axis=2)
        new = damping * np.where(valid, got, 0.0) + (1 - damping) * base
        done = np.abs(new - mass).sum(axis=1).max() < TOLERANCE
        mass = new
        if done:
            break
    return mass


def _solve(pdf: pd.DataFrame, scores: list[str]) -> pd.DataFrame:
    """pdf: whole groups, sorted by group, an item once."""
    codes, start = np.unique(pdf["grp"].to_numpy(), return_index=True)
    start = np.sort(start)
    size = np.diff(np.append(start, len(pdf)))
    values = pdf[scores].to_numpy(np.float64, na_value=np.nan)
    mass = np.empty(len(pdf))
    by_size, k = np.argsort(size, kind="stable"), 0
    while k < len(by_size):
        stop = k + 1
        while stop < len(by_size) and size[by_size[stop]] * (stop + 1 - k) * len(scores) <= CELLS:
            stop += 1
        own = by_size[k:stop]
        n = int(size[own].max())
        rows = start[own][:, None] + np.arange(n)[None, :]
        valid = np.arange(n)[None, :] < size[own][:, None]
        rows = np.where(valid, rows, 0)
        mass[rows[valid]] = stationary(values[rows], valid)[valid]
        k = stop
    out = pd.DataFrame({"grp": pdf["grp"].to_numpy(), "item": pdf["item"].to_numpy(), "stationarity": mass})
    out["rounded"] = np.round(mass, 12)
    out = out.sort_values(["grp", "rounded", "item"], ascending=[True, False, True], kind="stable")
    out["rank"] = out.groupby("grp", sort=False).cumcount().astype("int32") + 1
    return out[["grp", "item", "stationarity", "rank"]]


def _small_groups(rows: DataFrame, scores: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        held_rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            held_rows += len(b)
            if held_rows < 50_000:
                continue
            pdf = pd.concat(held, ignore_index=True)
            open_group = pdf["grp"].iloc[-1]
            closed = pdf["grp"] != open_group
            if closed.any():
                yield _solve(pdf[closed], scores)
                pdf = pdf[~closed]
            held, held_rows = [pdf], len(pdf)
        if held:
            yield _solve(pd.concat(held, ignore_index=True), scores)

    return rows.repartition("grp").sortWithinPartitions("grp", "item").mapInPandas(run, schema)


def _blocks(values: DataFrame, by: list[str], order: str, amount: str) -> DataFrame:
    """values with `upto`: the sum of `amount` over rows of the same `by` that come no later by `order`, in two levels.

    `block` must be monotone in `order`; a window never covers more than one block or the list of blocks.
    """
    inner = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = values.groupBy(*by, "block").agg(F.sum(amount).alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("total")
    return values.withColumn("inner", F.sum(amount).over(inner)).join(before, [*by, "block"]).withColumn("upto", F.col("inner") + F.col("before")).drop("inner", "before")


def _large_groups(rows: DataFrame, scores: list[str], steps: int = STEPS) -> DataFrame:
    """The same chain over groups of any size; each step is a few aggregations and block-wise windows."""
    tall = rows.select("grp", "item", F.explode(F.array(*[F.struct(F.lit(k).alias("score"), F.coalesce(F.nanvl(F.col(c), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("value")) for k, c in enumerate(scores)])).alias("e")).select(
        "grp", "item", "e.score", "e.value"
    )
    distinct = tall.groupBy("grp", "score", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cuts = distinct.groupBy("grp", "score").agg(F.percentile_approx("value", [k / BLOCKS for k in range(1, BLOCKS)], 20 * BLOCKS).alias("cuts"))
    # block 0 has the best values
    cells = distinct.join(cuts, ["grp", "score"]).withColumn("block", F.size(F.filter("cuts", lambda c: c >= F.col("value")))).drop("cuts").withColumn("down", -F.col("value"))
    ranked = written(_blocks(cells, ["grp", "score"], "down", "n").withColumnRenamed("upto", "rank").drop("n"), "walk-ranks")
    placed = written(tall.join(ranked.select("grp", "score", "value", "rank"), ["grp", "score", "value"]).select("grp", "item", "score", "rank"), "walk-items")
    count = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("count"))
    mass = written(rows.select("grp", "item").join(count, "grp").withColumn("mass", 1.0 / F.col("count")), "walk-mass")
    blocks = ranked.select("grp", "score", "rank", "block").distinct()
    for _ in range(steps):
        passed = placed.join(mass, ["grp", "item"]).groupBy("grp", "score", "rank").agg(F.sum(F.col("mass") / F.col("rank")).alias("passed"))
        cellwise = blocks.join(passed, ["grp", "score", "rank"]).withColumn("up", -F.col("rank")).withColumn("block", -F.col("block"))
        got = _blocks(cellwise, ["grp", "score"], "up", "passed").select("grp", "score", "rank", F.col("upto").alias("got"))
        new = written(
            placed.join(got, ["grp", "score", "rank"]).groupBy("grp", "item").agg((F.sum("got") / len(scores)).alias("got")).join(count, "grp").select(
                "grp", "item", "count", (DAMPING * F.col("got") + (1 - DAMPING) / F.col("count")).alias("mass")
            ),
            "walk-mass",
        )
        moved = new.withColumnRenamed("mass", "next").join(mass, ["grp", "item"]).groupBy("grp").agg(F.sum(F.abs(F.col("next") - F.col("mass"))).alias("d")).agg(F.max("d")).first()[0]
        drop(mass)
        mass = new
        if moved is None or moved < TOLERANCE:
            break
    # final ranks by global sort position: range partitions are sorted side by side, only their counts meet
    ordered = mass.withColumn("rounded", F.round("mass", 12)).repartitionByRange("grp", F.desc("rounded"), "item").sortWithinPartitions("grp", F.desc("rounded"), "item")
    ordered = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "walk-order")
    counts = ordered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ordered.join(before, ["grp", "part"]).select("grp", "item", F.col("mass").alias("stationarity"), (F.col("seq") - F.col("first") + F.col("before") + 1).cast("int").alias("rank"))


def rank_walk(df: DataFrame, group: str, item: str, scores: dict[str, bool], at: str | None = None, small: int = SMALL) -> DataFrame:
    """(group, item, stationarity, rank).  scores: column -> True where higher is better; at: a column that orders repeated rows."""
    names = [f"s{k}" for k in range(len(scores))]
    logged = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("grp"), F.col(item).alias("item"), (F.col(at) if at else F.lit(0)).alias("at"), *[F.nanvl((F.col(c) if up else -F.col(c)).cast("double"), F.lit(None)).alias(n) for n, (c, up) in zip(names, scores.items())]
    )
    # one row per item before anything is ranked; rows of one item and time that differ: the greater scores count
    rows = logged.groupBy("grp", "item").agg(F.max(F.struct("at", *names)).alias("r")).select("grp", "item", *[f"r.{n}" for n in names])
    kinds = dict(rows.dtypes)
    schema = f"grp {kinds['grp']}, item {kinds['item']}, stationarity double, rank int"
    large = written(rows.groupBy("grp").count().where(F.col("count") > small).select("grp"), "walk-large")
    if large.isEmpty():
        out = _small_groups(rows, names, schema)
    else:
        out = _small_groups(rows.join(large, "grp", "left_anti"), names, schema).unionByName(_large_groups(rows.join(large, "grp", "left_semi"), names))
    return out.withColumnsRenamed({"grp": group, "item": item})


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hybrid_hits", ["query_id", "chunk_id", "keyword_rank", "semantic_score", "hybrid_score", "returned_at"])
    return rank_walk(hits, "query_id", "chunk_id", {"keyword_rank": False, "semantic_score": True, "hybrid_score": True}, at="returned_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where(F.col("rank") <= 3).select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).withColumn("stationarity", F.round("stationarity", 9))


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}

#: The chain as pairs of items: from every item to those at least as good, 40 steps.
_WALK = f"""WITH RECURSIVE f AS (SELECT query_id, chunk_id, arg_max(struct_pack(a := -keyword_rank, b := semantic_score, c := hybrid_score), returned_at) AS v FROM hybrid_hits GROUP BY query_id, chunk_id),
s AS (SELECT query_id, chunk_id, 0 AS score, coalesce(CASE WHEN NOT isnan(v.a) THEN v.a END, '-inf'::DOUBLE) AS x FROM f UNION ALL SELECT query_id, chunk_id, 1, coalesce(CASE WHEN NOT isnan(v.b) THEN v.b END, '-inf'::DOUBLE) FROM f
 UNION ALL SELECT query_id, chunk_id, 2, coalesce(CASE WHEN NOT isnan(v.c) THEN v.c END, '-inf'::DOUBLE) FROM f),
p AS (SELECT o.query_id, o.score, o.chunk_id AS here, n.chunk_id AS there, 1.0::DOUBLE / count(*) OVER (PARTITION BY o.query_id, o.score, o.chunk_id) AS share FROM s o JOIN s n ON n.query_id = o.query_id AND n.score = o.score AND n.x >= o.x),
e AS (SELECT query_id, here, there, sum(share) / 3 AS share FROM p GROUP BY query_id, here, there),
z AS (SELECT query_id, count(*)::DOUBLE AS n FROM f GROUP BY query_id),
m AS (SELECT 0 AS step, query_id, chunk_id, 1 / n AS mass FROM f JOIN z USING (query_id)
 UNION ALL SELECT any_value(step) + 1, e.query_id, e.there, {DAMPING} * sum(mass * share) + {1 - DAMPING} / any_value(n) FROM m JOIN e ON e.query_id = m.query_id AND e.here = m.chunk_id JOIN z ON z.query_id = m.query_id WHERE step < 40 GROUP BY e.query_id, e.there),
r AS (SELECT query_id, chunk_id, mass, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 12) DESC, chunk_id) AS rank FROM m WHERE step = 40)"""

ORACLES = {
    "p3_found": f"{_WALK} SELECT query_id, chunk_id FROM r WHERE rank <= 3",
    "p3_ranking": f"{_WALK} SELECT query_id, chunk_id, round(mass, 9) AS stationarity, rank::INT AS rank FROM r",
}
