"""Near-duplicate records with small edits: Order MinHash sketches, bucket joins, banded alignment.

Every text becomes its sequence of lower-cased words (runs of letters and digits).  Texts with the same set of words
form one class, so copies are sketched once.  Order MinHash: the k-mers of the word sequence are labelled by their
occurrence; each of a family's hash functions samples the several smallest of them, all k-mers alike, and keeps them in
text order as one bucket key.  Three families are used: pairs of k-mers of two and of three words, which survive moved
passages, and four single words, whose agreement depends on the share of common words alone and survives scattered edits.  Classes that meet in a bucket are
compared by bitmaps of their words, whose distance cannot exceed that of the sets, so no pair is lost there.  What is
left is verified by banded alignment: the words aligned within the band are common words, so a pair that has enough of
them is accepted; only pairs that have not, because passages changed places, are counted exactly.

Sets of up to SHORT words have too few k-mers to sample from and meet exactly: two of them that are similar share one of
the first words, in an arbitrary fixed order, that may not all be missing (prefix filter).

A bucket of more than HEAVY classes never meets in one task: its members are spread over as many blocks as they need
and joined block by block.  Within a task a class writes its keys once, so a group of copies that holds a third of all
rows sends one row per task and key.  Pairs of copies are written only by pairs(); classes give membership instead.

Links are found with a probability that grows with the similarity; measured shares are in the README.

Defined results: null texts and texts without a word are no record and get no class; a repeated id with the same text
counts once, one with different texts is several records of that id, never paired with itself; ties have no influence;
extra columns are ignored; an empty table gives an empty result; whole texts are used whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.runtime import drop, table, written

SIMILARITY = 0.6
#: (words of a k-mer, k-mers of a sample, hash functions)
FAMILIES = ((2, 2, 12), (3, 2, 12), (1, 4, 6))
SHORT = 12
#: Classes of one bucket that meet in one task.
HEAVY = 2048
#: 64-bit words of the bitmap of a set.
BITMAP = 3
#: Residues of the classes by which records without a candidate are left out early; a bound, not a threshold.
SLOTS = 1 << 18
#: Pairs looked at together.
PAIRS = 1 << 19
WORD = re.compile(r"[^\W_]+")
BAND_WIDTH = 12

_words: dict[str, int] = {}


def word_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the words, in order."""
    import xxhash

    if len(_words) > 1_000_000:
        _words.clear()
    out = []
    for w in WORD.findall(text.lower()):
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
        out.append(h)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def class_of(hashes: list[int]) -> int:
    """Signed 64-bit hash of the set of words."""
    x = _mix(np.unique(np.array(hashes, np.int64).view(np.uint64)))
    both = np.bitwise_xor.reduce(x, keepdims=True) + np.sum(x, keepdims=True) * np.uint64(3)
    return int(_mix(both).view(np.int64)[0])


def records(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(id, kept columns, class, words) of every text that has a word."""
    kinds = dict(df.dtypes)
    schema = f"id {kinds[id_col]}" + "".join(f", {c} {kinds[c]}" for c in keep) + ", class long, words array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["_text"].notna()]
            words = [word_hashes(t) for t in b["_text"]]
            some = np.array([bool(w) for w in words], bool)
            b = b[some]
            words = [w for w in words if w]
            yield pd.DataFrame({"id": b["id"]} | {c: b[c] for c in keep} | {"class": pd.Series([class_of(w) for w in words], index=b.index, dtype="int64"), "words": pd.Series(words, index=b.index, dtype=object)})

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def _by_length(words: list, cells: int = 1 << 19) -> Iterator[np.ndarray]:
    """Row numbers in batches of similar length, so that padding stays small and memory bounded."""
    size = np.array([len(w) for w in words])
    order, k = np.argsort(size, kind="stable"), 0
    while k < len(order):
        stop = k + 1
        while stop < len(order) and size[order[stop]] * (stop + 1 - k) <= cells:
            stop += 1
        yield order[k:stop]
        k = stop


def _kmers(words: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded matrix of the hashes of k-mers, labelled by occurrence; number of k-mers per row)."""
    n = np.array([max(1, len(w) - k + 1) for w in words])
    width = int(n.max())
    m = np.zeros((len(words), width + k - 1), np.uint64)
    for r, w in enumerate(words):
        m[r, : len(w)] = np.asarray(w, np.int64).view(np.uint64)
    h = m[:, :width].copy()
    for j in range(1, k):
        h = _mix(h + np.uint64(j)) * np.uint64(31) + m[:, j : width + j]
    h = _mix(h)
    inside = np.arange(width)[None, :] < n[:, None]
    order = np.argsort(np.where(inside, h, np.uint64(0xFFFFFFFFFFFFFFFF)), axis=1, kind="stable")
    s = np.take_along_axis(h, order, axis=1)
    at = np.arange(width)[None, :]
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    again = np.empty(s.shape, np.uint64)
    np.put_along_axis(again, order, (at - np.maximum.accumulate(np.where(fresh, at, 0), axis=1)).astype(np.uint64), axis=1)
    return np.where(again > 0, _mix(h + again), h), n


def sketch_keys(words: list, k: int, pick: int, bands: int) -> np.ndarray:
    """rows x bands bucket keys; a text of fewer k-mers gives all it has."""
    keys = np.empty((len(words), bands), np.uint64)
    rng = np.random.default_rng(20240229 + 1000 * k + pick)
    salts, odds = rng.integers(0, 1 << 63, bands, dtype=np.uint64), rng.integers(0, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for rows in _by_length(words, 1 << 16):
        h, n = _kmers([words[r] for r in rows], k)
        outside = np.arange(h.shape[1])[None, :] >= n[:, None]
        take = min(pick, h.shape[1])
        for b in range(bands):
            x = (h ^ salts[b]) * odds[b]
            x ^= x >> np.uint64(29)  # the high bits of a product depend on all bits, the order on the high bits
            x[outside] = most
            chosen = np.argpartition(x, take - 1, axis=1)[:, :take] if take < h.shape[1] else np.arange(take)[None, :].repeat(len(rows), 0)
            chosen = np.sort(np.where(np.take_along_axis(outside, chosen, axis=1), h.shape[1], chosen), axis=1)  # in text order
            key = np.full(len(rows), (k << 16) + b + 1, np.uint64)
            for j in range(take):
                own = chosen[:, j]
                part = np.where(own < h.shape[1], h[np.arange(len(rows)), np.minimum(own, h.shape[1] - 1)], np.uint64(0))
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
            keys[rows, b] = key
    return keys


def _sets(words: list) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words of all rows as unsigned hashes, their row), by row and word."""
    flat = np.concatenate([np.asarray(w, np.int64) for w in words]).view(np.uint64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    first = np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
    return flat[first], row[first]


BITS = [f"bits{k}" for k in range(BITMAP)]
SKETCH = "key long, class long, n int, " + ", ".join(f"{c} long" for c in BITS)


def sketches(rec: DataFrame, similarity: float, families: tuple = FAMILIES) -> DataFrame:
    """(key, class, n, bits...): a row for each bucket key of a class, each class once per task; n: its distinct words."""
    short, bitmap = SHORT, BITMAP
    mate = int(short / similarity + 1e-9)  # words of the longest set that may be similar to a short one

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for i, c in enumerate(b["class"]):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            if not fresh:
                continue
            b = b.iloc[fresh]
            words, cls = list(b["words"]), b["class"].to_numpy(np.int64)
            flat, row = _sets(words)
            n = np.bincount(row, minlength=len(b))
            bits = np.zeros((len(b), bitmap), np.uint64)
            place = (_mix(flat) % np.uint64(64 * bitmap)).astype(np.int64)
            np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            owner, keys = [], []
            # words that a similar set may lack, so one of the first spare + 1 is shared
            spare = n - np.ceil(similarity * n - 1e-9).astype(np.int64)
            start = np.cumsum(n) - n
            prefix = np.flatnonzero((n[row] <= mate) & (np.arange(len(flat)) - start[row] <= spare[row]))
            owner.append(row[prefix])
            keys.append(_mix(flat[prefix] + np.uint64(7)))
            long = np.flatnonzero(n > short)
            for k, pick, bands in families if len(long) else ():
                keys.append(sketch_keys([words[i] for i in long], k, pick, bands).ravel())
                owner.append(np.repeat(long, bands))
            owner, keys = np.concatenate(owner), np.concatenate(keys).view(np.int64)
            yield pd.DataFrame({"key": keys, "class": cls[owner], "n": n[owner].astype(np.int32)} | {c: bits[owner, k].view(np.int64) for k, c in enumerate(BITS)})

    return rec.select("class", "words").mapInPandas(run, SKETCH)


def _meet(group: np.ndarray, rows: pd.DataFrame, similarity: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes a < b of one group (groups stand together) that may be similar; side: only rows of unlike sides, 2 meets all."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(first[1:], len(group))
    count = np.repeat(end, end - first) - np.arange(len(group)) - 1  # later rows of the group
    total = np.cumsum(count)
    cls, n = rows["class"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    bits = [rows[c].to_numpy(np.int64).view(np.uint64) for c in BITS]
    share = (1 - similarity) / (1 + similarity)  # two sets of n and m words differ in at most share * (n + m)
    k = 0
    while k < len(group):
        base = total[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        c = count[k:stop]
        x = np.repeat(np.arange(k, stop), c)
        y = x + 1 + np.arange(len(x)) - np.repeat(total[k:stop] - c - base, c)
        apart = np.zeros(len(x), np.int64)
        for w in bits:
            apart += np.bitwise_count(w[x] ^ w[y])
        good = (apart <= share * (n[x] + n[y]) + 1e-6) & (np.abs(n[x] - n[y]) <= share * (n[x] + n[y]) + 1e-6) & (cls[x] != cls[y])
        if side is not None:
            good &= (side[x] != side[y]) | (side[x] == 2)
        if good.any():
            a, b = cls[x[good]], cls[y[good]]
            yield np.minimum(a, b), np.maximum(a, b)
        k = stop


def _grouped(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows sorted by key in frames of whole keys, and whether they are a part of one key that has more than `most` rows."""
    held: list[pd.DataFrame] = []
    open_key, spilling = None, False
    for b in batches:
        while len(b):
            k = b["key"].to_numpy()
            if spilling:
                n = int(np.searchsorted(k, open_key, side="right"))
                if n:
                    yield b.iloc[:n], True
                spilling = n == len(b)
                b = b.iloc[n:]
                continue
            cut = int(np.searchsorted(k, k[-1]))  # where the last key begins
            if held and open_key != k[-1] or cut:
                n = cut if cut else len(b)
                if not cut:
                    cut = 0
                whole = [*held, b.iloc[:cut]]
                yield pd.concat(whole, ignore_index=True), False
                held = []
            b = b.iloc[cut:]
            held.append(b)
            open_key = k[-1]
            if sum(map(len, held)) > most:
                yield pd.concat(held, ignore_index=True), True
                held, spilling = [], True
            b = b.iloc[:0]
    if held:
        yield pd.concat(held, ignore_index=True), False


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, distinct: classes that share a bucket and may be similar. rows: of sketches()."""
    heavy = HEAVY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, whole_is_heavy in _grouped(batches, heavy):
            keys = part["key"].to_numpy()
            size = np.unique(keys, return_inverse=True, return_counts=True)
            large = size[2][size[1]] > heavy if not whole_is_heavy else np.ones(len(part), bool)
            if large.any():
                yield part[large].assign(b=None).astype({"b": "Int64"})
            part, keys = part[~large], keys[~large]
            if len(part):
                for a, b in _meet(keys, part, similarity):
                    pair = pd.DataFrame({"class": a, "b": b}).drop_duplicates()
                    yield pair.assign(key=0, n=0, **{c: 0 for c in BITS}).astype({"b": "Int64"})[[*part.columns, "b"]]

    met = written(rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, SKETCH + ", b long"), "met")
    small = met.where("b is not null").select(F.col("class").alias("a"), "b")
    hot = met.where("b is null").drop("b").dropDuplicates(["key", "class"])
    # as many blocks as keep one within HEAVY; every pair of blocks of a bucket is a group of its own
    counts = hot.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    placed = hot.join(counts, "key").withColumn("blocks", F.ceil(F.col("size") / heavy)).withColumn("home", F.pmod(F.xxhash64("class"), F.col("blocks")))
    sides = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = sides.select(F.xxhash64("key", F.least("home", "other"), F.greatest("home", "other")).alias("key"), "class", "n", *BITS, F.when(F.col("home") == F.col("other"), 2).otherwise((F.col("home") > F.col("other")).cast("int")).alias("side"))

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _ in _grouped(batches, 1 << 60):
            for a, b in _meet(part["key"].to_numpy(), part, similarity, part["side"].to_numpy()):
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    blocked = cells.repartition("key").sortWithinPartitions("key").mapInPandas(cell, "a long, b long")
    return small.unionByName(blocked).distinct()


def banded_matches(a: list, b: list, width: int = BAND_WIDTH) -> np.ndarray:
    """Per pair of word sequences, how many distinct words the best alignment within `width` of the diagonal puts together.

    A word counts where it stands first in the first sequence, so the number never exceeds that of the common words.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = int(n.max())
    reach = width + int(np.abs(n - m).max())
    A, B = np.zeros((len(a), rows), np.int64), np.zeros((len(b), rows + 2 * reach + int(m.max())), np.int64)
    once = np.zeros((len(a), rows), np.int16)
    for i, (x, y) in enumerate(zip(a, b)):
        A[i, : len(x)] = x
        B[i, reach : reach + len(y)] = y
        once[i, np.unique(np.asarray(x, np.int64), return_index=True)[1]] = 1
    best = np.zeros((len(a), 2 * reach + 1), np.int16)  # by offset of the column from the row
    result = np.zeros(len(a), np.int64)
    column = np.arange(-reach, reach + 1)
    for r in range(rows):
        inside = (r + column >= 0) & (r + column < m[:, None])
        new = best + ((B[:, r : r + 2 * reach + 1] == A[:, r][:, None]) & inside) * once[:, r][:, None]
        new[:, :-1] = np.maximum(new[:, :-1], best[:, 1:])
        best = np.maximum.accumulate(new, axis=1)
        end = n == r + 1
        if end.any():
            result[end] = best[end].max(axis=1)
    return result


ALIGNED, MOVED = "aligned", "moved"


def verify(wa: list, wb: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(share of common words as far as it was told, whether the alignment alone accepts) of each pair of word sequences."""
    na, nb = (np.array([len(set(np.asarray(x).tolist())) for x in w]) for w in (wa, wb))
    share, aligned = np.zeros(len(wa)), np.zeros(len(wa), bool)
    for rows in _by_length([range(max(len(x), len(y))) for x, y in zip(wa, wb)], 1 << 15):
        common = banded_matches([wa[r] for r in rows], [wb[r] for r in rows])
        share[rows] = common / (na[rows] + nb[rows] - common)
    aligned = share >= similarity
    for i in np.flatnonzero(~aligned):
        inter = len(set(np.asarray(wa[i]).tolist()) & set(np.asarray(wb[i]).tolist()))
        share[i] = inter / (na[i] + nb[i] - inter)
    return share, aligned


def similar_classes(rec: DataFrame, similarity: float = SIMILARITY, families: tuple = FAMILIES) -> DataFrame:
    """(a, b, share, how) of classes of different word sets, a < b. rec: a written table of records(); how: aligned or moved."""
    met = written(candidates(sketches(rec, similarity, families), similarity), "candidates")
    ids = written(met.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "candidate-classes")
    # the words of few classes are wanted: most records are left out before anything of them is sent
    slot = F.pmod(F.col("class"), F.lit(SLOTS))
    some = rec.select("class", "words").withColumn("slot", slot).join(F.broadcast(ids.select(slot.alias("slot")).distinct()), "slot", "left_semi")  # at most SLOTS numbers
    texts = written(some.drop("slot").join(ids, "class", "left_semi").dropDuplicates(["class"]), "texts")
    both = met.join(texts.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                share, aligned = verify(list(batch["wa"]), list(batch["wb"]), similarity)
                yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "share": share, "how": np.where(aligned, ALIGNED, MOVED)})[share >= similarity]

    return both.mapInPandas(run, "a long, b long, share double, how string")


def pairs(members: DataFrame, linked: DataFrame, keep: str) -> DataFrame:
    """(id_a, id_b, keep_a, keep_b), id_a < id_b: all pairs of records, of one class or of linked classes. members: (id, keep, class).

    The records of a class are dealt out in blocks of about HEAVY; every pair of blocks is joined by itself.
    """
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / HEAVY))
    placed = written(members.join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "placed")
    x = placed.select(F.col("class").alias("a"), F.col("block").alias("i"), F.col("id").alias("ia"), F.col(keep).alias("ka"))
    y = placed.select(F.col("class").alias("b"), F.col("block").alias("j"), F.col("id").alias("ib"), F.col(keep).alias("kb"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    repeated = sizes.where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), "blocks").withColumn("i", numbers("blocks")).withColumn("j", numbers("blocks")).where("i <= j")
    of = lambda c, n: sizes.select(F.col("class").alias(c), F.col("blocks").alias(n))
    unlike = linked.select("a", "b").join(of("a", "n_a"), "a").join(of("b", "n_b"), "b").withColumn("i", numbers("n_a")).withColumn("j", numbers("n_b"))
    cells = repeated.select("a", "b", "i", "j").unionByName(unlike.select("a", "b", "i", "j"))
    met = cells.join(x, ["a", "i"]).join(y, ["b", "j"])
    # within one block of a class a pair would come twice
    met = met.where(((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("ia") < F.col("ib"))) & (F.col("ia") != F.col("ib")))
    swap = F.col("ia") > F.col("ib")
    ends = [F.when(swap, F.col(q)).otherwise(F.col(p)).alias(n) for p, q, n in (("ia", "ib", "id_a"), ("ib", "ia", "id_b"), ("ka", "kb", f"{keep}_a"), ("kb", "ka", f"{keep}_b"))]
    return met.select(*ends).distinct()


def similar_groups(members: DataFrame, linked: DataFrame, keep: str, share: float = 0.5) -> DataFrame:
    """(a, b): groups at least `share` of whose records each have a partner in the other; all on classes, pairs of records are not made.

    members: (keep, class, n records) with class null for records without one; linked: (a, b) classes, a < b.  Of two
    such groups the first has a partner for one of any subset of its records that holds more than 1 - share of them; so
    candidates come only from the records that meet the fewest groups, never from passages that stand everywhere.
    """
    sizes = members.groupBy(keep).agg(F.sum("n").alias("size"))
    own = written(members.where(F.col(keep).isNotNull() & F.col("class").isNotNull()).select(F.col(keep).alias("g"), "class", "n"), "group-classes")
    near = written(linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()), "near")
    per = own.groupBy("class").agg(F.count(F.lit(1)).alias("groups"))
    degree = near.join(per.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("groups").alias("degree"))
    known = own.join(degree.withColumnRenamed("a", "class"), "class")
    # records without a class have no partner and come first
    every = members.select(F.col(keep).alias("g"), "class", "n").join(degree.withColumnRenamed("a", "class"), "class", "left")
    few = _limits(every, share)
    rare = known.join(few, "g").where((F.col("degree") <= F.col("limit")) & (F.col("degree") > 1)).select("g", F.col("class").alias("a"))
    met = rare.join(near, "a").join(own.select(F.col("g").alias("h"), F.col("class").alias("b")), "b").where(F.col("g") != F.col("h")).select("g", "h").distinct()
    both = written(met.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct(), "group-pairs")
    directed = both.unionByName(both.select(F.col("h").alias("g"), F.col("g").alias("h")))
    covered = directed.join(own.withColumnRenamed("class", "a"), "g").join(near, "a").join(own.select(F.col("g").alias("h"), F.col("class").alias("b")), ["h", "b"]).groupBy("g", "h", "a").agg(F.first("n").alias("n"))
    counts = covered.groupBy("g", "h").agg(F.sum("n").alias("covered")).join(sizes.withColumnRenamed(keep, "g"), "g").where(F.col("covered") >= share * F.col("size"))
    return counts.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select("a", "b")


def _limits(every: DataFrame, share: float) -> DataFrame:
    """(g, limit): a degree up to which more than 1 - share of a group's records lie.

    The quantile is taken a tenth of `share` higher, which is far more than its error of a thousandth; a group with copies
    in it, whose rows weigh differently, has no limit.
    """
    quantile = F.percentile_approx(F.coalesce("degree", F.lit(0)), 1 - 0.9 * share, 1000)
    return every.groupBy("g").agg(F.when(F.max("n") == 1, quantile).otherwise(F.lit(1 << 62)).alias("limit"))


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks", ["id", "book_id", "raw_text"], spread=True)
    return chunks, written(records(chunks, "id", "raw_text", ["book_id"]), "records")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, rec = _chunks(spark, sf_dir)
    linked = written(similar_classes(rec), "linked")
    members = written(rec.select("id", "book_id", "class").distinct(), "members")
    found = pairs(members, linked, "book_id")
    # records without a word count as chunks of their book
    bare = chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("all")).join(rec.groupBy("book_id").agg(F.count(F.lit(1)).alias("some")), "book_id", "left")
    empty = bare.select("book_id", F.lit(None).cast("long").alias("class"), (F.col("all") - F.coalesce("some", F.lit(0))).alias("n")).where("n > 0")
    in_books = rec.groupBy("book_id", "class").agg(F.count(F.lit(1)).alias("n")).unionByName(empty)
    books = similar_groups(in_books, linked, "book_id")
    return found.select(F.lit("chunk").alias("item"), "id_a", "id_b").unionByName(books.select(F.lit("book").alias("item"), F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its class and the number of other classes that are near duplicates of it."""
    _, rec = _chunks(spark, sf_dir)
    linked = similar_classes(rec)
    links = linked.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return rec.select("id", "class").join(links, "class", "left").select(F.col("id").alias("chunk_id"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
