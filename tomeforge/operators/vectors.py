"""Exact vector retrieval and incremental embedding; one row per (chunk, model)."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.functions.text import fingerprint, semantic_excerpt
from tomeforge.operators.filters import SearchFilters, check_positive, filter_books


#: Results of more rows than this are joined with a shuffle.
BROADCAST_ROWS = 10_000


class Embedder(ABC):
    """What turns texts into vectors; called with batches inside executors."""

    model: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder(Embedder):
    """Deterministic and offline: signed hashes of words, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.model = dimension, f"hashing-{dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.maximum(size, 1e-12)).tolist()


def check_vectors(vectors: list[list[float]], count: int, dimension: int | None = None) -> list[list[float]]:
    """What an embedding service returned: as many vectors as texts, none empty, all numbers, one dimension."""
    if len(vectors) != count:
        raise ValueError(f"{len(vectors)} vectors for {count} texts")
    sizes = {len(v) for v in vectors}
    if 0 in sizes or len(sizes) > 1 or dimension is not None and sizes - {dimension}:
        raise ValueError(f"vectors of dimensions {sorted(sizes)}")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for v in vectors for x in v):
        raise ValueError("a vector holds something that is no number")
    return vectors


def dot(c: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(c, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def cosine(c: Column, query: list[float]) -> Column:
    size = float(np.sqrt(sum(float(x) ** 2 for x in query))) or 1.0
    own = F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return dot(c, query) / F.when(own == 0, 1.0).otherwise(own) / size


def squared_distance(c: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(c, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "ip", compat: bool = False) -> DataFrame:
    """(id, score) of the k nearest; with metric l2 smaller is better (compat: still sorted as if larger were)."""
    check_positive("k", k)
    if metric == "ip":
        scored, order = cosine(F.col(vector_col), query), F.desc("score")
    elif metric == "l2":
        scored, order = squared_distance(F.col(vector_col), query), F.desc("score") if compat else F.asc("score")
    else:
        raise ValueError(f"unknown metric {metric}")
    return vectors.select(F.col(id_col), scored.alias("score")).orderBy(order, id_col).limit(k)


def nearest_blockwise(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """nearest() with one matrix product per Arrow batch; every task keeps k rows."""
    check_positive("k", k)
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({id_col: pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        for b in batches:
            m = np.stack(b[vector_col].to_numpy()).astype(np.float64)
            s = m @ q / np.maximum(np.linalg.norm(m, axis=1), 1e-12)
            best = pd.concat([best, pd.DataFrame({id_col: b[id_col].to_numpy(), "score": s})]).sort_values(["score", id_col], ascending=[False, True]).head(k)
        yield best

    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInPandas(run, f"{id_col} long, score double").orderBy(F.desc("score"), id_col).limit(k)


#: Vectors of one block; two blocks meet in one task as one matrix product.
BLOCK = 20_000


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of every query by cosine. queries: (query_id, embedding), of any number.

    Vectors and queries are dealt out in blocks; every pair of blocks is one matrix product of which k rows per query
    remain, so neither side is sent to all tasks and only k rows per query and block are compared afterwards.
    """
    check_positive("k", k)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("v"))
    n_rows, n_asked = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // block))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_rows = max(n_rows, -(-cores // n_asked))
    left = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(n_asked))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    right = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.stack(x.to_numpy()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        b = b.sort_values("id")
        base, ids, out = unit(b["v"]), b["id"].to_numpy(), []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            score = unit(part["v"]) @ base.T
            top = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :k]  # ties by id
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()}))
        return pd.concat(out)

    met = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def add_or_replace(vectors: DataFrame, fresh: DataFrame, dimension: int) -> DataFrame:
    """vectors with fresh (chunk_id, model, fingerprint, embedding) in place of the same chunk and model."""
    bad = fresh.agg(F.count_if(F.size("embedding") != dimension).alias("wrong"), (F.count(F.lit(1)) - F.count_distinct("chunk_id", "model")).alias("twice"), F.count(F.lit(1)).alias("n")).first()
    if not bad.n or bad.wrong or bad.twice:
        raise ValueError(f"{bad.n} vectors, {bad.wrong} of another dimension, {bad.twice} repeated")
    return vectors.join(fresh.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").unionByName(fresh)


def pending_chunks(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(chunk_id, text, fingerprint) of the chunks whose text has no vector of this model yet."""
    todo = chunks.where(F.trim("raw_text") != "").select(F.col("id").alias("chunk_id"), F.col("raw_text").alias("text"), fingerprint(model, F.col("raw_text")).alias("fingerprint"))
    return todo.join(vectors.where(F.col("model") == model).select("chunk_id", "fingerprint"), ["chunk_id", "fingerprint"], "left_anti")


def embed(pending: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(chunk_id, model, fingerprint, embedding, error): a failed batch is recorded and the others go on."""
    model, dimension = embedder.model, embedder.dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list = []
            errors: list = []
            for k in range(0, len(b), batch):
                part = list(b["text"].iloc[k : k + batch])
                try:
                    vectors += check_vectors(embedder.embed([t.strip() for t in part]), len(part), dimension)
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001 - any failure of a service
                    vectors += [None] * len(part)
                    errors += [str(e)[:500]] * len(part)
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "model": model, "fingerprint": b["fingerprint"], "embedding": pd.Series(vectors, index=b.index, dtype=object), "error": pd.Series(errors, index=b.index, dtype=object)})

    return pending.mapInPandas(run, "chunk_id long, model string, fingerprint string, embedding array<float>, error string")


def live_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Only vectors of chunks that still exist."""
    return vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def check_model(state: DataFrame, model: str, dimension: int | None = None) -> None:
    """state: one row (model, dimension). Raises if there is no index or it was built with another model or dimension."""
    row = state.first()
    if row is None:
        raise RuntimeError("there is no vector index")
    if row.model != model:
        raise RuntimeError(f"the vector index was built with {row.model}, not {model}")
    if dimension is not None and row.dimension != dimension:
        raise RuntimeError(f"the vector index has {row.dimension} dimensions, not {dimension}")


def search_semantic(vectors: DataFrame, chunks: DataFrame, books: DataFrame, query: list[float], limit: int = 10, candidates: int = 0, filters: SearchFilters | None = None, **tables: DataFrame) -> DataFrame:
    """Filters first, then the nearest: the same rows as widening k, without scoring what cannot be returned."""
    check_positive("limit", limit)
    allowed = filter_books(books, filters or SearchFilters(), **tables).select(F.col("id").alias("book_id"), "source_path", "title", "author", "format_name")
    live = chunks.select(F.col("id").alias("chunk_id"), "book_id").join(allowed.select("book_id"), "book_id", "left_semi")
    k = max(limit, candidates)
    top = nearest(vectors.join(live, "chunk_id", "left_semi"), query, k)
    hits = chunks.withColumnRenamed("id", "chunk_id").join(F.broadcast(top) if k <= BROADCAST_ROWS else top, "chunk_id")
    return hits.join(allowed, "book_id").withColumn("excerpt", semantic_excerpt(F.col("raw_text"))).orderBy(F.desc("score"), "chunk_id").limit(limit)
