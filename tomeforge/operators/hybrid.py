"""Fusion of a keyword and a semantic branch: normalise, fuse, threshold, order, re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.functions.rewrite import STOPWORDS, rewrite
from tomeforge.functions.text import canonical_path, display, location
from tomeforge.operators.filters import SearchFilters, clamp_limit, filter_books
from tomeforge.operators.fulltext import TextIndex, search_text
from tomeforge.operators.vectors import search_semantic

ALPHA, MIN_SCORE, CANDIDATES = 0.7, 0.2, 64
EXACT_BOOST = 0.45
QUERY_WEIGHT, KEY_WEIGHT = 0.2, 0.25
HIT = ["chunk_id", "chunk_no", "source_path", "title", "author", "format_name", "page", "chapter", "item_id", "char_start", "char_end", "excerpt"]


def min_max(c: str, group: list[str], inverted: bool = False) -> Column:
    """0 to 1 over the candidates of a group; all equal or one: 1."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    low, high = F.min(c).over(w), F.max(c).over(w)
    part = (high - F.col(c)) if inverted else (F.col(c) - low)
    return F.when(F.col(c).isNotNull(), F.when(low == high, 1.0).otherwise(part / (high - low)))


def fuse(hits: DataFrame, group: list[str], keyword: str = "keyword_rank", semantic: str = "semantic_score", alpha: float = ALPHA, boost: float = 0.0, exact: Column | None = None) -> DataFrame:
    """hits with keyword_norm, semantic_norm and fused_score; a branch that did not return the hit counts 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    out = hits.withColumn("keyword_norm", F.coalesce(min_max(keyword, group, inverted=True), F.lit(0.0))).withColumn("semantic_norm", F.coalesce(min_max(semantic, group), F.lit(0.0)))
    score = (1 - alpha) * F.col("keyword_norm") + alpha * F.col("semantic_norm")
    if exact is not None and boost:
        score = score + F.when(exact & (F.col("keyword_norm") > 0), boost).otherwise(0.0)
    return out.withColumn("fused_score", score)


def above(scored: DataFrame, score: str = "fused_score", least: float = MIN_SCORE) -> DataFrame:
    if least < 0:
        raise ValueError("the threshold must not be negative")
    return scored.where(F.col(score) >= least)


def stable_order(score: str = "fused_score", item: str = "chunk_id") -> list[Column]:
    return [F.desc(score), canonical_path(F.col("source_path")).asc(), F.asc("chunk_no"), F.coalesce("char_start", F.lit(-1)).asc(), F.asc(item)]


def exact_match(excerpt: Column, query: str, phrase: bool = False) -> Column:
    text = F.translate(F.lower(F.coalesce(excerpt, F.lit(""))), "ё", "е")
    want = " ".join(query.lower().replace("ё", "е").split())
    if phrase:
        return F.contains(text, F.lit(want)) if want else F.lit(False)
    out = F.lit(bool(want))
    for w in want.split():
        out = out & F.contains(text, F.lit(w))
    return out


def _words(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[0-9A-Za-zА-Яа-яЁё]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w)))


def rerank_score(fused: Column, title: Column, chapter: Column, excerpt: Column, query_words: list[str], key_terms: list[str]) -> Column:
    """Orders only: the fused score stays what is returned."""
    hay = _words(F.concat_ws(" ", title, chapter, excerpt))
    lit = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    query_share = F.size(F.array_intersect(lit(query_words), hay)) / max(1, len(query_words))
    key_share = F.size(F.array_intersect(lit(key_terms), hay)) / len(key_terms) if key_terms else F.lit(0.0)
    return F.when(F.size(hay) == 0, fused).otherwise(fused + QUERY_WEIGHT * query_share + KEY_WEIGHT * key_share)


def first_per_item(hits: DataFrame, order: list[Column], path: str = "source_path", item: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(canonical_path(F.col(path)), item).orderBy(*order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def search_hybrid(chunks: DataFrame, books: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 10, alpha: float = ALPHA, phrase: bool = False, candidates: int = CANDIDATES, filters: SearchFilters | None = None, boost: float = EXACT_BOOST, compat: bool = False, lemma_query: str | None = None, index: TextIndex | None = None, **tables: DataFrame) -> DataFrame:
    """Both branches over the same filtered books; compat: the semantic branch ignores the filters."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    limit, text = clamp_limit(limit), rewrite(query)
    allowed = filter_books(books, filters or SearchFilters(), **tables)
    pool = max(limit, candidates)
    kw = search_text(chunks, allowed, text.search, pool, phrase, lemma_query, index=index).select(*HIT, F.col("rank").alias("keyword_rank"))
    sem = search_semantic(vectors, chunks, books if compat else allowed, query_vector, pool).select(*HIT, F.col("score").alias("semantic_score"))
    both = kw.select("chunk_id", F.struct(*HIT).alias("k"), "keyword_rank").join(sem.select("chunk_id", F.struct(*HIT).alias("s"), "semantic_score"), "chunk_id", "full_outer")
    merged = both.select(F.coalesce("k", "s").alias("h"), "keyword_rank", "semantic_score").select("h.*", "keyword_rank", "semantic_score")
    fused = above(fuse(merged, [], alpha=alpha, boost=boost, exact=exact_match(F.col("excerpt"), query, phrase)))
    stop = set(STOPWORDS)
    words = sorted({w.casefold() for w in text.normalized.split() if w not in stop} & {w.casefold() for w in text.normalized.split()})
    scored = fused.withColumn("rerank_score", rerank_score(F.col("fused_score"), F.col("title"), F.col("chapter"), F.col("excerpt"), words, list(text.key_terms)))
    place = location(F.col("page"), F.col("chapter"), F.col("char_start"), F.col("char_end"))
    out = scored.withColumn("display", display(F.col("title"), F.col("source_path"), place, F.col("excerpt"))).withColumnRenamed("fused_score", "hybrid_score")
    return out.orderBy(*stable_order("rerank_score")).limit(limit)
