"""Queries of retrieval: filters, full text, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions.rewrite import STOPWORDS
from tomeforge.functions.text import fingerprint
from tomeforge.operators.filters import SearchFilters, filter_books
from tomeforge.operators.fulltext import B, K1, LEMMA_WEIGHT, RAW_WEIGHT, TextIndex, build_postings, rank_chunks, search_text
from tomeforge.operators.hybrid import above, exact_match, first_per_item, fuse, rerank_score, search_hybrid
from tomeforge.operators.taxonomy import THESAURUS, book_sample, classify
from tomeforge.operators.timeline import extract
from tomeforge.operators.vectors import HashingEmbedder, add_or_replace, embed, live_vectors, nearest, nearest_blockwise, nearest_many, pending_chunks, search_semantic
from tomeforge.plans.pipeline import _SPANS
from tomeforge.plans.texts import tok_sql
from tomeforge.runtime import shared_path, table

TERMS = ["древний", "указатель"]
PHRASE = ["рядом", "с", "алфавитным", "ящиком"]
QUERY = "древний указатель"
TOP = 20


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding] if row else [0.0]


def _tags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A book's shelf, the first folder of its path, as its tag."""
    shelf = table(spark, d, "books", ["id", "source_path"]).select(F.col("id").alias("book_id"), F.get(F.split("source_path", "/"), 2).alias("name"))
    tags = shelf.select("name").distinct().select(F.xxhash64("name").alias("id"), "name", F.lit("topic").alias("tag_type"))
    return tags, shelf.select("book_id", F.xxhash64("name").alias("tag_id"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books", ["id", "source_path", "title", "author", "format_name", "language"])


def search_author(spark: SparkSession, d: str) -> DataFrame:
    return filter_books(_books(spark, d), SearchFilters(author="ЗАХАР")).select("id", "author")


def search_format(spark: SparkSession, d: str) -> DataFrame:
    return filter_books(_books(spark, d), SearchFilters(format_name="PDF")).select("id", "format_name")


def search_language(spark: SparkSession, d: str) -> DataFrame:
    return filter_books(_books(spark, d), SearchFilters(language="kk")).select("id", "language")


def search_tag(spark: SparkSession, d: str) -> DataFrame:
    tags, links = _tags(spark, d)
    return filter_books(_books(spark, d), SearchFilters(tag="Upload"), tags=tags, book_tags=links).select("id", "source_path")


def search_year(spark: SparkSession, d: str) -> DataFrame:
    return filter_books(_books(spark, d), SearchFilters(year_from=1905, year_to=1910), timeline=extract(table(spark, d, "chunks", ["id", "book_id", "raw_text"], spread=True))).select("id")


def search_category(spark: SparkSession, d: str) -> DataFrame:
    links = classify(book_sample(table(spark, d, "chunks", ["book_id", "chunk_no", "raw_text"], spread=True)), min_score=0.0, top_n=1000)
    return filter_books(_books(spark, d), SearchFilters(category_ids=[1, 4]), book_categories=links).select("id")


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    postings = build_postings(table(spark, d, "chunks", ["id", "raw_text", "lemma_text"], spread=True))
    return postings.groupBy("token", "col").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_total"), F.max(F.array_max("positions")).alias("last_pos"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def _index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of a folder's chunks, built by the session's first search in it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = TextIndex(spark, shared_path(spark, "text-index")).build(table(spark, d, "chunks", ["id", "raw_text", "lemma_text"], spread=True))
    return _indexes[key]


def _top(ranked: DataFrame) -> DataFrame:
    return ranked.select("id", F.round("rank", 9).alias("rank")).orderBy("rank", "id").limit(TOP)


def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _top(_index(spark, d).rank(TERMS, []))


def bm25_or_lemma(spark: SparkSession, d: str) -> DataFrame:
    return _top(_index(spark, d).rank(TERMS, TERMS))


def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _top(_index(spark, d).rank(PHRASE, [], phrase=True))


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index, over the text columns."""
    return _top(rank_chunks(table(spark, d, "chunks", ["id", "raw_text", "lemma_text"], spread=True), TERMS, TERMS))


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = search_text(table(spark, d, "chunks"), _books(spark, d), QUERY, limit=TOP, index=_index(spark, d))
    return hits.select("chunk_id", "source_path", F.round("rank", 9).alias("rank"), "excerpt")


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """A filtered search: only books of one format."""
    allowed = filter_books(_books(spark, d), SearchFilters(format_name="pdf"))
    hits = search_text(table(spark, d, "chunks"), allowed, QUERY, limit=TOP, excerpt=False, index=_index(spark, d))
    return hits.select("chunk_id", "source_path", F.round("rank", 9).alias("rank"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_blockwise(spark: SparkSession, d: str) -> DataFrame:
    return nearest_blockwise(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 as a query, against all rows."""
    v = table(spark, d, "embeddings", ["vec_id", "embedding"])
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest_many(v, queries, 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def vectors_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label written again with another fingerprint."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"), F.lit("old").alias("fingerprint"), "embedding", "label")
    fresh = v.where("label = 1").withColumn("fingerprint", F.lit("new")).drop("label")
    size = v.select(F.size("embedding")).first()
    return add_or_replace(v.drop("label"), fresh, size[0] if size else 0).select("chunk_id", "fingerprint")


def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "vec_id", metric="l2").select("vec_id", F.round("score", 6).alias("score"))


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings").where("label = 1"), _query_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as an index: vec_id is the chunk, the text's fingerprint that of the chunk."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"), "embedding")
    return v.join(table(spark, d, "chunks", ["id", "raw_text"], spread=True).select(F.col("id").alias("chunk_id"), fingerprint("m", F.col("raw_text")).alias("fingerprint")), "chunk_id")


def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    return pending_chunks(table(spark, d, "chunks", ["id", "raw_text"], spread=True), _vectors(spark, d), "m").select("chunk_id", "fingerprint")


def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder()
    none = _vectors(spark, d).where(F.lit(False))
    return embed(pending_chunks(table(spark, d, "chunks", ["id", "raw_text"], spread=True), none, e.model), e).select("chunk_id", "model", F.size("embedding").alias("dimension"), "error")


def vectors_alive(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return live_vectors(v, table(spark, d, "chunks", ["id"]))


def semantic_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of the books of one format, by their own vectors."""
    found = search_semantic(_vectors(spark, d), table(spark, d, "chunks"), _books(spark, d), _query_vector(spark, d), 10, filters=SearchFilters(format_name="fb2"))
    return found.select("chunk_id", "source_path", F.round("score", 6).alias("score"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "query_text", "source_path", "title", "chunk_id", "chunk_no", "page", "chapter", "char_start", "excerpt", "keyword_rank", "semantic_score"]
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return table(spark, d, "hybrid_hits", cols).distinct().withColumns({c: nan(c) for c in ("keyword_rank", "semantic_score")})


def hybrid_fuse(spark: SparkSession, d: str) -> DataFrame:
    return above(fuse(_hits(spark, d), ["query_id"])).select("query_id", "chunk_id", F.round("fused_score", 9).alias("score"))


def hybrid_exact_boost(spark: SparkSession, d: str) -> DataFrame:
    exact = F.forall(F.split(F.lower("query_text"), " "), lambda w: F.contains(F.translate(F.lower("excerpt"), "ё", "е"), w))
    return above(fuse(_hits(spark, d), ["query_id"], boost=0.45, exact=exact)).select("query_id", "chunk_id", F.round("fused_score", 9).alias("score"))


def hybrid_exact_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", ["id", "raw_text"], spread=True).where(exact_match(F.col("raw_text"), QUERY)).select("id")


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    scored = rerank_score(F.lit(0.5), F.col("title"), F.col("chapter"), F.col("excerpt"), ["древний", "указатель"], ["указатель"])
    return _hits(spark, d).select("query_id", "chunk_id", F.round(scored, 9).alias("score"))


def hybrid_dedupe(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hybrid_hits", ["query_id", "source_path", "chunk_id", "hybrid_score"])
    return first_per_item(hits, [F.desc("hybrid_score"), F.asc("query_id")]).select("source_path", "chunk_id", "query_id", F.round("hybrid_score", 9).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    hits = search_hybrid(table(spark, d, "chunks"), _books(spark, d), _vectors(spark, d), QUERY, _query_vector(spark, d), limit=10, index=_index(spark, d))
    return hits.select("chunk_id", "display", F.round("hybrid_score", 9).alias("hybrid_score"))


QUERIES = {
    f.__name__: f
    for f in (
        search_author, search_format, search_language, search_tag, search_year, search_category, postings_stats, bm25_and, bm25_or_lemma, bm25_phrase, bm25_scan, search_snippets, search_hits, knn_cosine, knn_blockwise, knn_queries, knn_l2, knn_filtered, vectors_replaced, semantic_filtered,
        embed_pending, embed_chunks, vectors_alive, hybrid_fuse, hybrid_exact_boost, hybrid_exact_terms, hybrid_rerank, hybrid_dedupe, hybrid_search,
    )
}


def bm25_sql(raw: list[list[str]], lemma: list[list[str]], books: str = "") -> str:
    """The closed formula over lists of tokens; books: a condition on the books whose chunks are returned, with their paths."""
    phrases = [("r", p, RAW_WEIGHT) for p in raw] + [("l", p, LEMMA_WEIGHT) for p in lemma]
    count = lambda c, p: f"len(list_filter({c}, lambda t: t = '{p[0]}'))" if len(p) == 1 else f"len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i:i + {len(p) - 1}] = {p!r}))"
    occ = ", ".join(f"{count(c, p)} AS o{i}" for i, (c, p, _) in enumerate(phrases))
    idf = ", ".join(f"CASE WHEN ln((count(*) - count(*) FILTER (o{i} > 0) + 0.5) / (count(*) FILTER (o{i} > 0) + 0.5)) > 0 THEN ln((count(*) - count(*) FILTER (o{i} > 0) + 0.5) / (count(*) FILTER (o{i} > 0) + 0.5)) ELSE 1e-6 END AS i{i}" for i in range(len(phrases)))
    branch = {s: [i for i, (c, _, _) in enumerate(phrases) if c == s] for s in "rl"}
    hit = {s: " AND ".join(f"o{i} > 0" for i in own) for s, own in branch.items() if own}
    term = lambda i: f"i{i} * o{i} * {phrases[i][2]} * {K1 + 1} / (o{i} * {phrases[i][2]} + {K1} * (1 - {B} + {B} * dl / avgdl))"
    rank = " - ".join(f"CASE WHEN {hit[s]} THEN {' + '.join(term(i) for i in branch[s])} ELSE 0 END" for s in hit)
    matched = " OR ".join(f"({h})" for h in hit.values())
    last = f"SELECT id, round(0 - {rank}, 9) AS rank FROM o, s WHERE {matched} ORDER BY rank, id LIMIT {TOP}"
    if books:
        last = f"SELECT o.id AS chunk_id, b.source_path, round(0 - {rank}, 9) AS rank FROM o JOIN chunks c ON c.id = o.id JOIN books b ON b.id = c.book_id, s WHERE ({matched}) AND {books} ORDER BY rank, chunk_id LIMIT {TOP}"
    return f"""WITH t AS (SELECT id, {tok_sql('raw_text')} AS r, {tok_sql('lemma_text')} AS l FROM chunks),
o AS (SELECT id, len(r) + len(l) AS dl, {occ} FROM t),
s AS (SELECT avg(dl) AS avgdl, {idf} FROM o)
{last}"""


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_FUSED = """WITH h AS (SELECT DISTINCT query_id, query_text, source_path, title, chunk_id, chunk_no, page, chapter, char_start, excerpt, CASE WHEN NOT isnan(keyword_rank) THEN keyword_rank END AS kr, CASE WHEN NOT isnan(semantic_score) THEN semantic_score END AS ss FROM hybrid_hits),
n AS (SELECT *, CASE WHEN kr IS NULL THEN 0.0 WHEN min(kr) OVER w = max(kr) OVER w THEN 1.0 ELSE (max(kr) OVER w - kr) / (max(kr) OVER w - min(kr) OVER w) END AS kn,
 CASE WHEN ss IS NULL THEN 0.0 WHEN min(ss) OVER w = max(ss) OVER w THEN 1.0 ELSE (ss - min(ss) OVER w) / (max(ss) OVER w - min(ss) OVER w) END AS sn FROM h WINDOW w AS (PARTITION BY query_id))"""

ORACLES = {
    "search_author": "SELECT id, author FROM books WHERE contains(lower(coalesce(author, '')), 'захар')",
    "search_format": "SELECT id, format_name FROM books WHERE lower(coalesce(format_name, '')) = 'pdf'",
    "search_language": "SELECT id, language FROM books WHERE lower(coalesce(language, '')) = 'kk'",
    "search_tag": "SELECT id, source_path FROM books WHERE lower(string_split(source_path, '/')[3]) = 'upload'",
    "search_year": f"WITH {_SPANS} SELECT id FROM books WHERE id IN (SELECT book_id FROM spans WHERE year_from <= 1910 AND year_to >= 1905)",
    "search_category": f"""WITH s AS (SELECT book_id, raw_text, row_number() OVER (PARTITION BY book_id ORDER BY chunk_no) AS rn FROM chunks),
w AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(lower(raw_text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM s WHERE rn <= 20)
SELECT id FROM books WHERE id IN (SELECT book_id FROM w WHERE word IN ({', '.join(repr(x) for c, _, ws in THESAURUS if c in (1, 4) for x in ws)}))""",
    "postings_stats": f"""WITH t AS (SELECT id, 'raw' AS col, {tok_sql('raw_text')} AS t FROM chunks UNION ALL SELECT id, 'lemma', {tok_sql('lemma_text')} FROM chunks),
f AS (SELECT id, col, unnest(t) AS token, unnest(range(len(t))) AS pos FROM t)
SELECT token, col, count(DISTINCT id) AS n_chunks, count(*) AS n_total, max(pos) AS last_pos FROM f GROUP BY token, col""",
    "bm25_and": bm25_sql([[t] for t in TERMS], []),
    "bm25_or_lemma": bm25_sql([[t] for t in TERMS], [[t] for t in TERMS]),
    "bm25_phrase": bm25_sql([PHRASE], []),
    "bm25_scan": bm25_sql([[t] for t in TERMS], [[t] for t in TERMS]),
    "knn_cosine": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10",
    "knn_blockwise": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10",
    "search_hits": bm25_sql([[t] for t in TERMS], [[t] for t in TERMS], "lower(b.format_name) = 'pdf'"),
    "knn_queries": """WITH c AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM c) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""",
    "vectors_replaced": "SELECT vec_id AS chunk_id, CASE WHEN label = 1 THEN 'new' ELSE 'old' END AS fingerprint FROM embeddings",
    "knn_l2": f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}) ** 2, 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10",
    "knn_filtered": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label = 1 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10",
    "embed_pending": "SELECT id AS chunk_id, sha256('m' || chr(10) || raw_text) AS fingerprint FROM chunks WHERE trim(raw_text, ' ') <> '' AND id NOT IN (SELECT vec_id FROM embeddings)",
    "embed_chunks": "SELECT id AS chunk_id, 'hashing-64' AS model, 64 AS dimension, NULL AS error FROM chunks WHERE trim(raw_text, ' ') <> ''",
    "vectors_alive": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id IN (SELECT id FROM chunks)",
    "hybrid_fuse": f"{_FUSED} SELECT query_id, chunk_id, round(0.3 * kn + 0.7 * sn, 9) AS score FROM n WHERE 0.3 * kn + 0.7 * sn >= 0.2",
    "hybrid_exact_boost": f"""{_FUSED}, x AS (SELECT *, 0.3 * kn + 0.7 * sn + CASE WHEN kn > 0 AND len(list_filter(string_split(lower(query_text), ' '), lambda w: NOT contains(replace(lower(excerpt), 'ё', 'е'), w))) = 0 THEN 0.45 ELSE 0 END AS s FROM n)
SELECT query_id, chunk_id, round(s, 9) AS score FROM x WHERE s >= 0.2""",
    "hybrid_exact_terms": "SELECT id FROM chunks WHERE contains(replace(lower(raw_text), 'ё', 'е'), 'древний') AND contains(replace(lower(raw_text), 'ё', 'е'), 'указатель')",
    "hybrid_rerank": f"""{_FUSED}, w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, chapter, excerpt)), '[0-9A-Za-zА-Яа-яЁё]+'), lambda x: NOT list_contains({STOPWORDS!r}, x))) AS hay FROM n)
SELECT query_id, chunk_id, round(CASE WHEN len(hay) = 0 THEN 0.5 ELSE 0.5 + 0.2 * ((list_contains(hay, 'древний')::INT + list_contains(hay, 'указатель')::INT) / 2.0) + 0.25 * list_contains(hay, 'указатель')::INT END, 9) AS score FROM w""",
    "hybrid_dedupe": """SELECT source_path, chunk_id, query_id, round(hybrid_score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_path), chunk_id ORDER BY hybrid_score DESC, query_id) AS rn FROM hybrid_hits) WHERE rn = 1""",
    "semantic_filtered": f"""SELECT vec_id AS chunk_id, source_path, round(s, 6) AS score FROM (SELECT vec_id, b.source_path, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS s FROM embeddings e JOIN chunks c ON c.id = e.vec_id JOIN books b ON b.id = c.book_id
WHERE lower(b.format_name) = 'fb2') ORDER BY s DESC, chunk_id LIMIT 10""",
}
