import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tomeforge.operators.filters import SearchFilters, filter_books
from tomeforge.operators.fulltext import TextIndex, query_terms, rank_chunks, search_text, snippet_of
from tomeforge.operators.hybrid import above, exact_match, fuse, search_hybrid, stable_order
from tomeforge.operators.vectors import HashingEmbedder, add_or_replace, check_model, embed, nearest, nearest_blockwise, pending_chunks, search_semantic
from tomeforge.schemas import BOOKS, CHUNKS, VECTORS


def library(spark, rows):
    """rows: (path, raw, lemma, author, format, language)."""
    books = spark.createDataFrame([(i, p, None, a, f, lang, None) for i, (p, _, _, a, f, lang) in enumerate(rows)], BOOKS)
    chunks = spark.createDataFrame([(i, i, 0, r, m, None, None, None, 0, len(r)) for i, (_, r, m, *_) in enumerate(rows)], CHUNKS)
    return books, chunks


@pytest.mark.parametrize("phrase", [False, True])
def test_bm25_against_sqlite(spark, phrase, tmp_path):
    r = random.Random(7)
    words = [f"слово{i}" for i in range(12)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(1, 20))), " ".join(r.choices(words, k=r.randrange(0, 20)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(raw_text, lemma_text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t(rowid, raw_text, lemma_text) values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, raw_text string, lemma_text string")
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4).build(df)
    for terms in (["слово1"], ["слово1", "слово2"], ["слово3", "слово3"]):
        join = '"' + " ".join(terms) + '"' if phrase else None
        match = f"raw_text : {join} OR lemma_text : {join}" if phrase else "(" + " AND ".join(f'raw_text : "{t}"' for t in terms) + ") OR (" + " AND ".join(f'lemma_text : "{t}"' for t in terms) + ")"
        want = dict(db.execute("select rowid, bm25(t, 1.5, 1.0) from t where t match ?", (match,)).fetchall())
        got = {x.id: x.rank for x in rank_chunks(df, terms, terms, phrase).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        stored = {x.id: x.rank for x in index.rank(terms, terms, phrase).collect()}
        assert stored.keys() == want.keys() and all(abs(stored[k] - want[k]) < 1e-9 for k in want)
    plan = index.rank(["слово1"], [])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    index.optimize()
    assert index.current()["version"] == 2 and index.rank(["слово1"], []).count() == rank_chunks(df, ["слово1"], []).count()
    assert index.rank([], []).count() == 0 and TextIndex(spark, f"file://{tmp_path}/e").build(df.limit(0)).rank(["слово1"], []).count() == 0


def test_keyword_search(spark, tmp_path):
    books, chunks = library(spark, [("exact.txt", "Туманная книга стоит на полке.", "туманный книга стоять на полка", None, "txt", "ru"), ("other.txt", "Книга может быть туманной, но слова разделены.", "книга мочь быть туманный но слово разделить", None, "txt", "ru"), ("none.fb2", "Роман", "роман", "Nisargadatta Maharaj", "fb2", "kk")])
    hits = search_text(chunks, books, "туманная книга", phrase=True, lemma_query="туманный книга").collect()
    assert [h.source_path for h in hits] == ["exact.txt"] and hits[0].excerpt == "«Туманная книга» стоит на полке."
    assert search_text(chunks, books, "  ").count() == 0
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4).build(chunks)
    stored = search_text(chunks, books, "туманная книга", phrase=True, lemma_query="туманный книга", index=index).collect()
    assert [(h.source_path, h.excerpt, h["rank"]) for h in stored] == [(h.source_path, h.excerpt, h["rank"]) for h in hits] and search_text(chunks, books, "  ", index=index).count() == 0
    allowed = filter_books(books, SearchFilters(author="mahar", format_name="FB2", language="KK"))
    assert [r.source_path for r in allowed.collect()] == ["none.fb2"] and search_text(chunks, allowed, "роман").count() == 1 and search_text(chunks, allowed, "книга").count() == 0


def test_filters_on_other_tables(spark):
    books, _ = library(spark, [(f"{i}.txt", "x", "x", None, "txt", "ru") for i in range(3)])
    events = spark.createDataFrame([(0, 1905, 1922), (1, 1200, 1400)], "book_id long, year_from int, year_to int")
    ids = lambda **k: sorted(r.id for r in filter_books(books, **k).collect())
    assert ids(f=SearchFilters(year_from=1910, year_to=1920), timeline=events) == [0] and ids(f=SearchFilters(year_to=1300), timeline=events) == [1] and ids(f=SearchFilters()) == [0, 1, 2]
    links = spark.createDataFrame([(2, 5), (1, 6)], "book_id long, category_id int")
    assert ids(f=SearchFilters(category_ids=[5, 9]), book_categories=links) == [2]
    tags, on = spark.createDataFrame([(1, "Культура", "topic")], "id long, name string, tag_type string"), spark.createDataFrame([(1, 1)], "book_id long, tag_id long")
    assert ids(f=SearchFilters(tag="культура"), tags=tags, book_tags=on) == [1]


def test_snippet():
    text = " ".join(f"w{i}" for i in range(100))
    s = snippet_of(text, ["w50"])
    assert s.startswith(" … ") and s.endswith(" … ") and "«w50»" in s and len(s.split()) == 34
    assert snippet_of("один два", ["нет"]) == "один два" and query_terms("Ёж, ҚАЗАҚ!") == ["еж"]


def test_vectors(spark):
    df = spark.createDataFrame([(10, "m", "f", [1.0, 0.0, 0.0]), (11, "m", "f", [0.0, 2.0, 0.0])], VECTORS)
    assert [r.chunk_id for r in nearest(df, [1, 0, 0], 5).collect()] == [10, 11] == [r.chunk_id for r in nearest_blockwise(df, [1, 0, 0], 5).collect()]
    assert [r.chunk_id for r in nearest(df, [0, 2, 0], 5, metric="l2").collect()] == [11, 10]
    new = add_or_replace(df, spark.createDataFrame([(10, "m", "g", [0.0, 0.0, 1.0])], VECTORS), 3)
    assert new.count() == 2 and nearest(new, [0, 0, 1], 1).first().chunk_id == 10
    for bad in ([(1, "m", "f", [1.0])], [], [(1, "m", "f", [1.0] * 3)] * 2):
        with pytest.raises(ValueError):
            add_or_replace(df, spark.createDataFrame(bad, VECTORS), 3)
    with pytest.raises(ValueError):
        nearest(df, [1, 0, 0], 0)
    with pytest.raises(RuntimeError):
        check_model(spark.createDataFrame([("a",)], "model string"), "b")
    assert nearest(df.limit(0), [1, 0, 0], 3).count() == 0


def test_incremental_embedding(spark):
    _, chunks = library(spark, [(f"{i}.txt", f"текст {i}", "", None, "txt", "ru") for i in range(3)])
    e = HashingEmbedder(8)
    none = spark.createDataFrame([], VECTORS)
    done = embed(pending_chunks(chunks, none, e.model), e, 2).drop("error")
    assert done.count() == 3 and pending_chunks(chunks, done, e.model).count() == 0
    changed = chunks.withColumn("raw_text", F.when(F.col("id") == 1, "иначе").otherwise(F.col("raw_text")))
    assert [r.chunk_id for r in pending_chunks(changed, done, e.model).collect()] == [1]

    class Broken(HashingEmbedder):
        def embed(self, texts):
            raise TimeoutError("slow")

    assert {r.error for r in embed(pending_chunks(chunks, none, e.model), Broken(8)).collect()} == {"slow"}


def test_fusion(spark):
    df = spark.createDataFrame([(1, -10.0, 0.2), (2, -4.0, 0.4), (3, -1.0, 0.9), (4, None, None)], "chunk_id long, keyword_rank double, semantic_score double")
    got = {r.chunk_id: r for r in fuse(df, [], alpha=0.8).collect()}
    assert [got[i].keyword_norm for i in (1, 2, 3, 4)] == [1.0, pytest.approx(1 / 3), 0.0, 0.0] and got[3].semantic_norm == 1.0 and got[3].fused_score > got[1].fused_score
    low = {r.chunk_id: r.fused_score for r in fuse(df, [], alpha=0.2, boost=0.2, exact=F.col("chunk_id") == 1).collect()}
    assert low[1] == pytest.approx(1.0) and low[1] > low[3]
    for call in (lambda: fuse(df, [], alpha=1.2), lambda: above(df, "semantic_score", -1)):
        with pytest.raises(ValueError):
            call()
    assert sorted(r.chunk_id for r in above(df, "semantic_score", 0.4).collect()) == [2, 3]
    ties = spark.createDataFrame([(12, "b", 0, 1, 0.5), (10, "a", 2, 1, 0.5), (11, "a", 1, None, 0.5)], "chunk_id long, source_path string, chunk_no int, char_start int, fused_score double")
    assert [r.chunk_id for r in ties.orderBy(*stable_order()).collect()] == [11, 10, 12]
    t = spark.createDataFrame([("У «старой» мельницы", 0), (None, 1)], "t string, i int")
    assert [r[0] for r in t.select(exact_match(F.col("t"), "старой мельницы")).collect()] == [True, False]
    assert [r[0] for r in t.select(exact_match(F.col("t"), "старой мельницы", True)).collect()] == [False, False]


def test_hybrid(spark):
    books, chunks = library(spark, [("a.txt", "практика внимания каждый день", "практика внимание", "Иван", "txt", "ru"), ("b.txt", "тишина леса", "тишина лес", "Пётр", "txt", "ru"), ("c.txt", "другой текст", "другой текст", None, "pdf", "ru")])
    e = HashingEmbedder(32)
    vectors = embed(pending_chunks(chunks, spark.createDataFrame([], VECTORS), e.model), e).drop("error").cache()
    q = "практика внимания"
    hits = search_hybrid(chunks, books, vectors, q, e.embed([q])[0]).collect()
    assert hits[0].source_path == "a.txt" and hits[0].display.startswith("a.txt — position 0-29 — ") and hits[0].keyword_rank is not None
    only = search_hybrid(chunks, books, vectors, q, e.embed([q])[0], filters=SearchFilters(author="пётр")).collect()
    assert {h.source_path for h in only} <= {"b.txt"}
    assert [r.source_path for r in search_semantic(vectors, chunks, books, e.embed(["тишина леса"])[0], 1).collect()] == ["b.txt"]
