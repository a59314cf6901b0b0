import json

import pytest

from tomeforge import cli
from tomeforge.operators.vectors import HashingEmbedder
from tomeforge.schemas import BOOK_CATEGORIES, BOOKS, CHUNKS, VECTORS
from tomeforge.sources.files import scan


def call(capsys, *args):
    code = cli.run(list(args))
    return code, json.loads(capsys.readouterr().out)


def test_commands(spark, tmp_path, capsys):
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    docs.mkdir()
    (docs / "a.txt").write_text("Title: Сад\n\nСтарые книги стояли на полке в 1917 году.", encoding="utf-8")
    (docs / "b.txt").write_text("Тихий лес шумел.", encoding="utf-8")
    spark.createDataFrame([("книги", "книга"), ("книга", "книга"), ("стояли", "стоять")], "form string, lemma string").write.parquet(str(tmp_path / "lemmas"))
    code, out = call(capsys, "--store", store, "index-files", "--path", str(docs), "--lemmas", str(tmp_path / "lemmas"))
    assert code == 0 and (out["indexed"], out["errors"]) == (2, [])
    for query in ("книга", "книги"):  # the form in the text and its lemma find each other
        _, out = call(capsys, "--store", store, "search-text", "--query", query)
        assert [r["title"] for r in out["results"]] == ["Сад"], query
    assert call(capsys, "--store", store, "index-files", "--path", str(docs))[1]["skipped"] == 2
    assert call(capsys, "--store", store, "search-hybrid", "--query", "x") == (2, {"error": "there is no vector index"})
    assert call(capsys, "--store", store, "index-vectors")[1]["embedded"] >= 2 and call(capsys, "--store", store, "index-vectors")[1]["embedded"] == 0
    _, out = call(capsys, "--store", store, "search-hybrid", "--query", "книги на полке")
    assert out["results"][0]["title"] == "Сад"
    call(capsys, "--store", store, "optimize")
    assert call(capsys, "--store", store, "search-text", "--query", "лес")[1]["results"]
    _, out = call(capsys, "--store", store, "build-timeline")
    assert out["total_events"] == 1
    other = spark.createDataFrame([(5, 7), (5, 8)], BOOK_CATEGORIES)
    cli.Store(spark, store).write(book_categories=other)
    call(capsys, "--store", store, "classify-books", "--min-score", "0")
    kept = cli.Store(spark, store).read("book_categories", BOOK_CATEGORIES).where("book_id = 5")
    assert sorted(r.category_id for r in kept.collect()) == [7, 8]
    assert cli.run(["--store", store, "search-text", "--query", "x", "--alpha", "2"]) == 2
    capsys.readouterr()
    cli.Store(spark, store).write({"model": "other", "dimension": 3})
    assert call(capsys, "--store", store, "search-semantic", "--query", "x")[0] == 2


def test_a_failed_write_leaves_the_collection(spark, tmp_path):
    store = cli.Store(spark, f"file://{tmp_path}/s")
    store.write(books=spark.createDataFrame([(1, "a", None, None, "txt", None, None)], BOOKS))
    with pytest.raises(Exception):
        store.write(books=spark.createDataFrame([], BOOKS), chunks=spark.createDataFrame([(1,)], "id long").selectExpr("assert_true(id > 1)"))
    assert store.read("books", BOOKS).count() == 1 and store.read("chunks", CHUNKS).count() == 0


def test_watch_stages(spark, tmp_path):
    store, docs = cli.Store(spark, f"file://{tmp_path}/s"), tmp_path / "in"
    docs.mkdir()
    (docs / "a.txt").write_text("Тихий лес шумел.", encoding="utf-8")
    done = cli.take_in(store, HashingEmbedder(), scan(spark, str(docs)))
    assert (done["status"], done["stage"], done["indexed"], done["embedded"]) == ("done", "vectors", 1, 1) and store.read("vectors", VECTORS).count() == 1
    (docs / "b.txt").write_text("Тихий лес шумел.", encoding="utf-8")
    again = cli.take_in(store, HashingEmbedder(), scan(spark, str(docs)))
    assert (again["status"], again["stage"], [r["reason"] for r in again["duplicates"]]) == ("duplicate", "text", ["binary-match"])
    (docs / "c.txt").write_text("Новый текст.", encoding="utf-8")

    class Broken(HashingEmbedder):
        dimension = property(lambda self: 1 / 0, lambda self, x: None)

    failed = cli.take_in(store, Broken(), scan(spark, str(docs)))
    assert failed["status"] == "failed" and failed["stage"] == "vectors" and "division" in failed["error"] and store.read("books", BOOKS).count() == 2
