import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeforge.operators import chunking as C
from tomeforge.operators import dialog, rag, timeline
from tomeforge.operators.dedupe import decide
from tomeforge.operators.sequence import running_sum, with_previous
from tomeforge.operators.skew import salted_join
from tomeforge.operators.taxonomy import classify
from tomeforge.operators.upsert import keep_existing, upsert
from tomeforge.schemas import BOOKS, CHUNKS, INDEX_STATE, SETTINGS
from tomeforge.sources.files import earlier_files, extract, index_files, scan
from tomeforge.sources.formats import PdfPage, decode, html_texts, ocr_status, order_pdf_blocks, parse, pdf_adapter, register, route
from tomeforge.streaming.watch import BINARY, arrivals, consume, debounce_batch, debounce_stream, parse_payloads


def test_windows_exact():
    text = "Alpha one. Beta two is longer. Gamma three. Delta four."
    got = C.windows(text, 10, 65, 40, 12)
    assert [g[0] for g in got] == ["Alpha one. Beta two is longer.", "Beta two is longer. Gamma three.", "Gamma three. Delta four."] and [g[1] for g in got] == [10, 21, 41]
    assert [text[a:b] for a, b in C.sentences("В 1900 г. родился А. С. Иванов. Он жил т. е. был.")] != [] and len(C.sentences("В 1900 г. родился А. С. Иванов. Он жил.")) == 2
    assert C.windows("", 0, 0) == [] and len(C.windows("x" * 2000 + ". Y.", 0, 2004)) == 2
    with pytest.raises(ValueError):
        C.windows("a", 0, 1, 10, 10)


def test_domains_never_cross(spark):
    rows = [(1, 0, "One a.", None, "One", "item-1", 0, 6), (1, 1, "One b.", None, "One", "item-1", 7, 13), (1, 2, "Two.", None, "Two", "item-2", 0, 4)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, text string, page int, chapter string, item_id string, char_start int, char_end int")
    out = C.chunk_domains(C.domains(blocks), max_chars=40, overlap=10).orderBy("chunk_no").collect()
    assert [(r.text, r.chapter, r.char_start, r.char_end) for r in out] == [("One a. One b.", "One", 0, 13), ("Two.", "Two", 0, 4)]


def test_dedupe(spark):
    df = spark.createDataFrame([("a", "h1", "n1"), ("b", "h1", "n1"), ("c", "h2", "n1"), ("d", "h3", "n2"), ("e", "h4", "n9")], "p string, binary_hash string, normal_hash string")
    old = spark.createDataFrame([("h9", "n9")], "binary_hash string, normal_hash string")
    got = {r.p: r.reason for r in decide(df, "p", history=old).collect()}
    assert got == {"a": None, "b": "binary-match", "c": "normalized-content-match", "d": None, "e": "normalized-content-match"}


def test_timeline(spark):
    texts = ["1914-1918 и 1922–1917", "в 1917 году, 42, 7", "1840-е годы", "XIX веке", "XX столетии", "XVIII–XIX вв.", "Около 1850 года", "", "в XIX вв.", "1840е года", "1910-1920-1930", None, "x1917 19171 2030 XIXв", "1840-е 1920-1930"]
    df = spark.createDataFrame([(k, 1, t, "x") for k, t in enumerate(texts)], "id int, book_id int, raw_text string, s string")
    got = [[] for _ in texts]
    for r in timeline.extract(df).collect():
        got[r.chunk_id].append((r.year_from, r.year_to, r.is_approximate, r.confidence, r.source_fragment))
    assert got[0] == [(1914, 1918, False, 0.95, "1914-1918"), (1917, 1922, False, 0.95, "1922–1917")] and got[1] == [(1917, 1917, False, 0.9, "1917")]
    assert got[2] == [(1840, 1849, True, 0.7, "1840-е годы")] and got[3] == [(1801, 1900, True, 0.6, "XIX веке")] and got[4] == [(1901, 2000, True, 0.6, "XX столетии")]
    assert got[5] == [(1701, 1900, True, 0.6, "XVIII–XIX вв")] and got[6] == [(1850, 1850, True, 0.9, "1850")] and got[7] == got[11] == got[12] == []
    assert got[8] == [(1801, 1900, True, 0.6, "XIX вв")] and got[9] == [(1840, 1849, True, 0.7, "1840е года")] and [x[:2] for x in got[10]] == [(1910, 1920), (1930, 1930)]
    assert [x[:2] for x in got[13]] == [(1840, 1849), (1920, 1930)] and timeline.extract(df.limit(0)).count() == 0


def test_ranges_of_a_long_group(spark):
    rows = [(d, k, (k * 7) % 5) for d in (1, None) for k in range(200) if k % 11]
    df = spark.createDataFrame(rows, "d int, k int, v int")
    for width in (1, 16, 1000):
        out = running_sum(with_previous(df, ["d"], "k", ["v"], width=width), ["d"], "k", F.col("v"), "upto", width=width).collect()
        assert len(out) == len(rows)
        for d in (1, None):
            own = sorted((r for r in out if r.d == d), key=lambda r: r.k)
            assert [r.upto for r in own] == [sum(x.v for x in own[: i + 1]) for i in range(len(own))]
            assert [r.previous and r.previous.v for r in own] == [None] + [x.v for x in own[:-1]]


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0), (3, 0), (None, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "d")], "k int, w string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, salted_join(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "right")


def test_classify(spark):
    words = [(1, "История", ["летопись", "война"]), (2, "Язык", ["слово", "война"])]
    df = spark.createDataFrame([(1, "Летопись, война и слово"), (2, ""), (3, "нет")], "book_id long, text string")
    got = [(r.category_id, round(r.score, 2)) for r in classify(df, thesaurus=words).orderBy(F.desc("score"), "category_id").collect()]
    assert got == [(1, 0.5), (2, 0.5)] and classify(df, thesaurus=words, min_score=0.9).count() == 0 and classify(df, thesaurus=words, top_n=1).count() == 1


def test_rag(spark):
    hits = spark.createDataFrame([(1, k, p, "x" * 100, 0.5 - k / 10) for k, p in enumerate(["a", "a", "a", "b"])], "query_id long, rank int, source_path string, excerpt string, hybrid_score double")
    assert sorted(r["rank"] for r in rag.select_context(hits, 500, group=["query_id"]).collect()) == [0, 3]
    assert sorted(r["rank"] for r in rag.select_context(hits, 10**6, group=["query_id"]).collect()) == [0, 1, 3] and rag.select_context(hits, 0).count() == 0
    assert rag.sufficient(hits, ["query_id"]).first().sufficient and not rag.sufficient(hits.where("rank = 0"), ["query_id"]).first().sufficient
    assert rag.answer("p", "lead ", True) == ("lead [1]", True) and rag.answer("p", "l", False) == (rag.NO_DATA, False)

    class Slow(rag.Generator):
        def answer(self, prompt, lead):
            raise TimeoutError

    assert rag.answer("p", "l", True, Slow()) == (rag.NO_DATA, False)


def test_dialog(spark):
    rows = [(i, 1, 1, "user" if i % 2 else "assistant", f"m{i}", None) for i in range(6)]
    schema = "id long, chat_id long, user_id long, role string, content string, created_at timestamp"
    h = dialog.append(spark.createDataFrame([], schema), spark.createDataFrame(rows + [(9, 1, 1, "system", "x", None)], schema), keep=5)
    assert sorted(r.id for r in h.collect()) == [1, 2, 3, 4, 5]
    assert [r.content for r in dialog.read_history(h, 4, ["chat_id", "user_id"]).orderBy("place").collect()] == ["m2", "m3", "m4", "m5"]
    s = dialog.set_excerpt_size(spark.createDataFrame([], SETTINGS), 7, 300)
    assert dialog.excerpt_size(s, 7) == 300 and dialog.excerpt_size(s, 8) == 200
    with pytest.raises(ValueError):
        dialog.set_excerpt_size(s, 7, 10)
    assert dialog.answer_text("ok", None, [("t", "a", "p", "l")]).endswith("1. t — a; p; l")


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(a, b, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, keep_existing(a, b, "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]


FB2 = '<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>Иван</first-name><last-name>Листов</last-name></author><book-title>Сад</book-title><lang>ru</lang></title-info></description><body><section><title><p>Глава</p></title><p>Shared duplicate body for checking.</p></section></body></FictionBook>'


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><metadata/><manifest><item id="i1" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i2" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="i2"/><itemref idref="i1"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><body><h1>A</h1><p>First text</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><h1>B</h1><p>Second</p></body></html>")
    return out.getvalue()


def test_formats():
    kind, meta, blocks = parse("Название: Сад\nАвтор: Лист\n\nТекст".encode("cp1251"), "/x/y.txt")
    assert (kind, meta["title"], meta["author"]) == ("txt", "Сад", "Лист") and blocks[-1]["item_id"] == "line-4" and blocks[-1]["char_start"] == 27
    kind, meta, blocks = parse(FB2.encode(), "a.fb2")
    assert meta == {"title": "Сад", "language": "ru", "author": "Иван Листов"} and blocks[0]["chapter"] == "Глава"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.fb2", FB2)
    assert parse(z.getvalue(), "a.fb2.zip")[1]["title"] == "Сад" and route("a.fbz", z.getvalue(), compat=True) == "epub"
    kind, meta, blocks = parse(epub(), "/x/mystic_collection.epub")
    assert meta["title"] == "Mystic Collection" and [(b["text"], b["char_start"]) for b in blocks] == [("B", 0), ("Second", 2), ("A", 0), ("First text", 2)]
    assert html_texts("<blockquote><p>in</p> out</blockquote>") == ["in out", "in"]
    with pytest.raises(ValueError):
        parse(b"%PDF-1.4", "a.pdf")
    with pytest.raises(ValueError):
        register(" ", None)
    assert [b["text"] for b in order_pdf_blocks([[(0, 9, 1, "two"), (0, 1, 0, "one")], [(0, 0, 0, "next")]])] == ["one", "two", "next"]
    assert [ocr_status(5, 10, None)[0], ocr_status(0, 10, None)[0], ocr_status(0, 10, lambda: "")[0], ocr_status(0, 10, lambda: "x")[0], ocr_status(0, 10, lambda: 1 / 0)[0]] == ["EMBEDDED", "OCR_SKIPPED", "OCR_EMPTY", "OCR_SUCCESS", "OCR_FAILED"]


def test_code_pages():
    text = "Название: Сад\nТихий старый лес шумел над рекой, и никто не видел дома."
    for encoding in ("utf-8", "utf-8-sig", "utf-16", "cp1251", "koi8-r", "cp866"):
        assert decode(text.encode(encoding)) == text, encoding
    assert decode("café".encode("cp1252")) and decode(b"") == "" and decode(b"plain") == "plain"


def test_pdf_adapter():
    pages = [PdfPage(1000.0, [(0, 9, 1, "two  words"), (0, 1, 0, "one")]), PdfPage(1000.0, [], b"scan"), PdfPage(1000.0, [], b"blank"), PdfPage(1000.0, [])]
    read = lambda content: ({"title": None, "author": "A"}, pages)
    meta, blocks = pdf_adapter(read, lambda picture: "seen" if picture == b"scan" else " ")(b"%PDF-", "/x/my_book.pdf")
    assert meta == {"author": "A", "title": "My Book", "ocr": "EMBEDDED,OCR_SUCCESS,OCR_EMPTY,OCR_SKIPPED"}
    assert [(b["text"], b["page"], b["char_start"]) for b in blocks] == [("one", 1, 0), ("two words", 1, 4), ("seen", 2, 0)]
    assert pdf_adapter(read)(b"", "a.pdf")[0]["ocr"] == "EMBEDDED,OCR_SKIPPED,OCR_SKIPPED,OCR_SKIPPED"
    assert pdf_adapter(read, lambda picture: 1 / 0)(b"", "a.pdf")[0]["ocr"] == "EMBEDDED,OCR_FAILED,OCR_FAILED,OCR_SKIPPED"


def test_index_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title: Text\n\nShared duplicate body for checking.", encoding="utf-8")
    (tmp_path / "b.txt").write_text("Другой текст. И ещё.", encoding="utf-8")
    (tmp_path / "skip.doc").write_text("x")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.4")
    empty = [spark.createDataFrame([], s) for s in (BOOKS, CHUNKS, INDEX_STATE)]
    b, c, s, r = (x.cache() for x in index_files(scan(spark, str(tmp_path)), *empty, run_no=1))
    assert {(x.status, x.reason) for x in r.collect()} == {("indexed", None), ("error", None)} and b.count() == 2 and s.count() == 2
    assert c.select("id").distinct().count() == c.count() >= 3
    (tmp_path / "b.txt").write_text("Новый текст.", encoding="utf-8")
    (tmp_path / "c.txt").write_text("Title: Other\n\nShared duplicate body for checking.", encoding="utf-8")
    b2, c2, s2, r2 = index_files(scan(spark, str(tmp_path)), b, c, s, run_no=2)
    assert {os.path.basename(x.source_path): (x.status, x.reason) for x in r2.collect() if x.status != "error"} == {"a.txt": ("skipped", "unchanged"), "b.txt": ("indexed", None), "c.txt": ("indexed", None)}
    assert {x.raw_text for x in c2.join(b2.where(F.col("source_path").endswith("b.txt")).select(F.col("id").alias("book_id")), "book_id").collect()} == {"Новый текст."}
    assert extract(scan(spark, str(tmp_path)).limit(0)).count() == 0


def test_duplicates_of_earlier_runs(spark, tmp_path):
    body = "\n\nShared body for checking."
    (tmp_path / "m.txt").write_text("Title: Text" + body, encoding="utf-8")
    b, c, s = (spark.createDataFrame([], x) for x in (BOOKS, CHUNKS, INDEX_STATE))

    def run(state):
        _, _, new, results = index_files(scan(spark, str(tmp_path)), b, c, state, across_runs=True)
        return spark.createDataFrame(new.collect(), INDEX_STATE), {os.path.basename(x.source_path): (x.status, x.reason) for x in results.collect()}

    s, got = run(s)
    assert got == {"m.txt": ("indexed", None)}
    (tmp_path / "a.txt").write_text("Title: Text" + body, encoding="utf-8")
    (tmp_path / "z.txt").write_text("Title: Other" + body, encoding="utf-8")
    s, got = run(s)
    assert got == {"a.txt": ("skipped", "binary-match"), "m.txt": ("skipped", "unchanged"), "z.txt": ("skipped", "normalized-content-match")}
    (tmp_path / "m.txt").write_text("Title: Better" + body, encoding="utf-8")
    _, got = run(s)  # the indexed path itself may change
    assert {k: v[0] for k, v in got.items()} == {"a.txt": "skipped", "m.txt": "indexed", "z.txt": "skipped"}
    state = spark.createDataFrame([("file:/gone.txt", "h1", None), ("file:/m.txt", "h2", "n2")], "source_path string, fingerprint string, normal_hash string")
    good = spark.createDataFrame([("file:/new.txt", "h1", "n1"), ("file:/m.txt", "h3", "n3")], "source_path string, fingerprint string, normal_hash string")
    assert [tuple(r) for r in earlier_files(good, state).collect()] == [("h1", "n1")]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("x")
    (src / ".b.txt").write_text("x")
    seen, failed = [], []

    def work(batch, epoch):
        seen.extend(os.path.basename(r.path) for r in batch.collect())
        raise ValueError("broken")

    q = consume(arrivals(spark, str(src)), work, str(tmp_path / "ck"), once=True, failed=lambda e, x: failed.append(str(x)))
    q.awaitTermination(60)
    assert seen == ["a.txt"] and failed == ["broken"]
    with pytest.raises(ValueError):
        arrivals(spark, str(tmp_path / "none"))
    assert "path" in BINARY


def test_debounce(spark, tmp_path):
    rows = [(i, "p", f"2025-01-01 00:00:0{t}") for i, t in enumerate((0, 1, 2, 5))]
    df = spark.createDataFrame(rows, "event_id long, path string, t string").select("event_id", "path", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.n for r in debounce_batch(df, "ts", "path").collect()) == [1, 3]
    df.withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, path string, ts timestamp, x int").parquet(str(tmp_path / "e"))
    q = debounce_stream(stream, "ts", "path").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from bursts").count() <= 2


def test_payloads(spark):
    good = json.dumps({"results": [{"source_path": "a", "is_duplicate": True, "reason": "binary-match"}], "errors": []})
    rows = [good, "{x", "[]", json.dumps({"results": [], "errors": [{"path": "a", "error": "boom"}]}), json.dumps({"results": [], "errors": []})]
    got = [(r.ok, r.error) for r in parse_payloads(spark.createDataFrame([(x,) for x in rows], "json string")).collect()]
    assert got[0] == (True, None) and got[3] == (False, "boom") and all(not ok and e for ok, e in got[1:])
