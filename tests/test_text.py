from pyspark.sql import functions as F

from tomeforge.functions import text as X
from tomeforge.functions.language import detect_language
from tomeforge.functions.lemma import lemmatize
from tomeforge.functions.rewrite import rewrite, rewrite_columns
from tomeforge.schemas import BOOKS, conform


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_normalisation(spark):
    assert one(spark, " a\xa0b \t c\n", X.normalize_whitespace) == "a b c"
    assert one(spark, "Ｓtraße  ﬁ", X.normalize_text) == "strasse fi"
    for old, new in (("Сѣверъ", "Северъ"[:-1]), ("Ѳеодоръ", "Феодор"), ("міръ", "мир"), ("мѵро", "миро"), ("съезд", "съезд")):
        assert one(spark, old, X.modern_spelling) == new
    assert one(spark, None, X.tokens) == []
    assert one(spark, "Café, Ёж_1", X.tokens) == ["cafe", "еж_1"]
    assert one(spark, "XIX", X.roman_to_int) == 19 and one(spark, "", X.roman_to_int) == 0
    assert one(spark, "Title : x", X.is_metadata_line) and one(spark, "НАЗВАНИЕ: x", X.is_metadata_line)


def test_dispatch(spark):
    rows = [("КІТАП кітаптар", "kk"), ("Books and Libraries", "en"), ("Книги, ёж", None), ("книги", "zz")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, l string").select(X.normal_text(F.col("t"), F.col("l"))).collect()]
    assert got == ["кітап кітаптар", "books and libraries", "книги еж", "книги"]


def test_lemmas(spark):
    df = spark.createDataFrame([(1, "книга книги КНИГУ"), (2, "Книга, книги! Книгу? Ёжик и ёлки."), (3, None)], "id long, t string")
    got = {r.id: r.lemma_text for r in lemmatize(df.select("id", X.search_terms(F.col("t")).alias("terms")), "id", "terms").collect()}
    assert got == {1: "книга книга книга", 2: "книга книга книга ежик и елка", 3: ""}
    again = spark.createDataFrame([(1, got[2])], "id long, t string")
    assert lemmatize(again.select("id", X.search_terms(F.col("t")).alias("terms")), "id", "terms").first().lemma_text == got[2]


def test_places(spark):
    rows = [(4, "", None, None), (None, "Two", 1, 2), (None, "", 1, 2), (None, None, None, 2)]
    df = spark.createDataFrame(rows, "page int, chapter string, a int, b int")
    assert [r[0] for r in df.select(X.location(F.col("page"), F.col("chapter"), F.col("a"), F.col("b"))).collect()] == ["page 4", "Two", "position 1-2", "position unknown"]
    assert one(spark, "x" * 400, X.semantic_excerpt) == "x" * 297 + "..."


def test_language(spark):
    for text, lang in (("The quiet ledger of the village", "en"), ("Тихая рукопись в читальном зале", "ru"), ("Қалалық зерттеу оқу залында түрлі-түсті нұсқаулықты", "kk"), ("җыйнак истәлек кыска өзекне күрсәтә", "tt"), ("", "ru"), (None, "ru")):
        assert one(spark, text, detect_language) == lang


def test_rewrite(spark):
    long = "Здравствуйте, подскажите пожалуйста, давно пытаюсь понять, как практика внимания помогает в обычной жизни, можете помочь найти подробно об этом в книге автора, где описана практика"
    for q in (long, "  краткий   запрос ", ""):
        r, c = rewrite(q), one(spark, q, rewrite_columns)
        assert (r.normalized, r.search, list(r.key_terms)) == (c.normalized, c.search, c.key_terms)
    assert rewrite(long).search.startswith("практика внимания") and len(rewrite(long).search) < 120


def test_conform(spark):
    df = spark.createDataFrame([("1", "x", 5)], "id string, title string, extra int")
    assert conform(df, BOOKS).schema == BOOKS and conform(df, BOOKS).first().id == 1
