"""Keyword classification of books. The thesaurus is a parameter: (category_id, name, keywords)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.functions.text import TOKEN

#: A small example for a book collection; real ones are loaded with load_thesaurus().
THESAURUS = [
    (1, "Хроники", ["летопись", "хроника", "архив", "предание", "протокол", "опись"]),
    (2, "Словесность", ["роман", "поэма", "повесть", "сказка", "баллада", "сонет", "рассказ"]),
    (3, "Справочники", ["словарь", "каталог", "указатель", "атлас", "лексикон", "календарь"]),
    (4, "Letters", ["letter", "diary", "memoir", "chronicle", "archive"]),
    (5, "Кітап", ["кітап", "дәптер", "қолжазба", "сөздік", "журнал"]),
    (6, "Китап", ["китап", "дәфтәр", "кулъязма", "сүзлек", "дастан"]),
]
MIN_SCORE, TOP_N, SAMPLE_CHUNKS = 0.01, 3, 20


def load_thesaurus(path: str) -> list[tuple[int, str, list[str]]]:
    """From JSON {categories: [{id, name, ...}], keywords: {id: [...]}}."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return [(int(c["id"]), c["name"], list(data["keywords"].get(str(c["id"]), []))) for c in data["categories"]]


def book_sample(chunks: DataFrame, n: int = SAMPLE_CHUNKS) -> DataFrame:
    """(book_id, text): the first n chunks of each book joined by blanks."""
    first = chunks.withColumn("rn", F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_no"))).where(F.col("rn") <= n)
    rows = first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "raw_text"))).alias("r"))
    return rows.select("book_id", F.concat_ws(" ", F.col("r.raw_text")).alias("text"))


def classify(texts: DataFrame, key: str = "book_id", thesaurus=None, min_score: float = MIN_SCORE, top_n: int = TOP_N) -> DataFrame:
    """(key, category_id, name, score): matched keywords per distinct word, the best top_n; ties keep the thesaurus' order."""
    spark = texts.sparkSession
    rows = [(pos, c, name, w.lower()) for pos, (c, name, words) in enumerate(thesaurus or THESAURUS) for w in dict.fromkeys(words)]
    keywords = F.broadcast(spark.createDataFrame(rows, "pos int, category_id int, name string, word string"))  # a fixed list
    words = texts.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("words"))
    hits = words.select(key, F.size("words").alias("n"), F.explode("words").alias("word")).join(keywords, "word").groupBy(key, "n", "pos", "category_id", "name").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.select(key, "pos", "category_id", "name", (F.col("hits") / F.greatest("n", F.lit(1))).alias("score")).where(F.col("score") >= min_score)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_n).select(key, "category_id", "name", "score")


def categories_table(spark: SparkSession, thesaurus=None) -> DataFrame:
    return spark.createDataFrame([(c, n, None, None) for c, n, _ in thesaurus or THESAURUS], "id int, name string, parent_id int, description string")
