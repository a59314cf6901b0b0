"""Lemmas of Russian words: a dictionary first, then a light ending rule that only maps onto known lemmas.

Without the full dictionary this is an approximation: the dictionary is a parameter (form -> lemma), and words it does
not know keep their form unless dropping an ending gives a known lemma's stem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.operators.skew import salted_join

#: A seed; callers pass a larger table.
SEED = {"книга": "книга", "книги": "книга", "книгу": "книга", "книге": "книга", "книгой": "книга", "книг": "книга", "ежик": "ежик", "ежика": "ежик", "ежике": "ежик", "елка": "елка", "елки": "елка", "елку": "елка"}
ENDINGS = "(иями|ями|ами|ией|иям|ием|иях|ого|его|ому|ему|ыми|ими|ая|яя|ую|юю|ое|ее|ые|ие|ый|ий|ой|ей|ам|ям|ах|ях|ов|ев|ом|ем|ою|ею|а|я|о|е|ы|и|у|ю|ь|й)$"


def stem(c):
    return F.when(F.length(c) > 4, F.regexp_replace(c, ENDINGS, "")).otherwise(c)


def learn_dictionary(chunks: DataFrame, raw: str = "raw_text", lemma: str = "lemma_text") -> DataFrame:
    """(form, lemma) from texts that come with lemmas, where both have the same number of tokens: the most frequent lemma of a form."""
    from tomeforge.functions.text import search_terms

    both = F.struct(search_terms(F.col(raw)).alias("r"), search_terms(F.col(lemma)).alias("l"))
    pairs = chunks.select(F.explode(F.array(both)).alias("t")).select("t.r", "t.l").where(F.size("r") == F.size("l"))
    flat = pairs.select(F.explode(F.arrays_zip("r", "l")).alias("p")).select(F.col("p.r").alias("form"), F.col("p.l").alias("lemma"))
    counted = flat.groupBy("form", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("form").agg(F.max(F.struct("n", "lemma")).alias("m")).select("form", F.col("m.lemma").alias("lemma"))


def lemmas_of(terms: list[str], dictionary: DataFrame) -> list[str]:
    """The lemmas of a query's terms, in order; only the dictionary's rows of their forms and stems are read into the plan."""
    if not terms:
        return []
    asked = dictionary.sparkSession.createDataFrame([(0, terms)], "id int, terms array<string>")
    stems = [r.s for r in asked.select(F.explode("terms").alias("t")).select(stem(F.col("t")).alias("s")).collect()]
    near = dictionary.where(F.col("form").isin(terms) | stem(F.col("form")).isin(stems))
    return lemmatize(asked, "id", "terms", near).first().lemma_text.split(" ")


def lemmatize(df: DataFrame, id_col: str, terms_col: str, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, lemma_text): the terms of each row replaced by their lemmas, in order."""
    spark = df.sparkSession
    words = dictionary if dictionary is not None else spark.createDataFrame(list(SEED.items()), "form string, lemma string")
    stems = words.select(stem(F.col("form")).alias("stem"), "lemma").groupBy("stem").agg(F.min("lemma").alias("by_stem"))
    flat = df.select(F.col(id_col).alias("id"), F.posexplode(terms_col).alias("pos", "form"))
    forms = flat.select("form").distinct()
    known = forms.join(words, "form", "left").withColumn("stem", stem(F.col("form"))).join(stems, "stem", "left").select("form", F.coalesce("lemma", "by_stem", "form").alias("lemma"))
    parts = salted_join(flat, known, ["form"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("l"))
    return df.select(F.col(id_col).alias("id")).distinct().join(parts, "id", "left").select(F.col("id").alias(id_col), F.concat_ws(" ", F.col("l.lemma")).alias("lemma_text"))
