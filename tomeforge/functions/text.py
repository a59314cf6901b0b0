"""Text functions as Column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"
#: What counts as a search term: Latin letters, Russian letters, digits.
TERM = "^[0-9A-Za-zА-Яа-яЁё]+$"
LATIN_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
# Letters of the orthography before 1918 and what replaced them.
OLD_LETTERS, NEW_LETTERS = "ѢѣѲѳІіѴѵ", "ЕеФфИиИи"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, ё as е, Latin letters without accents."""
    low = F.replace(F.lower(c), F.lit("ё"), F.lit("е"))
    # character maps are slow: only for the few texts that have an accent
    return F.when(low.rlike(f"[{LATIN_ACCENTS[0]}]"), F.translate(low, *LATIN_ACCENTS)).otherwise(low)


def tokens(c: Column) -> Column:
    """All folded tokens in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def search_terms(c: Column) -> Column:
    return F.filter(F.coalesce(F.regexp_extract_all(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")), lambda t: t.rlike(TERM))


def is_old_spelling(c: Column) -> Column:
    return c.rlike(f"[{OLD_LETTERS}]")


def modern_spelling(c: Column) -> Column:
    """Letters replaced and final ъ dropped, only in texts that have one of the old letters."""
    return F.when(is_old_spelling(c), F.regexp_replace(F.translate(c, OLD_LETTERS, NEW_LETTERS), r"ъ(?![\p{L}\p{N}_])", "")).otherwise(c)


def turkic_normal(c: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")))


def english_normal(c: Column) -> Column:
    return F.concat_ws(" ", F.filter(F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")), lambda t: t.rlike("^[0-9A-Za-z]+$")))


def russian_terms(c: Column) -> Column:
    return F.concat_ws(" ", search_terms(modern_spelling(c)))


def normal_text(c: Column, language: Column) -> Column:
    """By language; anything unknown or null is taken as Russian. Lemmas are joined on afterwards, see lemma.py."""
    lang = F.coalesce(language, F.lit("ru"))
    return F.when(lang.isin("kk", "tt"), turkic_normal(c)).when(lang == "en", english_normal(c)).otherwise(russian_terms(c))


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """Compatibility form, single blanks, full case folding."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def is_metadata_line(c: Column) -> Column:
    return c.rlike(r"(?iu)^(title|author|название|автор)\s*:")


def fingerprint(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), text), 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def location(page: Column, chapter: Column, start: Column, end: Column) -> Column:
    return (
        F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string")))
        .when(F.coalesce(chapter, F.lit("")) != "", chapter)
        .when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("position "), start.cast("string"), F.lit("-"), end.cast("string")))
        .otherwise("position unknown")
    )


def display(title: Column, path: Column, place: Column, excerpt: Column) -> Column:
    return F.concat_ws(" — ", F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(basename(path)), place, excerpt)


def semantic_excerpt(c: Column) -> Column:
    t = strip(c)
    return F.when(F.length(t) > 300, F.concat(strip(F.substring(t, 1, 297)), F.lit("..."))).otherwise(t)


def cut_excerpt(c: Column, size: int = 200) -> Column:
    return F.concat(F.substring(c, 1, size), F.lit("..."))


def canonical_path(c: Column) -> Column:
    return F.lower(F.translate(c, "/", "\\"))


def answer_location(page: Column, chunk_no: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("стр. "), page.cast("string"))).otherwise(F.concat(F.lit("позиция "), (F.greatest(chunk_no, F.lit(0)) + 1).cast("string")))


def roman_to_int(c: Column) -> Column:
    """Subtractive, read from the right; other characters count nothing."""
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    worth = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    digits = F.transform(F.reverse(F.split(F.upper(c), "")), lambda d: F.coalesce(worth[d], F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(digits, start, lambda s, v: F.struct(F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), v.alias("last")), lambda s: s["sum"])


def century_years(c: Column) -> Column:
    return F.struct(((c - 1) * 100 + 1).alias("year_from"), (c * 100).alias("year_to"))


def safe_int(c: Column, default: int | None = None) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default).cast("int"))


def safe_double(c: Column) -> Column:
    return c.try_cast("double")
