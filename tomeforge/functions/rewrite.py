"""Rewriting of long questions into a few key terms, on the driver and as a Column over a table of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search intent, and stems of the collection's subject.
STOPWORDS = [
    "а", "без", "был", "была", "были", "быть", "в", "во", "вы", "где", "да", "для", "до", "его",
    "ее", "если", "же", "за", "и", "из", "или", "как", "когда", "кто", "ли", "мне", "мы", "на",
    "не", "но", "о", "об", "от", "по", "при", "про", "с", "со", "так", "то", "только", "ты",
    "у", "уже", "что", "чтобы", "я", "здравствуйте", "подскажите", "пожалуйста", "давно", "пытаюсь", "понять", "можете", "помочь", "найти",
    "книге", "книгу", "автор", "подробно", "обычной", "ежедневной",
]
SUBJECT_STEMS = ["практ", "вниман", "наблюд", "мысл", "тишин", "медитац", "внутрен"]

LONG_WORDS, LONG_CHARS, LEAST_CHARS, KEY_TERMS, SEARCH_TERMS = 18, 170, 4, 8, 3


@dataclass(frozen=True)
class Rewritten:
    normalized: str
    search: str
    key_terms: tuple[str, ...]


def rewrite(query: str) -> Rewritten:
    text = re.sub(r"\s+", " ", query.strip())
    words = [w.casefold() for w in re.findall("[0-9A-Za-zА-Яа-яЁё]+", text)]
    kept = list(dict.fromkeys(w for w in words if len(w) >= LEAST_CHARS and w not in STOPWORDS))
    subject = [w for w in kept if any(s in w for s in SUBJECT_STEMS)]
    keys = (subject + [w for w in kept if w not in subject])[:KEY_TERMS]
    long = len(words) >= LONG_WORDS or len(text) >= LONG_CHARS
    return Rewritten(text, " ".join(keys[:SEARCH_TERMS]) if long and keys else text, tuple(keys))


def rewrite_columns(query: Column) -> Column:
    """struct<normalized, search, key_terms> of a query column."""
    text = F.trim(F.regexp_replace(query, r"\s+", " "))
    words = F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-zА-Яа-яЁё]+"), F.lit(0)), F.lower)
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= LEAST_CHARS) & ~F.array_contains(stop, w)))
    subject = lambda w: w.rlike("|".join(SUBJECT_STEMS))
    keys = F.slice(F.concat(F.filter(kept, subject), F.filter(kept, lambda w: ~subject(w))), 1, KEY_TERMS)
    long = (F.size(words) >= LONG_WORDS) | (F.length(text) >= LONG_CHARS)
    search = F.when(long & (F.size(keys) > 0), F.array_join(F.slice(keys, 1, SEARCH_TERMS), " ")).otherwise(text)
    return F.struct(text.alias("normalized"), search.alias("search"), keys.alias("key_terms"))
