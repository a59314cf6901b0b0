"""Blocks with locators into sentence-aligned overlapping chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.operators.sequence import running_sum, with_previous

MAX_CHARS, OVERLAP_CHARS = 600, 120
# Short forms after which a full stop ends no sentence.
SHORT_FORMS = frozenset([
    "г", "гг", "в", "вв", "т", "тт", "с", "стр", "ул", "д", "кв", "им", "проф", "акад", "др", "см", "ср", "напр", "рис", "табл", "гл", "ок", "руб", "коп", "млн", "млрд", "тыс",
    "mr", "mrs", "ms", "dr", "prof", "st", "vol", "no", "fig", "ed", "pp", "cf", "eg", "ie", "vs",
])
_END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s+|$)")


def _ends(text: str, m: re.Match) -> bool:
    """Whether a mark ends a sentence: a single full stop does not after a short form or before a small letter."""
    if m.group() != ".":
        return True
    k = m.end()
    while k < len(text) and text[k].isspace():
        k += 1
    if k == len(text):
        return True
    if text[k].islower():
        return False
    k = m.start()
    while k and text[k - 1].isalpha():
        k -= 1
    word = text[k : m.start()]
    return word.lower() not in SHORT_FORMS and not (len(word) == 1 and word.isupper())


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of trimmed sentences; a text without any end is one sentence."""
    cuts = [0, *(m.end() for m in _END.finditer(text) if _ends(text, m)), len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        s = text[a:b]
        body = s.strip()
        if body:
            a += len(s) - len(s.lstrip())
            out.append((a, a + len(body)))
    return out


def windows(text: str, start: int, end: int, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, int, int]]:
    """(text, char_start, char_end) of the chunks of one domain.

    ends[k] is the length of the first k sentences, each with one blank behind it, so sentences i to j take
    ends[j] - ends[i] - 1 characters when joined, and both borders of a window are found by bisection.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and the overlap smaller")
    found = sentences(text)
    ends = list(accumulate((b - a + 1 for a, b in found), initial=0))
    out: list[tuple[str, int, int]] = []
    first = last = 0
    while last < len(found):
        last = max(first + 1, bisect_right(ends, ends[first] + max_chars + 1) - 1)
        out.append((" ".join(text[a:b] for a, b in found[first:last]), min(start + found[first][0], end), min(start + found[last - 1][1], end)))
        # the next window repeats at least one sentence, but never all of this one
        repeated = min(last - 1, bisect_left(ends, ends[last] - 1 - overlap))
        first = max(first + 1, repeated)
    return out


def domains(blocks: DataFrame, doc: str = "doc_id", order: str = "block_no") -> DataFrame:
    """(doc, domain_no, page, chapter, item_id, text, char_start, char_end): consecutive blocks of one locator joined.

    Blocks are compared and numbered range by range of their order, so a document of any length is spread over tasks;
    what one task joins is a domain, the blocks of one locator.
    """
    places = ["page", "chapter", "item_id"]
    seen = with_previous(blocks, [doc], order, places)
    same = F.col("previous").isNotNull()
    for c in places:
        same = same & F.col(c).eqNullSafe(F.col(f"previous.{c}"))
    marked = running_sum(seen.withColumn("_new", (~same).cast("int")).drop("previous"), [doc], order, F.col("_new"), "domain_no")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.col("char_start").alias("s"))))
    grouped = marked.groupBy(doc, "domain_no").agg(F.first("page").alias("page"), F.first("chapter").alias("chapter"), F.first("item_id").alias("item_id"), rows.alias("r"), F.max("char_end").alias("last"))
    text = F.concat_ws(" ", F.filter(F.col("r.t"), lambda t: F.coalesce(t, F.lit("")) != ""))
    start = F.coalesce(F.col("r")[0]["s"], F.lit(0))
    return grouped.select(doc, "domain_no", "page", "chapter", "item_id", text.alias("text"), start.alias("char_start"), F.coalesce("last", start + F.length(text)).alias("char_end"))


def chunk_domains(found: DataFrame, doc: str = "doc_id", max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc, chunk_no, text, page, chapter, item_id, char_start, char_end)."""
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and the overlap smaller")

    @F.pandas_udf("array<struct<text:string,char_start:int,char_end:int>>")
    def cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "char_start": a, "char_end": b} for t, a, b in windows(x or "", int(s), int(e), max_chars, overlap)] for x, s, e in zip(text, start, end)], index=text.index)

    cuts = found.select(doc, "domain_no", "page", "chapter", "item_id", cut("text", "char_start", "char_end").alias("parts"))
    numbered = running_sum(cuts, [doc], "domain_no", F.size("parts"), "_upto")
    parts = numbered.select(doc, "page", "chapter", "item_id", (F.col("_upto") - F.size("parts")).alias("_first"), F.posexplode("parts").alias("part", "c"))
    return parts.select(doc, (F.col("_first") + F.col("part")).cast("int").alias("chunk_no"), F.col("c.text").alias("text"), "page", "chapter", "item_id", F.col("c.char_start").alias("char_start"), F.col("c.char_end").alias("char_end"))


def chunk_id(path, no, text):
    """Ids by content: never reused for another text."""
    return F.xxhash64(path, no, text)
