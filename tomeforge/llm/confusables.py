"""One consistent form of text that looks the same: width forms, accents, invisible characters, spaces, look-alikes.

Normalisation applies Unicode compatibility composition, drops invisible characters and turns every blank but line
breaks into the plain one.  Look-alike letters are repaired by script: in a token that mixes scripts the letters of
the other script are replaced by what they look like in the token's dominant script (or in the sentence's, if the
token itself is undecided); a token all of whose letters are look-alikes of another script is repaired only if its
neighbours and its sentence are in that script.  A replacement is made only if the repaired word occurs in the corpus vocabulary,
counted over all texts from tokens of one script.  Roman numerals in Latin letters stay.

Defined results: null text stays null and is no case, empty text stays empty; repeated rows give repeated rows in the
normalised form and one row in the cases; line breaks, dashes and quotation marks are kept; stress marks that combine
with no letter are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.runtime import table, written

# Letters that look alike, Latin or Greek and Cyrillic, position by position.
_LATIN = "aceopxyijsABCEHIJKMOPSTX" + "əƏhv"
_CYRIL = "асеорхуіјѕАВСЕНІЈКМОРЅТХ" + "әӘһѵ"
_LATIN2 = "YKkhHV"
_CYRIL2 = "УКкһНѴ"
_GREEK = "αΑΒΕΖΗΙΚΜΝοΟρΡΤΥΧικν"
_GREEK_LATIN = "aABEZHIKMNoOpPTYXikv"
_GREEK_CYRIL = {"α": "а", "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Ι": "І", "Κ": "К", "Μ": "М", "ο": "о", "Ο": "О", "ρ": "р", "Ρ": "Р", "Τ": "Т", "Υ": "У", "Χ": "Х", "κ": "к"}

TO_CYRILLIC = dict(zip(_LATIN, _CYRIL)) | dict(zip(_LATIN2, _CYRIL2)) | _GREEK_CYRIL
TO_LATIN = {c: a for a, c in dict(zip(_LATIN, _CYRIL)).items()} | {"У": "Y", "К": "K", "к": "k"} | dict(zip(_GREEK, _GREEK_LATIN))
MIN_COUNT = 2

#: A numeral; a single C, D or M is rather a letter posing as another.
_ROMAN = "(?:[IVXLCDM]{2,}|[ivxlcdm]{2,}|[IVXLivxl])"
ROMAN = re.compile(_ROMAN)
TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?…\n]+")


def _class(test) -> str:
    """A regular-expression class of the characters of the basic plane that pass the test."""
    points = [c for c in range(1, 0x10000) if not (0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3) and test(chr(c))]
    out = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"


def _blank(c: str) -> bool:
    return c in "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85" or c != " " and unicodedata.category(c) in ("Zs", "Zl", "Zp")


def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F


_made: dict[str, re.Pattern] = {}


def patterns() -> dict[str, re.Pattern]:
    """Compiled once per Python worker."""
    if not _made:
        latin, cyrillic = "A-Za-zəƏͰ-Ͽ", "Ѐ-ԯ"
        _made["invisible"] = re.compile(_class(_invisible)[:-1] + "\U000e0001-\U000e007f]")
        _made["space"] = re.compile(_class(_blank))
        _made["odd"] = re.compile(_class(lambda c: _invisible(c) or _blank(c) or unicodedata.normalize("NFKC", c) != c))
        _made["astral"] = re.compile("[\U00010000-\U0010ffff]")
        _made["mark"] = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿゙゚]")
        _made["other"] = re.compile(f"[{latin}]")
        _made["cyrillic"] = re.compile(f"[{cyrillic}]")
        _made["greek"] = re.compile("[Ͱ-Ͽ]")
        alone = re.escape("".join(TO_CYRILLIC))
        posing = re.escape("".join(TO_LATIN))
        # what a text must have somewhere to be looked at closely: two scripts side by side, or a token of nothing but look-alikes
        _made["suspect"] = re.compile(f"[{latin}][{cyrillic}]|[{cyrillic}][{latin}]|[A-Za-z][Ͱ-Ͽ]|[Ͱ-Ͽ][A-Za-z]|(?<!\\w)(?!{_ROMAN}(?!\\w))[{alone}]+(?!\\w)")
        _made["posing"] = re.compile(f"(?<!\\w)[{posing}]+(?!\\w)")
    return _made


def tidy(text: str) -> str:
    """Compatibility composition, no invisible characters, plain blanks; line breaks stay."""
    p = patterns()
    if text.isascii():
        return p["space"].sub(" ", text)
    return p["space"].sub(" ", unicodedata.normalize("NFKC", p["invisible"].sub("", text)))


def disguised(text: str) -> bool:
    """A width or compatibility form, an accent apart from its letter, an invisible character or an odd blank."""
    p = patterns()
    if p["odd"].search(text):
        return True
    if p["astral"].search(text) and (p["invisible"].search(text) or unicodedata.normalize("NFKC", text) != unicodedata.normalize("NFC", text)):
        return True
    return bool(p["mark"].search(text)) and unicodedata.normalize("NFC", text) != text


def _script(token: str) -> tuple[int, int, int]:
    """Letters of a token that are Latin, Cyrillic, Greek."""
    latin = cyrillic = greek = 0
    for c in token:
        if "Ѐ" <= c <= "ԯ":
            cyrillic += 1
        elif "Ͱ" <= c <= "Ͽ":
            greek += 1
        elif c <= "ɏ" or c == "ə":
            latin += 1
    return latin, cyrillic, greek


def look_alikes(text: str) -> list[tuple[str, str, int]]:
    """(token, repaired form, offset) of every token of a tidy text that may hold look-alikes."""
    p = patterns()
    if text.isascii() or not p["other"].search(text) or not (p["cyrillic"].search(text) or p["greek"].search(text)):
        return []
    if not p["suspect"].search(text) and not p["posing"].search(text):
        return []
    found = []
    for s in SENTENCE.finditer(text):
        part = s.group()
        if part.isascii() or not p["other"].search(part):
            continue
        tokens = [(m.group(), s.start() + m.start()) for m in TOKEN.finditer(part)]
        scripts = [_script(t) for t, _ in tokens]
        # only letters that could not pose as the other script speak for the sentence's
        pure_c = sum("Ѐ" <= x <= "ԯ" and x not in TO_LATIN for x in part)
        pure_l = sum("A" <= x <= "ɏ" and x not in TO_CYRILLIC for x in part)
        for k, ((token, at), (a, c, g)) in enumerate(zip(tokens, scripts)):
            if (a > 0) + (c > 0) + (g > 0) > 1:  # mixed
                as_c = "".join(TO_CYRILLIC.get(x, x) for x in token)
                as_l = "".join(TO_LATIN.get(x, x) for x in token)
                can_c, can_l = _script(as_c)[1] == len(token), _script(as_l)[0] == len(token)
                if can_c and can_l:
                    choice = as_c if (c, pure_c) > (a, pure_l) else as_l
                elif can_c or can_l:
                    choice = as_c if can_c else as_l
                else:
                    continue
                found.append((token, choice, at))
                if can_c and can_l:
                    found.append((token, as_l if choice == as_c else as_c, at))
                continue
            if not (a or c or g):
                continue
            near = [scripts[j] for j in (k - 1, k + 1) if 0 <= j < len(tokens)]
            if (a or g) and pure_c > pure_l and not ROMAN.fullmatch(token):
                alike = "".join(TO_CYRILLIC.get(x, x) for x in token)
                if _script(alike)[1] == len(token) and (len(token) == 1 or all(n[1] and not n[0] for n in near)):
                    if not any(n[0] > 1 and not n[1] for n in near):
                        found.append((token, alike, at))
            elif (c or g) and pure_l > pure_c:
                alike = "".join(TO_LATIN.get(x, x) for x in token)
                if _script(alike)[0] == len(token) and (len(token) == 1 or all(n[0] and not n[1] for n in near)):
                    if not any(n[1] > 1 and not n[0] for n in near):
                        found.append((token, alike, at))
    return found


def vocabulary(df: DataFrame, columns: list[str], min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased one-script words of all texts; counted per task before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            words = [w for w in seen if sum(map(bool, _script(w))) == 1]
            return pd.DataFrame({"word": words, "n": [seen[w] for w in words]}).astype({"word": object, "n": "int64"})

        for b in batches:
            for col in columns:
                for text in b[col]:
                    if text:
                        seen.update(TOKEN.findall(text.lower()))
            if len(seen) > 500_000:
                yield flush()
                seen.clear()
        yield flush()

    counted = df.select(*columns).mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def suspects(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, field_name, kind, token, repaired): kind is form for what needs no vocabulary, letter for possible look-alikes."""
    id_type = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for col in columns:
                for i, text in zip(b["id"], b[col]):
                    if not text:
                        continue
                    if disguised(text):
                        out.append((i, col, "form", None, None))
                        text = tidy(text)
                    for token, repaired, _ in look_alikes(text):
                        out.append((i, col, "letter", token, repaired.lower()))
            yield pd.DataFrame(out, columns=["id", "field_name", "kind", "token", "repaired"]).astype({"id": b["id"].dtype})

    return df.select(F.col(id_col).alias("id"), *columns).mapInPandas(scan, f"id {id_type}, field_name string, kind string, token string, repaired string")


def find(df: DataFrame, id_col: str, columns: list[str], corpus: DataFrame | None = None) -> DataFrame:
    """(id, field_name), distinct: fields whose text is not in its consistent form."""
    seen = written(suspects(df, id_col, columns).distinct(), "suspects")  # both branches below read what one pass found
    words = vocabulary(corpus if corpus is not None else df, columns)
    letters = seen.where(F.col("kind") == "letter").join(words, F.col("repaired") == F.col("word"), "left_semi")
    forms = seen.where(F.col("kind") == "form")
    return forms.select("id", "field_name").unionByName(letters.select("id", "field_name")).distinct().withColumnRenamed("id", id_col)


def repair(text: str | None, accepted: frozenset) -> str | None:
    """The consistent form of a text; accepted: (token, lower-cased repaired form) pairs found in the vocabulary."""
    if not text:
        return text
    text = tidy(text)
    done: set[int] = set()
    for token, repaired, at in sorted(look_alikes(text), key=lambda x: x[2]):
        if at not in done and (token, repaired.lower()) in accepted:
            text = text[:at] + repaired + text[at + len(token) :]
            done.add(at)
    return text


def normalise(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, columns) with every text in its consistent form."""
    seen = written(suspects(df, id_col, columns).where(F.col("kind") == "letter").distinct(), "suspects")
    words = vocabulary(df, columns)
    pairs = seen.join(words, F.col("repaired") == F.col("word"), "left_semi").groupBy("id").agg(F.collect_set(F.struct("token", "repaired")).alias("pairs"))
    rows = df.select(F.col(id_col).alias("id"), *columns).join(pairs, "id", "left")
    schema = "id " + dict(df.dtypes)[id_col] + "".join(f", {c} string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            accepted = [frozenset((x["token"], x["repaired"]) for x in p) if p is not None else frozenset() for p in b["pairs"]]
            yield pd.DataFrame({"id": b["id"]} | {c: pd.Series([repair(t, a) for t, a in zip(b[c], accepted)], index=b.index, dtype=object) for c in columns})

    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", ["id", "raw_text", "lemma_text"], spread=True)
    return find(chunks, "id", ["raw_text", "lemma_text"]).withColumnRenamed("id", "chunk_id")


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", ["id", "raw_text", "lemma_text"], spread=True)
    return normalise(chunks, "id", ["raw_text", "lemma_text"]).withColumnRenamed("id", "chunk_id")


QUERIES = {"p6_found": p6_found, "p6_texts": p6_texts}
