"""Personal information inside free text: information-theoretic sanitisation.

Protected entities with a form of their own (mail addresses, phones, identity numbers, street addresses) are found by
patterns.  Names have none, and no list of names is used: how strongly a term reveals a person is estimated from the
corpus.  For every term the corpus gives how often it occurs, in which case, how often in a sentence with a protected
entity, and what it stands next to.  Disclosure is the pointwise mutual information between a term and what reveals, as a
share of the most it could be.  First the protected entities reveal: terms written as names that go with them are
candidates.  Then initials, patronymics and the terms found so far reveal, and a term discloses a person if it goes with
them and has more than one such neighbour, until none is added.  Next to a disclosing term or an initial, a term that is
no common word belongs to the name; a rare term whose neighbours all disclose persons is no common word, however it is
written.  Such runs are generalised to a placeholder, as are the other entities; nothing else changes.

Counts cover all texts and are exact at every size; they are aggregated per task before the shuffle.  What is known of
the terms that make up at least FREQUENT_SHARE of all running words, at most 1 / FREQUENT_SHARE of them, is broadcast;
of all others it reaches the texts by joins.

Defined results: null text stays null and has no entity; overlapping entities: the one that begins first, then the
longer, then the order of TYPES; repeated rows give one case each distinct item and as many sanitised rows; extra
columns are ignored; an empty table gives an empty result; texts are handled whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.runtime import table, written

TYPES = ["email", "phone", "id_number", "address", "name"]
FREQUENT_SHARE = 1e-5
#: Share of the attainable mutual information from which on a term discloses persons, by its neighbours and, to begin
#: with, by the protected entities in its sentences.
DISCLOSURE, FIRST_DISCLOSURE = 0.55, 0.5
#: Of a common word's occurrences at least this share are in lower case, or less than CASED are in lower case or in
#: capitals within a sentence, or less than REVEALED are next to what reveals or in a sentence with it.
LOWER, CASED, REVEALED = 0.35, 0.25, 0.3
#: A word half of whose occurrences are next to what reveals and in the same case, with up to so many different neighbours
#: (one, if it only ever begins sentences), is no common word but a rare name.
FEW, ONE = 8, 1

_AT = r"(?:[ \t]?@[ \t]?|[ \t]?[\[({][ \t]?(?:at|собака|собачка)[ \t]?[\])}][ \t]?)"
_DOT = r"(?:\.|[ \t]?[\[({][ \t]?(?:dot|точка)[ \t]?[\])}][ \t]?)"
_LOCAL = r"(?<![\w.+@-])[\w][\w.+-]*"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+|[ \t](?:at|собака)[ \t][^\W_][\w-]*(?:[ \t](?:dot|точка)[ \t][^\W_][\w-]*)+)", re.IGNORECASE)
_MAIL_SIGN = re.compile(r"@|[\[({ \t](?:at|собака|собачка)[\])} \t]", re.IGNORECASE)
PHONE = re.compile(
    r"(?<![\w./-])(?:(?:\+7|8)[ .\-‑]?(?:\(\d{3}\)|\d{3})[ .\-‑]?\d{3}[ .\-‑]?\d{2}[ .\-‑]?\d{2}"
    r"|\+44[ -]?\(?0?\)?\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}(?:[ -]?\d{2,3})?|0\d{4}[ -]\d{3}[ -]?\d{3}|0\d{2}[ -]\d{4}[ -]\d{4}"
    r"|(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4})(?![\w-]|\.\d)"
)
_LABEL = r"(?:паспорт\w*|удостоверени\w+|ИНН|СНИЛС|ЖСН|ИИН|жеке\s+куәлі\w+|жеке\s+куәлік|төлқұжат\w*|таныклык\w*|passport|id\s+card|identity\s+card|NINO|NI\s+number|national\s+insurance(?:\s+number)?)"
_MORE = r"(?:\s+(?:сери[ияй]|no\.?|number|номер\w*|№))*\s*[:№#]?\s*"
_NUMBER = r"(?:[A-ZА-ЯЁ]{1,2}[ -]?)?\d[\d]*(?:[ -]\d+)*(?:[ ]?[A-Z])?"
LABELLED = re.compile(rf"(?<!\w){_LABEL}{_MORE}({_NUMBER})(?!\w)", re.IGNORECASE)
_CODE_SIGN = re.compile(r"[A-Z] ?\d\d|\d-\d{3}-\d")
TAX_CODE = re.compile(r"(?<![\w-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\w-])|(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)|(?<!\w)[A-Z]\d{7}[A-Z](?!\w)")

_CAP = r"[A-ZА-ЯЁӘҒҚҢӨҰҮҺІҖ][\w'’]*"
_NAME12 = rf"{_CAP}(?:[ -]{_CAP})?"
_KIND = r"(?:улица|ул\.|переулок|пер\.|проспект|пр-т|пр\.|набережная|наб\.|бульвар|б-р|шоссе|ш\.|площадь|пл\.|тракт)"
_HOUSE = r"(?:(?:дом|д\.)\s?)?\d{1,4}(?:[А-Яа-яA-Z]|к\d{1,2}|/\d{1,3})?(?:-\d{1,4})?(?:,?\s(?:корп\.|к\.|стр\.)\s?\d{1,3})?(?:,?\s?(?:кв\.|квартира|оф\.|офис)\s?\d{1,5})?"
ADDRESS = re.compile(
    rf"(?<!\w)(?:{_KIND}\s?{_NAME12},?\s?{_HOUSE}|{_NAME12}\s(?:ул\.|улица|пер\.|наб\.|пр-т),?\s?{_HOUSE}"
    rf"|{_NAME12}\s(?:көшесі|к-сі|даңғылы)(?:,\s?|\s)\d{{1,4}}(?:-үй(?:,\s?\d{{1,5}}-пәтер)?|/\d{{1,5}})?"
    rf"|{_NAME12}\s(?:урамы|ур\.)(?:,\s?|\s)\d{{1,4}}(?:\s?йорт(?:,\s?\d{{1,5}}\s?фатир)?|-\d{{1,5}})?"
    rf"|(?:(?:Flat|Apt|Unit)\.?\s\d{{1,5}},\s)?\d{{1,4}}[A-Z]?\s{_CAP}(?:\s{_CAP}){{0,2}}?\s(?:Road|Rd|Street|St|Lane|Ln|Row|Avenue|Ave|Close|Drive|Way|Place|Square|Court)\b\.?(?:,\s(?:Flat|Apt|Unit|Office)\.?\s\d{{1,5}})?)(?!\w)"
)
LINK = re.compile(r"https?://\S+")

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"[^!?\n;]+")
_BORDER = re.compile(r"[.!?\n:]")
PATRONYMIC = re.compile(r"[а-яё]{2,}(?:ович|евич|овна|евна|ична|инична)(?:а|у|ем|е|ы|ой|и)?")
#: Endings of given names in other cases.
_ENDINGS = ("у", "а", "е", "ю", "и", "ы", "ом", "ем", "ой", "ей", "ға", "ге", "ның", "нің", "га")


def fold(word: str) -> str:
    return word.lower().replace("ё", "е")


def base_forms(word: str) -> list[str]:
    """The folded word and what it may be in the nominative."""
    forms = [word]
    for e in _ENDINGS:
        stem = word[: -len(e)]
        if len(stem) >= 3 and word.endswith(e):
            forms += [stem, *(stem + x for x in "аяй"), stem[:-1] + "е" + stem[-1]]
    return forms


def protected(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities that have a form of their own, none overlapping."""
    found = [(m.start(), m.end(), "link") for m in LINK.finditer(text)] if "://" in text else []
    for m in EMAIL.finditer(text) if _MAIL_SIGN.search(text) else ():
        end = m.end()
        while text[end - 1] in ".-":
            end -= 1
        found.append((m.start(), end, "email"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text)]
    for m in LABELLED.finditer(text):
        number = m.group(1)
        a, b = m.span(1)
        if number[-1].isalpha() and number[-2] == " " and not re.search(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d [A-D]$", number):
            b -= 2  # a word of one letter that follows
        if sum(c.isdigit() for c in number) >= 5:
            found.append((a, b, "id_number"))
    if _CODE_SIGN.search(text):
        found += [(m.start(), m.end(), "id_number") for m in TAX_CODE.finditer(text)]
    for m in ADDRESS.finditer(text):
        end = m.end()
        if text[end - 1] == "." and not text[m.start() : end].lower().endswith(("ул.", "наб.")):
            end -= 1
        found.append((m.start(), end, "address"))
    rank = {"link": -1} | {t: k for k, t in enumerate(TYPES)}
    found.sort(key=lambda x: (x[0], -x[1], rank[x[2]]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def letter_case(word: str, initial: bool) -> str:
    return "I" if initial else "U" if word.isupper() and len(word) > 1 else "C" if word[0].isupper() else "L"


def tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool, bool, bool]]:
    """(start, end, word, initial, joined to the one before, begins a sentence) outside of protected entities."""
    parts, at = [], 0
    for a, b, _ in taken:
        parts += [text[at:a], "\x00" * (b - a)]
        at = b
    masked = "".join(parts) + text[at:]
    out: list[tuple[int, int, str, bool, bool, bool]] = []
    last_end, fresh = -1, True
    for m in WORD.finditer(masked):
        a, b, w = m.start(), m.end(), m.group()
        if last_end >= 0 and len(w) > 2 and masked[last_end:a] == " ":  # the plain case
            out.append((a, b, w, False, True, False))
            last_end = b
            continue
        initial = len(w) <= 2 and w[0].isupper() and masked[b : b + 1] == "." and (len(w) == 1 or w in ("Дж",))
        gap = masked[last_end:a] if last_end >= 0 else "\n"
        joined = last_end >= 0 and (gap.strip(" \t\xa0") == "" and len(gap) <= 3 and (gap != "" or bool(out) and out[-1][3]))
        fresh = last_end < 0 or bool(_BORDER.search(gap)) and not (bool(out) and out[-1][3] and joined)
        end = b + 1 if initial else b
        out.append((a, end, w, initial, joined, fresh))
        last_end = end
    return out


_STREET = re.compile(r"([^\W\d_]+) (?=[^\W\d_]+ (?:көшесі|к-сі|даңғылы|урамы|ур\.))")
_DOC = "id {id}, row long, text string, taken array<struct<a:int,e:int,kind:string>>, terms array<string>"
_PAIR = "term string, left string, right string, n long, low long, caps long, guarded long, alike long"


def parse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts, (id, text): the parsed documents and the co-occurrence of terms, both written.

    Documents have their entities of a form (taken) and distinct terms.  Co-occurrence is (term, left, right, n, low, caps,
    guarded, alike): left and right are the terms a term stands next to; an initial has its dot, "" is nothing or a term that cannot
    matter, as neither of the two is written like a name.  low counts lower case, caps capitals within a sentence, guarded
    sentences with a protected entity, alike those next to a term in the same case.  The term "" has the number of running words.
    """
    doc_schema = _DOC.format(id=dict(docs.dtypes)["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str, str], list[int]] = {}
        total = 0

        def flush() -> pd.DataFrame:
            rows = [(*t, *v) for t, v in seen.items()] + [("", "", "", total, 0, 0, 0, 0)]
            out = pd.DataFrame(rows, columns=["term", "left", "right", "n", "low", "caps", "guarded", "alike"])
            out["taken"] = out["terms"] = out["text"] = out["id"] = None
            return out.assign(what="pair").astype({"id": "object"})

        for b in batches:
            parsed = []
            for text in b["text"]:
                if not text:
                    parsed.append(([], []))
                    continue
                taken = protected(text)
                tok = tokens(text, taken)
                spans = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
                guard, at, g = [], 0, 0
                entities = [a for a, _, kind in taken if kind != "link"]
                for s, e in spans:
                    while g < len(entities) and entities[g] < s:
                        g += 1
                    guard.append(g < len(entities) and entities[g] < e)
                folded = [fold(t[2]) + "." if t[3] else fold(t[2]) for t in tok]
                named = [t[2][0].isupper() or t[3] for t in tok]
                case = [letter_case(t[2], t[3]) for t in tok]
                for k, (a, _, w, initial, joined, fresh) in enumerate(tok):
                    while at < len(spans) and spans[at][1] <= a:
                        at += 1
                    if initial:
                        continue
                    follows = k + 1 < len(tok) and tok[k + 1][4]
                    left = folded[k - 1] if joined and (named[k] or named[k - 1]) else ""
                    right = folded[k + 1] if follows and (named[k] or named[k + 1]) else ""
                    v = seen.setdefault((folded[k], left, right), [0, 0, 0, 0, 0])
                    v[0] += 1
                    v[1] += w[0].islower()
                    v[2] += w[0].isupper() and not fresh and not w[1:].isupper()
                    v[3] += at < len(guard) and guard[at]
                    v[4] += bool(left) and case[k - 1] in (case[k], "I") or bool(right) and case[k + 1] in (case[k], "I")
                    total += 1
                streets = [fold(m.group(1)) for a, e, kind in taken if kind == "address" for m in [_STREET.match(text[a:e])] if m]
                parsed.append(([{"a": a, "e": e, "kind": kind} for a, e, kind in taken], sorted({f for f in folded if f[-1] != "."} | set(streets))))
            docs_out = pd.DataFrame({"id": b["id"], "text": b["text"], "taken": pd.Series([x for x, _ in parsed], index=b.index, dtype=object), "terms": pd.Series([x for _, x in parsed], index=b.index, dtype=object)})
            yield docs_out.assign(term=None, left=None, right=None, n=0, low=0, caps=0, guarded=0, alike=0, what="doc")
            if len(seen) > 300_000:
                yield flush()
                seen, total = {}, 0
        yield flush()

    both = docs.select("id", "text").mapInPandas(run, doc_schema.replace("row long, ", "") + ", " + _PAIR + ", what string")
    kept = written(both.withColumn("row", F.monotonically_increasing_id()), "parsed", by="what")  # the numbers are fixed by writing them
    parsed = kept.where("what = 'doc'").select("row", "id", "text", "taken", "terms")
    sums = kept.where("what = 'pair'").groupBy("term", "left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "low", "caps", "guarded", "alike")])
    return parsed, written(sums.withColumn("place", F.monotonically_increasing_id()), "co-occurrence")


def _forms(words: DataFrame) -> DataFrame:
    """(word, form): the base forms of the column word."""
    forms = F.pandas_udf(lambda w: w.map(base_forms), "array<string>")
    return words.select("word", F.explode(forms("word")).alias("form"))


_PATRONYMIC = f"^(?:{PATRONYMIC.pattern})$"


def _share(count, n, base: float):
    """Pointwise mutual information of a term and what occurs with it, as a share of the most it could be."""
    return F.log2(F.greatest(count, F.lit(0.01)) / n / F.lit(base)) / F.lit(max(1e-9, -math.log2(base)))


def disclosing_terms(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term) that disclose persons, and (term, common, upper, n) of all terms; upper: mostly not in lower case; pairs: the written co-occurrence."""
    terms = written(pairs.where(F.col("term") != "").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "low", "caps", "guarded")]), "terms")
    sums = terms.agg(F.sum("n").alias("n"), F.sum("guarded").alias("guarded")).first()
    if not sums.n:
        return terms.select("term").limit(0), terms.select("term", F.lit(True).alias("common"), F.lit(True).alias("upper"), "n").limit(0)
    rate = lambda count: min(0.5, max(1, count) / sums.n)
    sides = written(
        pairs.where((F.col("left") != "") & ~F.col("left").endswith(".")).select("place", "term", "n", "alike", F.col("left").alias("word")).unionByName(pairs.where((F.col("right") != "") & ~F.col("right").endswith(".")).select("place", "term", "n", "alike", F.col("right").alias("word"))), "sides"
    )
    forms = written(_forms(sides.select("word").distinct()), "neighbours")
    always = pairs.where(F.col("left").endswith(".") | F.col("right").endswith(".") | F.col("left").rlike(_PATRONYMIC) | F.col("right").rlike(_PATRONYMIC)).where(F.col("term") != "").select("place", "term", "n", "alike")

    def judged(known: DataFrame) -> DataFrame:
        near = forms.join(known.select(F.col("term").alias("form")), "form", "left_semi").select("word").distinct()
        places = sides.join(near, "word", "left_semi").select("place", "term", "n", "alike").unionByName(always).distinct()
        found = written(places.groupBy("term").agg(F.sum("n").alias("beside"), F.sum("alike").alias("alike"), F.count(F.lit(1)).alias("neighbours")), "beside")
        base = rate(found.agg(F.sum("beside")).first()[0] or 0)
        rows = terms.join(found, "term", "left").na.fill(0, ["beside", "alike", "neighbours"])
        rare = F.col("alike") >= 0.5 * F.col("n")
        common = (
            ((F.col("low") >= LOWER * F.col("n")) & ~(rare & (F.col("neighbours") <= FEW)))
            | ((F.col("caps") + F.col("low") < CASED * F.col("n")) & ~(rare & (F.col("neighbours") <= ONE)))
            | (F.col("guarded") + F.col("beside") < REVEALED * F.col("n"))
        )
        discloses = ~common & (F.col("low") < LOWER * F.col("n")) & (F.col("neighbours") > 1) & (_share(F.col("beside"), F.col("n"), base) >= DISCLOSURE)
        return written(rows.select("term", "n", common.alias("common"), (F.col("low") < LOWER * F.col("n")).alias("upper"), discloses.alias("discloses")), "judged")

    as_name = (F.col("low") < LOWER * F.col("n")) & (F.col("caps") >= REVEALED * F.col("n"))
    first = terms.where(as_name & (_share(F.col("guarded"), F.col("n"), rate(sums.guarded)) >= FIRST_DISCLOSURE)).select("term")
    known, names = first, first.limit(0)
    while True:
        told = judged(known)
        new = written(told.where("discloses").select("term").join(names, "term", "left_anti"), "new-names")
        if new.isEmpty():
            return names, told.select("term", "common", "upper", "n")
        names = written(names.unionByName(new), "names")
        known = names.unionByName(first).distinct()


def term_kinds(pairs: DataFrame) -> tuple[DataFrame, int]:
    """((term, kind, n), running words): G discloses a person, S is no common word, - is one."""
    names, told = disclosing_terms(pairs)
    # another case of a disclosing term discloses as well, unless it is mostly written in lower case
    words = told.where(~F.col("common") | F.col("upper")).select(F.col("term").alias("word"))
    given = _forms(words).join(names.select(F.col("term").alias("form")), "form", "left_semi").select(F.col("word").alias("term")).distinct().withColumn("given", F.lit(True))
    kind = F.when(F.col("given"), "G").when(F.col("common"), "-").when(F.col("term").rlike(_PATRONYMIC), "G").when(F.length("term") >= 3, "S").otherwise("-")
    kinds = written(told.join(given, "term", "left").select("term", kind.alias("kind"), "n"), "term-kinds")
    return kinds, kinds.agg(F.sum("n")).first()[0] or 0


_RUN = re.compile(r"II?[GS]|[GS]II?|G[GI]{0,2}[GS]|SG[GI]?")


class Detector:
    """kinds: of frequent terms; doc: of the other terms of the document at hand. A term in neither is a common word."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds, self.doc = kinds, {}

    def _kind(self, f: str) -> str:
        return self.kinds.get(f) or self.doc.get(f, "-")

    def _street(self, text: str, a: int, b: int) -> int:
        """Where an address begins: a common word in front of the street's name is none of it."""
        m = _STREET.match(text[a:b])
        return a + m.end() if m and self._kind(fold(m.group(1))) == "-" else a

    @staticmethod
    def _alike(cases: list[str], run: str) -> bool:
        """All capitalised, all in capitals or, without initials, all in lower case."""
        words = {c for c, kind in zip(cases, run) if kind != "I"}
        return len(words) == 1 and not ("I" in run and words == {"L"})

    def names(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        tok = tokens(text, taken)
        kind = []
        for a, b, w, initial, joined, fresh in tok:
            kind.append("I" if initial else self._kind(fold(w)))
        if "G" not in kind and "I" not in kind:
            return []
        case = [letter_case(w, False) for _, _, w, *_ in tok]
        out, k = [], 0
        while k < len(tok):
            n = 1
            while k + n < len(tok) and n < 5 and tok[k + n][4] and kind[k + n] != "-":
                n += 1
            run = "".join(kind[k : k + n]) if kind[k] != "-" else ""
            size = 0
            for length in range(len(run), 1, -1):
                if _RUN.fullmatch(run, 0, length) and self._alike(case[k : k + length], run[:length]):
                    after = k + length
                    if run[0] == "S" and length > 2 and case[k] == "L" and not PATRONYMIC.fullmatch(fold(tok[k + length - 1][2])):
                        continue
                    if run[0] == "S" and run[1] == "G" and run[length - 1] == "G" and length < len(run) and run[length] in "SG" and case[after] == case[k]:
                        continue  # what came first belongs to the sentence, the name begins later
                    size = length
                    break
            if size:
                out.append((tok[k][0], tok[k + size - 1][1], "name"))
                k += size
            else:
                k += 1
        return out

    def entities(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        taken = [(self._street(text, a, b), b, kind) if kind == "address" else (a, b, kind) for a, b, kind in taken]
        return sorted([x for x in taken if x[2] != "link"] + self.names(text, taken))


def sanitised(docs: DataFrame) -> DataFrame:
    """(id, text with placeholders, found array<struct<pii_type, pii_text>>). docs: (id, text)."""
    context = docs.sparkSession.sparkContext
    parsed, pairs = parse(docs)
    kinds, total = term_kinds(pairs)
    often = F.col("n") >= max(1, total * FREQUENT_SHARE)
    frequent = {r.term: r.kind for r in kinds.where(often).toLocalIterator()}  # at most 1 / FREQUENT_SHARE terms
    shared = context.broadcast(frequent)

    @F.pandas_udf("array<string>")
    def rare(terms: pd.Series) -> pd.Series:
        return pd.Series([[t for t in x if t not in shared.value] for x in terms], index=terms.index, dtype=object)

    # terms below FREQUENT_SHARE, so none of them is a hot key; common words need not be told
    told = parsed.select("row", F.explode(rare("terms")).alias("term")).join(kinds.where(~often & (F.col("kind") != "-")).select("term", "kind"), "term")
    rows = parsed.drop("terms").join(told.groupBy("row").agg(F.collect_list(F.struct("term", "kind")).alias("told")), "row", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for b in batches:
            texts, found = [], []
            for text, taken, known in zip(b["text"], b["taken"], b["told"]):
                d.doc = {} if known is None else {x["term"]: x["kind"] for x in known}
                spans = d.entities(text, [(x["a"], x["e"], x["kind"]) for x in taken]) if text else []
                parts, at = [], 0
                for a, e, kind in spans:
                    parts += [text[at:a], f"[{kind.upper()}]"]
                    at = e
                texts.append(None if text is None else "".join(parts) + text[at:])
                found.append([{"pii_type": kind, "pii_text": text[a:e]} for a, e, kind in spans])
            yield pd.DataFrame({"id": b["id"], "text": pd.Series(texts, index=b.index, dtype=object), "found": pd.Series(found, index=b.index, dtype=object)})

    return rows.select("id", "text", "taken", "told").mapInPandas(run, f"id {dict(docs.dtypes)['id']}, text string, found array<struct<pii_type string, pii_text string>>")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", [F.col("doc_id").alias("id"), "text"], spread=True)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitised(_documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.explode("found").alias("f"))
    return rows.select("doc_id", "f.pii_type", "f.pii_text").distinct()


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitised(_documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "text")


QUERIES = {"p10_found": p10_found, "p10_texts": p10_texts}
