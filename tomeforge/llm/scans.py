"""Noise in text from scanned pages: hyphenation, misread characters, running headers, page numbers.

Furniture goes first: lines that hold only a page number; and running headers, which stand beside a page number, in
capitals, repeat at the head of several pages of a book, resemble the book's title or author, or stand alone at the head
of a page.  Chapter headings, list items and codes are lawful.  What is left is joined over line ends; a word split there
is put together unless both parts are words of their own that belong together with a hyphen.

Misread words: every word is linked to the more frequent words from which it differs by at most MOST_EDITS plausible
glyph edits (what recognition takes for what).  Words that such edits connect have one skeleton, in which glyphs that
are taken for each other are one, so the links are a join on skeletons.  Skip-gram vectors are learned on the words of
the scanned pages.  Of the words a rare word is linked to, the one is chosen whose frequency and whose fit with the
vectors of the words around speak most for it; it is what was printed if together they outweigh the word as it stands.

Word counts cover all texts and are exact at every size.  Words that make up at least FREQUENT_SHARE of all running
words, at most 1 / FREQUENT_SHARE of them, have vectors and are broadcast; what is known of all other words reaches
the pages by joins.

Defined results: chunks without a page, null and empty texts have no noise and stay as they are; ties between
replacements go to the more frequent word, then by spelling; repeated rows give one case and repeated repaired rows;
extra columns are ignored; an empty table gives an empty result; texts are handled whole.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.confusables import tidy
from tomeforge.operators.skew import salted_join
from tomeforge.runtime import table, written

# What recognition writes -> what was printed.
GLYPHS = {
    "с": ["е"], "г": ["т"], "п": ["л", "ц"], "н": ["и"], "c": ["e"],
    "0": ["о", "o"], "1": ["l"], "3": ["з"], "4": ["ч"], "5": ["s"], "6": ["б", "b"], "!": ["i"], "|": ["l"],
    "ьт": ["ы"], "пт": ["ш"], "10": ["ю"], "cl": ["d"], "li": ["h"], "rn": ["m"], "vv": ["w"],
}

FREQUENT_SHARE = 1e-5
#: A word never met counts as this share of all running words.
UNSEEN_SHARE = 1e-7
VECTOR, WINDOW, CONTEXT = 16, 3, 3
MOST_EDITS = 2
#: How much speaks for a reading: the binary logarithm of how many times as frequent it is, plus CONTEXT_WEIGHT times the
#: cosine of its vector with those around; from EVIDENCE on it is made.
CONTEXT_WEIGHT, EVIDENCE = 4.0, 6.5
ALIKE = 0.75

PAGE_NUMBER = re.compile(r"^\s*[-—–·\[|]*\s*(?:(?:стр\.?|page|бет|бит)\s*)?\d{1,4}\s*[-—–·\]|]*\s*$", re.IGNORECASE)
_BESIDE = re.compile(r"^\s*\d{1,4}\s{2,}(?=\S*[^\W\d_])|(?<=\S)\s{2,}\d{1,4}\s*$")
_ORNAMENT = re.compile(r"[\s*•·]+$|^[\s*•·]+")
_CHAPTER = re.compile(r"^(?:глава|chapter|часть|part|бөлім|бүлек|тарау)\s+\d+|^\d+\s*(?:-\s*тарау|нче\s+бүлек|-\s*бөлім)", re.IGNORECASE)
_LINE = re.compile(r"\r?\n")
_SPLIT = re.compile(r"([^\W\d_]+)(-|¬|\xad)[ \t]*\n[ \t]*([^\W\d_]+)")
WORD = re.compile(r"[!|]?[^\W_]+(?:[!|]+[^\W_]+)*\|?")
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def counted_words(text: str, scanned: bool) -> list[str]:
    """The whole words of a text; the halves at line ends and tokens with digits or signs are no evidence."""
    if scanned:
        text = _SPLIT.sub(" ", text.replace("\r\n", "\n"))
    return _LETTERS.findall(text.lower())


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) over all texts, counted per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text, page in zip(b["raw_text"], b["page"].notna()):
                if text:
                    seen.update(counted_words(text, page))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": object, "n": "int64"})

    return chunks.select("raw_text", "page").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _skeleton_rules() -> tuple[list[tuple[str, str]], dict[int, str]]:
    """What is printed as one glyph but read as several, written out; and of glyphs taken for each other the first."""
    several = [(right, wrong) for wrong, rights in GLYPHS.items() for right in rights if len(wrong) > 1]
    leader: dict[str, str] = {}

    def top(c: str) -> str:
        while leader.get(c, c) != c:
            c = leader[c]
        return c

    for wrong, rights in GLYPHS.items():
        for right in rights if len(wrong) == 1 else ():
            leader[top(right)] = top(wrong)
    return several, str.maketrans({c: top(c) for c in leader})


_SEVERAL, _LEADERS = _skeleton_rules()


def skeleton(word: str) -> str:
    """Equal for any two words of which one is read from the other by glyph edits."""
    for right, wrong in _SEVERAL:
        word = word.replace(right, wrong)
    return word.translate(_LEADERS)


def glyph_edits(word: str, printed: str, most: int = MOST_EDITS) -> int | None:
    """How many glyph edits turn a printed word into the word as read; None if more than `most` or if none can."""
    reached = {(0, 0): 0}
    best = None
    while reached:
        after: dict[tuple[int, int], int] = {}
        for (i, j), n in reached.items():
            if i == len(word) and j == len(printed):
                best = n if best is None else min(best, n)
                continue
            steps = [(i + 1, j + 1, n)] if i < len(word) and j < len(printed) and word[i] == printed[j] else []
            if n < most:
                for wrong, rights in GLYPHS.items():
                    if word.startswith(wrong, i):
                        steps += [(i + len(wrong), j + len(right), n + 1) for right in rights if printed.startswith(right, j)]
            for x, y, m in steps:
                if after.get((x, y), most + 1) > m:
                    after[x, y] = m
        reached = after
    return best


def readings(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, options array<struct<printed, n, edits>>) of words: their count and the more frequent words they may be misread from."""
    frame = F.pandas_udf(lambda w: w.map(skeleton), "string")
    own = words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    # a reading needs two letters
    open_words = own.where(F.regexp_count("word", F.lit(r"\p{L}")) >= 2).withColumn("skeleton", frame("word"))
    linked = open_words.join(counts.select(F.col("word").alias("printed"), F.col("n").alias("m"), frame("word").alias("skeleton")), "skeleton").where((F.col("m") > F.col("n")) & (F.col("word") != F.col("printed")))

    @F.pandas_udf("int")
    def edits(word: pd.Series, printed: pd.Series) -> pd.Series:
        return pd.Series([glyph_edits(w, p) for w, p in zip(word, printed)], index=word.index, dtype="Int32")

    found = linked.withColumn("edits", edits("word", "printed")).where("edits > 0").groupBy("word").agg(F.collect_list(F.struct("printed", F.col("m").alias("n"), "edits")).alias("options"))
    return own.join(found, "word", "left")


def skip_grams(sentences: DataFrame, total: int) -> dict[str, np.ndarray]:
    """Unit vectors of the frequent words of scanned pages, at most 1 / FREQUENT_SHARE. sentences: a written table of (letters)."""
    least = max(2, int(total * FREQUENT_SHARE))
    words = sentences.where(F.size("letters") > 0).select("letters")
    model = Word2Vec(vectorSize=VECTOR, windowSize=WINDOW, minCount=least, maxIter=1, seed=17, inputCol="letters", outputCol="v", stepSize=0.05, numPartitions=sentences.sparkSession.sparkContext.defaultParallelism)
    try:
        vectors = model.fit(words).getVectors().collect()  # at most 1 / FREQUENT_SHARE rows
    except Exception as e:  # noqa: BLE001 - no word is frequent enough
        if "vocab" not in str(e).lower():
            raise
        return {}
    out = {}
    for r in vectors:
        v = np.asarray(r.vector.toArray(), np.float32)
        out[r.word] = v / max(1e-9, float(np.linalg.norm(v)))
    return out


class Reader:
    """Finds what a misread word was printed as. known: word -> (n, [(printed, n, edits), ...]) of the words asked for."""

    def __init__(self, known: dict[str, tuple[int, list]], vectors: dict[str, np.ndarray], total: int):
        self.known, self.vectors, self.unseen = known, vectors, max(1e-9, total * UNSEEN_SHARE)
        self.page: dict[str, tuple[int, list]] = {}  # what is known of the page's own rare words

    def count(self, word: str) -> int:
        return (self.known.get(word) or self.page.get(word) or (0,))[0]

    def read(self, words: list[str], k: int) -> str | None:
        """The printed form of words[k] if it is misread."""
        n, options = self.known.get(words[k]) or self.page.get(words[k]) or (0, ())
        if not options:
            return None
        near = [self.vectors[w] for w in words[max(0, k - CONTEXT) : k] + words[k + 1 : k + 1 + CONTEXT] if w in self.vectors]
        context = np.mean(near, axis=0) if near else None
        size = float(np.linalg.norm(context)) or 1.0 if near else 1.0
        scored = []
        for printed, m, edits in options:
            fit = float(self.vectors[printed] @ context) / size if near and printed in self.vectors else 0.0
            scored.append((np.log2(m / (n + self.unseen)) + CONTEXT_WEIGHT * fit - edits, m, printed))
        best = min(scored, key=lambda x: (-x[0], -x[1], x[2]))
        return best[2] if best[0] >= EVIDENCE else None


def _plain(line: str) -> str:
    return " ".join(_LETTERS.findall(line.lower()))


def line_candidates(text: str) -> list[tuple[int, str, str, bool, bool, bool]]:
    """(line number, plain text, key, certain, at head, alone) of the lines that could be running headers."""
    lines = _LINE.split(text)
    content = [bool(x.strip()) and not PAGE_NUMBER.match(x) for x in lines]
    widest = max((len(x) for x in lines), default=0)
    out = []
    for k, line in enumerate(lines):
        if not content[k]:
            continue
        core = _BESIDE.sub("", line.strip())
        beside = core != line.strip()
        core = _ORNAMENT.sub("", core).strip()
        if not 3 <= len(core) <= 120 or not _LETTERS.search(core) or _CHAPTER.match(core) or re.search(r"[.!?…,;:—¬\xad-]$", core) and not beside:
            continue
        if not (core[0].isupper() or core[0].isdigit() or core[0] in "«\"") or re.match(r"\d+\)", core):
            continue
        before = next((lines[j] for j in range(k - 1, -1, -1) if content[j]), "")
        after = next((lines[j] for j in range(k + 1, len(lines)) if content[j]), "")
        caps = core.upper() == core and len(_LETTERS.findall(core)) > 0 and sum(c.isalpha() for c in core) > 3
        caps = caps and not any(re.search(r"[^\W\d_a-zа-яё]{4,}\W*$|^\W*[^\W\d_a-zа-яё]{4,}", x) and x.upper() == x for x in (before, after))
        head = not any(content[:k]) or k > 0 and bool(PAGE_NUMBER.match(lines[k - 1])) or k + 1 < len(lines) and bool(PAGE_NUMBER.match(lines[k + 1]))
        follows = after.strip()[:1]
        alone = not any(content[:k]) and len(core) < 0.75 * widest and bool(follows) and (follows.isupper() or follows.isdigit() or follows in "«\"")
        plain = _plain(core)
        key = "".join(w[0] for w in plain.split()) + str(len(plain.split()))
        out.append((k, plain, key, beside or caps, head, alone))
    return out


def header_lines(scanned: DataFrame, books: DataFrame) -> DataFrame:
    """(id, header array<int>): the numbers of the lines that are running headers."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, book, *x) for i, book, t in zip(b["id"], b["book_id"], b["raw_text"]) if t for x in line_candidates(tidy(t))]
            yield pd.DataFrame(rows, columns=["id", "book_id", "line", "plain", "key", "certain", "head", "alone"]).astype({"id": "int64", "book_id": "Int64", "certain": bool, "head": bool, "alone": bool})

    found = written(scanned.select("id", "book_id", "raw_text").mapInPandas(lines, "id long, book_id long, line int, plain string, key string, certain boolean, head boolean, alone boolean"), "lines")
    # an inventory of keys per book, not of lines: a hot book stays one row per key
    again = found.groupBy("book_id", "key").agg(F.approx_count_distinct("id").alias("pages"), F.max("head").alias("seen_at_head"), F.count(F.lit(1)).alias("n"))
    again = again.where((F.col("pages") > 1) & F.col("seen_at_head") & (F.col("n") > 1)).select("book_id", "key", F.lit(True).alias("again"))
    named = books.select(F.col("id").alias("book_id"), "title", "author")

    @F.pandas_udf("boolean")
    def alike(plain: pd.Series, title: pd.Series, author: pd.Series) -> pd.Series:
        out = []
        for p, t, a in zip(plain, title, author):
            t, a = _plain(t or ""), _plain(a or "")
            both = sorted((a + " " + t).split())
            out.append(any(x and difflib.SequenceMatcher(None, p, x, autojunk=False).ratio() >= ALIKE for x in (t, a, f"{a} {t}")) or len(p.split()) > 1 and (sorted(p.split()) == sorted(t.split()) or sorted(p.split()) == both))
        return pd.Series(out, index=plain.index)

    # one book, and one header in it, may be that of very many pages
    rows = salted_join(salted_join(found, again, ["book_id", "key"], "left"), named, ["book_id"], "left")
    header = rows.where(F.col("certain") | F.col("alone") | F.coalesce("again", F.lit(False)) | alike("plain", "title", "author"))
    return header.groupBy("id").agg(F.collect_set("line").alias("header"))


def body(text: str, header: set[int]) -> tuple[str, set[str]]:
    """(the text without furniture, split words put together where that is certain; kinds of noise that were in it)."""
    kinds: set[str] = set()
    kept = []
    for k, line in enumerate(_LINE.split(text)):
        if k in header:
            kinds.add("header")
            if _BESIDE.search(line.strip()):
                kinds.add("page_number")
        elif line.strip() and PAGE_NUMBER.match(line):
            kinds.add("page_number")
        else:
            kept.append(line)

    def together(m: re.Match) -> str:
        left, sign, right = m.groups()
        if sign != "-":
            kinds.add("hyphenation")
            return left + right
        return m.group() if right[0].islower() else f"{left}-{right}"

    joined = "\n".join(kept)
    for _ in range(2):  # a short piece can end one split and begin the next
        joined = _SPLIT.sub(together, joined)
    return joined, kinds


def flow(joined: str) -> str:
    """Paragraphs: single line ends are blanks, but before a list item."""
    return re.sub(r"[ \t]*\n(?!\s*\n)(?<!\n\n)[ \t]*(?!\d+\)|[-*•] )", " ", joined)


def asked(joined: str) -> set[str]:
    """The words whose counts and readings the repair of a body may need."""
    words = set(words_of(joined))
    for m in _SPLIT.finditer(joined):
        left, right = m.group(1).lower(), m.group(3).lower()
        words |= {left, right, left + right}
    return words


def repair(joined: str, kinds: set[str], reader: Reader) -> tuple[str, set[str]]:
    """(the text in paragraphs, kinds of noise that were in it) of a body."""
    kinds = set(kinds)

    def together(m: re.Match) -> str:
        left, _, right = m.groups()
        whole, one, two = (reader.count(x.lower()) for x in (left + right, left, right))
        if min(one, two) > whole:  # words of their own, more often than together
            return f"{left}-{right}"
        kinds.add("hyphenation")
        return left + right

    for _ in range(2):
        joined = _SPLIT.sub(together, joined)
    flowing = flow(joined)
    spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(flowing)]
    words = [w.lower() for _, _, w in spans]
    pieces, at = [], 0
    for k, (a, b, word) in enumerate(spans):
        printed = reader.read(words, k)
        if printed is None:
            continue
        kinds.add("misread")
        if word.isupper() and len(word) > 1:
            printed = printed.upper()
        elif word[:1].isupper():
            printed = printed[:1].upper() + printed[1:]
        pieces += [flowing[at:a], printed]
        at = b
    return "".join(pieces) + flowing[at:], kinds


def repaired(chunks: DataFrame, books: DataFrame, use_vectors: bool = True) -> DataFrame:
    """(id, text, noise array<string>) of the chunks that have a page. use_vectors: off only to measure what they do."""
    context = chunks.sparkSession.sparkContext
    scanned = chunks.where(F.col("page").isNotNull()).select("id", "book_id", "raw_text")
    counts = written(word_counts(chunks), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1, total * FREQUENT_SHARE)
    frequent = {r.word for r in counts.where(often).select("word").toLocalIterator()}  # at most 1 / FREQUENT_SHARE words
    common = context.broadcast(frequent)

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, header in zip(b["raw_text"], b["header"]):
                joined, kinds = body(tidy(text), set() if header is None else set(header.tolist())) if text else (text, set())
                rows.append((joined, sorted(kinds), _LETTERS.findall(_SPLIT.sub(" ", joined).lower()) if joined else [], sorted(asked(joined) - common.value) if joined else []))
            yield pd.DataFrame({"id": b["id"]} | {c: pd.Series([r[k] for r in rows], index=b.index, dtype=object) for k, c in enumerate(("body", "kinds", "letters", "rare"))})

    headed = scanned.join(header_lines(scanned, books), "id", "left")
    made = headed.mapInPandas(bodies, "id long, body string, kinds array<string>, letters array<string>, rare array<string>")
    table_of_bodies = written(made.withColumn("row", F.monotonically_increasing_id()), "bodies")  # the numbers are fixed by writing them
    vectors = skip_grams(table_of_bodies, total) if use_vectors else {}
    wanted = table_of_bodies.select("row", F.explode("rare").alias("word"))
    told = written(readings(wanted.select("word").unionByName(counts.where(often).select("word")).distinct(), counts), "readings")
    of_frequent = {r.word: (r.n, [tuple(o) for o in r.options or ()]) for r in told.where(often).toLocalIterator()}  # at most 1 / FREQUENT_SHARE rows
    shared = context.broadcast((of_frequent, vectors, total))
    # words below FREQUENT_SHARE, so none of them is a hot key
    useful = told.where(~often & (F.col("options").isNotNull() | (F.col("n") > 0)))
    per_page = wanted.join(useful, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "options")).alias("words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for b in batches:
            texts, kinds = [], []
            for joined, known, words in zip(b["body"], b["kinds"], b["words"]):
                reader.page = {} if words is None else {w["word"]: (w["n"], [(o["printed"], o["n"], o["edits"]) for o in w["options"]] if w["options"] is not None else []) for w in words}
                t, k = repair(joined, set(known.tolist()), reader) if joined else (joined, set())
                texts.append(t)
                kinds.append(sorted(k))
            yield pd.DataFrame({"id": b["id"], "text": pd.Series(texts, index=b.index, dtype=object), "noise": pd.Series(kinds, index=b.index, dtype=object)})

    rows = table_of_bodies.select("row", "id", "body", "kinds").join(per_page, "row", "left")
    return rows.mapInPandas(run, "id long, text string, noise array<string>")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "chunks", ["id", "book_id", "raw_text", "page"], spread=True), table(spark, sf_dir, "books", ["id", "title", "author"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(*_tables(spark, sf_dir)).select(F.col("id").alias("chunk_id"), F.explode("noise").alias("noise")).distinct()


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(*_tables(spark, sf_dir)).select(F.col("id").alias("chunk_id"), "text")


QUERIES = {"p7_found": p7_found, "p7_texts": p7_texts}
