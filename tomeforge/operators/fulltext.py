"""Keyword retrieval: two-column matching, BM25, phrases, snippets; over text columns or an index of postings."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions.text import LATIN_ACCENTS, TERM, tokens
from tomeforge.operators.filters import clamp_limit
from tomeforge.operators.versions import Versions

K1, B = 1.2, 0.75
RAW_WEIGHT, LEMMA_WEIGHT = 1.5, 1.0
SNIPPET_TOKENS = 32


def query_terms(query: str) -> list[str]:
    text = query.lower().replace("ё", "е")
    return [t.translate(str.maketrans(*LATIN_ACCENTS)) for t in re.findall(r"[^\W]+", text) if re.match(TERM, t)]


def _joined(tok: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tok, "  "), F.lit(" "))


def _occurrences(joined: Column, phrase: list[str]) -> Column:
    """How often the words stand side by side, overlaps included; terms are letters and digits only."""
    return F.regexp_count(joined, F.lit(f"(?= {'  '.join(phrase)} )"))


def _score(n: float, avgdl: Column | float, counts: list[tuple[Column, float, float]], dl: Column) -> Column:
    """Negative BM25 of the (occurrences, idf, weight) of one row."""
    total = F.lit(0.0)
    for tf, idf, weight in counts:
        f = tf * F.lit(weight)
        total = total + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))
    return -total


def inverse_frequency(n: int, hits: int) -> float:
    value = math.log((n - hits + 0.5) / (hits + 0.5))
    return value if value > 0 else 1e-6


def rank_chunks(chunks: DataFrame, raw_terms: list[str], lemma_terms: list[str], phrase: bool = False) -> DataFrame:
    """(id, rank): chunks that match all raw terms in raw_text or all lemma terms in lemma_text, lower rank is better.

    One scan for the corpus statistics (a single row), one for the ranks; no shuffle of the texts.
    """
    raw_phrases = [raw_terms] if phrase else [[t] for t in raw_terms]
    lemma_phrases = [lemma_terms] if phrase else [[t] for t in lemma_terms]
    columns = [("r", p) for p in raw_phrases if p] + [("l", p) for p in lemma_phrases if p]
    # a generator keeps the optimiser from repeating the tokenising in every expression that reads the tokens
    both = F.struct(_joined(tokens(F.col("raw_text"))).alias("r"), _joined(tokens(F.col("lemma_text"))).alias("l"))
    base = chunks.select("id", F.explode(F.array(both)).alias("t")).select("id", "t.r", "t.l")
    # tokens have no blanks, so every pair of blanks is a border
    length = lambda c: F.when(F.length(c) <= 2, 0).otherwise(F.regexp_count(F.col(c), F.lit("  ")) + 1)
    counted = base.select("id", (length("r") + length("l")).alias("dl"), *[_occurrences(F.col(c), p).alias(f"o{i}") for i, (c, p) in enumerate(columns)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(f"o{i}") > 0).alias(f"h{i}") for i in range(len(columns))]).first()
    return _ranked(counted, [c for c, _ in columns], stats.n, stats.total, [stats[f"h{i}"] for i in range(len(columns))])


def _ranked(counted: DataFrame, sides: list[str], n: int, total: int | None, hits: list[int]) -> DataFrame:
    """(id, rank) of (id, dl, o0, o1, ...), the occurrences of phrases on their sides (r or l), of which hits rows have any."""
    if not sides or not n or not total:
        return counted.where(F.lit(False)).select("id", F.lit(0.0).alias("rank"))
    parts, matched = [], F.lit(False)
    for side, weight in (("r", RAW_WEIGHT), ("l", LEMMA_WEIGHT)):
        own = [i for i, c in enumerate(sides) if c == side]
        if not own:
            continue
        hit = F.lit(True)
        for i in own:
            hit = hit & (F.col(f"o{i}") > 0)
        matched = matched | hit
        parts.append(F.when(hit, _score(n, F.lit(total / n), [(F.col(f"o{i}"), inverse_frequency(n, hits[i]), weight) for i in own], F.col("dl"))).otherwise(0.0))
    return counted.where(matched).select("id", sum(parts[1:], parts[0]).alias("rank"))


def search_text(chunks: DataFrame, books: DataFrame, query: str, limit: int = 10, phrase: bool = False, lemma_query: str | None = None, excerpt: bool = True, index: TextIndex | None = None) -> DataFrame:
    """Top hits with their metadata. books: already filtered. A blank query has no hits. index: read instead of the texts."""
    terms = query_terms(query)
    lemmas = query_terms(lemma_query) if lemma_query is not None else terms
    allowed = chunks.join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    ranked = index.rank(terms, lemmas, phrase) if index else rank_chunks(chunks, terms, lemmas, phrase)
    top = ranked.join(allowed.select("id"), "id", "left_semi").orderBy("rank", "id").limit(clamp_limit(limit))
    hits = chunks.join(F.broadcast(top), "id")  # at most 100 rows
    meta = books.select(F.col("id").alias("book_id"), "source_path", "title", "author", "format_name")
    out = hits.join(meta, "book_id").withColumnRenamed("id", "chunk_id")
    text = snippet(F.col("raw_text"), terms, phrase) if excerpt and terms else F.col("raw_text")
    return out.withColumn("excerpt", text).orderBy("rank", "chunk_id")


def snippet(text: Column, terms: list[str], phrase: bool = False) -> Column:
    """The best SNIPPET_TOKENS tokens with hits in « »; only ever applied to the few rows of a result."""
    want = list(terms)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet_of(t, want, phrase))

    return cut(text)


def snippet_of(text: str, terms: list[str], phrase: bool = False) -> str:
    spans = [(m.start(), m.end(), m.group().lower().replace("ё", "е").translate(str.maketrans(*LATIN_ACCENTS))) for m in re.finditer(r"\w+", text)]
    words = [w for _, _, w in spans]
    marks: list[tuple[int, int]] = []
    if phrase and terms:
        k = 0
        while k + len(terms) <= len(words):
            if words[k : k + len(terms)] == terms:
                marks.append((k, k + len(terms) - 1))
                k += len(terms)
            else:
                k += 1
    else:
        marks = [(k, k) for k, w in enumerate(words) if w in set(terms)]
    best, start = -1, 0
    for k in [0] + [max(0, min(a - SNIPPET_TOKENS // 2, len(words) - SNIPPET_TOKENS)) for a, _ in marks]:
        inside = sum(k <= a and b < k + SNIPPET_TOKENS for a, b in marks)
        if inside > best:
            best, start = inside, k
    stop = min(len(words), start + SNIPPET_TOKENS)
    out, at = [], spans[start][0] if spans and start else 0
    for a, b in marks:
        if start <= a and b < stop:
            out += [text[at : spans[a][0]], "«", text[spans[a][0] : spans[b][1]], "»"]
            at = spans[b][1]
    end = spans[stop - 1][1] if stop < len(words) else len(text)
    body = "".join(out) + text[at:end]
    return (" … " if start else "") + body + (" … " if stop < len(words) else "")


def build_postings(chunks: DataFrame) -> DataFrame:
    """(token, col, chunk_id, tf, positions, dl): the inverted index; made row by row, nothing is shuffled."""
    sides = {"raw": tokens(F.col("raw_text")), "lemma": tokens(F.col("lemma_text"))}
    # generators keep the optimiser from repeating the tokenising in every expression that reads the tokens
    base = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array(F.struct(*[t.alias(c) for c, t in sides.items()]))).alias("t")).select("chunk_id", "t.raw", "t.lemma")
    both = base.select("chunk_id", (F.size("raw") + F.size("lemma")).alias("dl"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("words")) for c in sides])).alias("s")).select("chunk_id", "dl", "s.col", "s.words")
    # positions in order of token and place, so each token's own are neighbours
    placed = both.select("chunk_id", "dl", "col", F.explode(F.array(F.array_sort(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).alias("p"))
    starts = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["w"] != F.get("p", i - 1)["w"]))
    cut = placed.where(F.size("p") > 0).select("chunk_id", "dl", "col", "p", F.explode(F.array(starts)).alias("starts"))
    runs = cut.select("chunk_id", "dl", "col", "p", F.explode(F.transform("starts", lambda s, k: F.struct(s.alias("at"), (F.coalesce(F.get("starts", k + 1), F.size("p")) - s).alias("n")))).alias("r"))
    own = F.slice("p", F.col("r.at") + 1, F.col("r.n"))
    return runs.select(F.get("p", F.col("r.at"))["w"].alias("token"), "col", "chunk_id", F.col("r.n").cast("int").alias("tf"), F.transform(own, lambda x: x["i"]).alias("positions"), "dl")


POSTINGS = "token string, col string, chunk_id long, tf int, positions array<int>, dl int, bucket int"


class TextIndex(Versions):
    """A stored index: postings in folders of token buckets, sorted by token, and the two numbers a rank needs of the corpus.

    A query reads the row groups of its own terms. A new version replaces the old one in one step.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path)
        self.buckets = buckets

    def _store(self, postings: DataFrame, folder: str, buckets: int) -> None:
        # a frequent token's rows are spread over several files of its bucket
        spread = F.pmod(F.xxhash64("chunk_id"), F.lit(8))
        postings.repartition(2 * buckets, "bucket", spread).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(folder)

    def build(self, chunks: DataFrame) -> TextIndex:
        """Index (id, raw_text, lemma_text) as a new version."""
        before, folder = self.current(), self.new_folder()
        self._store(build_postings(chunks).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")), folder, self.buckets)
        stats = self._read(folder).agg(F.sum("tf").alias("total")).first()
        self.publish(before, {"folder": folder, "buckets": self.buckets, "n": chunks.count(), "total": stats.total or 0})
        return self

    def optimize(self) -> None:
        """Rewrite the current version into few sorted files, as a version of its own."""
        state, folder = self.current(), self.new_folder()
        self._store(self._read(state["folder"]), folder, state["buckets"])
        self.publish(state, state | {"folder": folder})

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(folder)

    def postings(self) -> DataFrame:
        return self._read(self.current()["folder"])

    def rank(self, raw_terms: list[str], lemma_terms: list[str], phrase: bool = False) -> DataFrame:
        """(id, rank) as rank_chunks() gives it."""
        state = self.current()
        if state is None:
            raise RuntimeError("there is no text index")
        phrases = [("r", p) for p in ([raw_terms] if phrase else [[t] for t in raw_terms]) if p] + [("l", p) for p in ([lemma_terms] if phrase else [[t] for t in lemma_terms]) if p]
        wanted = sorted({t for _, p in phrases for t in p})
        rows = self._read(state["folder"])
        buckets = sorted({r.b for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(state["buckets"])).cast("int").alias("b")).collect()})
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(wanted)) if wanted else rows.where(F.lit(False))
        places = {(side, t): f"p{k}" for k, (side, t) in enumerate(sorted({(side, t) for side, p in phrases for t in p}))}
        none = F.array().cast("array<int>")
        named = {"r": "raw", "l": "lemma"}
        per = rows.groupBy("chunk_id", "dl").agg(F.lit(1).alias("_"), *[F.first(F.when((F.col("col") == named[side]) & (F.col("token") == t), F.col("positions")), ignorenulls=True).alias(c) for (side, t), c in places.items()])

        def occurrences(side: str, p: list[str]):
            first = F.coalesce(places[side, p[0]], none)
            if len(p) == 1:
                return F.size(first)
            follows = lambda x: reduce(and_, [F.array_contains(F.coalesce(places[side, w], none), x + j) for j, w in enumerate(p[1:], 1)])
            return F.size(F.filter(first, follows))

        counted = per.select(F.col("chunk_id").alias("id"), "dl", *[occurrences(side, p).alias(f"o{i}") for i, (side, p) in enumerate(phrases)])
        hits = counted.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"o{i}") > 0).alias(f"h{i}") for i in range(len(phrases))]).first()
        return _ranked(counted, [side for side, _ in phrases], state["n"], state["total"], list(hits)[1:])
