"""Missing or wrong language labels: sparse multinomial logistic regression on TF-IDF character n-grams.

The classifier is trained here on all sentences of a sample of the chunks whose book has a label that names one
language: about SAMPLE_CHUNKS of them at every size, those with the least 64-bit hash of their id.  Features are hashed character n-grams of 1 to GRAMS
letters with TF-IDF weights; training is follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so
most weights are exactly zero).  Labels are noisy: two models, each trained on half of the sampled chunks, judge the
other half; chunks most of whose text contradicts their label and single sentences that do so are dropped, and the
final model is trained on the rest.  On held-out sentences one temperature is fitted that calibrates the confidences.  All chunks are then
cut into sentences; sentences too short or too unsure to tell take the language around them; neighbouring sentences
of one language form a segment.

Defined results: without any labelled text nothing can be learned and no text has a segment; a text without letters has no segment and no language; a book without any such text keeps none;
ties of a book's majority go to the language with more letters, then by code; null texts count as empty; repeated rows
count as often as they occur; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm.confusables import tidy
from tomeforge.runtime import table, written

LANGUAGES = ["en", "kk", "ru", "tt"]
# Notations of the languages.
NOTATIONS = {
    "en": ["en", "eng", "english", "английский", "ағылшын", "инглиз", "инглизчә"],
    "kk": ["kk", "kaz", "kazakh", "қазақша", "қазақ", "казахский"],
    "ru": ["ru", "rus", "russian", "русский", "орыс", "орысша", "рус", "русча"],
    "tt": ["tt", "tat", "tatar", "татарча", "татар", "татарский"],
}

SAMPLE_CHUNKS = 6000
GRAMS = 3
BUCKETS = 1 << 17
EPOCHS = 3
BATCH = 64
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.001
#: A sentence speaks for itself from so many letters, words and so much calibrated confidence on; less is a heading, a name, a code.
LEAST_LETTERS = 30
LEAST_WORDS = 5
LEAST_CONFIDENCE = 0.9

_BREAK = re.compile(r"(?<=[.!?…])[»\")]*\s+(?=[^\W_]|[«\"(\d])|\s*\n\s*(?=\d+\)|[-*•—] )|(?<=[.!?…:»)])\s*\n\s*")
_NOISE = re.compile(r"[\W\d_]+")
_QUOTED = re.compile(r"\(?«[^»]*»\)?")


def label_language(col):
    """The language a label names, in any notation; null if it names none or several."""
    plain = F.lower(F.trim(col))
    base = F.element_at(F.split(plain, "[-_]"), 1)
    out = None
    for lang, names in NOTATIONS.items():
        test = plain.isin(names) | base.isin(names[:2])
        out = F.when(test, lang) if out is None else out.when(test, lang)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; wrapped lines belong together, list items do not."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def plain(sentence: str) -> str:
    """Lower-case letters with single blanks; a quoted title is left out if something remains."""
    bare = _QUOTED.sub(" ", sentence)
    words = _NOISE.sub(" ", bare.lower()).strip()
    return words if len(words) >= 12 else _NOISE.sub(" ", sentence.lower()).strip()


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, number of the text it belongs to)."""
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    ids, own = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(codes) - n + 1] if n > 1 else h
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        inside = owner[: len(h)] == owner[n - 1 :]
        ids.append(((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(47)).astype(np.int64) % BUCKETS)
        own.append(owner[: len(h)][inside])
    return np.concatenate(ids), np.concatenate(own)


def logits(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """texts x languages; weights: buckets x languages with the inverse document frequency multiplied in."""
    out = np.zeros((len(texts), weights.shape[1]))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < 100_000 or stop == at):
            size += len(texts[stop]) + 2
            stop += 1
        ids, own = gram_ids(texts[at:stop])
        count = np.bincount(own, minlength=stop - at)
        w = weights[ids]
        for j in range(weights.shape[1]):
            out[at:stop, j] = np.bincount(own, weights=w[:, j], minlength=stop - at)
        out[at:stop] /= np.sqrt(np.maximum(1, count))[:, None]
        at = stop
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights (buckets x languages) by follow-the-regularised-leader."""
    k = len(LANGUAGES)
    ids, own = gram_ids(texts)
    pair = np.sort(own.astype(np.int64) * BUCKETS + ids)  # sorting is faster here than hashing
    df = np.bincount(pair[np.append(True, pair[1:] != pair[:-1])] % BUCKETS, minlength=BUCKETS)  # documents a bucket occurs in
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    first = np.searchsorted(np.sort(own, kind="stable"), np.arange(len(texts) + 1))
    by_text = np.argsort(own, kind="stable")
    ids = ids[by_text]
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    rng = np.random.default_rng(seed)

    def value(zz, nn):
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            spans = [ids[first[i] : first[i + 1]] for i in batch]
            owner = np.repeat(np.arange(len(batch)), [len(x) for x in spans])
            flat = np.concatenate(spans)
            scale = np.array([1 / np.sqrt(max(1, len(x))) for x in spans])
            used, place = np.unique(flat, return_inverse=True)
            w = value(z[used], n[used])
            x = idf[flat] * scale[owner]
            score = np.stack([np.bincount(owner, weights=w[place, j] * x, minlength=len(batch)) for j in range(k)], axis=1)
            miss = softmax(score)
            miss[np.arange(len(batch)), labels[batch]] -= 1
            g = np.stack([np.bincount(place, weights=miss[owner, j] * x, minlength=len(used)) for j in range(k)], axis=1)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w
            n[used] += g * g
    return (value(z, n) * idf[:, None]).astype(np.float32)


def temperature(score: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes held-out labels most likely.

    Some labels are wrong (a foreign sentence in a labelled chunk): a share of them, fitted along, is taken as drawn at
    random, so that they do not pass for errors of the classifier.
    """
    k = score.shape[1]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 120):
        p = softmax(score / t)[np.arange(len(labels)), labels]
        for wrong in (0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3):
            loss = -np.log((1 - wrong) * p + wrong / k).mean()
            if loss < best[0] - 1e-12:
                best = (loss, float(t))
    return best[1]


def fit(texts: list[str], labels: list[str], groups: list) -> tuple[np.ndarray, float]:
    """(weights, temperature) from sentences of labelled groups (chunks), some of whose labels are wrong."""
    k = len(LANGUAGES)
    y = np.array([LANGUAGES.index(x) for x in labels], np.int64)
    if not len(y):
        return np.zeros((BUCKETS, k), np.float32), 1.0
    group = np.unique(np.array(groups), return_inverse=True)[1]
    half = group % 2 == 0
    p = np.full((len(y), k), 1 / k)
    if 0 < half.sum() < len(y):
        for own in (half, ~half):
            p[~own] = softmax(logits([t for t, o in zip(texts, ~own) if o], train([t for t, o in zip(texts, own) if o], y[own])))
        mass = np.zeros((group.max() + 1, k))
        np.add.at(mass, group, p * np.array([len(t) for t in texts])[:, None])
        confirmed = mass[group].argmax(axis=1) == y
        trusted = confirmed & (p.argmax(axis=1) == y)
    else:
        confirmed = trusted = np.ones(len(y), bool)
    held = group % 5 == 0
    use = trusted & ~held if (trusted & ~held).any() else np.ones(len(y), bool)
    w = train([t for t, u in zip(texts, use) if u], y[use])
    # sentences of chunks whose label the other half's model confirms, whatever it makes of the single sentence
    check = held & confirmed
    t = temperature(logits([x for x, c in zip(texts, check) if c], w), y[check]) if check.any() else 1.0
    return w, t


def sample_bound(total: int, limit: int = SAMPLE_CHUNKS) -> int | None:
    """The 64-bit hash below which about `limit` of `total` ids lie; None if all are to be taken."""
    return None if total <= limit else -(1 << 63) + (limit << 64) // total


def fit_on_sample(chunks: DataFrame, books: DataFrame, limit: int = SAMPLE_CHUNKS) -> tuple[np.ndarray, float] | None:
    """(weights, temperature); None if no text has a label to learn from. The chunks of the sample are used whole."""
    labelled = books.select(F.col("id").alias("book_id"), label_language(F.col("language")).alias("language")).where(F.col("language").isNotNull())
    usable = chunks.where(F.col("raw_text").isNotNull()).join(labelled, "book_id")
    bound = sample_bound(usable.count(), limit)
    rank = F.xxhash64("id")
    picked = usable.where(rank < F.lit(bound)) if bound is not None else usable
    rows = picked.select("id", "raw_text", "language").orderBy(rank, "id").limit(2 * limit).collect()  # about `limit` rows, at most twice as many
    if bound is not None and not rows:
        raise RuntimeError("the sample of labelled chunks is empty")
    texts, labels, groups = [], [], []
    for r in rows:
        t = tidy(r.raw_text)
        for a, b in sentences(t):
            s = plain(t[a:b])
            if len(s) >= LEAST_LETTERS:
                texts.append(s)
                labels.append(r.language)
                groups.append(r.id)
    return fit(texts, labels, groups) if texts else None


def segments_of(texts: list[str], weights: np.ndarray, temp: float, least: float = LEAST_CONFIDENCE) -> list[list[tuple[int, int, int, float, bool]]]:
    """Per text its segments (start, end, language number, confidence, whether it holds a whole sentence sure of itself)."""
    spans = [sentences(t) for t in texts]
    flat = [plain(t[a:b]) for t, s in zip(texts, spans) for a, b in s]
    p = softmax(logits(flat, weights) / temp) if flat else np.zeros((0, len(LANGUAGES)))
    out, at = [], 0
    for s in spans:
        own, letters = p[at : at + len(s)], np.array([len(x) for x in flat[at : at + len(s)]])
        words = np.array([x.count(" ") + 1 for x in flat[at : at + len(s)]])
        at += len(s)
        if not letters.sum():
            out.append([])
            continue
        sure = (letters >= LEAST_LETTERS) & (words >= LEAST_WORDS) & (own.max(axis=1) >= least)
        total = (own * letters[:, None]).sum(axis=0)
        main = int(total.argmax())
        lang = np.where(sure, own.argmax(axis=1), -1)
        last = next((int(x) for x in lang if x >= 0), main)
        segs: list[list] = []
        for (a, b), x, ok, n, q in zip(s, lang, sure, letters, own):
            x = last if x < 0 else int(x)
            last = x
            if segs and segs[-1][2] == x:
                segs[-1][1] = b
                segs[-1][4] = segs[-1][4] or bool(ok)
            else:
                segs.append([a, b, x, 0.0, bool(ok), 0])
            if n:
                segs[-1][3] += float(q[x]) * int(n)
                segs[-1][5] += int(n)
        out.append([(a, b, x, c / max(1, n), ok) for a, b, x, c, ok, n in segs if n])
    return out


def segments(chunks: DataFrame, model: tuple[np.ndarray, float] | None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(chunk_id, book_id, segment_no, seg_start, seg_end, language, confidence, whole, letters) of all chunks; none without a model."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t = shared.value
        for b in batches:
            texts = [tidy(x) if x else "" for x in b["raw_text"]]
            rows = []
            for i, book, text, segs in zip(b["id"], b["book_id"], texts, segments_of(texts, w, t, least)):
                rows += [(i, book, n, s, e, LANGUAGES[x], round(c, 4), ok, e - s) for n, (s, e, x, c, ok) in enumerate(segs)]
            cols = ["chunk_id", "book_id", "segment_no", "seg_start", "seg_end", "language", "confidence", "whole", "letters"]
            yield pd.DataFrame(rows, columns=cols).astype({"chunk_id": "int64", "book_id": "Int64", "whole": bool})

    schema = "chunk_id long, book_id long, segment_no int, seg_start int, seg_end int, language string, confidence double, whole boolean, letters int"
    return chunks.select("id", "book_id", "raw_text").where(F.lit(model is not None)).mapInPandas(run, schema)


def book_languages(segs: DataFrame) -> DataFrame:
    """(book_id, language, confidence): the language of most chunks' text."""
    per_chunk = segs.groupBy("book_id", "chunk_id", "language").agg(F.sum("letters").alias("letters"), F.avg("confidence").alias("confidence"))
    main = per_chunk.groupBy("book_id", "chunk_id").agg(F.max(F.struct("letters", "language", "confidence")).alias("m"))
    votes = main.groupBy("book_id", F.col("m.language").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("m.letters").alias("letters"), F.avg("m.confidence").alias("confidence"))
    total = votes.groupBy("book_id").agg(F.max(F.struct("n", "letters", "language", "confidence")).alias("v"), F.sum("n").alias("all"))
    return total.select("book_id", F.col("v.language").alias("language"), F.round(F.col("v.confidence") * F.col("v.n") / F.col("all"), 4).alias("confidence"))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks", ["id", "book_id", "raw_text"], spread=True)
    books = table(spark, sf_dir, "books", ["id", "language"])
    return books, written(segments(chunks, fit_on_sample(chunks, books)), "segments")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, segs = _segments(spark, sf_dir)
    named = books.select(F.col("id").alias("book_id"), label_language(F.col("language")).alias("label"))
    wrong = book_languages(segs).join(named, "book_id").where(~F.col("label").eqNullSafe(F.col("language")))
    per = segs.where("whole").select("chunk_id", "language").distinct()
    mixed = per.groupBy("chunk_id").agg(F.collect_set("language").alias("l")).where(F.size("l") > 1)
    return wrong.select(F.lit("book").alias("item"), F.col("book_id").alias("item_id"), "language").unionByName(mixed.select(F.lit("chunk").alias("item"), F.col("chunk_id").alias("item_id"), F.explode("l").alias("language")))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, segs = _segments(spark, sf_dir)
    return segs.select("chunk_id", "segment_no", "seg_start", "seg_end", "language", "confidence")


def p2_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, segs = _segments(spark, sf_dir)
    return book_languages(segs)


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments, "p2_books": p2_books}
