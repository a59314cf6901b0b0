"""Encoding of a corpus with a public byte-level tokenizer, long texts by tree concatenation.

A text of up to LEAF_CHARS characters is encoded as it is.  A longer one is cut into leaves by halving; the leaves are
rows of their own, so a very long text is encoded by many tasks.  Neighbouring encodings are then joined pairwise up
the tree: the tokens around each join are encoded again in a window that grows on both sides until its first tokens
equal the left side's and its last tokens equal the right side's, at the latest when it covers both sides whole.
A cut is moved to a blank that follows a non-blank if the middle has one near by, where the encodings of both sides
are independent of each other; text without blanks is cut anywhere.

Defined results: null and empty texts both give an empty list; strings of special tokens are ordinary text; repeated
rows are kept as repeated rows; a null id stays null; extra columns are not part of the result; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeforge.runtime import table

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 16_384
#: Tokens on either side that a window has to agree on before its middle is trusted.
AGREE = 6


@lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """(encoding, byte length of each token), once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(directory, vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def cut_points(text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Where the leaves of a text begin and end: [0, ..., len(text)]."""
    points, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            points.append(a)
            continue
        mid, reach = (a + b) // 2, leaf // 8
        for k in range(reach):
            p = mid + k
            if text[p].isspace() and not text[p - 1].isspace():
                mid = p
                break
        stack += [(mid, b), (a, mid)]
    return sorted(points) + [len(text)]


class _Piece:
    """Token ids of data[start:end] and the byte offsets at which they end."""

    __slots__ = ("start", "end", "ids", "ends")

    def __init__(self, start: int, ids: np.ndarray, sizes: np.ndarray):
        self.start, self.ids = start, ids
        self.ends = start + np.cumsum(sizes[ids])
        self.end = int(self.ends[-1]) if len(ids) else start


def _join(a: _Piece, b: _Piece, data: bytes, encoding, sizes: np.ndarray) -> _Piece:
    if not len(a.ids) or not len(b.ids):
        return b if not len(a.ids) else a
    inside = lambda p: p < len(data) and data[p] & 0xC0 == 0x80  # noqa: E731 - in the middle of a character
    m = 2 * AGREE
    while True:
        i, j = max(0, len(a.ids) - m), min(len(b.ids), m)
        while i and inside(int(a.ends[i - 1])):
            i -= 1
        while j < len(b.ids) and inside(int(b.ends[j - 1])):
            j += 1
        s, e = int(a.ends[i - 1]) if i else a.start, int(b.ends[j - 1])
        w = np.array(encoding.encode_ordinary(data[s:e].decode("utf-8")), np.int64)
        left = i == 0 or (len(w) >= AGREE and np.array_equal(w[:AGREE], a.ids[i : i + AGREE]))
        right = j == len(b.ids) or (len(w) >= AGREE and np.array_equal(w[-AGREE:], b.ids[j - AGREE : j]))
        if left and right:
            return _Piece(a.start, np.concatenate([a.ids[:i], w, b.ids[j:]]), sizes)
        m *= 2


def concatenate(texts: list[str], ids: list, encoding, sizes: np.ndarray) -> list[int]:
    """The encoding of the joined texts from the encodings of each, joined pairwise as a tree."""
    raw = [t.encode("utf-8") for t in texts]
    data, pieces, at = b"".join(raw), [], 0
    for r, x in zip(raw, ids):
        pieces.append(_Piece(at, np.asarray(x, np.int64), sizes))
        at += len(r)
    while len(pieces) > 1:
        pieces = [_join(pieces[k], pieces[k + 1], data, encoding, sizes) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0].ids.tolist() if pieces else []


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(id, ids) of each row, ids being the whole text's token ids without special tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        encoding, _ = encoder(directory, vocabulary)
        return pd.Series([encoding.encode_ordinary(t) if t else [] for t in texts])

    short = F.coalesce(F.length("text"), F.lit(0)) <= leaf
    whole = rows.where(short).select("id", encode("text").alias("ids"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, row, text in zip(b["id"], b["row"], b["text"]):
                p = cut_points(text, leaf)
                yield pd.DataFrame({"id": [i] * (len(p) - 1), "row": row, "leaf": range(len(p) - 1), "text": [text[x:y] for x, y in zip(p, p[1:])]}).astype({"id": b["id"].dtype})

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("leaf")
        encoding, sizes = encoder(directory, vocabulary)
        return pd.DataFrame({"id": b["id"].iloc[:1], "ids": [concatenate(list(b["text"]), list(b["ids"]), encoding, sizes)]})

    leaf_type = T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("leaf", T.IntegerType()), T.StructField("text", T.StringType())])
    out_type = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    leaves = rows.where(~short).withColumn("row", F.monotonically_increasing_id()).mapInPandas(split, leaf_type)
    # a very long text's leaves go to different tasks for encoding; its result is one row, so one task joins it
    encoded = leaves.repartition("row", "leaf").withColumn("ids", encode("text"))
    joined = encoded.groupBy("row").applyInPandas(merge, out_type)
    return whole.unionByName(joined).select(F.col("id").alias(id_col), "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True))


def p8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes): the length of what each document's ids stand for; the encoding loses nothing."""

    @F.pandas_udf("long")
    def size(ids: pd.Series) -> pd.Series:
        _, sizes = encoder()
        return pd.Series([int(sizes[np.asarray(x, np.int64)].sum()) for x in ids], index=ids.index)

    return p8_ids(spark, sf_dir).select("doc_id", size("ids").alias("n_bytes"))


QUERIES = {"p8_ids": p8_ids, "p8_bytes": p8_bytes}

ORACLES = {"p8_bytes": "SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes FROM documents"}
