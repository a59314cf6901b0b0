"""Schemas of the engine's tables; additive migration by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _parse(ddl: str) -> T.StructType:
    """Names and types without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


LOCATOR = _parse("page int, chapter string, item_id string, char_start int, char_end int")
BLOCKS = "array<struct<text:string,page:int,chapter:string,item_id:string,char_start:int,char_end:int>>"
BOOKS = _parse("id long, source_path string, title string, author string, format_name string, language string, updated_at timestamp")
CHUNKS = _parse("id long, book_id long, chunk_no int, raw_text string, lemma_text string, page int, chapter string, item_id string, char_start int, char_end int")
INDEX_STATE = _parse("source_path string, book_id long, fingerprint string, mtime_ns long, indexed_at timestamp, run_no int, normal_hash string")
LEMMAS = _parse("form string, lemma string")
VECTORS = _parse("chunk_id long, model string, fingerprint string, embedding array<float>")
CATEGORIES = _parse("id int, name string, parent_id int, description string")
BOOK_CATEGORIES = _parse("book_id long, category_id int")
TAGS = _parse("id long, name string, tag_type string")
BOOK_TAGS = _parse("book_id long, tag_id long")
TIMELINE = _parse("book_id long, chunk_id long, year_from int, year_to int, decade int, century int, event_text string, source_fragment string, is_approximate boolean, confidence double")
DIALOG = _parse("id long, chat_id long, user_id long, role string, content string, created_at timestamp")
SETTINGS = _parse("user_id long, excerpt_size int")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones as null, others dropped, types cast."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
