"""Scanning folders of files and turning them into books and chunks; sinks for results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions.language import detect_language
from tomeforge.functions.lemma import lemmatize
from tomeforge.functions.text import is_metadata_line, normal_text, normalize_text
from tomeforge.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_domains, chunk_id, domains
from tomeforge.operators.dedupe import changed, decide
from tomeforge.operators.fulltext import TextIndex
from tomeforge.operators.upsert import replace_group, upsert
from tomeforge.runtime import written
from tomeforge.schemas import BLOCKS, BOOKS, CHUNKS, INDEX_STATE, conform
from tomeforge.sources.formats import parse

SUPPORTED = r"\.(pdf|epub|fb2|fbz|txt)$|\.fb2\.zip$"
UPLOAD_LIMIT = 50 * 1024 * 1024


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the supported files below a folder, or of one file as it is."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = reader.load(path)
    one = path.rstrip("/")
    return df.where(F.lower("path").rlike(SUPPORTED) | F.col("path").endswith(one))


def upload_problem(name: Column, size: Column) -> Column:
    """Null for a file that may be taken in, else what is wrong with it."""
    return F.when(size > UPLOAD_LIMIT, "too large").when(~F.lower(name).rlike(r"\.(pdf|epub|fb2|txt)$"), "unsupported format").when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "not a plain name")


def extract(files: DataFrame, compat: bool = False) -> DataFrame:
    """(source_path, fingerprint, mtime_ns, format_name, title, author, language, blocks, error), a row per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    kind, meta, blocks = parse(bytes(content), path, compat)
                    rows.append((kind, meta.get("title"), meta.get("author"), meta.get("language"), blocks, None))
                except Exception as e:  # noqa: BLE001 - a broken file is a row with its error
                    rows.append((None, None, None, None, [], str(e)[:500]))
            out = pd.DataFrame(rows, columns=["format_name", "title", "author", "language", "blocks", "error"], index=b.index)
            yield pd.concat([b[["source_path", "fingerprint", "mtime_ns"]], out], axis=1)

    ready = files.select("path", "content", F.col("path").alias("source_path"), F.sha2("content", 256).alias("fingerprint"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    parsed = ready.mapInPandas(run, f"source_path string, fingerprint string, mtime_ns long, format_name string, title string, author string, language string, blocks {BLOCKS}, error string")
    text = F.concat_ws(" ", F.col("blocks.text"))
    return parsed.withColumn("language", F.coalesce("language", detect_language(text)))


def content_hash(blocks: Column) -> Column:
    """Of the normalised text without lines of metadata."""
    body = F.filter(blocks, lambda b: ~is_metadata_line(b["text"]))
    return F.sha2(normalize_text(F.concat_ws("\n", F.transform(body, lambda b: b["text"]))), 256)


def book_chunks(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(source_path, chunk_no, text, locator) of extracted documents."""
    flat = docs.select("source_path", F.posexplode("blocks").alias("block_no", "b")).select("source_path", "block_no", "b.*")
    return chunk_domains(domains(flat, "source_path"), "source_path", max_chars, overlap)


def earlier_files(good: DataFrame, state: DataFrame) -> DataFrame:
    """(binary_hash, normal_hash) of the indexed files that are not in good; states of before the normalised hash get it from equal bytes."""
    known = good.groupBy("fingerprint").agg(F.min("normal_hash").alias("same_bytes"))
    rest = conform(state, INDEX_STATE).join(good.select("source_path"), "source_path", "left_anti").join(known, "fingerprint", "left")
    return rest.select(F.col("fingerprint").alias("binary_hash"), F.coalesce("normal_hash", "same_bytes").alias("normal_hash"))


def lemma_texts(chunks: DataFrame, lemmas: DataFrame) -> DataFrame:
    """chunks (id, lemma_text with the normalised text, language) with the lemmas of the Russian ones in place of their words; lemmas: (form, lemma)."""
    russian = ~F.coalesce("language", F.lit("ru")).isin("kk", "tt", "en")
    terms = chunks.where(russian & (F.coalesce("lemma_text", F.lit("")) != "")).select("id", F.split("lemma_text", " ").alias("terms"))
    found = lemmatize(terms, "id", "terms", lemmas).withColumnRenamed("lemma_text", "_lemmas")
    return chunks.join(found, "id", "left").withColumn("lemma_text", F.coalesce("_lemmas", "lemma_text")).drop("_lemmas")


def index_files(
    files: DataFrame, books: DataFrame, chunks: DataFrame, state: DataFrame, run_no: int = 0, skip_duplicates: bool = True, across_runs: bool = False, lemmas: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New (books, chunks, index_state) and the results (source_path, status, reason, error) of one run.

    Unchanged files are skipped; duplicates are not indexed unless skip_duplicates is off. across_runs: nor are duplicates
    of files that earlier runs indexed under another path; an indexed path comes before a new one of the same content.
    lemmas: (form, lemma) for the lemma text of Russian chunks, which without it is the normalised text.  Every file is
    read and parsed once; all four results come from that one table.
    """
    hashed = files.select("path", "modificationTime", "content").withColumn("source_path", F.col("path")).withColumn("fingerprint", F.sha2("content", 256))
    todo = changed(hashed, state)
    unchanged = written(hashed.join(todo.select("source_path"), "source_path", "left_anti").select("source_path"), "unchanged")
    docs = written(extract(todo.select("path", "modificationTime", "content")), "extracted")
    good = docs.where(F.col("error").isNull()).withColumn("normal_hash", content_hash(F.col("blocks")))
    order, history = F.col("source_path"), None
    if across_runs:
        indexed = state.select("source_path", F.lit(False).alias("new")).distinct()
        good = good.join(indexed, "source_path", "left")
        order, history = F.struct(F.coalesce("new", F.lit(True)), "source_path"), earlier_files(good, state)
    decided = decide(good.withColumn("turn", order).withColumnRenamed("fingerprint", "binary_hash"), "source_path", order="turn", history=history).withColumnRenamed("binary_hash", "fingerprint")
    decided = written(decided.withColumn("updated_at", F.current_timestamp()), "decided")
    taken = decided.where(~F.col("is_duplicate")) if skip_duplicates else decided
    fresh = taken.withColumn("id", F.xxhash64("source_path"))
    parts = book_chunks(taken).join(taken.select("source_path", "language"), "source_path")
    new_chunks = parts.select(
        chunk_id(F.col("source_path"), F.col("chunk_no"), F.col("text")).alias("id"), F.xxhash64("source_path").alias("book_id"), "chunk_no", F.col("text").alias("raw_text"), normal_text(F.col("text"), F.col("language")).alias("lemma_text"), "page", "chapter", "item_id", "char_start", "char_end", "language"
    )
    if lemmas is not None:
        new_chunks = lemma_texts(new_chunks, lemmas)
    new_state = fresh.select("source_path", F.col("id").alias("book_id"), "fingerprint", "mtime_ns", F.col("updated_at").alias("indexed_at"), F.lit(run_no).alias("run_no"), "normal_hash")
    results = (
        decided.select("source_path", F.when(F.col("is_duplicate") & F.lit(skip_duplicates), "skipped").otherwise("indexed").alias("status"), "reason", F.lit(None).cast("string").alias("error"))
        .unionByName(docs.where(F.col("error").isNotNull()).select("source_path", F.lit("error").alias("status"), F.lit(None).cast("string").alias("reason"), "error"))
        .unionByName(unchanged.select("source_path", F.lit("skipped").alias("status"), F.lit("unchanged").alias("reason"), F.lit(None).cast("string").alias("error")))
    )
    return upsert(books, conform(fresh, BOOKS), "source_path"), replace_group(chunks, conform(new_chunks, CHUNKS), "book_id"), upsert(conform(state, INDEX_STATE), conform(new_state, INDEX_STATE), "source_path"), results


def iter_chunks(chunks: DataFrame, books: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Chunks with their book, by id."""
    if limit is not None and limit <= 0 or offset < 0:
        raise ValueError("the limit must be positive and the offset not negative")
    meta = books.select(F.col("id").alias("book_id"), "source_path", "title", "author", "format_name", "language")
    out = chunks.join(meta, "book_id").orderBy("id").offset(offset)
    return out.limit(limit) if limit is not None else out


def chunks_by_ids(chunks: DataFrame, ids: list[int]) -> DataFrame:
    return chunks.where(F.col("id").isin(list(ids)) if ids else F.lit(False)).orderBy("id")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def parse_results(lines: DataFrame, col: str = "json") -> DataFrame:
    """Results of a search payload {"results": [...]}; entries without a path or a display are left out, odd numbers are null."""
    schema = "results array<struct<source_path:string,title:string,author:string,format:string,chunk_id:string,chunk_no:string,page:string,chapter:string,excerpt:string,hybrid_score:string,display:string>>"
    rows = lines.select(F.explode(F.from_json(col, schema)["results"]).alias("r")).select("r.*")
    keep = rows.where((F.coalesce("source_path", F.lit("")) != "") & (F.coalesce("display", F.lit("")) != ""))
    return keep.withColumns({"chunk_id": F.coalesce(F.col("chunk_id").try_cast("long"), F.lit(-1)), "chunk_no": F.coalesce(F.col("chunk_no").try_cast("int"), F.lit(0)), "page": F.col("page").try_cast("int"), "hybrid_score": F.col("hybrid_score").try_cast("double")})


def maintain(spark: SparkSession, action: str, index_path: str, chunks: DataFrame | None = None) -> None:
    """optimize: rewrite a text index into few sorted files; rebuild: build it again from chunks. Searches go on meanwhile."""
    if action == "rebuild" and chunks is not None:
        TextIndex(spark, index_path).build(chunks)
    elif action == "optimize":
        TextIndex(spark, index_path).optimize()
    else:
        raise ValueError(f"unknown action {action}")
