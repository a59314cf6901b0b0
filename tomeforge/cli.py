"""Command line: index, search, classify, timeline, watch; every command prints one JSON object."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.lemma import lemmas_of
from tomeforge.operators.filters import SearchFilters, filter_books
from tomeforge.operators.fulltext import TextIndex, query_terms, search_text
from tomeforge.operators.hybrid import ALPHA, CANDIDATES, search_hybrid
from tomeforge.operators.taxonomy import MIN_SCORE, TOP_N, book_sample, classify
from tomeforge.operators.timeline import MIN_CONFIDENCE, extract
from tomeforge.operators.upsert import replace_group
from tomeforge.operators.vectors import Embedder, HashingEmbedder, check_model, embed, live_vectors, pending_chunks, search_semantic
from tomeforge.operators.versions import Versions
from tomeforge.runtime import build_session, written
from tomeforge.schemas import BOOK_CATEGORIES, BOOKS, CHUNKS, INDEX_STATE, LEMMAS, TIMELINE, VECTORS, conform
from tomeforge.sources.files import index_files, maintain, scan

GATE_MS = 2000


class Store(Versions):
    """The tables of one collection, as they were left by the last finished command; a command publishes all it wrote in one step."""

    def read(self, name: str, schema) -> DataFrame:
        """A table that no command has written yet is empty; any other failure to read it is one."""
        state = self.current()
        folder = state["tables"].get(name) if state else None
        return conform(self.spark.read.parquet(folder), schema) if folder else self.spark.createDataFrame([], schema)

    def write(self, facts: dict | None = None, **tables: DataFrame) -> None:
        """Write the tables and publish them together, with facts about them; the others stay as they are."""
        state = self.current()
        folders = {}
        for name, df in tables.items():
            folders[name] = f"{self.new_folder()}/{name}"
            df.write.parquet(folders[name])
        old = state or {"tables": {}, "facts": {}}
        self.publish(state, {"tables": old["tables"] | folders, "facts": old["facts"] | (facts or {})})

    def fact(self, name: str):
        state = self.current()
        return state["facts"].get(name) if state else None

    @property
    def index(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.path}/text_index")


def index_new(store: Store, files: DataFrame) -> dict:
    """Index files, bring the text index up to date and report; books, chunks and state change together or not at all."""
    lemmas = store.read("lemmas", LEMMAS)
    lemmas = None if lemmas.isEmpty() else lemmas
    b, k, s, results = index_files(files, store.read("books", BOOKS), store.read("chunks", CHUNKS), store.read("index_state", INDEX_STATE), across_runs=True, lemmas=lemmas)
    rows = _rows(results)
    if any(r["status"] == "indexed" for r in rows):
        store.write(books=b, chunks=k, index_state=s)
        store.index.build(store.read("chunks", CHUNKS).select("id", "raw_text", "lemma_text"))
    counts = {status: sum(r["status"] == status for r in rows) for status in ("indexed", "skipped")}
    return {"scanned": len(rows), **counts, "duplicates": [r for r in rows if r["reason"] in ("binary-match", "normalized-content-match")], "errors": [r for r in rows if r["status"] == "error"]}


def embed_new(store: Store, embedder: Embedder, batch_size: int = 32) -> dict:
    """Vectors of the chunks that have none of this model yet; those of chunks that are gone are left out."""
    chunks, vectors = store.read("chunks", CHUNKS), store.read("vectors", VECTORS)
    done = written(embed(pending_chunks(chunks, vectors, embedder.model), embedder, batch_size), "embedded")
    fresh = done.where(F.col("error").isNull()).drop("error")
    n = fresh.count()
    if n:
        kept = live_vectors(vectors, chunks).join(fresh.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").unionByName(fresh)
        store.write({"model": embedder.model, "dimension": embedder.dimension}, vectors=kept)
    return {"embedded": n, "errors": _rows(done.where(F.col("error").isNotNull()).select("chunk_id", "error"))}


def take_in(store: Store, embedder: Embedder, batch: DataFrame) -> dict:
    """One batch of a watched folder: the text stage, then the vector stage unless all files were duplicates. stage: where it ended."""
    stage = "text"
    try:
        report = index_new(store, batch)
        if report["indexed"]:
            stage = "vectors"
            report |= embed_new(store, embedder)
        return report | {"status": "failed" if report["errors"] else "duplicate" if not report["indexed"] and report["duplicates"] else "done", "stage": stage}
    except Exception as e:  # noqa: BLE001 - the watch goes on; the batch is reported with what went wrong
        return {"status": "failed", "stage": stage, "error": str(e)[:500]}


def _filters(a: argparse.Namespace) -> SearchFilters:
    return SearchFilters(author=a.author, format_name=a.format, language=a.language)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.drop("raw_text", "lemma_text", "embedding").collect()]


def run(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tomeforge")
    p.add_argument("--store", default="library")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("index-files")
    ingest.add_argument("--path", required=True)
    ingest.add_argument("--lemmas", help="parquet of (form, lemma), kept with the collection")
    sub.add_parser("optimize")
    sub.add_parser("index-vectors").add_argument("--batch-size", type=int, default=32)
    for name in ("search-text", "search-semantic", "search-hybrid"):
        s = sub.add_parser(name)
        s.add_argument("--query", required=True)
        s.add_argument("--limit", type=int, default=10)
        s.add_argument("--phrase-mode", action="store_true")
        s.add_argument("--alpha", type=float, default=ALPHA)
        s.add_argument("--candidate-limit", type=int, default=CANDIDATES)
        s.add_argument("--measure-ms", action="store_true")
        s.add_argument("--repeats", type=int, default=1)
        for f in ("author", "format", "language"):
            s.add_argument(f"--{f}")
    c = sub.add_parser("classify-books")
    c.add_argument("--min-score", type=float, default=MIN_SCORE)
    c.add_argument("--top-n", type=int, default=TOP_N)
    sub.add_parser("build-timeline").add_argument("--min-confidence", type=float, default=MIN_CONFIDENCE)
    w = sub.add_parser("watch")
    w.add_argument("--watch-dir", required=True)
    w.add_argument("--once", action="store_true")
    a = p.parse_args(argv)
    spark = build_session()
    store = Store(spark, a.store)
    books, chunks = store.read("books", BOOKS), store.read("chunks", CHUNKS)
    code, out = 0, {}

    embedder = HashingEmbedder()
    if a.command == "index-files":
        if a.lemmas:
            store.write(lemmas=conform(spark.read.parquet(a.lemmas), LEMMAS))
        out = index_new(store, scan(spark, a.path))
        code = int(bool(out["errors"]))
    elif a.command == "optimize":
        maintain(spark, "optimize", store.index.path)
    elif a.command == "index-vectors":
        out = embed_new(store, embedder, a.batch_size)
        code = int(bool(out["errors"]))
    elif a.command.startswith("search-"):
        if not 0 <= a.alpha <= 1:
            print(json.dumps({"error": "alpha must be between 0 and 1"}))
            return 2
        if a.command != "search-text":
            model = store.fact("model")
            state = spark.createDataFrame([(model, store.fact("dimension"))] if model else [], "model string, dimension int")
            try:
                check_model(state, embedder.model, embedder.dimension)
            except RuntimeError as e:
                print(json.dumps({"error": str(e)}))
                return 2
        index = store.index if store.index.current() else None
        times = []
        for _ in range(max(1, a.repeats)):
            began = time.time()
            lemmas = store.read("lemmas", LEMMAS)
            lemma_query = None if lemmas.isEmpty() else " ".join(lemmas_of(query_terms(a.query), lemmas))
            if a.command == "search-text":
                hits = search_text(chunks, filter_books(books, _filters(a)), a.query, a.limit, a.phrase_mode, lemma_query, index=index)
            elif a.command == "search-semantic":
                hits = search_semantic(store.read("vectors", VECTORS), chunks, books, embedder.embed([a.query])[0], a.limit, filters=_filters(a))
            else:
                hits = search_hybrid(chunks, books, store.read("vectors", VECTORS), a.query, embedder.embed([a.query])[0], a.limit, a.alpha, a.phrase_mode, a.candidate_limit, _filters(a), lemma_query=lemma_query, index=index)
            rows = _rows(hits) if a.query.strip() else []
            times.append(round((time.time() - began) * 1000, 2))
        out = {"query": a.query, "limit": a.limit, "phrase_mode": a.phrase_mode, "results": rows}
        if a.measure_ms:
            out["elapsed_ms"] = times
            code = 2 if max(times) > GATE_MS else 0
    elif a.command == "classify-books":
        found = classify(book_sample(chunks), min_score=a.min_score, top_n=a.top_n)
        fresh = written(conform(found, BOOK_CATEGORIES), "categories")
        store.write(book_categories=replace_group(store.read("book_categories", BOOK_CATEGORIES), fresh, "book_id"))  # those of other books stay
        rows = _rows(found.withColumn("score", F.round("score", 4)))
        out = {"classified": len({r["book_id"] for r in rows}), "results": rows}
    elif a.command == "build-timeline":
        store.write(timeline=extract(chunks, least=a.min_confidence))
        rows = _rows(store.read("timeline", TIMELINE).groupBy("book_id").count())
        out = {"total_events": sum(r["count"] for r in rows), "books": rows}
    else:
        from tomeforge.streaming.watch import arrivals, consume

        try:
            stream = arrivals(spark, a.watch_dir)
        except ValueError as e:
            print(json.dumps({"error": str(e)}))
            return 2
        q = consume(stream, lambda batch, _: print(json.dumps(take_in(store, embedder, batch), ensure_ascii=False, default=str)), f"{a.store}/_watch", a.once)
        q.awaitTermination()
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(run())
