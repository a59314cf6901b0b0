"""Queries of ingestion, enrichment, answering, dialogs and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.functions import text as X
from tomeforge.operators.chunking import chunk_domains, domains
from tomeforge.operators.dedupe import binary_duplicates, changed, decide, latest_per_key, run_stats
from tomeforge.operators.dialog import active_sessions, book_line, clear_history, read_history
from tomeforge.operators.dialog import book_page as page_of_books
from tomeforge.operators.rag import NO_DATA, answers, distinct_sources, prompt, select_context, sufficient
from tomeforge.operators.taxonomy import MIN_SCORE, THESAURUS, TOP_N, book_sample, classify
from tomeforge.operators.timeline import CENTURY_WORDS, extract, numerals, overlapping
from tomeforge.operators.upsert import keep_existing, last_n, upsert
from tomeforge.plans.incremental import committed_files
from tomeforge.runtime import table
from tomeforge.sources.files import upload_problem
from tomeforge.sources.formats import route
from tomeforge.streaming.watch import debounce_batch, parse_payloads, wanted


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "chunks", list(cols) or None, spread=True)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a book as blocks of a document."""
    c = ["book_id", "chunk_no", "raw_text", "page", "chapter", "item_id", "char_start", "char_end"]
    return _chunks(spark, d, *c).withColumnsRenamed({"book_id": "doc_id", "chunk_no": "block_no", "raw_text": "text"})


def chunk_domain_texts(spark: SparkSession, d: str) -> DataFrame:
    found = domains(_blocks(spark, d))
    return found.select("doc_id", "domain_no", "page", "chapter", "item_id", F.sha2("text", 256).alias("sha"), "char_start", "char_end")


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk_domains(domains(_blocks(spark, d)), max_chars=600, overlap=120)


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(t, 256).alias("binary_hash"), F.sha2(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), 256).alias("normal_hash"))


def dedupe_binary(spark: SparkSession, d: str) -> DataFrame:
    return binary_duplicates(_hashed(spark, d), "doc_id", "binary_hash")


def dedupe_normalized(spark: SparkSession, d: str) -> DataFrame:
    return decide(_hashed(spark, d), "doc_id").select("doc_id", "is_duplicate", "reason")


def incremental_changed(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "file_scans", ["source_path", "fingerprint"]).where("fingerprint is not null").select("source_path", F.lower("fingerprint").alias("fingerprint")).distinct()
    return changed(seen, committed_files(table(spark, d, "index_state"), table(spark, d, "index_runs")))


def incremental_stats(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("status") == "succeeded"
    log = table(spark, d, "index_state", ["run_no", "fingerprint", "source_path"]).distinct().join(F.broadcast(table(spark, d, "index_runs", ["run_no", "status"])), "run_no")
    return run_stats(log.select(F.when(good, "indexed").otherwise("error").alias("status")))


def index_state_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_state", ["source_path", "run_no", "mtime_ns", "book_id"])
    return latest_per_key(rows, "source_path", ["run_no", "mtime_ns"])


def classify_topn(spark: SparkSession, d: str) -> DataFrame:
    found = classify(book_sample(_chunks(spark, d, "book_id", "chunk_no", "raw_text")))
    return found.select("book_id", "category_id", "name", F.round("score", 9).alias("score"))


def books_by_category(spark: SparkSession, d: str) -> DataFrame:
    found = classify(book_sample(_chunks(spark, d, "book_id", "chunk_no", "raw_text")))
    return found.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_books"), F.min("book_id").alias("first_book"))


def timeline_spans(spark: SparkSession, d: str) -> DataFrame:
    return extract(_chunks(spark, d, "id", "book_id", "raw_text"))


def timeline_years(spark: SparkSession, d: str) -> DataFrame:
    return extract(_chunks(spark, d, "id", "book_id", "raw_text")).groupBy("book_id", "year_from").agg(F.count(F.lit(1)).alias("n"))


def timeline_overlap(spark: SparkSession, d: str) -> DataFrame:
    events = extract(_chunks(spark, d, "id", "book_id", "raw_text"))
    return overlapping(events, table(spark, d, "books", ["id", "title", "author"]), 1700, 1725).select("book_id", "chunk_id", "year_from", "title")


def _results(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "query_text", "source_path", "title", "author", "chunk_id", "chunk_no", "page", "excerpt", "hybrid_score"]
    hits = table(spark, d, "hybrid_hits", cols).distinct()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "chunk_id")))


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    return select_context(_results(spark, d), 1200, group=["query_id"]).select("query_id", "chunk_id", "rank")


def rag_gate(spark: SparkSession, d: str) -> DataFrame:
    return sufficient(_results(spark, d), ["query_id"])


def rag_sources(spark: SparkSession, d: str) -> DataFrame:
    return distinct_sources(_results(spark, d), ["query_id"]).select("query_id", "title", "author", "source_path", "location", "first_rank")


def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    return prompt(_results(spark, d), ["query_id", "query_text"], "query_text", 1500).select("query_id", F.sha2("prompt", 256).alias("sha"), F.length("prompt").alias("chars"))


def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    lead = results.where("rank = 1").select("query_id", F.col("excerpt").alias("lead"))
    asked = prompt(results, ["query_id", "query_text"], "query_text", 1500).select("query_id", "prompt")
    return answers(asked.join(lead, "query_id").join(sufficient(results, ["query_id"]), "query_id"))


def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "file_scans", ["source_path", "size_bytes"])
    return seen.groupBy(upload_problem(X.basename(F.col("source_path")), F.col("size_bytes")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def file_routes(spark: SparkSession, d: str) -> DataFrame:
    """The format by which a file would be read; only its path is looked at."""

    @F.pandas_udf("string")
    def kind(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: route(p, b""))

    return table(spark, d, "file_scans", ["source_path"]).groupBy(kind("source_path").alias("format_name")).agg(F.count(F.lit(1)).alias("n"))


def history_cleared(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "events", ["event_id", "user_id"]).select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("chat_id"), "user_id")
    return clear_history(turns, 3, 10).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """The events as messages: a user's chat is the kind of the event."""
    return table(spark, d, "events", ["event_id", "user_id", "event_type", "ts"]).select(F.col("event_id").alias("id"), F.col("event_type").alias("chat"), "user_id", "ts")


def dialog_last_n(spark: SparkSession, d: str) -> DataFrame:
    return last_n(_turns(spark, d), ["chat", "user_id"], [F.desc("id")], 20).groupBy("chat", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("oldest"))


def dialog_history(spark: SparkSession, d: str) -> DataFrame:
    return read_history(_turns(spark, d), 4, ["user_id"]).select("user_id", "id", "place")


def session_active(spark: SparkSession, d: str) -> DataFrame:
    return active_sessions(_turns(spark, d), "user_id", "id").select("user_id", "id", "chat")


def book_page(spark: SparkSession, d: str) -> DataFrame:
    rows, total = page_of_books(table(spark, d, "books", ["id", "title", "author", "format_name"]), 2, 10)
    return rows.select("id", book_line().alias("line"), F.lit(total).alias("total"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five of each query's results."""
    return _results(spark, d).where("rank between 6 and 10").select("query_id", "chunk_id", "rank")


def upsert_books(spark: SparkSession, d: str) -> DataFrame:
    """Books of one shelf get a new title; one unknown path is added."""
    books = table(spark, d, "books", ["id", "source_path", "title"])
    new = books.where(F.contains("source_path", F.lit("/upload/"))).select("source_path", "id", F.upper("title").alias("title"))
    extra = spark.createDataFrame([(10**9, "/library/new.txt", "New")], "id long, source_path string, title string")
    return keep_existing(upsert(books, new, "source_path"), extra, "source_path")


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "user_id", "ts"])
    return debounce_batch(e, "ts", "user_id", 1800).select("user_id", F.date_format(F.col("first_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format(F.col("last_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_at"), "n")


def ingest_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Reports as an ingestion prints them, one per file: good ones, errors, and broken JSON."""
    b = table(spark, d, "books", ["id", "source_path", "title"])
    report = F.when(F.col("title").isNull(), "{broken").when(F.contains("source_path", F.lit("/upload/")), F.concat(F.lit('{"results": [], "errors": [{"path": "x", "error": "no '), F.col("id").cast("string"), F.lit('"}]}'))).otherwise(
        F.concat(F.lit('{"results": [{"source_path": "'), F.col("source_path"), F.lit('", "is_duplicate": true, "reason": "binary-match"}], "errors": []}'))
    )
    return parse_payloads(b.select("id", report.alias("json"))).groupBy("ok", "stage", "is_duplicate", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error"))


def file_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_scans", ["source_path"]).where(wanted(F.col("source_path"))).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_domain_texts, chunk_windows, dedupe_binary, dedupe_normalized, incremental_changed, incremental_stats, index_state_latest, classify_topn, books_by_category, timeline_spans, timeline_years, timeline_overlap,
        rag_context, rag_gate, rag_sources, rag_prompt, rag_answers, upload_checks, file_routes, history_cleared, dialog_last_n, dialog_history, session_active, book_page, search_page, upsert_books, debounce_sessions, ingest_payloads, file_arrivals,
    )
}

_RES = """WITH h AS (SELECT DISTINCT query_id, query_text, source_path, title, author, chunk_id, chunk_no, page, excerpt, hybrid_score FROM hybrid_hits),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM h)"""
_ANSWER_LOC = "CASE WHEN page IS NOT NULL THEN 'стр. ' || page ELSE 'позиция ' || (greatest(chunk_no, 0) + 1) END"
_HASH = "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS b, sha256(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS n FROM documents)"
_ROMANS = repr(numerals())
_NUMERAL = f"list_position({_ROMANS}, upper(r[i + %d]))"
_WORDED = f"(regexp_full_match(coalesce(r[i + %d], ''), '\\s+') AND regexp_full_match(lower(coalesce(r[i + %d], '')), '{CENTURY_WORDS}'))"
_YEAR = "CASE WHEN regexp_full_match(coalesce(r[i + %d], ''), '1[0-9]{3}|20[0-2][0-9]') THEN r[i + %d]::INT END"
_DECADE_TAIL = "(regexp_full_match(coalesce(r[i + %d], ''), '[\\s-]+') AND lower(coalesce(r[i + %d], '')) IN ('год', 'года', 'годы'))"
#: Spans by the rules of the operator, each classified by its neighbours; overlaps go by the parity of chains of ranges.
_SPANS = f"""t AS (SELECT book_id, id, regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS r FROM chunks),
p AS (SELECT book_id, id, r, unnest(list_filter(range(1, len(r) + 1), lambda i: regexp_full_match(r[i], '[0-9]{{4}}[еЕ]?|[IVXivx]+'))) AS i FROM t),
v AS (SELECT *, {_YEAR % (0, 0)} AS a, {_YEAR % (2, 2)} AS b, {_NUMERAL % 0} AS c, {_NUMERAL % 2} AS d, trim(coalesce(r[i + 1], ''), chr(32) || chr(9) || chr(10) || chr(13)) IN ('-', '–', '—') AS dash,
 CASE WHEN regexp_full_match(r[i], '1[0-9]{{2}}0[еЕ]') THEN r[i][1:4]::INT END AS e FROM p),
k AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND dash THEN 'range' WHEN a < 2000 AND a % 10 = 0 AND r[i + 1] IN ('-', '–') AND lower(coalesce(r[i + 2], '')) = 'е' THEN 'dashed'
 WHEN e IS NOT NULL THEN 'joined' WHEN a IS NOT NULL THEN 'year' WHEN c > 0 AND d > 0 AND dash AND {_WORDED % (3, 4)} THEN 'centuries' WHEN c > 0 AND {_WORDED % (1, 2)} THEN 'century' END AS kind FROM v),
l AS (SELECT *, coalesce(lag(kind) OVER w = 'range' AND lag(i) OVER w = i - 2, false) AS linked, coalesce(lag(kind) OVER w = 'centuries' AND lag(i) OVER w = i - 2, false) AS second FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY i)),
g AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY id ORDER BY i) AS island FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY i) - 1 AS chain FROM g),
s AS (SELECT *, CASE kind WHEN 'range' THEN 3 WHEN 'dashed' THEN CASE WHEN {_DECADE_TAIL % (3, 4)} THEN 5 ELSE 3 END WHEN 'joined' THEN CASE WHEN {_DECADE_TAIL % (1, 2)} THEN 3 ELSE 1 END WHEN 'year' THEN 1 WHEN 'centuries' THEN 5 ELSE 3 END AS size FROM n WHERE chain % 2 = 0 AND NOT second),
spans AS (SELECT book_id, id AS chunk_id, (CASE kind WHEN 'range' THEN least(a, b) WHEN 'joined' THEN e WHEN 'centuries' THEN c * 100 - 99 WHEN 'century' THEN c * 100 - 99 ELSE a END)::INT AS year_from,
 (CASE kind WHEN 'range' THEN greatest(a, b) WHEN 'dashed' THEN a + 9 WHEN 'joined' THEN e + 9 WHEN 'centuries' THEN d * 100 WHEN 'century' THEN c * 100 ELSE a END)::INT AS year_to,
 (CASE kind WHEN 'dashed' THEN a WHEN 'joined' THEN e END)::INT AS decade, (CASE WHEN kind IN ('century', 'centuries') THEN c END)::INT AS century, array_to_string(r[i:i + size - 1], '') AS event_text, array_to_string(r[i:i + size - 1], '') AS source_fragment,
 kind IN ('dashed', 'joined', 'century', 'centuries') OR list_has_any(regexp_extract_all(lower(right(CASE WHEN i > 1 THEN array_to_string(r[greatest(1, i - 30):i - 1], '') ELSE '' END, 30)), '[\\p{{L}}\\p{{N}}_]+'), ['около', 'примерно', 'приблизительно']) AS is_approximate,
 (CASE kind WHEN 'range' THEN 0.95 WHEN 'year' THEN 0.9 WHEN 'dashed' THEN 0.7 WHEN 'joined' THEN 0.7 ELSE 0.6 END)::DOUBLE AS confidence FROM s)"""
_WORDS = " UNION ALL ".join(f"SELECT {pos} AS pos, {c} AS category_id, '{n}' AS name, '{w}' AS word" for pos, (c, n, ws) in enumerate(THESAURUS) for w in dict.fromkeys(x.lower() for x in ws))
_CLASSIFY = f"""WITH k AS ({_WORDS}), s AS (SELECT book_id, chunk_no, raw_text, row_number() OVER (PARTITION BY book_id ORDER BY chunk_no) AS rn FROM chunks),
t AS (SELECT book_id, list_distinct(regexp_extract_all(lower(string_agg(raw_text, ' ' ORDER BY chunk_no)), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM s WHERE rn <= 20 GROUP BY book_id),
u AS (SELECT book_id, len(w) AS n, unnest(w) AS word FROM t), c AS (SELECT book_id, n, pos, category_id, name, count(*)::DOUBLE / greatest(n, 1) AS score FROM u JOIN k USING (word) GROUP BY book_id, n, pos, category_id, name),
z AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, pos) AS rn FROM c WHERE score >= {MIN_SCORE})"""

ORACLES = {
    "chunk_domain_texts": """WITH b AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR page IS DISTINCT FROM lag(page) OVER w OR chapter IS DISTINCT FROM lag(chapter) OVER w OR item_id IS DISTINCT FROM lag(item_id) OVER w THEN 1 ELSE 0 END AS new FROM chunks WINDOW w AS (PARTITION BY book_id ORDER BY chunk_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY chunk_no) AS domain_no FROM b)
SELECT book_id AS doc_id, domain_no, any_value(page) AS page, any_value(chapter) AS chapter, any_value(item_id) AS item_id, sha256(string_agg(raw_text, ' ' ORDER BY chunk_no) FILTER (raw_text <> '')) AS sha,
 coalesce(first(char_start ORDER BY chunk_no), 0) AS char_start, coalesce(max(char_end), coalesce(first(char_start ORDER BY chunk_no), 0) + length(string_agg(raw_text, ' ' ORDER BY chunk_no) FILTER (raw_text <> ''))) AS char_end
FROM g GROUP BY book_id, domain_no""",
    "dedupe_binary": f"{_HASH} SELECT doc_id, f AS first_key FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY b) AS f FROM h) WHERE doc_id <> f",
    "dedupe_normalized": f"""{_HASH}, f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS rn, first_value(b) OVER (PARTITION BY n ORDER BY doc_id) AS fb FROM h)
SELECT doc_id, rn > 1 AS is_duplicate, CASE WHEN rn > 1 THEN CASE WHEN b = fb THEN 'binary-match' ELSE 'normalized-content-match' END END AS reason FROM f""",
    "incremental_changed": """WITH c AS (SELECT source_path, lower(arg_max(fingerprint, s.run_no)) AS fp FROM index_state s JOIN index_runs r ON r.run_no = s.run_no AND r.status = 'succeeded' GROUP BY source_path)
SELECT DISTINCT f.source_path, lower(f.fingerprint) AS fingerprint FROM file_scans f WHERE fingerprint IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.source_path = f.source_path AND c.fp = lower(f.fingerprint))""",
    "incremental_stats": "SELECT count(*) AS scanned, count(*) FILTER (status = 'succeeded') AS indexed, 0 AS skipped, count(*) FILTER (status <> 'succeeded') AS errors FROM (SELECT DISTINCT run_no, fingerprint, source_path FROM index_state) s JOIN index_runs USING (run_no)",
    "index_state_latest": "SELECT source_path, run_no, mtime_ns, book_id FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY run_no DESC, mtime_ns DESC, book_id DESC) AS rn FROM index_state) WHERE rn = 1",
    "classify_topn": f"{_CLASSIFY} SELECT book_id, category_id, name, round(score, 9) AS score FROM z WHERE rn <= {TOP_N}",
    "books_by_category": f"{_CLASSIFY} SELECT category_id, count(*) AS n_books, min(book_id) AS first_book FROM z WHERE rn <= {TOP_N} GROUP BY category_id",
    "timeline_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "timeline_years": f"WITH {_SPANS} SELECT book_id, year_from, count(*) AS n FROM spans GROUP BY book_id, year_from",
    "timeline_overlap": f"""WITH {_SPANS} SELECT s.book_id, chunk_id, year_from, title FROM spans s JOIN books b ON b.id = s.book_id
WHERE year_from <= 1725 AND year_to >= 1700 ORDER BY year_from, confidence DESC, s.book_id, chunk_id, event_text LIMIT 50""",
    "rag_context": f"""{_RES}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(source_path) ORDER BY rank) AS rd, min(rank) OVER (PARTITION BY query_id, lower(source_path)) AS fr, length(trim(excerpt)) + 140 AS cost FROM r),
o AS (SELECT *, row_number() OVER w AS no, sum(cost) OVER w AS used FROM s WHERE rd <= 2 WINDOW w AS (PARTITION BY query_id ORDER BY rd, fr)),
c AS (SELECT *, max(CASE WHEN (no > 1 AND used > 1200) OR no > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY no) AS cut FROM o)
SELECT query_id, chunk_id, rank FROM c WHERE cut = 0""",
    "rag_gate": f"{_RES} SELECT query_id, count(*) >= 2 AND sum(hybrid_score) >= 0.7 AS sufficient FROM r WHERE rank <= 2 GROUP BY query_id",
    "rag_sources": f"""{_RES} SELECT query_id, CASE WHEN coalesce(title, '') = '' THEN 'Без названия' ELSE title END AS title, CASE WHEN coalesce(author, '') = '' THEN 'Неизвестный автор' ELSE author END AS author, source_path, {_ANSWER_LOC} AS location, min(rank) AS first_rank FROM r GROUP BY 1, 2, 3, 4, 5""",
    "rag_prompt": f"""{_RES}, f AS (SELECT query_id, query_text, rank, '[' || rank || '] title=' || coalesce(nullif(title, ''), 'Без названия') || '; author=' || coalesce(nullif(author, ''), 'Неизвестный автор') || '; source_path=' || source_path || '; location=' || {_ANSWER_LOC} || chr(10) || 'Фрагмент: ' || excerpt AS f FROM r),
u AS (SELECT *, sum(length(f)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM f),
p AS (SELECT query_id, 'Вопрос: ' || query_text || chr(10) || chr(10) || 'Контекст:' || chr(10) || string_agg(f, chr(10) || chr(10) ORDER BY rank) AS prompt FROM u WHERE rank = 1 OR used <= 1500 GROUP BY query_id, query_text)
SELECT query_id, sha256(prompt) AS sha, length(prompt) AS chars FROM p""",
    "dialog_last_n": "SELECT chat, user_id, count(*) AS n, min(event_id) AS oldest FROM (SELECT event_type AS chat, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY chat, user_id",
    "dialog_history": "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS place FROM (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 4",
    "session_active": "SELECT user_id, max(event_id) AS id, arg_max(event_type, event_id) AS chat FROM events GROUP BY user_id",
    "book_page": "SELECT id, '• ' || coalesce(nullif(title, ''), 'Без названия') || ' — ' || coalesce(nullif(author, ''), 'Неизвестный автор') || ' (' || coalesce(nullif(format_name, ''), '?') || ')' AS line, (SELECT count(*) FROM books) AS total FROM books ORDER BY id LIMIT 10 OFFSET 20",
    "search_page": f"{_RES} SELECT query_id, chunk_id, rank FROM r WHERE rank BETWEEN 6 AND 10",
    "upsert_books": "SELECT id, source_path, CASE WHEN contains(source_path, '/upload/') THEN upper(title) ELSE title END AS title FROM books UNION ALL SELECT 1000000000, '/library/new.txt', 'New'",
    "debounce_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1800 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS n FROM b GROUP BY user_id, burst""",
    "ingest_payloads": """WITH k AS (SELECT id, CASE WHEN title IS NULL THEN 'b' WHEN contains(source_path, '/upload/') THEN 'e' ELSE 'g' END AS k FROM books)
SELECT k = 'g' AS ok, CASE WHEN k <> 'g' THEN 'ingest' END AS stage, k = 'g' AS is_duplicate, CASE WHEN k = 'g' THEN 'binary-match' END AS reason, count(*) AS n,
 min(CASE k WHEN 'b' THEN 'the report is no JSON object' WHEN 'e' THEN 'no ' || id END) AS error FROM k GROUP BY 1, 2, 3, 4""",
    "file_arrivals": "SELECT source_path, count(*) AS n FROM file_scans WHERE regexp_matches(lower(string_split(source_path, '/')[-1]), '\\.(pdf|epub|fb2|txt)$') AND NOT regexp_matches(string_split(source_path, '/')[-1], '^[.~]|~$|\\.(tmp|part)\\b') GROUP BY source_path",
    "rag_answers": f"""{_RES}, g AS (SELECT query_id, count(*) >= 2 AND sum(hybrid_score) >= 0.7 AS ok FROM r WHERE rank <= 2 GROUP BY query_id)
SELECT g.query_id, CASE WHEN ok THEN trim(excerpt, ' ' || chr(9) || chr(10) || chr(13)) || ' [1]' ELSE '{NO_DATA}' END AS answer, ok AS confirmed FROM g JOIN r ON r.query_id = g.query_id AND r.rank = 1""",
    "upload_checks": "SELECT CASE WHEN size_bytes > 52428800 THEN 'too large' WHEN NOT regexp_matches(lower(source_path), '\\.(pdf|epub|fb2|txt)$') THEN 'unsupported format' END AS problem, count(*) AS n FROM file_scans GROUP BY 1",
    "file_routes": "SELECT CASE WHEN regexp_matches(lower(source_path), '\\.fb2\\.zip$|\\.fb2$|\\.fbz$') THEN 'fb2' WHEN regexp_matches(lower(source_path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(source_path), '\\.epub$') THEN 'epub' ELSE 'txt' END AS format_name, count(*) AS n FROM file_scans GROUP BY 1",
    "history_cleared": "SELECT user_id % 7 AS chat_id, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE NOT (user_id % 7 = 3 AND user_id = 10) GROUP BY 1",
}
