"""Queries of the text functions, scans and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions import text as X
from tomeforge.functions.language import FIRST_CHARS, MARGIN, detect_language
from tomeforge.functions.lemma import ENDINGS, learn_dictionary, lemmatize
from tomeforge.functions.rewrite import KEY_TERMS, LEAST_CHARS, LONG_CHARS, LONG_WORDS, SEARCH_TERMS, STOPWORDS, SUBJECT_STEMS, rewrite_columns
from tomeforge.runtime import table
from tomeforge.sources.files import chunks_by_ids as by_ids
from tomeforge.sources.files import extract
from tomeforge.sources.files import iter_chunks as scan_chunks
from tomeforge.sources.files import parse_results as parse_json_results
from tomeforge.sources.files import to_json_rows

MODEL = "hashing-64"
IDS = [1, 7, 42, 99, 256, 10**9]
TOK = "[\\p{L}\\p{N}_]+"


def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("text"))


def doc_sha256(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), X.fingerprint(MODEL, t).alias("fingerprint"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "chunks", ["raw_text"], spread=True).select(F.explode(X.tokens(F.col("raw_text"))).alias("token"))
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def search_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", ["id", "raw_text"], spread=True).select("id", F.size(X.search_terms(F.col("raw_text"))).alias("n_terms"))


def prereform_map(spark: SparkSession, d: str) -> DataFrame:
    """Over the titles spelled in the old way: и as і, е as ѣ, and final ъ after consonants, then back."""
    old = F.regexp_replace(F.translate(F.col("title"), "ие", "іѣ"), r"([бвгджзклмнпрстфхцчшщ])(?=$|[^\p{L}])", "$1ъ")
    return table(spark, d, "books", ["id", "title"]).select("id", X.modern_spelling(old).alias("modern"), X.is_old_spelling(old).alias("was_old"))


def normalize_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normal_text(F.col("text"), F.col("lang")).alias("normal"))


def lemmas_learned(spark: SparkSession, d: str) -> DataFrame:
    """The lemma of every form, learned from the chunks that come with lemmas."""
    return learn_dictionary(table(spark, d, "chunks", ["raw_text", "lemma_text"], spread=True))


def lemmatized_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text"]).withColumn("terms", X.search_terms(X.modern_spelling(F.col("text"))))
    return lemmatize(docs, "doc_id", "terms", learn_dictionary(table(spark, d, "chunks", ["raw_text", "lemma_text"], spread=True)))


def metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(~X.is_metadata_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def display_location(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "books", ["id", "source_path", "title"]).withColumnRenamed("id", "book_id")
    rows = table(spark, d, "chunks").join(books, "book_id")
    place = X.location(F.col("page"), F.col("chapter"), F.col("char_start"), F.col("char_end"))
    return rows.select("id", place.alias("location"), X.display(F.col("title"), F.col("source_path"), place, F.substring("raw_text", 1, 40)).alias("display"), X.answer_location(F.col("page"), F.col("chunk_no")).alias("answer_location"))


def semantic_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", ["id", "raw_text"], spread=True).select("id", X.semantic_excerpt(F.col("raw_text")).alias("excerpt"), X.cut_excerpt(F.col("raw_text")).alias("short"))


def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books", ["id", "source_path"]).select("id", X.canonical_path(F.col("source_path")).alias("path"), X.basename(F.col("source_path")).alias("name"))


def safe_casts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", ["id", "item_id"]).select("id", X.safe_int(F.element_at(F.split("item_id", "-"), -1), -1).alias("item_no"), X.safe_double(F.col("item_id")).alias("item_number"))


def roman_centuries(spark: SparkSession, d: str) -> DataFrame:
    tok = F.regexp_extract_all("raw_text", F.lit(TOK), F.lit(0))
    rows = table(spark, d, "chunks", ["raw_text"], spread=True).select(F.explode(F.filter(tok, lambda t: t.rlike("^[IVX]+$"))).alias("roman"))
    value = rows.groupBy("roman").agg(F.count(F.lit(1)).alias("n")).withColumn("century", X.roman_to_int(F.col("roman")))
    return value.select("roman", "n", "century", X.century_years(F.col("century"))["year_from"].alias("year_from"), X.century_years(F.col("century"))["year_to"].alias("year_to"))


def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hybrid_hits", ["query_id", "query_text"]).distinct()
    r = rewrite_columns(F.col("query_text"))
    return hits.select("query_id", r["normalized"].alias("normalized"), r["search"].alias("search"), F.array_join(r["key_terms"], " ").alias("key_terms"))


def iter_chunks(spark: SparkSession, d: str) -> DataFrame:
    return scan_chunks(table(spark, d, "chunks"), table(spark, d, "books"), limit=100, offset=50).select("id", "book_id", "chunk_no", "source_path", "language")


def iter_all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return scan_chunks(table(spark, d, "chunks"), table(spark, d, "books")).select("id", "book_id", "chunk_no", "source_path", "language")


def chunks_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return by_ids(table(spark, d, "chunks", ["id", "book_id", "chunk_no", "raw_text"], spread=True), IDS)


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """The JSON sink and its reader: what was written comes back."""
    hits = table(spark, d, "hybrid_hits", ["query_id", "source_path", "title", "author", "chunk_id", "chunk_no", "page", "chapter", "excerpt", "hybrid_score", "display"])
    packed = hits.groupBy("query_id").agg(F.to_json(F.struct(F.collect_list(F.struct(*[c for c in hits.columns if c != "query_id"])).alias("results"))).alias("json"))
    return parse_json_results(packed).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.count("page").alias("n_page"), F.min("chunk_id").alias("first_chunk"))


def _as_files(spark: SparkSession, d: str, condition) -> DataFrame:
    """Documents as the files of a folder, <doc_id>.txt."""
    docs = table(spark, d, "documents", ["doc_id", "text", "created_at"]).where(condition)
    return docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("created_at", F.lit(0).cast("timestamp")).alias("modificationTime"), F.encode("text", "UTF-8").alias("content"))


def txt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as text files through the extraction of files: one block per non-blank line with its number and offset."""
    found = extract(_as_files(spark, d, F.col("text").isNotNull()))
    rows = found.select(F.regexp_extract("source_path", r"(\d+)\.txt", 1).cast("long").alias("doc_id"), F.explode("blocks").alias("b"))
    return rows.select("doc_id", "b.item_id", "b.text", "b.char_start")


def fb2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as FictionBook files through the extraction of files: kind is the chapter, the words are its paragraph."""
    docs = table(spark, d, "documents", ["doc_id", "text", "kind"]).where(F.col("text").isNotNull() & F.col("kind").isNotNull())
    words = F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")
    xml = F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?><FictionBook><body><section><title><p>"), F.col("kind"), F.lit("</p></title><p>"), words, F.lit("</p></section></body></FictionBook>"))
    files = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".fb2")).alias("path"), F.lit(0).cast("timestamp").alias("modificationTime"), F.encode(xml, "UTF-8").alias("content"))
    rows = extract(files).select(F.regexp_extract("source_path", r"(\d+)\.fb2", 1).cast("long").alias("doc_id"), F.explode("blocks").alias("b"))
    return rows.select("doc_id", "b.chapter", "b.text")


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", detect_language(F.col("text")).alias("language"))


def normalized_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(X.normalize_text(F.col("text")), 256).alias("hash"))


def results_json(spark: SparkSession, d: str) -> DataFrame:
    return to_json_rows(table(spark, d, "books", ["id", "title", "format_name"]).where(F.col("title").isNotNull() & F.col("format_name").isNotNull()))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_whitespace, doc_sha256, tokenize_counts, search_term_counts, prereform_map, normalize_dispatch, lemmas_learned, lemmatized_documents, metadata_lines, display_location, semantic_excerpt, canonical_paths, safe_casts, roman_centuries,
        query_rewrite, iter_chunks, iter_all_chunks, chunks_by_ids, json_rows, txt_blocks, fb2_blocks, language_detect, normalized_hash, results_json,
    )
}

ACCENTS = f"'{X.LATIN_ACCENTS[0]}', '{X.LATIN_ACCENTS[1]}'"


def tok_sql(col: str) -> str:
    return f"coalesce(regexp_extract_all(translate(replace(lower({col}), 'ё', 'е'), {ACCENTS}), '{TOK}'), [])"


_LOC = """CASE WHEN page IS NOT NULL THEN 'page ' || page WHEN coalesce(chapter, '') <> '' THEN chapter
 WHEN char_start IS NOT NULL AND char_end IS NOT NULL THEN 'position ' || char_start || '-' || char_end ELSE 'position unknown' END"""
_ALL = f"coalesce(regexp_extract_all(lower(text), '{TOK}'), [])"
_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"



ORACLES = {
    "normalize_whitespace": "SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) AS text FROM documents",
    "doc_sha256": f"SELECT doc_id, sha256(text) AS sha, sha256('{MODEL}' || chr(10) || text) AS fingerprint FROM documents",
    "tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tok_sql('raw_text')}) AS token FROM chunks) GROUP BY token",
    "search_term_counts": f"SELECT id, len(list_filter(coalesce(regexp_extract_all(replace(lower(raw_text), 'ё', 'е'), '{TOK}'), []), lambda t: regexp_full_match(t, '[0-9A-Za-zА-Яа-яЁё]+'))) AS n_terms FROM chunks",
    "prereform_map": f"""WITH o AS (SELECT id, regexp_replace(regexp_replace(translate(title, 'ие', 'іѣ') || ' ', '([бвгджзклмнпрстфхцчшщ])([^\\p{{L}}])', '\\1ъ\\2', 'g'), ' $', '') AS old FROM books)
SELECT id, CASE WHEN regexp_matches(old, '[{X.OLD_LETTERS}]') THEN regexp_replace(regexp_replace(translate(old, '{X.OLD_LETTERS}', '{X.NEW_LETTERS}') || ' ', 'ъ([^\\p{{L}}\\p{{N}}_])', '\\1', 'g'), ' $', '') ELSE old END AS modern,
 regexp_matches(old, '[{X.OLD_LETTERS}]') AS was_old FROM o""",
    "normalize_dispatch": f"""SELECT doc_id, CASE WHEN coalesce(lang, 'ru') IN ('kk', 'tt') THEN array_to_string({_ALL}, ' ')
 WHEN lang = 'en' THEN array_to_string(list_filter({_ALL}, lambda t: regexp_full_match(t, '[0-9A-Za-z]+')), ' ')
 ELSE array_to_string(list_filter(coalesce(regexp_extract_all(replace(lower(CASE WHEN regexp_matches(text, '[{X.OLD_LETTERS}]') THEN regexp_replace(translate(text, '{X.OLD_LETTERS}', '{X.NEW_LETTERS}') || ' ', 'ъ([^\\p{{L}}\\p{{N}}_])', '\\1', 'g') ELSE text END), 'ё', 'е'), '{TOK}'), []), lambda t: regexp_full_match(t, '[0-9A-Za-zА-Яа-яЁё]+')), ' ') END AS normal FROM documents""",
    "metadata_lines": "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '^(?i)(title|author|название|автор)\\s*:') GROUP BY doc_id",
    "display_location": f"""SELECT c.id, {_LOC} AS location, CASE WHEN coalesce(title, '') <> '' THEN title ELSE string_split(source_path, '/')[-1] END || ' — ' || {_LOC} || ' — ' || substring(raw_text, 1, 40) AS display,
 CASE WHEN page IS NOT NULL THEN 'стр. ' || page ELSE 'позиция ' || (greatest(chunk_no, 0) + 1) END AS answer_location FROM chunks c JOIN books b ON b.id = c.book_id""",
    "semantic_excerpt": f"SELECT id, CASE WHEN length({strip_sql('raw_text')}) > 300 THEN {strip_sql('substring(' + strip_sql('raw_text') + ', 1, 297)')} || '...' ELSE {strip_sql('raw_text')} END AS excerpt, substring(raw_text, 1, 200) || '...' AS short FROM chunks",
    "canonical_paths": "SELECT id, lower(replace(source_path, '/', chr(92))) AS path, string_split(source_path, '/')[-1] AS name FROM books",
    "safe_casts": "SELECT id, coalesce(try_cast(string_split(item_id, '-')[-1] AS INTEGER), -1) AS item_no, try_cast(item_id AS DOUBLE) AS item_number FROM chunks",
    "roman_centuries": f"""WITH t AS (SELECT unnest(list_filter(regexp_extract_all(raw_text, '{TOK}'), lambda t: regexp_full_match(t, '[IVX]+'))) AS roman FROM chunks),
g AS (SELECT roman, count(*) AS n, list_transform(string_split(roman, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 ELSE 10 END) AS v FROM t GROUP BY roman),
s AS (SELECT roman, n, list_sum(list_transform(v, lambda x, i: CASE WHEN i < len(v) AND x < v[i + 1] THEN -x ELSE x END))::INTEGER AS century FROM g)
SELECT roman, n, century, (century - 1) * 100 + 1 AS year_from, century * 100 AS year_to FROM s""",
    "query_rewrite": f"""WITH q AS (SELECT DISTINCT query_id, trim(regexp_replace(query_text, '\\s+', ' ', 'g')) AS normalized FROM hybrid_hits),
w AS (SELECT *, list_transform(regexp_extract_all(normalized, '[0-9A-Za-zА-Яа-яЁё]+'), lambda x: lower(x)) AS words FROM q),
k AS (SELECT *, list_filter(words, lambda x, i: length(x) >= {LEAST_CHARS} AND NOT list_contains({STOPWORDS!r}, x) AND list_position(words, x) = i) AS kept FROM w),
s AS (SELECT *, list_slice(list_concat(list_filter(kept, lambda x: regexp_matches(x, '{"|".join(SUBJECT_STEMS)}')), list_filter(kept, lambda x: NOT regexp_matches(x, '{"|".join(SUBJECT_STEMS)}'))), 1, {KEY_TERMS}) AS keys FROM k)
SELECT query_id, normalized, CASE WHEN (len(words) >= {LONG_WORDS} OR length(normalized) >= {LONG_CHARS}) AND len(keys) > 0 THEN array_to_string(list_slice(keys, 1, {SEARCH_TERMS}), ' ') ELSE normalized END AS search, array_to_string(keys, ' ') AS key_terms FROM s""",
    "iter_chunks": "SELECT c.id, c.book_id, c.chunk_no, b.source_path, b.language FROM chunks c JOIN books b ON b.id = c.book_id ORDER BY c.id LIMIT 100 OFFSET 50",
    "chunks_by_ids": f"SELECT id, book_id, chunk_no, raw_text FROM chunks WHERE id IN ({', '.join(map(str, IDS))})",
    "json_rows": "SELECT source_path, count(*) AS n, count(page) AS n_page, min(chunk_id) AS first_chunk FROM hybrid_hits WHERE coalesce(source_path, '') <> '' AND coalesce(display, '') <> '' GROUP BY source_path",
    "txt_blocks": f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), ' ' || chr(10)), '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, l FROM l)
SELECT doc_id, 'line-' || no AS item_id, {strip_sql('l[no]')} AS text, (coalesce(list_sum(list_transform(list_slice(l, 1, no - 1), lambda s: length(s) + 1)), 0) + length(l[no]) - length(regexp_replace(l[no], '^{_BLANK}', '')))::INTEGER AS char_start
FROM x WHERE {strip_sql('l[no]')} <> ''""",
    "results_json": """SELECT '{"id":' || id || ',"title":' || to_json(title) || ',"format_name":' || to_json(format_name) || '}' AS json FROM books WHERE title IS NOT NULL AND format_name IS NOT NULL""",
    "lemmas_learned": f"""WITH p AS (SELECT list_filter(coalesce(regexp_extract_all(replace(lower(raw_text), 'ё', 'е'), '{TOK}'), []), lambda t: regexp_full_match(t, '[0-9A-Za-zА-Яа-яЁё]+')) AS r,
 list_filter(coalesce(regexp_extract_all(replace(lower(lemma_text), 'ё', 'е'), '{TOK}'), []), lambda t: regexp_full_match(t, '[0-9A-Za-zА-Яа-яЁё]+')) AS l FROM chunks),
f AS (SELECT unnest(r) AS form, unnest(l) AS lemma FROM p WHERE len(r) = len(l)), c AS (SELECT form, lemma, count(*) AS n FROM f GROUP BY form, lemma)
SELECT form, lemma FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, lemma DESC) AS rn FROM c) WHERE rn = 1""",
    "iter_all_chunks": "SELECT c.id, book_id, chunk_no, source_path, language FROM chunks c JOIN books b ON b.id = c.book_id",
}
_STEM = "CASE WHEN length({0}) > 4 THEN regexp_replace({0}, '" + ENDINGS + "', '') ELSE {0} END"
_TERMS = "list_filter(coalesce(regexp_extract_all(replace(lower({0}), 'ё', 'е'), '" + TOK + "'), []), lambda t: regexp_full_match(t, '[0-9A-Za-zА-Яа-яЁё]+'))"
_MODERN = f"CASE WHEN regexp_matches(text, '[{X.OLD_LETTERS}]') THEN regexp_replace(regexp_replace(translate(text, '{X.OLD_LETTERS}', '{X.NEW_LETTERS}') || ' ', 'ъ([^\\p{{L}}\\p{{N}}_])', '\\1', 'g'), ' $', '') ELSE text END"
_COUNT = "(length(t) - length(translate(t, '{0}', '')))"
ORACLES |= {
    "lemmatized_documents": f"""WITH words AS ({ORACLES["lemmas_learned"]}),
stems AS (SELECT {_STEM.format("form")} AS stem, min(lemma) AS by_stem FROM words GROUP BY 1),
d AS (SELECT doc_id, {_TERMS.replace("{0}", "(" + _MODERN + ")")} AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS form, unnest(range(len(w))) AS pos FROM d),
m AS (SELECT doc_id, pos, coalesce(lemma, by_stem, f.form) AS lemma FROM f LEFT JOIN words ON words.form = f.form LEFT JOIN stems ON stems.stem = {_STEM.format("f.form")})
SELECT d.doc_id, coalesce(string_agg(lemma, ' ' ORDER BY pos), '') AS lemma_text FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""",
    "language_detect": f"""WITH t AS (SELECT doc_id, lower(substring(trim(coalesce(text, ''), ' '), 1, {FIRST_CHARS})) AS t FROM documents),
c AS (SELECT doc_id, length(regexp_replace(t, '[^a-z]', '', 'g')) AS la, length(regexp_replace(t, '[^\\x{{0400}}-\\x{{04ff}}]', '', 'g')) AS cy, {_COUNT.format("қғұі")} AS kk, {_COUNT.format("җ")} AS tt, {_COUNT.format("әөүңһ")} AS both_ FROM t)
SELECT doc_id, CASE WHEN la + cy = 0 OR abs(la - cy) < {MARGIN} * (la + cy) THEN 'ru' WHEN la > cy THEN 'en' WHEN kk + tt + both_ > 0.02 * cy AND kk > tt AND kk > 0.2 * (kk + tt + both_) THEN 'kk' WHEN kk + tt + both_ > 0.02 * cy THEN 'tt' ELSE 'ru' END AS language FROM c""",
    "fb2_blocks": """SELECT doc_id, kind AS chapter, trim(regexp_replace(kind || ' ' || regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL AND kind IS NOT NULL""",
}
