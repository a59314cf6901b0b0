"""Temporal expressions of texts as year spans, and queries over them; built-ins only.

A text is cut once into runs of word characters and the runs between them.  Each run is classified by itself and by its
neighbours: two years with a dash between them are a range; a round year with the ending of an ordinal, a decade; any
other year, itself; a Roman numeral, or two with a dash, before a word for century, a century.  The scan goes from left
to right and continues behind what it accepted, so no two spans overlap and a range comes before the years in it.

Defined results: null and empty texts have no span; a range written backwards is turned; repeated rows give repeated
spans; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import TOKEN, century_years, roman_to_int

CONTEXT_CHARS, MIN_CONFIDENCE = 30, 0.6
SURE = {"range": 0.95, "year": 0.9, "decade": 0.7, "century": 0.6}

# The words that count.
DASHES = ["-", "–", "—"]
DECADE_WORDS = ["год", "года", "годы"]
CENTURY_WORDS = "вв?|век[а-яё]{0,4}|столетии?"
NEAR_WORDS = ["около", "примерно", "приблизительно"]

RUNS = TOKEN + "|" + TOKEN.replace("[", "[^")
#: Years from 1000 to 2029; numerals up to 39.
FIRST_YEAR, LAST_YEAR, LAST_CENTURY = 1000, 2029, 39


def numerals(last: int = LAST_CENTURY) -> list[str]:
    """The Roman numerals from 1 to `last`."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    return ["X" * (n // 10) + ones[n % 10] for n in range(1, last + 1)]


def _year(run: Column) -> Column:
    """The year a run of four digits names, else null."""
    n = F.when(run.rlike("^[0-9]{4}$"), run.cast("int"))
    return F.when(n.between(FIRST_YEAR, LAST_YEAR), n)


def _decade(run: Column) -> Column:
    """The first year of the decade before 2000 that a run of digits names, else null."""
    y = _year(run)
    return F.when((y < 2000) & (y % 10 == 0), y)


def _century(run: Column) -> Column:
    up = F.upper(run)
    return F.when(up.isin(numerals()), roman_to_int(up))


def _dash(run: Column) -> Column:
    return F.trim(F.translate(run, "\t\r\n", "   ")).isin(DASHES)


def _span(kind: str, low: Column, high: Column, size: Column | int, decade: Column | None = None, century: Column | None = None) -> Column:
    null = F.lit(None).cast("int")
    return F.struct(
        F.lit(kind).alias("kind"), low.cast("int").alias("year_from"), high.cast("int").alias("year_to"), (null if decade is None else decade).cast("int").alias("decade"),
        (null if century is None else century).cast("int").alias("century"), (F.lit(size) if isinstance(size, int) else size).cast("int").alias("size"),
    )


def _span_at(runs: Column, i: Column) -> Column:
    """What begins at run i (from 0): struct of kind, years and the number of runs it takes; null if nothing does."""
    run = lambda k: F.coalesce(F.get(runs, i + k), F.lit(""))
    low, high, round_year = _year(run(0)), _year(run(2)), _decade(run(0))
    dashed = (F.lower(run(2)) == "е") & run(1).isin(DASHES[:2])
    joined_year = F.when(F.lower(run(0)).endswith("е"), _decade(F.substring(run(0), 1, 4)))
    named = lambda k: F.lower(run(k + 1)).isin(DECADE_WORDS) & run(k).rlike(r"^[\s-]+$")
    one, two = _century(run(0)), _century(run(2))
    worded = lambda k: run(k).rlike(r"^\s+$") & F.lower(run(k + 1)).rlike(f"^(?:{CENTURY_WORDS})$")
    many = one.isNotNull() & two.isNotNull() & _dash(run(1)) & worded(3)
    first_years, last_years = century_years(one), century_years(two)
    return (
        F.when(low.isNotNull() & high.isNotNull() & _dash(run(1)), _span("range", F.least(low, high), F.greatest(low, high), 3))
        .when(round_year.isNotNull() & dashed, _span("decade", round_year, round_year + 9, F.when(named(3), 5).otherwise(3), decade=round_year))
        .when(joined_year.isNotNull() & (F.length(run(0)) == 5), _span("decade", joined_year, joined_year + 9, F.when(named(1), 3).otherwise(1), decade=joined_year))
        .when(low.isNotNull(), _span("year", low, low, 1))
        .when(many, _span("century", first_years["year_from"], last_years["year_to"], 5, century=one))
        .when(one.isNotNull() & worded(1), _span("century", first_years["year_from"], first_years["year_to"], 3, century=one))
    )


def _places(runs: Column) -> Column:
    """The runs that may begin a span: only these are looked at with their neighbours."""
    return F.filter(F.transform(runs, lambda r, i: F.when(r.rlike("^(?:[0-9]{4}[еЕ]?|[IVXivx]+)$"), i)), lambda i: i.isNotNull())


def _accepted(found: Column) -> Column:
    """Of array<struct<at, s>> by `at` those that begin behind the end of the one accepted before."""
    start = F.struct(F.filter(found, lambda x: F.lit(False)).alias("out"), F.lit(0).alias("free"))
    step = lambda state, x: F.when(x["at"] >= state["free"], F.struct(F.concat(state["out"], F.array(x)).alias("out"), (x["at"] + x["s"]["size"]).alias("free"))).otherwise(state)
    return F.aggregate(found, start, step, lambda state: state["out"])


def _shown(runs: Column, x: Column) -> Column:
    fragment = F.array_join(F.slice(runs, x["at"] + 1, x["s"]["size"]), "")
    first = F.greatest(x["at"] - CONTEXT_CHARS, F.lit(0))  # a run has a character at least, so as many runs hold the context
    before = F.lower(F.right(F.array_join(F.slice(runs, first + 1, x["at"] - first), ""), F.lit(CONTEXT_CHARS)))
    near = F.arrays_overlap(F.regexp_extract_all(before, F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, NEAR_WORDS)))
    kind = x["s"]["kind"]
    sure = F.create_map(*[F.lit(v) for kv in SURE.items() for v in kv])[kind]
    return F.struct(*[x["s"][c].alias(c) for c in ("year_from", "year_to", "decade", "century")], fragment.alias("fragment"), (kind.isin("decade", "century") | near).alias("is_approximate"), sure.alias("confidence"))


def extract(chunks: DataFrame, text: str = "raw_text", least: float = 0.0) -> DataFrame:
    """(book_id, chunk_id, year_from, ..., event_text, source_fragment, is_approximate, confidence) of all chunks."""
    keys = ["book_id", "chunk_id"]
    some = chunks.where(F.col(text).rlike(f"[0-9]{{4}}|[IVXivx](?:\\s|[-–—])")).select("book_id", F.col("id").alias("chunk_id"), F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)).alias("runs"))
    # generators keep the optimiser from repeating the runs and spans in every expression that reads them
    runs = some.select(*keys, F.explode(F.array("runs")).alias("runs"))
    found = runs.select(*keys, "runs", F.explode(F.array(F.transform(_places(F.col("runs")), lambda i: F.struct(i.alias("at"), _span_at(F.col("runs"), i).alias("s"))))).alias("f"))
    taken = found.select(*keys, "runs", F.explode(_accepted(F.filter("f", lambda x: x["s"].isNotNull()))).alias("x"))
    rows = taken.select(*keys, _shown(F.col("runs"), F.col("x")).alias("s"))
    fields = [F.col(f"s.{c}").alias(c) for c in ("year_from", "year_to", "decade", "century")]
    return rows.select(*keys, *fields, F.col("s.fragment").alias("event_text"), F.col("s.fragment").alias("source_fragment"), F.col("s.is_approximate").alias("is_approximate"), F.col("s.confidence").alias("confidence")).where(F.col("confidence") >= least)


def overlapping(events: DataFrame, books: DataFrame, low: int, high: int, limit: int = 50) -> DataFrame:
    """Events that touch [low, high] with their books, earliest first, then surest."""
    hit = events.where((F.col("year_from") <= high) & (F.col("year_to") >= low))
    return hit.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id").orderBy("year_from", F.desc("confidence"), "book_id", "chunk_id", "event_text").limit(limit)
