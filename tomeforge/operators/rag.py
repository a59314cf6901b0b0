"""Context for answers: source-diverse selection, sufficiency gate, prompt, sources, offline answer."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.functions.text import answer_location, canonical_path

PER_SOURCE, MAX_CHUNKS, EXTRA_CHARS = 2, 8, 140
LEAST_RESULTS, LEAST_SUM = 2, 0.7
NO_TITLE, NO_AUTHOR, NO_DATA = "Без названия", "Неизвестный автор", "Недостаточно данных в источниках"


def select_context(hits: DataFrame, budget: int, rank: str = "rank", group: list[str] | None = None, per_source: int = PER_SOURCE, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """hits of each group (a query) in a round over their sources, cut where the budget first overflows; original order kept.

    A group is the result list of one query (at most 100 hits), so its windows are small.
    """
    if budget <= 0 or max_chunks <= 0:
        return hits.where(F.lit(False))
    g = group or []
    part = lambda *extra: Window.partitionBy(*(g or [F.lit(0)]), *extra)
    source = canonical_path(F.col("source_path"))
    rows = hits.withColumn("_s", source).withColumn("_round", F.row_number().over(part("_s").orderBy(rank))).where(F.col("_round") <= per_source)
    rows = rows.withColumn("_first", F.min(rank).over(part("_s"))).withColumn("_cost", F.length(F.trim("excerpt")) + EXTRA_CHARS)
    order = part().orderBy("_round", "_first")
    rows = rows.withColumn("_no", F.row_number().over(order)).withColumn("_used", F.sum("_cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = ((F.col("_no") > 1) & (F.col("_used") > budget)) | (F.col("_no") > max_chunks)
    rows = rows.withColumn("_cut", F.max(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_cut = 0").drop("_s", "_round", "_first", "_cost", "_no", "_used", "_cut")


def sufficient(hits: DataFrame, group: list[str], rank: str = "rank", score: str = "hybrid_score") -> DataFrame:
    """(group, sufficient): at least two scored results whose first two sum to LEAST_SUM."""
    w = Window.partitionBy(*group).orderBy(rank)
    top = hits.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    return top.groupBy(*group).agg(((F.count(F.lit(1)) >= LEAST_RESULTS) & (F.sum(score) >= LEAST_SUM)).alias("sufficient"))


def distinct_sources(hits: DataFrame, group: list[str], rank: str = "rank") -> DataFrame:
    """(group, title, author, source_path, location, first_rank), each once."""
    named = hits.select(*group, F.when(F.coalesce("title", F.lit("")) == "", NO_TITLE).otherwise(F.col("title")).alias("title"), F.when(F.coalesce("author", F.lit("")) == "", NO_AUTHOR).otherwise(F.col("author")).alias("author"), "source_path", answer_location(F.col("page"), F.col("chunk_no")).alias("location"), F.col(rank).alias("_rank"))
    return named.groupBy(*group, "title", "author", "source_path", "location").agg(F.min("_rank").alias("first_rank"))


def prompt(hits: DataFrame, group: list[str], query: str, budget: int, rank: str = "rank") -> DataFrame:
    """(group, prompt): numbered fragments within the budget of their own lengths, then the question."""
    w = Window.partitionBy(*group).orderBy(rank)
    n = F.row_number().over(w)
    title, author = F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE)), F.coalesce(F.nullif("author", F.lit("")), F.lit(NO_AUTHOR))
    fragment = F.concat(F.lit("["), n.cast("string"), F.lit("] title="), title, F.lit("; author="), author, F.lit("; source_path="), F.col("source_path"), F.lit("; location="), answer_location(F.col("page"), F.col("chunk_no")), F.lit("\nФрагмент: "), F.col("excerpt"))
    rows = hits.withColumn("_n", n).withColumn("_f", fragment).withColumn("_used", F.sum(F.length("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where((F.col("_n") == 1) | (F.col("_used") <= budget))
    parts = kept.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", "_f"))).alias("p"))
    return parts.select(*group, F.concat(F.lit("Вопрос: "), F.col(query), F.lit("\n\nКонтекст:\n"), F.concat_ws("\n\n", F.col("p._f"))).alias("prompt"))


class Generator(ABC):
    """What writes an answer from a prompt."""

    @abstractmethod
    def answer(self, prompt: str, lead: str) -> str: ...


class LeadGenerator(Generator):
    """Offline: the first excerpt with its reference."""

    def answer(self, prompt: str, lead: str) -> str:
        return f"{lead.strip()} [1]"


def answer(prompt_text: str, lead: str, enough: bool, generator: Generator | None = None) -> tuple[str, bool]:
    """(answer, confirmed). Too little data or a timeout give the template, another failure the lead excerpt."""
    if not enough:
        return NO_DATA, False
    try:
        return (generator or LeadGenerator()).answer(prompt_text, lead), True
    except TimeoutError:
        return NO_DATA, False
    except Exception:  # noqa: BLE001 - any failure of a service
        return f"{lead.strip()} [1]", True


def answers(prompts: DataFrame, generator: Generator | None = None) -> DataFrame:
    """prompts (prompt, lead, sufficient and any others) with answer and confirmed; the generator runs inside executors."""

    @F.pandas_udf("struct<answer:string,confirmed:boolean>")
    def write(prompt_text: pd.Series, lead: pd.Series, enough: pd.Series) -> pd.DataFrame:
        rows = [answer(p or "", x or "", bool(ok), generator) for p, x, ok in zip(prompt_text, lead, enough)]
        return pd.DataFrame(rows, columns=["answer", "confirmed"])

    kept = [c for c in prompts.columns if c not in ("prompt", "lead", "sufficient")]
    return prompts.select(*kept, write("prompt", "lead", "sufficient").alias("a")).select(*kept, "a.answer", "a.confirmed")
