"""Dialog history, settings, paging and the texts of a front end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.operators.upsert import last_n, upsert

KEEP, ROLES = 20, ("user", "assistant")
EXCERPT_DEFAULT, EXCERPT_LOW, EXCERPT_HIGH = 200, 50, 500


def append(history: DataFrame, messages: DataFrame, keep: int = KEEP) -> DataFrame:
    """history with the valid messages, cut to the newest `keep` of each (chat, user)."""
    valid = messages.where(F.col("role").isin(*ROLES) & F.col("content").isNotNull())
    return last_n(history.unionByName(valid), ["chat_id", "user_id"], [F.desc("id")], keep)


def read_history(history: DataFrame, n: int, group: list[str]) -> DataFrame:
    """The newest n of each group with their place, oldest first."""
    rows = last_n(history, group, [F.desc("id")], n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("id")))


def clear_history(history: DataFrame, chat_id: int, user_id: int) -> DataFrame:
    return history.where(~((F.col("chat_id") == chat_id) & (F.col("user_id") == user_id)))


def set_excerpt_size(settings: DataFrame, user_id: int, size: int) -> DataFrame:
    if not EXCERPT_LOW <= size <= EXCERPT_HIGH:
        raise ValueError(f"the excerpt size must be from {EXCERPT_LOW} to {EXCERPT_HIGH}")
    return upsert(settings, settings.sparkSession.createDataFrame([(user_id, size)], settings.schema), "user_id")


def excerpt_size(settings: DataFrame, user_id: int) -> int:
    row = settings.where(F.col("user_id") == user_id).first()
    return row.excerpt_size if row else EXCERPT_DEFAULT


def book_page(books: DataFrame, page: int, size: int) -> tuple[DataFrame, int]:
    """(page of books by id, total)."""
    return books.orderBy("id").offset(page * size).limit(size), books.count()


def active_sessions(sessions: DataFrame, chat: str = "chat_id", order: str = "created_at") -> DataFrame:
    """The newest session of each chat."""
    return last_n(sessions, [chat], [F.desc(order)], 1)


def book_line() -> Column:
    title, author, kind = (F.coalesce(F.nullif(c, F.lit("")), F.lit(d)) for c, d in (("title", "Без названия"), ("author", "Неизвестный автор"), ("format_name", "?")))
    return F.concat(F.lit("• "), title, F.lit(" — "), author, F.lit(" ("), kind, F.lit(")"))


def answer_text(status: str, text: str | None, sources: list[tuple[str, str, str, str]]) -> str:
    """status line, answer, numbered sources (title, author, path, location)."""
    lines = [status, "", text or "Нет ответа"]
    if sources:
        lines += ["", "Источники:"] + [f"{i}. {t} — {a}; {p}; {w}" for i, (t, a, p, w) in enumerate(sources, 1)]
    return "\n".join(lines)
