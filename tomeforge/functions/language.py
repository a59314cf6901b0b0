"""A quick language guess among kk, ru, tt, en by letters; unknown or unsure texts count as Russian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_CHARS = 3000
#: Share of the winner over the runner-up below which the guess is not trusted.
MARGIN = 0.1


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def detect_language(text: Column) -> Column:
    t = F.lower(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, FIRST_CHARS))
    latin = F.length(F.regexp_replace(t, "[^a-z]", ""))
    cyrillic = F.length(F.regexp_replace(t, "[^\\u0400-\\u04ff]", ""))
    kazakh, tatar, shared = _count(t, "қғұі"), _count(t, "җ"), _count(t, "әөүңһ")
    letters = latin + cyrillic
    native = kazakh + tatar + shared
    turkic = native > 0.02 * cyrillic
    return (
        F.when(letters == 0, "ru")
        .when(F.abs(latin - cyrillic) < MARGIN * letters, "ru")
        .when(latin > cyrillic, "en")
        .when(turkic & (kazakh > tatar) & (kazakh > 0.2 * native), "kk")
        .when(turkic, "tt")
        .otherwise("ru")
    )
