"""Cursor and truthiness semantics as Column expressions, kept in one place.

Message ids are strings that compare as numbers.  "Truthy" follows the data
model: null and '' are absent for strings, null and 0 for numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of queue items that still have work, and of entries that are incomplete.
ACTIVE = ("queued", "catching_up", "retry")
INCOMPLETE = ("partial", "queued", "catching_up", "error")
INCOMPLETE_PREVIEW = ("partial", "queued", "catching_up")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x: Column | str) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(col(x), F.lit(""))


def or_default(x: Column | str, default: int) -> Column:
    """A number with 0 and null replaced."""
    return F.coalesce(F.nullif(col(x), F.lit(0)), F.lit(default))


def id_number(x: Column | str) -> Column:
    """An id as a number; 0 if it isn't an integer (null, '1.5', '1_0' and what exceeds 64 bits too)."""
    c = col(x)
    return F.coalesce(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint")), F.lit(0).cast("bigint"))


def newest_cursor(*xs: Column | str) -> Column:
    """The truthy id with the largest number, the first one on ties; null if there is none.

    Each argument is there a few times only, so that nested uses stay small.
    """
    ranked = [F.when(truthy(x).isNotNull(), F.struct(id_number(x).alias("num"), F.lit(-k).alias("place"), col(x).alias("id"))) for k, x in enumerate(xs)]
    return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["id"]


def first_cursor(*xs: Column | str) -> Column:
    """The first truthy id, whichever is larger."""
    return F.coalesce(*(truthy(x) for x in xs))


def durable_cursor() -> Column:
    """The newest of an entry's two cursors."""
    return newest_cursor("last_written_message_id", "last_message_id")


def written_cursor() -> Column:
    """An entry's written cursor, else its compatibility cursor."""
    return first_cursor("last_written_message_id", "last_message_id")


def parse_day(x: Column | str) -> Column:
    """The date in the first ten characters, null if they aren't one."""
    c = F.left(col(x), F.lit(10))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
