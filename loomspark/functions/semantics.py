"""Number and text rules that the operators share, in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c: str | Column) -> Column:
    """Two decimals; halves go up, also below zero."""
    return F.floor(col(c) * 100 + 0.5) / 100


def or_else(c: str | Column, default) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


#: All characters of Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: str | Column) -> Column:
    """Without any Unicode white space at either end; only the ends are looked at."""
    return F.btrim(col(c), F.lit(WHITE))


def squeeze(c: str | Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return trim_all(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def percent(part: Column, whole: Column) -> Column:
    """round2 of 100 * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, round2(part * 100.0 / whole)).otherwise(F.lit(0.0))


def iso_week(ts: str | Column) -> Column:
    t = col(ts)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def slug(c: str | Column, custom: bool = False) -> Column:
    """A file name: the first 30 characters in lower case, or a custom name as it is, with other characters as '-'."""
    text = col(c) if custom else F.lower(F.substring(col(c), 1, 30))
    text = F.regexp_replace(text, r"[^a-zA-Z0-9]+", "-" if not custom else "_")
    return F.regexp_replace(text, r"^[-_]+|[-_]+$", "")


def format_cost(c: str | Column) -> Column:
    x = col(c)
    return F.when(x == 0, "$0.00").when(x < 0.01, "<$0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", F.floor(x * 100 + 0.5) / 100)))


def to_label(c: str | Column) -> Column:
    """snake_case to words whose first letters are capitals; other letters stay."""
    words = F.split(col(c), "_")
    return F.concat_ws(" ", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))))


#: Most rows of a table that is sent whole to every task.
MOST_ROWS = 10_000


def short(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A table marked for broadcasting if it has at most ``most`` rows, which is counted; a longer one stays distributed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
