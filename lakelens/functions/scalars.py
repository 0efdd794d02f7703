"""Column functions over ids, dates, texts and rankings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_month(month: Column) -> Column:
    """The id-month (YYMM) after another."""
    yy, mm = F.substring(month, 1, 2).cast("int"), F.substring(month, 3, 2).cast("int")
    return F.when(mm == 12, F.format_string("%02d01", yy + 1)).otherwise(F.format_string("%02d%02d", yy, mm + 1))


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def cap_words(text: Column, n: int) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, n), " ")


def overlaps(start: Column, end: Column, first: int | None, last: int | None) -> Column:
    """Ranges that touch first..last; either bound may be open."""
    out = F.lit(True)
    if first is not None:
        out = out & (end >= first)
    if last is not None:
        out = out & (start <= last)
    return out


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (rank + k)


def gain(rank: Column) -> Column:
    """The discounted gain of a hit at a rank from 1."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def id_year(pid: Column) -> Column:
    """The year that an id (YYMM.number) begins with; 90 and later are of the last century."""
    yy = F.substring(pid, 1, 2).cast("int")
    return F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)


def paper_year(published: Column, pid: Column) -> Column:
    """Of the ISO date, else of the id."""
    return F.when(published != "", F.substring(published, 1, 4).cast("int")).otherwise(id_year(pid))


def paper_day(published: Column, pid: Column) -> Column:
    """YYYYMMDD of the ISO date, else the first day of the year."""
    digits = F.regexp_replace(F.substring(published, 1, 10), "-", "").try_cast("int")
    return F.when(F.length(published) >= 10, digits).otherwise(paper_year(published, pid) * 10000 + 101)
