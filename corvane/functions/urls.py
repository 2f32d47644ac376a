"""Addresses, titles and dates of pages as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import col


def closed_path(c: Column | str) -> Column:
    """With a leading and a trailing slash."""
    led = F.when(F.substring(col(c), 1, 1) == "/", col(c)).otherwise(F.concat(F.lit("/"), col(c)))
    return F.when(F.substring(led, -1, 1) == "/", led).otherwise(F.concat(led, F.lit("/")))


def page_url(path: Column | str, index_names: list[str]) -> Column:
    """The address of a file by its path under the content root: an index file stands for its folder."""
    name, parent = F.regexp_extract(col(path), r"([^/]*)$", 1), F.regexp_replace(col(path), r"/?[^/]*$", "")
    bare = F.when(name.isin(index_names), parent).otherwise(F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*$", ""))
    return closed_path(F.replace(F.concat(F.lit("/"), bare), F.lit("//"), F.lit("/")))


def dated_url(path: Column | str, index_names: list[str]) -> Column:
    """Like page_url, but a dated file under _posts/ gets an address by date."""
    post = r"^_posts/(?:.*/)?(\d{4})-(\d{2})-(\d{2})-([^/]+?)(?:\.[^./]*)?$"
    return F.when(col(path).rlike(post), F.regexp_replace(col(path), post, r"/$1/$2/$3/$4/")).otherwise(page_url(path, index_names))


def file_title(path: Column | str) -> Column:
    stem = F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.translate(stem, "-_", "  ")


def normal_path(c: Column | str) -> Column:
    """A path to compare by: without scheme and host (then also without query and fragment), single slashes, lower case."""
    absolute = F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), absolute).otherwise(col(c))
    path = F.regexp_replace(F.concat(F.lit("/"), F.trim(path)), "/+", "/")
    return F.lower(F.when(F.char_length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path))


def year_month(date: Column | str) -> tuple[Column, Column]:
    """(year, month) of a date written YYYY or YYYY-MM…; month is null unless 1 to 12."""
    d = col(date)
    year = F.when(d.rlike(r"^\d{4}"), F.substring(d, 1, 4)).try_cast("int")
    month = F.when(F.octet_length(d) >= 7, F.substring(d, 6, 2)).try_cast("int")
    return year, F.when(month.between(1, 12), month)


def recency(date: Column | str, now: float, most: float = 0.18, half_life: float = 4.0) -> Column:
    """1 + most * 2^(-age in years / half_life); 1 where the date can't be read, June where it has no month. now is a year."""
    year, month = year_month(date)
    then = year + (F.coalesce(month, F.lit(6)) - F.lit(0.5)) / F.lit(12.0)
    age = F.when(then > F.lit(now), F.lit(0.0)).otherwise(F.lit(now) - then)
    return F.coalesce(F.lit(1.0) + F.lit(most) * F.pow(F.lit(2.0), -age / F.lit(half_life)), F.lit(1.0))
