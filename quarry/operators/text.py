"""Operators over lines, strings and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row (key, line_no from 1, line) for each line of *text*."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def line_range(text: str, first: int, last: int) -> Column:
    """Lines *first* to *last* (from 1, clamped) of a text column, joined again."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def first_match(subject: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (fragment, label) whose fragment the subject contains."""
    out = None
    for fragment, label in rules:
        hit = subject.contains(fragment)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def occurrences(text: Column, fragment: str) -> Column:
    """How often *fragment* stands in *text*, not overlapping."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(fragment), F.lit("")))) / len(fragment)).cast("long")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def sanitized(name: Column) -> Column:
    """An identifier: dots, angle brackets, spaces, hyphens and slashes become underscores."""
    return F.translate(name, ".<> -/", "______")


def camel_words(name: Column, least: int = 3) -> Column:
    """Lower-case words of a camelCase or spaced name that have at least *least* letters."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z]+"), lambda x: F.length(x) >= least)


def last_part(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def module_path(path: Column) -> Column:
    """The last three folders of a path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.array_join(F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), 3), "/")
