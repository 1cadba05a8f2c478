"""Edit distance, likeness of names, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer, ignoring case; 1 for two empty strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def singular(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.char_length(word) - n)
    return (
        F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("es") & ~word.endswith("ses") & ~word.endswith("xes"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def entry_likeness(a: Column, b: Column) -> Column:
    """How alike two lower-case directory entries are: equal stems, singulars, else the ratio."""
    x, y = stem(a), stem(b)
    sx, sy = singular(x), singular(y)
    return F.when(x == y, 1.0).when((sx == sy) | (sx == y) | (x == sy), 0.95).otherwise(ratio(x, y))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either vector is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def half_up(x: Column) -> Column:
    """Rounded to the next integer, halves upward."""
    return F.floor(x + 0.5).cast("long")


def major(version: Column) -> Column:
    """First number of a version, or null."""
    return F.nullif(F.regexp_extract(version, r"(?<!\d)(\d{1,16})(?!\d)", 1), F.lit("")).cast("long")
