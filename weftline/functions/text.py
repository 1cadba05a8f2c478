"""Occurrences of patterns with their places, in built-in expressions only.

One regexp_replace sets marks around the matches and between their groups, and
the text is cut at the marks; so match i starts where gaps 0..i and matches
0..i-1 end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = "array<struct<start:int,line:int>>"


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def places(matches: Column, gaps: Column) -> Column:
    """(start, line) of each match: 0-based character, 1-based line."""
    none = F.array().cast(PLACES)

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.char_length(F.get(gaps, i))
        line = acc["line"] + newlines(F.get(gaps, i))
        here = F.array(F.struct(start.alias("start"), line.alias("line")))
        return F.struct(F.concat(acc["out"], here).alias("out"), (start + F.char_length(F.get(matches, i))).alias("pos"), (line + newlines(F.get(matches, i))).alias("line"))

    zero = F.struct(none.alias("out"), F.lit(0).alias("pos"), F.lit(1).alias("line"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda acc: acc["out"])).otherwise(none)


#: Marks are a run of FILL, longer than any in the text, between two of MATCH or of GROUP: no text holds one, nor makes one with its neighbours.
FILL, MATCH, GROUP = "\x01", "\x02", "\x03"


def occurrences(df: DataFrame, text: str, pattern: str | Column, groups: dict[str, int] | None = None) -> DataFrame:
    """One row per match: df's columns, ord, start, line, raw, and the named groups ('' where unmatched).

    Rows without a match are filtered on rlike before any array is built, the
    others are searched once.  The pattern may be a column, so that one pass
    tries many patterns.
    """
    c, p, names = F.col(text), F.lit(pattern) if isinstance(pattern, str) else pattern, list(groups or {})
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"{FILL}+"), F.lit(0)), lambda run: F.char_length(run))
    found = df.where(F.rlike(c, p)).withColumn("__f", F.repeat(F.lit(FILL), F.when(c.contains(FILL), F.array_max(runs) + 1).otherwise(1)))
    mark = lambda at: F.concat(F.lit(at), "__f", F.lit(at))
    each = [x for k in (groups or {}).values() for x in (mark(GROUP), F.lit(f"${k}"))]
    found = found.withColumn("__p", F.split(F.regexp_replace(c, p, F.concat(mark(MATCH), F.lit("$0"), *each, mark(MATCH))), mark(MATCH), -1))
    # gaps and matches take turns
    found = found.withColumn("__m", F.transform(F.sequence(F.lit(1), F.size("__p") - 2, F.lit(2)), lambda i: F.split(F.get("__p", i), mark(GROUP), -1)))
    gaps = F.transform(F.sequence(F.lit(0), F.size("__p") - 1, F.lit(2)), lambda i: F.get("__p", i))
    found = found.withColumns({"__g": gaps, "__r": F.transform("__m", lambda m: F.get(m, F.lit(0)))})
    each = found.select(*df.columns, F.posexplode(F.arrays_zip(F.col("__m").alias("m"), places(F.col("__r"), F.col("__g")).alias("place"))).alias("ord", "__o"))
    return each.select(*df.columns, "ord", F.col("__o.place.start").alias("start"), F.col("__o.place.line").alias("line"), *[F.get("__o.m", F.lit(k)).alias(n) for k, n in enumerate(["raw", *names])])


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def first_index(text: Column, opening: str, closing: str) -> Column:
    """0-based index of the bracket that closes the one at the start of text, or null.

    A pattern finds what is nested at most three deep, in few parts; a fold
    over the brackets that only counts does for the rest.  Text starts with
    `opening`.
    """
    o, c = f"\\{opening}", f"\\{closing}"
    other = f"[^{o}{c}]"
    nested = f"{o}{other}*+{c}"
    for _ in range(2):
        nested = f"{o}(?:{other}++|{nested}){{0,50}}+{c}"
    short = F.char_length(F.regexp_extract(text, f"^{nested}", 0))
    either = F.lit(f"[{o}{c}]")
    marks, gaps = F.regexp_extract_all(text, either, F.lit(0)), F.split(text, either, -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["gap"])
        depth = acc["depth"] + F.when(x["mark"] == opening, 1).when(x["mark"] == closing, -1).otherwise(0)
        end = F.coalesce(acc["end"], F.when((x["mark"] == closing) & (depth == 0), at))
        return F.struct((at + 1).alias("at"), depth.alias("depth"), end.alias("end"))

    return F.when(short > 0, short - 1).otherwise(F.aggregate(F.arrays_zip(gaps.alias("gap"), marks.alias("mark")), zero, step, lambda acc: acc["end"]))


def enclosed(text: Column, opening: str, closing: str) -> Column:
    """What stands between the bracket at the start of text and its partner; null if unclosed."""
    return F.transform(F.array(first_index(text, opening, closing)), lambda end: F.substring(text, F.lit(2), end - 1))[0]


def top_level_parts(text: Column, openings: str, closings: str, keep_empty: bool = False) -> Column:
    """Parts between commas outside brackets, trimmed; empty ones are left out unless kept inside."""
    either = F.lit("[," + "".join(f"\\{ch}" for ch in openings + closings) + "]")
    pieces = F.arrays_zip(F.split(text, either, -1).alias("gap"), F.regexp_extract_all(text, either, F.lit(0)).alias("mark"))
    zero = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"), F.lit(0).alias("depth"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.coalesce(x["mark"], F.lit(""))
        depth = acc["depth"] + F.when(mark.isin(*openings), 1).when(mark.isin(*closings), -1).otherwise(0)
        cut = (mark == ",") & (depth == 0)
        part = trimmed(F.concat(acc["cur"], x["gap"]))
        kept = F.when(cut & (F.lit(keep_empty) | (part != "")), F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"])
        return F.struct(kept.alias("parts"), F.when(cut, F.lit("")).otherwise(F.concat(acc["cur"], x["gap"], mark)).alias("cur"), depth.alias("depth"))

    def finish(acc: Column) -> Column:
        part = trimmed(acc["cur"])
        return F.when(part != "", F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"])

    return F.aggregate(pieces, zero, step, finish)


def lines_at_depth_zero(body: Column) -> Column:
    """Trimmed non-empty lines of a braces' body that begin outside inner braces."""
    rows = F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("depth"))
    count = lambda x, ch: F.char_length(x) - F.char_length(F.replace(x, F.lit(ch), F.lit("")))

    def step(acc: Column, row: Column) -> Column:
        out = F.when(acc["depth"] == 0, F.concat(acc["out"], F.array(row))).otherwise(acc["out"])
        return F.struct(out.alias("out"), (acc["depth"] + count(row, "{") - count(row, "}")).alias("depth"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])
