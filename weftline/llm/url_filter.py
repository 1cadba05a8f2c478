"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into the bits of a few words (Shift-And): the state
before symbol i of a rule is a bit, a '*' is a loop on the bit before it.
Each character of the canonical URL, host and path, moves all rules at once:
    D = ((D << 1 | carry) & B[c]) | (D & LOOP)
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

BITS = 63
#: Up to so many words are written out one by one; a table of more is gone through.
UNROLLED = 8
#: A table of globs may hold so many characters: each takes a bit in 129 masks.
MOST_SYMBOLS = 200_000
FULL = (1 << BITS) - 1
OTHER = 128
#: What follows '%' where it stands for an ASCII letter, a digit or one of -._~
ESCAPED = "^(?:2[dDeE]|3[0-9]|[46][1-9a-fA-F]|[57][0-9aA]|5[fF]|7[eE])"

#: (host, path, verdict): fits the host and its subdomains and the paths that begin so; the longest wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Globs over the canonical URL for what no rule decides: a match blocks.
BLOCKED = ("*spam*", "*cheap-pills*", "*casino*", "*adult*", "*/ads/*", "*.onion", "*.onion/*")


@dataclass
class Automaton:
    """Masks of all globs: words of 63 bits."""

    start: list[int]
    loop: list[int]
    step: list[list[int]]  # by character code, OTHER for any beyond ASCII
    accept: list[int]  # of each glob, one bit over all words


def _symbols(glob: str) -> tuple[list[str], set[int]]:
    """Symbols ('?' for any one character) and the states with a loop."""
    out, loops = [], set()
    for c in glob:
        if c == "*":
            loops.add(len(out))
        else:
            out.append(c)
    return out, loops


def compile_globs(globs: list[str]) -> Automaton:
    """Packs globs of literals, '?' and '*' one after another, over word ends too."""
    at, start, loop, accept = 0, 0, 0, []
    step = [0] * (OTHER + 1)
    for glob in globs:
        symbols, loops = _symbols(glob)
        start |= 1 << at
        for i in loops:
            loop |= 1 << (at + i)
        for i, c in enumerate(symbols):
            for code in range(OTHER + 1) if c == "?" else [min(ord(c), OTHER)]:
                step[code] |= 1 << (at + i + 1)
        at += len(symbols)
        accept.append(at)
        at += 1
    words = max(1, -(-at // BITS))
    cut = lambda x: [(x >> (BITS * w)) & FULL for w in range(words)]
    return Automaton(cut(start), cut(loop), [cut(s) for s in step], accept)


def _constant(values: list) -> Column:
    """An array of numbers that the optimizer folds into one constant, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>" if values and isinstance(values[0], list) else "array<bigint>")


def run_automaton(a: Automaton, text: Column) -> Column:
    """Array of words: the states after the last character of text."""
    words = len(a.start)
    table_, begin, loop = _constant(a.step), _constant(a.start), _constant(a.loop)

    def move(d: Column, c: Column) -> Column:
        code = F.ascii(c)
        row = table_[F.when((code < 0) | (code >= OTHER), OTHER).otherwise(code)]
        if words > UNROLLED:
            def word(w: Column) -> Column:
                carry = F.when(w > 0, F.shiftright(F.get(d, w - 1), BITS - 1)).otherwise(F.lit(0).cast("long"))
                shifted = F.shiftleft(F.get(d, w).bitwiseAND(F.lit(FULL >> 1)), 1).bitwiseOR(carry)
                return shifted.bitwiseAND(F.get(row, w)).bitwiseOR(F.get(d, w).bitwiseAND(F.get(loop, w)))

            return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)
        out = []
        for w in range(words):
            shifted = F.shiftleft(d[w].bitwiseAND(F.lit(FULL >> 1)), 1)
            if w:
                shifted = shifted.bitwiseOR(F.shiftright(d[w - 1], BITS - 1))
            out.append(shifted.bitwiseAND(row[w]).bitwiseOR(d[w].bitwiseAND(F.lit(a.loop[w]).cast("long"))))
        return F.array(*out)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, begin, move)


def accepted(states: Column, bit: int) -> Column:
    return F.shiftright(states[bit // BITS], bit % BITS).bitwiseAND(F.lit(1)) == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and without '://'."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path in the form that globs are held against.

    Escapes of ASCII letters, digits and -._~ are read, A-Z become lower case,
    and the segments . and .. are resolved, in this order; the rest stays.
    """
    pieces = F.split(path, "%")
    code = lambda p: F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
    read = lambda p: F.when(p.rlike(ESCAPED), F.concat(F.chr(code(p)), F.substring(p, F.lit(3), F.char_length(p)))).otherwise(F.concat(F.lit("%"), p))
    plain = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), read), ""))
    segments = F.split(F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "/")
    step = lambda s, x: F.when(x == "..", F.regexp_replace(s, r"(?s)/[^/]*\z", "")).when(x == ".", s).otherwise(F.concat(s, F.lit("/"), x))
    return F.concat(host, F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), segments[0], step))


def globs_of(table_: DataFrame) -> list[str]:
    """The distinct globs of a table(glob), null left out; an error where they exceed MOST_SYMBOLS characters."""
    globs = table_.where("glob is not null").select("glob").distinct()
    total = globs.agg(F.sum(F.char_length("glob") + 1).alias("n")).first()["n"] or 0
    if total > MOST_SYMBOLS:
        raise ValueError(f"{total} characters of globs; at most {MOST_SYMBOLS} fit the masks")
    return sorted(r["glob"] for r in globs.collect())


def judge(pages: DataFrame, *, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict for every row, in one pass without exchange.

    A rule is two globs, 'host/path*' and '*.host/path*', where a host in
    itself never holds '/': the path starts after it.  Rules' verdicts come
    first, the longest first; else a match of a blocked glob (a sequence, or a
    table with a column glob) with the canonical URL blocks, and the rest is
    allowed, null and broken urls included.  Null page_ids and repeated rows
    are judged like others, urls of any length whole; rules of equal length (a
    tie) go by their text; other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    if isinstance(blocked, DataFrame):
        blocked = globs_of(blocked)
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    # '\x00' parts host and path, so that a rule's host can't be found in a path
    a = compile_globs([g for h, p, _ in ranked for g in (f"{h}\0{p}*", f"*.{h}\0{p}*")])
    b = compile_globs(list(blocked))
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    plain = F.translate(canonical(F.col("host"), F.col("path")), "\0", " ")
    marked = F.concat(F.translate("host", "\0", " "), F.lit("\0"), F.translate("path", "\0", " "))
    out = out.withColumns({"__rules": run_automaton(a, marked), "__globs": run_automaton(b, plain)})
    rule, verdict = F.lit(None).cast("string"), F.when(sum([F.when(accepted(F.col("__globs"), x), 1).otherwise(0) for x in b.accept], F.lit(0)) > 0, "block").otherwise("allow")
    for i, (h, p, v) in reversed(list(enumerate(ranked))):
        fits = accepted(F.col("__rules"), a.accept[2 * i]) | accepted(F.col("__rules"), a.accept[2 * i + 1])
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP10_SQL = r"""
with p as (
  select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), c as (
  select *, string_split(path, '%') as cut from q
), d as (
  select * exclude (cut), string_split(translate(cut[1] || array_to_string(list_transform(cut[2:], lambda p:
      case when regexp_matches(p, '""" + ESCAPED + r"""') then chr(('0x' || substr(p, 1, 2))::int) || substr(p, 3) else '%' || p end), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/') as segments from c
), e as (
  select * exclude (segments), host || list_reduce(segments, lambda s, x: case when x = '..' then regexp_replace(s, '/[^/]*$', '') when x = '.' then s else s || '/' || x end) as canonical from d
), r as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule
  from e
)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow'
    when rule is not null then 'block'
    when regexp_matches(canonical, '(?s)spam|cheap-pills|casino|adult|/ads/|\.onion(/|$)') then 'block' else 'allow' end as verdict
from r
"""
