"""Lexical paths and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for a reader's own; tested on each segment of a path.
EXAMPLE_START = "bar baz demo dummy example fake foo mock my sample stub test your".split()
EXAMPLE_PATHS = [
    f"(?i)^(?:{'|'.join(EXAMPLE_START)})",
    r"(?i)^(?:another|first|new|second|some|third)\.",
    r"(?i)^(?:qux|quux)\z",
    r"<[^<>]+>",
    r"\{[^{}]+\}",
]
UI_NAMES = "About App Button Card Chat Contact Dashboard Footer Form Header Home Input Item List Login Menu Modal Nav Page Profile Settings Sidebar Signup".split()
EXAMPLE_SYMBOLS = [
    f"(?i)^(?:{'|'.join(EXAMPLE_START)})[a-z]",
    r"^(?:DELETE|GET|PATCH|POST|PUT)\z",
    r"^[a-z]{1,2}\z",
    f"^(?:{'|'.join(UI_NAMES)})\\z",
]


def normalized(path: Column) -> Column:
    """Absolute lexical form of an absolute path: no '.', '..', doubled or trailing slashes."""
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    )
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def resolved(base: Column, path: Column) -> Column:
    """path against the directory base, unless it is absolute."""
    return normalized(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def parent(path: Column) -> Column:
    """Directory part; '' of a bare name, '/' of a name at the root."""
    return F.when(path.rlike("^/[^/]*\\z"), F.lit("/")).when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def within_root(path: Column, root: str) -> Column:
    """Whether a normalised path is root or below it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def document_dir(root: str, doc_path: Column) -> Column:
    return normalized(F.concat(F.lit(root + "/"), doc_path, F.lit("/..")))


def example_path(path: Column, custom: tuple[str, ...] = ()) -> Column:
    patterns = EXAMPLE_PATHS + ["(?i)" + p for p in custom]
    hit = lambda s: F.rlike(s, F.lit("|".join(f"(?:{p})" for p in patterns)))
    return F.exists(F.split(path, "/"), hit)


def example_symbol(name: Column, custom: tuple[str, ...] = ()) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in EXAMPLE_SYMBOLS + ["(?i)" + p for p in custom]))


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob with **, *, ? and {a,b}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-2] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + ("\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return "^" + out + "\\z"


def included(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a path fits one of the include globs and none of the others."""
    if not include:
        return F.lit(False)
    yes = path.rlike("|".join(glob_regex(g) for g in include))
    return yes & ~path.rlike("|".join(glob_regex(g) for g in exclude)) if exclude else yes
