"""References in documents: links, URLs, versions, packages, trees, symbols.

Each extractor takes documents(path, format, content) and gives one row per
reference: path, type, value, line, raw and what is its own.  Patterns are in
Java's dialect; its \\s and \\b read ASCII space and Unicode words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import AN, BARS, LOW, ANY, DIGITS, H, S, W, maybe
from ..functions.paths import example_path, example_symbol
from ..functions.text import occurrences, trimmed

DOC = ["path", "format", "content"]
MARKDOWN_LINK = r"\[([^\]\[]*)\]\(([^()\s\[\]]+)\)"
RST_LINK = rf"`([^`]+){H}+<([^<>]+)>`_"
ASCIIDOC_LINK = r"link:([^\[\s]+)\[([^\]\[]*)\]"
PLAIN_FILE = rf"^[{AN}_\\/\-]+\.(?:[a-zA-Z]){{1,10}}\z"
LINE_SUFFIX = rf"(?::{DIGITS}(?:-[0-9]*)?|#L{DIGITS}(?:-L?{DIGITS})?)\z"
URL = r"""https?://[^\s>\]"']+"""
TRAILING = ".,;:!?>}]'\""

#: Regex fragments for the names of technologies; a name of several words isn't among them.
TECHNOLOGIES = r"angular cargo django docker express fastapi flask go golang gradle java kubernetes maven mongodb mysql next\.?js node\.?js? npm nuxt pip pnpm postgresql python react redis rust spring terraform typescript vite vue webpack yarn".split()
STOP_WORDS = "array async await boolean class config console const data debug default error export false file function import info let name null number object options path return string true type undefined value var warning".split()

#: Aliases in the order in which a block's language is guessed: the first whose alias occurs anywhere in it.
ALIASES = {"javascript": ["javascript", "js"], "typescript": ["typescript", "ts"], "python": ["python", "py"], "go": ["go", "golang"], "rust": ["rust", "rs"], "java": ["java"], "csharp": ["csharp", "cs", "c#"], "ruby": ["ruby", "rb"], "php": ["php"]}
_TITLE, _ANY, _SNAKE = (f"([{first}][{AN}{rest}]{many})" for first, rest, many in (("A-Z", "", "+"), ("a-zA-Z", "", "+"), ("a-z_", "_", "*")))
_BY_WORD = lambda words, name: [(w, rf"\b{w}{W}{name}") for w in words]
SYMBOLS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", rf"\bclass{W}{_TITLE}"), ("function", rf"\bfunction{W}{_ANY}"), ("const", rf"\bconst{W}{_TITLE}{S}="), ("export", rf"\bexport{W}{maybe('default')}(?:const|function|class){W}{_ANY}")],
    "typescript": [*_BY_WORD(["class", "interface", "type"], _TITLE), ("function", rf"\bfunction{W}{_ANY}"), ("export", rf"\bexport{W}\{{{S}{_TITLE}")],
    "python": [("class", rf"\bclass{W}{_TITLE}"), ("function", rf"\bdef{W}{_SNAKE}")],
    "go": [("struct", rf"\btype{W}{_TITLE}{W}struct"), ("interface", rf"\btype{W}{_TITLE}{W}interface"), ("function", rf"\bfunc{W}{_TITLE}")],
    "rust": [*_BY_WORD(["struct", "enum", "trait"], _TITLE), ("function", rf"\bfn{W}{_SNAKE}")],
    "java": _BY_WORD(["class", "interface", "enum"], _TITLE),
}


def _by_format(docs: DataFrame, rst: str, asciidoc: str, other: str, groups: dict[str, int]) -> DataFrame:
    """Occurrences of the pattern of each document's format, in one scan; none where the format is null."""
    pattern = F.when(F.col("format") == "restructuredtext", rst).when(F.col("format") == "asciidoc", asciidoc).otherwise(other)
    return occurrences(docs.select(*DOC).where("format is not null").withColumn("__by", pattern), "content", F.col("__by"), groups).drop("__by")


def file_links(docs: DataFrame) -> DataFrame:
    """Links to files, by the link syntax of each format, without their line suffix."""
    found = _by_format(docs, RST_LINK, ASCIIDOC_LINK, MARKDOWN_LINK, {"first": 1, "second": 2})
    is_rst, is_adoc = F.col("format") == "restructuredtext", F.col("format") == "asciidoc"
    found = found.withColumns({"link_text": F.when(is_adoc, F.col("second")).otherwise(F.col("first")), "target": F.when(is_adoc, F.col("first")).otherwise(F.col("second"))})
    relative = F.col("target").startswith("../") | F.col("target").startswith("./") | F.col("target").startswith(".\\")
    found = found.where(is_rst | is_adoc | relative | F.col("target").rlike(PLAIN_FILE)).where(~F.col("target").rlike("^(?:https?://|#)"))
    suffix = F.regexp_extract("target", LINE_SUFFIX, 0)
    return found.select(
        "path", "format", F.lit("file-path").alias("type"), F.regexp_replace("target", LINE_SUFFIX, "").alias("value"), "link_text", "line", "raw",
        F.nullif(F.regexp_replace(suffix, "^[:#]L?", ""), F.lit("")).alias("line_ref"), "start",
    )


def clean_url(raw: Column) -> Column:
    """Without trailing punctuation; a closing parenthesis goes only while it has no partner.

    A fold over the trailing run: each step drops one more character or stops.
    """
    tail = F.char_length(F.regexp_extract(raw, r"[.,;:!?>}\]'\")]*\z", 0))
    count = lambda s, ch: F.char_length(s) - F.char_length(F.replace(s, F.lit(ch), F.lit("")))

    def step(url: Column, _: Column) -> Column:
        last, rest = F.right(url, F.lit(1)), F.substring(url, F.lit(1), F.char_length(url) - 1)
        spare = (last == ")") & (count(url, ")") > count(url, "("))
        return F.when(spare | ((last != ")") & (url != "") & (F.instr(F.lit(TRAILING), last) > 0)), rest).otherwise(url)

    return F.when(tail > 0, F.aggregate(F.sequence(F.lit(1), tail), raw, step)).otherwise(raw)


def urls(docs: DataFrame) -> DataFrame:
    found = occurrences(docs.select(*DOC), "content", URL).withColumn("value", clean_url(F.col("raw")))
    return found.where("value <> ''").select("path", "format", F.lit("external-url").alias("type"), "value", "line", "raw", "start")


def versions(docs: DataFrame, technologies: list[str] | None = None) -> DataFrame:
    """Technologies followed by a version; the technologies replace the default ones."""
    # longer names first where one begins another, as alternatives are tried in order
    names = sorted(technologies or TECHNOLOGIES, key=lambda t: (-len(t), t)) if technologies is None else technologies
    pattern = rf"(?i)\b({'|'.join(names)}){W}v?(\d+(?:\.\d+)?(?:\.\d+)?(?:\.x)?)\b"
    found = occurrences(docs.select(*DOC), "content", pattern, {"technology": 1, "version": 2})
    return found.select("path", "format", F.lit("version").alias("type"), F.col("raw").alias("value"), "technology", "version", "line", "raw", "start")


PACKAGES = [("npm", r"`(@[a-z0-9-]+/[a-z0-9-]+)`"), ("npm", rf"`([a-z][{LOW}-]{{2,}})`"), ("go", rf"`(github\.com/[{AN}\-_]+/[{AN}\-_]+)`")]


def packages(docs: DataFrame, ecosystems: tuple[str, ...] = ("npm", "pypi", "crates", "go")) -> DataFrame:
    """Packages in backticks, without common words and file names."""
    rules = [F.struct(F.lit(k).alias("k"), F.lit(e).alias("ecosystem"), F.lit(p).alias("regex")) for k, (e, p) in enumerate(PACKAGES) if e in ecosystems]
    none = F.array().cast("array<struct<k:int,ecosystem:string,regex:string>>")
    each = docs.select(*DOC, F.explode(F.array(*rules) if rules else none).alias("rule")).select(*DOC, "rule.*")
    out = occurrences(each, "content", F.col("regex"), {"value": 1})
    out = out.select("path", "format", F.lit("dependency").alias("type"), "value", "ecosystem", "line", "raw", F.col("k").alias("pattern"), "start")
    return out.where((F.char_length("value") >= 3) & ~F.lower("value").isin(STOP_WORDS) & ~F.col("value").rlike(r"\.[a-z]{2,4}\z"))


FENCE = rf"```(?:\w*)\n({ANY})```"
RST_BLOCK = rf"\.\.{W}code-block::{S}\n\n((?:[ ]{{3,}}+[^\n]*+\n?+)++)"
ASCIIDOC_BLOCK = rf"----\n({ANY})----"


def tree_depth(row: Column) -> Column:
    """Level of a line of a tree: columns before its name, four a level; a bar or branch counts four."""
    lead = F.regexp_extract(row, r"^[ \t│|]*", 0)
    width = F.char_length(F.regexp_replace(lead, r"[^ ]", "")) + 4 * F.char_length(F.regexp_replace(lead, r"[ ]", ""))
    branch = F.when(row.rlike(r"^[ \t│|]*[├└+`]"), 4).otherwise(0)
    return F.floor((width + branch) / 4).cast("int")


def tree_name(row: Column) -> Column:
    """The one path segment on a line, or '' where there is none to take."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(row, rf"^{BARS}*[├└+`][\s─-]*", ""), rf"^{BARS}+", ""))
    name = F.regexp_extract(bare, rf"^([{AN}_\-.@]+)/?\z", 1)
    return F.when((name == "...") | name.rlike(r"^[=\-_~]+\z"), "").otherwise(name)


def tree_paths(block: Column) -> Column:
    """Full paths of a tree's entries, in order: a fold whose state is the stack of ancestors."""
    rows = F.filter(F.transform(F.split(block, "\n"), lambda r: F.struct(tree_depth(r).alias("depth"), tree_name(r).alias("name"))), lambda e: e["name"] != "")
    zero = F.struct(F.array().cast("array<struct<depth:int,name:string>>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda s: s["depth"] < e["depth"]), F.array(e))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.array_join(F.transform(stack, lambda s: s["name"]), "/"))).alias("out"))

    return F.filter(F.aggregate(rows, zero, step, lambda acc: acc["out"]), lambda p: p.contains("/") | (F.char_length(p) >= 3))


def trees(docs: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Paths drawn as trees in code blocks; each has the line of its block."""
    drawn = _by_format(docs, RST_BLOCK, ASCIIDOC_BLOCK, FENCE, {"block": 1}).where(F.col("block").rlike(r"[├│└]|\|--|`--"))
    each = drawn.select("path", "format", "line", "start", F.posexplode(tree_paths(F.col("block"))).alias("entry", "value"))
    return each.select("path", "format", F.lit("directory-structure").alias("type"), "value", "line", F.col("value").alias("raw"), "start", "entry", example_path(F.col("value"), custom).alias("is_illustrative"))


def guessed_language(block: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The first language one of whose aliases occurs anywhere in the lower-case block."""
    low, out = F.lower(block), F.lit("javascript")
    for language, names in reversed(list(aliases.items())):
        hit = F.lit(False)
        for n in names:
            hit = hit | low.contains(n)
        out = F.when(hit, language).otherwise(out)
    return out


def code_symbols(docs: DataFrame, aliases: dict[str, list[str]] | None = None, symbols: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Symbols declared in fenced code, each at the line of its fence."""
    aliases, symbols = aliases or ALIASES, symbols or SYMBOLS
    tags = "|".join(sorted((a for v in aliases.values() for a in v), key=lambda a: -len(a)))
    blocks = occurrences(docs.select(*DOC), "content", rf"(?i)```(?:{tags})\n({ANY})```", {"block": 1}).select("path", "format", "line", F.col("start").alias("at"), F.col("raw").alias("fence"), "block")
    blocks = blocks.withColumn("language", guessed_language(F.col("fence"), aliases)).drop("fence")
    blocks = each_pattern(blocks.withColumnRenamed("line", "fence_line"), symbols)
    found = occurrences(blocks, "block", F.col("regex"), {"value": 1})
    return found.select(
        "path", "format", F.lit("code-pattern").alias("type"), "value", "kind", "language", F.col("fence_line").alias("line"), "raw", "at", "pattern", "start", example_symbol(F.col("value")).alias("is_illustrative")
    )


def each_pattern(df: DataFrame, symbols: dict[str, list[tuple[str, str]]], other: str | None = "javascript") -> DataFrame:
    """df with a row for each pattern of its language: pattern (its place), kind, regex; one scan serves all.

    Languages without patterns take those of `other`, or none.
    """
    rows = {lang: F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(regex).alias("regex")) for kind, regex in of]) for lang, of in symbols.items()}
    chosen = rows[other] if other else F.array().cast("array<struct<kind:string,regex:string>>")
    for lang, array in rows.items():
        chosen = F.when(F.col("language") == lang, array).otherwise(chosen)
    return df.select("*", F.posexplode(chosen).alias("pattern", "__p")).select(*df.columns, "pattern", F.col("__p.kind").alias("kind"), F.col("__p.regex").alias("regex"))


def sections(docs: DataFrame) -> DataFrame:
    """path, ord, heading, text: the text under each '#' heading; what comes first is the Introduction."""
    c = F.col("content")
    rows = F.split(c, "\n")
    step = lambda acc, r: F.when(r.rlike(rf"^#{{1,6}}{H}+\S"), F.concat(acc, F.array(F.struct(F.regexp_replace(r, rf"^#{{1,6}}{H}+", "").alias("heading"), F.array().cast("array<string>").alias("rows"))))).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["heading"].alias("heading"), F.concat(F.element_at(acc, -1)["rows"], F.array(r)).alias("rows"))))
    )
    zero = F.array(F.struct(F.lit("Introduction").alias("heading"), F.array().cast("array<string>").alias("rows")))
    all_ = docs.where("content is not null").select("path", F.posexplode(F.aggregate(rows, zero, step)).alias("ord", "s"))
    return all_.select("path", "ord", F.col("s.heading").alias("heading"), trimmed(F.array_join("s.rows", "\n")).alias("text")).where("ord > 0 or text <> ''")


#: Extractors by the type of their references, in the order of a run.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"file-path": file_links, "external-url": urls, "version": versions, "directory-structure": trees, "code-pattern": code_symbols, "dependency": packages}


def extract(docs: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All references of all documents, columns of other extractors null, with their order: type_ord, start."""
    out = None
    for k, run in enumerate((extractors or EXTRACTORS).values()):
        rows = run(docs).withColumn("type_ord", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
