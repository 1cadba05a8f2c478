"""Indexes of source code: symbols, exports, signatures, interface keys, comments.

Each takes code(path, content, language); matches are by pattern over the
whole text, so those in comments and strings count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ANY, ARGS, LET, N, NAME, S, W, maybe
from ..functions.text import enclosed, lines_at_depth_zero, occurrences, top_level_parts, trimmed
from .extract import _ANY, _BY_WORD, _SNAKE, _TITLE, each_pattern

EXTENSIONS = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
SNIPPET_EXTENSIONS = {k: v for k, v in EXTENSIONS.items() if v not in ("rust", "java")}
IGNORED = ["**/*.test.*", "**/*.spec.*", "**/*.d.ts", "**/node_modules/**", "**/vendor/**"]
SNIPPET_IGNORED = [*IGNORED, "**/dist/**", "**/build/**"]
_JS = [("function", rf"\bexport{W}{maybe('async')}function{W}{_ANY}"), ("const", rf"\bexport{W}const{W}{_TITLE}"), ("function", rf"\bfunction{W}{_ANY}")]
DECLARED: dict[str, list[tuple[str, str]]] = {
    "javascript": [*_BY_WORD(["class"], _TITLE), *_JS],
    "typescript": [*_BY_WORD(["class", "interface"], _TITLE), ("type", rf"\btype{W}{_TITLE}{S}="), *_JS],
    "python": [*_BY_WORD(["class"], _TITLE), ("function", rf"\bdef{W}{_SNAKE}")],
    "go": [("struct", rf"\btype{W}{_TITLE}{W}struct"), ("interface", rf"\btype{W}{_TITLE}{W}interface"), ("function", rf"\bfunc{W}(?:\([^)]+\){W})?{_TITLE}")],
    "rust": [*_BY_WORD(["struct", "enum", "trait"], _TITLE), ("function", rf"\bpub{W}fn{W}{_SNAKE}"), ("function", rf"\bfn{W}{_SNAKE}")],
    "java": _BY_WORD(["class", "interface", "enum"], _TITLE),
}


def language_of(path: Column, table: dict[str, str] = EXTENSIONS) -> Column:
    """By extension; unknown ones count as JavaScript."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))), F.lit("javascript"))


def symbols(code: DataFrame) -> DataFrame:
    """symbol, file_path, kind, language, pattern, start of every declaration; one may be found by two patterns."""
    rows = each_pattern(code.select("path", "language", "content"), DECLARED, None)
    found = occurrences(rows, "content", F.col("regex"), {"symbol": 1})
    return found.select("symbol", F.col("path").alias("file_path"), "kind", "language", "pattern", "start")


def exports(code: DataFrame) -> DataFrame:
    """path, symbol: what each file offers to others, distinct."""
    c = F.col("content")
    every = lambda p, k=1: F.regexp_extract_all(c, F.lit(p), F.lit(k))
    public = lambda names: F.filter(names, lambda n: ~n.startswith("_"))
    python = public(F.concat(every(rf"(?m)^{maybe('async')}def{W}({NAME}){S}\("), every(rf"(?m)^class{W}({NAME})\b"), every(rf"(?m)^({NAME}){S}=")))
    items = lambda p, cut: F.flatten(F.transform(every(p), lambda body: F.transform(F.split(body, ","), lambda x: trimmed(F.get(F.split(trimmed(x), cut), F.lit(0))))))
    direct = every(rf"export{W}{maybe('default')}{maybe('async')}(?:class|const|enum|function|interface|let|type|var){W}{N}")
    named, cjs = items(rf"export{S}\{{([^}}]+)\}}", rf"{W}as{W}"), items(rf"module\.exports{S}={S}\{{([^}}]+)\}}", rf"{S}:")
    default = every(rf"export{W}default{W}{N}{S}[;\n]")
    declared = every(rf"export{W}default{W}{maybe('async')}(?:function|class)\b(?:{W}{N})?")
    flag = F.when((F.size(default) > 0) | (F.size(declared) > 0), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    script = F.concat(direct, named, default, declared, cjs, flag)
    names = F.array_distinct(F.filter(F.when(F.col("language") == "python", python).otherwise(script), lambda n: n != ""))
    return code.select("path", F.explode(names).alias("symbol"))


def _parameters(raw: Column, language: Column) -> Column:
    """array<struct<name, free>>: free parameters need no argument."""
    script = language != "python"
    parts = top_level_parts(raw, "(<[{", ")>]}", keep_empty=True)
    name = lambda p: F.when(script, F.regexp_extract(p, rf"^(?:\.\.\.)?{N}", 1)).otherwise(F.regexp_extract(p, rf"^\*{{0,2}}{N}", 1))
    # a default is a '=' outside brackets that begins no arrow
    flat = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"=>", "~"), r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    free = lambda p: p.startswith("...") | p.startswith("*") | (script & p.rlike(rf"^\w+{S}\?")) | F.regexp_replace(flat(p), r"[(\[{<].*", "").contains("=")
    return F.filter(F.transform(parts, lambda p: F.struct(name(p).alias("name"), free(p).alias("free"))), lambda s: s["name"] != "")


def signatures(code: DataFrame) -> DataFrame:
    """name, params, required, file_path, pattern, start of functions in JavaScript, TypeScript and Python."""
    script = [("function", rf"{maybe('export')}{maybe('async')}function{W}{N}{S}{ARGS}"), ("arrow", rf"{maybe('export')}{LET}{W}{N}{S}={S}{maybe('async')}{ARGS}[^{{;]*=>")]
    rows = each_pattern(code.select("path", "language", "content"), {"javascript": script, "typescript": script, "python": [("def", rf"def{W}{N}{S}{ARGS}")]}, None)
    found = occurrences(rows, "content", F.col("regex"), {"name": 1, "raw_params": 2})
    found = found.withColumn("p", _parameters(F.col("raw_params"), F.col("language")))
    # once one is free, none after it is required
    needed = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(False).alias("seen")), lambda acc, x: F.struct((acc["n"] + F.when(x["free"] | acc["seen"], 0).otherwise(1)).alias("n"), (acc["seen"] | x["free"]).alias("seen")), lambda acc: acc["n"])
    names = F.transform("p", lambda x: x["name"])
    own = (F.col("language") == "python") & F.coalesce(F.get(names, F.lit(0)).isin("self", "cls"), F.lit(False))
    return found.select(
        "name", F.when(own, F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names).alias("params"),
        F.when(own, F.greatest(needed - 1, F.lit(0))).otherwise(needed).alias("required"), F.col("path").alias("file_path"), "pattern", "start",
    )


def interface_keys(code: DataFrame) -> DataFrame:
    """type_name, key: keys of TypeScript's interfaces and object types, those of one name together."""
    heads = [("interface", rf"{maybe('export')}interface{W}{N}(?:{W}extends{W}[\w,\s<>]+)?{S}\{{"), ("type", rf"{maybe('export')}type{W}{N}{S}={S}\{{")]
    rows = each_pattern(code.select("path", "language", "content"), {"typescript": heads}, None)
    found = occurrences(rows, "content", F.col("regex"), {"type_name": 1})
    body = enclosed(F.substring("content", F.col("start") + F.char_length("raw"), F.char_length("content")), "{", "}")
    keys = F.filter(F.transform(lines_at_depth_zero(body), lambda r: F.regexp_extract(r, rf"^(?:readonly{W})?{N}\??{S}:", 1)), lambda k: k != "")
    return found.select("type_name", F.explode(keys).alias("key")).distinct()


_LINE, _BLOCK, _DOC = ("line", r"//[^\n]*"), ("block", rf"/\*{ANY}\*/"), ("doc", rf"/\*\*{ANY}\*/")
#: Patterns in the order in which a file is read by each; Rust's doc lines are found twice.
COMMENTS: dict[str, list[tuple[str, str]]] = {
    "javascript": [_DOC, _LINE], "typescript": [_DOC, _LINE], "go": [_LINE, _BLOCK], "java": [_DOC, _LINE],
    "python": [("docstring", rf'"""{ANY}"""'), ("line", r"#[^\n]*")], "rust": [("doc", r"///[^\n]*"), _LINE],
}
NEXT_SYMBOL = rf"(?:async|class|const|def|fn|func|function|interface|let|struct|type|var){W}{N}"


def comments(code: DataFrame) -> DataFrame:
    """path, kind, text, symbol, start: comments without their marks, and the next name declared after they begin."""
    rows = each_pattern(code.select("path", "language", "content"), COMMENTS, "javascript")
    found = occurrences(rows, "content", F.col("regex"))
    bare = F.col("raw")
    for mark in (r"^/\*\*|\*/\z", r"(?m)^///?", r"(?m)^#", rf"(?m)^{S}\*\s?"):
        bare = F.regexp_replace(bare, mark, "")
    after = F.regexp_extract(F.substring("content", F.col("start") + 1, F.char_length("content")), NEXT_SYMBOL, 1)
    return found.select("path", "language", "kind", trimmed(bare).alias("text"), F.when(after == "", "unknown").otherwise(after).alias("symbol"), "pattern", "start").where("text <> ''")
