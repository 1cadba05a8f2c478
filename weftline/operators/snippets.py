"""References inside code snippets: imports, calls, configuration keys.

Lines are those of the fence plus the place in the block counted from 0, so
one less than where a reader finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import QUOTED, ANY, H, LET, N, NAME, S, W
from ..functions.text import enclosed, lines_at_depth_zero, occurrences, top_level_parts, trimmed
from .extract import DOC, each_pattern

LANGUAGES = {"javascript": "javascript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "typescript": "typescript", "ts": "typescript", "tsx": "typescript", "python": "python", "py": "python", "go": "go", "golang": "go"}
#: Names before a parenthesis that are no calls of the project: keywords, built-ins, test functions.
NO_CALLS = set(
    """and as assert async await break case catch class const continue def default delete do elif else except export finally for from func function if import in instanceof is lambda let new not or pass raise return super switch this throw try typeof var void while with yield of self cls None True False
    Array Boolean Buffer Date Error JSON Map Math Number Object Promise RegExp Request Response Set String URL URLSearchParams clearInterval clearTimeout console decodeURI encodeURI fetch isFinite isNaN parseFloat parseInt require setInterval setTimeout
    abs all any bool classmethod delattr dict dir enumerate filter float format getattr hasattr hash id input int isinstance issubclass len list map max min open print property range repr reversed round set setattr sorted staticmethod str sum tuple type zip
    afterAll afterEach beforeAll beforeEach describe expect it jest mock spy test vi append close copy make panic println recover Errorf Printf Println Sprintf""".split()
) - {"as"}
JS_IMPORT = rf"""(?m)^{H}*import{H}+(?:type{H}+)?([^'"\n]*?[^ \t'"\n]){H}+from{H}+{QUOTED}"""
REQUIRE = rf"""{LET}{H}+(?:\{{([^{{}}]*)\}}|{N}){H}*={H}*require\({H}*{QUOTED}{H}*\)"""
PY_IMPORT = rf"from{W}([\w.]+){W}import{W}(.+)"
GO_IMPORT, GO_GROUP = rf'import{W}"([^"]+)"', rf"import{H}*\(([^()]*)\)"
CALL = rf"\b({NAME}){S}\("
NOT_BEFORE = rf"\b(?:class|def|function|interface|new|type|typeof){S}\z"
TYPED_OBJECT, TYPED_CALL = rf"{LET}{W}\w+{S}:{S}([A-Z]\w+){S}={S}\{{", rf"\b(?:{NAME})<([A-Z]\w+)>{H}*\({H}*\{{"
COLUMNS = ["path", "type", "kind", "value", "line", "raw", "language", "link_text", "import_specifiers", "argument_names", "at", "step", "start"]


def blocks(docs: DataFrame) -> DataFrame:
    """path, fence_line, at, language, block of the fences in a known language."""
    found = occurrences(docs.select(*DOC), "content", rf"```{N}\n({ANY})```", {"tag": 1, "block": 2})
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return found.select("path", F.col("line").alias("fence_line"), F.col("start").alias("at"), F.try_element_at(table, F.lower("tag")).alias("language"), "block").where("language is not null")


def _named(list_: Column) -> Column:
    """Names of a comma list without their aliases and empty ones."""
    return F.filter(F.transform(F.split(list_, ","), lambda s: trimmed(F.substring_index(trimmed(s), " as ", 1))), lambda s: s != "")


def _tagged(names: Column, tag: str) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(tag + ":"), n))


def _rows(df: DataFrame, step: int | Column, **cols: Column) -> DataFrame:
    base = {"type": F.lit("code-snippet"), "line": F.col("fence_line") + F.col("line") - 1, "link_text": F.lit(None).cast("string"), "import_specifiers": F.lit(None).cast("array<string>"), "argument_names": F.lit(None).cast("array<string>"), "step": F.lit(step)} | cols
    return df.select(*[base[c].alias(c) if c in base else F.col(c) for c in COLUMNS])


#: Patterns of imports with their steps, by language; one scan tries all that a block needs.
IMPORTS = {"javascript": [("0", JS_IMPORT), ("1", REQUIRE)], "python": [("2", PY_IMPORT)], "go": [("3", GO_IMPORT), ("4", GO_GROUP)]}
IMPORTS["typescript"] = IMPORTS["javascript"]


def _each_step(code: DataFrame, patterns: dict[str, list[tuple[str, str]]], groups: dict[str, int]) -> DataFrame:
    """Occurrences of a block's patterns, with the step of each; empty groups behind a pattern make up for those it lacks."""
    padded = {lang: [(step, regex + "()" * max(groups.values())) for step, regex in of] for lang, of in patterns.items()}
    rows = each_pattern(code, padded, None).withColumn("step", F.col("kind").cast("int")).drop("pattern", "kind")
    return occurrences(rows, "block", F.col("regex"), groups).drop("regex")


def imports(code: DataFrame) -> DataFrame:
    """Imports of blocks: relative ones of JavaScript and TypeScript, all of Python and Go."""
    found = _each_step(code, IMPORTS, {"g1": 1, "g2": 2, "g3": 3})
    is_ = lambda k: F.col("step") == k
    es, cjs, py, one, group = (is_(k) for k in range(5))
    # a group of Go's imports is a row for each of its modules
    many = F.when(group, F.regexp_extract_all("g1", F.lit(r'"([^"]+)"'), F.lit(1))).otherwise(F.array(F.when(es, F.col("g2")).when(cjs, F.col("g3")).otherwise(F.col("g1"))))
    found = found.select("*", F.posexplode(many).alias("k", "module"))
    near = F.col("module").startswith(".") | F.col("module").startswith("/")
    found = found.where(~(es | cjs) | near)
    none = F.array().cast("array<string>")
    what = trimmed(F.col("g1"))
    braces = F.instr(what, "{")
    inner = lambda c: trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), r"^\{", ""), r"\}\z", ""))
    named = F.when(braces > 0, _named(inner(F.substring(what, braces, F.char_length(what))))).otherwise(none)
    first = trimmed(F.regexp_replace(trimmed(F.when(braces > 0, F.substring(what, F.lit(1), braces - 1)).otherwise(what)), r",\z", ""))
    default = F.filter(F.array(first), lambda s: s != "")
    star, space = what.startswith("*"), F.regexp_extract(what, rf"^\*{W}as{W}{N}\z", 1)
    symbols = F.when(star, none).otherwise(F.concat(default, named))
    specs = F.when(star, F.when(space != "", F.array(F.concat(F.lit("namespace:"), space))).otherwise(none)).otherwise(F.concat(_tagged(default, "default"), _tagged(named, "named")))
    keys = F.filter(F.transform(F.split("g1", ","), lambda s: trimmed(F.substring_index(trimmed(s), ":", 1))), lambda s: s != "")
    plain, names = F.col("g1") == "", _named(F.col("g2"))
    found = found.withColumns({
        "__text": F.when(es, F.array_join(symbols, ",")).when(cjs, F.array_join(F.when(plain, none).otherwise(keys), ",")).when(py, F.array_join(names, ",")),
        "__specs": F.when(es, specs).when(cjs, F.when(plain, F.array(F.lit("module:*"))).otherwise(_tagged(keys, "named"))).when(py, _tagged(names, "named")),
        "raw": F.when(group, F.concat(F.lit('import "'), F.col("module"), F.lit('"'))).otherwise(F.col("raw")),
        "start": F.col("start") + F.col("k"),
    })
    return _rows(found, F.col("step"), kind=F.lit("import"), value=F.col("module"), link_text=F.col("__text"), import_specifiers=F.col("__specs"))


def calls(code: DataFrame) -> DataFrame:
    """Calls with the number of their arguments, and their names if all are bare.

    The argument list runs on over lines to its closing parenthesis; strings
    are not understood; an open one is dropped.  link_text is the arity.
    """
    found = occurrences(code, "block", CALL, {"name": 1})
    # one line holds the name and its parenthesis
    found = found.where(~F.col("raw").contains("\n") & ~F.col("name").isin(sorted(NO_CALLS)))
    before = F.regexp_extract(F.substring("block", F.greatest(F.col("start") - 19, F.lit(1)), F.least(F.col("start"), F.lit(20))), r"[^\n]*\z", 0)
    found = found.where(~before.endswith(".") & ~before.rlike(NOT_BEFORE))
    tail = F.substring("block", F.col("start") + F.char_length("raw"), F.char_length("block"))
    found = found.withColumn("inner", enclosed(tail, "(", ")")).where("inner is not null")
    parts = top_level_parts(F.col("inner"), "([{", ")]}")
    found = found.withColumn("parts", F.when(trimmed(F.col("inner")) == "", F.array().cast("array<string>")).otherwise(parts))
    bare = F.transform("parts", lambda p: F.regexp_extract(p, rf"^(?:\.\.\.)?({NAME})\z", 1))
    return _rows(found, 5, kind=F.lit("function-call"), value=F.col("name"), raw=F.regexp_replace("raw", r"\(\z", ""), link_text=F.size("parts").cast("string"), argument_names=F.when(F.forall(bare, lambda n: n != ""), bare))


def config_keys(code: DataFrame) -> DataFrame:
    """Keys of object literals with a type: one reference with all keys of the outer level."""
    rows = [("6", TYPED_OBJECT), ("7", TYPED_CALL)]
    found = _each_step(code, {"javascript": rows, "typescript": rows}, {"type_name": 1})
    body = enclosed(F.substring("block", F.col("start") + F.char_length("raw"), F.char_length("block")), "{", "}")
    keyed = F.transform(lines_at_depth_zero(body), lambda r: F.when(r.rlike(rf"^\w+{S}\??:"), F.regexp_extract(r, rf"^{N}", 1)).otherwise(F.regexp_extract(r, rf"^(?!(?:true|false|null|undefined)\b){N}{S}[,}}]?{S}\z", 1)))
    found = found.withColumn("keys", F.array_distinct(F.filter(keyed, lambda k: k != ""))).where("size(keys) > 0")
    joined = F.concat(F.col("type_name"), F.lit(" { "), F.array_join("keys", ", "), F.lit(" }"))
    return _rows(found, F.col("step"), kind=F.lit("config-keys"), value=F.array_join("keys", ","), raw=joined, link_text=F.col("type_name"))


def snippets(docs: DataFrame) -> DataFrame:
    code = blocks(docs)
    return imports(code).unionByName(calls(code)).unionByName(config_keys(code))
