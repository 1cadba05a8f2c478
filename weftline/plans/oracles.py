"""SQL for DuckDB that gives the rows of the registered queries.

The patterns are those of RE2, without look-around; matches and gaps are the
lists from which places are summed.
"""

from __future__ import annotations

from ..functions.paths import EXAMPLE_START, UI_NAMES
from ..functions.patterns import ANY, NAME, PKG, TAKEN, N, S, W, maybe
from ..operators.extract import ALIASES, ASCIIDOC_BLOCK, LINE_SUFFIX, PACKAGES, RST_BLOCK, RST_LINK, STOP_WORDS, SYMBOLS, TECHNOLOGIES
from ..operators.index import DECLARED
from ..operators.snippets import GO_GROUP, GO_IMPORT, JS_IMPORT, PY_IMPORT, REQUIRE
from ..operators.validate import GET_FIRST
from ..sources.corpora import with_corpora

NL = "(length({x}) - length(replace({x}, chr(10), '')))"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(source: str, cols: str, pattern: str, groups: dict[str, int] | None = None, text: str = "content") -> str:
    """Subquery: a row per match with ord, raw, line, start and the groups; pattern is an SQL expression."""
    groups = groups or {}
    lists = "".join(f", regexp_extract_all({text}, {pattern}, {k}) AS g_{n}" for n, k in groups.items())
    picks = "".join(f", g_{n}[i] AS {n}" for n in groups)
    return f"""(SELECT {cols}, i - 1 AS ord, ms[i] AS raw,
      1 + list_sum(list_transform(gs[1:i], lambda x: {NL.format(x='x')}))::bigint + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: {NL.format(x='x')})), 0)::bigint AS line,
      list_sum(list_transform(gs[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::bigint AS start{picks}
    FROM (SELECT *, regexp_extract_all({text}, {pattern}) AS ms, string_split_regex({text}, {pattern}) AS gs{lists} FROM {source} WHERE regexp_matches({text}, {pattern})), unnest(range(1, len(ms) + 1)) AS t(i))"""


def example_path(x: str) -> str:
    starts = "|".join(EXAMPLE_START)
    return f"regexp_matches({x}, '(?i)(^|/)(?:{starts})|(^|/)(?:another|first|new|second|some|third)\\.|(^|/)(?:qux|quux)(/|$)|<[^<>/]+>|\\{{[^{{}}/]+\\}}')"


def example_symbol(x: str) -> str:
    return f"(regexp_matches({x}, '(?i)^(?:{'|'.join(EXAMPLE_START)})[a-z]') OR regexp_matches({x}, '^(?:DELETE|GET|PATCH|POST|PUT|[a-z]{{1,2}}|{'|'.join(UI_NAMES)})$'))"


def normal(x: str) -> str:
    """Lexical form of an absolute path whose names begin with no dot."""
    out = f"regexp_replace(regexp_replace({x}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    for _ in range(6):
        out = f"regexp_replace({out}, '(/[^/.][^/]*|^)/\\.\\.(/|$)', '/')"
        out = f"regexp_replace({out}, '/+', '/', 'g')"
    return f"regexp_replace({out}, '(.)/$', '\\1')"


MD = "(SELECT * FROM docs_syn WHERE format NOT IN ('restructuredtext', 'asciidoc'))"
RST, ADOC = "(SELECT * FROM docs_syn WHERE format = 'restructuredtext')", "(SELECT * FROM docs_syn WHERE format = 'asciidoc')"
SUFFIX = quoted(LINE_SUFFIX)
LINKS = f"""
links AS (
  SELECT path, regexp_replace(target, {SUFFIX}, '') AS value, link_text, line, nullif(regexp_replace(regexp_extract(target, {SUFFIX}), '^[:#]L?', ''), '') AS line_ref, raw FROM (
    SELECT path, target, link_text, line, raw FROM {hits(MD, 'path', quoted(r'[[]([^]\[]*)[]]\(([^()\s\[\]]+)\)'), {'link_text': 1, 'target': 2})}
      WHERE starts_with(target, '../') OR starts_with(target, './') OR regexp_matches(target, '^[a-zA-Z0-9_\\-/]+\\.[a-zA-Z]{{1,10}}$')
    UNION ALL SELECT path, target, link_text, line, raw FROM {hits(RST, 'path', quoted(RST_LINK), {'link_text': 1, 'target': 2})}
    UNION ALL SELECT path, target, link_text, line, raw FROM {hits(ADOC, 'path', quoted(r'link:([^\[\s]+)\[([^\]\[]*)\]'), {'target': 1, 'link_text': 2})}
  ) WHERE NOT regexp_matches(target, '^(?:https?://|#)')
)"""
_TRIM = "regexp_replace({x}, '[.,;:!?>}}\\]''\"]+$', '')"
_PAREN = "CASE WHEN {x} LIKE '%)' AND length({x}) - length(replace({x}, ')', '')) > length({x}) - length(replace({x}, '(', '')) THEN left({x}, length({x}) - 1) ELSE {x} END"
URL_ROWS = f"""
raw_urls AS (SELECT path, raw, line, {_TRIM.format(x='raw')} AS a FROM {hits('docs_syn', 'path', quoted("https?://[^\\s>\\]\"']+"))}),
url_rows AS (SELECT path, raw, line, {_TRIM.format(x='b')} AS value FROM (SELECT *, {_PAREN.format(x='a')} AS b FROM raw_urls))"""
_TECH = "|".join(sorted(TECHNOLOGIES, key=lambda t: (-len(t), t)))
VERSION_ROWS = f"""
version_rows AS (SELECT path, technology, version, line, raw FROM {hits('docs_syn', 'path', quoted(rf'(?i)\b({_TECH})\s+v?(\d+(?:\.\d+)?(?:\.\d+)?(?:\.x)?)\b'), {'technology': 1, 'version': 2})})"""
_PKG = " UNION ALL ".join(f"SELECT path, value, '{e}' AS ecosystem, line FROM {hits('docs_syn', 'path', quoted(p), {'value': 1})}" for e, p in PACKAGES)
PACKAGE_ROWS = f"""
package_rows AS (SELECT * FROM ({_PKG}) WHERE length(value) >= 3 AND lower(value) NOT IN ({', '.join(map(quoted, STOP_WORDS))}) AND NOT regexp_matches(value, '\\.[a-z]{{2,4}}$'))"""
_NORM = "CASE WHEN coalesce({x}, '') = '' THEN 'any' ELSE regexp_replace(regexp_replace({x}, '^[\\^~>=<]+', ''), '(?i)\\.x$', '.0') END"
_REQ = f"'^{PKG}([!<=>]+)?(.+)?$'"
MANIFEST_ROWS = f"""
pkg AS (SELECT ord, content::json AS j FROM manifests_syn WHERE name = 'package.json'),
manifest_lines AS (SELECT ord, name, pos, trim(r[pos]) AS r, r[pos] AS whole FROM (SELECT ord, name, string_split(content, chr(10)) AS r FROM manifests_syn), unnest(range(1, len(r) + 1)) AS t(pos)),
go_lines AS (SELECT m.ord, i, trim(s[i]) AS r FROM (SELECT ord, string_split(regexp_extract(content, 'require\\s+\\(([\\s\\S]*?)\\)', 1), chr(10)) AS s FROM manifests_syn WHERE name = 'go.mod') m, unnest(range(1, len(s) + 1)) AS t(i)),
cargo_lines AS (SELECT m.ord, i, s[i] AS r FROM (SELECT ord, string_split(regexp_extract(content, '\\[dependencies\\]([\\s\\S]*?)(?:\\[|$)', 1), chr(10)) AS s FROM manifests_syn WHERE name = 'Cargo.toml') m, unnest(range(1, len(s) + 1)) AS t(i)),
listed AS (SELECT ord, unnest(regexp_extract_all(regexp_extract(content, '\\[project\\.dependencies\\]([\\s\\S]*?)(?:\\[|$)', 1), '"([^"]+)"', 1)) AS d FROM manifests_syn WHERE name = 'pyproject.toml'),
manifest_rows AS (
  SELECT ord, 0 AS part, 0 AS pos, n AS name, {_NORM.format(x="(j->>'$.engines.node')")} AS version FROM pkg, unnest(['node', 'nodejs']) AS t(n) WHERE coalesce(j->>'$.engines.node', '') <> ''
  UNION ALL SELECT ord, 1, 0, 'npm', {_NORM.format(x="(j->>'$.engines.npm')")} FROM pkg WHERE coalesce(j->>'$.engines.npm', '') <> ''
  UNION ALL SELECT ord, 2, 0, lower(k), {_NORM.format(x="(j->'dependencies'->>k)")} FROM pkg, unnest(json_keys(j, '$.dependencies')) AS t(k)
  UNION ALL SELECT ord, 3, 0, lower(k), {_NORM.format(x="(j->'devDependencies'->>k)")} FROM pkg, unnest(json_keys(j, '$.devDependencies')) AS t(k)
  UNION ALL SELECT ord, 4, pos, lower(regexp_extract(r, {_REQ}, 1)), {_NORM.format(x=f"regexp_extract(r, {_REQ}, 3)")} FROM manifest_lines WHERE name = 'requirements.txt' AND r <> '' AND r NOT LIKE '#%' AND regexp_matches(r, {_REQ})
  UNION ALL SELECT ord, 5, 0, lower(string_split_regex(d, '[<>=!]+')[1]), coalesce(string_split_regex(d, '[<>=!]+')[2], 'any') FROM listed WHERE string_split_regex(d, '[<>=!]+')[1] <> ''
  UNION ALL SELECT ord, 6, 0, n, regexp_extract(content, '(?m)^go\\s+(\\d+\\.\\d+)', 1) FROM manifests_syn, unnest(['go', 'golang']) AS t(n) WHERE manifests_syn.name = 'go.mod'
  UNION ALL SELECT ord, 7, i, regexp_extract(r, '^(\\S+)\\s+v?(\\S+)', 1), {_NORM.format(x="regexp_extract(r, '^(\\S+)\\s+v?(\\S+)', 2)")} FROM go_lines WHERE regexp_matches(r, '^(\\S+)\\s+v?(\\S+)')
  UNION ALL SELECT ord, 8, i, lower(regexp_extract(r, '^([a-zA-Z0-9\\-_]+)\\s*=\\s*"?([^"\\n]+)"?', 1)), {_NORM.format(x="regexp_extract(r, '^([a-zA-Z0-9\\-_]+)\\s*=\\s*\"?([^\"\\n]+)\"?', 2)")} FROM cargo_lines WHERE regexp_matches(r, '^([a-zA-Z0-9\\-_]+)\\s*=')
  UNION ALL SELECT ord, 9, 0, 'java', regexp_extract(content, '<java\\.version>([^<]+)<', 1) FROM manifests_syn WHERE manifests_syn.name = 'pom.xml'
  UNION ALL SELECT ord, 10, 0, lower(regexp_extract(content, '<dependency>{ANY}<artifactId>{TAKEN}<', 1)), {_NORM.format(x=f"regexp_extract(content, '<dependency>{ANY}<version>{TAKEN}<', 1)")} FROM manifests_syn WHERE manifests_syn.name = 'pom.xml'
),
effective AS (SELECT name, arg_max(version, (ord, part, pos)) AS version FROM manifest_rows GROUP BY name)"""
DEPENDENCY_ROWS = """
dependency_names AS (
  SELECT DISTINCT lower(name) AS name FROM (
    SELECT unnest(list_concat(json_keys(content::json, '$.dependencies'), list_concat(json_keys(content::json, '$.devDependencies'), json_keys(content::json, '$.peerDependencies')))) AS name FROM manifests_syn WHERE name = 'package.json'
    UNION ALL SELECT name FROM manifest_rows WHERE part IN (4, 5, 7, 8)
    UNION ALL SELECT unnest(regexp_extract_all(content, '<artifactId>([^<]+)</artifactId>', 1)) FROM manifests_syn WHERE manifests_syn.name = 'pom.xml'
  )
)"""
_MAJOR = "nullif(regexp_extract({x}, '(\\d+)', 1), '')::bigint"
CHECKED_VERSIONS = f"""
{VERSION_ROWS.strip()}, {MANIFEST_ROWS.strip()},
version_results AS (
  SELECT v.*, nullif(nullif(e.version, 'any'), '') AS actual,
    NOT coalesce({_MAJOR.format(x='v.version')} <> {_MAJOR.format(x="nullif(e.version, 'any')")}, false) AS valid
  FROM version_rows v LEFT JOIN effective e ON e.name = CASE WHEN lower(v.technology) = 'nodejs' THEN 'node' ELSE lower(v.technology) END
),
version_messages AS (
  SELECT *, CASE WHEN NOT valid THEN 'Version mismatch: doc says ' || technology || ' ' || version || ', actual is ' || actual WHEN actual IS NULL THEN 'Could not find ' || lower(technology) || ' in dependencies' END AS message,
    CASE WHEN NOT valid THEN 'Update to ' || technology || ' ' || actual END AS suggestion FROM version_results
)"""
SUMMARY = "SELECT count(*) AS total, count_if(b = 'valid') AS valid, count_if(b = 'error') AS errors, count_if(b = 'warning') AS warnings, count_if(b = 'skipped') AS skipped FROM"

BLOCKS = f"""
tree_blocks AS (
  SELECT path, line, start, block FROM {hits(MD, 'path', quoted('```(?:' + chr(92) + 'w*)' + chr(92) + 'n([' + chr(92) + 's' + chr(92) + 'S]*?)```'), {'block': 1})}
  UNION ALL SELECT path, line, start, block FROM {hits(RST, 'path', quoted(RST_BLOCK.replace('}+', '}').replace('*+', '*').replace('?+', '?').replace('++', '+')), {'block': 1})}
  UNION ALL SELECT path, line, start, block FROM {hits(ADOC, 'path', quoted(ASCIIDOC_BLOCK), {'block': 1})}
),
tree_lines AS (
  SELECT path, line, start, pos, r[pos] AS r FROM (SELECT *, string_split(block, chr(10)) AS r FROM tree_blocks WHERE regexp_matches(block, '[├│└]|\\|--|`--')), unnest(range(1, len(r) + 1)) AS t(pos)
),
tree_entries AS (
  SELECT * FROM (
    SELECT path, line, start, pos,
      (length(regexp_replace(lead, '[^ ]', '', 'g')) + 4 * length(replace(lead, ' ', '')) + CASE WHEN regexp_matches(r, '^[ \\t│|]*[├└+`]') THEN 4 ELSE 0 END) // 4 AS depth,
      regexp_extract(trim(regexp_replace(regexp_replace(r, '^[\\s│|]*[├└+`][\\s─-]*', ''), '^[\\s│|]+', '')), '^([a-zA-Z0-9_\\-.@]+)/?$', 1) AS name
    FROM (SELECT *, regexp_extract(r, '^[ \\t│|]*') AS lead FROM tree_lines)
  ) WHERE name <> '' AND name <> '...' AND NOT regexp_matches(name, '^[=\\-_~]+$')
),
tree_rows AS (
  SELECT path, line, value FROM (
    SELECT e.path, e.line, e.start, e.pos, string_agg(a.name, '/' ORDER BY a.pos) AS value
    FROM tree_entries e JOIN tree_entries a ON a.path = e.path AND a.start = e.start AND a.pos <= e.pos
    WHERE a.pos = e.pos OR NOT EXISTS (SELECT 1 FROM tree_entries b WHERE b.path = e.path AND b.start = e.start AND b.pos > a.pos AND b.pos <= e.pos AND b.depth <= a.depth)
    GROUP BY 1, 2, 3, 4
  ) WHERE contains(value, '/') OR length(value) >= 3
)"""


def _pattern_values(table: dict[str, list[tuple[str, str]]]) -> str:
    return ", ".join(f"('{lang}', {k}, '{kind}', {quoted(p)})" for lang, rows in table.items() for k, (kind, p) in enumerate(rows))


_TAGS = "|".join(sorted((a for v in ALIASES.values() for a in v), key=lambda a: -len(a)))
_GUESS = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(raw), {quoted(a)})' for a in names)} THEN '{lang}'" for lang, names in ALIASES.items()) + " ELSE 'javascript' END"
CODE_ROWS = f"""
fences AS (SELECT path, line AS fence_line, block AS content, {_GUESS} AS language FROM {hits('docs_syn', 'path', quoted('(?i)```(?:' + _TAGS + ')' + chr(92) + 'n([' + chr(92) + 's' + chr(92) + 'S]*?)```'), {'block': 1})}),
fence_patterns AS (SELECT * FROM (VALUES {_pattern_values(SYMBOLS)}) AS t(language, k, kind, regex)),
fence_rules AS (SELECT f.*, p.kind, p.regex FROM fences f JOIN fence_patterns p ON p.language = CASE WHEN f.language IN (SELECT language FROM fence_patterns) THEN f.language ELSE 'javascript' END),
symbol_rows AS (SELECT path, value, kind, language, fence_line AS line, {example_symbol('value')} AS is_illustrative FROM {hits('fence_rules', 'path, kind, language, fence_line', 'regex', {'value': 1})})"""
INDEX_ROWS = f"""
code_patterns AS (SELECT * FROM (VALUES {_pattern_values(DECLARED)}) AS t(language, k, kind, regex)),
code_rules AS (SELECT c.*, p.kind, p.regex, p.k FROM code_syn c JOIN code_patterns p USING (language)),
index_rows AS (SELECT symbol, path AS file_path, kind, language, k, start FROM {hits('code_rules', 'path, kind, language, k', 'regex', {'symbol': 1})})"""
LISTING = """
listing AS (
  SELECT DISTINCT array_to_string(s[1:n], '/') AS path FROM (SELECT string_split(path, '/') AS s FROM (SELECT path FROM docs_syn UNION ALL SELECT path FROM code_syn)), unnest(range(0, len(s) + 1)) AS t(n)
),
entries AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS entry, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM listing WHERE path <> '')"""


def nearest(targets: str, candidates: str, keys: str = "") -> str:
    """target, match by all pairs: targets(target, keys), candidates(candidate, ord, keys)."""
    on = " AND ".join([f"t.{k} = c.{k}" for k in keys.split(", ") if k] or ["true"])
    own = "".join(f", t.{k}" for k in keys.split(", ") if k)
    return f"""(SELECT t.target{own}, arg_min(c.candidate, (CASE WHEN lower(t.target) = lower(c.candidate) AND t.target <> c.candidate THEN 0 ELSE 1 END, levenshtein(lower(t.target), lower(c.candidate)), c.ord)) AS match
      FROM (SELECT DISTINCT * FROM {targets}) t JOIN {candidates} c ON {on} AND levenshtein(lower(t.target), lower(c.candidate)) <= 3 GROUP BY t.target{own})"""


LINK_RESULTS = f"""
{LINKS.strip()}, {LISTING.strip()},
link_paths AS (SELECT *, {normal("'/project/' || regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || value")} AS full_path, {example_path('value')} AS example FROM links),
link_hits AS (
  SELECT p.*, (full_path = '/project' OR starts_with(full_path, '/project/')) AS inside, l.path IS NOT NULL AS there, regexp_extract(value, '([^/]*)/*$', 1) AS target,
    CASE WHEN contains(substr(full_path, 10), '/') THEN regexp_extract(substr(full_path, 10), '^(.*)/[^/]*$', 1) ELSE '' END AS dir
  FROM link_paths p LEFT JOIN listing l ON starts_with(full_path, '/project/') AND l.path = substr(full_path, 10)
),
link_near AS (SELECT * FROM {nearest('(SELECT target, dir FROM link_hits WHERE inside AND NOT there AND NOT example)', '(SELECT entry AS candidate, path AS ord, dir FROM entries)', 'dir')}),
link_results AS (
  SELECT h.path, value, line, example OR (inside AND there) AS valid, example AS skipped, CASE WHEN NOT example AND NOT (inside AND there) THEN 'error' END AS severity,
    CASE WHEN example THEN 'Skipped: illustrative/example path' WHEN NOT inside THEN 'Path escapes project root: ' || value WHEN NOT there THEN 'File not found: ' || value END AS message,
    CASE WHEN NOT example AND inside AND NOT there AND n.match IS NOT NULL THEN 'Did you mean: ' || n.match || '?' END AS suggestion, CASE WHEN NOT example THEN full_path END AS resolved_path
  FROM link_hits h LEFT JOIN link_near n ON n.target = h.target AND n.dir = h.dir
)"""
NAME_RESULTS = f"""
{CODE_ROWS.strip()}, {INDEX_ROWS.strip()},
spots AS (SELECT symbol, array_to_string(list(file_path ORDER BY file_path, k, start), ',') AS found_in, min((file_path, k, start)) AS ord FROM index_rows GROUP BY symbol),
name_near AS (SELECT * FROM {nearest('(SELECT value AS target FROM symbol_rows WHERE NOT is_illustrative AND value NOT IN (SELECT symbol FROM spots))', '(SELECT symbol AS candidate, ord FROM spots)')}),
name_results AS (
  SELECT r.path, r.value, r.kind, r.line, is_illustrative OR s.symbol IS NOT NULL AS valid, is_illustrative AS skipped, CASE WHEN NOT is_illustrative AND s.symbol IS NULL THEN 'warning' END AS severity,
    CASE WHEN is_illustrative THEN 'Skipped: illustrative/example code pattern' WHEN s.symbol IS NULL THEN 'Code pattern not found: ' || kind || ' ' || value END AS message,
    CASE WHEN NOT is_illustrative AND s.symbol IS NULL THEN 'Did you mean: ' || n.match || '?' END AS suggestion, CASE WHEN NOT is_illustrative THEN s.found_in END AS found_in
  FROM symbol_rows r LEFT JOIN spots s ON s.symbol = r.value LEFT JOIN name_near n ON n.target = r.value
)"""
PACKAGE_RESULTS = f"""
{PACKAGE_ROWS.strip()}, {DEPENDENCY_ROWS.strip()},
package_results AS (SELECT p.path, value, line, d.name IS NOT NULL AS valid, CASE WHEN d.name IS NULL THEN 'info' END AS severity, CASE WHEN d.name IS NULL THEN 'Package not found in dependencies: ' || value END AS message FROM package_rows p LEFT JOIN dependency_names d ON d.name = lower(value))"""
RESULTS = f"""
{LINK_RESULTS.strip()}, {CHECKED_VERSIONS.strip()}, {PACKAGE_RESULTS.strip()}, {NAME_RESULTS.strip()},
results AS (
  SELECT path, 'file-path' AS type, value, line, valid, skipped, severity, message, suggestion FROM link_results
  UNION ALL SELECT path, 'version', raw, line, valid, false, CASE WHEN NOT valid THEN 'warning' END, message, suggestion FROM version_messages
  UNION ALL SELECT path, 'dependency', value, line, valid, false, severity, message, NULL FROM package_results
  UNION ALL SELECT path, 'code-pattern', value, line, valid, skipped, severity, message, suggestion FROM name_results
),
buckets AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN valid OR severity = 'info' THEN 'valid' ELSE severity END AS b FROM results)"""
EDGE_ROWS = f"""
edge_links AS (SELECT l.path AS doc_path, substr(full_path, 10) AS code_path, 'file-path' AS type, value, line FROM link_paths l WHERE starts_with(full_path, '/project/') AND substr(full_path, 10) IN (SELECT file_path FROM index_rows)),
edges AS (SELECT * FROM edge_links UNION ALL SELECT r.path, i.file_path, 'code-pattern', r.value, r.line FROM symbol_rows r JOIN (SELECT DISTINCT symbol, file_path FROM index_rows) i ON i.symbol = r.value),
edge_pairs AS (SELECT DISTINCT doc_path, code_path FROM edges)"""
GRAPH = f"{LINK_RESULTS.strip()}, {NAME_RESULTS.strip()}, {EDGE_ROWS.strip()}"
LAST = """
last_rows AS (SELECT path, c.hash AS hash, c.ts AS ts, c.message AS message FROM (SELECT path, max({'ts': ts, 'hash': hash, 'message': message}) AS c FROM commits_syn GROUP BY path)),
changed AS (SELECT DISTINCT path FROM commits_syn WHERE ts >= (SELECT max(ts) FROM commits_syn) - INTERVAL 1 DAY)"""
AFTER = """
after_rows AS (
  SELECT p.doc_path, p.code_path, (SELECT count(*) FROM commits_syn c WHERE c.path = p.code_path AND c.ts >= l.ts) AS n FROM edge_pairs p JOIN last_rows l ON l.path = p.doc_path
)"""
_ROUND = "floor({x} + 0.5)::bigint"
FACTORS = f"""
{RESULTS.strip()}, {EDGE_ROWS.strip()}, {LAST.strip()}, {AFTER.strip()},
f_validity AS (SELECT d.path, coalesce({_ROUND.format(x='(r.n - r.e) / r.n * 100')}, 100) AS reference_validity FROM docs_syn d LEFT JOIN (SELECT path, count(*)::double AS n, count_if(b = 'error') AS e FROM buckets GROUP BY path) r USING (path)),
f_code AS (SELECT p.doc_path AS path, max(l.ts) AS code_ts FROM edge_pairs p LEFT JOIN last_rows l ON l.path = p.code_path GROUP BY 1),
f_delta AS (
  SELECT d.path, CASE WHEN l.ts IS NULL THEN 50 WHEN c.path IS NULL THEN 100 WHEN c.code_ts IS NULL THEN 75 WHEN l.ts >= c.code_ts THEN 100
    ELSE greatest(0, {_ROUND.format(x='100 * exp(-0.02::double * ((epoch_ms(c.code_ts) - epoch_ms(l.ts)) / 86400000.0::double))')}) END::bigint AS git_time_delta
  FROM docs_syn d LEFT JOIN last_rows l USING (path) LEFT JOIN f_code c USING (path)
),
f_churn AS (
  SELECT d.path, CASE WHEN c.path IS NULL THEN 100 WHEN l.path IS NULL THEN 50 WHEN coalesce(a.n, 0) = 0 THEN 100 ELSE greatest(40, {_ROUND.format(x='40 + 60 * exp(-0.03::double * a.n)')}) END::bigint AS code_change_frequency
  FROM docs_syn d LEFT JOIN f_code c USING (path) LEFT JOIN last_rows l USING (path) LEFT JOIN (SELECT doc_path AS path, max(n) AS n FROM after_rows GROUP BY 1) a USING (path)
),
f_said AS (SELECT DISTINCT path, value FROM symbol_rows),
f_coverage AS (
  SELECT d.path, coalesce({_ROUND.format(x='s.k / s.n * 100')}, 100) AS symbol_coverage FROM docs_syn d LEFT JOIN (
    SELECT p.doc_path AS path, count(*)::double AS n, count(f.value) AS k FROM edge_pairs p JOIN (SELECT DISTINCT file_path, symbol FROM index_rows) i ON i.file_path = p.code_path LEFT JOIN f_said f ON f.path = p.doc_path AND f.value = i.symbol GROUP BY 1) s USING (path)
),
score_rows AS (
  SELECT *, floor(raw + 0.5)::bigint AS total_score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
    SELECT *, round(reference_validity * 0.4::double + git_time_delta * 0.3::double + code_change_frequency * 0.15::double + symbol_coverage * 0.15::double, 9) AS raw FROM f_validity JOIN f_delta USING (path) JOIN f_churn USING (path) JOIN f_coverage USING (path))
)"""
_MODULE = quoted(JS_IMPORT)
_REQUIRE = quoted(REQUIRE)
_NAMES = "list_filter(list_transform(string_split({x}, ','), lambda s: trim(regexp_replace(trim(s), ' as .*$', ''))), lambda s: s <> '')"
_KNOWN = "CASE lower(tag) WHEN 'ts' THEN 'typescript' WHEN 'python' THEN 'python' WHEN 'go' THEN 'go' END"
IMPORT_ROWS = f"""
snips AS (SELECT path, line AS fence_line, {_KNOWN} AS language, block AS content FROM {hits('docs_syn', 'path', quoted('```(' + chr(92) + 'w+)' + chr(92) + 'n([' + chr(92) + 's' + chr(92) + 'S]*?)```'), {'tag': 1, 'block': 2})}),
es AS (
  SELECT *, CASE WHEN contains(what, '{{') THEN {_NAMES.format(x="trim(regexp_replace(regexp_replace(what, '^[^{]*[{]', ''), '[}][^}]*$', ''))")} ELSE [] END AS named,
    list_filter([trim(regexp_replace(trim(regexp_replace(what, '[{{].*$', '')), ',$', ''))], lambda s: s <> '') AS def
  FROM {hits("(SELECT * FROM snips WHERE language = 'typescript')", 'path, fence_line, language', _MODULE, {'what': 1, 'module': 2})} WHERE starts_with(module, '.') OR starts_with(module, '/')
),
import_rows AS (
  SELECT path, module AS value, fence_line + line - 1 AS line, language, array_to_string(list_concat(def, named), ',') AS link_text,
    array_to_string(list_concat(list_transform(def, lambda s: 'default:' || s), list_transform(named, lambda s: 'named:' || s)), ';') AS specifiers FROM es
  UNION ALL SELECT path, module, fence_line + line - 1, language, '', 'module:*' FROM {hits("(SELECT * FROM snips WHERE language = 'typescript')", 'path, fence_line, language', _REQUIRE, {'module': 3})} WHERE starts_with(module, '.')
  UNION ALL SELECT path, module, fence_line + line - 1, language, array_to_string({_NAMES.format(x='what')}, ','), array_to_string(list_transform({_NAMES.format(x='what')}, lambda s: 'named:' || s), ';') FROM {hits("(SELECT * FROM snips WHERE language = 'python')", 'path, fence_line, language', quoted(PY_IMPORT), {'module': 1, 'what': 2})}
  UNION ALL SELECT path, module, fence_line + line - 1, language, NULL, NULL FROM {hits("(SELECT * FROM snips WHERE language = 'go')", 'path, fence_line, language', quoted(GO_IMPORT), {'module': 1})}
  UNION ALL SELECT path, unnest(regexp_extract_all(body, '"([^"]+)"', 1)), fence_line + line - 1, language, NULL, NULL FROM {hits("(SELECT * FROM snips WHERE language = 'go')", 'path, fence_line, language', quoted(GO_GROUP), {'body': 1})}
)"""
_EXPORT = lambda p, k=1: f"regexp_extract_all(content, {quoted(p)}, {k})"
_ASYNC = maybe("async")
_DIRECT = rf"export{W}{maybe('default')}{_ASYNC}(?:class|const|enum|function|interface|let|type|var){W}{N}"
_DEFAULT = rf"export{W}default{W}{N}{S}[;\n]"
EXPORT_ROWS = f"""
export_rows AS (
  SELECT DISTINCT path, symbol FROM (
    SELECT path, unnest(list_concat({_EXPORT(rf'(?m)^{_ASYNC}def{W}({NAME}){S}[(]')}, list_concat({_EXPORT(rf'(?m)^class{W}({NAME})')}, {_EXPORT(rf'(?m)^({NAME}){S}=')}))) AS symbol FROM code_syn WHERE language = 'python'
    UNION ALL SELECT path, unnest({_EXPORT(_DIRECT)}) FROM code_syn WHERE language <> 'python'
    UNION ALL SELECT path, trim(regexp_replace(trim(unnest(flatten(list_transform({_EXPORT(r'export\s*[{]([^}]+)[}]')}, lambda b: string_split(b, ','))))), '\\s+as\\s+.*$', '')) FROM code_syn WHERE language <> 'python'
    UNION ALL SELECT path, unnest(list_concat({_EXPORT(_DEFAULT)}, ['default'])) FROM code_syn WHERE language <> 'python' AND regexp_matches(content, 'export\\s+default\\s+\\w+\\s*[;\\n]')
  ) WHERE symbol <> '' AND NOT (starts_with(symbol, '_') AND path LIKE '%.py')
)"""
_CLEAN = "regexp_replace(regexp_replace(value, '^(\\./|(\\.\\./)+)', ''), '^\\.+', '')"
IMPORT_RESULTS = f"""
{IMPORT_ROWS.strip()}, {EXPORT_ROWS.strip()}, {LISTING.strip()},
asked AS (SELECT DISTINCT value, language FROM import_rows),
tried AS (
  SELECT value, language, (b * 100 + e) AS pos, base || regexp_replace(value, '^(\\./|(\\.\\./)+)', '') || ext AS candidate
  FROM asked, (VALUES (0, ''), (1, 'src/'), (2, 'lib/'), (3, 'app/')) AS bs(b, base), (VALUES (0, ''), (1, '.ts'), (2, '/index.ts'), (3, '.tsx'), (4, '/index.tsx'), (5, '.js'), (6, '/index.js'), (7, '.jsx'), (8, '/index.jsx'), (9, '.mjs'), (10, '/index.mjs'), (11, '.cjs'), (12, '/index.cjs')) AS es2(e, ext) WHERE language <> 'python'
  UNION ALL SELECT value, language, e, replace(value, '.', '/') || ext FROM asked, (VALUES (0, '.py'), (1, '/__init__.py')) AS es3(e, ext) WHERE language = 'python'
),
known AS (SELECT path AS candidate, 0 AS stage FROM code_syn UNION ALL SELECT path, 1 FROM listing),
found AS (SELECT value, language, arg_min(candidate, (stage, pos)) AS resolved_path FROM tried JOIN known USING (candidate) GROUP BY 1, 2),
import_names AS (
  SELECT r.*, f.resolved_path, list_transform(list_filter(string_split(coalesce(specifiers, ''), ';'), lambda s: starts_with(s, 'named:')), lambda s: substr(s, 7)) AS named, list_transform(list_filter(string_split(coalesce(specifiers, ''), ';'), lambda s: starts_with(s, 'default:')), lambda s: substr(s, 9)) AS def,
    coalesce((SELECT list(symbol) FROM export_rows x WHERE x.path = f.resolved_path), []) AS offered, {example_path('r.value')} AS example
  FROM import_rows r LEFT JOIN found f ON f.value = r.value AND f.language = r.language
),
import_gaps AS (SELECT *, list_filter(named, lambda s: NOT list_contains(offered, s)) AS lost, CASE WHEN list_contains(offered, 'default') THEN [] ELSE def END AS nodef FROM import_names),
import_near AS (SELECT * FROM {nearest('(SELECT unnest(lost) AS target, resolved_path AS file FROM import_gaps WHERE resolved_path IS NOT NULL)', '(SELECT symbol AS candidate, symbol AS ord, path AS file FROM export_rows)', 'file')}),
import_hints AS (
  SELECT path, value, line, string_agg(s || coalesce(' → ' || n.match, ''), ', ' ORDER BY i) AS hint FROM (SELECT path, value, line, resolved_path, i, lost[i] AS s FROM import_gaps, unnest(range(1, len(lost) + 1)) AS t(i) WHERE resolved_path IS NOT NULL) g LEFT JOIN import_near n ON n.target = g.s AND n.file = g.resolved_path GROUP BY 1, 2, 3
),
import_similar AS (
  SELECT value, list(DISTINCT c.path ORDER BY c.path) AS files FROM (SELECT DISTINCT value, lower(regexp_extract(value, '([^/]*)$', 1)) AS base FROM import_names WHERE resolved_path IS NULL) a
  JOIN code_syn c ON contains(a.base, lower(regexp_replace(regexp_extract(c.path, '([^/]*)$', 1), '\\.[^.]*$', ''))) OR contains(lower(regexp_replace(regexp_extract(c.path, '([^/]*)$', 1), '\\.[^.]*$', '')), a.base) GROUP BY 1 HAVING count(DISTINCT c.path) <= 5
),
import_results AS (
  SELECT g.path, g.value, g.line, CASE WHEN example THEN true WHEN far THEN true WHEN resolved_path IS NULL THEN false ELSE len(lost) + len(nodef) = 0 END AS valid, example OR far AS skipped,
    CASE WHEN example THEN 'Skipped: illustrative/example snippet import path' WHEN far THEN language || ' import could not be resolved locally (may be stdlib or external)' WHEN resolved_path IS NULL THEN 'Import path not found: ' || g.value
      WHEN len(lost) + len(nodef) > 0 THEN 'Symbol(s) not exported from ' || resolved_path || ': ' || array_to_string(list_concat(lost, nodef), ', ') END AS message,
    CASE WHEN example OR far THEN NULL WHEN resolved_path IS NULL THEN 'Did you mean: ' || array_to_string(s.files[1:3], ', ') || '?' WHEN len(lost) + len(nodef) > 0 AND contains(h.hint, '→') THEN 'Did you mean: ' || h.hint || '?' END AS suggestion, resolved_path
  FROM (SELECT *, resolved_path IS NULL AND language IN ('python', 'go') AND NOT starts_with(value, '.') AS far FROM import_gaps) g
  LEFT JOIN import_hints h ON h.path = g.path AND h.value = g.value AND h.line = g.line LEFT JOIN import_similar s ON s.value = g.value
)"""
_IP = "regexp_extract(host, '^(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})\\.(\\d{{1,3}})$', {k})"
_OCT = lambda k: f"nullif({_IP.format(k=k)}, '')::int"
PRIVATE = f"coalesce(greatest({_OCT(1)}, {_OCT(2)}, {_OCT(3)}, {_OCT(4)}) > 255 OR {_OCT(1)} IN (0, 10, 127) OR {_OCT(1)} >= 224 OR ({_OCT(1)} = 172 AND {_OCT(2)} BETWEEN 16 AND 31) OR ({_OCT(1)} = 192 AND {_OCT(2)} = 168) OR ({_OCT(1)} = 169 AND {_OCT(2)} = 254), false)"
URL_RESULTS = f"""
url_parts AS (SELECT DISTINCT url, lower(nullif(regexp_extract(url, '^([a-zA-Z][+.0-9a-zA-Z-]*)://', 1), '')) AS scheme, lower(nullif(regexp_extract(url, '^[a-zA-Z][+.0-9a-zA-Z-]*://([^/?#:]*)', 1), '')) AS host, regexp_matches(url, '[{{}} ]') AS broken FROM urls),
url_cases AS (
  SELECT p.*, r.status, CASE
    WHEN regexp_matches(url, '\\$\\{{.*\\}}|\\{{\\{{.*\\}}\\}}|<%.*%>') THEN 'template' WHEN broken OR scheme IS NULL OR (scheme IN ('http', 'https') AND host IS NULL) THEN 'format' WHEN scheme NOT IN ('http', 'https') THEN 'protocol'
    WHEN host IN ('127.0.0.1', 'localhost', 'example.com') OR host LIKE '%.localhost' OR host LIKE '%.example.com' THEN 'domain'
    WHEN {PRIVATE} THEN 'private'
    WHEN status IS NULL THEN 'failed' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (401, 403) THEN 'auth' WHEN status = 404 AND host = 'github.com' THEN 'hub' ELSE 'bad' END AS c
  FROM url_parts p LEFT JOIN probe_results r USING (url)
)
SELECT url, c IN ('template', 'domain', 'private', 'ok', 'auth', 'hub') AS valid, c IN ('template', 'domain', 'private') AS skipped, CASE WHEN c IN ('format', 'protocol', 'failed', 'bad') THEN 'warning' END AS severity,
  CASE c WHEN 'template' THEN 'URL contains template placeholders' WHEN 'domain' THEN 'Domain in skip list' WHEN 'private' THEN 'Skipped: private/internal address' WHEN 'format' THEN 'Invalid URL format: ' || url WHEN 'protocol' THEN 'Unsupported URL protocol: ' || scheme || ':'
    WHEN 'failed' THEN 'URL check failed: ' || url || ' (no answer)' WHEN 'auth' THEN 'Requires authentication: ' || url WHEN 'hub' THEN 'May be private repository: ' || url WHEN 'bad' THEN url || ' returned ' || status END AS message,
  CASE WHEN c IN ('ok', 'auth', 'hub', 'bad') THEN status END::int AS status_code FROM url_cases"""
_ONE = "CASE WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%es' AND {x} NOT LIKE '%ses' AND {x} NOT LIKE '%xes' THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"
_SX, _SY = _ONE.format(x="x"), _ONE.format(x="y")
_LIKENESS = f"CASE WHEN x = y THEN 1.0 WHEN {_SX} = {_SY} OR {_SX} = y OR x = {_SY} THEN 0.95 ELSE 1 - levenshtein(x, y)::double / greatest(length(x), length(y)) END"
DIRECTORY_RESULTS = f"""
{BLOCKS.strip()}, {LISTING.strip()},
tree_hits AS (
  SELECT t.*, {example_path('value')} AS example, a.path IS NOT NULL AS fa, b.path IS NOT NULL AS fb, b.path AS beside, regexp_extract(value, '([^/]*)$', 1) AS target, CASE WHEN contains(value, '/') THEN regexp_extract(value, '^(.*)/[^/]*$', 1) ELSE '' END AS above
  FROM tree_rows t LEFT JOIN listing a ON a.path = value LEFT JOIN listing b ON b.path = regexp_extract(t.path, '^(.*)/[^/]*$', 1) || '/' || value
),
tree_pairs AS (
  SELECT DISTINCT h.target, h.above, e.entry, e.path AS epath, lower(h.target) = lower(e.entry) AND h.target <> e.entry AS other_case,
    regexp_replace(lower(h.target), '\\.[^.]+$', '') AS x, regexp_replace(lower(e.entry), '\\.[^.]+$', '') AS y
  FROM tree_hits h JOIN entries e ON e.dir = h.above WHERE NOT example AND NOT fa AND NOT fb
),
tree_scored AS (SELECT *, {_LIKENESS} AS score FROM tree_pairs),
tree_near AS (SELECT target, above, arg_min(entry, (CASE WHEN other_case THEN 0 ELSE 1 END, CASE WHEN other_case THEN 0.0 ELSE -score END, epath)) AS match FROM tree_scored WHERE other_case OR score >= 0.7 GROUP BY 1, 2)
SELECT h.path, value, line, example OR fa OR fb AS valid, example AS skipped, CASE WHEN example THEN 'Skipped: illustrative/example path' WHEN NOT (fa OR fb) THEN 'Directory/file not found: ' || value END AS message,
  CASE WHEN NOT example AND NOT fa AND NOT fb THEN h.above || '/' || n.match END AS suggestion, CASE WHEN example THEN NULL WHEN fa THEN value WHEN fb THEN beside END AS found_at
FROM tree_hits h LEFT JOIN tree_near n ON n.target = h.target AND n.above = h.above"""
_SIGN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^/\*\*|\*/$', '', 'g'), '(?m)^///?', '', 'g'), '(?m)^#', '', 'g'), '(?m)^\s*\*\s?', '', 'g')"
_COMMENTS = "('typescript', 'doc', '/\\*\\*[\\s\\S]*?\\*/'), ('typescript', 'line', '//[^\\n]*'), ('python', 'docstring', '\"\"\"[\\s\\S]*?\"\"\"'), ('python', 'line', '#[^\\n]*'), ('go', 'line', '//[^\\n]*'), ('go', 'block', '/\\*[\\s\\S]*?\\*/')"

RAW: dict[str, str] = {
    "version_mismatch_summary": f"WITH {CHECKED_VERSIONS} {SUMMARY} (SELECT CASE WHEN valid THEN 'valid' ELSE 'warning' END AS b FROM version_results)",
    "version_mismatches": f"WITH {CHECKED_VERSIONS} SELECT path, line, technology, version, actual, valid, message, suggestion FROM version_messages",
    "extract_file_links": f"WITH {LINKS} SELECT * FROM links",
    "extract_urls": f"WITH {URL_ROWS} SELECT path, value, line, raw FROM url_rows",
    "extract_versions": f"WITH {VERSION_ROWS} SELECT * FROM version_rows",
    "extract_dependencies": f"WITH {PACKAGE_ROWS} SELECT * FROM package_rows",
    "extract_tree_paths": f"WITH {BLOCKS} SELECT path, value, line, {example_path('value')} AS is_illustrative FROM tree_rows",
    "extract_code_patterns": f"WITH {CODE_ROWS} SELECT * FROM symbol_rows",
    "extract_imports": f"WITH {IMPORT_ROWS} SELECT * FROM import_rows",
    "index_symbols": f"WITH {INDEX_ROWS} SELECT symbol, file_path, kind, language FROM index_rows",
    "index_exports": f"WITH {EXPORT_ROWS} SELECT * FROM export_rows",
    "index_comments": f"""WITH comment_patterns AS (SELECT * FROM (VALUES {_COMMENTS}) AS t(language, kind, regex)), comment_rules AS (SELECT c.*, p.kind, p.regex, c.content AS whole FROM code_syn c JOIN comment_patterns p USING (language))
      SELECT path, kind, regexp_replace({_SIGN}, '^\\s+|\\s+$', '', 'g') AS text, coalesce(nullif(regexp_extract(substr(whole, start + 1), '(?:async|class|const|def|fn|func|function|interface|let|struct|type|var)\\s+(\\w+)', 1), ''), 'unknown') AS symbol FROM {hits('comment_rules', 'path, kind, whole', 'regex')}""",
    "doc_sections": """WITH rows_ AS (SELECT path, pos, r[pos] AS r FROM (SELECT path, string_split(content, chr(10)) AS r FROM docs_syn), unnest(range(1, len(r) + 1)) AS t(pos)),
      marked AS (SELECT *, regexp_matches(r, '^#{1,6}[ \\t]+\\S') AS head, sum(CASE WHEN regexp_matches(r, '^#{1,6}[ \\t]+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS ord FROM rows_)
      SELECT path, ord::int AS ord, coalesce(max(CASE WHEN head THEN regexp_replace(r, '^#{1,6}[ \\t]+', '') END), 'Introduction') AS heading, regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN r END, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') AS text
      FROM marked GROUP BY path, ord HAVING ord > 0 OR regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN r END, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') <> ''""",
    "detect_formats": "SELECT path, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.rst' THEN 'restructuredtext' WHEN path LIKE '%.adoc' THEN 'asciidoc' ELSE 'plaintext' END AS format, 'javascript' AS language FROM docs_syn",
    "file_listing": f"WITH {LISTING} SELECT path FROM listing",
    "parse_manifest_versions": f"WITH {MANIFEST_ROWS} SELECT ord, name, version FROM manifest_rows",
    "effective_versions": f"WITH {MANIFEST_ROWS} SELECT * FROM effective",
    "parse_manifest_dependencies": f"WITH {MANIFEST_ROWS}, {DEPENDENCY_ROWS} SELECT * FROM dependency_names",
    "validate_file_paths": f"WITH {LINK_RESULTS} SELECT * FROM link_results",
    "validate_directories": f"WITH {DIRECTORY_RESULTS}",
    "validate_symbols": f"WITH {NAME_RESULTS} SELECT path, value, kind, valid, skipped, message, suggestion, found_in FROM name_results",
    "validate_dependencies": f"WITH {MANIFEST_ROWS}, {PACKAGE_RESULTS} SELECT path, value, valid, severity, message FROM package_results",
    "validate_urls": f"WITH {URL_RESULTS}",
    "validate_imports": f"WITH {IMPORT_RESULTS} SELECT * FROM import_results",
    "nearest_string": f"""WITH named AS (SELECT c_custkey, 'Fn_' || substr(md5(c_name), 1, 9) AS n FROM customer),
      typed AS (SELECT CASE c_custkey % 3 WHEN 0 THEN substr(n, 1, 6) || 'zz' || substr(n, 8, 9) WHEN 1 THEN upper(n) ELSE 'g' || substr(md5(n), 1, 8) END AS target FROM named) SELECT * FROM {nearest('typed', '(SELECT n AS candidate, c_custkey AS ord FROM named)')}""",
    "similarity_ratio": f"""WITH s AS (SELECT p_partkey, p_name AS a, p_type AS b, lower(p_name) || 's' AS x, lower(p_name) AS y FROM part)
      SELECT p_partkey, levenshtein(a, b) AS distance, round(1 - levenshtein(lower(a), lower(b))::double / greatest(length(a), length(b)), 9) AS ratio, round({_LIKENESS}, 9) AS likeness FROM s""",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM edges",
    "docs_for_code": f"WITH {GRAPH} SELECT code_path, string_agg(doc_path, ',' ORDER BY doc_path) AS docs FROM edge_pairs GROUP BY 1",
    "code_for_doc": f"WITH {GRAPH} SELECT doc_path, string_agg(code_path, ',' ORDER BY code_path) AS code_files FROM edge_pairs GROUP BY 1",
    "affected_docs": f"WITH {GRAPH}, {LAST} SELECT DISTINCT doc_path FROM edge_pairs WHERE code_path IN (SELECT path FROM changed)",
    "change_summary": f"WITH {GRAPH}, {LAST} SELECT code_path, count(*)::int AS n_docs, any_value(l.hash) AS hash, any_value(l.message) AS message FROM edge_pairs p JOIN last_rows l ON l.path = p.code_path WHERE code_path IN (SELECT path FROM changed) GROUP BY 1",
    "last_commit": f"WITH {LAST} SELECT * FROM last_rows",
    "commits_after_doc": f"WITH {GRAPH}, {LAST}, {AFTER} SELECT * FROM after_rows",
    "changed_since": f"WITH {LAST} SELECT * FROM changed",
    "urls_to_probe": f"""WITH {URL_RESULTS[: URL_RESULTS.index("url_cases AS")].strip().rstrip(",")}
      SELECT url, CASE WHEN regexp_matches(host, '{"|".join(GET_FIRST)}') THEN 'GET' ELSE 'HEAD' END AS method FROM url_parts WHERE scheme IN ('http', 'https') AND host IS NOT NULL AND NOT broken AND host <> 'localhost' AND NOT {PRIVATE}""",
    "changed_between": "SELECT DISTINCT path FROM commits_syn WHERE ts > (SELECT min(ts) FROM commits_syn) AND ts <= (SELECT max(ts) FROM commits_syn)",
    "graph_validity": """WITH m AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey * 10000 END AS t, ([NULL, 'abc', 'zzz', ''])[o_orderkey % 4 + 1] AS h, ([NULL, 'c1', 'c2', NULL, 'c1'])[o_orderkey % 5 + 1] AS g FROM orders),
      v AS (SELECT *, coalesce(t, 0) <> 0 AND (coalesce(h, '') = '' OR h = 'abc') AS sound, 300000000 - t < 86400000 AS young FROM m)
      SELECT o_orderkey, coalesce(sound AND CASE WHEN g IS NOT NULL THEN g = 'c1' ELSE young END, false) AS valid_at_commit, coalesce(sound AND young, false) AS valid_by_age FROM v""",
    "embeddings_missing": """WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS kind, coalesce(lang, 'none') || ':' || md5(coalesce(text, '')) AS key FROM documents)
      SELECT DISTINCT kind, key FROM t WHERE key NOT IN (SELECT key FROM t WHERE doc_id % 3 = 0)""",
    "cache_fresh": "SELECT 'https://x.org/' || o_orderkey AS url, o_orderkey * 1000 AS ts_ms FROM orders WHERE 4000000 - o_orderkey * 1000 < 3600000",
    "factor_validity": f"WITH {FACTORS} SELECT * FROM f_validity",
    "factor_time_delta": f"WITH {FACTORS} SELECT * FROM f_delta",
    "factor_churn": f"WITH {FACTORS} SELECT * FROM f_churn",
    "factor_coverage": f"WITH {FACTORS} SELECT * FROM f_coverage",
    "doc_scores": f"WITH {FACTORS} SELECT path, reference_validity, git_time_delta, code_change_frequency, symbol_coverage, total_score, grade FROM score_rows",
    "project_score": f"""WITH {FACTORS} SELECT floor(avg(total_score) + 0.5)::bigint AS project_score, CASE WHEN avg(total_score) >= 90 THEN 'A' WHEN avg(total_score) >= 80 THEN 'B' WHEN avg(total_score) >= 70 THEN 'C' WHEN avg(total_score) >= 60 THEN 'D' ELSE 'F' END AS project_grade, count(*) AS total,
      {', '.join(f"count_if(grade = '{g}') AS grade_{g.lower()}" for g in 'ABCDF')} FROM score_rows""",
    "results_summary": f"WITH {RESULTS} {SUMMARY} buckets",
    "issues_by_doc": f"WITH {RESULTS} SELECT path, count(*) AS n, count_if(severity = 'error') AS errors, min(line) AS first_line FROM buckets WHERE b IN ('error', 'warning') GROUP BY 1",
    "incremental_changed": "SELECT d.doc_id AS path FROM documents d LEFT JOIN hash_state s ON s.path = d.doc_id WHERE md5(d.text) IS DISTINCT FROM s.md5",
    "incremental_state": "SELECT doc_id AS path, md5(text) AS md5 FROM documents",
    "incremental_stats": """WITH n AS (SELECT count(*) AS total, count_if(md5(d.text) IS DISTINCT FROM s.md5) AS changed FROM documents d LEFT JOIN hash_state s ON s.path = d.doc_id)
      SELECT total, changed, total - changed AS skipped, CASE WHEN total > 0 THEN floor((total - changed) / total * 100 + 0.5)::bigint ELSE 0 END AS percent_skipped FROM n""",
    "prune_newest": """WITH e AS (SELECT event_type || user_id::varchar AS key, event_id AS seq, value FROM events), k AS (SELECT key, min(seq) AS a, max(seq) AS z FROM e GROUP BY 1 ORDER BY a DESC, key DESC LIMIT 50) SELECT e.key, e.seq, e.value FROM e JOIN k ON k.key = e.key AND e.seq = k.z""",
    "semantic_best_match": """WITH s AS (SELECT d.vec_id AS doc_id, c.vec_id AS code_id, list_cosine_similarity(d.embedding::double[], c.embedding::double[]) AS score FROM embeddings d, embeddings c WHERE d.vec_id % 2 = 1 AND c.vec_id % 2 = 0), b AS (SELECT doc_id, max(score) AS score, arg_min(code_id, (-score, code_id)) AS code_id FROM s WHERE score > 0 GROUP BY 1)
      SELECT e.vec_id AS doc_id, coalesce(round(b.score, 6), 0) AS score, b.code_id FROM embeddings e LEFT JOIN b ON b.doc_id = e.vec_id WHERE e.vec_id % 2 = 1""",
    "semantic_mismatches": """WITH s AS (SELECT d.vec_id AS doc_id, greatest(0, max(list_cosine_similarity(d.embedding::double[], c.embedding::double[]))) AS score FROM embeddings d, embeddings c WHERE d.vec_id % 2 = 1 AND c.vec_id % 2 = 0 GROUP BY 1)
      SELECT doc_id, (['the function', 'a class', 'no such', 'API of it', 'it returns', 'methods'])[doc_id % 6 + 1] AS text, round(score, 6) AS score, 'Documentation may describe functionality not found in code' AS suggestion FROM s WHERE score < 0.45 AND doc_id % 6 <> 2""",
    "cosine_pairs": "SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "illustrative_flags": f"""WITH v AS (SELECT p_partkey, (['src/', 'my-app/', 'x/{{id}}/', 'foo/', 'lib/second.', 'a/<b>/'])[p_partkey % 6 + 1] || replace(p_name, ' ', '') AS v, (['GET', 'Modal', 'Mymodule', 'ab', 'Widget', 'testing'])[p_partkey % 6 + 1] AS w FROM part) SELECT p_partkey, {example_path('v')} AS path_flag, {example_symbol('w')} AS symbol_flag FROM v""",
    "path_within_root": f"""WITH v AS (SELECT p_partkey, {normal("'/project/docs/' || (['../src/', './', '../../', '../../projectExtra/', 'a/../b/', '../../project/'])[p_partkey % 6 + 1] || replace(p_name, ' ', '_')")} AS full_path FROM part) SELECT p_partkey, full_path, full_path = '/project' OR starts_with(full_path, '/project/') AS inside FROM v""",
    "markdown_escape": "SELECT path, replace(replace(content, chr(92), chr(92) || chr(92)), '|', chr(92) || '|') AS cell FROM docs_syn",
    "report_markdown": f"""WITH {RESULTS}, cells AS (SELECT path, line, type, value, '| ' || line || ' | ' || CASE WHEN severity = 'error' THEN '❌ Error' ELSE '⚠️ Warning' END || ' | ' || replace(replace(coalesce(message, ''), chr(92), chr(92) || chr(92)), '|', chr(92) || '|') || ' | ' || replace(coalesce(suggestion, '-'), '|', chr(92) || '|') || ' |' AS r FROM buckets WHERE b IN ('error', 'warning'))
      SELECT path, '### 📄 `' || path || '`' || chr(10) || chr(10) || '| Line | Severity | Issue | Suggestion |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg(r, chr(10) ORDER BY line, type, value, r) || chr(10) || chr(10) AS section FROM cells GROUP BY path""",
}
SQL: dict[str, str] = {name: with_corpora(sql) for name, sql in RAW.items()}
