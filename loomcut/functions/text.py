"""Scalar text functions as Column expressions; all stay inside the JVM.

White space is JavaScript's ``\\s``, spelled out because Java's own class is
ASCII only.  Lengths that stand for source offsets count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
LANGUAGE_OF = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyi": "python", ".rs": "rust", ".go": "go", ".java": "java",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nws_count(text: Column | str) -> Column:
    """Characters that aren't white space, in UTF-16 units."""
    return utf16_length(F.regexp_replace(_c(text), f"[{JS_SPACE}]+", ""))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def lines(text: Column | str) -> Column:
    return F.split(_c(text), "\n", -1)


def js_trim(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def clean_signature(text: Column | str) -> Column:
    """White space runs become one space; trimmed."""
    return js_trim(F.regexp_replace(_c(text), f"[{JS_SPACE}]+", " "))


def extension(path: Column | str) -> Column:
    """From the last dot on; null without a dot."""
    p = _c(path)
    return F.when(F.contains(p, F.lit(".")), F.concat(F.lit("."), F.element_at(F.split(p, "[.]", -1), -1)))


def detect_language(path: Column | str, override: Column | str | None = None) -> Column:
    """Language by extension (case-sensitive), or the override; null where unsupported."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    found = F.try_element_at(table, extension(path))
    return F.coalesce(_c(override), found) if override is not None else found


def normalize_path(path: Column | str) -> Column:
    """Trimmed, without leading ``./`` or ``/``, doubled or closing slashes."""
    p = js_trim(path)
    for pattern, to in (("^(\\./)+", ""), ("^/+", ""), ("/+", "/"), ("/+$", "")):
        p = F.regexp_replace(p, pattern, to)
    return p


def strip_prefix(path: Column | str, folder: Column | str) -> Column:
    """Without a leading work-tree folder, raw or with %-escapes decoded."""
    p, q = _c(path), F.concat(F.regexp_replace(_c(folder), "/+$", ""), F.lit("/"))
    decoded = F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    cut = lambda x: F.substring(x, F.length(q) + 1, F.length(x))
    return F.when(F.startswith(p, q), cut(p)).when(F.coalesce(F.startswith(decoded, q), F.lit(False)), cut(decoded)).otherwise(p)


def diff_files(patch: Column | str) -> Column:
    """Distinct normalised new-side paths of a unified diff, without the null device."""
    found = F.regexp_extract_all(_c(patch), F.lit("(?m)^diff --git a/(.*?) b/(.*)$"), F.lit(2))
    return F.array_distinct(F.transform(F.filter(found, lambda f: f != "/dev/null"), normalize_path))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("long")


def identifiers(text: Column | str) -> Column:
    """Distinct ASCII identifiers between ASCII word boundaries."""
    # greedy, so a word's end needs no test of its own
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit("(?<![A-Za-z0-9_])[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)))


def strip_quotes(text: Column | str) -> Column:
    """Without one pair of equal quotes around it."""
    t = _c(text)
    return F.when(F.rlike(t, F.lit("(?s)^(\".*\"|'.*'|`.*`)$")) & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def safe_name(text: Column | str) -> Column:
    """For folder names: what isn't a letter, digit, dash or underline becomes an underline."""
    return F.regexp_replace(_c(text), "[^a-zA-Z0-9_-]", "_")


def bare_clone_name(repo: Column | str) -> Column:
    return F.concat(F.replace(_c(repo), F.lit("/"), F.lit("__")), F.lit(".git"))


def humanize_ms(ms: Column | str) -> Column:
    m = _c(ms)
    return F.when(m < 1000, F.concat(F.round(m).cast("long").cast("string"), F.lit("ms"))).when(m < 60000, F.format_string("%.1fs", m / 1000.0)).otherwise(F.format_string("%.1fm", m / 60000.0))


def humanize_tokens(n: Column | str) -> Column:
    m = _c(n)
    return F.when(m < 1000, F.round(m).cast("long").cast("string")).when(m < 1000000, F.format_string("%.1fk", m / 1000.0)).otherwise(F.format_string("%.2fM", m / 1000000.0))


def declared_files(output: Column | str, most: int = 10) -> Column:
    """Files that an answer declares: a fenced JSON object, a bare one, or else anything that looks like a path."""
    o = _c(output)
    listed = lambda j: F.try_variant_get(F.try_parse_json(j), "$.top_files", "array<string>")
    fenced = listed(F.nullif(F.regexp_extract(o, "(?s)```json\\s*(.*?)\\s*```", 1), F.lit("")))
    bare = listed(F.nullif(F.regexp_extract(o, '(?s)\\{.*"top_files".*\\}', 0), F.lit("")))
    paths = F.array_distinct(F.regexp_extract_all(o, F.lit("(?i)[A-Za-z0-9_./-]+\\.[a-z]+"), F.lit(0)))
    loose = F.slice(F.filter(paths, lambda p: ~F.startswith(p, F.lit("http")) & ~F.contains(p, F.lit("...")) & F.contains(p, F.lit("/"))), 1, most)
    return F.coalesce(fenced, bare, loose)


def tool_paths(tool: Column | str, given: Column | str, output: Column | str) -> Column:
    """Paths that a tool call touched, by tool."""
    t, i, o = _c(tool), _c(given), _c(output)
    rows = F.split(o, "\n", -1)
    grep = F.transform(rows, lambda r: js_trim(F.regexp_extract(r, "^([^:]+):", 1)))
    grep = F.filter(grep, lambda p: ~F.rlike(p, F.lit("^[0-9]+$")) & (F.contains(p, F.lit("/")) | F.contains(p, F.lit("."))))
    glob = F.filter(rows, lambda p: p != "")
    block = F.regexp_extract(o, "(?s)__FILES__\\n(.*?)\\n__END_FILES__", 1)
    search = F.filter(F.split(block, "\n", -1), lambda p: p != "")
    empty = F.array().cast("array<string>")
    return F.when(t == "Read", F.when(i != "", F.array(i)).otherwise(empty)).when(t == "Grep", grep).when(t == "Glob", glob).when(t == "mcp__semantic_search__search", search).otherwise(empty)


def tool_allowed(tool: Column | str, calls: Column | str, budget: int | None, allow: list[str], deny: list[str]) -> Column:
    """Budget first, then the allow list, then the deny list; anything else is refused."""
    t = _c(tool)
    over = _c(calls) >= budget if budget is not None else F.lit(False)
    return F.when(over, "Tool budget exceeded").when(t.isin(allow), "allowed").when(t.isin(deny), "Tool is denied for retrieval-only mode").otherwise("Tool not in allowlist")
