"""Queries over source code made from rows, so that SQL can state what parsing must find.

Each nation is a file: imports from its region, a class named after it, one
method for each of its suppliers.  The code is truly parsed; the expected rows
are arithmetic on the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcut.lang import LANGUAGES
from loomcut.operators import code as C
from loomcut.operators.chunker import Options

QUERIES, ORACLES = {}, {}


@dataclass(frozen=True)
class Template:
    """Lines with ``{n}``, ``{r}`` and ``{s}`` for nation, region and supplier, and the entities in them.

    Entities are (type, name, signature, docstring, parent, source, first line,
    last line); lines of the method's count from where it begins; ``end`` is
    the line of the class's end after ``K`` methods.
    """

    extension: str
    head: tuple[str, ...]
    method: tuple[str, ...]
    tail: tuple[str, ...]
    fixed: tuple[tuple, ...]
    methods: tuple[tuple, ...]


_DOC = "Doc {n}."
TEMPLATES = {
    "python": Template(
        "py",
        ("import os.p{r} as q", "from lib.r{r} import Base, Other as Alias{n}", "@deco", "class N{n}(Base):", '    """Doc {n}."""'),
        ("    async def m{s}(self, a: int = {s},", "            b=None) -> int:", "        return a + {s}"),
        (),
        (
            ("import", "q", "import os.p{r} as q", None, None, None, 0, 0),
            ("import", "lib.r{r}", "from lib.r{r} import Base, Other as Alias{n}", None, None, "lib.r{r}", 1, 1),
            ("import", "Base", "from lib.r{r} import Base, Other as Alias{n}", None, None, "lib.r{r}", 1, 1),
            ("import", "Alias{n}", "from lib.r{r} import Base, Other as Alias{n}", None, None, "lib.r{r}", 1, 1),
            ("class", "N{n}", "class N{n}(Base)", _DOC, None, None, 3, "4 + 3 * K"),
        ),
        (("function", "m{s}", "async def m{s}(self, a: int = {s}, b=None) -> int", None, "N{n}", None, 0, 2),),
    ),
    "typescript": Template(
        "ts",
        ('import D{n}, { Base, type Other as Alias{n} } from "lib/r{r}";', "/** Doc {n}. */", "class N{n}<T> extends Base<T> {"),
        ("  async m{s}(a: Array<number>, b?: { x: number }): Promise<number> {", "    return a[0] + {s};", "  }"),
        ("}", "enum E{n} { A, B }", "type U{n}<T> = T | null;", "interface I{n} { a: string }", "export { N{n} };"),
        (
            *(("import", x, 'import D{n}, { Base, type Other as Alias{n} } from "lib/r{r}";', None, None, "lib/r{r}", 0, 0) for x in ("D{n}", "Base", "Alias{n}")),
            ("class", "N{n}", "class N{n}<T> extends Base<T>", _DOC, None, None, 2, "3 + 3 * K"),
            ("enum", "E{n}", "enum E{n}", None, None, None, "4 + 3 * K", "4 + 3 * K"),
            ("type", "U{n}", "type U{n}<T>", None, None, None, "5 + 3 * K", "5 + 3 * K"),
            ("interface", "I{n}", "interface I{n}", None, None, None, "6 + 3 * K", "6 + 3 * K"),
            ("export", "<anonymous>", "export { N{n} };", None, None, None, "7 + 3 * K", "7 + 3 * K"),
        ),
        (("method", "m{s}", "async m{s}(a: Array<number>, b?: { x: number }): Promise<number>", None, "N{n}", None, 0, 2),),
    ),
    "tsx": Template(
        "tsx",
        ('import D{n}, { Base } from "lib/r{r}";', "/**", " * Doc {n}:", " *   it's of three lines.", " */", "class N{n} extends D{n}.Component<Props> {"),
        ("  m{s}(a: string): Element {", "    return <p title='{s}' {...this.props}>don't {a as string} <b>http://x.y // ` {s}</b></p>;", "  }"),
        ("}", "const g{n} = <T,>(x: T) => <>{x} isn't</>;", "function f{n}<T extends Base>(x: Array<T>) {", "  return x.length < 3 && <List<T> items={x.map((y) => { function h{n}() { return <i/>; } return h{n}(); })} />;", "}", "interface I{n} { a: <T>(x: T) => void }"),
        (
            *(("import", x, 'import D{n}, { Base } from "lib/r{r}";', None, None, "lib/r{r}", 0, 0) for x in ("D{n}", "Base")),
            ("class", "N{n}", "class N{n} extends D{n}.Component<Props>", "Doc {n}:\n  it's of three lines.", None, None, 5, "6 + 3 * K"),
            ("function", "f{n}", "function f{n}<T extends Base>(x: Array<T>)", None, None, None, "8 + 3 * K", "10 + 3 * K"),
            ("function", "h{n}", "function h{n}()", None, "f{n}", None, "9 + 3 * K", "9 + 3 * K"),
            ("interface", "I{n}", "interface I{n}", None, None, None, "11 + 3 * K", "11 + 3 * K"),
        ),
        (("method", "m{s}", "m{s}(a: string): Element", None, "N{n}", None, 0, 2),),
    ),
    "jsx": Template(
        "jsx",
        ('import D{n} from "lib/r{r}"', "function A{n}() {"),
        ("  function v{s}() {", "    return <li>don't / {v{s} < {s} ? <b>`</b> : null} // no comment, {'}'} isn't one</li>", "  }"),
        ("}", "export default class N{n} extends D{n} { render() { return <><A{n} x='>' y={<i/>} /> it's</> } }"),
        (
            ("import", "D{n}", 'import D{n} from "lib/r{r}"', None, None, "lib/r{r}", 0, 0),
            ("function", "A{n}", "function A{n}()", None, None, None, 1, "2 + 3 * K"),
            ("export", "<anonymous>", "export default class N{n} extends D{n} { render() { return <><A{n} x='>' y={<i/>} /> it's</> } }", None, None, None, "3 + 3 * K", "3 + 3 * K"),
            ("class", "N{n}", "class N{n} extends D{n}", None, None, None, "3 + 3 * K", "3 + 3 * K"),
            ("method", "render", "render()", None, "N{n}", None, "3 + 3 * K", "3 + 3 * K"),
        ),
        (("function", "v{s}", "function v{s}()", None, "A{n}", None, 0, 2),),
    ),
    "javascript": Template(
        "mjs",
        ('import * as D{n} from "lib/r{r}"', "/** Doc {n}. */", "class N{n} extends Base {"),
        ("  static m{s}(a, b = {s}) {", "    return a / b / {s}", "  }"),
        ("}", "function* g{n}() { yield {n} }"),
        (
            ("import", "D{n}", 'import * as D{n} from "lib/r{r}"', None, None, "lib/r{r}", 0, 0),
            ("class", "N{n}", "class N{n} extends Base", _DOC, None, None, 2, "3 + 3 * K"),
            ("function", "g{n}", "function* g{n}()", None, None, None, "4 + 3 * K", "4 + 3 * K"),
        ),
        (("method", "m{s}", "static m{s}(a, b = {s})", None, "N{n}", None, 0, 2),),
    ),
    "java": Template(
        "java",
        ("package p{n};", "import lib.r{r}.Base;", "import lib.s{r}.*;", "/** Doc {n}. */", "@Ann(1) public class N{n} extends Base {"),
        ("  @Override public <T> List<T> m{s}(final int a, String... b) throws X {", "    return a < {s} ? null : b;", "  }"),
        ("}",),
        (
            ("import", "Base", "import lib.r{r}.Base;", None, None, "lib.r{r}.Base", 1, 1),
            ("import", "s{r}", "import lib.s{r}.*;", None, None, "lib.s{r}", 2, 2),
            ("class", "N{n}", "@Ann(1) public class N{n} extends Base", _DOC, None, None, 4, "5 + 3 * K"),
        ),
        (("method", "m{s}", "@Override public <T> List<T> m{s}(final int a, String... b) throws X", None, "N{n}", None, 0, 2),),
    ),
    "go": Template(
        "go",
        ("package p{n}", 'import alias "lib/r{r}"', "type N{n} struct { A int }"),
        ("// Doc {s}.", "func (t *N{n}) M{s}(a int, b ...string) (int, error) {", "\treturn a + {s}, nil }"),
        ("type I{n} interface { X(a int) error }",),
        (
            ("import", "<anonymous>", "package p{n}", None, None, "", 0, 0),
            ("import", "alias", 'import alias "lib/r{r}"', None, None, "lib/r{r}", 1, 1),
            ("type", "N{n}", "N{n} struct", None, None, None, 2, 2),
            ("type", "I{n}", "I{n} interface", None, None, None, "3 + 3 * K", "3 + 3 * K"),
            ("method", "X", "X(a int) error", None, None, None, "3 + 3 * K", "3 + 3 * K"),
        ),
        (("method", "M{s}", "func (t *N{n}) M{s}(a int, b ...string) (int, error)", "Doc {s}.", None, None, 1, 2),),
    ),
    "rust": Template(
        "rs",
        ("use lib::r{r}::{Base, Other as Alias{n}};", "/// Doc {n}.", "pub struct S{n}<T> { a: T }", "impl N{n} {"),
        ("    /// Doc {s}.", "    pub fn m{s}<T: Clone>(&self, a: i32) -> Option<i32> {", "        Some(a + {s}) }"),
        ("}", "enum E{n} { A, B(i32) }", "trait T{n} { fn q(&self); }"),
        (
            ("import", "Base", "use lib::r{r}::{Base, Other as Alias{n}};", None, None, "lib::r{r}::{Base, Other as Alias{n}}", 0, 0),
            ("import", "Alias{n}", "use lib::r{r}::{Base, Other as Alias{n}};", None, None, "lib::r{r}::{Base, Other as Alias{n}}", 0, 0),
            ("type", "S{n}", "pub struct S{n}<T>", _DOC, None, None, 2, 2),
            ("class", "N{n}", "impl N{n}", None, None, None, 3, "4 + 3 * K"),
            ("enum", "E{n}", "enum E{n}", None, None, None, "5 + 3 * K", "5 + 3 * K"),
            ("interface", "T{n}", "trait T{n}", None, None, None, "6 + 3 * K", "6 + 3 * K"),
        ),
        (("function", "m{s}", "pub fn m{s}<T: Clone>(&self, a: i32) -> Option<i32>", "Doc {s}.", "N{n}", None, 1, 2),),
    ),
}


def _sql(text: str | None) -> str:
    """SQL that fills the placeholders, for either engine."""
    if text is None:
        return "CAST(NULL AS VARCHAR(1000))"
    out = text.replace("'", "\0")
    for k in "nrs":
        out = out.replace(f"{{{k}}}", f"' || CAST({k} AS VARCHAR(20)) || '")
    return "'" + out.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\0", "' || chr(39) || '") + "'"


def _spread(files: DataFrame) -> DataFrame:
    """A nation's keys are few bytes, and would share a task with all others; its file is long to parse."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism)


def files(spark: SparkSession, d: str, language: str) -> DataFrame:
    """``n, filepath, code``: a source file for every nation."""
    t = TEMPLATES[language]
    nation = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as n", "n_regionkey as r")
    supplier = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_nationkey as n", "s_suppkey as s")
    line = " || chr(10) || ".join(_sql(x) for x in t.method)
    per = _spread(nation.join(supplier, "n", "left").groupBy("n", "r").agg(F.array_sort(F.collect_list("s")).alias("ms")))
    head = " || chr(10) || ".join(map(_sql, t.head))
    tail = " || ".join(f"chr(10) || {_sql(x)}" for x in t.tail) or "''"
    body = f"array_join(transform(ms, s -> chr(10) || {line}), '')"
    return per.selectExpr("n", f"'src/n' || n || '.{t.extension}' as filepath", f"{head} || {body} || {tail} || chr(10) as code")


def expected(language: str) -> str:
    """DuckDB SQL for the entities of ``files``."""
    t = TEMPLATES[language]
    f = "WITH f AS (SELECT n_nationkey AS n, n_regionkey AS r, count(s_suppkey) AS K FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL), m AS (SELECT n_nationkey AS n, n_regionkey AS r, s_suppkey AS s, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey)"
    row = lambda e, lines: f"n, '{e[0]}' AS type, " + ", ".join(f"{_sql(x)} AS {c}" for x, c in zip(e[1:6], ("name", "signature", "docstring", "parent", "source"))) + f", CAST({lines(e[6])} AS INTEGER) AS line_start, CAST({lines(e[7])} AS INTEGER) AS line_end"
    # a statement's own text is its signature for imports; K is the number of methods
    parts = [f"SELECT {row(e, str)} FROM f" for e in t.fixed]
    parts += [f"SELECT {row(e, lambda x: f'{len(t.head)} + {len(t.method)} * k + {x}')} FROM m" for e in t.methods]
    return f + " " + " UNION ALL ".join(parts)


def _entities(language: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        src = files(spark, d, language)
        found = C.extract_entities(src.select("filepath", "code"))
        n = F.regexp_extract("filepath", "n([0-9]+)\\.", 1).cast("int").alias("n")
        return found.select(n, "type", "name", "signature", "docstring", "parent", "source", F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"))

    return run


for _language in TEMPLATES:
    QUERIES[f"entities_{_language}"] = _entities(_language)
    ORACLES[f"entities_{_language}"] = expected(_language)
# 'import os.p{r} as q' names its module in the name field, alias and all
ORACLES["entities_python"] = ORACLES["entities_python"].replace("'import os.p' || CAST(r AS VARCHAR(20)) || ' as q' AS signature, CAST(NULL AS VARCHAR(1000)) AS docstring, CAST(NULL AS VARCHAR(1000)) AS parent, CAST(NULL AS VARCHAR(1000)) AS source", "'import os.p' || CAST(r AS VARCHAR(20)) || ' as q' AS signature, CAST(NULL AS VARCHAR(1000)) AS docstring, CAST(NULL AS VARCHAR(1000)) AS parent, 'os.p' || CAST(r AS VARCHAR(20)) || ' as q' AS source")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _all_files(spark, d, languages=tuple(TEMPLATES)):
    out = None
    for language in languages:
        one = files(spark, d, language).select("filepath", "code")
        out = one if out is None else out.unionByName(one)
    bad = spark.read.parquet(f"{d}/region.parquet").selectExpr("'src/r' || r_regionkey || '.rb' as filepath", "'puts 1' as code")
    return out.unionByName(bad)


@query("""SELECT 'src/r' || r_regionkey || '.rb' AS filepath, 'UnsupportedLanguageError' AS tag, 'Unsupported file type: src/r' || r_regionkey || '.rb' AS message FROM region""")
def batch_errors(spark, d):
    return C.chunk_batch(_all_files(spark, d)).where("error is not null").select("filepath", "error.tag", "error.message")


@query("""SELECT 'src/n' || n_nationkey || '.' || e AS filepath, 1 AS n_chunks FROM nation, (SELECT unnest(['py', 'ts', 'mjs', 'java', 'go', 'rs']) AS e)
UNION ALL SELECT 'src/r' || r_regionkey || '.rb', NULL FROM region""")
def chunk_code_batch(spark, d):
    """At a size that holds any file, a file of each language is one chunk; one that fails has none."""
    return C.chunk_batch(_all_files(spark, d, LANGUAGES), Options(max_chunk_size=2**31 - 1)).select("filepath", F.when(F.col("chunks").isNotNull(), F.size("chunks")).alias("n_chunks"))


@query(f"""WITH f AS (SELECT n_nationkey AS n, count(s_suppkey) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n, CAST(i AS INTEGER) AS idx, 'N' || n AS scope FROM f, unnest(range(0, k - 1)) AS u(i)""")
def chunk_code_scopes(spark, d):
    """Chunks that begin with a method, when each is a chunk of its own (the first shares one with the brace)."""
    src = files(spark, d, "java").select("filepath", "code")
    got = C.chunk_files(src, Options(max_chunk_size=95)).withColumn("n", F.regexp_extract("filepath", "n([0-9]+)\\.", 1).cast("int"))
    inside = got.where(F.exists("context.entities", lambda e: e["type"] == "method") & (F.try_element_at("context.scope", F.lit(-1))["name"] == F.concat(F.lit("N"), F.col("n").cast("string"))))
    from pyspark.sql import Window

    first = inside.where(F.startswith("text", F.lit("@Override")))
    return first.select("n", (F.row_number().over(Window.partitionBy("n").orderBy("index")) - 1).alias("idx"), F.element_at("context.scope", -1)["name"].alias("scope"))


@query("SELECT s_suppkey, 'x' || u AS name, 'lib.m' || s_suppkey AS source FROM (SELECT s_suppkey, unnest(range(0, s_suppkey % 4 + 1)) AS u FROM supplier) UNION ALL SELECT s_suppkey, 'lib.m' || s_suppkey, 'lib.m' || s_suppkey FROM supplier")
def import_explode(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    line = "'from lib.m' || s_suppkey || ' import ' || array_join(transform(sequence(0, cast(s_suppkey % 4 as int)), i -> case when i = 1 then 'y as x1' else 'x' || i end), ', ')"
    src = s.selectExpr("'s' || s_suppkey || '.py' as filepath", f"{line} as code")
    return C.extract_entities(src).select(F.regexp_extract("filepath", "s([0-9]+)", 1).cast("long").alias("s_suppkey"), "name", "source")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE array_to_string(list_transform(range(0, least(s_suppkey % 6, 3)), lambda i: 'ERROR at line ' || (i + 1) || ', column 1'), '; ')
  || CASE WHEN s_suppkey % 6 > 3 THEN '; ... and ' || (s_suppkey % 6 - 3) || ' more' ELSE '' END END AS message FROM supplier""")
def parse_error_message(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return C.parse_errors(s.selectExpr("'s' || s_suppkey || '.js' as filepath", "repeat(')' || chr(10), cast(s_suppkey % 6 as int)) || 'ok()' as code")).select(F.regexp_extract("filepath", "s([0-9]+)", 1).cast("long").alias("s_suppkey"), "message")


@query("""SELECT 'page/' || page_id || '/' || (i - 1) || '.js' AS filepath, CAST(k AS INTEGER) AS index, 2 AS total_chunks, CASE k WHEN 0 THEN 'var t="</p>";' ELSE 'track(' || regexp_extract(code[i], 'track\\(([0-9]+)\\)', 1) || ');' END AS text
FROM (SELECT page_id, code, unnest(range(1, len(code) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<script>(.*?)</script>', 1) AS code FROM pages)), unnest([0, 1]) AS u(k)""")
def script_entities(spark, d):
    """Entities and chunks of the scripts inside web pages."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1))).alias("i", "code"))
    src = scripts.select(F.concat_ws("/", F.lit("page"), F.col("page_id").cast("string"), F.concat(F.col("i").cast("string"), F.lit(".js"))).alias("filepath"), "code")
    return C.chunk_files(src, Options(max_chunk_size=20)).select("filepath", "index", "total_chunks", "text")


# Functions of one size in a file for every nation, so that windows, lines and offsets are arithmetic.

_FUNCTION = "'function f' || lpad(CAST({s} AS {t}), 8, '0') || '() {{' || chr(10) || '  return \"aaaaaaaaaaaaaaaaaaaa\";' || chr(10) || '}}'"  # 57 characters, 50 of them no white space


def _function(s: str, engine: str = "duckdb") -> str:
    return _FUNCTION.format(s=s, t="VARCHAR" if engine == "duckdb" else "STRING")


def _function_files(spark, d):
    """``n, filepath, code``: the functions of a nation's suppliers, by number."""
    s = _spread(spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("ms")))
    return s.selectExpr("n", "'src/f' || n || '.js' as filepath", f"array_join(transform(ms, s -> {_function('s', 'spark')}), chr(10)) || chr(10) as code", "'src/c' || n || '.js' as class_path", f"'class N' || n || ' {{' || chr(10) || array_join(transform(ms, s -> replace({_function('s', 'spark')}, 'function f', 'f')), chr(10)) || chr(10) || '}}' || chr(10) as class_code")


_SUPPLIED = "m AS (SELECT s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier)"


@query(f"""WITH {_SUPPLIED} SELECT n, CAST(i // 2 AS INTEGER) AS index, CAST((max(k) + 1) // 2 AS INTEGER) AS total_chunks, string_agg({_function('s')}, chr(10) ORDER BY i) AS text, CAST(min(i) * 58 AS INTEGER) AS byte_start, CAST(max(i) * 58 + 57 AS INTEGER) AS byte_end,
  CAST(min(i) * 3 AS INTEGER) AS line_start, CAST(max(i) * 3 + 2 AS INTEGER) AS line_end FROM m GROUP BY n, i // 2""")
def tree_windows(spark, d):
    """Two functions fit a window, the third does not; text, offsets and lines are rebuilt from the nodes."""
    got = C.chunk_files(_function_files(spark, d).select("filepath", "code"), Options(max_chunk_size=120))
    n = F.regexp_extract("filepath", "f([0-9]+)", 1).cast("int").alias("n")
    return got.select(n, "index", "total_chunks", "text", F.col("byte_range.start").alias("byte_start"), F.col("byte_range.end").alias("byte_end"), F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"))


@query(f"""WITH {_SUPPLIED}, c AS (SELECT n, i // 2 AS j, (max(k) + 1) // 2 AS t, string_agg({_function('s')}, chr(10) ORDER BY i) AS text FROM m GROUP BY n, i // 2)
SELECT n, CAST(j AS INTEGER) AS index, CASE WHEN j = 0 THEN '' ELSE '# ...' || chr(10) || '  return "aaaaaaaaaaaaaaaaaaaa";' || chr(10) || '}}' || chr(10) || '# ---' || chr(10) END || text AS text FROM c""")
def code_overlap(spark, d):
    """The last two lines of the chunk before, over each chunk but the first."""
    got = C.chunk_files(_function_files(spark, d).select("filepath", "code"), Options(max_chunk_size=120, overlap_lines=2, context_mode="none"))
    return got.select(F.regexp_extract("filepath", "f([0-9]+)", 1).cast("int").alias("n"), "index", F.col("contextualized_text").alias("text"))


@query(f"""WITH {_SUPPLIED} SELECT n, CAST(i // 3 AS INTEGER) AS index, CASE WHEN i // 3 = 0 THEN 'class N' || n || ' {{' || chr(10) ELSE '' END || string_agg(replace({_function('s')}, 'function f', 'f'), chr(10) ORDER BY i) || CASE WHEN max(i) = max(k) - 1 THEN chr(10) || '}}' ELSE '' END AS text FROM m GROUP BY n, i // 3""")
def merged_windows(spark, d):
    """A class over the limit is entered: its head and its first methods are windows of their own and merged, as their sizes allow."""
    got = C.chunk_files(_function_files(spark, d).select(F.col("class_path").alias("filepath"), F.col("class_code").alias("code")), Options(max_chunk_size=140))
    return got.select(F.regexp_extract("filepath", "c([0-9]+)", 1).cast("int").alias("n"), "index", "text")


_LINE = "lpad(CAST({s} AS {t}), 8, '0') || repeat('b', 32)"  # 40 characters


@query(f"""WITH {_SUPPLIED}, l AS (SELECT n, s, i + 2 AS i, k + 2 AS k FROM m UNION ALL SELECT DISTINCT n, j, j, k + 2 FROM m, unnest([0, 1]) AS u(j)),
r AS (SELECT n, s, i, k, {_LINE.format(s='s', t='VARCHAR')} AS line FROM l)
SELECT n, 0 AS index, 'const s =' AS text, 0 AS first, 0 AS last FROM m GROUP BY n UNION ALL
SELECT n, CAST(i + 1 AS INTEGER), CASE WHEN i = 0 THEN '`' || chr(10) ELSE '' END || line || chr(10) || CASE WHEN i = k - 1 THEN '`' ELSE '' END, CAST(CASE WHEN i = 0 THEN 0 ELSE i + 1 END AS INTEGER), CAST(CASE WHEN i = k - 1 THEN k + 1 ELSE i + 2 END AS INTEGER) FROM r""")
def leaf_windows(spark, d):
    """A string over the limit is split at its lines: exact pieces, and the whole lines that the default gives for them."""
    s = _spread(spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("ms")))
    src = s.selectExpr("'src/s' || n || '.js' as filepath", f"'const s = `' || chr(10) || array_join(transform(concat(array(0L, 1L), ms), s -> {_LINE.format(s='s', t='STRING')}), chr(10)) || chr(10) || '`' || chr(10) as code")
    exact = C.chunk_files(src, Options(max_chunk_size=45, compat="exact")).select("filepath", "index", "text")
    whole = C.chunk_files(src, Options(max_chunk_size=45)).select("filepath", "index", F.col("line_range.start").alias("first"), F.col("line_range.end").alias("last"))
    return exact.join(whole, ["filepath", "index"]).select(F.regexp_extract("filepath", "s([0-9]+)", 1).cast("int").alias("n"), "index", "text", "first", "last")


_NEAR = "(SELECT string_agg('f' || lpad(CAST(o.s AS VARCHAR), 8, '0'), ',' ORDER BY abs(o.i - m.i)) FROM m o WHERE o.n = m.n AND o.i {} m.i AND abs(o.i - m.i) <= 3)"


@query(f"""WITH {_SUPPLIED} SELECT n, CAST(i AS INTEGER) AS index, 'f' || lpad(CAST(s AS VARCHAR), 8, '0') AS scope, 'f' || lpad(CAST(s AS VARCHAR), 8, '0') || ':false' AS entities, coalesce({_NEAR.format('<')}, '') AS before, coalesce({_NEAR.format('>')}, '') AS after, 'javascript' AS language, CAST(NULL AS VARCHAR) AS parse_error FROM m""")
def chunk_context(spark, d):
    """Scope, entities, siblings and parse error of a chunk that is one function."""
    got = C.chunk_files(_function_files(spark, d).select("filepath", "code"), Options(max_chunk_size=60))
    of = lambda side: F.array_join(F.transform(F.filter("context.siblings", lambda x: x["position"] == side), lambda x: x["name"]), ",").alias(side)
    return got.select(
        F.regexp_extract("filepath", "f([0-9]+)", 1).cast("int").alias("n"), "index", F.array_join(F.transform("context.scope", lambda x: x["name"]), ",").alias("scope"),
        F.array_join(F.transform("context.entities", lambda x: F.concat(x["name"], F.lit(":"), x["is_partial"].cast("string"))), ",").alias("entities"), of("before"), of("after"), "context.language", F.col("context.parse_error.message").alias("parse_error"),
    )


@query("""SELECT s_suppkey, CAST(i AS INTEGER) AS index, 'ERROR at line 1, column 1' AS message FROM supplier, unnest([0, 1]) AS u(i)""")
def chunk_parse_errors(spark, d):
    """What is wrong with a file is in the context of each of its chunks, which are made all the same."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    src = s.selectExpr("'s' || s_suppkey || '.js' as filepath", f"')' || chr(10) || {_function('s_suppkey', 'spark')} || chr(10) || {_function('s_suppkey', 'spark')} as code")
    return C.chunk_files(src, Options(max_chunk_size=60)).select(F.regexp_extract("filepath", "s([0-9]+)", 1).cast("long").alias("s_suppkey"), "index", F.col("context.parse_error.message").alias("message"))


@query(f"""WITH {_SUPPLIED}, k AS (SELECT DISTINCT n, k FROM m) SELECT n, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN k WHEN n % 4 = 2 THEN (k + 1) // 2 ELSE 1 END::INTEGER AS n_chunks, CASE WHEN n % 4 = 0 THEN 'UnsupportedLanguageError' END AS tag FROM k""")
def option_merge(spark, d):
    """A file's own options go before the batch's; a null one isn't given.  Without a language, a ``.txt`` file fails alone."""
    m = F.col("n") % 4
    own = F.struct(F.when(m == 1, 60).when(m == 3, 10**6).cast("int").alias("max_chunk_size"), F.lit(None).cast("string").alias("context_mode"), F.lit(None).cast("string").alias("sibling_detail"), F.lit(None).cast("boolean").alias("filter_imports"), F.when(m > 0, "javascript").alias("language"), F.lit(None).cast("int").alias("overlap_lines"))
    src = _function_files(spark, d).select(F.format_string("f%d.txt", "n").alias("filepath"), "code", own.alias("options"))
    got = C.chunk_batch(src, Options(max_chunk_size=120))
    return got.select(F.regexp_extract("filepath", "f([0-9]+)", 1).cast("int").alias("n"), F.when(F.col("chunks").isNotNull(), F.size("chunks")).alias("n_chunks"), "error.tag")


@query("SELECT CAST(i AS INTEGER) AS completed, CAST(count(*) OVER () AS INTEGER) AS total, i <= 0 OR true AS told FROM (SELECT row_number() OVER () AS i FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region))")
def batch_progress(spark, d):
    """The progress that a batch tells of, file by file; those that fail are counted too."""
    told = []
    src = files(spark, d, "go").select("filepath", "code").unionByName(spark.read.parquet(f"{d}/region.parquet").selectExpr("'src/r' || r_regionkey || '.rb' as filepath", "'puts 1' as code"))
    for _ in C.chunk_batch_stream(src, Options(), lambda done, total, path, good: told.append((done, total, good == (not path.endswith(".rb"))))):
        pass
    return spark.createDataFrame(told, "completed int, total int, told boolean")


def _walked(language: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = C.extract_entities(files(spark, d, language).select("filepath", "code"), mode="nodes")
        n = F.regexp_extract("filepath", "n([0-9]+)\\.", 1).cast("int").alias("n")
        return found.select(n, "type", "name", "parent", F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"))

    return run


for _language in ("java", "rust", "tsx"):
    QUERIES[f"node_walk_{_language}"] = _walked(_language)
    ORACLES[f"node_walk_{_language}"] = f"SELECT n, type, name, parent, line_start, line_end FROM ({expected(_language)})"


_DOCS = {
    "ts": ("/**\n * Doc {n}.\n *\n *   indented\n * @return it\n */\nfunction f{n}() {}\n", "Doc {n}.\n\n  indented\n@return it"),
    "py": ('def f{n}():\n    """\n    Doc {n}.\n\n      indented\n    """\n', "Doc {n}.\n\n  indented"),
    "rs": ("/// Doc {n}.\n///\n///   indented\nfn f{n}() {}\n", "Doc {n}.\n\n  indented"),
    "go": ("package p\n// Doc {n}.\n//\n//   indented\nfunc f{n}() {}\n", "Doc {n}.\n\n  indented"),
    "java": ("class K {\n  /**\n   * Doc {n}.\n   *\n   *   indented\n   */\n  void f{n}() {}\n}\n", "Doc {n}.\n\n  indented"),
}


@query(" UNION ALL ".join(f"SELECT n_nationkey AS n, '{e}' AS extension, {_sql(doc).replace('CAST(n AS', 'CAST(n_nationkey AS')} AS docstring FROM nation" for e, (_, doc) in _DOCS.items()))
def docstrings_of_many_lines(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as n")
    src = None
    for e, (code, _) in _DOCS.items():
        one = nation.selectExpr(f"'n' || n || '.{e}' as filepath", f"{_sql(code)} as code")
        src = one if src is None else src.unionByName(one)
    found = C.extract_entities(src).where(F.startswith("name", F.lit("f")))
    return found.select(F.regexp_extract("filepath", "n([0-9]+)", 1).cast("int").alias("n"), F.substring_index("filepath", ".", -1).alias("extension"), "docstring")


def _spelt(spark, d):
    """A file for every nation whose words, its number spelt in letters, no other file has."""
    nation = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as n", "'w' || translate(n_nationkey, '0123456789', 'abcdefghij') || 'w' as w")
    return nation.selectExpr("n", "'src/n' || n || '.js' as filepath", "'function ' || w || '() {' || chr(10) || '  return ' || w || ';' || chr(10) || '}' as code")


@query("SELECT 'src/n' || n_nationkey || '.js' AS filepath, 0 AS ord, 0 AS start_line, 2 AS end_line, 64 AS dims, 1.0::DOUBLE AS norm FROM nation")
def index_build(spark, d):
    """Every file chunked and embedded; vectors are of length one."""
    from loomcut.operators import index as I
    from loomcut.operators import search as V

    built = I.build_index(_spelt(spark, d).select("filepath", "code"), I.hashing_embedder(64))
    return built.select("filepath", "ord", "start_line", "end_line", F.size("embedding").alias("dims"), F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query("SELECT 'src/n7.js' AS filepath, 0 AS start_line, 2 AS end_line, 1.0::DOUBLE AS score, 'function whw() {' || chr(10) || '  return whw;' || chr(10) || '}' AS snippet")
def index_search(spark, d):
    """The text of a chunk, asked for, finds that chunk first."""
    from loomcut.operators import index as I

    embed = I.hashing_embedder(4096)
    built = I.build_index(_spelt(spark, d).select("filepath", "code"), embed, Options(context_mode="none"))
    return I.search_index(built, "function whw() {\n  return whw;\n}", embed, 1).withColumn("score", F.round("score", 6))


@query(f"""SELECT api, CAST(i AS INTEGER) AS index, CAST(CASE WHEN api = 'stream' THEN -1 ELSE 2 END AS INTEGER) AS total_chunks, {_function('(i + 1)')} AS text, CAST(i * 3 AS INTEGER) AS line_start FROM unnest(['chunk', 'stream', 'chunker', 'overridden']) AS a(api), unnest([0, 1]) AS u(i)""")
def one_file(spark, d):
    """One file without a table: all at once, lazily, and by a chunker whose options a call may override."""
    from loomcut.operators import chunker as K

    code = "\n".join(f'function f{i:08d}() {{\n  return "aaaaaaaaaaaaaaaaaaaa";\n}}' for i in (1, 2))
    small = Options(max_chunk_size=60)
    kept = C.create_chunker(max_chunk_size=60)
    made = {"chunk": K.chunk("a.js", code, small), "stream": K.stream("a.js", code, small), "chunker": kept.chunk("a.js", code), "overridden": C.create_chunker(max_chunk_size=5000).chunk("a.js", code, max_chunk_size=60)}
    rows = [(api, c["index"], c["total_chunks"], c["text"], c["line_range"]["start"]) for api, chunks in made.items() for c in chunks]
    return spark.createDataFrame(rows, "api string, index int, total_chunks int, text string, line_start int")


@query(f"""WITH {_SUPPLIED} SELECT n, CAST(k AS BIGINT) AS defaults, CAST(k * 50 <= 1500 AS BOOLEAN) AS whole FROM (SELECT DISTINCT n, k FROM m)""")
def default_options(spark, d):
    """With nothing said a chunk holds 1,500 characters that aren't white space; a file within that is one chunk."""
    src = _function_files(spark, d).select("filepath", "code")
    got = C.chunk_files(src).groupBy("filepath").agg(F.max("total_chunks").alias("n_chunks"), F.sum(F.size("context.entities")).alias("defaults"))
    return got.select(F.regexp_extract("filepath", "f([0-9]+)", 1).cast("int").alias("n"), "defaults", (F.col("n_chunks") == 1).alias("whole"))
