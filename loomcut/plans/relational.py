"""Queries over the driver's tables whose answers SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcut.functions import text as T
from loomcut.operators import events as E
from loomcut.operators import scope as S
from loomcut.operators import search as V
from loomcut.operators import windows as W

MOST, TARGET, OVERLAP = 300, 450, 2
_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NL = "chr(10)"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nws(x: str) -> str:
    return f"length(regexp_replace({x}, '{_WS}', '', 'g'))"


_LINES = f"""lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line, {_nws('l[i]')} AS s
  FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"""
#: Greedy windows as a recursion over lines: id is the current window, busy whether it holds a line.
_GREEDY = f"""{_LINES}, g(doc_id, line_no, id, size, busy) AS (
  SELECT doc_id, line_no, 0, CASE WHEN s > {MOST} THEN 0 ELSE s END, s <= {MOST} FROM lines WHERE line_no = 0
  UNION ALL
  SELECT n.doc_id, n.line_no,
    CASE WHEN NOT g.busy THEN g.id + 1 WHEN g.size + n.s <= {MOST} THEN g.id ELSE g.id + 1 END,
    CASE WHEN n.s > {MOST} THEN 0 WHEN g.busy AND g.size + n.s <= {MOST} THEN g.size + n.s ELSE n.s END,
    n.s <= {MOST}
  FROM g JOIN lines n ON n.doc_id = g.doc_id AND n.line_no = g.line_no + 1),
windows AS (
  SELECT g.doc_id, CAST(g.id AS INTEGER) AS window_idx, min(g.line_no) AS first_line, max(g.line_no) AS last_line, CAST(sum(n.s) AS BIGINT) AS size
  FROM g JOIN lines n USING (doc_id, line_no) GROUP BY g.doc_id, g.id)"""
_CHUNKS = f"""{_GREEDY}, chunks AS (
  SELECT w.doc_id, w.window_idx AS idx, CAST(count(*) OVER (PARTITION BY w.doc_id) AS INTEGER) AS total, first_line, last_line,
    (SELECT string_agg(n.line, {_NL} ORDER BY n.line_no) FROM lines n WHERE n.doc_id = w.doc_id AND n.line_no BETWEEN first_line AND last_line) AS chunk
  FROM windows w JOIN documents d ON d.doc_id = w.doc_id WHERE {_nws('d.text')} > 0),
lapped AS (
  SELECT *, nullif(array_to_string(list_slice(string_split(p, {_NL}), -{OVERLAP}, len(string_split(p, {_NL}))), {_NL}), '') AS overlap
  FROM (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM chunks))"""


@query(f"SELECT doc_id, CAST({_nws('text')} AS BIGINT) AS nws FROM documents")
def nws_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.nws_count("text").cast("long").alias("nws"))


@query(f"""WITH {_LINES} SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS length,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines""")
def line_starts(spark, d):
    return W.numbered_lines(_t(spark, d, "documents")).select("doc_id", "line_no", "length", "start")


@query(f"""WITH {_LINES} SELECT doc_id, line_no, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS nws_until FROM lines""")
def prefix_sum(spark, d):
    from pyspark.sql import Window

    each = W.numbered_lines(_t(spark, d, "documents"))
    return each.select("doc_id", "line_no", F.sum(T.nws_count("line").cast("long")).over(Window.partitionBy("doc_id").orderBy("line_no")).alias("nws_until"))


@query(f"WITH RECURSIVE {_GREEDY} SELECT * FROM windows")
def greedy_line_windows(spark, d):
    return W.line_windows(_t(spark, d, "documents"), MOST)


@query(f"""WITH RECURSIVE {_GREEDY}, m(doc_id, window_idx, id, size) AS (
  SELECT doc_id, window_idx, 0, size FROM windows WHERE window_idx = 0
  UNION ALL
  SELECT w.doc_id, w.window_idx, CASE WHEN m.size + w.size <= {TARGET} THEN m.id ELSE m.id + 1 END, CASE WHEN m.size + w.size <= {TARGET} THEN m.size + w.size ELSE w.size END
  FROM m JOIN windows w ON w.doc_id = m.doc_id AND w.window_idx = m.window_idx + 1)
SELECT m.doc_id, CAST(m.id AS INTEGER) AS window_idx, min(first_line) AS first_line, max(last_line) AS last_line, CAST(sum(w.size) AS BIGINT) AS size
FROM m JOIN windows w USING (doc_id, window_idx) GROUP BY m.doc_id, m.id""")
def merge_windows(spark, d):
    return W.merge_windows(W.line_windows(_t(spark, d, "documents"), MOST), TARGET)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, idx, overlap FROM lapped")
def chunk_overlap(spark, d):
    return W.line_chunks(_t(spark, d, "documents"), MOST, OVERLAP).select("doc_id", "idx", "overlap")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, idx, total, first_line, last_line, chunk FROM chunks")
def chunk_index_total(spark, d):
    return W.line_chunks(_t(spark, d, "documents"), MOST, 0).select("doc_id", "idx", "total", "first_line", "last_line", "chunk")


_WORDS = r"'[A-Za-z]{14,}'"


@query(f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, idx, concat_ws({_NL}, '# src/' || source || '/doc' || doc_id || '.txt', '# Scope: ' || source || ' > ' || lang,
  CASE WHEN len(def) > 0 THEN '# Defines: ' || array_to_string(def, ', ') END, CASE WHEN len(uses) > 0 THEN '# Uses: ' || array_to_string(uses[1:10], ', ') END,
  CASE WHEN idx > 0 THEN '# After: part' || (idx - 1) END, CASE WHEN idx + 1 < total THEN '# Before: part' || (idx + 1) END, '',
  CASE WHEN overlap IS NOT NULL THEN '# ...' || {_NL} || overlap || {_NL} || '# ---' END, chunk) AS contextualized
FROM (SELECT l.*, source, lang, regexp_extract_all(chunk, {_WORDS}) AS def, regexp_extract_all(chunk, '[A-Za-z]{{12,}}') AS uses FROM lapped l JOIN documents USING (doc_id))""")
def contextualized_text(spark, d):
    c = W.line_chunks(_t(spark, d, "documents"), MOST, OVERLAP, keep=("source", "lang"))
    no = F.array().cast("array<string>")
    part = lambda n: F.array(F.concat(F.lit("part"), n.cast("string")))
    text = W.contextualized(
        F.col("chunk"),
        F.concat(F.lit("home/src/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")),
        F.array("lang", "source"),
        F.regexp_extract_all("chunk", F.lit("[A-Za-z]{14,}"), F.lit(0)),
        F.regexp_extract_all("chunk", F.lit("[A-Za-z]{12,}"), F.lit(0)),
        F.when(F.col("idx") > 0, part(F.col("idx") - 1)).otherwise(no),
        F.when(F.col("idx") + 1 < F.col("total"), part(F.col("idx") + 1)).otherwise(no),
        F.col("overlap"),
    )
    return c.select("doc_id", "idx", text.alias("contextualized"))


_EXTS = ["ts", "tsx", "js", "mjs", "py", "pyi", "rs", "go", "java", "rb", "PY", "txt"]
_PATH_SQL = f"CASE WHEN p_partkey % 13 = 12 THEN 'bin/part' || p_partkey ELSE 'src/v1.2/part' || p_partkey || '.' || {_EXTS}[CAST(p_partkey % 13 AS INTEGER) + 1] END"


@query(f"""SELECT p_partkey, CASE WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext IN ('js', 'mjs') THEN 'javascript' WHEN ext IN ('py', 'pyi') THEN 'python'
  WHEN ext = 'rs' THEN 'rust' WHEN ext = 'go' THEN 'go' WHEN ext = 'java' THEN 'java' WHEN p_partkey % 2 = 0 AND ext = 'txt' THEN 'go' END AS language
FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 < 12 THEN {_EXTS}[CAST(p_partkey % 13 AS INTEGER) + 1] END AS ext FROM part)""")
def detect_language(spark, d):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), F.least(k % 13, F.lit(11)).cast("int") + 1)
    path = F.when(k % 13 == 12, F.concat(F.lit("bin/part"), k.cast("string"))).otherwise(F.concat(F.lit("src/v1.2/part"), k.cast("string"), F.lit("."), ext))
    override = F.when((k % 2 == 0) & (k % 13 == 11), F.lit("go"))
    return _t(spark, d, "part").select("p_partkey", T.detect_language(path, override).alias("language"))


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p), '^(\\./)+', ''), '^/+', ''), '/+', '/', 'g'), '/+$', '')) AS path FROM (
  SELECT s_suppkey, ' ' || CASE s_suppkey % 4 WHEN 0 THEN './././' WHEN 1 THEN '///' WHEN 2 THEN './/' ELSE '' END || 'a//b' || s_suppkey || '///c.py' || CASE WHEN s_suppkey % 3 = 0 THEN '//' ELSE '' END || ' ' AS p FROM supplier)""")
def normalize_path(spark, d):
    k = F.col("s_suppkey")
    lead = F.when(k % 4 == 0, "./././").when(k % 4 == 1, "///").when(k % 4 == 2, ".//").otherwise("")
    p = F.concat(F.lit(" "), lead, F.lit("a//b"), k.cast("string"), F.lit("///c.py"), F.when(k % 3 == 0, "//").otherwise(""), F.lit(" "))
    return _t(spark, d, "supplier").select("s_suppkey", T.normalize_path(p).alias("path"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '/other/x' || s_suppkey ELSE 'lib/x' || s_suppkey END AS path,
  'repo__' || s_suppkey || '.git' AS clone, 'inst_' || s_suppkey || '_v_1' AS folder FROM supplier""")
def strip_prefix(spark, d):
    k = F.col("s_suppkey").cast("string")
    m = F.col("s_suppkey") % 3
    p = F.when(m == 0, F.concat(F.lit("/w t/i/lib/x"), k)).when(m == 1, F.concat(F.lit("/w%20t/i/lib/x"), k)).otherwise(F.concat(F.lit("/other/x"), k))
    return _t(spark, d, "supplier").select(
        "s_suppkey", T.strip_prefix(p, F.lit("/w t/i//")).alias("path"), T.bare_clone_name(F.concat(F.lit("repo/"), k)).alias("clone"), T.safe_name(F.concat(F.lit("inst/"), k, F.lit(":v.1"))).alias("folder")
    )


def _patches(spark, d):
    """A unified diff for every order: one file for each line item, and one deletion."""
    head = F.format_string("diff --git a/old%d.py b/./pkg//m%d.py\nindex 1..2\n--- x\n+++ y", F.col("l_linenumber"), F.col("l_partkey") % 7)
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(head)), "\n").alias("p"))
    return per.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("diff --git a/gone.py b//dev/null\n"), "p", F.lit("\n+ text diff --git a/no b/no\n")).alias("patch"))


@query("SELECT DISTINCT l_orderkey AS o_orderkey, 'pkg/m' || (l_partkey % 7) || '.py' AS file FROM lineitem")
def oracle_files(spark, d):
    return _patches(spark, d).select("o_orderkey", F.explode(T.diff_files("patch")).alias("file"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, left(text, 200) AS snippet FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"), F.left("text", F.lit(200)).alias("snippet"))


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'))) AS INTEGER) AS n FROM documents")
def identifier_sets(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.identifiers("text")).alias("n"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS signature FROM documents")
def clean_signature(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean_signature("text").alias("signature"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def unit_norm(spark, d):
    e = F.col("embedding").cast("array<double>")
    return _t(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(e, e)), 6).alias("norm"), F.round(V.unit(e)[0], 6).alias("first"))


def _index(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.format_string("src/l%d/v%d.py", F.col("label"), F.col("vec_id")).alias("filepath"), "embedding")


def _first_vector(spark, d):
    return _t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _topk_sql(where: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT 'src/l' || v.label || '/v' || v.vec_id || '.py' AS filepath, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q {where} ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id LIMIT 10"""


@query(_topk_sql(""))
def cosine_topk(spark, d):
    return V.search(_index(spark, d), _first_vector(spark, d)).select("filepath", F.round("score", 6).alias("score"))


@query(_topk_sql("WHERE v.label IN (3, 4)"))
def cosine_topk_filtered(spark, d):
    return V.search(_index(spark, d), _first_vector(spark, d), pattern="^src/l[34]/").select("filepath", F.round("score", 6).alias("score"))


_RANKED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ranked AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.label = v.label AS hit, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS rank
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10)"""


def _ranked(spark, d):
    e = _t(spark, d, "embeddings")
    found = V.search_many(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    labels = e.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").withColumn("hit", F.col("label") == F.col("want"))


@query(f"""WITH {_RANKED} SELECT query_id, CAST(max(CASE WHEN rank <= 1 AND hit THEN 1 ELSE 0 END) AS INTEGER) AS hit_1, CAST(max(CASE WHEN rank <= 3 AND hit THEN 1 ELSE 0 END) AS INTEGER) AS hit_3,
  CAST(max(CASE WHEN rank <= 5 AND hit THEN 1 ELSE 0 END) AS INTEGER) AS hit_5, CAST(max(CASE WHEN hit THEN 1 ELSE 0 END) AS INTEGER) AS hit_10 FROM ranked GROUP BY query_id""")
def hit_at_k(spark, d):
    return V.ranking_metrics(_ranked(spark, d)).drop("reciprocal_rank")


@query(f"WITH {_RANKED} SELECT round(avg(r), 6) AS mrr FROM (SELECT coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS r FROM ranked GROUP BY query_id)")
def mrr(spark, d):
    ranked = _ranked(spark, d)
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("f"))
    return first.agg(F.round(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""WITH {_RANKED}, o AS (SELECT query_id, v.vec_id FROM (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 50 = 0) q JOIN v ON v.label = q.label AND v.vec_id % 7 = query_id % 7 AND v.vec_id <> query_id AND query_id % 150 <> 0)
SELECT query_id, round(coalesce(h * 1.0 / n, 1), 6) AS coverage FROM (SELECT DISTINCT query_id FROM ranked) LEFT JOIN
  (SELECT o.query_id, count(*) AS n, count(r.vec_id) AS h FROM o LEFT JOIN ranked r ON r.query_id = o.query_id AND r.vec_id = o.vec_id GROUP BY o.query_id) USING (query_id)""")
def coverage_at_k(spark, d):
    ranked = _ranked(spark, d).select("query_id", "rank", F.col("vec_id").alias("file"))
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("file"), "label")
    q = e.where("file % 50 = 0").select(F.col("file").alias("query_id"), "label")
    oracle = q.join(e, "label").where("file % 7 = query_id % 7 and file <> query_id and query_id % 150 <> 0")
    return V.coverage(ranked, oracle, 10)


# Ranges: regions hold nations, nations hold customers.


_WIDTH = 10**6


def _ranges(spark, d):
    r, n, c = _t(spark, d, "region"), _t(spark, d, "nation"), _t(spark, d, "customer")
    span = lambda df, i, s, n: df.select((F.col(f) % 2).cast("long").alias("file_id"), i.cast("long").alias("id"), s.cast("long").alias("start"), (s + n).cast("long").alias("end"))
    f = "r_regionkey"
    a = span(r, F.col("r_regionkey") + 1, F.col("r_regionkey") * 100000000, 100000000)
    f = "n_regionkey"
    at = F.col("n_regionkey") * 100000000 + F.col("n_nationkey") * 1000000
    b = span(n, F.col("n_nationkey") + 100, at, 1000000)
    nc = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    e = span(nc, F.col("c_custkey") + 1000, at + F.pmod(F.col("c_custkey"), F.lit(49999)) * 20, 10)
    return a.unionByName(b).unionByName(e)


_RANGES = """ranges AS (
  SELECT r_regionkey % 2 AS file_id, r_regionkey + 1 AS id, r_regionkey * 100000000 AS s, (r_regionkey + 1) * 100000000 AS e FROM region
  UNION ALL SELECT n_regionkey % 2, n_nationkey + 100, n_regionkey * 100000000 + n_nationkey * 1000000, n_regionkey * 100000000 + (n_nationkey + 1) * 1000000 FROM nation
  UNION ALL SELECT n_regionkey % 2, c_custkey + 1000, n_regionkey * 100000000 + n_nationkey * 1000000 + (c_custkey % 49999) * 20, n_regionkey * 100000000 + n_nationkey * 1000000 + (c_custkey % 49999) * 20 + 10 FROM customer JOIN nation ON c_nationkey = n_nationkey),
parents AS (SELECT CAST(i.file_id AS BIGINT) AS file_id, CAST(i.id AS BIGINT) AS id, CAST((SELECT o.id FROM ranges o WHERE o.file_id = i.file_id AND o.s <= i.s AND i.e <= o.e AND (o.s < i.s OR (o.s = i.s AND o.id < i.id)) ORDER BY o.s DESC, o.id DESC LIMIT 1) AS BIGINT) AS parent FROM ranges i)"""


@query(f"WITH {_RANGES} SELECT * FROM parents")
def scope_parent(spark, d):
    return S.scope_parents(_ranges(spark, d))


@query(f"""WITH {_RANGES}, p AS (SELECT CAST(o_orderkey AS BIGINT) AS point, CAST(o_orderkey % 2 AS BIGINT) AS file_id, CAST(o_orderkey * 7919 % 500000000 AS BIGINT) AS spot FROM orders)
SELECT file_id, point, spot, CAST((SELECT r.id FROM ranges r WHERE r.file_id = p.file_id AND r.s <= p.spot AND p.spot < r.e ORDER BY r.s DESC, r.id DESC LIMIT 1) AS BIGINT) AS scope FROM p""")
def scope_at_offset(spark, d):
    k = F.col("o_orderkey").cast("long")
    points = _t(spark, d, "orders").select(k.alias("point"), (k % 2).alias("file_id"), (k * 7919 % 500000000).alias("at"))
    return S.scope_at(points, _ranges(spark, d), _WIDTH).select("file_id", "point", F.col("at").alias("spot"), "scope")


@query(f"""WITH RECURSIVE {_RANGES}, up(file_id, id, nxt, depth, chain) AS (
  SELECT file_id, id, parent, 0, '' FROM parents UNION ALL
  SELECT up.file_id, up.id, p.parent, depth + 1, chain || '/' || up.nxt FROM up JOIN parents p ON p.file_id = up.file_id AND p.id = up.nxt)
SELECT file_id, id, CAST(depth AS INTEGER) AS depth, chain FROM up WHERE nxt IS NULL""")
def ancestor_chain(spark, d):
    chains = S.ancestors(S.scope_parents(_ranges(spark, d)))
    return chains.select("file_id", "id", "depth", F.concat_ws("", F.transform("chain", lambda x: F.concat(F.lit("/"), x.cast("string")))).alias("chain"))


@query(f"""WITH RECURSIVE {_RANGES}, up(file_id, id, nxt, depth) AS (SELECT file_id, id, parent, 0 FROM parents UNION ALL SELECT up.file_id, up.id, p.parent, depth + 1 FROM up JOIN parents p ON p.file_id = up.file_id AND p.id = up.nxt)
SELECT up.file_id, up.id, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY up.file_id ORDER BY r.s, depth, up.id) AS INTEGER) AS position FROM up JOIN ranges r ON r.file_id = up.file_id AND r.id = up.id WHERE nxt IS NULL""")
def scope_flatten(spark, d):
    e = _ranges(spark, d)
    return S.flattened(e, S.ancestors(S.scope_parents(e)))


_LINE_RANGES = f"""{_LINES}, e AS (SELECT doc_id AS file_id, line_no AS id, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(line) AS n FROM lines),
c AS (SELECT doc_id AS file_id, k AS chunk, k * 400 AS cs, least(k * 400 + 400, length(text)) AS ce FROM documents, unnest(range(0, CAST(ceil(length(text) / 400.0) AS BIGINT))) AS u(k))"""


@query(f"WITH {_LINE_RANGES} SELECT c.file_id, CAST(chunk AS BIGINT) AS chunk, id, s < cs OR s + n > ce AS is_partial FROM c JOIN e ON e.file_id = c.file_id AND s < ce AND s + n > cs")
def entities_in_range(spark, d):
    docs = _t(spark, d, "documents")
    lines = W.numbered_lines(docs).select(F.col("doc_id").alias("file_id"), F.col("line_no").alias("id"), "start", (F.col("start") + F.col("length")).alias("end"))
    n = F.length("text").cast("long")
    chunks = docs.where(n > 0).select(F.col("doc_id").alias("file_id"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / 400) - 1)).alias("chunk"))
    chunks = chunks.select("file_id", "chunk", (F.col("chunk") * 400).alias("c_start"), F.least(F.col("chunk") * 400 + 400, "n").alias("c_end"))
    return S.entities_in_range(chunks, lines)


@query("""SELECT CAST(a.o_custkey AS BIGINT) AS file_id, a.o_orderkey AS id, b.o_orderkey AS sibling, CASE WHEN b.n < a.n THEN 'before' ELSE 'after' END AS position, CAST(abs(b.n - a.n) AS INTEGER) AS distance
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) a
JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(b.n - a.n) <= 3""")
def siblings_topk(spark, d):
    from pyspark.sql import Window

    o = _t(spark, d, "orders")
    nodes = o.select(F.col("o_custkey").cast("long").alias("file_id"), F.lit(None).cast("long").alias("parent"), F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ord"))
    return S.siblings(nodes)


@query(f"""WITH {_RANGES}, pts AS (SELECT CAST(o_orderkey % 2 AS BIGINT) AS file_id, CAST(o_orderkey AS BIGINT) AS chunk, CAST(o_orderkey * 7919 % 500000000 AS BIGINT) AS cs, CAST(o_orderkey * 7919 % 500000000 + 1500 * (o_orderkey % 700) AS BIGINT) AS ce FROM orders),
level AS (SELECT r.*, p.parent AS up, row_number() OVER (PARTITION BY r.file_id, p.parent ORDER BY r.s, r.id) AS i, count(*) OVER (PARTITION BY r.file_id, p.parent) AS n FROM ranges r JOIN parents p ON p.file_id = r.file_id AND p.id = r.id WHERE r.id < 1000),
c AS (SELECT pts.*, l.up, l.i AS here FROM pts LEFT JOIN (SELECT pts.chunk, arg_max(l.id, l.s * 1000000 + l.id) AS scope FROM pts JOIN level l ON l.file_id = pts.file_id AND l.s <= pts.cs AND pts.cs < l.e GROUP BY pts.chunk) x ON x.chunk = pts.chunk LEFT JOIN level l ON l.id = x.scope AND l.file_id = pts.file_id),
met AS (SELECT c.file_id, c.chunk, l.id AS sibling, CASE WHEN l.s < c.cs THEN 'before' ELSE 'after' END AS position, CASE WHEN c.here IS NOT NULL THEN abs(l.i - c.here) WHEN l.s < c.cs THEN l.n - l.i + 1 ELSE l.i END AS distance
  FROM c JOIN level l ON l.file_id = c.file_id AND l.up IS NOT DISTINCT FROM c.up AND NOT (l.s < c.ce AND l.e > c.cs))
SELECT file_id, chunk, CAST(sibling AS BIGINT) AS sibling, position, CAST(distance AS INTEGER) AS distance FROM met QUALIFY row_number() OVER (PARTITION BY chunk, position ORDER BY distance) <= 3""")
def siblings_of_ranges(spark, d):
    """Orders as ranges over the nations: neither those that a range overlaps nor its own scope are its neighbours."""
    e = _ranges(spark, d).where("id < 1000")
    k = F.col("o_orderkey").cast("long")
    at = k * 7919 % 500000000
    chunks = _t(spark, d, "orders").select(k.alias("chunk"), (k % 2).alias("file_id"), at.alias("c_start"), F.greatest(at + 1500 * (k % 700), at).alias("c_end"))
    found = S.scope_at(chunks.select("file_id", F.col("chunk").alias("point"), F.col("c_start").alias("at")), e, _WIDTH).select(F.col("point").alias("chunk"), "scope")
    nodes = e.join(S.scope_parents(e), ["file_id", "id"])
    return S.siblings_of_ranges(chunks.join(found, "chunk"), nodes)


@query(r"""SELECT d.doc_id AS file_id, name FROM documents d JOIN (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'))) AS name FROM benchmark) b
ON b.item_id = d.doc_id % 40 AND list_contains(regexp_extract_all(d.text, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'), name)""")
def used_imports(spark, d):
    """Every document imports the words of a benchmark item; those that its text uses.  One scan, nothing shuffled."""
    known = _t(spark, d, "benchmark").select("item_id", T.identifiers("text").alias("imports"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), (F.col("doc_id") % 40).alias("item_id"), "text").join(known, "item_id")
    return docs.select("file_id", F.explode(S.used_names(F.col("imports"), T.identifiers("text"))).alias("name"))


@query("SELECT DISTINCT o_custkey AS file_id, o_orderkey % 50 AS name FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def import_semi_join(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    imports = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("name"))
    names = li.where("l_quantity > 30").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("name"))
    return S.used_imports(imports, names).select("file_id", (F.col("name") % 50).alias("name")).distinct()


# Events as an agent's log: the user is the session, the event type the tool, k of props the path.


def _log(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("event_no"), F.col("event_type").alias("tool"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_ms"), F.get_json_object("props", "$.k").cast("long").alias("path"), F.floor(F.abs("value") * 100).cast("long").alias("tokens"))


_LOG = """log AS (SELECT user_id AS session, event_id AS event_no, event_type AS tool, epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS path, CAST(floor(abs(value) * 100) AS BIGINT) AS tokens FROM events)"""


@query(f"WITH {_LOG} SELECT session, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY event_no) AS n FROM log) WHERE n = 1 GROUP BY session")
def usage_dedupe_sum(spark, d):
    return E.usage(_log(spark, d), "session", "path", ["event_no"], ("tokens",))


@query(f"""WITH {_LOG} SELECT e.session, e.event_no, CAST(coalesce(e.ts_ms - s.t, 0) AS BIGINT) AS latency_ms FROM log e
LEFT JOIN (SELECT session, path, min(ts_ms) AS t FROM log WHERE event_no % 2 = 0 GROUP BY session, path) s ON s.session = e.session AND s.path = e.path WHERE e.event_no % 2 = 1""")
def tool_latency(spark, d):
    log = _log(spark, d)
    return E.tool_latency(log.where("event_no % 2 = 0"), log.where("event_no % 2 = 1"), ["session", "path"]).select("session", "event_no", "latency_ms")


@query(f"WITH {_LOG} SELECT session, tool, CAST(sum(tokens) AS BIGINT) AS chars FROM log GROUP BY session, tool")
def output_chars_by_tool(spark, d):
    return E.map_sum(_log(spark, d), "session", "tool", "tokens", "m").select("session", F.explode("m").alias("tool", "chars"))


@query(f"""WITH {_LOG}, p AS (SELECT session, event_no, place, CASE place WHEN 0 THEN (path * 7) % 50 WHEN 1 THEN path ELSE (path + event_no) % 50 END AS path FROM log, unnest([0, 1, 2]) AS u(place)),
f AS (SELECT session, path, min(event_no * 3 + place) AS a FROM p GROUP BY session, path) SELECT session, CAST(path AS BIGINT) AS path, CAST(row_number() OVER (PARTITION BY session ORDER BY a) AS INTEGER) AS rank FROM f""")
def first_seen_rank(spark, d):
    """An event names three paths; the ranking follows events, and within one the order of its paths."""
    k = F.col("path")
    three = F.posexplode(F.array(k * 7 % 50, k, (k + F.col("event_no")) % 50)).alias("place", "path")
    return E.first_seen(_log(spark, d).select("session", "event_no", three), order=("event_no", "place"))


@query(f"""WITH {_LOG}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY event_no) AS u FROM log)
SELECT session, CAST(arg_min(ts_ms, event_no) AS BIGINT) AS ts_ms, CAST(arg_min(u, event_no) AS BIGINT) AS tokens FROM r WHERE path % 5 = 0 GROUP BY session""")
def first_hit(spark, d):
    return E.first_hit(_log(spark, d).withColumn("hit", F.col("path") % 5 == 0))


@query(f"WITH {_LOG} SELECT tool, quantile_disc(tokens, 0.5) AS p50, quantile_disc(tokens, 0.9) AS p90, quantile_disc(CASE WHEN path < 0 THEN tokens END, 0.5) AS none FROM log GROUP BY tool")
def percentile_nearest_rank(spark, d):
    return _log(spark, d).withColumn("x", F.expr("case when path < 0 then tokens end")).groupBy("tool").agg(*[E.nearest_rank(c, p).cast("long").alias(n) for c, p, n in (("tokens", 50, "p50"), ("tokens", 90, "p90"), ("x", 50, "none"))])


_SUMMARY = f"""{_LOG}, s AS (SELECT CASE WHEN session % 2 = 0 THEN 'ops' ELSE 'search' END AS variant, count(*) AS n, round(avg(CASE WHEN path % 5 = 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(tokens), 6) AS mean_tokens,
  quantile_disc(tokens, 0.5) AS p50_tokens, quantile_disc(tokens, 0.9) AS p90_tokens FROM log GROUP BY 1)"""


def _summary(spark, d):
    m = _log(spark, d).withColumn("variant", F.when(F.col("session") % 2 == 0, "ops").otherwise("search"))
    return E.variant_summary(m, ["ops", "search", "absent"], {"hit_rate": F.col("path") % 5 == 0}, ["tokens"], {"tokens": (50, 90)})


@query(f"WITH {_SUMMARY} SELECT * FROM s UNION ALL SELECT 'absent', 0, 0, 0, 0, 0")
def variant_summary(spark, d):
    return _summary(spark, d)


@query(f"WITH {_SUMMARY} SELECT round(a.hit_rate - b.hit_rate, 6) AS delta_hit_rate, round(a.mean_tokens - b.mean_tokens, 6) AS delta_mean_tokens FROM s a, s b WHERE a.variant = 'search' AND b.variant = 'ops'")
def variant_delta(spark, d):
    return E.delta(_summary(spark, d), "search", "ops", ["hit_rate", "mean_tokens"])


@query("SELECT count(DISTINCT user_id) AS instances FROM events")
def distinct_instances(spark, d):
    return _t(spark, d, "events").agg(F.countDistinct("user_id").alias("instances"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'a/x' || conv_id || '.py,b.py' WHEN 1 THEN 'q/z' || conv_id || '.rs' ELSE 'lib/m' || conv_id || '.go,lib/n.js,//x/y.html' END AS files FROM conversations""")
def parse_top_files(spark, d):
    k = F.col("conv_id").cast("string")
    m = F.col("turn") % 3
    plain = F.regexp_replace("text", "[./`{}]", " ")
    o = (
        F.when(m == 0, F.concat(plain, F.lit('\n```json\n{"top_files": ["a/x'), k, F.lit('.py", "b.py"]}\n```\n see c/d.py')))
        .when(m == 1, F.concat(plain, F.lit(' {"why": {}, "top_files": ["q/z'), k, F.lit('.rs"]} ')))
        .otherwise(F.concat(plain, F.lit(" look at lib/m"), k, F.lit(".go and lib/n.js, lib/n.js or plain.py, http://x/y.html .../z.c")))
    )
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.declared_files(o), ",").alias("files"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'r/' || event_id || '.py' WHEN 1 THEN 'g/' || event_id || '.py|h.py' WHEN 2 THEN 'b' || event_id || '|c' ELSE 's/' || event_id || '|t' END AS paths FROM events""")
def tool_output_paths(spark, d):
    k = F.col("event_id").cast("string")
    m = F.col("event_id") % 4
    tool = F.when(m == 0, "Read").when(m == 1, "Grep").when(m == 2, "Glob").otherwise("mcp__semantic_search__search")
    given = F.when(m == 0, F.concat(F.lit("r/"), k, F.lit(".py")))
    out = (
        F.when(m == 0, "whatever: 1")
        .when(m == 1, F.concat(F.lit("g/"), k, F.lit(".py:12:x\n17: no\nnone\nword:x\nh.py:3")))
        .when(m == 2, F.concat(F.lit("b"), k, F.lit("\n\nc")))
        .otherwise(F.concat(F.lit("Found\n__FILES__\ns/"), k, F.lit("\nt\n__END_FILES__")))
    )
    return _t(spark, d, "events").select("event_id", F.array_join(T.tool_paths(tool, given, out), "|").alias("paths"))


@query("""SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0) ELSE printf('%.1fm', ms / 60000.0) END AS duration,
  CASE WHEN ms * 100 < 1000 THEN (ms * 100) || '' WHEN ms * 100 < 1000000 THEN printf('%.1fk', ms * 100 / 1000.0) ELSE printf('%.2fM', ms * 100 / 1000000.0) END AS tokens FROM (SELECT event_id, event_id * 100 + 3 AS ms FROM events)""")
def humanize(spark, d):
    ms = F.col("event_id") * 100 + 3
    return _t(spark, d, "events").select("event_id", T.humanize_ms(ms).alias("duration"), T.humanize_tokens(ms * 100).alias("tokens"))


@query("""SELECT event_id, CASE WHEN event_id % 50 >= 40 THEN 'Tool budget exceeded' WHEN event_id % 4 = 0 THEN 'allowed' WHEN event_id % 4 = 1 THEN 'Tool is denied for retrieval-only mode' ELSE 'Tool not in allowlist' END AS verdict FROM events""")
def tool_allowed(spark, d):
    m = F.col("event_id") % 4
    tool = F.when(m == 0, "Read").when(m == 1, "Write").otherwise("Else")
    return _t(spark, d, "events").select("event_id", T.tool_allowed(tool, F.col("event_id") % 50, 40, ["Read", "Grep", "Glob"], ["Write", "Bash"]).alias("verdict"))




def _quality_sql(name: str, first: str, five: str, ten: str) -> str:
    """Columns of one ranking, given where the first wanted file stands (null: nowhere) and the coverages."""
    hits = ", ".join(f"coalesce({first} <= {k}, false) AS hit_at_{k}_{name}" for k in (1, 3, 5, 10))
    return f"{hits}, round(coalesce(1.0 / {first}, 0.0), 6)::DOUBLE AS mrr_{name}, ({five})::DOUBLE AS coverage_at_5_{name}, ({ten})::DOUBLE AS coverage_at_10_{name}"


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier)
SELECT CAST(k AS VARCHAR) AS instance_id, 'ops' AS agent_variant, CASE WHEN m = 0 THEN '' ELSE 'b.py,x/a.py' END AS oracle_files,
  {_quality_sql("behavioral", "(CASE m WHEN 1 THEN 1 WHEN 2 THEN 2 END)", "CASE m WHEN 0 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.5 END", "CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END")},
  {_quality_sql("declared", "(CASE WHEN m <> 0 THEN k % 6 + 1 END)", "CASE WHEN m = 0 THEN 1.0 WHEN k % 6 + 1 <= 5 THEN 0.5 ELSE 0.0 END", "CASE WHEN m = 0 THEN 1.0 ELSE 0.5 END")},
  CASE WHEN m IN (1, 2) THEN k * 5 END AS time_to_first_hit_ms, CASE WHEN m IN (1, 2) THEN k END AS tokens_to_first_hit, k * 10 AS total_duration_ms, CAST(k AS DOUBLE) / 4 AS total_cost_usd, k * 2 AS total_input_tokens, k * 3 AS total_output_tokens, k % 9 AS tool_calls_count,
  CASE WHEN k % 2 = 0 THEN k % 5 END AS semantic_search_calls, CASE WHEN k % 2 = 0 THEN k + 7 END AS embed_latency_ms, CASE WHEN k % 2 = 0 THEN k * 1000 + 500 END AS embed_tokens, CASE WHEN k % 2 = 0 THEN round((k * 1000 + 500) / 1000.0 * 0.00002, 9) END::DOUBLE AS embed_cost_usd,
  k * 3 AS tool_output_chars_total, 'Grep=' || (k * 2) || ',Read=' || k AS tool_output_chars_by_type, CASE WHEN k % 6 = 0 THEN 'b.py' ELSE array_to_string(list_transform(range(0, k % 6), lambda i: 'n' || i), ',') || ',b.py' END AS top_files_final,
  CASE m WHEN 1 THEN './x//a.py,q,q,q,q,q,/b.py' WHEN 2 THEN 'z.py,b.py' WHEN 0 THEN 'any.py' ELSE '' END AS ranked_files_from_tools FROM s""")
def instance_metrics(spark, d):
    """Every run has a.py and b.py to find (none if divisible by 4); how soon it does depends on its number."""
    from loomcut.operators import evaluation as X

    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    k, m = F.col("k"), F.col("k") % 4
    i = k.cast("string").alias("instance_id")
    patch = F.when(m != 0, "diff --git a/x/a.py b/x/a.py\n\ndiff --git a/b.py b/./b.py\n").otherwise("")
    oracle = X.extract_oracle(s.select(i, patch.alias("patch")))
    files = F.when(m == 1, F.array(*map(F.lit, ["./x//a.py", "q", "q", "q", "q", "q", "/b.py"]))).when(m == 2, F.array(F.lit("z.py"), F.lit("b.py"))).when(m == 0, F.array(F.lit("any.py")))
    declared = F.concat(F.expr("transform(filter(array(0, 1, 2, 3, 4), i -> i < k % 6), i -> 'n' || i)"), F.array(F.lit("b.py")))
    hit, even = m.isin(1, 2), k % 2 == 0
    runs = s.select(
        i, F.lit("ops").alias("agent_variant"), files.alias("ranked_files_from_tools"), declared.alias("top_files_final"), F.when(hit, k * 5).alias("time_to_first_hit_ms"), F.when(hit, k).alias("tokens_to_first_hit"), (k * 10).alias("total_duration_ms"), (k / 4).alias("total_cost_usd"),
        (k * 2).alias("total_input_tokens"), (k * 3).alias("total_output_tokens"), (k % 9).alias("tool_calls_count"), F.create_map(F.lit("Read"), k.cast("long"), F.lit("Grep"), (k * 2).cast("long")).alias("tool_output_chars_by_type"),
        F.when(even, k % 5).alias("semantic_search_calls"), (k * 1000).alias("query_embed_tokens"), k.alias("query_embed_latency_ms"), F.lit(500).alias("index_embed_tokens"), F.lit(7).alias("index_load_ms"),
    )
    return _flat(X.instance_metrics(runs, oracle))


def _flat(metrics):
    """Arrays and maps as text, which either engine can compare."""
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("tool_output_chars_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return metrics.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else entries.alias(c) if t.startswith("map") else F.col(c) for c, t in metrics.dtypes])


def _sessions(spark, d):
    """Sessions of the event log as runs: every event is a call that names three paths, every fourth one reports usage too."""
    from loomcut.operators import evaluation as X

    log = _log(spark, d)
    k = F.col("path")
    named = F.array(*[F.concat(F.lit("./f"), p.cast("string"), F.lit(".py")) for p in (k * 7 % 50, k, (k + F.col("event_no")) % 50)])
    none = lambda t: F.lit(None).cast(t)
    begin = log.groupBy("session").agg(F.min("ts_ms").alias("begin"), F.max("ts_ms").alias("last"))
    timed = log.withColumn("timestamp", F.col("ts_ms"))  # the session's begin is taken off the few hits, not all events
    calls = timed.select("session", (F.col("event_no") * 2).alias("event_no"), F.lit("tool_call").alias("type"), "timestamp", F.col("tool").alias("tool_name"), F.col("tokens").alias("output_chars"), named.alias("paths"), none("string").alias("message_id"), none("long").alias("input_tokens"), none("long").alias("output_tokens"))
    used = timed.where("event_no % 4 = 0").select("session", (F.col("event_no") * 2 + 1).alias("event_no"), F.lit("usage").alias("type"), "timestamp", none("string").alias("tool_name"), none("long").alias("output_chars"), none("array<string>").alias("paths"), (F.col("path") % 20).cast("string").alias("message_id"), F.col("tokens").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    s = F.col("session")
    sessions = begin.select("session", s.cast("string").alias("instance_id"), F.when(s % 2 == 0, "ops-only").otherwise("ops-plus-search").alias("agent_variant"), (F.col("last") - F.col("begin")).alias("total_duration_ms"), (s.cast("double") / 8).alias("total_cost_usd"), F.array(F.lit("none.py")).alias("top_files_final"))
    oracle = begin.where("session % 5 <> 0").select(s.cast("string").alias("instance_id"), F.concat(F.lit("f"), (s % 50).cast("string"), F.lit(".py")).alias("file"))
    runs = X.runs_of_events(calls.unionByName(used), sessions, oracle).join(begin.select(s.cast("string").alias("instance_id"), "begin"), "instance_id", "left")
    return X.instance_metrics(runs.withColumn("time_to_first_hit_ms", F.col("time_to_first_hit_ms") - F.col("begin")).drop("begin"), oracle)


_SESSIONS = f"""{_LOG}, b AS (SELECT session, min(ts_ms) AS b, max(ts_ms) AS l FROM log GROUP BY session),
p AS (SELECT session, event_no, event_no * 3 + place AS pos, ts_ms, CASE place WHEN 0 THEN (path * 7) % 50 WHEN 1 THEN path ELSE (path + event_no) % 50 END AS path FROM log, unnest([0, 1, 2]) AS u(place)),
f AS (SELECT session, path, min(pos) AS a FROM p GROUP BY session, path), ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY a) AS rank FROM f),
hit AS (SELECT session, a // 3 AS event_no, rank FROM ranked WHERE path = session % 50 AND session % 5 <> 0),
u AS (SELECT * FROM log WHERE event_no % 4 = 0 QUALIFY row_number() OVER (PARTITION BY session, path % 20 ORDER BY event_no) = 1),
spent AS (SELECT u.session, sum(tokens) AS i, count(*) AS o, sum(CASE WHEN u.event_no < h.event_no THEN tokens + 1 ELSE 0 END) AS t FROM u LEFT JOIN hit h ON h.session = u.session GROUP BY u.session),
m AS (SELECT CAST(b.session AS VARCHAR) AS instance_id, CASE WHEN b.session % 2 = 0 THEN 'ops-only' ELSE 'ops-plus-search' END AS variant, b.session % 5 = 0 AS free, h.rank, e.ts_ms - b.b AS time_hit, CASE WHEN h.rank IS NOT NULL THEN coalesce(s.t, 0) END AS token_hit, l - b AS duration, CAST(b.session AS DOUBLE) / 8 AS cost,
  coalesce(s.i, 0) AS i, coalesce(s.o, 0) AS o, (SELECT count(*) FROM log WHERE log.session = b.session) AS calls FROM b LEFT JOIN hit h ON h.session = b.session LEFT JOIN log e ON e.session = b.session AND e.event_no = h.event_no LEFT JOIN spent s ON s.session = b.session)"""


@query(f"""WITH {_SESSIONS} SELECT instance_id, variant AS agent_variant, coalesce(rank <= 10, false) AS hit_at_10_behavioral, round(coalesce(1.0 / rank, 0), 6)::DOUBLE AS mrr_behavioral, (CASE WHEN free OR rank <= 5 THEN 1 ELSE 0 END)::DOUBLE AS coverage_at_5_behavioral,
  (CASE WHEN free THEN 1 ELSE 0 END)::DOUBLE AS coverage_at_10_declared, CAST(time_hit AS BIGINT) AS time_to_first_hit_ms, CAST(token_hit AS BIGINT) AS tokens_to_first_hit, CAST(i AS BIGINT) AS total_input_tokens, CAST(o AS BIGINT) AS total_output_tokens, calls AS tool_calls_count FROM m""")
def session_metrics(spark, d):
    """From an event log to the metrics' rows."""
    return _sessions(spark, d).select("instance_id", "agent_variant", "hit_at_10_behavioral", "mrr_behavioral", "coverage_at_5_behavioral", "coverage_at_10_declared", "time_to_first_hit_ms", "tokens_to_first_hit", "total_input_tokens", "total_output_tokens", "tool_calls_count")


@query(f"""WITH {_SESSIONS} SELECT variant, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1_rate, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3_rate, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5_rate, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_at_10_rate,
  round(avg(round(coalesce(1.0 / rank, 0), 6)), 6) AS mean_mrr, round(avg(CASE WHEN free OR rank <= 5 THEN 1.0 ELSE 0 END), 6) AS mean_coverage_at_5, round(avg(CASE WHEN free OR rank <= 10 THEN 1.0 ELSE 0 END), 6) AS mean_coverage_at_10,
  CAST(sum(duration) AS BIGINT) AS total_duration_ms, CAST(sum(i + o) AS BIGINT) AS total_tokens, CAST(sum(i) AS BIGINT) AS total_input_tokens, CAST(sum(o) AS BIGINT) AS total_output_tokens, round(sum(cost), 6) AS total_cost_usd, CAST(sum(calls) AS BIGINT) AS total_tool_calls,
  CAST(quantile_disc(duration, 0.5) AS BIGINT) AS median_duration_ms, CAST(quantile_disc(duration, 0.9) AS BIGINT) AS p90_duration_ms, CAST(quantile_disc(i + o, 0.5) AS BIGINT) AS median_tokens, CAST(quantile_disc(i + o, 0.9) AS BIGINT) AS p90_tokens,
  CAST(quantile_disc(time_hit, 0.5) AS BIGINT) AS median_time_to_first_hit_ms, CAST(quantile_disc(token_hit, 0.5) AS BIGINT) AS median_tokens_to_first_hit FROM m GROUP BY variant""")
def event_summary(spark, d):
    """From an event log to the summary: sessions' metrics go straight into the aggregation."""
    from loomcut.operators import evaluation as X

    return X.aggregate_metrics(_sessions(spark, d))


_RUNS = """runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ops-only' ELSE 'ops-plus-search' END AS variant, o_custkey % 7 AS m, o_custkey AS c, o_orderkey AS o FROM orders),
s AS (SELECT variant, round(avg(CASE WHEN m < 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1_rate, round(avg(CASE WHEN m < 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3_rate, round(avg(CASE WHEN m < 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5_rate, round(avg(CASE WHEN m < 6 THEN 1.0 ELSE 0 END), 6) AS hit_at_10_rate,
  round(avg(1.0 / (m + 1)), 6) AS mean_mrr, round(avg(m / 7.0), 6) AS mean_coverage_at_5, round(avg(m / 6.0), 6) AS mean_coverage_at_10,
  CAST(sum(c * 10) AS BIGINT) AS total_duration_ms, CAST(sum(c + o) AS BIGINT) AS total_tokens, CAST(sum(c) AS BIGINT) AS total_input_tokens, CAST(sum(o) AS BIGINT) AS total_output_tokens, round(sum(CAST(m AS DOUBLE) / 4), 6) AS total_cost_usd, CAST(sum(m) AS BIGINT) AS total_tool_calls,
  CAST(quantile_disc(c * 10, 0.5) AS BIGINT) AS median_duration_ms, CAST(quantile_disc(c * 10, 0.9) AS BIGINT) AS p90_duration_ms, CAST(quantile_disc(c + o, 0.5) AS BIGINT) AS median_tokens, CAST(quantile_disc(c + o, 0.9) AS BIGINT) AS p90_tokens,
  CAST(quantile_disc(CASE WHEN variant = 'ops-only' AND m < 4 THEN c END, 0.5) AS BIGINT) AS median_time_to_first_hit_ms, CAST(quantile_disc(CASE WHEN m < 4 THEN o END, 0.5) AS BIGINT) AS median_tokens_to_first_hit
  FROM runs GROUP BY variant)"""


def _runs(spark, d):
    from loomcut.operators import evaluation as X

    m, c, o = F.col("o_custkey") % 7, F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long")
    variant = F.when(o % 2 == 0, "ops-only").otherwise("ops-plus-search")
    runs = _t(spark, d, "orders").select(
        o.cast("string").alias("instance_id"), variant.alias("agent_variant"), *[(m < x).alias(f"hit_at_{k}_behavioral") for k, x in ((1, 1), (3, 3), (5, 5), (10, 6))], (1.0 / (m + 1)).alias("mrr_behavioral"), (m / 7.0).alias("coverage_at_5_behavioral"), (m / 6.0).alias("coverage_at_10_behavioral"),
        (c * 10).alias("total_duration_ms"), c.alias("total_input_tokens"), o.alias("total_output_tokens"), (m.cast("double") / 4).alias("total_cost_usd"), m.cast("long").alias("tool_calls_count"),
        F.when((variant == "ops-only") & (m < 4), c).alias("time_to_first_hit_ms"), F.when(m < 4, o).alias("tokens_to_first_hit"),
    )
    return X.aggregate_metrics(runs)


@query(f"WITH {_RUNS} SELECT * FROM s")
def aggregate_metrics(spark, d):
    return _runs(spark, d)


@query(f"""WITH {_RUNS} SELECT round(b.hit_at_1_rate - a.hit_at_1_rate, 6) AS delta_hit_at_1_rate, round(b.hit_at_3_rate - a.hit_at_3_rate, 6) AS delta_hit_at_3_rate, round(b.hit_at_5_rate - a.hit_at_5_rate, 6) AS delta_hit_at_5_rate, round(b.mean_mrr - a.mean_mrr, 6) AS delta_mean_mrr,
  b.total_duration_ms - a.total_duration_ms AS delta_total_duration_ms, b.total_tokens - a.total_tokens AS delta_total_tokens, round(b.total_cost_usd - a.total_cost_usd, 6) AS delta_total_cost_usd FROM s a, s b WHERE a.variant = 'ops-only' AND b.variant = 'ops-plus-search'""")
def metric_deltas(spark, d):
    from loomcut.operators import evaluation as X

    return X.metric_deltas(_runs(spark, d))


@query("SELECT event_id, CAST(CASE WHEN event_id = 0 THEN 1 WHEN event_id % 3 = 0 THEN event_id * 2 WHEN event_id % 7 = 0 THEN 0 ELSE event_id + 5 END AS BIGINT) AS tokens FROM events")
def reported_usage(spark, d):
    """A session's reported usage, or what was added up where it is 0 or missing."""
    from loomcut.operators import evaluation as X

    k = F.col("event_id")
    e = _t(spark, d, "events").select("event_id", F.when(k % 3 == 0, k * 2).when(k % 5 == 0, 0).alias("reported"), F.when(k % 7 != 0, k + 5).when(k % 3 == 0, 1).alias("added"))
    return e.select("event_id", X.reported_usage("added", "reported").cast("long").alias("tokens"))


@query("""SELECT event_id, CASE WHEN event_id % 60 >= 50 THEN 'Tool budget exceeded' WHEN event_id % 4 = 0 THEN 'allowed' WHEN event_id % 4 = 1 THEN 'Tool is denied for retrieval-only mode' WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN 'allowed' ELSE 'Tool not in allowlist' END AS verdict FROM events""")
def policy_verdicts(spark, d):
    """Calls judged by their variant's policy: only one variant may search."""
    from loomcut.operators import evaluation as X

    k = F.col("event_id")
    tool = F.when(k % 4 == 0, "Grep").when(k % 4 == 1, "Bash").when(k % 4 == 2, "mcp__semantic_search__search").otherwise("Else")
    calls = _t(spark, d, "events").select("event_id", F.when(k % 3 == 0, X.VARIANTS[1]).otherwise(X.VARIANTS[0]).alias("agent_variant"), tool.alias("tool"), (k % 60).alias("so_far"))
    return X.judged_calls(calls, X.variant_policies(spark)).select("event_id", "verdict")


@query("SELECT event_id AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'usage' ELSE 'tool_call' END AS type, CAST(user_id AS VARCHAR) AS session, CAST(CASE WHEN event_id % 2 = 0 THEN event_id * 3 END AS BIGINT) AS input_tokens, CAST(NULL AS VARCHAR) AS error FROM events")
def event_log_round_trip(spark, d):
    """Two appends to a JSON-lines log, read back by its schema."""
    from loomcut.sources import files as S_
    from loomcut.workers import scratch

    e = _t(spark, d, "events")
    rows = e.select(F.when(F.col("event_id") % 2 == 0, "usage").otherwise("tool_call").alias("type"), F.col("event_id").alias("timestamp"), F.col("user_id").cast("string").alias("session"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 3).alias("input_tokens"))
    at = scratch(spark, "events")
    S_.append_events(rows.where("timestamp % 3 = 0"), at)
    S_.append_events(rows.where("timestamp % 3 <> 0"), at)
    return S_.read_events(spark, at).select("timestamp", "type", "session", "input_tokens", "error")


@query(f"""WITH {_SESSIONS} SELECT instance_id, variant AS agent_variant, coalesce(rank <= 5, false) AS hit_at_5_behavioral, CAST(time_hit AS BIGINT) AS time_to_first_hit_ms, calls AS tool_calls_count, CASE WHEN free THEN 0 ELSE 1 END AS n_oracle FROM m""")
def metrics_round_trip(spark, d):
    """Metrics' rows written as JSON lines and loaded by their schema."""
    from loomcut.sources import files as S_
    from loomcut.workers import scratch

    at = scratch(spark, "metrics")
    S_.write_metrics(_sessions(spark, d), at)
    return S_.load_metrics(spark, at).select("instance_id", "agent_variant", "hit_at_5_behavioral", "time_to_first_hit_ms", "tool_calls_count", F.size("oracle_files").alias("n_oracle"))


@query("SELECT vec_id AS ord, label, CAST(len(embedding) AS INTEGER) AS dims, 3 AS found FROM embeddings WHERE vec_id % 2 = 1")
def index_round_trip(spark, d):
    """An index saved, replaced, and loaded; others than that one aren't there."""
    from loomcut.sources import files as S_
    from loomcut.workers import scratch

    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "label", "embedding")
    at = scratch(spark, "index")
    for odd in (0, 1):
        S_.save_index(e.where(F.col("ord") % 2 == odd), at, "i", "p", 64, {"size": 1500})
    there = S_.index_exists(spark, at, "i", "p", 64) + 2 * (not S_.index_exists(spark, at, "i", "p", 32))
    return S_.load_index(spark, at, "i", "p", 64).select("ord", "label", F.size("embedding").alias("dims"), F.lit(int(there)).alias("found"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'lib/x' || s_suppkey ELSE chr(39) || 'lib/x' || s_suppkey || '"' END AS path FROM supplier""")
def strip_quotes(spark, d):
    k = F.col("s_suppkey")
    q = F.when(k % 4 == 0, "'").when(k % 4 == 1, '"').when(k % 4 == 2, "`").otherwise("'")
    return _t(spark, d, "supplier").select("s_suppkey", T.strip_quotes(F.concat(q, F.lit("lib/x"), k.cast("string"), F.when(k % 4 == 3, '"').otherwise(q))).alias("path"))
