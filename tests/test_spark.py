"""The engine over tables: the catalogue against SQL, batches, streams, sources and sinks."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import loomcut as L
from loomcut.functions import text as T
from loomcut.operators import chunker, code, events, index, search
from loomcut.plans import catalogue, sourcecode
from loomcut.sources import files as S
from loomcut.streaming import usage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert got
        return
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text_functions(spark):
    f = lambda c, x: one(spark, c("x"), x=x)
    assert f(T.nws_count, "a\u00a0b\u2003c\t🎉") == 5 and f(T.utf16_length, "a🎉") == 3
    assert [f(T.detect_language, p) for p in ("a.tsx", "a.b/c", "x.PY", "a.", "q.java")] == ["typescript", None, None, None, "java"]
    assert f(T.normalize_path, "././/a//b/ ") == "a/b" and f(T.strip_quotes, "`x`") == "x" and f(T.strip_quotes, "'x\"") == "'x\""
    assert f(T.diff_files, "diff --git a/x b/./y\nz diff --git a/q b/q\ndiff --git a/x b//dev/null") == ["y"]
    assert f(T.clean_signature, " a \n\t b ") == "a b"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [6.0, 8.0])], "ord long, embedding array<double>").withColumn("filepath", F.concat(F.lit("p"), F.col("ord").cast("string")))
    assert [r[0] for r in v.orderBy("ord").select(search.unit(F.col("embedding"))).collect()] == [[0.6, 0.8], [0.0, 0.0], [0.6, 0.8]]
    got = search.search(v, [3.0, 4.0], 3).collect()
    assert [r.ord for r in got] == [1, 3, 2] and math.isnan(got[2].score) and got[0].score == pytest.approx(1)
    assert search.search(v, [3.0, 4.0], 3, pattern="p[23]").count() == 2


def test_latency_and_percentiles(spark):
    s = spark.createDataFrame([("u", 10), ("u", 5)], "id string, ts_ms long")
    e = spark.createDataFrame([("u", 25), ("v", 9)], "id string, ts_ms long")
    assert {r.id: r.latency_ms for r in events.tool_latency(s, e, ["id"]).collect()} == {"u": 20, "v": 0}
    n = spark.range(1, 5)
    assert n.select(events.nearest_rank("id", 50), events.nearest_rank("id", 90)).first()[:] == (2, 4)


FILES = [("a.py", "def f():\n    return 1\n"), ("b.rb", "puts 1"), ("c.ts", "export const x = 1\nfunction g() {}\n"), ("d.py", ""), ("e.py", None)]


def test_batch_equals_one_by_one(spark):
    df = spark.createDataFrame(FILES, "filepath string, code string").repartition(3)
    got = {r.filepath: r for r in L.chunk_batch(df).collect()}
    assert got["b.rb"].error.tag == "UnsupportedLanguageError" and got["b.rb"].chunks is None and got["d.py"].chunks == [] and got["e.py"].chunks == []
    for path, text in FILES[:1] + FILES[2:3]:
        assert [c.asDict(True) for c in got[path].chunks] == L.chunk(path, text)
    flat = L.chunk_files(df).collect()
    assert sorted({r.filepath for r in flat}) == ["a.py", "c.ts"]


def test_batch_options(spark):
    text = "\n".join(f"def f{i}():\n    return {i}" for i in range(9))
    rows = [("a.py", text, {"max_chunk_size": 20, "language": None}), ("b.txt", text, {"max_chunk_size": None, "language": "python"}), ("c.py", text, None)]
    df = spark.createDataFrame(rows, "filepath string, code string, options struct<max_chunk_size:int,language:string>")
    got = {r.filepath: len(r.chunks) for r in L.chunk_batch(df, L.Options(max_chunk_size=60)).collect()}
    assert got["a.py"] > got["b.txt"] == got["c.py"] > 1
    c = L.create_chunker(max_chunk_size=60)
    assert len(c.chunk("c.py", text)) == got["c.py"] and len(c.chunk("c.py", text, max_chunk_size=10**5)) == 1
    assert next(c.stream("c.py", text))["total_chunks"] == -1 and len(list(c.chunk_batch_stream(df))) == 3


def test_batch_query_has_a_file_of_each_language(spark, sf):
    got = catalogue.queries()["chunk_code_batch"](spark, sf).collect()
    assert sorted({r.filepath.rpartition(".")[2] for r in got}) == ["go", "java", "mjs", "py", "rb", "rs", "ts"]
    assert len({r.filepath for r in got}) == len(got)


@pytest.mark.parametrize("language", ["tsx", "jsx"])
def test_batch_of_files_with_markup(spark, sf, language):
    src = sourcecode.files(spark, sf, language).select("filepath", "code")
    got = L.chunk_batch(src, L.Options(max_chunk_size=10**6)).collect()
    assert len(got) == spark.read.parquet(f"{sf}/nation.parquet").count() and all(r.error is None and len(r.chunks) == 1 for r in got)


def test_own_chunk_function_may_fail(spark):
    def broken(path, text, options):
        raise RuntimeError("no")

    r = code.chunk_batch(spark.createDataFrame(FILES[:1], "filepath string, code string"), chunk_file=broken).first()
    assert (r.error.tag, r.error.message) == ("ChunkingError", "no")


def test_relational_context_agrees_with_the_chunker(spark):
    from loomcut.operators import scope

    text = "class A:\n    def a(self):\n        def x(): pass\n    def b(self): pass\n\ndef c(): pass\n"
    ents = [e for e in chunker.entities_of("f.py", text)[0]]
    df = spark.createDataFrame([("f.py", i, e.start, e.end) for i, e in enumerate(ents)], "file_id string, id int, start int, end int")
    parents = {r.id: r.parent for r in scope.scope_parents(df).collect()}
    roots = chunker.scope_tree(ents)
    want, stack = {}, list(roots)
    while stack:
        s = stack.pop()
        want[ents.index(s.entity)] = ents.index(s.parent.entity) if s.parent else None
        stack += s.children
    assert parents == want
    points = spark.createDataFrame([("f.py", p, p) for p in range(0, len(text), 7)], "file_id string, point int, at int")
    for r in scope.scope_at(points, df).collect():
        s = chunker.scope_at(roots, r.at)
        assert r.scope == (ents.index(s.entity) if s else None)


def test_scopes_of_a_deep_file_in_order(spark):
    from loomcut.operators import scope

    n = 100  # each in the one before, two of one range, and a leaf after
    rows = [("f", i, i, 1000 - i) for i in range(n)] + [("f", n, n - 1, 1001 - n), ("f", n + 1, 2000, 2001)]
    e = spark.createDataFrame(rows, "file_id string, id int, start int, end int")
    got = sorted((r.position, r.id, r.depth) for r in scope.flattened(e, scope.ancestors(scope.scope_parents(e))).collect())
    assert got == [(i + 1, i, i) for i in range(n + 1)] + [(n + 2, n + 1, 0)]


def test_ancestors_of_any_depth(spark):
    from loomcut.operators import scope

    parents = spark.createDataFrame([("f", i, i - 1 if i else None) for i in range(200)] + [("f", 900, 901), ("g", 0, None)], "file_id string, id int, parent int")
    got = {(r.file_id, r.id): (r.depth, r.chain) for r in scope.ancestors(parents).collect()}
    assert got == {("f", i): (i, list(range(i - 1, -1, -1))) for i in range(200)} | {("f", 900): (1, [901]), ("g", 0): (0, [])}
    with pytest.raises(ValueError):
        scope.ancestors(spark.createDataFrame([("f", i, (i + 1) % 7) for i in range(7)], "file_id string, id int, parent int"))


def test_parents_are_found_without_pairs(spark):
    from loomcut.operators import scope

    rows = [(f, i, (i * 37) % 50, (i * 37) % 50 + (i * i) % 23) for f in ("a", "b") for i in range(60)] + [("a", 99, None, 5), ("a", 98, 1, None), (None, 1, 0, 9), (None, 2, 1, 2)]
    df = spark.createDataFrame(rows, "file_id string, id int, start int, end int").repartition(3)
    got = scope.scope_parents(df)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    whole = [r for r in rows if None not in r]
    before = lambda x: [o for o in whole if o[0] == x[0] and (o[2], o[1]) < (x[2], x[1]) and x[3] <= o[3]]
    want = {(x[0], x[1]): max(before(x), key=lambda o: (o[2], o[1]))[1] if x in whole and before(x) else None for x in rows}
    assert {(r.file_id, r.id): r.parent for r in got.collect()} == want


def test_files_index_and_sinks(spark, tmp_path):
    src = tmp_path / "repo" / "pkg.x"
    src.mkdir(parents=True)
    (src / "a.py").write_text("def alpha():\n    return 1\n")
    (src / "b.ts").write_text("export function beta() { return 2 }\n")
    (src / "c.md").write_text("no")
    df = S.read_files(spark, str(tmp_path / "repo"))
    assert sorted(r.filepath for r in df.collect()) == ["pkg.x/a.py", "pkg.x/b.ts"]
    assert S.read_files(spark, str(tmp_path / "repo"), ["py"]).count() == 1
    embed = index.retrying(L.hashing_embedder(32))
    built = L.build_index(df, embed)
    S.save_index(built, str(tmp_path / "ix"), "i", "hash", 32, {"max": 1500})
    assert S.index_exists(spark, str(tmp_path / "ix"), "i", "hash", 32) and S.load_index(spark, str(tmp_path / "ix"), "i", "hash", 64) is None
    found = L.search_index(S.load_index(spark, str(tmp_path / "ix"), "i", "hash", 32), "function alpha", embed, 5)
    assert found.first().filepath == "pkg.x/a.py" and L.search_index(built, "alpha", embed, 5, r"\.ts$").count() == 1
    text = index.result_text(found)
    assert text.startswith("Found 2 relevant code locations:\n\n1. pkg.x/a.py (score: ") and text.endswith("__FILES__\npkg.x/a.py\npkg.x/b.ts\n__END_FILES__")
    (tmp_path / "m.jsonl").write_text('{"instance_id": "a", "agent_variant": "ops-only", "hit_at_1_behavioral": true}\n\n{"instance_id": "b", "agent_variant": "ops-only"}\n')
    assert [r.hit_at_1_behavioral for r in S.load_metrics(spark, str(tmp_path / "m.jsonl")).orderBy("instance_id").collect()] == [True, None]
    log = str(tmp_path / "log")
    for k in range(2):
        S.append_events(spark.createDataFrame([("tool_call", k)], "type string, timestamp long"), log)
    assert S.read_events(spark, log).count() == 2
    S.write_summary(spark.range(2), str(tmp_path / "s"))
    assert sum(1 for f in (tmp_path / "s").glob("*.json") for _ in map(json.loads, f.open())) == 2


def test_folders_of_any_name_and_indexes_replaced(spark, tmp_path):
    src = tmp_path / "a+b (c)[1] .x"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    assert [r.filepath for r in S.read_files(spark, str(src).replace("[1]", "?1?")).collect()] != [] and S.read_files(spark, str(tmp_path), ["py"]).first().filepath.endswith("/a.py")
    at = tmp_path / "a+b"
    at.mkdir()
    (at / "b.py").write_text("y = 1\n")
    assert [r.filepath for r in S.read_files(spark, str(at)).collect()] == ["b.py"]
    v = lambda k: spark.createDataFrame([(k,)], "ord long")
    first = None
    for k in (1, 2):
        S.save_index(v(k), str(tmp_path / "ix"), "i", "p", 8)
        got = S.load_index(spark, str(tmp_path / "ix"), "i", "p", 8)
        assert got.first().ord == k
        first = first or got
    assert first.first().ord == 1  # what is being read stays while it is replaced
    assert not S.index_exists(spark, str(tmp_path / "none"), "i", "p", 8)


def test_pages_of_a_dataset_are_fetched_once(spark, tmp_path):
    marker = tmp_path / "calls"

    def fetch(offset, length):
        with marker.open("a") as f:
            f.write("x")
        if offset == 20 and marker.read_text().count("x") < 5:
            raise OSError("try again")
        return [{"instance_id": str(i), "repo": "r"} for i in range(offset, offset + length)]

    for _ in range(2):
        got = S.read_paged(spark, fetch, 45, str(tmp_path / "cache"), page=20, wait=0.01)
        assert sorted(int(r.instance_id) for r in got.collect()) == list(range(45))
        calls = marker.read_text()
    assert marker.read_text() == calls and got.columns[0] == "instance_id"


def test_stream_of_events_to_a_log(spark, tmp_path):
    df = spark.createDataFrame([("usage", k) for k in range(5)], "type string, timestamp long")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        S.append_event_stream(stream, str(tmp_path / "log"), str(tmp_path / "c"), once=True).awaitTermination()
    assert S.read_events(spark, str(tmp_path / "log")).count() == 5


def test_metrics_rows_survive_a_file(spark, sf, tmp_path):
    from loomcut.operators import evaluation
    from loomcut.plans import relational

    m = relational._sessions(spark, sf)
    assert ", ".join(m.columns) == ", ".join(c.split()[0] for c in S.METRICS.split(", ")) and len(m.columns) == 32
    S.write_metrics(m, str(tmp_path / "m"))
    back = S.load_metrics(spark, str(tmp_path / "m"))
    summary = L.aggregate_metrics(back)
    assert sorted(map(str, summary.collect())) == sorted(map(str, L.aggregate_metrics(m).collect()))
    from loomcut.__main__ import main

    main(["report", str(tmp_path / "m"), "--skip", "ops-plus-search", "--out", str(tmp_path / "sum")])
    assert list((tmp_path / "sum").glob("*.json"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    main(["chunk", str(tmp_path / "src"), str(tmp_path / "chunks"), "--overlap-lines", "0"])
    assert spark.read.parquet(str(tmp_path / "chunks")).first().text == "x = 1"
    text = evaluation.summary_report(summary, "test", 3)
    assert "OPS-ONLY" in text and "Hit@1:" in text and text.count("MRR") == 2


def test_search_many_equals_search(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None), (62, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = search.search_many(df, df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 7)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    unit = lambda v: math.sqrt(sum(x * x for x in v))
    for q, v in rows[0:60:9]:
        near = sorted((-round(sum(a * b for a, b in zip(v, w)) / (unit(v) * unit(w)), 9), i) for i, w in rows[:60] if i != q and unit(v) and unit(w))
        assert found[q] == [i for _, i in near[:7]]


def test_search_holds_little_and_keeps_ties_in_order(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows, dim, k = rng.integers(-2, 3, (5000, 8)).astype(float), 8, 7  # many alike, some zero
    table = pa.table({"query_id": pa.array(range(4096)), "q": pa.array(list(rows[:4096]))})
    batches = [pa.RecordBatch.from_pydict({"vec_id": pa.array(range(i, min(i + 3000, 5000))), "e": pa.array(list(rows[i : i + 3000]))}) for i in (0, 3000)]
    run = search._best(spark.range(1), table, dim, k)
    tracemalloc.start()
    got = pa.Table.from_batches(list(run(iter(batches)))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    found = {}
    for q, v, x in sorted(zip(got["query_id"], got["vec_id"], got["score"]), key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1])):
        found.setdefault(q, []).append(v)
    norm = np.sqrt((rows * rows).sum(1))
    for q in range(0, 4096, 101):
        with np.errstate(invalid="ignore"):
            s = np.nan_to_num(np.round(rows @ rows[q] / (norm * norm[q]), 9), nan=-2)
        s[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(5000), -s))[:k].tolist()
    few = search._best(spark.range(1), table.slice(0, 3), dim, k)
    got = pa.Table.from_batches(list(few(iter([batches[0].slice(0, 4)])))).to_pydict()
    assert sorted(zip(got["query_id"], got["vec_id"])) == [(q, v) for q in range(3) for v in range(4) if q != v]


def test_search_steps_change_nothing(spark, sf, monkeypatch):
    whole = catalogue.queries()["mrr"](spark, sf).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "QUERY_STEP", 2)
    monkeypatch.setattr(search, "ROW_STEP", 7)
    assert catalogue.queries()["mrr"](spark, sf).collect() == whole


def test_runs_read_events_few_times(spark, sf):
    from loomcut.plans import relational

    plan = relational._sessions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 7
    assert plan.count("/+$") <= 8  # a path is normalized once as found, once in each ranking and in the oracle


def test_runs_of_odd_events(spark):
    from loomcut.operators import evaluation

    call = lambda s, n, *paths: (s, n, "tool_call", n % 1000 * 10, "Read", 5, list(paths), None, None, None)
    used = lambda s, n, m, i, o: (s, n, "usage", n * 10, None, None, None, m, i, o)
    rows = [call("a", 3, "./x//b.py", "q", "x/b.py"), call("a", 2, "q", None), used("a", 1, "m", 7, None), used("a", 4, "m", 70, 1), used("a", 5, "n", 2, 2), call("a", 1 << 61, "/last"), used("b", 1, "m", 1, 1), call("b", 2), call(None, 1, "z")]
    ev = spark.createDataFrame(rows, "session string, event_no long, type string, timestamp long, tool_name string, output_chars long, paths array<string>, message_id string, input_tokens long, output_tokens long").repartition(3)
    runs = spark.createDataFrame([(s, i, "v", 9, 1.0, ["d"]) for s, i in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "A"))], "session string, instance_id string, agent_variant string, total_duration_ms long, total_cost_usd double, top_files_final array<string>")
    oracle = spark.createDataFrame([("A", "./x/b.py"), ("A", "none"), ("B", "z")], "instance_id string, file string")
    got = evaluation.runs_of_events(ev, runs, oracle)
    cols = ["instance_id", "ranked_files_from_tools", "time_to_first_hit_ms", "tokens_to_first_hit", "total_input_tokens", "total_output_tokens", "tool_calls_count", "tool_output_chars_by_type"]
    empty = (None, None, None, 0, 0, 0, None)
    want = [("A", ["q", None, "x/b.py", "last"], 30, 7, 9, 2, 3, {"Read": 15}), ("A", *empty), ("B", None, None, None, 1, 1, 1, {"Read": 5}), ("C", *empty)]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_retry():
    calls = []

    def flaky(texts, task):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return [[1.0]]

    assert index.retrying(flaky, wait=0)(["x"], "query") == [[1.0]] and len(calls) == 3
    with pytest.raises(RuntimeError):
        index.retrying(lambda t, k: (_ for _ in ()).throw(RuntimeError("bad key")), wait=0)(["x"], "query")


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.py").write_text("def alpha():\n    return 1\n")
    (src / "b.rb").write_text("x")
    q = L.chunk_files_stream(S.read_files(spark, str(src), [".py", ".rb"], streaming=True)).writeStream.format("memory").queryName("chunks").outputMode("append").start()
    q.processAllAvailable()
    (src / "c.go").write_text("package x\n")
    (src / "d.py").write_text("x = 1\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.filepath for r in spark.table("chunks").collect()) == ["a.py", "d.py"]


def test_stream_of_usage(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "s", "m1", 5, 1), ("2024-01-01 00:00:02", "s", "m1", 7, 1), ("2024-01-01 00:01:00", "s", "m2", 2, 3), ("2024-01-01 09:00:00", "s", "m3", 1, 1)]
    df = spark.createDataFrame(rows, "ts string, session string, message_id string, input_tokens long, output_tokens long").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = usage.usage_by_window(stream).writeStream.format("memory").queryName("used").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("used").collect()
    assert [(r.session, r.output_tokens, r.messages) for r in got] == [("s", 4, 2)]
    with pytest.raises(ValueError):
        L.chunk_files_stream(spark.createDataFrame(FILES, "filepath string, code string"))


def test_files_to_parse_are_spread_over_tasks(spark, sf):
    for src in (sourcecode.files(spark, sf, "go"), sourcecode._function_files(spark, sf)):
        per_task = [r["count"] for r in src.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) >= spark.sparkContext.defaultParallelism and max(per_task) <= sum(per_task) / 3


def test_a_worker_passes_on_what_it_has(spark, monkeypatch):
    monkeypatch.setattr(code, "STEP", 100)
    monkeypatch.setattr(code, "ROWS", 2)
    df = spark.createDataFrame([(f"a{i}.py", "def f():\n    return 1\n" * (1 + i % 9)) for i in range(100)] + FILES[:3], "filepath string, code string").coalesce(1)
    assert sorted(r.filepath for r in L.chunk_batch(df).collect()) == sorted(r.filepath for r in df.collect())
    assert L.extract_entities(df).where("filepath like 'a%'").count() == sum(1 + i % 9 for i in range(100)) + 1


def test_batch_of_one_chunk_for_any_file(spark, tmp_path):
    spark.createDataFrame([(7, 1)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1,)], "r_regionkey int").write.parquet(str(tmp_path / "region.parquet"))
    spark.range(14000).selectExpr("id as s_suppkey", "7 as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = sourcecode.QUERIES["chunk_code_batch"](spark, str(tmp_path)).collect()
    assert len(got) == 7 and {r.n_chunks for r in got} == {1, None}
