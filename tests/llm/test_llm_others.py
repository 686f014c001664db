"""The operators over pages and embeddings, and what all of them share."""

import collections
import hashlib
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcut.llm import ann_scan, textbuf, warc_zip
from loomcut.llm.components import components, joined
from loomcut.llm import html_paths
from loomcut.llm.html_paths import extract, main_text
from loomcut.llm.sieve import anti

# 2

PARAS = ["First paragraph, with enough text; it says something about the matter at hand.", "Short one.", "A third paragraph, again of some length, so that ratios differ from the menu's."]


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body class='has-sidebar nav-open'>{body}</body></html>"


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 Example. All rights reserved, of course; and more text here.</footer>"
P = "".join(f"<p>{p}</p>" for p in PARAS)


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (page(MENU + f"<article><h1>Title</h1>{P}</article>" + FOOT), " ".join(["Title", *PARAS])),
        (page(MENU + f"<div class='ad'>Buy now, today, at once!</div><div class='content'><h1>Title</h1>{P}</div><div id='comments'><p>Nice post, thanks a lot for writing it, really!</p></div>" + FOOT), " ".join(["Title", *PARAS])),
        (page(f"<div role='banner'>Site name, and motto</div><main>{P}<aside>Related, of interest</aside><form>Name: <input> <button>Send</button></form></main>"), " ".join(PARAS)),
        (page(f"<article><p>a<br>b<b>c</b>d<p><i>e&nbsp;&#102;&lt;x&gt;\n\n g<script>var x='</p>';</script><!-- no <p>no</p> --></article>"), "a bcd e f<x> g"),
        (page("<article><h1>T</h1><p>unfinished<p>text &am"), "T unfinished text &am"),
        (page("<article><p>whole</p><p>cut</p></artic"), "whole cut"),
        (page("<article><p>1 < 2 and 3 > 2</p></article>"), "1 < 2 and 3 > 2"),
        (page(f"<article><p>half<span hidden>gone</span>way <button>Push</button>there</p>{P}</article>"), " ".join(["halfway there", *PARAS])),
        (page(f"<article class='post'>{P}<section class='comments'><article class='comment'><p>I disagree, strongly, with it all.</p></article></section></article>"), " ".join(PARAS)),
        (page(f"<article><header><h1>Title</h1></header>{P}<ul><li>point one</li><li>point two</li></ul></article>"), " ".join(["Title", *PARAS, "point one point two"])),
        (page(f"<div id='wrap' class='layout has-sidebar no-comments'><div class='entry'>{P}</div><div class='sidebar'>Other things, of no interest.</div></div>"), " ".join(PARAS)),
        (page("<div class='cookie-notice'>We use cookies, as you know, for many things.</div>" + MENU), ""),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


CARDS = "".join(f"<article class='card'><h3>Other story {i}</h3><p>A line about it.</p></article>" for i in range(3))
LONG = ["One long paragraph of the story, with clauses, commas, and stops. It goes on for a while, as such things do; then it ends.", "And another one, which follows the first, says more of the same, and is about as long. It ends here, more or less, too."]
Q = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<main><div class='story'><h1>Title</h1>{Q}</div><div class='more'>{CARDS}</div></main>", ["Title", *LONG]),
        (f"<div class='story'><h1>Title</h1>{Q}</div>{CARDS}", ["Title", *LONG]),
        (f"<div class='story'><h1>Title</h1>{Q}</div><article class='card'><h3>Other story</h3><p>A line about it.</p></article>", ["Title", *LONG]),
        (f"<div><div class='a'><h1>Title</h1>{Q * 6}</div><div class='b'><h2>Part</h2><p>{LONG[0]}</p></div></div><div class='foot'>Small print</div>", ["Title", *LONG * 6, "Part", LONG[0]]),
        (f"<article><h1>Title</h1><div class='x'>{Q}</div></article><div class='y'>Elsewhere</div>", ["Title", *LONG]),
    ],
)
def test_paths_choose_the_story(body, want):
    assert main_text(page(MENU + body + FOOT)) == " ".join(want)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p title=it's>Hello world</p><p>more text</p>", "Hello world more text"),
        ("<p title=it's>Hello world, it's fine</p><p>more text</p>", "Hello world, it's fine more text"),
        ("<p it's>Hello</p><p class=a\"b>more</p>", "Hello more"),
        ("<p title='a > b' id = \"c>d\">Hello</p><p a=b='c'>more</p>", "Hello more"),
        ("<p title=\"open>Hello</p><p>more text</p>", "Hello more text"),
        ("<p>one</ >two</3>three</p><p>four</p>", "onetwothree four"),
        ("<p>one</p><!--><p>two</p><p title='x", "one two"),
    ],
)
def test_quotes_do_not_cut_the_page(html, want):
    assert main_text(html) == want


SIDE = "<div class='sidebar'><p>Other things, of no interest.</p></div>"
NICE = "<div id='comments'><p>Nice post, thanks a lot for writing it, really!</p></div>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<div class='elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'><h1>Title</h1>{Q}</div></div>", ["Title", *LONG]),
        ("".join(f"<div class='elementor-widget-container'><p>{p}</p></div>" for p in LONG * 3), LONG * 3),
        (f"<div class='layout-sidebar-right'><div class='x'><h1>Title</h1>{Q}</div>{SIDE}</div>{NICE}", ["Title", *LONG]),
        (f"<article><div class='social-content'><h1>Title</h1>{Q}</div>{SIDE}</article>", ["Title", *LONG]),
        (f"<div class='comments-enabled'><div class='x'><h1>Title</h1>{Q}</div>{SIDE}</div>{NICE}", ["Title", *LONG]),
        (f"<div class='x'><h1>Title</h1>{Q}</div><div class='footer-top'>{Q}</div>{SIDE}", ["Title", *LONG]),
    ],
)
def test_names_only_hint(body, want):
    assert main_text(page(MENU + body + FOOT)) == " ".join(want)


def test_path_ratios_equal_a_plain_sum():
    """Lengths, punctuation and link shares by path, and their fused value, against loops over the blocks."""
    body = MENU + f"<div class='s'><h1>A, b.</h1>{Q}<p>See <a href='x'>this; that</a>.</p></div><div class='t'><p>Other, words.</p></div>" + FOOT
    found = html_paths.pieces(page(body)).found
    at, ratio, mark, link = html_paths.path_ratios(found)
    for i, x in enumerate(found):
        same = [y for y in found if y.path == x.path]
        chars = sum(len(y.text) for y in same)
        assert ratio[i] == chars / len(same) and mark[i] == sum(c in ".,;:!?" for y in same for c in y.text) / len(same)
        assert link[i] == pytest.approx(sum(y.linked for y in same) / chars)
    assert [len({y.path for y in found}), found[0].out, found[-1].out] == [5, True, True]
    kernel = [np.exp(-0.5 * d * d) for d in (-2, -1, 0, 1, 2)]
    near = lambda v, i: sum(k * v[min(max(i + d, 0), len(v) - 1)] for k, d in zip(kernel, (-2, -1, 0, 1, 2))) / sum(kernel)
    fused = [near(ratio, i) * (1 + near(mark, i)) * (1 - link[i]) for i in range(len(found))]
    value = [max(ratio[i] * (1 + mark[i]) * (1 - link[i]), np.mean([f for f, y in zip(fused, found) if y.path == x.path])) for i, x in enumerate(found)]
    got = html_paths.selected(found, np.zeros(len(found), bool))[0]
    assert got.tolist() == [v >= html_paths.THRESHOLD * np.std(value) for v in value]


def test_ratios_alone_find_the_story(monkeypatch):
    """No tag, role or name says what is what: the paths' ratios do, and others choose other text."""
    links = "<div class='m1'>" + "".join(f"<div class='m2'><a href='/{i}'>Entry {i}</a></div>" for i in range(9)) + "</div>"
    short = "<div class='q1'>" + "".join(f"<div class='q2'>Item {i}</div>" for i in range(9)) + "</div>"
    html = page(links + f"<div class='z'><h2>Title</h2>{Q * 3}</div>" + short)
    assert main_text(html) == " ".join(["Title", *LONG * 3])
    real = html_paths.path_ratios

    def turned(found):  # the paths' ratios in reverse order
        at, ratio, mark, link = real(found)
        by = lambda v: np.array([v[at == k][0] for k in range(at.max() + 1)])[::-1][at]
        return at, by(ratio), by(mark), by(link)

    monkeypatch.setattr(html_paths, "path_ratios", turned)
    assert LONG[0] not in main_text(html)


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert main_text("<div>" * n + "deep" + "<p>x" * n).startswith("deep x")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)


def test_extract_rows(spark):
    rows = [(1, "u", page(f"<article>{P}</article>"), "clash"), (1, "u", page(f"<article>{P}</article>"), "clash"), (2, None, None, None), (None, "x", "<p>" * 5000 + "deep" + "x" * 200_000, "t")]
    got = collections.Counter(tuple(r) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    long = "deep" + "x" * 200_000
    assert got == collections.Counter({(1, "u", " ".join(PARAS), len(" ".join(PARAS))): 2, (2, None, "", 0): 1, (None, "x", long, len(long)): 1})
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# 6


def test_warc_round_trip(spark):
    big, other = "é" * 600 + "x", "y" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", other), (9, "http://a/9", big), (7, "bad\r\nurl: x", "z" * 999), (8, "u", "z" * 999)]
    got = warc_zip.round_trip(spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3))
    best = {big: 9, other: 6}
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in best and i != best[h]
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h] if again else None)] += 1
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def open_bytes(b):
    return pa.BufferReader(b)


@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it"])
def test_zip_directory(comment):
    raw = io.BytesIO()
    members = {f"dir/é{i}.txt": f"content {i}".encode() * i for i in range(50)} | {"big": b"0123456789"}
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = comment
        for name, content in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=name == "big") as m:
                m.write(content)
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    f = open_bytes(raw.getvalue())
    d = warc_zip.directory(f)
    assert list(d) == [*members, "packed"]
    for n, content in members.items():
        assert warc_zip._read(f, warc_zip.member_start(f, d[n]), d[n].size) == content
    with pytest.raises(ValueError):
        warc_zip.member_start(f, d["packed"])


def test_zip64_directory(monkeypatch):
    """An archive whose directory is in ZIP64 form throughout."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", allowZip64=True) as z:
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"f{i}"), "w", force_zip64=True) as m:
                m.write(b"abc" * (i + 4))
    b = raw.getvalue()
    assert b"PK\x06\x06" in b
    k = b.rfind(b"PK\x05\x06")
    b = b[: k + 8] + struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + b[k + 20 :]
    f = open_bytes(b)
    d = warc_zip.directory(f)
    assert [warc_zip._read(f, warc_zip.member_start(f, m), m.size) for m in d.values()] == [b"abc" * (i + 4) for i in range(5)]
    with pytest.raises(ValueError):
        warc_zip.directory(open_bytes(b[:-30]))


# 8


def brute_nearest(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) and len(v) == 8]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted(((-(q * x).sum(), j) for m, (j, x) in enumerate(ok) if m != n))[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(best)]
    return out


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(90)]
    rows += [(100, [0.0] * 8), (101, None), (102, [1.0, None] * 4), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (105, [1.0, 2.0]), (None, [1.0] * 8), (40, rows[40][1]), (200, rows[0][1]), (201, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, list int, v string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann_scan.search(df).collect())
    assert got == sorted(brute_nearest(rows, 20, 20))
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert ann_scan.search(few).count() == 4
    assert ann_scan.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("cells", [1024, 8])  # 8: cells are cut by a second set of centroids
def test_nearest_recall_with_a_crowded_cell(spark, monkeypatch, cells):
    monkeypatch.setattr(ann_scan, "PART_ROWS", 500)
    monkeypatch.setattr(ann_scan, "QUERIES", 50)
    monkeypatch.setattr(ann_scan, "CELLS", cells)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 8))
    x[:1500] = x[0] + rng.standard_normal((1500, 8)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    for r in ann_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample_rows=2000).collect():
        got[r.query_id].add(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    true = np.argsort(-s, 1)[:, :20]
    assert np.mean([len(got[i * 20] & set(t.tolist())) / 20 for i, t in enumerate(true)]) > 0.9
    assert all(len(v) == 20 for v in got.values()) and len(got) == 200


def test_nearest_recall_of_many_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((50, 32))
    x = (centres[rng.integers(0, 50, 20_000)] + rng.standard_normal((20_000, 32)) * 0.7).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x))}))
    got = ann_scan.search(df, every=200).toPandas().groupby("query_id").vec_id.agg(set)
    s = x[::200].astype(float) @ x.T.astype(float)
    s[np.arange(100), np.arange(0, 20_000, 200)] = -np.inf
    true = np.argsort(-s, 1)[:, :20]
    assert np.mean([len(got[i * 200] & set(t.tolist())) / 20 for i, t in enumerate(true)]) > 0.95


def test_threshold_tightens(monkeypatch):
    """Fewer candidates are left to the last column block than with the first rows' threshold."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((5000, 64)), rng.standard_normal((10, 64))
    seen = []
    real = ann_scan._tightened
    monkeypatch.setattr(ann_scan, "_tightened", lambda best, qi, part: seen.append((best.max(1), qi.size)) or real(best, qi, part))
    ann_scan.scan(q, x, 10, np.full(10, -1))
    limits = np.array([b for b, _ in seen[1:]])
    assert len(limits) > 3 and (np.diff(limits, axis=0) <= 0).all() and (limits[-1] < limits[0]).all()
    assert seen[-1][1] < seen[1][1]


def test_scan_keeps_true_neighbours():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    qi, xi = ann_scan.scan(q, x, 10, np.full(20, -1))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    true = np.argsort(d, 1)[:, :10]
    found = set(zip(qi.tolist(), xi.tolist()))
    assert np.mean([(i, j) in found for i, t in enumerate(true.tolist()) for j in t]) > 0.98


def test_copies_of_a_query_all_stay(spark):
    """Of a list full of copies those with the smallest ids are found, wherever they stand."""
    lost = 0
    for seed in range(24):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((3000, 64)).astype(np.float32).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        x = x.astype(np.float32).astype(float)
        copies = np.sort(rng.permutation(3000)[:1500])
        x[copies] = x[copies[0]]
        space = ann_scan.Space(64, float((x * x).sum(1).max()), np.zeros((1, 65)), 1)
        qi, xi = ann_scan.scan(space.queries(x[copies[:20]]), space.rows(x), 20, copies[:20])
        lost += sum(len(np.setdiff1d(np.delete(copies, n), xi[qi == n])) for n in range(20))
    assert lost == 0
    order = rng.permutation(3000).tolist()
    rows = [(i, v.tolist()) for i, v in zip(order, x)]
    ids = sorted(order[c] for c in copies)
    got = collections.defaultdict(list)
    for r in ann_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i in ids:
        if i % 20 == 0:
            assert got[i] == [j for j in ids if j != i][:20]


# shared


def test_words_and_hashes():
    texts = ["", "a bb  a", None, "\x1cx y\x0b", "é日 A"]
    buf, offs = textbuf.buffers(pa.array(texts)[0:5])
    w = textbuf.words(buf, offs)
    got = [[buf[s:e].tobytes() for s, e, r in zip(w.start, w.end, w.row) if r == i] for i in range(5)]
    assert got == [(t or "").encode().split() for t in texts]
    h = textbuf.hashes(w)
    assert h[0] == h[2] and len(set(h.tolist())) == len({x for g in got for x in g})
    assert textbuf.hashes(w, lower=True).tolist()[0] == textbuf.hashes(w, lower=True).tolist()[-1]
    assert textbuf.hashes(w, most=1).tolist() == h.tolist()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(int(a), int(b)) for a, b in rng.integers(5000, 5300, (150, 2))] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    first, later = edges[::2], [e for e in edges[1::2] if e[0] != e[1]]
    both = joined(components(spark.createDataFrame(first, "u long, v long")), spark.createDataFrame(later, "u long, v long"))
    assert {r.node: r.component for r in both.collect()} == got


def test_anti(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 100 < 99, F.col("id")).alias("k"), F.lit("x").alias("_bucket_"))
    ids = spark.range(0, 5000, 3).select(F.col("id").alias("k"))
    got = collections.Counter(r.k for r in anti(rows, ids, [F.col("k")]).collect())
    assert got == collections.Counter([i if i % 100 < 99 else None for i in range(5000) if i % 100 == 99 or i % 3])


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    last = cp.run(spark, sf)
    assert last.count() > 50 and not last.where("n_tokens = 0 or n_tokens <> size(ids)").count()
    empty = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_stages_do_what_their_operators_say(spark, sf):
    """Each stage's rows against the verdicts of its operator, or the library, on what the one before kept."""
    import corpus_pipeline as cp
    import sentencepiece

    from loomcut.llm import dedup_minhash, mixing, quality_js, runtime, sentencepiece_sa, toxicity_nb

    odd = ["x", "_row", "_k", "_h", "_copy", "_take", "_takes", "row", "k0", "bucket", "at", "bits", "byte", "hit", "counts", "kept", "score", "sid", "size", "a b.c"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[(F.col("doc_id") * 3).alias(c) for c in odd])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    verdicts = [
        lambda d: quality_js.quality(d).where("kept"),
        lambda d: toxicity_nb.toxicity(d, labels).where("predicted = 0"),
        lambda d: dedup_minhash.near_duplicates(d, 5, 80, 4).where("kept"),
    ]
    for (name, stage), verdict in zip(cp.STAGES, verdicts):
        out = runtime.cut(stage(spark, docs, sf), "t")
        assert ids(out) == ids(verdict(docs)), name
        assert out.columns == docs.columns and out.subtract(docs).isEmpty(), name
        docs = out
    mixed = runtime.cut(cp.STAGES[3][1](spark, docs, sf), "t")
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken}
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert all(r[c] == r.doc_id * 3 for c in odd) and r.n_chars == len(r.text)
    assert dict(got) == taken
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
    texts = collections.Counter((r.doc_id, tuple(model.encode(r.text))) for r in mixed.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in cp.STAGES[4][1](spark, mixed, sf).collect()) == texts


@pytest.mark.parametrize("name", ["op2_html_paths", "op3_license_join", "op4_near_duplicates", "op6_warc_zip", "lm_base_scores", "quality_base_rules", "mix_targets"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    from loomcut.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(names).collect())) == collections.Counter(map(tuple, rel.fetchall()))


def test_release(spark):
    from loomcut.llm import runtime

    t = runtime.cut(spark.range(3), "t")
    at = t.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(at)
    runtime.release(spark)
    assert not os.path.exists(at)
