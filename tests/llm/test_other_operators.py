"""Pages, archives, vectors and the pipeline."""

import base64
import gzip
import hashlib
import os
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import hilbert, html, warc

PAGES = [
    (1, "http://a", "<html><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   text here<br>goes on.<p>Second &#233;t&eacute;.</article><footer>Foot &copy;</footer></body></html>"),
    (2, None, None), (3, "http://c", ""), (4, "http://d\r\nX: y", "no tags at all, but a sentence"), (5, "http://e", "<div class='ad'>buy</div><p"), (6, "u", "<p>same</p>"), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>"), (None, "u", "<p>same</p>"),
    (8, "http://big", "<article>" + "".join(f"<p>Paragraph number {k} of a long page, with words.</p>" for k in range(3000)) + "</article>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).checkpoint()


def test_html_marginals_on_held_out_pages():
    model, right, total = html.trained(), 0, 0
    for text in html.labelled_pages(80, seed=99):
        page = html.parse(text)
        labels = []
        for node in page.nodes:
            labels.append(node.label if node.label is not None else labels[node.parent] if node.parent >= 0 else False)
        chance = html.marginals(page.nodes, model)
        assert all(0 <= x <= 1 for x in chance)
        right += sum(len(raw) for k, raw in page.runs if (chance[k] >= 0.5) == labels[k])
        total += sum(len(raw) for _, raw in page.runs)
    assert right / total > 0.97


def test_html_marginals_equal_enumeration():
    model = html.trained()
    nodes = html.parse("<div class='menu'><p>a</p></div><article><p>some words</p><p>more</p></article>").nodes
    n, edge = len(nodes), np.array(model.edge)
    weight = np.zeros(n)
    total = 0.0
    seen = [model.evidence(html.features(x)) for x in nodes]
    for states in np.ndindex(*(3,) * n):
        if states[0] != html.FRAME:
            continue
        p = np.prod([seen[k][states[k]] for k in range(1, n)]) * np.prod([edge[states[nodes[k].parent], states[k]] for k in range(1, n)])
        total += p
        weight += p * (np.array(states) == html.CONTENT)
    assert np.allclose(html.marginals(nodes, model), weight / total)


def test_html_text_of_pages(pages, spark):
    rows = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert rows[1] == "A & B First text here goes on. Second été."
    assert rows[2] == rows[3] == "" and "buy" not in rows[5]
    assert rows[8].count("Paragraph") == 3000
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_leaves_out_comments_forms_and_notices():
    text = html.extract("<header><div class='logo'>Site</div></header><div class='cookie'><p>We use cookies.</p></div><article><h1>Title</h1><p>Body text of the article.</p><div class='ad'>Buy now</div><form><p>Your name</p></form><script>var x='<p>';</script><section class='comments'><h3>Comments</h3><div class='comment'><p>First!</p></div></section></article><aside class='sidebar'><h3>More</h3></aside>", html.trained())
    assert text == "Title Body text of the article."


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p title=it's>Some words of a long enough article here.</p><p>That's it, the end of all.</p></article>", "Some words of a long enough article here. That's it, the end of all."),
        ("<article><p title=\"a > b\">Quoted bracket in a value of an attribute.</p><p>It's fine.</p></article>", "Quoted bracket in a value of an attribute. It's fine."),
        ("<article><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is a formula in the text.</p></article>", "The sum x+1 is a formula in the text."),
        ("<article><p>Never closed paragraph of words<p>Another one with <b>bold text</article>", "Never closed paragraph of words Another one with bold text"),
        ("<article><p data-class='ad' title='x'>An attribute that only ends in class.</p></article>", "An attribute that only ends in class."),
        ("Nothing but plain words, no mark-up at all, " * 5, ("Nothing but plain words, no mark-up at all, " * 5).strip()),
        ("<body><h1>Title here</h1>Some <b>bold</b>text that goes on<br>and on for a while.<footer>Copy</footer></body>", "Title here Some boldtext that goes on and on for a while."),
    ],
)
def test_html_of_odd_mark_up(page, want):
    assert html.extract(page, html.trained()) == want


RISE = "The river rose by two metres in the night and the lower road was closed until noon."
SAND = "Volunteers carried sand to the old mill, where the water had reached the first step."
FALL = "By evening the gauge had fallen again."
LAYOUTS = [
    ("<p>A short line.</p>", ["A short line."], []),
    ("<div>Hello there, this is all.</div>", ["Hello there, this is all."], []),
    (f"<html><body><h1>Flood</h1><p>{FALL}</p></body></html>", ["Flood", FALL], []),
    (f"<body><div id=hd><a href=/>Gazette</a><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></div><div class=storytext><h1>Flood at the mill</h1><p>{RISE}<p>{SAND}<p>{FALL}</div><div id=ft><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>", ["Flood at the mill", RISE, SAND, FALL], ["Gazette","News","Sport","Imprint","Privacy"]),
    (f"<table><tr><td><a href=/1>Home</a><br><a href=/2>Archive</a><br><a href=/3>Contact</a></td><td><h2>Flood</h2><p>{RISE}</p><p>{SAND}</p></td></tr></table>", ["Flood", RISE, SAND], ["Home","Archive","Contact"]),
    (f"<div class=page><nav><a href=/>Start</a><a href=/b>Blog</a></nav><section class='post-body'><p>{RISE}</p><blockquote>{FALL}</blockquote><pre>x = 1</pre><p>{SAND}</p></section><section id=reader-comments><p>Great piece, thank you all!</p></section></div>", [RISE, FALL, "x = 1", SAND], ["Start","Blog","Great piece"]),
    (f"<main><h1>Notes</h1><ul><li>{RISE}</li><li>{SAND}</li></ul><aside><h3>See also</h3><ul><li><a href=/q>Droughts</a></li></ul></aside></main><footer>All rights reserved</footer>", ["Notes", RISE, SAND], ["See also","Droughts","All rights reserved"]),
    (f"<div class='gdpr-banner'><p>We use cookies to improve your visit.</p></div><article><header><h1>Flood</h1><p>By a reporter</p></header><p>{RISE}</p><div class='ad-slot'>Buy boots now.</div><p>{SAND}</p></article>", ["Flood","By a reporter", RISE, SAND], ["cookies","Buy boots"]),
    (f"<video controls><p>Your browser cannot play this.</p></video><p>{RISE}</p>", [RISE], ["cannot play"]),
    (f"Plain text page.\n\n{RISE}", ["Plain text page.", RISE], []),
]


@pytest.mark.parametrize(("page", "content", "noise"), LAYOUTS)
def test_html_of_layouts_written_by_hand(page, content, noise):
    text = html.extract(page, html.trained())
    assert all(x in text for x in content)
    assert not any(x in text for x in noise)


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "<p>" * 50_000, "<div>x</b>" * 50_000, "<a " * 100_000, '<a =">" ' * 100_000, "<ul><li>" * 50_000, "<td>x" * 50_000, "<script " * 50_000])
def test_html_of_hostile_pages_takes_linear_time(page):
    start = time.process_time()
    html.extract(page, html.trained())
    assert time.process_time() - start < 20  # quadratic work would take hours


def test_html_behind_a_tag_that_nothing_closes():
    assert html.extract('<article><p>if a <b and c</p><p>some more text</p> <a =">" ', html.trained()).endswith("some more text <a =\">\"")


def test_html_keeps_columns_but_not_the_result_s_names(spark):
    pages = spark.createDataFrame([(1, "<p>hello there</p>", "a", "u"), (1, "<p>hello there</p>", "a", "u")], "page_id long, html string, text string, url string")
    found = html.main_text(pages, keep=("url", "text", "page_id"))
    assert found.columns == ["page_id", "url", "text"] and found.count() == 2


def test_warc_round_trip_and_dedupe(pages, spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path)
    rows = warc.read_archives(spark, path, keep=True).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        texts = {h or "" for i, _, h in PAGES if i == r.page}
        payload = texts.pop().encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == payload
    kinds = sorted((str(r.page), r.record_type, r.refers_to) for r in rows if r.page in (2, 3, 6, 7, None))
    assert kinds == sorted([("2", "revisit", 3), ("3", "response", None), ("6", "revisit", 7), ("7", "response", None), ("7", "response", None), ("None", "revisit", 7)])
    names = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    raw = b"".join(subprocess.run(["gzip", "-dc", os.path.join(path, n)], capture_output=True, check=True).stdout for n in names if os.path.getsize(os.path.join(path, n)))
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES)
    # Framed by a second, plain parser: header lines, Content-Length, block, two line ends.
    blocks = []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
        blocks.append(raw[:length].partition(b"\r\n\r\n")[2])
        assert raw[length : length + 4] == b"\r\n\r\n"
        raw = raw[length + 4 :]
    assert len(blocks) == len(PAGES)
    records = warc.read_archives(spark, path)
    assert warc.unresolved(records).count() == 0
    assert warc.unresolved(records.where("record_type = 'revisit'")).count() == 3


def test_warc_reader_verifies():
    good = warc.record(1, "u", b"hello", warc.digest32(hashlib.sha1(b"hello").digest()), None, "2024-01-01T00:00:00Z")
    bad = warc.record(1, "u", b"hello", warc.digest32(hashlib.sha1(b"other").digest()), None, "2024-01-01T00:00:00Z")
    assert [r["page"] for r in warc.records(memoryview(good + warc.EMPTY + good + warc.EMPTY))] == [1, 1]
    noise = os.urandom(17 << 20)
    large = warc.record(2, "u", noise, warc.digest32(hashlib.sha1(noise).digest()), None, "2024-01-01T00:00:00Z")
    file = b"".join(warc.line(x) + b"\x00" for x in (good, large, good))
    assert large[-1] != 0 and gzip.decompress(file).count(b"WARC/1.1\r\n") >= 3
    assert [(r["page"], r["payload_bytes"]) for r in warc.records(memoryview(file))] == [(1, 5), (2, len(noise)), (1, 5)]
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(memoryview(bad)))
    with pytest.raises(ValueError):
        list(warc.records(memoryview(good[: len(good) // 2])))


def test_warc_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("dimension,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_on_the_curve_touch(dimension, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimension, indexing="ij"), -1).reshape(-1, dimension)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    points = centres[rng.integers(20, size=3000)] + 0.3 * rng.normal(size=(3000, 16))
    points *= rng.uniform(0.5, 2, size=(3000, 1))  # lengths differ: the inner product isn't the angle
    points[100:140] = points[100]  # equal vectors tie
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [1.0, 2.0]), (None, rows[5][1]), rows[40]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in hilbert.nearest(frame, F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([r[1] for r in rows[:3000]])
    hits = 0
    for q in range(0, 3000, 20):
        got = sorted(found[q])
        assert [k for k, _, _ in got] == list(range(1, 21)) and len({v for _, v, _ in got}) == 20 and q not in {v for _, v, _ in got}
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:], strict=False))
        products = x @ x[q]
        assert np.allclose([s for _, _, s in got], products[[v for _, v, _ in got]])
        products[q] = -np.inf
        hits += len({v for _, v, _ in got} & set(np.lexsort((np.arange(3000), -products))[:20]))
    assert hits / (20 * 150) >= 0.9 and not set(found) - set(range(0, 3000, 20))


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in sorted(hilbert.nearest(frame, F.col("id") == 0).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert hilbert.nearest(frame.where("vec_id > 5"), F.col("id") == 0).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline


    common, rare = "the of and to in a is that".split(), [f"{a}{b}{c}" for a in ("mor", "ten", "lis") for b in ("an", "el", "or") for c in ("ing", "ed", "s")]
    text = lambda seed: " ".join(x for s in range(12) for x in [np.random.default_rng(1000 * seed + s).choice(common + rare, 12)] for x in [*x[:-1], x[-1] + "."])
    docs = [(i, text(i), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s", 0) for i in range(5)] + [(200 + i, docs[i][1] + " added words", "en", "s", 0) for i in range(5)]
    docs += [(300 + i, text(50 + i) + " idiot moron scum", "en", "s", 0) for i in range(40)] + [(400, "short", "en", "s", 0), (401, None, "en", "s", 0), (402, "same same same same same same " * 20, "en", "s", 0)]
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids & set(range(60))) >= 57 and not ids & {400, 401, 402} and not ids & set(range(100, 105)) and not ids & set(range(200, 205))
    assert not ids & set(range(300, 340))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]


def test_repeated_rows_cost_no_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(rng.normal(size=(400, 8)))]
    order = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hilbert.nearest(df, F.col("id") % 20 == 0).collect())
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    once = order(frame(rows))
    assert len(once) == 20 * 20 and order(frame(rows * 5)) == once
    monkeypatch.setattr(hilbert, "PER_TASK", 3)  # a block's queries in many tasks
    assert order(frame(rows)) == once
    # Of different vectors of one id the least stays.
    assert order(frame([*rows, (7, [99.0] * 8), (20, [99.0] * 8)])) == once
