"""HTML extraction and WARC archives."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import html_extract, warc
from gapspark.llm.common import open_fs, stored
from gapspark.session import fresh_path

CASES = [
    ("", ""), ("plain words only", "plain words only"),
    ("<article><p>a &amp; b&nbsp;&#233;<p>c <b>d<br>e</b></article><footer>no</footer>", "a & b é\n\nc d e"),
    ("<body><nav><a>x</a></nav><article><p>one</p><div class='ad'>buy</div><ol class='comment-list'><li>first!</ol></article>", "one"),
    ("<article><script>var a='<p>no</p>'</script><p>yes</p><!-- <p>no</p> --></article>", "yes"),
    ("<article><header><h1>Head</h1></header><p>text</p><form>mail <input></form><aside>more</aside></article>", "Head\n\ntext"),
    ("<article><p>broken <b>bold<p>next</article><div class=sidebar>side</div>", "broken bold\n\nnext"),
    ("<html><body><div id='cookie-notice'>we use</div><main><p>body text</p></main></body></html>", "body text"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


WRAPPERS = [
    "<div class='layout has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='page-with-header'>{}</div>",
    "<div id='search-results'>{}</div>", "<div class='review'>{}</div>", "<div class='reviews'>{}</div>", "<form id='page'>{}</form>",
]


@pytest.mark.parametrize("wrapper", [*WRAPPERS, "<div class='side'>{}</div>", "<div class='header'>{}</div>"])
def test_wrappers_keep_the_article(wrapper):
    text = " ".join(f"w{i}" for i in range(30))
    for tag in ("article", "main"):
        page = f"<{tag}><p>{text}</p><p>more</p><div class='cookie-notice'>we use</div></{tag}><div class='site-footer'>rights</div>"
        assert html_extract.main_text(f"<body>{wrapper.format(page)}</body>") == f"{text}\n\nmore"


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_plain_paragraphs(wrapper):
    text = " ".join(f"w{i}" for i in range(40))
    assert html_extract.main_text(f"<body>{wrapper.format(f'<p>{text}</p><p>{text}</p>')}</body>") == f"{text}\n\n{text}"


def test_items_in_furniture_are_no_articles():
    text = " ".join(f"w{i}" for i in range(30))
    for name in ("comments", "related", "sidebar"):
        page = f"<body><article><p>{text}</p></article><div class='{name}'><article><p>{text[:60]}</p></article></div></body>"
        assert html_extract.main_text(page) == text


def test_blocks_of_pages_the_tree_has_not_seen():
    x, y = html_extract.labelled_table(html_extract.labelled_pages(seed=2, count=300))
    right = np.array([html_extract.judge(html_extract.tree(), r) >= 0.5 for r in x.tolist()]) == y
    assert len(y) > 2000 and right.mean() > 0.96


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize("page, kept", [
    (f"<nav><a>home</a></nav><article><p>{words(12)}</p></article>", [words(12)]),
    (f"<article><h1>Head line</h1><p>{words(40)}</p></article>", ["Head line", words(40)]),
    (f"<article><p>{words(10)}</p><p>{words(40, 20)}</p></article>", [words(10), words(40, 20)]),
    (f"<p>{words(10)}</p><p>{words(40, 20)}</p>", [words(10), words(40, 20)]),
    (f"<h1>Head line</h1><p>{words(60)}</p>", ["Head line", words(60)]),
    (f"<article><p>{words(14)}</p><p>Done.</p></article>", [words(14), "Done."]),
    (f"<body><div class='search'><p>{words(60)}</p></div></body>", [words(60)]),
    (f"<body><div class='search'><p>{words(60)}</p></div><article><p>{words(9)}</p></article></body>", [words(9)]),
])
def test_ordinary_pages_without_a_footer(page, kept):
    assert html_extract.main_text(page) == "\n\n".join(kept)


@pytest.mark.parametrize("part, n", [
    ('<a href="x ', 200_000), ("<b>", 200_000), ("</i>", 200_000), ("<i><b></i>", 100_000), ("<i><div><b></i>", 100_000), ("<!x", 200_000),
    ("<p>some words", 60_000), ("<script>", 100_000), ("<a href='x >", 100_000), ("<", 300_000), ("x" * 100, 30_000),
])
def test_long_broken_pages_take_time_in_proportion(part, n):
    began = time.perf_counter()
    html_extract.main_text("<article><p>start</p>" + part * n)
    html_extract.main_text("<a" + part.replace(">", "") * n)
    assert time.perf_counter() - began < 15


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>é 🎉</p>" * 2, 2)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "é 🎉\n\né 🎉", 8), (1, "", 0), (1, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def pages(spark):
    inner = warc.record("response", [("X-Page-ID", "99")], b"inside").decode()
    same = "s" * 150
    rows = [(i, f"http://x/{i} a\r\nb", inner * 3 + "é" * (i * 50)) for i in range(1, 30)]
    rows += [(40, "u", same), (41, "u", same), (42, None, same), (43, "u", "small"), (44, "u", "small"), (45, "u", None), (46, "u", ""), (41, "v", same), (None, "n", same)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("range_bytes", [100, 1000, 8_000_000])
def test_archives_give_all_pages_back(spark, range_bytes):
    df = pages(spark)
    where = fresh_path(spark, "warc")
    manifest = warc.write_archives(df, where)
    got = warc.read_archives(manifest, where, range_bytes, with_payload=True).collect()
    assert len(got) == df.count()  # no record that only stands inside a payload
    bodies = {}
    for r in df.collect():
        bodies.setdefault(r.page_id, (r.html or "").encode())
    for r in got:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.payload == (body if r.record_type == "response" else b"")
        assert (r.record_type, r.refers_to) == (("revisit", 40) if r.page_id in (41, 42) else ("response", None))


def test_a_broken_chain_is_reported(spark):
    where = fresh_path(spark, "warc")
    system, path = open_fs(where)
    system.create_dir(path, recursive=True)
    good = warc.record("response", [("X-Page-ID", "1")], b"abc")
    with system.open_output_stream(f"{path}/f") as out:
        out.write(good + b"garbage" + good)
    manifest = stored(spark.createDataFrame([("f", 2 * len(good) + 7, 2)], "file string, size long, records long"), "m")
    with pytest.raises(Exception, match="no record at"):
        warc.read_archives(manifest, where).collect()


def test_no_pages(spark):
    where = fresh_path(spark, "warc")
    manifest = warc.write_archives(pages(spark).limit(0), where)
    assert warc.read_archives(manifest, where).count() == 0


@pytest.mark.parametrize("range_bytes", [1000, 8_000_000])
def test_long_urls_and_clashing_columns(spark, range_bytes):
    rows = [(1, "http://x/" + "a" * 100_000, "h" * 200, 1, "k"), (2, " " * 60_000 + "é", "h" * 200, 2, "k"), (3, "http://x/" + "b" * 32_000, None, 3, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size long, digest string").withColumn("key", F.lit(9)).withColumn("__k", F.lit(1))
    where = fresh_path(spark, "warc")
    manifest = warc.write_archives(df, where)
    got = {r.page_id: r for r in warc.read_archives(manifest, where, range_bytes).collect()}
    assert [(i, got[i].record_type, got[i].payload_bytes, got[i].refers_to) for i in (1, 2, 3)] == [(1, "response", 200, None), (2, "revisit", 200, 1), (3, "response", 0, None)]
    assert (got[1].url, got[2].url, got[3].url) == (None, None, rows[2][1])
    assert manifest.agg(F.sum("records")).first()[0] == 3
