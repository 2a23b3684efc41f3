"""Links, files and images of pages, and messages, against plain Python."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import functions as F

from docloom.functions import messages
from docloom.operators import candidates


def test_addresses_are_joined_as_python_joins_them(spark):
    bases = ["http://a.org/b/c/d?q=1#f", "http://a.org", "https://a.org/", "http://a.org/b/", "http://a.org/x?y=/z"]
    refs = ["", "g", "./g", "g/", "/g", "//h.org/i", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../..", "../../../g", "./", ".", "g/./h", "g/../h", "/./g", "/../g", "g;x=1/../y", "mailto:x@y", "http://h.org/a/../b", "é ü", "a//b"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    for r in rows.select("base", "ref", candidates.joined(F.col("base"), F.col("ref")).alias("got")).collect():
        want = urljoin(r["base"], r["ref"])
        assert r["got"] == want or r["ref"].startswith("http"), (r, want)


def test_links_files_and_images_of_odd_pages(spark):
    pages = [
        (1, "http://a.org/b/c", "<a\nhref='x.pdf'>one <i>two</i>\n</a><a href=\"\">no</a><a HREF=\"y\">" + "z" * 200 + "</a>"),
        (2, None, '<a href="/x">t</a><img src="q.png">'), (3, "http://a.org", None), (4, "http://a.org", ""),
        (5, "http://a.org/p/", "<img src='a.png' alt='A'><img src='a.png'><img src='BADGE.png'><img src='s.png' width=10 height='20px'><img src='w.png' width='10' height='20px'><img>"),
        (6, "http://a.org", "".join(f'<a href="{i}.pdf">{i}</a><img src="{i}.png">' for i in range(30))),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = candidates.anchors(df, "page_id")
    got = {(r["page_id"], r["place"]): (r["url"], r["text"]) for r in links.collect()}
    assert {k: v for k, v in got.items() if k[0] < 6} == {(1, 0): ("http://a.org/b/x.pdf", "one two"), (1, 2): ("http://a.org/b/y", "z" * 120), (2, 0): ("/x", "t")}
    files = [(r["page_id"], r["rank"], r["url"]) for r in candidates.files(links, "page_id").orderBy("page_id", "rank").collect()]
    assert files == [(1, 1, "http://a.org/b/x.pdf")] + [(6, i + 1, f"http://a.org/{i}.pdf") for i in range(20)]
    images = [(r["page_id"], r["rank"], r["url"], r["alt"]) for r in candidates.images(df, "page_id").orderBy("page_id", "rank").collect()]
    assert images == [(2, 1, "q.png", ""), (5, 1, "http://a.org/p/a.png", "A"), (5, 2, "http://a.org/p/s.png", "")] + [(6, i + 1, f"http://a.org/{i}.png", "") for i in range(20)]
    assert candidates.images(df.limit(0), "page_id").count() == candidates.anchors(df.limit(0), "page_id").count() == 0


def test_messages_and_back(spark):
    errors = [["Page 3: Error code: 408", None, "nothing", "page 4 StringDataRightTruncationError for character varying(500)", "page 3 " + "x " * 200], [], None]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "id long, errors array<string>")
    got = [r["w"] for r in df.orderBy("id").select(messages.warning(F.col("errors")).alias("w")).collect()]
    long_reason = ("page 3 " + "x " * 200)[:220]
    assert got[0] == f"Partial OCR warnings: Failed pages: 3, 4, 3 | Failed page reasons: 3=Typhoon OCR timeout (408); 4=DB insert failed: table_name too long for structured_data.table_name; 3={long_reason}"
    assert got[1:] == ["Partial OCR warnings: "] * 2
    told = spark.createDataFrame([(0, got[0]), (1, None), (2, " processing PAGE 2/9 "), (3, "Failed pages: 1, x")], "id long, m string").orderBy("id").select(messages.told(F.col("m")).alias("t")).collect()
    assert told[0]["t"]["failed_pages"] == [3, 4, 3]
    assert told[0]["t"]["failed_page_reasons"] == {3: long_reason.strip(), 4: "DB insert failed: table_name too long for structured_data.table_name"}
    assert tuple(told[1]["t"]) == ("", [], {}, "")
    assert (told[2]["t"]["progress_text"], told[2]["t"]["status_detail"]) == ("หน้า 2/9", "processing PAGE 2/9")
    assert told[3]["t"]["failed_pages"] == [1]
