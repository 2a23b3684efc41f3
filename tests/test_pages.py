"""Tables, titles and links in small texts, and the file sources' round trips."""

import json

from docloom.operators import pages
from docloom.sources import files


def test_pipe_tables_with_titles_gaps_and_nulls(spark):
    texts = [(1, "| a | b |\n|---|---|\n| 1 |  |\n| -5 | x |\ntext\n| only |"), (2, None), (3, ""), (4, "| T |\n| h | i |\n| 1 | 2 |"), (5, "| h | i |\n|---|---|")]
    got = {(r["k"], r["at"]): (r["title"], r["headers"], r["rows"]) for r in pages.pipe_tables(spark.createDataFrame(texts, "k int, text string"), "k").collect()}
    assert got == {(1, 0): (None, ["a", "b"], [["1", ""], ["-5", "x"]]), (4, 1): ("T", ["h", "i"], [["1", "2"]])}


def test_html_tables_skip_blank_rows_and_need_a_body(spark):
    html = [(1, "<table><caption> C </caption><tr><td> </td></tr><tr><th>a</th></tr><tr><td><i>1</i>\n2</td></tr></table><table><tr><td>z</td></tr></table>"), (2, None), (3, "no")]
    got = pages.html_tables(spark.createDataFrame(html, "k int, html string"), "k").collect()
    assert [tuple(r) for r in got] == [(1, 0, "C", ["a"], [["1 2"]])]


def test_titles_and_links(spark):
    html = [(1, "http://h.org/x", '<title> </title><h1>H</h1><a href="/a#f"><a href="/a"><a href="//cdn/x"><a href="https://o.org/b"><a href="mailto:x">'), (2, None, None), (3, "bad", '<meta property="og:title" content="O"><a href="/a">')]
    df = spark.createDataFrame(html, "k int, url string, html string")
    assert [r[0] for r in df.orderBy("k").select(pages.page_title(df["html"])).collect()] == ["H", None, "O"]
    assert sorted(tuple(r) for r in pages.links(df, "k").collect()) == [(1, "http://h.org/a", 0), (1, "https://o.org/b", 3)]


def test_files_come_back_as_written(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "q", "ground_truth": "1"}, {"question": "r", "note": "n"}]))
    assert sorted(tuple(r) for r in files.questions(spark, str(tmp_path / "q.json")).collect()) == [("q", "1", None), ("r", None, "n")]
    answers = spark.createDataFrame([("q", "a", ["c", "d"], None)], files.LOGGED)
    for _ in range(2):
        files.append_log(answers, str(tmp_path / "log"))
        files.append_history(spark.createDataFrame([("l", 0.5)], "label string, mean double"), str(tmp_path / "history"))
    assert [tuple(r) for r in files.log(spark, str(tmp_path / "log")).collect()] == [("q", "a", ["c", "d"], None)] * 2
    assert [tuple(r) for r in files.history(spark, str(tmp_path / "history"), "label string, mean double").collect()] == [("l", 0.5)] * 2
    (tmp_path / "g" / "doc7").mkdir(parents=True)
    (tmp_path / "g" / "doc7" / "data.json").write_text('{"nodes": [{"id": "n"}]}')
    assert [tuple(r)[0] for r in files.graphs(spark, str(tmp_path / "g"), "nodes array<map<string,string>>").collect()] == ["doc7"]
