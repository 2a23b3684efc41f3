"""Grids of tables against a grid filled cell by cell, and pages put together by hand."""

import random
import re

import pyarrow as pa
import pytest

from docloom.operators import assembly, dom
from docloom.operators.dom import in_parts


def brute_grid(rows):
    """Cells as rectangles; a place has the text of the first that covers it."""
    placed = []
    covers = lambda p, y, x: p[0] <= y < p[0] + p[2] and p[1] <= x < p[1] + p[3]
    for y, row in enumerate(rows):
        x = 0
        for value, down, across in row:
            while any(covers(p, y, x) for p in placed):
                x += 1
            placed.append((y, x, down or len(rows) - y, across, value))
            x += across
    width = max([p[1] + p[3] for p in placed], default=0)
    return [[next((p[4] for p in placed if covers(p, y, x)), "") for x in range(width)] for y in range(len(rows))]


def table(draw, depth=0):
    """Mark-up of a table, and what it and the tables within it should give, in order of their start."""
    rows, marks, inner = [], [], []
    for _ in range(draw.randrange(0, 5)):
        row, cells = [], []
        for _ in range(draw.randrange(1, 4)):
            value, down, across = draw.choice(["", "a b", "12", "wind"]), draw.choice([1, 1, 1, 2, 3, 0]), draw.choice([1, 1, 2, 3])
            own = ""
            if depth < 2 and draw.random() < 0.1:
                own, below = table(draw, depth + 1)
                inner += below
            cells.append(f"<td rowspan='{down}' colspan={across}><b>{value.replace(' ', '<br>  ')}</b>{own}</td>")
            row.append((value, down, across))
        rows.append(row)
        marks.append("<tr>" + "".join(cells) + "</tr>")
    grid = [r for r in brute_grid(rows) if any(r)]
    mine = (grid[0], grid[1:]) if len(grid) > 1 else None
    return f"<TABLE class=x>{''.join(marks)}</TABLE>", [mine, *inner]


def test_grids_of_spanning_and_nested_cells(spark):
    draw = random.Random(4)
    made = [table(draw) for _ in range(200)]
    df = spark.createDataFrame([(i, f"text before\n{m}\nafter") for i, (m, _) in enumerate(made)], "id long, html string")
    got = {}
    for r in assembly.html_grids(dom.nodes(df, "id"), "id").collect():
        got.setdefault(r.id, []).append((r.at, None if r.rows is None else (r.headers, r.rows)))
    for i, (mark, want) in enumerate(made):
        assert [g for _, g in sorted(got[i], key=lambda x: x[0])] == want, mark
    assert any(len(w) > 1 for _, w in made)


def test_odd_spans_and_captions(spark):
    html = "<table><caption> The <b>title</b></caption><tr><th rowspan=x colspan=0>h</th><th colspan='2000'>k</tr><tr><td>1</td></tr></table><table></table><td>loose</td>"
    first, second = assembly.html_grids(dom.nodes(spark.createDataFrame([(1, html)], "id long, html string"), "id"), "id").orderBy("at").collect()
    assert first.caption == "The title" and len(first.headers) == 1001 and first.headers[:2] == ["h", "k"] and first.rows[0][:2] == ["1", ""] and second.rows is None


PAGE = """Report of the year
<figure>
intro line one

intro line two

| head | of |
|:--|--:|
| Only title | |
| a | 1 |
| --- | --- |
tail | not a row
Costs by region
<table><tr><td>r</td><td>c</td></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>
| no | separator |
after ![img](x.png) the table
<table><tr><td>alone</td></tr></table>
tail | not a row
| h | i |
|---|---|
"""


@pytest.mark.parametrize("paragraphs", [False, True])
def test_a_page_in_reading_order(spark, paragraphs):
    rows = [("d", 1, PAGE), ("d", 2, "second page\n| a | b |\n|---|---|\n| 1 | 2 |"), ("d", 3, None), ("e", 1, ""), (None, None, "x"), ("d", 0, "zero")]
    df = spark.createDataFrame(rows, "doc string, page int, markdown string")
    parts = assembly.assembled(df, "doc", "page", paragraphs=paragraphs)
    got = [(r.page, r.kind, r.title, r.headers, r.rows, r.text) for r in parts.filter("doc = 'd'").orderBy("place").collect()]
    intro = ["intro line one", "intro line two"] if paragraphs else ["intro line one\nintro line two"]
    want = [(0, "text", None, None, None, "zero"), (1, "text", None, None, None, "Report of the year")]
    want += [(1, "text", None, None, None, t) for t in intro]
    want += [
        (1, "pipe_table", "Only title", ["head", "of"], [["a", "1"], ["---", "---"]], None),
        (1, "text", None, None, None, "tail | not a row\nCosts by region"),
        (1, "html_table", "Costs by region", ["r", "c"], [["x", "1"], ["x", "2"]], None),
        (1, "text", None, None, None, "| no | separator |\nafter  the table"),
        (1, "text", None, None, None, "tail | not a row"),
        (2, "text", None, None, None, "second page"),
        (2, "pipe_table", None, ["a", "b"], [["1", "2"]], None),
    ]
    assert got == want
    assert [r.text for r in parts.filter("doc IS NULL").collect()] == ["x"]
    counts = {(r.doc, r.page): (r.text_blocks, r.tables) for r in assembly.page_counts(df, parts, "doc", "page").collect()}
    assert counts["e", 1] == counts["d", 3] == (0, 0) and counts[None, None] == (1, 0) and counts["d", 2] == (1, 1)


def test_no_character_is_in_two_parts(spark):
    draw = random.Random(6)
    rows = []
    for i in range(60):
        n, bits = 0, []
        for _ in range(draw.randrange(1, 9)):
            word = lambda: f"w{i}x{(n := draw.randrange(10**9))}q"  # noqa: E731, F841, B023
            bits.append(draw.choice([lambda: f"{word()}\n{word()}", lambda: f"<table><tr><td>{word()}</td></tr><tr><td>{word()}<table><tr><td>{word()}</td></tr><tr><td>{word()}</td></tr></table></td></tr></table>", lambda: f"| {word()} | b |\n|---|---|\n| {word()} | {word()} |\n", lambda: ""])())
        rows.append((i, 1, "\n".join(bits)))
    parts = assembly.assembled(spark.createDataFrame(rows, "doc long, page int, markdown string"), "doc", "page").collect()
    for i, _, body in rows:
        found = [w for r in parts if r.doc == i for w in re.findall(r"w\d+x\d+q", str((r.headers, r.rows, r.text)))]
        assert sorted(found) == sorted(re.findall(r"w\d+x\d+q", body))


def test_grids_leave_a_task_in_parts():
    made = list(in_parts(pa.array([3, 0, 50, None, 7, 1]), lambda n: [["x"] * (n or 0)], lambda g: sum(map(len, g)), 10))
    assert [(start, [len(g[0]) for g in of]) for start, of in made] == [(0, [3, 0, 50]), (3, [0, 7, 1])]


def test_pages_go_to_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", dom.BATCH), ("0", dom.BATCH), ("20", 20)):  # 0 is no bound
            spark.conf.set(name, given)
            found = dom.nodes(spark.range(30).selectExpr("id", "'<p>a</p>' AS html"), "id")
            assert int(spark.conf.get(name)) == want
            assert found.count() == 30 * 3
    finally:
        spark.conf.set(name, before)
