"""Pages as trees against a tree built with the standard parser, element by element."""

import random
import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from docloom.functions import text
from docloom.operators import dom, pages


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = {"name": "", "attrs": {}, "kids": [], "up": None}
        self.at, self.held = self.root, ""
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if self.held:
            self.at["kids"].append(self.held)
        self.held = ""

    def handle_comment(self, data):
        self.flush()

    handle_decl = unknown_decl = handle_pi = handle_comment

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = {"name": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in dom.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.at["kids"].append({"name": tag, "attrs": dict(attrs), "kids": [], "up": self.at})

    def handle_endtag(self, tag):
        self.flush()
        n = self.at
        while n is not self.root and n["name"] != tag:
            n = n["up"]
        if n is not self.root:
            self.at = n["up"]

    def handle_data(self, data):
        self.held += data


def below(n):
    for k in n["kids"]:
        if isinstance(k, dict):
            yield k
            yield from below(k)


def strings(n):
    return [s for k in n["kids"] for s in (strings(k) if isinstance(k, dict) else [k.strip()] if k.strip() and n["name"] not in ("script", "style") else [])]


def cleaned(n, junk):
    n["kids"] = [k for k in n["kids"] if not (isinstance(k, dict) and junk(k))]
    for k in n["kids"]:
        if isinstance(k, dict):
            cleaned(k, junk)


def label(n):
    return f"{n['attrs'].get('id', '')} {' '.join(n['attrs'].get('class', '').split())}".lower().strip()


def article_junk(n):
    return n["name"] in dom.JUNK_TAGS or bool(re.search("|".join(dom.JUNK_NAMES), label(n))) or any(h in n["attrs"].get("style", "").lower() for h in dom.HIDDEN)


def dense_junk(n):
    return n["name"] in dom.DENSE_JUNK_TAGS or bool(re.search("|".join(dom.DENSE_JUNK_NAMES), label(n)))


def size(n):
    return len("\n".join(strings(n)))


def article(root):
    cleaned(root, article_junk)
    every = list(below(root))
    kinds = [lambda n: n["name"] == "article", lambda n: n["attrs"].get("itemprop") == "articleBody", *[lambda n, c=c: c in n["attrs"].get("class", "").split() for c in dom.ARTICLE_CLASSES]]
    for k in kinds:
        first = next((n for n in every if k(n)), None)
        if first and size(first) > 300:
            return first
    scores, order = {}, []
    for n in every:
        links = sum(len("".join(strings(a))) for a in below(n) if a["name"] == "a")
        if n["name"] not in dom.SCORED or size(n) < 30 or links / size(n) > 0.4:
            continue
        for up, share in ((n["up"], 1), (n["up"]["up"], 0.5)):
            if up is not None:
                if id(up) not in scores:
                    order.append(up)
                scores[id(up)] = scores.get(id(up), 0) + size(n) * share
    if order:
        return max(order, key=lambda n: scores[id(n)])  # the first of equal ones
    return next((n for n in every if n["name"] == "body"), root)


def dense(root):
    cleaned(root, dense_junk)
    every = list(below(root))
    first = [n for n in every if n["name"] in ("article", "main") or n["attrs"].get("role") == "main"]
    best, most = None, -1.0
    for n in first + [n for n in every if n["name"] in ("section", "div")]:
        chars, links = size(n), sum(size(a) for a in below(n) if a["name"] == "a")
        if chars >= 400:
            share, blocks = links / chars, sum(b["name"] in dom.BLOCKS for b in below(n))
            score = max(chars - links, 0) * (1 - min(share, 0.95)) * (1 + min(blocks, 60) / 12) * (0.25 if share > 0.55 else 1)
            if score > most:
                best, most = n, score
    return best or next((n for k in ("article", "main", "body") for n in every if n["name"] == k), root)


def plain_lines(raw):
    out = []
    for ln in re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", raw)).split("\n"):
        if len(ln.strip()) >= 3 and ln.strip().lower() not in [x.lower() for x in out]:
            out.append(ln.strip())
    kept, seen = [], set()
    for ln in out:
        low = ln.lower()
        if len(low) < 60 and any(w in low for w in pages.STOP_LINES) and sum(map(len, kept)) > 300:
            break
        if (any(w in low for w in pages.SKIPPED_LINES) and len(low) < 40) or (len(ln) < 10 and " " not in ln and not re.search(r"\d", ln)) or low in seen:
            continue
        seen.add(low)
        kept.append(ln)
    return "\n".join(kept)


def page(draw):
    words = lambda n: " ".join(draw.choice("wind house water quiet ความ ﬁre café &amp; &lt;x&gt; 12 tags: sponsored".split()) for _ in range(n))
    attrs = lambda: draw.choice(["", "", "", ' class="entry-content x"', " class='side BAR'", ' id="Related-1"', ' style="COLOR: red; display: none"', " role=main", ' itemprop="articleBody"', ' class="tags"', ' data-x="a>b"'])

    def node(depth):
        kind = draw.random()
        if depth > 5 or kind < 0.35:
            return draw.choice([words(draw.randrange(1, 40)), f"<a href='x'{attrs()}>{words(draw.randrange(1, 12))}</a>", "<br>", "<img src=x/>", f"<!-- {words(2)} -->", "<script>if (a < b) { '</p>' }</script>", " a < b ", "\n", "</span>"])
        tag = draw.choice(["div", "div", "p", "span", "section", "ul", "li", "h2", "article", "main", "nav", "b", "table"])
        inner = "".join(node(depth + 1) for _ in range(draw.randrange(0, 5)))
        return f"<{tag}{attrs()}>{inner}" + (f"</{tag.upper()}>" if draw.random() < 0.85 else "")

    return "<!DOCTYPE html><html><head><title>T t</title></head><body>" + "".join(node(0) for _ in range(draw.randrange(1, 9))) + draw.choice(["</body></html>", "", "</div>"])


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(8)
    rows = [(i, page(draw)) for i in range(150)] + [(900, None), (901, ""), (902, "only text"), (903, "<div><p>" * 300 + "deep"), (904, "<a" * 50), (905, "<nav>x</nav>"), (906, "<article>" + "<p>" + "w " * 400 + "</p><p>Sponsored</p><p>after the end</p></article>")]
    return rows, spark.createDataFrame(rows, "id long, html string").repartition(3)


@pytest.mark.parametrize("by_density", [False, True])
def test_main_texts_are_those_of_a_tree(made, by_density):
    rows, df = made
    got = {r.id: r.text for r in dom.main_texts(df, "id", dense=by_density).collect()}
    assert len(got) == len(rows)
    for i, html in rows:
        want = plain_lines("\n".join(strings((dense if by_density else article)(Tree(html or "").root))))
        assert got[i] == want, (i, html)


def test_elements_have_their_parents_and_measures(made):
    rows, df = made
    got = {}
    for r in dom.measured(dom.nodes(df, "id"), "id").collect():
        got.setdefault(r.id, []).append((r.at, r.name, r.parent, r.chars, r.link_chars, r.link_text, r.blocks))
    for i, html in rows:
        root = Tree(html or "").root
        every, mine = [root, *below(root)], sorted(got[i])
        places = {id(n): m[0] for n, m in zip(every, mine, strict=True)}
        links = [[a for a in below(n) if a["name"] == "a"] for n in every]
        want = [(n["name"], places.get(id(n["up"]), -1), size(n), sum(len("".join(strings(a))) for a in ls), sum(map(size, ls)), sum(b["name"] in dom.BLOCKS for b in below(n))) for n, ls in zip(every, links, strict=True)]
        assert [m[1:] for m in mine] == want, (i, html)


def test_a_stop_line_ends_a_text_whatever_else_it_is(spark):
    long = "a line that is long enough to be kept, number "
    rows = [("\n".join([f"{long}{i}" for i in range(8)] + [stop, "what follows it"]),) for stop in ("sponsored", "tags:", "แชร์ข่าว")] + [("tags:\nshort text here",), (None,), ("\n".join([f"{long}{i % 2}" for i in range(30)] + ["tags:", "tags:", "goes on here"]),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(pages.filtered_lines("t")).collect()]
    assert all(not g.endswith("it") and g.endswith("number 7") for g in got[:3]) and got[3:5] == ["short text here", ""] and got[5].endswith("goes on here")


def test_folded_forms(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").union(spark.createDataFrame([(None,), ("",), ("ﬁ ① ｱ é  กํา",), ("plain",)], "text string"))
    assert all(r.f == (None if r.text is None else unicodedata.normalize("NFKC", r.text)) for r in df.select("text", text.nfkc("text").alias("f")).collect())


@pytest.mark.parametrize("cut,want", [("a &amp", "a &amp"), ("a &amp;", "a &"), ("a &ampx; b", "a &ampx; b"), ("&notit;", "&notit;"), ("&lt;&#39;&#x41;&copy;", "<'A©"), ("&&amp;amp;", "&&amp;"), ("&nosuch;", "&nosuch;"), ("x &lt y", "x &lt y")])
def test_a_reference_that_was_cut_is_text(spark, cut, want):
    rows = dom.nodes(spark.createDataFrame([(1, f"<p>{cut}</p>")], "id int, html string"), "id").filter("name IS NULL").collect()
    assert [r.text for r in rows] == [want]


def test_nodes_leave_a_task_in_parts():
    tokens = ["<p>", "a", "</p>"] * 2000
    made = list(dom.sweep(iter([pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([tokens] * 29 + [[]])], ["key", "tokens"])])))
    assert [k for b in made for k in b.column(0).to_pylist()] == list(range(30)) and len(made) > 5
    assert all(sum(map(len, b.column(1).to_pylist())) <= dom.PART + 4001 for b in made) and made[-1].column(1).to_pylist()[-1][0]["end"] == 1
