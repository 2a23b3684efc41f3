"""Answers from rows against nested loops, and their texts."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import answers

BARE = re.compile(r"[ \n\r\t,:;(){}\[\]\"'`“”‘’%\-_/]")
ROWS = "document_id long, table_name string, row_index long, label string, cells map<string,string>"


def bare(s):
    return BARE.sub("", s or "").strip().lower()


def test_contained_pairs_are_those_of_all_pairs(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abกข ") for _ in range(draw.randrange(n)))
    needles, hays = [word(7) for _ in range(300)] + [None, "aaaa"], [word(30) for _ in range(300)] + [None, "a" * 50]
    df = answers.contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string"))
    want = {(n, h) for n in needles for h in hays if n and h and n in h}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_best(questions, rows, terms_of):
    out = {}
    for key, q in questions:
        best, most, nq = None, -1, bare(q)
        for r in sorted(rows, key=lambda r: r[:3]):
            nl = bare(r[3])
            if not nl or not any(re.fullmatch(r"(25|20)\d{2}", h) for h in r[4]):
                continue
            score = len(nl) + 100 if nl in nq else len(nq) + 50 if nq and nq in nl else 0
            score += sum(max(10, 3 * len(t)) for t in terms_of[key] if not re.fullmatch(r"(25|20)\d{2}", t) and bare(t) and bare(t) in nl)
            if score > most and score >= 40:
                best, most = r[:3], score
        if best:
            out[key] = (*best, most)
    return out


def test_best_rows_are_those_of_every_pair(spark):
    draw = random.Random(3)
    words = "total assets net profit loans deposits อัตราส่วน กำไรสุทธิ SSF".split()
    phrase = lambda n: " ".join(draw.choice(words) for _ in range(draw.randrange(1, n)))
    rows = [(draw.randrange(3), draw.choice("ab"), i, draw.choice([phrase(4), phrase(2), "", None, "Net-Profit"]), draw.choice([{"2021": "1"}, {"x": "1"}, {"2565": "", "2564": "2"}])) for i in range(120)]
    questions = [(i, draw.choice(["What is {} in 2021?", "{}", "{} 2565 2564"]).format(phrase(5))) for i in range(60)] + [(90, None), (91, "")]
    q, r = spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(rows, ROWS)
    from docloom.functions import text

    terms = {x.question_id: x.t or [] for x in q.select("question_id", text.keyword_terms(F.col("question")).alias("t")).collect()}
    best = answers.best_rows(q, r)
    assert {x.question_id: (x.document_id, x.table_name, x.row_index, x.score) for x in best.collect()} == brute_best(questions, rows, terms)
    for plan in (best, answers.looked_up(q, r)):
        assert not re.search("NestedLoop|Cartesian", plan._jdf.queryExecution().executedPlan().toString())


def test_what_answers_say(spark):
    cells = {"2565": "1,200.5", "2564": "(3)", "2563": "", "รายการ": "กำไร"}
    asks = ["กำไร ปี 2565", "กำไร 2565 เพิ่มขึ้น จาก 2564", "กำไร สูงสุด", "กำไร ต่ำสุด", "กำไร", "กำไร 2563", "กำไรต่อหุ้น 2565", "กำไร อัตราส่วน 2565 เปลี่ยนจาก 2564", "กำไร 2570"]
    df = spark.createDataFrame([(i, a, 1, "t", 0, "กำไร", cells) for i, a in enumerate(asks)], "n int, question string, document_id long, table_name string, row_index long, label string, cells map<string,string>")
    got = [r.answer for r in answers.direct_answers(df).orderBy("n").collect()]
    assert got == [
        "กำไรในปี 2565 เท่ากับ 1,200.5", "กำไรปี 2565 เพิ่มขึ้น 1203.50 บาท จาก (3) เหลือ 1,200.5", "ปี 2565 ที่ 1,200.5", "ปี 2564 ที่ (3)", "กำไร\nปี 2564: (3)\nปี 2565: 1,200.5", None,
        "กำไรในปี 2565 เท่ากับ 1,200.5 บาท", "กำไรปี 2565 เพิ่มขึ้น 1203.50 จุดเปอร์เซ็นต์ จาก (3)% เหลือ 1,200.5%", None,
    ]


def test_lookups_take_the_first_year_that_a_row_has(spark):
    rows = [(1, "t", 0, "Net profit", {"2021": "", "2022": "7"}), (1, "t", 1, "Net", {"2021": "5"}), (0, "u", 0, "Net profit and more of 2021 2022", {"2021": "9"}), (0, "u", 1, None, {"2021": "9"})]
    asks = [(1, "net profit 2021 2022"), (2, "net 2021"), (3, "net profit and more of 2021"), (4, "net profit"), (5, None), (6, "nothing 2021")]
    got = {r.question_id: (r.document_id, r.row_index, r.value, r.year) for r in answers.looked_up(spark.createDataFrame(asks, "question_id long, question string"), spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: (1, 0, "7", "2022"), 2: (1, 1, "5", "2021"), 3: (1, 1, "5", "2021")}


def test_lookups_meet_one_row_of_a_label_and_year(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(9), draw.choice("ab"), i, draw.choice(["Net", "Net profit", "profit", None]), draw.choice([{"2021": "1"}, {"2021": " ", "2022": str(i)}, {"2021": str(i), "2022": "2"}, {"x": "1"}, None])) for i in range(400)]
    asks = [(i, draw.choice(["net 2021", "net profit 2022 2021", "profit 2022 2022", "net profit 2021 2023", "net profit", "gross 2021"])) for i in range(200)]
    q, r = spark.createDataFrame(asks, "question_id long, question string"), spark.createDataFrame(rows, ROWS)
    plain = lambda x: (x or "").lower().replace(" ", "")
    want = {}
    for i, question in asks:
        years = re.findall(r"20\d\d", question)
        hits = []
        for d, t, n, label, cells in rows:
            a, b = plain(question), plain(label)
            year = next((y for y in years if (cells or {}).get(y, "").strip()), None)
            if b and year and (b in a or a in b):
                hits.append((-(len(b) + 100 if b in a else len(a)), d, t, n, cells[year], year))
        if hits:
            want[i] = min(hits)[1:]
    got = answers.looked_up(q, r)
    assert {x.question_id: (x.document_id, x.table_name, x.row_index, x.value, x.year) for x in got.collect()} == want
    known = r.withColumn("__label", F.lower("label"))
    firsts = answers.first_of_years(known, answers.asked(q, "question"))
    assert firsts.count() == firsts.select("__label", "__year").distinct().count() <= 8 and {x["__year"] for x in firsts.select("__year").collect()} == {"2021", "2022"}
