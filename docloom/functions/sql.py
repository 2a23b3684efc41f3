"""Functions and table functions for Spark SQL, registered in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import nfkc
from docloom.operators.assembly import filled
from docloom.operators.dom import TOKEN, swept

#: TOKEN as Python's patterns have it.
PATTERN = TOKEN.replace("++", "+").replace("*+", "*").replace(r"\z", r"\Z")


class ExtractTables:
    """The rows of the tables in one page: number of the table, from 0, of the row, from 0 for the head, and cells; tables within tables count on their own."""

    def eval(self, html: str):
        import re

        nodes = swept([m[0] for m in re.finditer(PATTERN, html or "")])
        words: dict[int, list[str]] = {}
        for n in nodes:
            if n[4] is None and n[15] >= 0:
                words.setdefault(n[15], []).append(n[10])
        rows: dict[int, dict[int, list]] = {n[0]: {} for n in nodes if n[4] == "table"}
        for n in nodes:
            if n[4] in ("td", "th") and n[14] >= 0:
                rows[n[13]].setdefault(n[14], []).append((" ".join(" ".join(words.get(n[0], [])).split()), n[16], n[17]))
        number = 0
        for of in rows.values():
            grid = [r for r in filled(list(of.values())) if any(r)]
            if len(grid) > 1:
                for i, cells in enumerate(grid):
                    yield number, i, cells
                number += 1


#: A shown number: (x) is negative; commas, blanks at the ends and Thai digits are read; anything else is null.
PARSE_NUMERIC = """
CREATE OR REPLACE TEMPORARY FUNCTION parse_numeric(cell STRING) RETURNS DOUBLE
RETURN CASE WHEN trim(cell) RLIKE '^[(].*[)]$' THEN -1 ELSE 1 END
  * try_cast(nullif(regexp_extract(replace(translate(regexp_replace(trim(cell), '^[(]|[)]$', ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), ',', ''), '^ *(-?[0-9]+([.][0-9]+)?) *$', 1), '') AS DOUBLE)
"""


def register(spark: SparkSession) -> None:
    """extract_tables(html), for LATERAL joins; nfkc(text); parse_numeric(cell), which Spark inlines."""
    spark.udtf.register("extract_tables", F.udtf(ExtractTables, returnType="table_no bigint, row_no bigint, cells array<string>"))
    spark.udf.register("nfkc", nfkc)
    spark.sql(PARSE_NUMERIC)
