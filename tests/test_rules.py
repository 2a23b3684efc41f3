"""Every rule on the cases that are given for it."""

import duckdb
import pytest

from docloom.plans import catalogue
from docloom.plans.catalogue import Tables
from docloom.plans.registry import CASES
from tests import rule_cases  # noqa: F401  it fills CASES


@pytest.mark.parametrize("name", list(CASES))
def test_rule(spark, name):
    run, sql = CASES[name]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = duckdb.sql(sql)
    got = run(Tables(spark, "")).select(*want.columns).collect()
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name,most", [("rule_file_name", 60), ("rule_folder_name", 40)])
def test_names_of_parts_are_also_cut_and_replaced(name, most):
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT i AS p_partkey, 'large ring' AS p_name, 'SMALL' AS p_type, 'Brand#7' AS p_brand, i % 50 + 1 AS p_size FROM range(500) t(i)")
    got = {r[1] for r in con.execute(catalogue.oracle_sql()[name]).fetchall()}
    assert "site" in got and max(map(len, got)) == most and len(got) > 5
