"""SQL functions that give tables are inlined; they and the fold give what the operators give."""

import pytest

from docspark import dims, sql
from docspark.operators import review
from docspark.plans.adapters import view


@pytest.fixture(scope="module")
def state(spark, sf):
    rows = view(spark, sf, "review_state").select("id", "national_id", "full_name", "governorate", "review_status").cache()
    sql.register_tables(spark, rows)
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("query, status", [(" 01 ", "PENDING"), ("", "ALL"), ("CUSTOMER", "ACCEPTED"), ("it's", "ALL"), ("%", "ALL")])
def test_search(spark, state, query, status):
    text = query.replace("'", "''")
    assert rows_of(spark.sql(f"SELECT * FROM portal_search('{text}', '{status}')")) == rows_of(review.search(state, query, status).select("id", "national_id", "full_name", "governorate", "review_status"))


def test_no_python_and_no_call_is_left(spark, state):
    for call in ("SELECT * FROM portal_search('x', 'PENDING')", "SELECT c.* FROM VALUES ('29904170100119') t(x), LATERAL id_checks(x, DATE '2026-01-01') c"):
        plan = spark.sql(call)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "SQLFunction" not in plan and "portal_search" not in plan and "id_checks" not in plan


def test_template_fields(spark, state):
    for side in ("front", "back", "other"):
        want = sorted((i, f[0], f[5], f[6]) for _, s, fields in dims.TEMPLATES if s == side for i, f in enumerate(fields))
        assert rows_of(spark.sql(f"SELECT * FROM template_fields('{side}')")) == sorted(want, key=str)


def test_id_checks(spark, state):
    got = {r["part"]: r["value"] for r in spark.sql("SELECT * FROM id_checks('2990417 0100119', DATE '2026-01-01')").collect()}
    want = spark.sql("SELECT nid_status('29904170100119', DATE '2026-01-01') AS s").first()["s"]
    assert got["status"] == want and got["birth_date"] == "1999-04-17" and set(got) == {"status", "birth_date", "gender", "governorate"}
    none = {r["part"]: r["value"] for r in spark.sql("SELECT * FROM id_checks(NULL, DATE '2026-01-01')").collect()}
    assert none == {"status": "INVALID_FORMAT", "birth_date": None, "gender": None, "governorate": None}


def test_fold(spark, state):
    got = spark.sql("SELECT combined(array(named_struct('line_ord', 2, 'text', 'b', 'confidence', 0.5D), named_struct('line_ord', 1, 'text', 'a', 'confidence', 1.0D))) AS c, combined(array()) AS e").first()
    assert tuple(got["c"]) == ("a b", 0.75) and tuple(got["e"]) == ("", None)
