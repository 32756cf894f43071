import os

import pytest

from spanforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_problem_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 9))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ngrams_of_every_length(spark):
    rows = {(r["n"], r["term"]): (r["occurrences"], r["records"]) for r in queries.queries()["p5_ngrams_all"](spark, SF).collect()}
    assert {n for n, _ in rows} == {1, 2, 3, 4, 5} and all(len(term.split(" ")) == n for n, term in rows)
    two = {(2, r["term"]): (r["occurrences"], r["records"]) for r in queries.queries()["p5_ngrams"](spark, SF).collect()}
    assert {k: v for k, v in rows.items() if k[0] == 2} == two
