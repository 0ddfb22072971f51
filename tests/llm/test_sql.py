import pytest

from lodestrand.llm import queries
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, oracle):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), oracle.execute(queries.oracle_sql()[name]).df()
    for c in got:
        if got[c].dtype.kind == "f" and want[c].dtype.kind in "iI":
            got[c] = got[c].astype("Int64")
    assert_same(got, want.astype({c: "Int64" for c in want if want[c].dtype.kind in "iI" and got[c].dtype.name == "Int64"}))
