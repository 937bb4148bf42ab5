import pytest
from conftest import SF, same

from inkwell.operators import notes
from inkwell.plans import batches, catalog, increments, vaults  # noqa: F401  (these add their queries to the catalog)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_other_queries_have_a_test_of_their_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"summary_parse"}


def test_summary_parse_equals_one_by_one(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {}
    for r in rows:
        *fields, status = notes._summary(r.text or "")
        want[r.conv_id, r.turn] = (status, len(fields[0]), fields[1])
    got = {(r.conv_id, r.turn): (r.status, r.cards, r.permanent_note) for r in catalog.QUERIES["summary_parse"](spark, SF).collect()}
    assert got == want and len(got) == len(rows)
