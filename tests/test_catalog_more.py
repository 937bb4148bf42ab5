import datetime

import duckdb
from conftest import SF, same
from pyspark.sql import functions as F

from inkwell.plans import batches, catalog, increments, vaults  # noqa: F401  (these add their queries to the catalog)


def test_seconds_given_are_rounded_as_in_the_sql(spark, tmp_path):
    at = lambda s, us=0: datetime.datetime(2024, 1, 5, 15, 59, s, us)  # noqa: E731  (a second before the day changes in Shanghai)
    times = [at(58, 499999), at(59), at(59, 499999), at(59, 500000), at(59, 500001), at(59, 999999), datetime.datetime(2024, 1, 5, 16, 0, 0, 500000)]
    duck = duckdb.connect()
    duck.execute("create table events (event_id bigint, ts timestamp)")
    duck.executemany("insert into events values (?, ?)", [(i + 1, t) for i, t in enumerate(times)])
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    same(catalog.QUERIES["publish_time_format"](spark, str(tmp_path)), duck, catalog.ORACLES["publish_time_format"])


def test_pages_differ_from_the_sql_only_where_a_reference_has_no_semicolon(spark, tmp_path):
    """HTML reads `&amp<` as `&<`; the SQL replaces references with a semicolon only, and agrees once they have one."""
    html = "<html><head><title>Cut title and{}</title></head><body><article><h1>Cut title and{}</h1><p>one</p></article></body></html>"
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, 'https://h.example.com/a/1', ?)", [(i, html.format(x, x)) for i, x in enumerate(("&amp;", "&amp", " &am", ""))])
    duck.execute(f"copy pages to '{tmp_path}/pages.parquet' (format parquet)")
    rows = {r.page_id: r.title for r in catalog.QUERIES["page_metadata"](spark, str(tmp_path)).collect()}
    assert rows == {0: "Cut title and&", 1: "Cut title and&", 2: "Cut title and &am", 3: "Cut title and"}
    duck.execute("update pages set html = replace(html, '&amp<', '&amp;<')")
    duck.execute(f"copy pages to '{tmp_path}/pages.parquet' (format parquet)")
    for name in ("page_candidates", "page_metadata", "page_extraction", "quarantined_pages"):
        same(catalog.QUERIES[name](spark, str(tmp_path)), duck, catalog.ORACLES[name])
