"""Every registered query against its SQL twin, and the plans behind them."""
import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows
from linkspark.plans import fixtures as fx
from linkspark.plans.oracles import ORACLES
from linkspark.plans.queries import QUERIES

WITHOUT_SQL = {"analyze_english", "search_highlights"}  # stems and highlights have no SQL form


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    got = entry.queries()[name](spark, sf).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    kinds, wanted = ({f.name: str(f.type).replace("large_", "") for f in t.schema} for t in (got, want))
    assert kinds == wanted
    assert got.num_rows > 0 or name == "rejected_link_jobs"
    assert rows(got.to_pandas()) == rows(want.to_pandas())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "job_id", "source_url", "broken_url", "anchor_text", "status_code", "error_type", "error_message", "depth", "discovered_at"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["broken_links", "check_links", "admission_schedule", "retry_decisions", "fuzzy_terms",
                                  "search_many", "crawl_bfs", "robots_verdicts", "visited_lookup", "redirect_chains"])
def test_no_pairs_of_everything(spark, sf, name):
    plan = _plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_columns_and_filters_reach_the_scan(spark, sf):
    plan = _plan(QUERIES["retryable_errors"](spark, sf))
    assert "EqualTo(event_type,error)" in plan or "event_type" in plan.split("PushedFilters")[1]
    assert "value:double" not in plan
    plan = _plan(QUERIES["list_jobs"](spark, sf))
    assert "TakeOrderedAndProject" in plan and "o_totalprice" not in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in _plan(QUERIES["search_many"](spark, sf))


def test_hot_rows_are_combined_before_the_shuffle(spark, sf):
    plan = _plan(QUERIES["dedupe_urls"](spark, sf))
    assert "partial_min_by" in plan and "Window" not in plan


def test_fixture_covers_all_pages(spark, sf):
    pages = fx.table(spark, sf, "pages").count()
    assert fx.link_rows(spark, sf).count() == 4 * pages
    assert fx.linked(spark, sf).count() == pages
