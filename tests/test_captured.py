"""The data source over captured pages: scans, schema and business rejects, pushed filters, page ranges."""

import json

import pyspark.sql.functions as F
import pytest

from loomstone.sources import captured
from loomstone.sources.schemas import PAGES


def full(n, size, last=None):
    """n items in pages of a size, as (page, status, items, last)."""
    counts = [size] * (n // size) + ([n % size] if n % size else [])
    return [(i, 200, c, i == len(counts) - 1 if last else False) for i, c in enumerate(counts)]


def by_hand(source, items, size, cap, asks_rest, last):
    """A paged source asked page by page."""
    at, page, received, truncated = 0, 0, 0, False
    while received < cap:
        limit = min(size, cap - received) if asks_rest else size
        got = min(limit, items - at)
        if got <= 0:
            break
        rest = cap - received
        if got > rest:
            truncated = True
        received += min(got, rest)
        at += got
        if got < limit or (last and at >= items):
            break
        if received >= cap:
            truncated = True
        page += 1
    return received, truncated


@pytest.mark.parametrize("source", sorted(PAGES))
@pytest.mark.parametrize("last", [False, True])
def test_scans_go_as_page_by_page(source, last):
    rules = PAGES[source]
    for n in [*range(0, 4 * rules.size + 1, max(1, rules.size // 10)), 5 * rules.size]:
        for cap in (1, rules.size - 1, rules.size, rules.size + 1, 2 * rules.size, 2 * rules.size + 3, 100 * rules.size):
            if last and rules.asks_rest:
                continue  # this source doesn't say which page is its last
            scan = captured.plan_scan(source, full(n, rules.size, last), cap)
            assert (scan.received, scan.truncated) == by_hand(source, n, rules.size, cap, rules.asks_rest, last), (n, cap)
            assert sum(t for _, t in scan.taken.values()) == scan.received


def test_scans_stop_where_a_page_fails():
    scan = captured.plan_scan("gupy", [(0, 200, 10, False), (1, 503, None, False), (2, 200, 10, False)], 50)
    assert (scan.received, scan.truncated, scan.failure) == (10, False, "page 1 was answered with 503")
    assert captured.plan_scan("gupy", [(0, 200, 10, False), (1, 200, None, False)], 50).failure == "page 1 isn't the source's envelope"
    assert captured.plan_scan("gupy", [(0, 200, 10, False), (2, 200, 10, False)], 50).failure == "page 1 was not captured"
    assert captured.plan_scan("gupy", [(0, 200, 4, False), (1, 200, 10, False)], 50).received == 4
    assert captured.plan_scan("gupy", [], 50).taken == {}


@pytest.mark.parametrize(
    ("source", "item", "problem"),
    [
        ("gupy", {"id": 1, "name": "a"}, None),
        ("gupy", {"id": "x", "name": "a", "city": None, "more": [1]}, None),
        ("gupy", {"name": "a"}, "id: missing"),
        ("gupy", {"id": True, "name": "a"}, "id: not of kind id"),
        ("gupy", {"id": 1, "name": None}, "name: not of kind text"),
        ("gupy", {"id": 1, "name": "a", "description": None}, "description: not of kind text"),
        ("gupy", [1], "(item): not an object"),
        ("ciee", {"codigoVaga": 5, "local": None, "requisitos": {"semestreInicio": None}}, None),
        ("ciee", {"codigoVaga": 5, "requisitos": {"semestreInicio": "1"}}, "requisitos.semestreInicio: not of kind number"),
        ("ciee", {"codigoVaga": 5, "atividades": ["a", 1]}, "atividades: not of kind texts"),
        ("solides", {"id": 1, "title": "t", "city": {"id": 1}}, "city.name: missing"),
        ("solides", {"id": 1, "title": "t", "city": None, "homeOffice": "yes"}, "homeOffice: not of kind flag"),
    ],
)
def test_items_are_checked(source, item, problem):
    assert captured.schema_problem(source, item) == problem


def test_requests_carry_the_sources_own_filters():
    assert captured.request_parameters("gupy", 4, title="dev", city="Rio", remote=True, cap=47) == {"jobName": "dev", "city": "Rio", "isRemoteWork": "true", "limit": "7", "offset": "40"}
    assert captured.request_parameters("solides", 0, city="Niterói") == {"title": "", "locations": "Niterói - RJ", "take": "10", "page": "1"}
    assert captured.request_parameters("solides", 2, title="x", city="Elsewhere")["locations"] == "Elsewhere"
    assert captured.request_parameters("ciee", 3, title="x", city="Rio") == {"page": "3", "size": "100"}


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    """35 gupy items of query "a b/c", one of which is broken, 3 of "late" whose second page failed, and 150 of ciee."""
    gupy = [{"id": i, "name": f"job {i}", "city": "Rio" if i % 2 else None, "workplaceType": "remote" if i % 5 == 0 else "hybrid"} for i in range(35)]
    gupy[7] = {"id": 7}
    ciee = [{"codigoVaga": i, "nivelEscolar": "SU" if i % 3 else "EM", "local": {"cidade": "Rio de Janeiro"}, "areaProfissional": "Informática" if i % 2 else None} for i in range(150)]
    pages = [("gupy", "a b/c", p, 200, json.dumps({"data": gupy[10 * p : 10 * p + 10]})) for p in range(4)]
    pages += [("gupy", "late", 0, 200, json.dumps({"data": [{"id": i, "name": "n"} for i in range(10)]})), ("gupy", "late", 1, 500, "oops")]
    pages += [("ciee", "all", p, 200, json.dumps({"content": ciee[100 * p : 100 * p + 100], "last": p == 1})) for p in range(2)]
    path = str(tmp_path_factory.mktemp("capture") / "c")
    captured.capture(spark.createDataFrame(pages, "source string, query string, page int, status int, body string"), path)
    captured.register(spark)
    return path


def reading(spark, path, **options):
    return spark.read.format("captured_pages").options(path=path, **options).load()


def test_items_in_page_ranges(spark, capture):
    for per_task in (1, 3, 200):
        rows = reading(spark, capture, pages_per_task=per_task).filter("source = 'gupy' AND query = 'a b/c'").orderBy("pos").collect()
        assert [r.source_id for r in rows] == [str(i) for i in range(35) if i != 7]
        assert [r.page for r in rows] == [int(r.source_id) // 10 for r in rows]
        assert json.loads(rows[0].payload)["name"] == "job 0"


def test_filters_are_pushed(spark, capture):
    found = reading(spark, capture).filter((F.col("query") == "a b/c") & (F.col("mode") == "remote") & F.col("city").isin("Rio", "x") & F.col("title").contains("5"))
    assert [r.source_id for r in found.collect()] == ["5", "15", "25"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert all(x not in "".join(filters) for x in ("remote", "a b/c", "Contains"))
    left = reading(spark, capture).filter("query = 'a b/c' AND pos > 30")
    assert left.count() == 4


def test_rejects_and_scans(spark, capture):
    rejects = reading(spark, capture, table="rejects", levels="SU", area="informatica").collect()
    assert {(r.query, r.pos, r.kind, r.problem) for r in rejects if r.source == "gupy"} == {("a b/c", 7, "schema", "name: missing")}
    assert {(r.pos, r.problem) for r in rejects if r.source == "ciee"} == {(i, "level" if i % 3 == 0 else "areaProfissional") for i in range(150) if i % 3 == 0 or i % 2 == 0}
    scans = {r.query: r for r in reading(spark, capture, table="scans").collect()}
    assert scans["a b/c"][2:] == (35, 34, 1, 0, False, None)
    assert scans["late"][2:] == (10, 10, 0, 0, False, "page 1 was answered with 500")
    assert scans["all"][2:] == (150, 100, 0, 50, False, None)
    cut = {r.query: r for r in reading(spark, capture, table="scans", max_results=20).collect()}
    assert (cut["a b/c"].received, cut["a b/c"].truncated, cut["all"].received, cut["all"].truncated) == (20, True, 20, True)
    assert reading(spark, capture, max_results=20).filter("query = 'a b/c'").count() == 19


def test_wrong_tables_are_refused(spark, capture):
    with pytest.raises(Exception, match="table: one of items, rejects, scans"):
        reading(spark, capture, table="x").collect()


def test_a_capture_without_pages(spark, tmp_path):
    captured.register(spark)
    captured.capture(spark.createDataFrame([], "source string, query string, page int, status int, body string"), str(tmp_path / "none"))
    assert reading(spark, str(tmp_path / "none")).count() == 0
