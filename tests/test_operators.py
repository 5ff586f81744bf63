"""Operators on small fixtures, and every registered query against its SQL."""

import datetime as dt
import hashlib
import json
import os
import random

import pyspark.sql.functions as F
import pytest

from loomstone.operators import delivery, enrich, market, normalize, runs, scoring, similarity, store
from loomstone.operators.prefilter import Criteria, prefilter
from loomstone.plans import catalog
from loomstone.streaming import ingest, machines

DATA = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 8, 14, 3)


def posting(**changes):
    base = {"source": "gupy", "source_id": "1", "company": "Empresa X", "title": "Estágio em Desenvolvimento Backend", "location_kind": "known", "location_city": "Rio de Janeiro", "work_mode": "hybrid", "application_deadline": None, "published_at": None, "first_seen_at": NOW, "fingerprint": "f1", "pos": 1}
    return base | changes


SCHEMA = "source string, source_id string, company string, title string, location_kind string, location_city string, work_mode string, application_deadline timestamp, published_at timestamp, first_seen_at timestamp, fingerprint string, pos long"


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"title": "Estágio Tech Lead"}, "title_blocked"),
        ({"title": "Desenvolvedor"}, "title_missing_required_term"),
        ({"title": "Estágio em Direito"}, "track_unknown"),
        ({"title": "Estágio Desenvolvimento de Embalagens"}, "track_unknown"),
        ({"company": "EMPRESA RUIM!"}, "company_blocked"),
        ({"application_deadline": dt.datetime(2026, 8, 13)}, "expired"),
        ({"published_at": dt.datetime(2026, 6, 1)}, "too_old"),
        ({"published_at": dt.datetime(2027, 6, 1)}, None),
        ({"location_city": "São Paulo"}, "location_not_allowed"),
        ({"location_city": None, "location_kind": "unknown"}, None),
        ({"location_city": None, "location_kind": "unknown", "source": "ciee"}, "location_not_allowed"),
        ({"work_mode": "remote", "location_city": "São Paulo"}, None),
    ],
)
def test_prefilter_rules(spark, changes, reason):
    c = Criteria(("tech lead",), ("estágio",), {"dev": ("desenvolvimento", "back-end")}, {"dev": ("embalagens",)}, True, ("empresa ruim",), 30, None, 2, True, ("rio de janeiro",), ("ciee",), 0)
    row = prefilter(spark.createDataFrame([posting(**changes)], SCHEMA), c, (), NOW).first()
    assert (row.passed, row.reason) == (reason is None, reason)
    assert row.anomalies == (["published_at_future"] if (changes.get("published_at") or NOW) > dt.datetime(2027, 1, 1) else [])


def test_criteria_problems_are_all_told():
    with pytest.raises(ValueError, match="titleRequired.*maxAgeDays"):
        Criteria(max_age_days=-1)


def test_similarity_window_city_and_cap(spark):
    day = dt.timedelta(days=1)
    rows = [posting(fingerprint=f"f{i}", pos=i, first_seen_at=NOW + i * day, company=c, location_city=city) for i, (c, city) in enumerate([("Acme", "Rio"), ("Acme Ltda", "RIO"), ("Acme", "Niterói"), ("Acme SA", "rio"), ("Other", "Rio")])]
    late = posting(fingerprint="late", pos=9, first_seen_at=NOW + 30 * day, company="Acme", location_city="Rio")
    df = spark.createDataFrame([*rows, late], SCHEMA)
    found = {r.fingerprint: (r.duplicate_of, r.similarity) for r in similarity.shadow_duplicates(df).collect()}
    assert found == {"f1": ("f0", 1.0), "f3": ("f0", 1.0)}
    four = spark.createDataFrame([posting(fingerprint=f"g{i}", pos=i, first_seen_at=NOW + i * day) for i in range(4)], SCHEMA)
    assert similarity.truncated_comparisons(four, cap=1).first().truncated == 2
    assert {r.fingerprint: r.duplicate_of for r in similarity.shadow_duplicates(four, cap=1).collect()} == {"g1": "g0", "g2": "g1", "g3": "g2"}


def match(weight, status, text="r", evidence="e", verifiable=None):
    return ((text, "c", weight, verifiable), status, evidence)


@pytest.mark.parametrize(
    ("matches", "tracks", "score", "verdict"),
    [
        ([match("mandatory", s) for s in ("met", "partial", "not_met")], ["dev"], 17.5 + 20 + 45, "apply"),
        ([], ["dev"], 100.0, "review"),
        ([match("blocking", "partial"), *[match("mandatory", "met")] * 3], ["dev"], 35.0, "discard"),
        ([match("mandatory", "met")] * 3, [], 50.0, "review"),
        ([match("mandatory", "not_met", verifiable=False), *[match("desirable", "met")] * 3], ["dev"], 100.0, "apply"),
    ],
)
def test_score(spark, matches, tracks, score, verdict):
    df = spark.createDataFrame([(matches, tracks)], f"matches array<{scoring.MATCH}>, tracks array<string>")
    row = scoring.score(df, scoring.ScoringConfig()).first()
    assert (row.score, row.verdict) == (pytest.approx(score), verdict)


def test_period_gate(spark):
    gate = [match("blocking", "not_met", "a partir do 4º período"), *[match("mandatory", "met")] * 3]
    df = spark.createDataFrame([(gate, ["dev"])], f"matches array<{scoring.MATCH}>, tracks array<string>")
    row = scoring.score(df, scoring.ScoringConfig(), F.lit("2026-03-01").cast("date"), F.lit("2026-08-14").cast("date")).first()
    assert tuple(row.period_gate) == (4, "2027.2")


def test_upsert_keeps_first_sightings_and_bookkeeping(spark):
    schema = "fingerprint string, title string, first_seen_at int, last_seen_at int, notified_at int"
    old = spark.createDataFrame([("a", "old", 1, 1, 7), ("b", "b", 2, 2, None)], schema)
    batch = spark.createDataFrame([("a", "new", 5, 5, 0), ("a", "newer", 6, 6, 1), ("c", "c1", 5, 5, 2), ("c", "c2", 6, 6, 3)], "fingerprint string, title string, first_seen_at int, last_seen_at int, pos int")
    got = {r.fingerprint: tuple(r)[1:] for r in store.upsert(old, batch).collect()}
    assert got == {"a": ("newer", 1, 6, 7), "b": ("b", 2, 2, None), "c": ("c2", 5, 6, None)}
    again = store.upsert(store.upsert(old, batch), batch)
    assert {r.fingerprint: tuple(r)[1:] for r in again.collect()} == got


def test_snapshots(spark, tmp_path):
    table = store.Snapshots(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    for i in range(4):
        table.write(spark.range(i + 1), keep=2)
    assert table.read().count() == 4
    assert len(table.versions()) == 2


def test_normalisers_of_all_sources(spark):
    raw = [
        ("gupy", "1", {"name": "Dev", "careerPageName": "A", "city": "Rio", "workplaceType": "on-site", "publishedDate": "2026-08-10T12:00:00.000Z"}),
        ("gupy", "2", {"name": "Dev"}),
        ("ciee", "3", {"nomeEmpresa": "B", "tipoVaga": "ESTAGIO", "areaProfissional": "TI", "atividades": [" x ", "", "y"], "requisitos": {"semestreInicio": 2}, "bolsaAuxilio": 900.0, "local": {"cidade": " Rio "}}),
        ("indeed", "4", {"title": "T", "company": "C", "location": "Rio de Janeiro, RJ, BR", "is_remote": False}),
        ("linkedin", "5", {"title": "T", "company": "D", "location": "Brasil (Remoto)"}),
        ("solides", "6", {"title": "T", "companyName": "E", "homeOffice": True, "city": {"name": "Rio"}}),
        ("catho", "7", {"pageTitle": "Vaga de Emprego de Dev, Niterói / ", "jobPosting": {"title": "Dev", "hiringOrganization": {"name": "F"}, "jobLocationType": "TELECOMMUTE"}}),
        ("other", "8", {}),
    ]
    df = spark.createDataFrame([(s, i, json.dumps(p)) for s, i, p in raw], "source string, source_id string, payload string")
    got = {r.source: (r.company, r.title, r.location_city, r.work_mode) for r in normalize.normalize_all(df, F.lit(NOW)).collect()}
    assert got == {"gupy": ("A", "Dev", "Rio", "onsite"), "ciee": ("B", "Estágio em TI", "Rio", "unknown"), "indeed": ("C", "T", "Rio de Janeiro", "unknown"), "linkedin": ("D", "T", None, "remote"), "solides": ("E", "T", "Rio", "remote"), "catho": ("F", "Dev", "Niterói", "remote")}
    ciee = normalize.normalize_source(df, "ciee", F.lit(NOW)).first()
    assert ciee.description == "Atividades: x; y. Semestre exigido: 2 a ?. Bolsa-auxílio: R$ 900."
    assert [r.source_id for r in normalize.without_normalizer(df).collect()] == ["8"]


def test_extraction_uses_the_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(title, description):
        calls.add(1)
        return {"requirements": [{"text": title, "category": "c", "weight": "mandatory", "verifiable": True}]}

    p = spark.createDataFrame([("a", "h", "T", "D"), ("b", "h", "T", "D"), ("c", "h", "T", " ")], "fingerprint string, content_hash string, title string, description string")
    cache = spark.createDataFrame([("a", "h", "v", "m", [], None, None)], f"fingerprint string, content_hash string, prompt_version string, model string, requirements array<{scoring.REQUIREMENT}>, seniority string, experience_years int")
    cached, fresh = enrich.extract(p, cache, model, "v", "m")
    assert [r.fingerprint for r in cached.collect()] == ["a"]
    assert {r.fingerprint: (len(r.requirements), r.failure) for r in fresh.collect()} == {"b": (1, None), "c": (0, "blank")}
    assert calls.value == 1


@pytest.mark.parametrize("competencies", [1, 20, 64, 65, 200])
def test_recommended_variants_equal_counts(spark, competencies):
    """Repeated and null competencies, ties, several words of bits; and one shuffle, of a row for each id."""
    rnd = random.Random(competencies)
    variants = [(f"v{o}", o, f"c{rnd.randrange(competencies)}") for o in range(7) for _ in range(competencies // 2 + 1)] + [("v1", 1, None)]
    matched = [(rnd.choice([None, *range(60)]), rnd.choice([None, *(f"c{i}" for i in range(competencies + 5))])) for _ in range(3000)]
    has = {o: {c for _, p, c in variants if p == o and c} for o in range(7)}
    expected = {}
    for i in {i for i, _ in matched}:
        n, o = max((len(has[o] & {c for j, c in matched if j == i}), -o) for o in has)
        if n:
            expected[i] = (f"v{-o}", n)
    df = scoring.recommend_variant(spark.createDataFrame(matched, "id int, competency string"), spark.createDataFrame(variants, "variant string, ord int, competency string"))
    assert {r.id: (r.variant, r.overlap) for r in df.collect()} == expected
    assert dict(df.dtypes) == {"id": "int", "variant": "string", "overlap": "bigint"}
    shuffles = [line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(id" in line]
    assert len(shuffles) == 1, shuffles


def test_breaker_batch_equals_steps(spark):
    outcomes = ["transient"] * 5 + ["success", "transient", "success", "permanent"]
    times = [0, 1, 2, 3, 4, 5, 40_000, 40_001, 90_000]
    df = spark.createDataFrame([("k", t, o) for t, o in zip(times, outcomes, strict=True)], "key string, at long, outcome string")
    row = machines.breaker_replay(df, "key", F.col("at"), F.col("at"), F.col("outcome")).first()
    state, failures, opened, blocked = "closed", 0, 0, 0
    for t, o in zip(times, outcomes, strict=True):
        state, failures, opened, ok = machines.breaker_step(state, failures, opened, t, o)
        blocked += not ok
    assert (row.state, row.failures, row.blocked) == (state, failures, blocked) == ("closed", 0, 2)


def test_crawl_quarantine_and_requeue(spark):
    df = spark.createDataFrame([("a", i, "error") for i in range(5)] + [("b", i, x) for i, x in enumerate([*["error"] * 5, "requeue", "ok", "ingested", "error"])], "key string, i int, x string")
    got = {r.key: (r.state, r.retries) for r in machines.crawl_fold(df, "key", F.col("i"), F.col("x")).collect()}
    assert got == {"a": ("quarantined", 5), "b": ("ingested", 0)}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    rows = [{"source": "gupy", "source_id": str(i), "payload": json.dumps({"name": f"Dev {i % 2}", "careerPageName": "A"})} for i in range(4)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    table = store.Snapshots(spark, f"file://{tmp_path}/table")
    for _ in range(2):
        ingest.ingest(ingest.read_raw(spark, f"file://{tmp_path}/in"), table, f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", lambda: F.lit(NOW)).awaitTermination()
    assert table.read().count() == 2
    assert len(table.versions()) == 1


def test_alerts(spark):
    df = spark.createDataFrame([("r", 23, 0, {"success": 9, "timeout": 4, "invalid": 10})], "run_id string, attempts long, blocked long, outcomes map<string,long>")
    assert runs.failure_rate_alert(df, 0.5).first().text == "14/23 operations failed (61%)"
    assert spark.range(1).select(runs.count_summary(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(0)))).first()[0] == "b=2"


def test_message_chunks():
    assert delivery.split_message("a\n\n\nb", 100) == ["a\n\n\nb"]
    assert delivery.split_message("aaaa\n\n\nbbbb", 6) == ["aaaa", "bbbb"]
    assert delivery.split_message("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert all(len(c) <= 7 for c in delivery.split_message("one\n\ntwo\n\nthree\n\n\nfour five six", 7))


def test_weekly_volume(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 8, 10),), (dt.datetime(2026, 8, 14, 12),)], "ts timestamp")
    assert [tuple(r) for r in market.weekly_volume(df, F.col("ts")).collect()] == [("2026-08-10", 2)]


def _rows(rows, columns):
    import pandas as pd

    def plain(v):
        if not isinstance(v, (list, str)) and pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(str(tuple(map(plain, r))) for r in rows[columns].astype(object).itertuples(index=False, name=None))


def test_html_to_text_keeps_every_page(spark, tmp_path):
    pages = {1: ("<p>it&#39;s &#x2014; &amp;#39;</p>", "it's — &#39;"), 2: ("a &lt; b", "a < b"), 3: ("<b>&#</b>", "&#"), 4: (None, None)}
    spark.createDataFrame([(i, h) for i, (h, _) in pages.items()], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.text_sha256, r.n_chars) for r in catalog.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.sha256((t or "").encode()).hexdigest(), t and len(t)) for i, (_, t) in pages.items()}


def test_evidence_and_suppliers_are_read_whole(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (4, "a"), (9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.queries()["evidence_join"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.competency) for r in got) == [(1, 4), (2, 2), (4, 4)]
    spark.createDataFrame([(n,) for n in range(4)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted(r.n_nationkey for r in catalog.queries()["variant_except"](spark, str(tmp_path)).collect()) == [2, 3]


def test_url_allow_list_judges_every_page(spark, tmp_path):
    urls = ["https://ththon.example.com/a", "https://BLOG.tionble.example.com:443/", "https://ththon.example.com?x", "https://other.example.com/a", "https://xththon.example.com/", "http://ththon.example.com/", "https://u@ththon.example.com/", "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.allowed for r in catalog.queries()["url_allow_list"](spark, str(tmp_path)).collect()}
    assert got == {i: i < 3 for i in range(len(urls))}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, name):
    import duckdb

    got = catalog.queries()[name](spark, DATA).toPandas()
    if (sql := catalog.oracle_sql().get(name)) is None:
        assert len(got) > 0
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    expected = c.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got, sorted(got.columns)) == _rows(expected, sorted(got.columns))
