"""Literal results of the text, identity and date functions."""

import datetime as dt

import pyspark.sql.functions as F
import pytest

from loomstone.functions import dates, identity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "deleted", "spaced"), [("Node.js, TypeScript!", "nodejs typescript", "node js typescript"), ("  Estágio, Back-End!!  ", "estagio backend", "estagio back end"), ("", "", ""), ("ÇÃO Ünïcode", "cao unicode", "cao unicode")])
def test_normalisers(spark, given, deleted, spaced):
    assert one(spark, text.normalize(F.lit(given))) == deleted == text.plain_normalize(given)
    assert one(spark, text.normalize_title(F.lit(given))) == spaced == text.plain_normalize(given, " ")


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("Estágio em Back-end", "Estagiário Backend (Rio de Janeiro)", 0.40),
        ("Estágio", "Estagiário", 0.0),
        ("Analista de dados", "Dados, analista", 1.0),
        ("", "", 0.0),
    ],
)
def test_title_similarity(spark, a, b, expected):
    assert one(spark, text.title_similarity(F.lit(a), F.lit(b))) == pytest.approx(expected, abs=0.005)
    assert one(spark, text.title_similarity(F.lit(b), F.lit(a))) == pytest.approx(expected, abs=0.005)


def test_numbered_bigrams_count_repetitions(spark):
    assert one(spark, text.dice(text.numbered_bigrams(F.lit("aaaa")), text.numbered_bigrams(F.lit("aa")))) == pytest.approx(0.5)


def test_whole_words(spark):
    assert one(spark, text.title_matches_any(F.lit("Analista III"), ["iii"]))
    assert not one(spark, text.title_matches_any(F.lit("Nível Superior"), ["iv", ""]))
    assert not one(spark, text.keyword_matches(F.lit("Social media"), "soc"))
    assert one(spark, text.keyword_matches(F.lit("Backend Developer"), "back-end"))
    assert one(spark, text.keyword_matches(F.lit("Back-End Developer"), "back-end"))
    assert not one(spark, text.keyword_matches(F.lit("Node.js"), "JS"))
    assert one(spark, text.keyword_matches(F.lit("Noções de JS"), "JS"))


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("<p>A</p><br><br><br><p>B</p>", "A\n\nB"),
        ("Caf&#233; com leite &#x2014; grátis", "Café com leite — grátis"),
        ("Remuneração < R$ 2000 > acordo", "Remuneração < R$ 2000 > acordo"),
        ("&amp;lt; &#xD800; &#99999999; &copy;", "&lt; � � &copy;"),
        ("<ul><li>a</li><li>b</li></ul><script>x()</script>", "- a\n\n- b"),
    ],
)
def test_html_to_text(spark, given, expected):
    assert one(spark, text.html_to_text(F.lit(given))) == expected


def test_small_functions(spark):
    assert one(spark, text.company_group(F.lit("Acme S.A. LTDA"))) == "acme"
    assert one(spark, text.company_group(F.lit("Ltda"))) == "ltda"
    assert one(spark, text.minimum_period(F.lit("Cursando a partir do 4º período"))) == 4
    assert one(spark, text.minimum_period(F.lit("9 periodos em diante"))) is None
    assert one(spark, text.strip_evidence_tag(F.lit(" - [a b] Built it"))) == "Built it"
    assert one(spark, text.model_output(F.lit('```json\n{"a": [1]}\n```'))) == '{"a": [1]}'
    assert one(spark, text.log_label(F.lit("a\tb" + "x" * 80))) == "a b" + "x" * 57 + "…"
    assert one(spark, text.truncate_text(F.lit("one two\n\nthree four"), 10)) == "one two"
    assert one(spark, text.truncate_text(F.lit("one two three"), 9)) == "one two"
    assert one(spark, text.percent(F.lit(0.606))) == "61%"
    assert one(spark, text.includes_term(text.normalized_words(F.lit("C++ and Node.js")), F.lit("c++")))


def test_identity(spark):
    a = one(spark, identity.fingerprint(F.lit("Acme"), F.lit("Estágio!"), F.lit(None).cast("string")))
    assert a == one(spark, identity.fingerprint(F.lit("ACME"), F.lit("estagio"), F.lit("")))
    assert len(a) == 64
    assert identity.config_hash({"a": 1}) == identity.config_hash({"a": 1}) != identity.config_hash({"a": 2})


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.week_start(F.lit("2026-08-16 10:00:00").cast("timestamp"))) == "2026-08-10"
    assert one(spark, dates.academic_period(d("2026-03-01"), d("2026-08-14")))["period"] == 2
    assert one(spark, dates.academic_period(d("2026-03-01"), d("2027-03-01")))["period"] == 3
    assert one(spark, dates.academic_period(d("2026-03-01"), d("2025-12-31")))["status"] == "not_started"
    assert one(spark, dates.period_label(d("2026-03-01"), F.lit(2))) == "2026.2"
    now, last = F.lit(dt.datetime(2026, 8, 16)), F.lit(dt.datetime(2026, 8, 1))
    assert one(spark, dates.recency_window_days(now, last, 2, 30)) == 15
    assert one(spark, dates.recency_window_days(now, F.lit(None).cast("timestamp"), 2, 30)) == 30
    assert dates.cron_daily("07:05") == "5 7 * * *"
