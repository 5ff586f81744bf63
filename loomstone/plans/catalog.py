"""The engine's registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import dates, identity, text
from ..operators import calibration, delivery, market, normalize, prefilter, runs, scoring, similarity, store
from ..sources import payloads
from ..streaming import machines
from .views import CRITERIA, KEYWORDS, NOW, POSTINGS_SQL, PROFILE_SKILLS, SQL_SPACES, TAXONOMY, postings, sql_keywords, sql_normalize, sql_terms, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """name -> callable(spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL."""
    return dict(_ORACLES)


# --- rule filter -----------------------------------------------------------------------------------------------------

_T = {t: f"(NOT {sql_keywords(CRITERIA.track_exclusions.get(t, ()))} AND {sql_keywords(k)})" for t, k in CRITERIA.tracks.items()}
_TRACKS = "list_filter([" + ", ".join(f"CASE WHEN {s} THEN '{t}' END" for t, s in _T.items()) + "], lambda x: x IS NOT NULL)"
_NOW = f"TIMESTAMP '{NOW}'"
_FUTURE = f"coalesce(epoch_ms(published_at) - epoch_ms({_NOW}) > 2 * 86400000, false)"
FILTERED_SQL = f"""WITH {POSTINGS_SQL},
t AS (SELECT *, {_TRACKS} AS tracks, {_FUTURE} AS future, {" + ".join(f"contains(tc, '{text.plain_normalize(k)}')::INT" for k in KEYWORDS)} AS adherence FROM p),
f AS (SELECT *, CASE WHEN {sql_terms(CRITERIA.title_blocklist)} THEN 'title_blocked' WHEN NOT {sql_terms(CRITERIA.title_required)} THEN 'title_missing_required_term'
  WHEN len(tracks) = 0 THEN 'track_unknown' WHEN {sql_normalize("company")} IN ('src7', 'src13') THEN 'company_blocked' WHEN application_deadline < {_NOW} THEN 'expired'
  WHEN (published_at IS NULL AND first_seen_at <= TIMESTAMP '2024-01-01 02:00:00') OR epoch_ms({_NOW}) - epoch_ms(CASE WHEN future THEN first_seen_at ELSE
    coalesce(published_at, first_seen_at) END) > 30 * 86400000::BIGINT THEN 'too_old'
  WHEN NOT (CASE WHEN work_mode = 'remote' THEN true WHEN location_kind = 'unknown' THEN source NOT IN ('src3', 'src4') ELSE
    coalesce({sql_normalize("location_city")} IN ('en', 'fr', 'es'), false) END) THEN 'location_not_allowed'
  WHEN adherence < 1 THEN 'insufficient_keyword_adherence' END AS reason FROM t)"""


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.prefilter(postings(spark, sf_dir), CRITERIA, KEYWORDS, NOW)


@_query(f"{FILTERED_SQL}, c AS (SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM f GROUP BY 1) SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def prefilter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter.funnel(_filtered(spark, sf_dir))


@_query(f"{FILTERED_SQL} SELECT source_id, reason, reason IS NULL AS passed, array_to_string(tracks, ',') AS tracks, CASE WHEN future THEN 'published_at_future' ELSE '' END AS anomalies FROM f")
def prefilter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filtered(spark, sf_dir)
    return f.select("source_id", "reason", "passed", F.array_join("tracks", ",").alias("tracks"), F.array_join("anomalies", ",").alias("anomalies"))


@_query(f"{FILTERED_SQL} SELECT source AS term, count(*) AS returned, count(*) FILTER (reason IS NULL) AS passes, count(*) FILTER (len(tracks) > 0) AS on_track FROM f GROUP BY 1")
def probe_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.probe_table(_filtered(spark, sf_dir).withColumn("term", F.col("source")), "term", F.col("passed"), F.size("tracks") > 0)


# --- text and identity -----------------------------------------------------------------------------------------------


@_query(f"WITH {POSTINGS_SQL} SELECT source_id, fingerprint, sha256(title || chr(0) || coalesce(description, '')) AS content_hash FROM p")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("source_id", "fingerprint", identity.content_hash(F.col("title"), F.col("description")).alias("content_hash"))


_SIGNIFICANT = f"list_filter(string_split(ts, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)}))"


@_query(f"WITH {POSTINGS_SQL} SELECT source_id, tc AS normalized, ts AS title_form, array_to_string({_SIGNIFICANT}, '+') AS tokens FROM p")
def normalized_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("source_id", text.normalize(F.col("title")).alias("normalized"), text.normalize_title(F.col("title")).alias("title_form"), F.array_join(text.significant_tokens(F.col("title")), "+").alias("tokens"))


@_query(
    f"WITH s AS (SELECT s_suppkey, s_name || ['', ' Ltda.', ' S.A. ME', ' EIRELI'][s_suppkey % 4 + 1] AS company FROM supplier), n AS (SELECT *, "
    f"{sql_normalize('company')} AS n FROM s) SELECT s_suppkey, regexp_replace(n, '^(.+?)( (sa|ltda|me|eireli|epp))+$', '\\1') AS grp FROM n"
)
def company_suffix_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, ("", " Ltda.", " S.A. ME", " EIRELI"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").withColumn("company", F.concat("s_name", form))
    return s.select("s_suppkey", text.company_group(F.col("company")).alias("grp"))


def _sql_text(value: str) -> str:
    """A DuckDB string with its line ends as chr(10)."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_HTML = "html"
for _p, _r in text.MARKUP:
    for _tag in ("script", "style") if "\\1" in _p else ("",):
        _HTML = f"regexp_replace({_HTML}, '{_p.replace('(script|style)', _tag).replace(chr(92) + '1', _tag)}', {_sql_text(_r)}, 'gi')"
_ENTITY = "&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);"
_CODE = "TRY_CAST(CASE WHEN m LIKE '&#x%' THEN '0x' || m[4:-2] ELSE m[3:-2] END AS BIGINT)"
_CHAR = f"CASE WHEN m NOT LIKE '&#%' THEN CASE m {' '.join(f'WHEN {_sql_text(f"&{n};")} THEN {_sql_text(c)}' for n, c in text.ENTITIES.items())} ELSE m END WHEN {_CODE} BETWEEN 0 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}::INTEGER) ELSE chr(65533) END"
_TIDIED = "list_aggregate(list_transform(range(len(g)), lambda i: g[i + 1] || coalesce(c[i + 1], '')), 'string_agg', '')"
for _p, _r in text.TIDY:
    _TIDIED = f"regexp_replace({_TIDIED}, '{_p}', {_sql_text(_r)}, 'g')"
_TIDIED = f"regexp_replace({_TIDIED}, '^[{SQL_SPACES}]+|[{SQL_SPACES}]+$', '', 'g')"


@_query(
    f"WITH s AS (SELECT page_id, html, {_HTML} AS h FROM pages), m AS (SELECT *, string_split_regex(h, '{_ENTITY}') AS g, list_transform(regexp_extract_all(h, '{_ENTITY}'), lambda m: {_CHAR}) AS c FROM s), "
    f"t AS (SELECT page_id, html, {_TIDIED} AS t FROM m) SELECT page_id, sha256(coalesce(t, '')) AS text_sha256, length(t) AS n_chars, regexp_matches(html, '<[a-zA-Z/][^>]*>') AS had_markup FROM t"
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("t", text.html_to_text(F.col("html")))
    return p.select("page_id", F.sha2(F.coalesce("t", F.lit("")), 256).alias("text_sha256"), F.length("t").alias("n_chars"), text.had_markup(F.col("html")).alias("had_markup"))


@_query(
    "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, "
    "len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1)) AS n_links, array_to_string(regexp_extract_all(html, "
    "'(?i)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1), ' ') AS links FROM pages"
)
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", payloads.page_title(F.col("html")).alias("title"), F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


_ALLOWED = ("ththon.example.com", "blog.tionble.example.com")


@_query(
    f"SELECT page_id, coalesce(regexp_matches(url, "
    f"'(?i)^https://([^/?#]*@)?({'|'.join(h.replace('.', chr(92) + '.') for h in _ALLOWED)})(:[0-9]*)?([/?#]|$)') AND NOT regexp_matches(url, "
    f"'^https://[^/?#]*@'), false) AS allowed FROM pages"
)
def url_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", payloads.url_allowed(F.col("url"), list(_ALLOWED)).alias("allowed"))


#: Words and what stands between them, for RE2; characters with their marks.
_WORDS_SQL = (
    r"\r\n|[\r\n\x0b\f\x{85}\x{2028}\x{2029}]|(?:(?:\p{L}[\p{M}\p{Cf}]*(?:(?:[.''\x{b7}\x{2018}\x{2019}\x{2024}\x{2027}][\p{M}\p{Cf}]*)?\p{L}[\p{M}\p{Cf}]*)*)"
    r"|(?:\p{Nd}[\p{M}\p{Cf}]*(?:(?:[.,;''\x{2018}\x{2019}\x{2024}\x{2044}][\p{M}\p{Cf}]*)?\p{Nd}[\p{M}\p{Cf}]*)*)|\p{Pc}[\p{M}\p{Cf}]*)+|[ \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{205f}\x{3000}]+[\p{M}\p{Cf}]*|(?s:.)[\p{M}\p{Cf}]*"
)
_UNITS_SQL = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


@_query(
    rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, {_UNITS_SQL.format("text")} <= 400 AS fits, string_split_regex(text, '\n{{2,}}') AS parts FROM documents),
h AS (SELECT r, max(k) AS k FROM (SELECT r, unnest(range(1, least(len(parts), 400) + 1)) AS k, parts FROM t WHERE NOT fits) WHERE
    {_UNITS_SQL.format("array_to_string(parts[1:k], chr(10) || chr(10))")} <= 400 GROUP BY 1),
p AS (SELECT r, array_to_string(parts[1:k], chr(10) || chr(10)) AS joined FROM h JOIN t USING (r)),
g AS (SELECT r, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM (SELECT r, regexp_extract_all(substr(text, 1, 1000), '{_WORDS_SQL}') AS segments FROM t WHERE NOT fits)),
w AS (SELECT r, string_agg(s, '' ORDER BY i) AS words FROM (SELECT *, sum({_UNITS_SQL.format("s")}) OVER (PARTITION BY r ORDER BY i) AS n FROM g) WHERE n <= 400 GROUP BY 1),
c AS (SELECT r, unnest(clusters) AS s, generate_subscripts(clusters, 1) AS i FROM (SELECT r, regexp_extract_all(substr(text, 1, 1000),
    '\r\n|(?s:.)[\p{{M}}\x{{200d}}]*') AS clusters FROM t WHERE NOT fits)),
x AS (SELECT r, string_agg(s, '' ORDER BY i) AS clusters FROM (SELECT *, sum({_UNITS_SQL.format("s")}) OVER (PARTITION BY r ORDER BY i) AS n FROM c) WHERE n <= 400 GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL OR fits THEN text WHEN coalesce(joined, '') <> '' THEN joined WHEN words IS NOT NULL THEN regexp_replace(words,
    '[{SQL_SPACES}]+$', '') ELSE coalesce(clusters, '') END AS short
FROM t LEFT JOIN p USING (r) LEFT JOIN w USING (r) LEFT JOIN x USING (r)"""
)
def truncate_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text"), 400).alias("short"))


@_query(
    "WITH r AS (SELECT o_orderkey, ['Cursando a partir do ' || (o_orderkey % 12) || 'º período', (o_orderkey % 12) || ' periodos em diante', 'semestre "
    "exigido: ' || (o_orderkey % 12), (o_orderkey % 12) || 'º período'][(o_orderkey // 3) % 4 + 1] AS t FROM orders) SELECT o_orderkey, CASE WHEN t LIKE "
    "'_º período' OR t LIKE '__º período' THEN NULL WHEN o_orderkey % 12 BETWEEN 1 AND 8 THEN (o_orderkey % 12)::INTEGER END AS period FROM r"
)
def minimum_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 12).cast("string")
    forms = F.array(F.concat(F.lit("Cursando a partir do "), n, F.lit("º período")), F.concat(n, F.lit(" periodos em diante")), F.concat(F.lit("semestre exigido: "), n), F.concat(n, F.lit("º período")))
    t = F.element_at(forms, (F.floor(k / 3) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.minimum_period(t).alias("period"))


@_query(
    "SELECT o_orderkey, CASE WHEN i < 1 THEN 'not_started' WHEN i > 8 THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN i BETWEEN 1 AND 8 THEN i "
    "END AS period, ((1995 * 2 + 1 + 2) // 2)::VARCHAR || '.' || ((1995 * 2 + 1 + 2) % 2 + 1)::VARCHAR AS third FROM (SELECT o_orderkey, (year(o_orderdate) "
    "* 2 + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END - (1995 * 2 + 1) + 1)::INTEGER AS i FROM orders)"
)
def academic_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("1995-08-01").cast("date")
    p = dates.academic_period(start, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p["status"].alias("status"), p["period"].alias("period"), dates.period_label(start, F.lit(3)).alias("third"))


# --- similarity ------------------------------------------------------------------------------------------------------

_GRAMS = f"CASE WHEN length(j) >= 2 THEN list_transform(range(1, length(j)), lambda i: substr(j, i, 2)) WHEN length(j) = 1 THEN [j] ELSE [] END"
_PAIRS = f"""WITH {POSTINGS_SQL},
g0 AS (SELECT *, array_to_string(list_sort({_SIGNIFICANT}), ' ') AS j, regexp_replace({sql_normalize("company")}, '^(.+?)( (sa|ltda|me|eireli|epp))+$', '\\1')
    AS grp, CASE WHEN location_kind = 'known' THEN {sql_normalize("location_city")} END AS city FROM p),
g1 AS (SELECT *, {_GRAMS} AS b, row_number() OVER (PARTITION BY grp ORDER BY first_seen_at, pos) AS rank FROM g0),
g2 AS (SELECT pos, unnest(b) AS x FROM g1), g3 AS (SELECT pos, list(x || '#' || k) AS grams FROM (SELECT pos, x, row_number() OVER (PARTITION BY pos, x) - 1 AS k FROM g2) GROUP BY pos),
g AS (SELECT g1.*, coalesce(grams, []) AS grams FROM g1 LEFT JOIN g3 USING (pos)),
s AS (SELECT a.fingerprint, e.fingerprint AS duplicate_of, e.rank AS e_rank, CASE WHEN len(a.grams) + len(e.grams) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE *
    len(list_intersect(a.grams, e.grams)) / (len(a.grams) + len(e.grams)) END AS similarity
  FROM g a JOIN g e ON a.grp = e.grp AND a.city IS NOT DISTINCT FROM e.city AND e.rank < a.rank AND a.rank - e.rank <= 500 AND epoch_ms(a.first_seen_at) -
    epoch_ms(e.first_seen_at) <= 14 * 86400000::BIGINT)"""


@_query(f"{_PAIRS} SELECT fingerprint, arg_min(duplicate_of, e_rank) AS duplicate_of, round(arg_min(similarity, e_rank), 9) AS similarity FROM s WHERE similarity >= 0.35 GROUP BY fingerprint")
def shadow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.shadow_duplicates(postings(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@_query(f"{_PAIRS} SELECT floor(similarity * 20) / 20 AS band, count(*) AS n FROM s WHERE similarity >= 0.5 GROUP BY 1")
def title_similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similar_pairs(postings(spark, sf_dir), threshold=0.5)
    return pairs.groupBy((F.floor(F.col("similarity") * 20) / 20).alias("band")).agg(F.count("*").alias("n"))


@_query(
    f"WITH {POSTINGS_SQL}, g AS (SELECT regexp_replace({sql_normalize('company')}, '^(.+?)( (sa|ltda|me|eireli|epp))+$', '\\1') AS grp, "
    f"epoch_ms(first_seen_at) AS ms, row_number() OVER (PARTITION BY grp ORDER BY first_seen_at, pos) AS rank FROM p) SELECT a.grp, count(*) FILTER (a.ms - "
    f"e.ms <= 14 * 86400000::BIGINT) AS truncated, count(*) AS n FROM g a LEFT JOIN g e ON a.grp = e.grp AND e.rank = a.rank - 11 GROUP BY 1"
)
def dedup_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.truncated_comparisons(postings(spark, sf_dir), cap=10)


# --- market ----------------------------------------------------------------------------------------------------------

_SKILLS = "list_filter([" + ", ".join(f"CASE WHEN {sql_keywords([n, *a])} THEN '{n}' END" for n, a in TAXONOMY.items()) + "], lambda x: x IS NOT NULL)"
_MENTIONS = (
    f"WITH {POSTINGS_SQL}, m AS (SELECT fingerprint, pos, unnest({_SKILLS}) AS skill FROM p), u AS (SELECT DISTINCT fingerprint, skill FROM m), h AS (SELECT "
    f"DISTINCT fingerprint FROM p WHERE pos % 3 = 0), t AS (SELECT count(*) AS n FROM p), k AS (SELECT count(*) AS n FROM p WHERE pos % 3 = 0)"
)


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.skill_mentions(postings(spark, sf_dir), F.col("title"), TAXONOMY)


@_query(f"{_MENTIONS} SELECT skill, count(*) AS n, round(count(*) / (SELECT n FROM t), 9) AS share FROM u GROUP BY 1")
def skill_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.skill_frequency(_mentions(spark, sf_dir), postings(spark, sf_dir).select(F.count("*")).scalar()).withColumn("share", F.round("share", 9))


@_query(f"{_MENTIONS} SELECT skill, count(*) AS n, round(count(*) / (SELECT n FROM k), 9) AS share FROM u SEMI JOIN h USING (fingerprint) WHERE skill NOT IN ('The', 'In') GROUP BY 1")
def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = postings(spark, sf_dir).filter(F.col("pos") % 3 == 0)
    return market.gap_analysis(_mentions(spark, sf_dir), high, PROFILE_SKILLS).withColumn("share", F.round("share", 9))


@_query(f"{_MENTIONS} SELECT skill, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, skill LIMIT 3")
def market_demand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.top(market.skill_frequency(_mentions(spark, sf_dir), 1), 3).select("skill", "n")


@_query(
    f"WITH {POSTINGS_SQL}, l AS (SELECT 'company' AS kind, company AS label, pos FROM p UNION ALL SELECT 'region', coalesce(location_city, 'unknown'), pos "
    f"FROM p UNION ALL SELECT 'mode', work_mode, pos FROM p UNION ALL SELECT 'level', coalesce(seniority, 'unknown'), pos FROM p) SELECT kind, label, "
    f"count(*) AS n, min(pos) AS first_pos FROM l GROUP BY 1, 2"
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    out = None
    for kind, c in (("company", "company"), ("region", "location_city"), ("mode", "work_mode"), ("level", "seniority")):
        part = market.label_counts(p, F.col(c)).select(F.lit(kind).alias("kind"), "label", "n", "first_pos")
        out = part if out is None else out.unionByName(part)
    return out


@_query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY 1")
def weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.weekly_volume(table(spark, sf_dir, "events"), F.col("ts"))


# --- scoring ---------------------------------------------------------------------------------------------------------

_CONFIG = scoring.ScoringConfig()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as requirements' matches: the flag gives the status, the line's number the weight."""
    li = table(spark, sf_dir, "lineitem")
    weight = F.element_at(F.array(*map(F.lit, ("blocking", "mandatory", "desirable"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "A", "met").when(F.col("l_returnflag") == "N", "partial").otherwise("not_met")
    requirement = F.struct(F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("text"), F.lit("c").alias("category"), weight.alias("weight"), (F.col("l_quantity") > 5).alias("verifiable"))
    match = F.struct(F.col("l_linenumber").alias("n"), scoring.make_match(requirement, status, F.when(F.col("l_quantity") != 7, F.col("l_shipmode") if "l_shipmode" in li.columns else F.lit("quote"))).alias("m"))
    grouped = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(match)), lambda x: x["m"]).alias("matches"))
    tracks = F.when(F.col("l_orderkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("l_orderkey") % 4 == 1, F.array(F.lit("automation"))).otherwise(F.array(F.lit("automation"), F.lit("dev")))
    return scoring.score(grouped.withColumn("tracks", tracks), _CONFIG)


_SCORED = """WITH m AS (SELECT l_orderkey, l_linenumber, ['blocking', 'mandatory', 'desirable'][l_linenumber % 3 + 1] AS w, CASE WHEN l_quantity = 7 THEN
    'not_met' WHEN l_returnflag = 'A' THEN 'met' WHEN l_returnflag = 'N' THEN 'partial' ELSE 'not_met' END AS s, l_quantity > 5 AS v FROM lineitem),
x AS (SELECT *, CASE s WHEN 'met' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c FROM m),
g AS (SELECT l_orderkey, coalesce(avg(c) FILTER (v AND w = 'mandatory'), 1) AS mc, coalesce(avg(c) FILTER (v AND w = 'desirable'), 1) AS dc, count(*) FILTER (v)
    AS nv, count(*) FILTER (v AND w = 'blocking' AND s <> 'met') AS nb, count(*) FILTER (v AND w IN ('blocking', 'mandatory') AND s <> 'met') AS ng,
  CASE WHEN l_orderkey % 4 = 0 THEN 0.4 WHEN l_orderkey % 4 = 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS ta FROM x GROUP BY l_orderkey),
r AS (SELECT *, 35 * mc + 20 * dc + 45 * ta AS raw FROM g),
c AS (SELECT *, CASE WHEN nb > 0 THEN least(raw, 35.0::DOUBLE) ELSE raw END AS s0 FROM r),
s AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN l_orderkey % 4 = 0 THEN least(s0, 50.0::DOUBLE) ELSE s0 END)) AS score, nv < 3 AS low FROM c),
o AS (SELECT *, CASE WHEN low AND score >= 70 THEN 'review' WHEN score >= 70 THEN 'apply' WHEN score >= 45 THEN 'review' ELSE 'discard' END AS verdict FROM s)"""


@_query(
    f"{_SCORED} SELECT l_orderkey, round(mc, 6) AS mandatory, round(dc, 6) AS desirable, ta AS alignment, round(score, 6) AS score, low AS low_confidence, "
    f"verdict, nb AS n_blocking, ng AS n_gaps FROM o"
)
def score_stage_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("l_orderkey", F.round("mandatory_coverage", 6).alias("mandatory"), F.round("desirable_coverage", 6).alias("desirable"), "alignment", F.round("score", 6).alias("score"), "low_confidence", "verdict", F.size("blocking_failures").cast("long").alias("n_blocking"), F.size("critical_gaps").cast("long").alias("n_gaps"))


@_query(f"{_SCORED} SELECT verdict, count(*) AS n, count(*) FILTER (low) AS low, count(*) FILTER (nb > 0) AS blocked FROM o GROUP BY 1")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("low_confidence").alias("low"), F.count_if(F.size("blocking_failures") > 0).alias("blocked"))


@_query(f"{_SCORED} SELECT l_orderkey, round(score, 6) AS score FROM o WHERE verdict <> 'discard' ORDER BY score DESC, l_orderkey LIMIT 20")
def score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).filter("verdict <> 'discard'").select("l_orderkey", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "l_orderkey").limit(20)


@_query(f"{_SCORED} SELECT CASE WHEN verdict = 'apply' THEN 'recommended' WHEN l_orderkey % 10 = 3 THEN 'opening_later' ELSE 'review' END AS section, count(*) AS n FROM o WHERE verdict <> 'discard' OR l_orderkey % 10 = 3 GROUP BY 1".replace("CASE WHEN verdict = 'apply' THEN 'recommended' WHEN l_orderkey % 10 = 3 THEN 'opening_later' ELSE 'review' END", "CASE WHEN l_orderkey % 10 = 3 THEN 'opening_later' WHEN verdict = 'review' THEN 'review' ELSE 'recommended' END"))
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.when(F.col("l_orderkey") % 10 == 3, F.lit(4))
    s = _scored(spark, sf_dir).withColumn("section", delivery.section_of(F.col("verdict"), gate)).withColumn("pos", F.col("l_orderkey"))
    return delivery.sections(s.withColumn("entry", F.col("l_orderkey").cast("string"))).select("section", "n")


@_query(
    "SELECT l_orderkey, array_to_string(list_distinct_ordered, ',') AS highlights FROM (SELECT l_orderkey, list(l_returnflag || (l_linenumber % 2) ORDER BY "
    "f) AS list_distinct_ordered FROM (SELECT l_orderkey, l_returnflag, l_linenumber % 2 AS l_linenumber, min(l_linenumber) AS f FROM lineitem WHERE "
    "l_linenumber % 3 <> 2 AND l_returnflag = 'A' GROUP BY ALL) GROUP BY 1)"
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    weight = F.element_at(F.array(*map(F.lit, ("blocking", "mandatory", "desirable"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    requirement = F.struct(F.lit("r").alias("text"), F.lit("c").alias("category"), weight.alias("weight"), F.lit(True).alias("verifiable"))
    evidence = F.concat(F.lit("- [tag] "), "l_returnflag", (F.col("l_linenumber") % 2).cast("string"))
    match = F.struct(F.col("l_linenumber").alias("n"), scoring.make_match(requirement, F.when(F.col("l_returnflag") == "A", "met").otherwise("partial"), evidence).alias("m"))
    grouped = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(match)), lambda x: x["m"]).alias("m"))
    return grouped.select("l_orderkey", scoring.highlights(F.col("m")).alias("h")).filter(F.size("h") > 0).select("l_orderkey", F.array_join("h", ",").alias("highlights"))


@_query(
    "WITH m AS (SELECT DISTINCT l_orderkey AS id, (l_partkey % 20)::INT AS competency FROM lineitem), v AS (SELECT i // 5 AS ord, 'v' || (i // 5) AS "
    "variant, (i * 7 % 20)::INT AS competency FROM range(20) t(i)), o AS (SELECT id, variant, ord, count(*) AS overlap FROM m JOIN v USING (competency) "
    "GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, ord) AS k FROM o) SELECT id, variant, overlap FROM r WHERE k "
    "= 1"
)
def recommend_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 20).cast("int").alias("competency"))
    i = F.col("id")
    variants = spark.range(20).select(F.floor(i / 5).alias("ord"), F.concat(F.lit("v"), F.floor(i / 5).cast("string")).alias("variant"), (i * 7 % 20).cast("int").alias("competency"))
    return scoring.recommend_variant(matched, variants)


@_query(
    "WITH e AS (SELECT text AS q, arg_max(item_id % 7, item_id) AS competency FROM benchmark GROUP BY 1), m AS (SELECT item_id AS id, text AS q FROM "
    "benchmark) SELECT DISTINCT id, competency FROM m JOIN e USING (q)"
)
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    evidence = b.select(F.concat(F.lit("[e] "), "text").alias("quote"), (F.col("item_id") % 7).alias("competency"), F.col("item_id").alias("ord"))
    found = b.select(F.col("item_id").alias("id"), F.lit("met").alias("status"), F.concat(F.lit(" - [x y] "), "text").alias("evidence"))
    return scoring.matched_competencies(found, evidence)


# --- calibration -----------------------------------------------------------------------------------------------------

_LABELLED = "WITH j AS (SELECT d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


@_query(f"{_LABELLED} SELECT source, round(CASE WHEN count(*) >= 2 AND stddev_pop(n_chars) > 0 AND stddev_pop(quality) > 0 THEN corr(n_chars::DOUBLE, quality::DOUBLE) END, 6) AS r FROM j GROUP BY 1")
def calibration_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = calibration.joined(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return labelled.groupBy("source").agg(F.round(calibration.pearson("n_chars", "quality"), 6).alias("r"))


_VERDICTS = ("apply", "review", "discard")


@_query(
    "WITH j AS (SELECT CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'apply' WHEN l.quality = 1 THEN 'review' ELSE 'discard' END AS e, CASE WHEN d.n_chars > "
    "2000 THEN 'apply' WHEN d.n_chars > 500 THEN 'review' WHEN d.n_chars > 100 THEN 'discard' END AS a FROM documents d JOIN labels l USING (doc_id)), s AS "
    "(SELECT v, e = v AS x, a = v AS y FROM j, unnest(['apply', 'review', 'discard']) t(v) WHERE a IS NOT NULL) SELECT v AS verdict, count(*) FILTER (x) AS "
    "support, round(count(*) FILTER (x AND y) / nullif(count(*) FILTER (y), 0), 9) AS precision, round(count(*) FILTER (x AND y) / nullif(count(*) FILTER "
    "(x), 0), 9) AS recall FROM s GROUP BY 1"
)
def calibration_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expected = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "apply").when(F.col("quality") == 1, "review").otherwise("discard")
    n = F.col("n_chars")
    actual = F.when(n > 2000, "apply").when(n > 500, "review").when(n > 100, "discard")
    m = calibration.verdict_metrics(j.select(expected.alias("e"), actual.alias("a")), "e", "a", _VERDICTS)
    return m.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@_query("SELECT coalesce(count(*) FILTER (l.doc_id IS NULL) / nullif(count(*), 0), 0.0)::DOUBLE AS failure_rate FROM documents d LEFT JOIN labels l USING (doc_id)")
def parse_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return calibration.failure_rate(j, "quality")


@_query(
    "SELECT doc_id AS fingerprint, n_chars AS last_seen_at FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND "
    "e.doc_id % 50 = 0) ORDER BY n_chars DESC, doc_id LIMIT greatest(0, 60 - (SELECT count(*) FROM documents WHERE doc_id % 50 = 0))::BIGINT"
)
def worksheet_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fingerprint"), F.col("n_chars").alias("last_seen_at"))
    return calibration.worksheet_batch(d, d.filter("fingerprint % 50 = 0"), 60)


# --- state -----------------------------------------------------------------------------------------------------------


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("fingerprint"), F.col("event_id").alias("pos"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), "event_type", "value")


@_query(
    "WITH b AS (SELECT user_id AS fingerprint, event_id AS pos, ts, event_type, value FROM events), o AS (SELECT fingerprint, arg_min(ts, pos) AS f, "
    "arg_max(ts, pos) AS l, arg_max(event_type, pos) AS t, arg_max(value, pos) AS v FROM b WHERE pos % 2 = 0 GROUP BY 1), n AS (SELECT fingerprint, "
    "arg_min(ts, pos) AS f, arg_max(ts, pos) AS l, arg_max(event_type, pos) AS t, arg_max(value, pos) AS v FROM b WHERE pos % 2 = 1 GROUP BY 1) SELECT "
    "coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(o.f, n.f) AS first_seen_at, CASE WHEN n.fingerprint IS NULL THEN o.l ELSE n.l END AS "
    "last_seen_at, CASE WHEN n.fingerprint IS NULL THEN o.t ELSE n.t END AS event_type, CASE WHEN n.fingerprint IS NULL THEN o.v ELSE n.v END AS value FROM "
    "o FULL JOIN n ON o.fingerprint = n.fingerprint"
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sightings(spark, sf_dir)
    columns = ["fingerprint", "first_seen_at", "last_seen_at", "event_type", "value"]
    base = store.latest(s.filter("pos % 2 = 0"), "fingerprint", "pos").select(*columns)
    return store.upsert(base, s.filter("pos % 2 = 1")).select(*columns)


@_query(
    "WITH b AS (SELECT user_id AS fingerprint, event_id AS pos FROM events), k AS (SELECT DISTINCT fingerprint FROM b WHERE pos % 10 = 0), n AS (SELECT *, "
    "min(pos) OVER (PARTITION BY fingerprint) AS f FROM b WHERE pos % 10 <> 0) SELECT n.fingerprint, n.pos, CASE WHEN k.fingerprint IS NULL AND n.pos = f "
    "THEN 'new' ELSE 'already_seen' END AS outcome FROM n LEFT JOIN k USING (fingerprint)"
)
def upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sightings(spark, sf_dir).select("fingerprint", "pos")
    return store.upsert_results(s.filter("pos % 10 = 0"), s.filter("pos % 10 <> 0"))


@_query(
    "SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 2 = 0 OR o_orderdate::TIMESTAMP < TIMESTAMP "
    "'1998-01-01' - INTERVAL 4 HOURS) AS claimable FROM orders"
)
def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda n, kind, value: F.when(k % n == 0, value).otherwise(F.lit(None).cast(kind))
    o = table(spark, sf_dir, "orders").select("o_orderkey", some(3, "string", F.lit("x")).alias("duplicate_of"), some(5, "timestamp", F.current_timestamp()).alias("notified_at"), some(7, "timestamp", F.current_timestamp()).alias("discarded_at"), F.when(k % 2 != 0, F.col("o_orderdate").cast("timestamp")).alias("claimed_at"))
    return o.select("o_orderkey", F.coalesce(store.is_claimable(F.lit("1998-01-01").cast("timestamp")), F.lit(False)).alias("claimable"))


@_query(
    "WITH k AS (SELECT event_type, max(ts) FILTER (event_id % 100 = 0) AS s FROM events GROUP BY 1), e AS (SELECT max(ts) AS now FROM events), c AS (SELECT "
    "event_type, now, coalesce(least(greatest((epoch_ms(now) - epoch_ms(s)) / 86400000.0, 2.0), 30.0), 30.0) AS days FROM k, e) SELECT x.event_type, "
    "count(*) AS n, count(*) FILTER (epoch_ms(x.ts) < (epoch_ms(now) - days * 86400000)::BIGINT) AS late FROM events x JOIN c USING (event_type) GROUP BY 1"
)
def late_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import cutoffs, split_late

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnsRenamed({"event_type": "source", "ts": "published_at"})
    now = e.select(F.max("published_at")).scalar()
    history = e.groupBy("source").agg(F.max(F.when(F.col("event_id") % 100 == 0, F.col("published_at"))).alias("last_success"))
    kept, late = split_late(e, cutoffs(history, now, 2, 30))
    both = kept.select("source", F.lit(0).alias("late")).unionByName(late.select("source", F.lit(1).alias("late")))
    return both.groupBy(F.col("source").alias("event_type")).agg(F.count("*").alias("n"), F.sum("late").alias("late"))


# --- runs ------------------------------------------------------------------------------------------------------------


@_query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, bool_and(coalesce(event_type = "
    "'error', false)) AS all_errors, bool_and(coalesce(value < 50, false)) AS all_low FROM r WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3"
)
def last_n_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.consecutive(table(spark, sf_dir, "events"), "user_id", "event_id", 3, {"all_errors": F.col("event_type") == "error", "all_low": F.col("value") < 50})


@_query("SELECT user_id, CASE WHEN count(*) FILTER (event_id % 9 = 0) = 0 THEN sum(event_id)::BIGINT END AS total FROM events GROUP BY 1")
def null_contagious_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 9 != 0, F.col("event_id")))
    return e.groupBy("user_id").agg(runs.contagious_sum(F.col("x")).alias("total"))


@_query(
    "SELECT coalesce(sum(event_id), 0)::BIGINT AS collected, coalesce(sum(user_id), 0)::BIGINT AS \"new\", coalesce(sum(event_id % 5), 0)::BIGINT AS "
    "duplicates, greatest(0, coalesce(sum(user_id), 0) - coalesce(sum(event_id % 5), 0))::BIGINT AS remaining FROM events WHERE ts >= (SELECT max(ts) - "
    "INTERVAL 10 DAYS FROM events)"
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("started_at"), F.col("event_id").alias("collected"), F.col("user_id").alias("new"), (F.col("event_id") % 5).alias("duplicates"))
    since = e.select(F.max("started_at") - F.expr("INTERVAL 10 DAYS")).scalar()
    return runs.totals_since(e, since)


@_query(
    "WITH u AS (SELECT user_id AS run_id, count(*) AS attempts, count(*) FILTER (event_id % 13 = 0) AS blocked, count(*) FILTER (event_id % 3 = 0) AS ok "
    "FROM events GROUP BY 1) SELECT run_id, attempts + blocked - ok AS failed, attempts + blocked AS total, (attempts + blocked - ok) || '/' || (attempts + "
    "blocked) || ' operations failed (' || round((attempts + blocked - ok) / (attempts + blocked) * 100)::BIGINT || '%)' AS text FROM u WHERE attempts >= "
    "10 AND (attempts + blocked - ok) / (attempts + blocked) >= 0.7"
)
def failure_rate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("attempts"), F.count_if(i % 13 == 0).alias("blocked"), F.map_from_arrays(F.array(F.lit("success"), F.lit("timeout")), F.array(F.count_if(i % 3 == 0), F.count_if(i % 3 != 0))).alias("outcomes"))
    return runs.failure_rate_alert(e, 0.7)


@_query(
    "SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS without_usage, coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN user_id END), "
    "0)::BIGINT AS tokens, round(coalesce(sum(value), 0.0), 4) AS cost FROM events GROUP BY 1"
)
def usage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("tokens", F.when(F.col("event_id") % 4 != 0, F.col("user_id"))).withColumn("cost", F.col("value"))
    return runs.usage(e, "event_type").withColumn("cost", F.round("cost", 4))


@_query("SELECT user_id, max(ts) AS finished_at, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("finished_at"), F.col("event_id").alias("run_id"), "event_type")
    return runs.latest_run(e, "user_id").select("user_id", "finished_at", "event_type")


@_query(
    "SELECT event_type AS source, count(*) AS collected, count(*) FILTER (event_id % 6 < 4) AS normalized, count(*) FILTER (event_id % 6 < 2) AS \"new\", "
    "count(*) FILTER (event_id % 6 IN (2, 3)) AS already_seen, count(*) FILTER (event_id % 6 = 4) AS too_old, count(*) FILTER (event_id % 6 = 5) AS "
    "unnormalizable FROM events GROUP BY 1"
)
def collect_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("new", "new", "already_seen", "already_seen", "too_old", "unnormalizable")))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("outcome"))
    return runs.collect_counters(e, "source")


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) > 1 AS limited FROM events")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "principal", "event_type": "operation"})
    return runs.rate_limited(e, most=1, seconds=86400).select("event_id", "limited")


def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    outcome = F.when(i % 3 == 0, "success").when(i % 3 == 1, "transient").otherwise(F.when(i % 5 == 0, "permanent").otherwise("transient"))
    return machines.breaker_replay(table(spark, sf_dir, "events"), "event_type", dates.rounded_millis(F.col("ts").cast("timestamp")), i, outcome)


def crawl_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ok", "error", "ingested", "error", "gone", "requeue", "error")))
    outcome = F.element_at(names, (F.shiftright(F.col("event_id") * 2654435761, 8) % 7 + 1).cast("int"))
    return machines.crawl_fold(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), outcome)


# --- sets, resumption and sources ------------------------------------------------------------------------------------


@_query("SELECT 'r' AS kind, r_name AS name FROM region UNION ALL SELECT 'n', n_name FROM nation UNION ALL SELECT 's', s_name FROM supplier")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t, k, c: table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    return part("region", "r", "r_name").unionByName(part("nation", "n", "n_name")).unionByName(part("supplier", "s", "s_name"))


@_query("SELECT source, min(doc_id) AS first FROM documents GROUP BY 1")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.array("source").alias("failed"), F.col("doc_id").alias("started_at"))
    return runs.sources_named(d, "failed")


@_query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def variant_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey").distinct().join(s, "n_nationkey", "left_anti")


@_query("SELECT o_orderstatus AS status, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT ALL SELECT o_orderstatus, o_custkey % 50 FROM orders WHERE o_orderkey % 2 = 1")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).alias("k"))
    return o.filter("o_orderkey % 2 = 0").drop("o_orderkey").intersectAll(o.filter("o_orderkey % 2 = 1").drop("o_orderkey"))


@_query(
    "WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id AS "
    "fingerprint, i::INTEGER AS requirement_index, i % 3 = 0 AND conv_id % 2 = 0 AS resumed FROM c"
)
def partial_match_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.enrich import partial_resume

    c = table(spark, sf_dir, "conversations")
    grouped = c.groupBy(F.col("conv_id").alias("fingerprint")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("requirements"))
    done = grouped.select("fingerprint", F.posexplode("requirements").alias("requirement_index", "requirement")).filter("requirement_index % 3 = 0")
    # in odd conversations the text has changed since, so that the finished match doesn't count
    changed = F.when(F.col("fingerprint") % 2 == 0, F.col("requirement.text")).otherwise(F.concat("requirement.text", F.lit("!")))
    partial = done.select("fingerprint", "requirement_index", F.struct(F.struct(changed.alias("text")).alias("requirement"), F.lit("met").alias("status")).alias("match"))
    return partial_resume(grouped, partial).select("fingerprint", "requirement_index", F.col("match").isNotNull().alias("resumed"))


@_query(
    f"WITH {POSTINGS_SQL}, r AS (SELECT pos, ['gupy', 'indeed', 'solides', 'linkedin'][pos % 4 + 1] AS source, trim(title) AS title, trim(company) AS "
    f"company, lang FROM p JOIN d ON d.doc_id = p.pos) SELECT source, pos::VARCHAR AS source_id, sha256({sql_normalize('company')} || "
    f"{sql_normalize('title')} || coalesce({sql_normalize('lang')}, '')) AS fingerprint, CASE source WHEN 'gupy' THEN 'hybrid' WHEN 'indeed' THEN 'remote' "
    f"WHEN 'solides' THEN 'onsite' ELSE 'remote' END AS work_mode, lang AS location_city FROM r WHERE title <> '' AND company <> ''"
)
def normalize_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "lang"), "pos")
    source = F.element_at(F.array(*map(F.lit, ("gupy", "indeed", "solides", "linkedin"))), (F.col("pos") % 4 + 1).cast("int"))
    k, title, company, lang = (F.col(c) for c in ("pos", "title", "company", "lang"))
    payload = (
        F.when(k % 4 == 0, F.to_json(F.struct(title.alias("name"), company.alias("careerPageName"), lang.alias("city"), F.lit("hybrid").alias("workplaceType"))))
        .when(k % 4 == 1, F.to_json(F.struct(title.alias("title"), company.alias("company"), F.concat(lang, F.lit(", XX")).alias("location"), F.lit(True).alias("is_remote"))))
        .when(k % 4 == 2, F.to_json(F.struct(title.alias("title"), company.alias("companyName"), F.struct(lang.alias("name")).alias("city"), F.lit("presencial").alias("jobType"))))
        .otherwise(F.to_json(F.struct(title.alias("title"), company.alias("company"), F.concat(lang, F.lit(", YY (Remoto)")).alias("location"))))
    )
    raw = p.select(source.alias("source"), k.cast("string").alias("source_id"), payload.alias("payload"))
    return normalize.normalize_all(raw, F.lit(NOW)).select("source", "source_id", "fingerprint", "work_mode", "location_city")


def digest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("channel"), F.coalesce("text", F.lit("")).alias("text"))
    return delivery.chunks(m, 1000).select("operation_id", "chunk_index", "content_hash")


from . import captures, functions, lifecycle, observed, streams  # noqa: E402, F401  register their queries; folds as SQL

for _f, _sql in ((breaker_replay, lifecycle.BREAKER_SQL), (crawl_states, lifecycle.CRAWL_SQL), (digest_chunks, lifecycle.CHUNKS_SQL)):
    _query(_sql)(_f)


@_query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY 1")
def stream_weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly counts, taken from a stream of the table's files batch by batch."""
    import uuid

    name = f"weekly_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = stream.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n")
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
