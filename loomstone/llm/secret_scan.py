"""Secret scans with corpus-wide ownership frequency.

Three base kinds of candidates are found by pattern: ``assign`` (a keyword, a sign and a value), ``access`` (key ids)
and ``hex`` (long hexadecimal runs). A fourth kind, ``opaque``, is a long run of letters of both cases and digits that
no base span touches. The SHA-256 of every candidate's value is then counted over the whole corpus by distinct
documents (which stand for repositories) and distinct owners (sources). Owners alone decide: a value that ``COPIED_OWNERS`` owners or more
have is a widely copied example, every other is owner-specific and counts as live. Base spans always stay, with their
class; opaque spans are added where their value is live.

Only DataFrame functions are used. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .scratch import Scratch

# The patterns of the base kinds and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Long runs that may be credentials; both cases and a digit are asked for besides.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
COPIED_OWNERS = 3
SECRET, EXAMPLE = "[SECRET]", "[EXAMPLE-CREDENTIAL]"
SPAN = "struct<start: int, kind: int, end: int, hash: string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes value once and names it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans_sql(text: str, pattern: str, kind: int, value: str, where: str = "true") -> str:
    """SQL of a pattern's leftmost non-overlapping spans; value and where are SQL of a match ``x``.

    What lies between matches comes from split, so starts are prefix sums of lengths; they are summed over chunks of
    about the square root of their number, which keeps texts with very many matches cheap.
    """
    lengths = "transform(sequence(0, size(m) - 1), i -> length(g[i]) + length(m[i]))"
    chunk = "cast(ceil(sqrt(size(m))) as int)"
    sums = "transform(sequence(0, cast(floor((size(m) - 1) / k) as int)), c -> aggregate(slice(w, c * k + 1, k), 0, (a, b) -> a + b))"
    start = "aggregate(slice(u, 1, cast(floor(i / k) as int)), 0, (a, b) -> a + b) + aggregate(slice(w, cast(floor(i / k) as int) * k + 1, i % k), 0, (a, b) -> a + b) + length(g[i])"
    span = _let(start, "s", f"named_struct('start', s, 'kind', {kind}, 'end', s + length(m[i]), 'hash', {_let('m[i]', 'x', f'if({where}, sha2(encode({value}, "UTF-8"), 256), null)')})")
    found = _let(lengths, "w", _let(chunk, "k", _let(sums, "u", f"filter(transform(sequence(0, size(m) - 1), i -> {span}), y -> y.hash is not null)")))
    split = _let(f"split({text}, {_quoted(pattern)}, -1)", "g", found)
    return _let(f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", "m", f"if(size(m) = 0, cast(array() as array<{SPAN}>), {split})")


def candidates(text: str) -> Column:
    """All candidate spans of the named text column (not null), by start and kind: an array of ``SPAN``."""
    t = "t"
    group = f"regexp_extract(x, {_quoted(ASSIGN)}, 2)"
    assign = _spans_sql(t, ASSIGN, 0, group, f"length({group}) >= {ASSIGN_LEAST}")
    base = f"concat({assign}, {_spans_sql(t, ACCESS, 1, 'x')}, {_spans_sql(t, HEX, 2, 'x')})"
    opaque = _spans_sql(t, OPAQUE, 3, "x", "x rlike '[a-z]' and x rlike '[A-Z]' and x rlike '[0-9]'")
    free = f"filter({opaque}, o -> not exists(b, y -> y.start < o.end and o.start < y.end))"
    return F.expr(_let(f"`{text}`", t, _let(base, "b", f"array_sort(concat(b, {free}))")))


def identity(key: str, text: str) -> Column:
    """A key of a row's document that holds for null ids too."""
    return F.md5(F.encode(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), "UTF-8"))


def ownership(found: DataFrame, owner: str = "owner") -> DataFrame:
    """Documents and owners of each candidate value: hash, n_docs, n_owners.

    found: a row per document with its id, spans and owner; repeated rows are one document. What is counted is made
    distinct before the shuffle by value, so a value that a third of all documents hold makes no large group.
    """
    each = found.select("id", F.coalesce(F.col(owner), F.lit("")).alias("owner"), F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    return each.groupBy("hash").agg(F.countDistinct("id").alias("n_docs"), F.countDistinct("owner").alias("n_owners"))


def copied_values(found: DataFrame, least: int = COPIED_OWNERS) -> DataFrame:
    """For each document (``id``) with candidates: ``copied``, the hashes of its values that many owners have."""
    each = found.select("id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    many = ownership(found).filter(F.col("n_owners") >= least).select("hash")
    return each.join(many, "hash").groupBy("id").agg(F.collect_set("hash").alias("copied"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Every row's key with ``spans`` (an array of start, kind, end, hash, copied), by start and kind.

    Null texts count as empty, null owners as one owner. Rows are kept one to one, repeated ones included.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), identity(key, text).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("key", "owner", "id", candidates("text").alias("spans")), "found")
    some = found.filter(F.size("spans") > 0)
    judged = some.join(copied_values(some), "id", "left").select("key", _judged("spans", "copied").alias("spans"))
    none = found.filter(F.size("spans") == 0).select("key", F.expr(f"cast(array() as array<{_JUDGED}>)").alias("spans"))
    return judged.unionByName(none)


_JUDGED = "struct<start: int, kind: int, end: int, hash: string, copied: boolean>"


def _judged(spans: str, copied: str) -> Column:
    """Spans with their class, without opaque ones that are widely copied."""
    hashes = f"coalesce({copied}, cast(array() as array<string>))"
    return F.expr(f"filter(transform({spans}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'hash', s.hash, 'copied', array_contains({hashes}, s.hash))), s -> s.kind < 3 or not s.copied)")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """The table with every span in the text replaced: live ones by ``SECRET``, widely copied ones by ``EXAMPLE``.

    Overlapping spans are replaced once, as live if the first of them is. All rows and columns stay, of whatever names
    (and if there is an ``n_chars`` column, it follows the text); texts without spans, null ones included, stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{owner}`").cast("string").alias("owner"))
    # the patterns are searched once: spans are written with their rows
    spotted = scratch.keep(own.select("row", "text", "owner", identity("key", "text").alias("id"), F.when(F.col("text").isNull(), none).otherwise(candidates("text")).alias("spans")), "spotted")
    some = spotted.filter(F.size("spans") > 0)
    copied = copied_values(some.select("id", "owner", "spans"))
    judged = some.select("row", "text", "id", "spans").join(copied, "id", "left").select("row", "text", _judged("spans", "copied").alias("judged"))
    mark = f"if(s.copied, '{EXAMPLE}', '{SECRET}')"
    step = f"if(s.start >= a.at, named_struct('at', s.end, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), {mark})), named_struct('at', greatest(a.at, s.end), 'out', a.out))"
    masked = judged.select("row", F.expr(f"aggregate(judged, named_struct('at', 0, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring(text, a.at + 1)))").alias("text"))
    changed = {text: F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {text: F.col("text")}
    return masked.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)).unionByName(spotted.filter(F.size("spans") == 0).select("row.*"))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text of ``documents``: counts and digest of the base kinds, all spans, and their classes."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(F.encode(_listed(F.filter("spans", lambda s: s["kind"] < 3)), "UTF-8"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
        F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long").alias("n_live"),
        count(3).alias("n_added"),
    )


def _oracle() -> str:
    assign = ASSIGN.replace("(?i)(password|passwd|secret|token|api_?key)", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").replace("'", "''")
    spans = lambda p, kind, value, where: f"list_filter(list_transform(range(len(regexp_extract_all(t, '{p}'))), lambda i: {{'start': coalesce(list_sum(list_transform(range(i + 1), lambda j: length(string_split_regex(t, '{p}')[j + 1]))), 0)::BIGINT + coalesce(list_sum(list_transform(range(i), lambda j: length(regexp_extract_all(t, '{p}')[j + 1]))), 0)::BIGINT, 'kind': {kind}, 'n': length(regexp_extract_all(t, '{p}')[i + 1]), 'm': regexp_extract_all(t, '{p}')[i + 1], 'v': {value.replace('@', f"regexp_extract_all(t, '{p}')[i + 1]")}}}), lambda s: {where})"
    every = [spans(assign, 0, f"regexp_extract(@, '{assign}', 2)", f"length(s.v) >= {ASSIGN_LEAST}"), spans(ACCESS, 1, "@", "true"), spans(HEX, 2, "@", "true"), spans(OPAQUE, 3, "@", "regexp_matches(s.v, '[a-z]') AND regexp_matches(s.v, '[A-Z]') AND regexp_matches(s.v, '[0-9]')")]
    name = "CASE s.kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END || ':' || s.start || ':' || (s.start + s.n)"
    unnested = " UNION ALL ".join(f"SELECT doc_id, source, unnest({x}) AS s FROM d" for x in every)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
every AS ({unnested}),
free AS (SELECT * FROM every e WHERE s.kind < 3 OR NOT EXISTS (SELECT 1 FROM every b WHERE b.doc_id = e.doc_id AND b.s.kind < 3 AND b.s.start < e.s.start + e.s.n AND e.s.start < b.s.start + b.s.n)),
owners AS (SELECT s.v AS v, count(DISTINCT coalesce(source, '')) AS n FROM free GROUP BY 1),
judged AS (SELECT f.doc_id, f.s, o.n >= {COPIED_OWNERS} AS copied FROM free f JOIN owners o ON o.v = f.s.v WHERE f.s.kind < 3 OR o.n < {COPIED_OWNERS}),
g AS (SELECT doc_id, count(*) FILTER (s.kind = 0) AS n_assign, count(*) FILTER (s.kind = 1) AS n_access, count(*) FILTER (s.kind = 2) AS n_hex,
  string_agg({name}, ',' ORDER BY s.start, s.kind) FILTER (s.kind < 3) AS base, string_agg({name}, ',' ORDER BY s.start, s.kind) AS spans,
  count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (s.kind = 3) AS n_added FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


#: DuckDB's version of the query; doc_id must be unique and not null in it.
ORACLE_SQL = _oracle()
