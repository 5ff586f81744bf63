"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (its non-empty lines). Each paragraph is hashed to a wide
vector; the fingerprint is the sum of the vectors, each word modulo 2**60. The sum doesn't depend
on the order of the paragraphs, and a paragraph can be added to or taken from a fingerprint without
the rest of the text. A vector has

* ``EXACT`` words from SHA-256 in counter mode over the paragraph's digest: sums are equal where the
  multisets of paragraphs are equal, and otherwise differ but for chance;
* ``2 * SHIFTS`` words of ``LANES`` lanes each for likeness. A paragraph's pieces (up to eight words,
  ending at a sentence's end) give 120 random signs each, from MD5; a lane counts the pieces with a
  positive sign. The squared distance of two such sums estimates the size of the difference of the
  two multisets of pieces, so 1 - |a-b|^2 / (|a|^2 + |b|^2) tells how much of the pieces two texts
  share, within about 0.1;
* the number of pieces.

Only DataFrame functions are used, of which DuckDB has equivalents: ``ORACLE_SQL`` gives the rows of
the query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

EXACT = 16
SHIFTS = 20
LANES = 3
WORDS = EXACT + 2 * SHIFTS + 1
MODULUS = 1 << 60
MASK = MODULUS - 1
#: Bits 0, 20 and 40: a lane each.
ONES = 1 | 1 << SHIFTS | 1 << 2 * SHIFTS
#: Up to eight words, the last of which may end a sentence. Java's and RE2's readings agree on it.
PIECE = r"(?:[^ \t\r\f]*[^ \t\r\f.!?][ \t\r\f]+){0,7}[^ \t\r\f]+"
#: Rows of a bucket of neighbouring ids, about, and most buckets; a bucket is sorted with spilling, so the latter bounds the split points only.
BUCKET_ROWS, MOST_BUCKETS = 5000, 65536


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes value once and names it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _word(text: str, start: int) -> str:
    return f"cast(conv(substring({text}, {start}, 15), 16, 10) as bigint)"


def vector_sql(text: str) -> str:
    """SQL of the vector of a string expression: an array of ``WORDS`` longs in 0..2**60-1."""
    exact = ", ".join(f"aggregate(e, 0L, (s, h) -> (s + {_word(f'h[{i // 4}]', i % 4 * 15 + 1)}) & {MASK}L)" for i in range(EXACT))
    digests = "transform(p, x -> sha2(encode(x, 'UTF-8'), 256))"
    blocks = f"transform({digests}, d -> transform(sequence(0, {EXACT // 4 - 1}), j -> sha2(encode(concat(d, ':', j), 'UTF-8'), 256)))"
    lanes = f"transform(sequence(0, {SHIFTS - 1}), k -> aggregate(%s, 0L, (s, h) -> (s + (shiftright(h, k) & {ONES}L)) & {MASK}L))"
    pieces = f"flatten(transform(p, x -> regexp_extract_all(x, '{PIECE}', 0)))".replace("\\", "\\\\")
    likeness = _let(
        f"transform({pieces}, x -> md5(encode(x, 'UTF-8')))",
        "m",
        "concat(" + _let(f"transform(m, x -> {_word('x', 1)})", "h1", lanes % "h1") + ", " + _let(f"transform(m, x -> {_word('x', 16)})", "h2", lanes % "h2") + ", array(cast(size(m) as bigint)))",
    )
    whole = f"concat({_let(blocks, 'e', f'array({exact})')}, {likeness})"
    return _let(f"filter(split({text}, '\\n'), x -> x <> '')", "p", whole)


def vector(text: str) -> Column:
    """Vector of the named text column; null counts as the empty text, whose vector is all zeros."""
    return F.expr(vector_sql(f"coalesce(`{text}`, '')"))


def insert(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def delete(a: Column, b: Column) -> Column:
    """Vector of the multiset a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def as_text(v: Column) -> Column:
    """The fingerprint as a string: the words in hex, 15 digits each."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _squares_sql(word: str, count: str) -> str:
    """SQL of the sum over the lanes of a word of (2 * lane - count)**2; lanes are signed, with borrows undone."""
    low, half = (1 << SHIFTS) - 1, 1 << SHIFTS - 1
    lane = lambda x: f"((({x} + {half}L) & {low}L) - {half}L)"
    square = lambda x: f"(2 * {x} - {count}) * (2 * {x} - {count})"
    second = f"shiftright({word} - {lane(word)}, {SHIFTS})"
    third = _let(second, "w2", f"array({lane('w2')}, {lane(f'shiftright(w2 - {lane("w2")}, {SHIFTS})')})")
    return _let(lane(word), "l0", square("l0")) + " + " + _let(third, "l", f"{square('l[0]')} + {square('l[1]')}")


def _norm_sql(v: str) -> str:
    lanes = f"slice({v}, {EXACT + 1}, {2 * SHIFTS})"
    return _let(f"{v}[{WORDS - 1}]", "n", f"aggregate({lanes}, 0L, (s, w) -> s + {_squares_sql('w', 'n')})")


def likeness(a: str, b: str) -> Column:
    """Share of the pieces that two vectors (named columns) have in common, 0 to 1; 1 where they are equal.

    Lanes count up to 2**19 pieces (some 4 million words); beyond that the likeness of unequal texts loses sense,
    equality does not.
    """
    differ = f"zip_with({a}, {b}, (x, y) -> (x - y) & {MASK}L)"
    n = f"({a}[{WORDS - 1}] - {b}[{WORDS - 1}])"
    gap = f"aggregate(slice({differ}, {EXACT + 1}, {2 * SHIFTS}), 0L, (s, w) -> s + {_squares_sql('w', n)})"
    total = f"({_norm_sql(a)} + {_norm_sql(b)})"
    return F.expr(_let(gap, "g", _let(total, "t", f"case when {a} = {b} then 1D when t = 0 then 0D else greatest(0D, 1D - g / cast(t as double)) end")))


def _ordered_bucket(splits: list[int], numbers: list[int]) -> Column:
    """SQL column: bucket of ``__key`` and ``__hash``; the lists tell each bucket's greatest key (descending) and into how many it is cut by hash."""
    steps = max(1, len(splits).bit_length())
    # the index of the last split point that is not below the key
    middle = 'if(__splits[mid] >= __key, named_struct("lo", mid, "hi", s.hi), named_struct("lo", s.lo, "hi", mid - 1))'
    search = f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(splits) - 1}), (s, i) -> if(s.lo = s.hi, s, {_let('cast(floor((s.lo + s.hi + 1) / 2) as int)', 'mid', middle)}), s -> s.lo)"
    # hashes are dealt by range, so that buckets follow each other in the order of hashes too
    cut = "least(__numbers[i] - 1, cast(floor((__hash / 18446744073709551616D + 0.5D) * __numbers[i]) as int))"
    return F.expr(_let(search, "i", f"__firsts[i] + {cut}"))


def with_next(docs: DataFrame, key: str, text: str, make: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """``make`` of the rows, with a column ``next`` more: a struct of the carried columns of the row after each by descending key, circularly.

    Null keys come last; rows of one key are ordered by a hash of their text, then the text. The rows are dealt into
    buckets that follow each other in this order: by approximate quantiles of the keys, which needn't be keys, and keys
    with much of all rows (found by exact counts) in buckets of their own, by ranges of the hash. The first row of a
    bucket also goes, as a guest, to the end of the bucket before. So a window over each bucket suffices. Columns whose
    names begin with two underscores, and ``next``, are the operator's own and must not be in docs.
    """
    spark = docs.sparkSession
    null = F.lit(-(1 << 63))
    keyed = docs.withColumns({"__key": F.coalesce(F.col(key).cast("long"), null), "__hash": F.xxhash64(text)})
    top, rows = keyed.agg(F.max("__key"), F.count("*")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_BUCKETS, max(4 * partitions, rows // BUCKET_ROWS))
    if not rows:
        return make(docs).withColumn("next", F.lit(None).cast(make(docs).select(F.struct(*carried)).dtypes[0][1]))
    points = keyed.select(F.col("__key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.5 / n)
    most = max(2, -(-rows // n))
    hot = {r["__key"]: r["count"] for r in keyed.groupBy("__key").count().filter(F.col("count") >= most).collect()}  # n at most
    ends = {max(-(1 << 63), int(x)) for x in points} | set(hot) | {k - 1 for k in hot if k > -(1 << 63)}
    splits = sorted({x for x in ends if x < top} | {top}, reverse=True)
    numbers = [-(-hot.get(x, 0) // most) or 1 for x in splits]
    lists = {"__splits": splits, "__numbers": numbers, "__firsts": [0, *np.cumsum(numbers)[:-1].tolist()]}
    lit = lambda values: F.lit(np.array(values, dtype=np.int64))
    found = keyed.withColumns({k: lit(v) for k, v in lists.items()}).withColumn("__b", _ordered_bucket(splits, numbers)).drop(*lists)
    # of each bucket that has rows: the first one's key and hash (two numbers for each of some n buckets)
    heads = sorted((r["__b"], -r.h["k"], r.h["__hash"]) for r in found.groupBy("__b").agg(F.min(F.struct((-1 - F.col("__key")).alias("k"), "__hash")).alias("h")).collect())
    heads = [(b, k - 1, h) for b, k, h in heads]
    size = heads[-1][0] + 1
    first = {name: [0] * size for name in ("__head_key", "__head_hash", "__before")}
    for (b, k, h), (before, *_) in zip(heads, [heads[-1], *heads], strict=False):
        first["__head_key"][b], first["__head_hash"][b], first["__before"][b] = k, h, before
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.expr("__before[__b]").alias("b"), F.lit(True).alias("guest"))
    is_first = F.expr("__head_key[__b] = __key and __head_hash[__b] = __hash")
    dealt = found.withColumns({k: lit(v) for k, v in first.items()}).withColumn("__to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own)))).drop("__b", *first)
    if n > 4 * partitions:  # as many tasks as the rows need, whatever the session's setting
        dealt = dealt.repartition(n // 2, F.col("__to.b"))
    w = W.partitionBy("__to.b").orderBy("__to.guest", F.desc("__key"), "__hash", text)
    return make(dealt).withColumn("next", F.lead(F.struct(*carried)).over(w)).filter(~F.col("__to.guest")).drop("__to", "__key", "__hash")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, with likenesses.

    Null texts count as empty; an empty table gives no rows; a single document is its own next one; columns of the table
    beyond doc_id and text are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, "doc_id", "text", lambda df: df.withColumn("v", vector("text")), ["text", "v"])
    half = "cast(floor(length(text) / 2) as int)"
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next.text, 1, {half}))"))
    full = edited.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "v", vector("edited").alias("ev"), F.col("next.v").alias("nv"))
    return full.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("ev")).alias("edited_fingerprint"), likeness("v", "ev").alias("near_edited"), likeness("v", "nv").alias("near_next"))


def _oracle() -> str:
    low, half = (1 << SHIFTS) - 1, 1 << SHIFTS - 1
    lanes = f"list_transform(range({SHIFTS}), lambda k: coalesce(list_sum(list_transform(%s, lambda h: (h >> k) & {ONES})), 0) %% {MODULUS})"
    exact = f"list_transform(range({EXACT}), lambda i: coalesce(list_sum(list_transform(p, lambda x: ('0x' || substr(sha256(sha256(x) || ':' || (i // 4)), 15 * (i % 4) + 1, 15))::BIGINT)), 0) % {MODULUS})"
    hashes = "list_transform(m, lambda x: ('0x' || substr(x, %d, 15))::BIGINT)"
    first = f"((w + {half}) & {low}) - {half}"
    squares = f"""list_sum(list_transform(list_transform(list_transform(%s, lambda w: {{'w': w, 'l': {first}}}),
        lambda s: {{'a': s.l, 'w': (s.w - s.l) >> {SHIFTS}, 'l': {first.replace("w", f"((s.w - s.l) >> {SHIFTS})")}}}),
        lambda s: (2 * s.a - %s) ** 2 + (2 * s.l - %s) ** 2 + (2 * ({first.replace("w", f"((s.w - s.l) >> {SHIFTS})")}) - %s) ** 2))::BIGINT"""
    part = f"[{EXACT + 1}:{EXACT + 2 * SHIFTS}]"
    norm = lambda v: squares % (f"{v}{part}", *[f"{v}[{WORDS}]"] * 3)
    differ = f"list_transform(list_zip(a{part}, b{part}), lambda z: ((z[1] - z[2]) % {MODULUS} + {MODULUS}) % {MODULUS})"
    gap = squares % (differ, *[f"(a[{WORDS}] - b[{WORDS}])"] * 3)
    text = "list_aggregate(list_transform(%s, lambda x: format('{:015x}', x)), 'string_agg', '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS following FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT *, substr(text, 1, (length(text) - length(text) // 2)::BIGINT) || substr(following, 1, (length(text) // 2)::BIGINT) AS edited FROM n),
t AS (SELECT doc_id, 'own' AS which, text AS s FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'following', following FROM e),
p AS (SELECT *, list_filter(string_split(s, chr(10)), lambda x: x <> '') AS p FROM t),
m AS (SELECT *, list_transform(flatten(list_transform(p, lambda x: regexp_extract_all(x, '{PIECE}'))), lambda x: md5(x)) AS m FROM p),
h AS (SELECT *, {hashes % 1} AS h1, {hashes % 16} AS h2 FROM m),
v AS (SELECT doc_id, which, list_transform(list_concat(list_concat({exact}, {lanes % "h1"}), list_concat({lanes % "h2"}, [len(m)])), lambda x: x::BIGINT) AS v FROM h),
x AS (SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256, o.v AS v, c.v AS ev, f.v AS nv
  FROM e JOIN v o ON o.doc_id = e.doc_id AND o.which = 'own' JOIN v c ON c.doc_id = e.doc_id AND c.which = 'edited' JOIN v f ON f.doc_id = e.doc_id AND f.which = 'following'),
y AS (SELECT doc_id, 'near_edited' AS which, v AS a, ev AS b FROM x UNION ALL SELECT doc_id, 'near_next', v, nv FROM x),
g AS (SELECT doc_id, which, a = b AS same, {gap} AS gap, {norm("a")} + {norm("b")} AS total FROM y),
l AS (SELECT doc_id, which, CASE WHEN same THEN 1::DOUBLE WHEN total = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 1::DOUBLE - gap / total::DOUBLE) END AS near FROM g)
SELECT x.doc_id, n_chars, edited_sha256, {text % "v"} AS fingerprint, {text % "ev"} AS edited_fingerprint, i.near AS near_edited, k.near AS near_next
FROM x JOIN l i ON i.doc_id = x.doc_id AND i.which = 'near_edited' JOIN l k ON k.doc_id = x.doc_id AND k.which = 'near_next'
"""


#: DuckDB's version of the query; doc_id must be unique and not null in it.
ORACLE_SQL = _oracle()
