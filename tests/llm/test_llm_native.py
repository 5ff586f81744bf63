"""Sharding, fingerprints, secrets and mixing on small tables, against brute force and SQL."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import pyspark.sql.functions as F
import pytest

from loomstone.llm import fingerprints, mixing, registry, secret_scan, sharding

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- sharding


def brute_table(shards, size):
    owner = [None] * size
    prefs = []
    for s in shards:
        offset, skip = sharding.preference(s, size)
        prefs.append(iter([(offset + i * skip) % size for i in range(size)]))
    while None in owner:
        for i, p in enumerate(prefs):
            for slot in p:
                if owner[slot] is None:
                    owner[slot] = i
                    break
            if None not in owner:
                break
    return owner


def test_table_is_that_of_turns():
    shards = [f"s{i}" for i in range(7)]
    assert sharding.fill_table(shards, 101) == brute_table(shards, 101)


def test_table_is_even_and_stable():
    full = sharding.fill_table([f"s{i}" for i in range(20)], 10007)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.fill_table([f"s{i}" for i in range(20) if i != 7], 10007)
    names = [i for i in range(20) if i != 7]
    moved = sum(names[b] != a for a, b in zip(full, less, strict=True) if a != 7)
    assert moved < 0.1 * 10007
    weighted = Counter(sharding.fill_table(["a", "b"], 101, [3, 1]))
    assert weighted[0] == pytest.approx(76, abs=1)
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(["a"], 100)
    with pytest.raises(ValueError, match="distinct"):
        sharding.fill_table(["a", "a"], 101)


def test_placement(spark):
    df = docs_of(spark, [(1, "x"), (None, "y"), (None, "z"), (1, "x")], "doc_id long, shard string")
    got = sharding.place(df, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(got) == 4
    owner = sharding.fill_table(["a", "b", "c"], 101)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.shard_name) == (slot, owner[slot], "abc"[owner[slot]])
    assert sharding.place(df.limit(0), "doc_id").count() == 0


# --- fingerprints


def brute_vector(text):
    words = [0] * fingerprints.WORDS
    piece = re.compile(fingerprints.PIECE)
    for p in filter(None, text.split("\n")):
        d = hashlib.sha256(p.encode()).hexdigest()
        for i in range(fingerprints.EXACT):
            block = hashlib.sha256(f"{d}:{i // 4}".encode()).hexdigest()
            words[i] = (words[i] + int(block[15 * (i % 4) : 15 * (i % 4) + 15], 16)) % fingerprints.MODULUS
        for m in piece.finditer(p):
            h = hashlib.md5(m[0].encode()).hexdigest()
            for j in range(2):
                x = int(h[15 * j : 15 * j + 15], 16)
                for k in range(fingerprints.SHIFTS):
                    at = fingerprints.EXACT + j * fingerprints.SHIFTS + k
                    words[at] = (words[at] + (x >> k & fingerprints.ONES)) % fingerprints.MODULUS
            words[-1] += 1
    return words


TEXTS = ["", "one", "one two. three\n\nfour five", "ä😀 b\n" * 3 + "end", " \t", "w " * 5000, "\n".join(f"line {i} of it." for i in range(200)), "x" * 3000]


def test_vectors_are_those_of_brute_force(spark):
    df = docs_of(spark, list(enumerate(TEXTS)))
    got = {r.doc_id: r.v for r in df.select("doc_id", fingerprints.vector("text").alias("v")).collect()}
    assert got == {i: brute_vector(t) for i, t in enumerate(TEXTS)}


def test_fingerprints_are_of_the_multiset(spark):
    df = docs_of(spark, [(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b"), (4, "c d\ne"), (5, "a b\na b\nc d\ne"), (6, None), (7, "")])
    v = {r.doc_id: r.v for r in df.select("doc_id", fingerprints.vector("text").alias("v")).collect()}
    assert v[1] == v[2] != v[5]
    assert v[6] == v[7] == [0] * fingerprints.WORDS
    pair = spark.createDataFrame([(v[3], v[4], v[1])], "a array<long>, b array<long>, c array<long>")
    row = pair.select(fingerprints.insert(F.col("a"), F.col("b")).alias("u"), fingerprints.delete(F.col("c"), F.col("b")).alias("d")).first()
    assert (row.u, row.d) == (v[1], v[3])


def test_likeness_follows_the_shared_part(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(8)) + "."
    base = [line() for _ in range(100)]
    rows = [(k, "\n".join(base[: 100 - k] + [line() for _ in range(k)])) for k in (0, 10, 50, 90, 100)]
    v = {r.doc_id: r.v for r in docs_of(spark, rows).select("doc_id", fingerprints.vector("text").alias("v")).collect()}
    near = {k: spark.createDataFrame([(v[0], v[k])], "a array<long>, b array<long>").select(fingerprints.likeness("a", "b").alias("x")).first().x for k in v}
    assert near[0] == 1
    assert all(abs(near[k] - (1 - k / 100)) < 0.2 for k in near)
    assert near[10] > near[50] > near[90]


def test_next_documents_in_a_circle(spark):
    rng = random.Random(1)
    ids = [*rng.sample(range(100000), 500), None]
    df = docs_of(spark, [(i, f"t{i}") for i in ids]).repartition(7)
    following = lambda df: fingerprints.with_next(df, "doc_id", "text", lambda x: x, ["text"])
    got = {r.doc_id: r.n for r in following(df).select("doc_id", F.col("next.text").alias("n")).collect()}
    order = [*sorted((i for i in ids if i is not None), reverse=True), None]
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert following(docs_of(spark, [(5, "x")])).first().next.text == "x"
    assert following(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["wide", "hot", "one", "null", "ends"])
def test_next_documents_of_any_ids(spark, kind, monkeypatch):
    if kind == "wide":
        monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)  # many buckets and partitions
    rng = random.Random(7)
    ids = {
        "wide": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)],
        "hot": [rng.choice([7, 7, 7, (1 << 60) + rng.randrange(9), (1 << 60) + 5]) for _ in range(400)],
        "one": [3] * 300,
        "null": [None] * 200 + [1],
        "ends": [-(1 << 63), (1 << 63) - 1] * 40 + [None] * 3 + [-(1 << 63) + 1],
    }[kind]
    df = docs_of(spark, [(i, f"text {k}") for k, i in enumerate(ids)]).repartition(5)
    low = -(1 << 63)
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [r.text for r in sorted(rows, key=lambda r: (-(low if r.doc_id is None else r.doc_id), r.h, r.text))]
    paired = fingerprints.with_next(df, "doc_id", "text", lambda x: x, ["text"])
    got = {r.text: r.next.text for r in paired.collect()}
    assert paired.columns == [*df.columns, "next"]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


# --- secrets


def test_ownership_counts_distinct_documents(spark):
    rows = [("d1", "a", "v"), ("d1", "a", "v"), ("d2", "a", "v"), ("d3", "b", "v"), ("d4", None, "w"), ("d4", None, "w")]
    found = spark.createDataFrame([(i, o, [(0, 0, 6, h)]) for i, o, h in rows], f"id string, owner string, spans array<{secret_scan.SPAN}>")
    assert {r.hash: (r.n_docs, r.n_owners) for r in secret_scan.ownership(found).collect()} == {"v": (3, 2), "w": (1, 1)}


def brute_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = [
    "", "plain words", "password=secret99 TOKEN : 'abcdef1'", "secret=token:abcdefgh", "é😀 api_key=\"x.y/z+12=\" AKIA" + "Q" * 16 + " AKIA" + "Q" * 15,
    "token=" + "0123456789abcdef" * 3, "0" * 23 + " " + "f" * 24, "passwd=short passwd=longer1\npassword = last-one", "AKIAAKIA" + "Z" * 12, "apikey=" + "aB3" * 9, "token=abcdef " * 3000,
]


def test_base_spans_are_those_of_brute_force(spark):
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(SECRETS)]
    got = {r.key: sorted((s.start, s.kind, s.end) for s in r.spans if s.kind < 3) for r in secret_scan.scan(docs_of(spark, rows, DOCS)).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(SECRETS)}


def test_ownership_separates_examples(spark):
    opaque, shared = "Zx9" * 8, "Qq1" * 8
    rows = [(i, f"token=common99 and {shared}", "en", f"s{i}", 0) for i in range(4)] + [(9, f"token=mine1234 {opaque}", "en", "s9", 0), (10, None, None, None, None), (9, f"token=mine1234 {opaque}", "en", "s9", 0)]
    got = secret_scan.scan(docs_of(spark, rows, DOCS)).collect()
    by = {r.key: [(s.kind, s.copied) for s in r.spans] for r in got}
    assert len(got) == len(rows)
    assert by == {**{i: [(0, True)] for i in range(4)}, 9: [(0, False), (3, False)], 10: []}
    red = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs_of(spark, rows, DOCS)).collect()}
    assert red[9][0] == "[SECRET] [SECRET]"
    assert red[9][1] == len(red[9][0])
    assert red[0][0] == f"[EXAMPLE-CREDENTIAL] and {shared}"
    assert red[10] == (None, None)
    assert secret_scan.redact(docs_of(spark, [], DOCS)).count() == 0


# --- mixing


def test_exponent_meets_the_targets():
    tokens = {"a": 700_000, "b": 200_000, "c": 90_000, "d": 10_000}
    mix = mixing.solve(tokens, 1e6, 0.9, None)
    assert mixing.entropy(mix.weights) == pytest.approx(0.9 * math.log(4), abs=1e-9)
    assert math.fsum(mix.weights.values()) == pytest.approx(1)
    limited = mixing.solve(tokens, 1e6, 0.9, 2.0)
    assert max(limited.budgets[s] / tokens[s] for s in tokens) == pytest.approx(2.0)
    assert mixing.solve(tokens, 1e6, 0.1).exponent == 1
    assert mixing.solve({"a": 5}, None).weights == {"a": 1.0}
    whole = mixing.solve(tokens, None, None, 1.25)
    epochs = [whole.budgets[s] / tokens[s] for s in tokens]
    assert (min(epochs), max(epochs)) == (pytest.approx(1), pytest.approx(1.25))
    with pytest.raises(ValueError, match="budget"):
        mixing.solve(tokens, 1e7, 0.9, 2.0)


def mixed_rows(spark, **options):
    rows = [(i, "w " * (1 + i % 5), "en", "hot" if i % 3 else f"s{i % 2}", 0) for i in range(3000)] + [(None, None, None, None, None), (1, "w", "en", "hot", 0)]
    return rows, mixing.mixed(docs_of(spark, rows, DOCS), ["doc_id", "source"], **options).collect()


def test_budgets_are_met_by_whole_blocks(spark):
    rows, got = mixed_rows(spark)
    size = lambda r: max(1, len((r[1] or "").split()))
    tokens = Counter()
    for r in rows:
        tokens[r[3] or ""] += size(r)
    mix = mixing.solve(dict(tokens), float(sum(tokens.values())))
    taken = Counter()
    for r in got:
        taken[r.source or ""] += r.mix_tokens
    for s in tokens:
        assert taken[s] == pytest.approx(mix.budgets[s], abs=max(60, 0.03 * mix.budgets[s]))
    # an epoch takes a block whole or not at all, and once
    seen = Counter((r.source, r.doc_id, r.mix_epoch) for r in got if r.doc_id not in (1, None))
    assert set(seen.values()) == {1}
    # any stretch of the mix has the weights
    half = Counter()
    for r in got:
        if r.mix_at < 0.5:
            half[r.source or ""] += r.mix_tokens
    assert half["hot"] / sum(half.values()) == pytest.approx(mix.weights["hot"], abs=0.05)


def test_the_whole_mix_keeps_every_document(spark):
    rows, got = mixed_rows(spark, whole=True, target=None, repetitions=1.25)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert len(rows) <= len(got) <= 1.25 * len(rows) + 60
    again = mixed_rows(spark, whole=True, target=None, repetitions=1.25)[1]
    assert sorted(map(str, got)) == sorted(map(str, again))


# --- the registered queries that SQL can express


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    got = registry.queries()[name](spark, DATA)
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    expected = c.execute(registry.oracle_sql()[name])
    names, columns = [d[0] for d in expected.description], sorted(got.columns)
    assert sorted(names) == columns
    # as Python's values: pandas would make floats of integers beside nulls
    own = sorted(repr(tuple(r[x] for x in columns)) for r in got.collect())
    assert own == sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in expected.fetchall())
