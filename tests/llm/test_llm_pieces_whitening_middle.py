"""SentencePiece, whitening and fill-in-the-middle: against the library, numpy and plain Python, and at the edges."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import sentencepiece

from loomstone.llm import fill_middle, pieces, whitening

DATA = "/root/testdata/sf0.001"


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary(pieces.read_model(pieces.model_path())))


def fuzzed():
    rnd = random.Random(7)
    letters = [*"aebtcd rnos  ▁\n\t.,é\U0001f600梦中한ก\x00\x01')-_0123٣²ªʹ̈", "the", "ing", " ", "   ", "     ", "in", "er"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF), rnd.randint(32, 126)])) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    return texts + [" " * n for n in range(60)] + ["a" * n for n in range(60)] + ["ab" * n for n in range(40)] + ["<s>", "</s>", "<0x41>", "▁", "⁇"]


def test_pieces_equal_the_library(library, encoder):
    rnd = random.Random(8)
    vocabulary = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = fuzzed() + ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encoded(texts), strict=True):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert encoder.vocabulary.decode(got) == library.decode(got.tolist()), text


def test_any_ids_decode_as_in_the_library(library, encoder):
    rnd = random.Random(9)
    for _ in range(8000):
        ids = [rnd.choice([rnd.randint(0, 31999), rnd.randint(0, 258), rnd.randint(0, 3), rnd.randint(131, 258), 28705]) for _ in range(rnd.randint(0, 12))]
        assert encoder.vocabulary.decode(np.array(ids, dtype=int)) == library.decode(ids), ids


def test_words_are_no_other_beyond_the_cache(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 5)
    small = pieces.Encoder(pieces.Vocabulary(pieces.read_model(pieces.model_path())), begin=False, end=False)
    texts = fuzzed()[:300]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encoded(texts)] == [library.encode(t) for t in texts]
    assert len(small.words) <= 5


def test_the_pieces_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: library.encode(r.text or "", add_bos=True, add_eos=True) for r in docs}
    got = {r.doc_id: r for r in pieces.op11_sentence_pieces(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, ids in want.items():
        assert tuple(got[i]) == (i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids)))


def test_pieces_at_the_edges(spark, library):
    """Null, empty and very long texts, repeated rows, clashing columns; ids beyond the vocabulary."""
    rows = [(1, None), (1, ""), (None, "x  y"), (2, "z" * 200_000), (2, " " * 50_000), (3, "same text"), (3, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("own"), "a.b": F.lit(1), "ids": F.lit(2)})
    got = df.select("*", pieces.encode(spark, F.col("text")).alias("e")).withColumn("d", pieces.decode(spark, F.col("e"))).collect()
    assert [r.e for r in got] == [library.encode(t or "", add_bos=True, add_eos=True) for _, t in rows]
    assert [r.d for r in got] == [t or "" for _, t in rows]
    assert all(r["n_tokens"] == "own" and r["a.b"] == 1 for r in got)
    assert df.limit(0).select(pieces.token_digests(spark, F.col("text"))).collect() == []
    assert spark.createDataFrame([(None,)], "i array<int>").select(pieces.decode(spark, F.col("i"))).first()[0] is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([32000],)], "i array<int>").select(pieces.decode(spark, F.col("i"))).collect()


# --- whitening


def expected(x, k=16):
    """Rows and components by numpy: fit on distinct rows."""
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (u * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    kept = min(k, int((e > e[0] * (len(e) * 2.0**-52) ** 2 * 100).sum()))
    return n, ((x * n - s) ** 2).sum(axis=1), ((x * n - s) / n) @ q[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        a = np.linalg.qr(rng.normal(size=(d, d)))[0] @ np.diag(np.logspace(0, -9, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
        v, s = whitening.jacobi(np.linalg.qr(a)[1])
        assert np.allclose(s, np.logspace(0, -9, d), rtol=1e-6)
        assert np.abs(v @ v.T - np.eye(d)).max() < 1e-13
    assert whitening.jacobi(np.zeros((3, 3)))[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize(("tasks", "block"), [(1, 1 << 20), (40, 1 << 20), (7, 64)])
def test_whitening_equals_numpy(spark, tasks, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (900, 9)) * np.arange(1, 10) + 1_000_000
    x[::3] = x[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "id long, v array<long>").repartition(tasks)
    fitted = df.select("v").distinct().repartition(tasks)
    model = whitening.fit(fitted, 16)
    n, deviation, white, explained = expected(x)
    got = {r.id: r.white for r in whitening.whitened(df, "v", model).collect()}
    assert model.n == n and len(got) == 900
    assert [got[i].deviation for i in range(900)] == deviation.tolist()
    assert np.abs(np.abs([got[i].whitened for i in range(900)]) - np.abs(white)).max() < 1e-9
    assert np.allclose(model.deviations**2 / model.trace, explained)
    assert whitening.identity_error(fitted, model) < 1e-12


def test_the_whitening_query(spark, tmp_path):
    """Vectors that take no part, repeated rows and ties, against numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    rows = [(i % 250, [float(c) for c in x[i // 2]]) for i in range(300)]
    rows += [(1, None), (2, [None] * 20), (3, [float("nan")] * 20), (4, [1.0] * 19 + [float("inf")]), (5, []), (6, [1.0, 2.0]), (7, [3e38] * 20), (None, [0.5] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "white": F.lit("own")})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_whitening(spark, str(tmp_path)).collect()
    ints = np.floor(64 * np.array([v for i, v in rows[:300]] + [[0.5] * 20])).astype(int) + 1_000_000
    n, deviation, white, explained = expected(ints)
    assert len(got) == 301 * 16 and {r.n for r in got} == {n}
    ids = [i for i, _ in rows[:300]] + [None]
    key = lambda v: (v[0] is None, v[0] or 0, *v[1:])
    want = sorted(((i, c + 1, int(d), round(abs(w[c]), 8)) for i, d, w in zip(ids, deviation, white, strict=True) for c in range(16)), key=key)
    assert sorted(((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 8)) for r in got), key=key) == want
    assert max(abs(r.explained - explained[r.component - 1]) for r in got) < 1e-12
    assert {r.identity_error < 1e-10 for r in got} == {True}


def test_whitening_without_variance(spark, tmp_path):
    for name, rows in (("same", [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), ("none", []), ("nulls", [(1, None)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert whitening.op12_whitening(spark, str(tmp_path / name)).collect() == []
    flat = spark.createDataFrame([([i, 2 * i, 5],) for i in range(10)], "v array<long>")
    assert len(whitening.fit(flat, 16).deviations) == 1  # of lower rank


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [1 << 50, 0]), (2, [0, 1 << 20]), (3, [0, 0])], "id long, v array<long>")
    got = {r.id: r.white.deviation for r in whitening.whitened(df, "v", whitening.fit(df.select("v"), 2)).collect()}
    assert got == {1: None, 2: None, 3: None}
    doubles = df.select("id", F.transform("v", lambda c: c.cast("double")).alias("v"))
    assert {r.white.deviation for r in whitening.whitened(doubles, "v", whitening.fit(doubles.select("v"), 2)).collect()} == {None}


# --- fill in the middle


def plain_middle(key, text):
    """(n, form, prefix, middle, output) of a text."""
    n, text = len(text or ""), text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_plain_python(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab\n é\U0001f600中́<PSM>\x00") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, None), (None, "no id"), (None, None), (7, "x<P>y"), (8, "<S"), (9, "q" * 3_000_000), (9, "same"), (9, "same")]
    clash = {"fim": F.lit(1), "n": F.lit("own"), "a.b": F.array(F.lit(2)), "key": F.lit(3), "c0": F.lit(4)}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    want = ("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")
    got = fill_middle.transformed(df, want=want)
    assert got.columns == ["doc_id", "text", "n", "a.b", "key", "c0", "fim"]
    got = got.collect()
    assert len(got) == len(rows)
    for r, (key, text) in zip(got, rows, strict=True):
        whole = plain_middle(key, text)
        assert tuple(r.fim)[:5] == whole, (key, text)
        assert (r.fim.restored, r.fim.output_sha256, r.fim.restored_sha256) == (text or "", sha(whole[4]), sha(text or ""))
        assert (r.n, r["a.b"], r.key, r.c0) == ("own", [2], 3, 4)
    assert fill_middle.transformed(df.limit(0)).collect() == []


def test_middles_of_words(spark):
    """Other units: words with the blanks after them; a text that they don't cover stays plain."""
    rows = [(i, "one two  three four") for i in range(30)] + [(i, " leading") for i in range(30)]
    got = fill_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*", plain_from=100, spm_below=50, marks=("[[1", "[[2", "[[3"), want=("n", "form", "output", "restored")).collect()
    assert {r.fim.form for r in got[:30]} == {"psm", "spm"} and {r.fim.n for r in got[:30]} == {4}
    assert all(r.fim.restored == r.text for r in got) and {r.fim.form for r in got[30:]} == {"plain"}
    with pytest.raises(ValueError, match="marks"):
        fill_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), marks=("<<<", "<S>", "<M>"))


def test_the_middle_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = fill_middle.op13_fill_middle(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output = plain_middle(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
