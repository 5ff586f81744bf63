"""Search, BPE, HTML, quality, toxicity, near-duplicates and the pipeline on small tables, against brute force."""

import hashlib
import math
import os
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from loomstone.llm import bpe, html_text, linear, near_dedup, quality, topk_search, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- search


def brute_top(rows, k):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = {}
    for q in ints:
        if q % 100 == 0:
            best = sorted((-dot(ints[q], v), i) for i, v in ints.items() if i != q)[:k]
            out |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "copies", "few", "clustered"])
def test_search_is_exact(spark, kind):
    rng = np.random.default_rng(5)
    n = 7 if kind == "few" else 1500
    x = rng.normal(size=(n, 6)).astype(np.float32)
    if kind == "copies":
        x[::3] = x[0]
    if kind == "clustered":
        x = x * 0.05 + rng.normal(size=(10, 6)).astype(np.float32)[rng.integers(0, 10, n)] * 3
    rows = [(i * (1 if kind != "few" else 50), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100_001, None), (100_100, [1.0, None]), (100_200, [float("nan")] * 6), (None, [1.0] * 6), (100_300, [float("inf")] * 6), (100_400, []), (100_500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    data = topk_search.quantised(df, "vec_id", "embedding")
    got = topk_search.search(data, data.filter("id % 100 = 0"), k=5, roots=8, subtree=100, page=16).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_search_is_exact_beyond_exact_floats(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 29), 1 << 29, (600, 3))
    x[::4] = x[0] + rng.integers(0, 2, (150, 3))
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "id long, v array<long>")
    got = topk_search.search(df, df.filter("id % 50 = 0"), k=5, roots=4, subtree=60, page=16).collect()
    scores = x.astype(object) @ x.astype(object).T
    expected = {}
    for q in range(0, 600, 50):
        best = sorted((-scores[q, i], i) for i in range(600) if i != q)[:5]
        expected |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == expected


def test_rings_hold_a_subtree_each():
    rng = random.Random(1)
    counted = [(root, step, rng.choice([1, 7, 40, 250]), step / 9, step / 9 + 0.05) for root in range(5) for step in range(30) if rng.random() < 0.8]
    rings, steps = topk_search.cut_rings(counted, 100)
    held = {}
    for (root, step, n, low, high), (r, s, first, number) in zip(sorted(counted), steps, strict=True):
        assert (root, step) == (r, s)
        ring = rings.first.tolist().index(first)
        assert rings.root[ring] == root and rings.low[ring] <= low and high <= rings.high[ring] and rings.number[ring] == number
        held[first, number] = held.get((first, number), 0) + n
    assert all(n <= 100 * number for (_, number), n in held.items())
    assert rings.first.tolist() == [0, *np.cumsum(rings.number)[:-1].tolist()]


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<long>")
    assert topk_search.search(df, df).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-50, 50, (4000, 8))).astype(float)
    most = float((x * x).sum(1).max())
    lifted = topk_search._lift(x, most)
    parent = lifted[0]
    tree = topk_search.build_pages(np.arange(4000), lifted, parent)
    told = {}
    for q in range(0, 4000, 400):
        got = topk_search.search_pages(tree, parent, q, x[q], topk_search.Space(most, 8), 10, -np.inf, told)
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:10]
        assert sorted(got, key=lambda g: (-g[0], g[1])) == [(int(scores[i]), int(i)) for i in order]
    assert told["members"] < 10 * 4000 / 2
    assert told["objects"] < 10 * len(tree["sizes"])


# --- BPE

ODD = ["", " ", "a<|endoftext|>b  c", "<|endoftext|>", "\n\n\t x  y", "don't I'LL we'll", "x" * 5000, " " * 999, "日本語 العربية 😀👨‍👩‍👧", "é" * 300 + " é", "a\u0085b\x1cc", "<|endoftext|><|endoftext|>", "﻿word"]


@pytest.fixture(scope="module")
def tokenizers():
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_encodings_equal_the_library(tokenizers):
    rng = random.Random(4)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(150)) for _ in range(60)]
    encoder = bpe.Encoder(bpe.Vocabulary(open(bpe.tokenizer_path()).read()))
    for text, (ids, n), truth in zip(texts, encoder.encoded(texts), tokenizers.encode_batch(texts, add_special_tokens=False), strict=True):
        assert (ids, n) == (",".join(map(str, truth.ids)), len(truth.ids))
        assert encoder.decoded(ids) == tokenizers.decode(truth.ids, skip_special_tokens=False)


def test_both_splits_into_words_agree():
    encoder = bpe.Encoder(bpe.Vocabulary(open(bpe.tokenizer_path()).read()))
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice([chr(rng.randrange(0x250)), rng.choice(" '\n\t-as09éß\u2019ŉ×÷ªºµ²½")]) for _ in range(12))
        if encoder.latin(text):
            assert encoder.latin_word(text) == encoder.any_word(text), repr(text)
    assert encoder.latin("Où sont-ils? «l'été» 12") is None and encoder.latin("Où sont-ils? l'été \u2013 12")


def test_kept_words_change_nothing(tokenizers, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 2)
    encoder = bpe.Encoder(bpe.Vocabulary(open(bpe.tokenizer_path()).read()))
    for _ in range(2):
        for text, (ids, _) in zip(ODD, encoder.encoded(ODD), strict=True):
            assert ids == ",".join(map(str, tokenizers.encode(text, add_special_tokens=False).ids))
    assert len(encoder.words) <= 3


def test_bpe_query_equals_the_library(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in bpe.op4_bpe(spark, "/root/testdata/sf0.001").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc_id, text in docs:
        ids = tokenizers.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id] == (doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizers.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)
    assert spark.createDataFrame([], "doc_id long, text string").select(bpe.token_digests(spark, F.col("text")).alias("t")).count() == 0


def test_round_trip(spark, tokenizers):
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id long, text string")
    ids = df.withColumn("ids", bpe.encode(spark, F.col("text")))
    got = {r.doc_id: (r.ids, r.back) for r in ids.withColumn("back", bpe.decode(spark, F.col("ids"))).collect()}
    assert {i: back for i, (_, back) in got.items()} == dict(enumerate(ODD)) | {99: ""}
    full = {r.doc_id: r.t for r in df.select("doc_id", bpe.tokenized(spark, F.col("text")).alias("t")).collect()}
    assert all(full[i].ids == ids and full[i].n_tokens == len(ids) for i, (ids, _) in got.items())


# --- HTML


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
      <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies</div>
      <article class="post"><h1>Head &amp; tail</h1><p><b>One <i>t</i>wo<br>three<p>caf&#233; &lt;x&gt;<form><input>Search</form><aside>Side</aside>
      <div id="comments"><p>First!</p></div></article><footer>&copy; x</footer>"""
    assert texts_of(spark, [(1, "https://a.example/x", page, None), (2, None, None, None), (3, "x", "", "t"), (4, "https://a.example", "<p>a <b>b", None)]) == {1: "Head & tail One two three café <x>", 2: "", 3: "", 4: "a b"}


def test_templates_go_and_articles_stay(spark):
    frame = '<div><div><span>Best offers of {h}</span></div><div><p>{t}</p><p>shared passage</p></div></div>'
    rows = [(i, f"https://{h}.example/{i}", frame.format(h=h, t=f"text {i} of its own, and long enough"), None) for i in range(30) for h in [f"h{i % 2}"]]
    got = texts_of(spark, rows)
    assert all(got[i] == f"text {i} of its own, and long enough" for i in range(30))
    inside = [(i, "https://a.example/", f"<article><p>text {i}</p><p>shared passage</p></article>" if i % 2 else f"<article><p>text {i}</p></article>", None) for i in range(40)]
    assert texts_of(spark, inside)[1] == "text 1 shared passage"
    assert texts_of(spark, []) == {}


def test_text_beside_an_article_stays(spark):
    main = "the main text number {i} is long, and it stands in a block beside the card " + "{i} " * 20
    page = "<div><p>one frame for all</p></div><div><p>" + main + "</p></div><article><p>card {i}</p></article>"
    got = texts_of(spark, [(i, "https://a.example/", page.format(i=i), None) for i in range(6)])
    assert got == {i: " ".join(main.format(i=i).split()) + f" card {i}" for i in range(6)}
    framed = "<div><p>one frame for all</p></div><div><p>other {i}</p></div><article><p>" + main + "</p></article>"
    got = texts_of(spark, [(i, "https://a.example/", framed.format(i=i), None) for i in range(6)])
    assert got == {i: " ".join(main.format(i=i).split()) for i in range(6)}


def test_copies_of_a_page_count_once(spark):
    page = "<{tag}><p>the first paragraph</p><p>the second paragraph</p><p>and a third</p></{tag}>"
    text = "the first paragraph the second paragraph and a third"
    for tag in ("div", "article"):
        copies = [(i, "https://a.example/", page.format(tag=tag), None) for i in range(12)]
        other = [(100, "https://a.example/", f"<{tag}><p>one page of its own</p></{tag}>", None)]
        assert texts_of(spark, copies + other) == {i: text for i in range(12)} | {100: "one page of its own"}
    wrapped = [(i, "https://a.example/", "<div>" * i + page.format(tag="section"), None) for i in range(4)]
    assert texts_of(spark, wrapped) == {i: text for i in range(4)}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<div class='layout has-sidebar'><article>a long text</article><div class='sidebar'>side</div></div>", ["a long text"]),
        ("<main><div id='share-page'><div class='notice'><article><p>one<p>two</article></div></div></main>", ["one", "two"]),
        ("<div class='disclaimer page'><p>most of the text</p></div><p>rest</p><div class='disclaimer'>note</div>", ["most of the text", "rest"]),
        ("<div class='sidebar'><article class='teaser'>card</article></div><article>a text</article>", ["a text"]),
        ("<div class='sidebar'><article class='box-disclaimer'>a text</article></div><p>more than the text</p>", ["a text", "more than the text"]),
        ("<div class='ad'>an advert that is longer than the text</div><article>a text</article>", ["a text"]),
        ("<div class='menu'><nav><article>card</article></nav></div><p>text</p>", ["text"]),
        ("<script>s='<!--'</script><article>a text</article>", ["a text"]),
        ("<p title='<!--'>a text</p><p>b</p>", ["a text", "b"]),
        ("<p>a text<!-- b --></p><p>c<!-- <p>d", ["a text", "c"]),
        ("<p>a</p><!-- x <script>s='<!--'</script> --><p>b</p>", ["a", "b"]),
    ],
)
def test_names_and_comments_leave_out_no_article(page, expected):
    assert [t for t, _, other in html_text.parsed(page)[0] if not other] == expected


def test_broken_and_deep_markup():
    assert html_text.parsed("<div>" * 3000 + "x")[0][0][0] == "x"
    assert [t for t, _, _ in html_text.parsed("<p>a</b></p></p><table><tr><td>b<td>c<tr><td>d")[0]] == ["a", "b", "c", "d"]
    assert html_text.parsed("<!-- x") == html_text.parsed(" ") == ([], [])


# --- classifiers


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < linear.sigmoid(x @ [2.0, -1.0, 0.0] + 0.5)).astype(float)
    assert linear.fit_logistic(x, y) == pytest.approx([2.0, -1.0, 0.0, 0.5], abs=0.25)
    assert linear.fit_logistic(x, np.ones(2000))[:-1] == pytest.approx([0, 0, 0])
    rows = [sorted(rng.choice(50, 10, replace=False).tolist()) for _ in range(1000)]
    y = np.array([float(7 in r) for r in rows])
    b = linear.fit_sparse_logistic(linear.Incidence(rows, 50), np.zeros((1000, 0)), y, np.ones(1000), 1e-3)
    assert np.argmax(b[:-1]) == 7


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet")
    out = quality.op6_quality(spark, DATA.replace("0.001", "0.1"))
    assert out.count() == docs.count()
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet")
    rows = out.filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [1 - r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) > 0.8


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert [r.s for r in docs.select(quality.score(F.col("text"), model).alias("s")).collect()] == pytest.approx([0.5] * 3)


def test_toxicity_on_rows_not_learned_from(spark):
    sf = DATA.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, toxicity.label_categories(labels.filter("doc_id % 4 <> 0")), list(toxicity.CATEGORIES))
    rest = docs.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("toxic", toxicity.score(F.col("text"), chain)["toxic"].alias("p")).collect()
    found = [r.p >= 0.5 for r in rest if r.toxic]
    clean = [r.p < 0.5 for r in rest if not r.toxic]
    assert sum(found) / len(found) > 0.8  # few examples of each word here; on the larger tables nearly all
    assert sum(clean) / len(clean) > 0.995


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad word", 5), (2, None, 6), (3, "", 7), (None, "good", 8), (1, "bad word", 9)], "doc_id long, text string, is_toxic int")
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(docs, labels).count() == 5
    assert toxicity.judge(docs, labels.limit(0)).count() == 5
    assert toxicity.judge(docs.limit(0), labels).count() == 0


# --- near-duplicates


def brute_classes(rows):
    words = [(t or "").split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same or alike:
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, least.get(find(i))) for i, (key, _) in enumerate(rows) if key is not None)


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3 + g % 2, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(10_000 + i, passage + " " + " ".join(word() for _ in range(rng.choice([5, 40])))) for i in range(15)]
    rows += [(20_000, ""), (20_001, None), (20_002, " \n"), (20_003, "one two"), (20_004, "one  two"), (20_005, "one three"), (None, "one two"), (20_006, "w " * 20_000), (20_007, "w " * 19_000), (20_000, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_classes(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classes(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.key, r.class_id) for r in got if r.key is not None) == brute_classes(rows)
    kept = near_dedup.deduplicate(df.withColumn("node", F.lit("clash"))).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_classes(rows)})


def test_repetitions_hide_no_near_duplicates(spark):
    rows = []
    for i in range(16):
        line, rest = " ".join(f"l{i}x{j}" for j in range(10)), " ".join(f"r{i}x{j}" for j in range(16))
        rows += [(2 * i, f"{line} {line} {rest}"), (2 * i + 1, " ".join([line] * 51) + f" {rest}")]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.key, r.class_id) for r in got) == brute_classes(rows) == [(i, i // 2 * 2) for i in range(32)]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.classes(df).count() == near_dedup.deduplicate(df).count() == 0
    apart = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert near_dedup.deduplicate(apart).count() == 2


def test_shingles_are_told_apart_by_their_words_alone():
    rng = random.Random(5)
    words = [rng.choice(["a", "é", "日本", "x" * 1500, "y" * 1500, "ab", "b"]) for _ in range(40_000)]
    tuples = list(zip(*(words[i:] for i in range(5)), strict=False))
    hashes = near_dedup.Shingler().shingles("\n ".join(words)).tolist()
    assert len(hashes) == len(tuples)
    assert len(set(hashes)) == len(set(tuples)) == len(set(zip(hashes, tuples, strict=True)))


def test_parities_exclude_no_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in [1, 5, 100, 127, 128, 129, 1000, 5000] * 12:
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        share = rng.choice([0.6, 0.85, 0.9, 0.95, 1])
        other = np.unique(np.r_[one[: int(len(one) * share)], rng.integers(0, 1 << 63, int(n * (1 - share))).astype(np.uint64)])
        both = len(np.intersect1d(one, other))
        rows.append((len(one), near_dedup.parities(one).tolist(), len(other), near_dedup.parities(other).tolist(), both / (len(one) + len(other) - both)))
    got = spark.createDataFrame(rows, "n int, p array<long>, n2 int, p2 array<long>, s double").withColumn("may", near_dedup.may_be_alike("n", "p", "n2", "p2")).collect()
    assert all(r.may for r in got if r.s >= near_dedup.ALIKE)
    assert not any(r.may for r in got if r.s < 0.7 and r.n >= 100)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    a = {int(h): float(w) for h, w in zip(rng.integers(0, 2**63, 200), rng.integers(1, 5, 200), strict=True)}
    b = {h: w * (1 + (i % 3 == 0)) for i, (h, w) in enumerate(a.items()) if i < 160}
    hashes = np.array([*a, *b], dtype=np.uint64)
    s = near_dedup.sign(hashes, np.array([*a.values(), *b.values()]), np.repeat([0, 1], [len(a), len(b)]), 2)
    both = set(a) & set(b)
    truth = sum(1 / (sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b))) for i in both)
    assert (s[0] == s[1]).mean() == pytest.approx(truth, abs=0.12)


# --- the pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, DATA).cache()
        seen[name] = before
        if name != "bpe":
            assert before.columns == docs.columns
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert all(labels.get(i) != 0 for i in {r.doc_id for r in docs.collect()} - kept)
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == sorted({c for _, c in brute_classes([(r.doc_id, r.text) for r in seen["toxicity"].collect()])})
    assert {r.doc_id for r in seen["mixing"].collect()} == {r.doc_id for r in seen["secret_scan"].collect()}
    assert seen["bpe"].count() == seen["mixing"].count() == corpus_pipeline.run(spark, DATA).count()
