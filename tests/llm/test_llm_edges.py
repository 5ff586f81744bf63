"""Columns of any names, repeated ids and empty tables, through every operator that carries columns."""

import os
import urllib.parse

import pyspark.sql.functions as F
import pytest

from loomstone.llm import html_text, linear, mixing, near_dedup, quality, secret_scan, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, or that need quoting.
CLASHES = ("a.b", "c d", "row", "spans", "key", "id", "__row", "__name", "__spans", "mix_tokens", "mix_at", "block", "epoch", "tokens", "hash", "label", "node", "is_toxic", "p_toxic", "__p")


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def docs_with_clashes(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA))


ROWS = [(i, f"some text number {i} token=value{i}aa and more of it", "en", f"s{i % 3}", 50) for i in range(20)] + [(None, None, None, None, None), (1, "other text", "en", "s1", 10), (2, "", "en", "s1", 0)]


def same_columns(got, docs):
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    return rows


def test_mixing_keeps_columns_of_any_names(spark):
    docs = docs_with_clashes(spark, ROWS)
    rows = same_columns(mixing.mixed(docs, docs.columns, whole=True, target=None, repetitions=1.25, added=False), docs)
    assert {(r.doc_id, r.text) for r in rows} == {r[:2] for r in ROWS}
    full = mixing.mixed(docs, docs.columns, whole=True)
    assert sorted(full.columns) == sorted({*docs.columns, *mixing.ADDED})
    assert all(r.mix_tokens >= 1 and r["a.b"] == "own a.b" for r in full.collect())


def test_mix_equals_a_plain_walk_over_its_blocks(spark):
    """The mix, by brute force: blocks of each source in the order of their hashes, epoch by epoch, until the budget is met."""
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 2}", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.source, r.doc_id, r.mix_epoch): r.mix_block for r in mixing.mixed(docs, ["doc_id", "source"]).collect()}
    tokens = {}
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + max(1, len(r[1].split()))
    mix = mixing.solve(tokens, float(sum(tokens.values())))
    blocks = {r.doc_id: r.b for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(mixing.LEAST_BLOCKS)).alias("b")).collect()}
    members = {}
    for r in rows:
        members.setdefault((r[3], blocks[r[0]]), []).append(r)
    keys = [(s, b, e) for s, b in members for e in range(4)]
    order = {(r.s, r.b, r.e): r.o & (1 << 64) - 1 ^ 1 << 63 for r in spark.createDataFrame(keys, "s string, b long, e int").select("*", F.xxhash64("s", "b", "e", F.lit(mixing.SEED)).alias("o")).collect()}
    expected = {}
    for s in tokens:
        spent, epoch = 0, 0
        while spent < mix.budgets[s]:
            for _, b in sorted((order[s, b, epoch], b) for t, b in members if t == s):
                if spent < mix.budgets[s]:
                    expected |= {(s, r[0], epoch): b for r in members[s, b]}
                spent += sum(max(1, len(r[1].split())) for r in members[s, b])
            epoch += 1
    assert got == expected


def test_redaction_keeps_columns_of_any_names(spark):
    docs = docs_with_clashes(spark, ROWS)
    rows = same_columns(secret_scan.redact(docs), docs)
    by = {(r.doc_id, r.text) for r in rows}
    assert len(rows) == len(ROWS)
    assert {(i, f"some text number {i} [SECRET] and more of it") for i in range(20)} | {(None, None), (1, "other text"), (2, "")} == by


def test_near_duplicates_keep_columns_of_any_names(spark):
    docs = docs_with_clashes(spark, [*ROWS, (77, ROWS[0][1], "en", "s", 3)])
    rows = same_columns(near_dedup.deduplicate(docs), docs)
    assert {r.text or "" for r in rows} == {r[1] or "" for r in ROWS}


def test_toxicity_keeps_columns_of_any_names(spark):
    docs = docs_with_clashes(spark, ROWS)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    same_columns(toxicity.without_toxic(docs, labels), docs)
    judged = toxicity.judge(docs, labels)
    assert judged.count() == len(ROWS)
    assert dict(judged.dtypes)["is_toxic"] == "int"
    assert judged.columns == [*docs.columns, "p_degraded"]
    assert {r["__p"] for r in judged.collect()} == {"own __p"}


def test_samples_are_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "bad text")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    sample, _ = toxicity._sampled(docs, toxicity.label_categories(labels), ["degraded", "toxic"], 10, 10)
    assert sorted(tuple(r) for r in sample.collect()) == [(1, 0, 0, "text 0"), (2, 1, 1, "bad text")]
    model = quality.fit(docs, labels.drop("toxic"))
    assert docs.limit(3).select(quality.score(F.col("text"), model).alias("s")).filter("s between 0 and 1").count() == 3


def test_one_label_of_quality_only(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(30)] + [(99, "x" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    scores = [r.s for r in docs.select(quality.score(F.col("text"), quality.fit(docs, labels)).alias("s")).collect()]
    assert len(set(scores)) == 1 and 0.5 < scores[0] < 1


def test_masked_features_are_left_out():
    x = linear.Incidence([[0, 2], [1], [], [0, 1, 2]], 3)
    assert x.only([0]).times(__import__("numpy").array([1.0, 10.0, 100.0])).tolist() == [1, 0, 0, 1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_pipeline_of_no_documents_and_of_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, table in (("empty", docs.limit(0)), ("clash", with_clashes(docs.limit(60)))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/clash").count() > 0


# --- HTML


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a</p><script><!-- code</script><p>article text</p>", "a article text"),
        ('<p title="<!--">a</p>', "a"),
        ('<article class="card">teaser</article><div>the long text of the page, which is in a div</div>', "teaser the long text of the page, which is in a div"),
        ('<article><section id="legal">law</section><div class="ad-hoc-report">report</div><div class="post-comment-free">free</div></article>', "law report free"),
        ('<article>in<div class="ad-banner">buy</div><div class="comment-list">c1</div><div id="cookieNotice2">ok</div></article>', "in"),
        ('<div class="layout has-sidebar"><article>in</article></div><div class="sidebar left">no</div>', "in"),
        ("a<!-- hidden", "a"),
        ("<p>one<p>two<ul><li>three<li>four</ul>", "one two three four"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ],
)
def test_main_text_of_odd_pages(spark, page, expected):
    got = html_text.extract(spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string")).first()
    assert got.text == expected


def test_html_keeps_columns_of_any_names(spark):
    df = spark.createDataFrame([(i, "https://a.example/", f"<p>page {i}") for i in range(4)] + [(9, None, None)], "page_id long, url string, html string")
    docs = df.withColumns({c: F.lit(f"own {c}") for c in (*CLASHES, "host", "blocks", "subtrees", "off")})
    got = html_text.extract(docs)
    assert got.columns == [*(c for c in docs.columns if c != "html"), "text"]
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in ("host", "key", "a.b", "row"))
    assert {r.page_id: r.text for r in rows} == {**{i: f"page {i}" for i in range(4)}, 9: ""}


def test_deep_pages_stay_linear():
    blocks, subtrees = html_text.parsed("<div>x" * 30_000)
    assert len(blocks) == 30_000 and len(subtrees) <= 30_000
    assert len(html_text.parsed("<div>x</p></td></b>" * 20_000)[0]) == 20_000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_html_query_against_brute_force(spark, tmp_path):
    """The registered query over the driver's pages and a site with a frame in plain divs, against counts by hand."""
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    frame = "<div><b>Offers of the week</b></div><div class=x><p>page {i} has a long text of its own, number {i}</p><p>shared {k}</p></div><div>Imprint</div>"
    pages += [(100_000 + i, f"https://Plain.example/{i}", frame.format(i=i, k=i % 30)) for i in range(60)] + [(100_100, "https://plain.example/0", frame.format(i=0, k=0)), (100_101, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    host = lambda u: urllib.parse.urlsplit(u or "").hostname or ""
    read = {p: html_text.parsed(h) for p, _, h in pages}
    contents, seen = {}, {}
    for p, u, _ in pages:
        blocks, subtrees = read[p]
        content = tuple(b[0] for b in blocks)
        contents.setdefault(host(u), set()).add(content)
        for h, inside, *_, kind in subtrees:
            seen.setdefault((host(u), h, inside, kind), set()).add(content)

    def template(u, h, inside, kind):
        n, of = len(seen[host(u), h, inside, kind]), len(contents[host(u)])
        if kind == html_text.NAMED:
            return n >= 3 or len({k[0] for k in seen if k[1] == h and k[3] == kind}) >= 3
        if inside:
            return n >= max(10, 0.6 * of)
        return n >= 3 and n >= (0.005 if kind == html_text.CONTAINER else 0.6) * of

    expected, deleted = {}, 0
    for p, u, _ in pages:
        blocks, subtrees = read[p]
        off = {(i, inside) for h, inside, a, b, _, kind in subtrees if template(u, h, inside, kind) for i in range(a, b + 1)}
        deleted += len(off)
        expected[p] = " ".join(t for i, (t, inside, other) in enumerate(blocks) if not other and (i, inside) not in off)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op5_html_extraction(spark, str(tmp_path)).collect()}
    assert got == {p: (t, len(t)) for p, t in expected.items()}
    assert deleted > 100
    assert got[100_001][0] == "page 1 has a long text of its own, number 1 shared 1"


def main_texts(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_sentences_that_some_stories_share_stay(spark):
    """On a host of 50 pages, three share a paragraph; what most of them share goes."""
    page = "<div><p>story {i} with a text of its own that goes on for some time</p>{shared}<p>imprint of the host</p></div>"
    got = main_texts(spark, [("https://a.example/", page.format(i=i, shared="<p>a sentence of three</p>" if i < 3 else "")) for i in range(50)])
    assert all(got[i] == f"story {i} with a text of its own that goes on for some time" + (" a sentence of three" if i < 3 else "") for i in range(50))


def test_a_story_beside_its_article_stays(spark):
    page = "<article>two sentences. of a story</article><div><p>second half</p></div>"
    frame = "<article>a long text {i} that holds most of its page</article><div class=x><h2>More</h2><ul><li>card {i}</li></ul></div>"
    got = main_texts(spark, [("https://a.example/", page), *(("https://b.example/", frame.format(i=i)) for i in range(10)), ("https://b.example/", page)])
    assert got[0] == got[11] == "two sentences. of a story second half"
    assert {got[i] for i in range(1, 11)} == {f"a long text {i} that holds most of its page" for i in range(10)}


def test_a_form_around_a_page_is_the_page(spark):
    page = "<body><form action=x><nav>menu</nav><h1>Title</h1><p>text of the page</p><form><label>Search</label></form><footer>f</footer></form></body>"
    got = main_texts(spark, [("https://a.example/", page), ("https://a.example/l", "<form><label>User</label><label>Password</label></form>"), ("https://a.example/a", "<article>text</article><form><p>your name</p><p>your mail</p></form>")])
    assert got == {0: "Title text of the page", 1: "", 2: "text"}


def test_names_that_may_mean_something_else_need_the_count(spark):
    story = "<p>a story about the market</p><p>with a long first part</p><div class='share'><p>Share of the market went to 5 per cent</p></div>"
    button = "<article>text {i} of this page</article><div class='share-box'><b>Share</b> {i}</div>"
    got = main_texts(spark, [("https://a.example/", story), *((f"https://b{i % 4 if i < 4 else 9}.example/", button.format(i=i)) for i in range(8))])
    assert got[0] == "a story about the market with a long first part Share of the market went to 5 per cent"
    assert {got[i + 1] for i in range(8)} == {f"text {i} of this page" for i in range(8)}


def test_counts_decide(spark, monkeypatch):
    """Without the count all of a site's frame stays."""
    page = "<div><b>Offers</b> <i>of the week</i><p>now</p></div><div><p>text {i} of its own</p></div><div class='notice'>seen {i} times</div>"
    pages = [("https://a.example/", page.format(i=i)) for i in range(6)]
    assert set(main_texts(spark, pages).values()) == {f"text {i} of its own" for i in range(6)}
    monkeypatch.setattr(html_text, "LEAST_PAGES", 100)
    assert set(main_texts(spark, pages).values()) == {f"Offers of the week now text {i} of its own seen {i} times" for i in range(6)}
