"""Very long and broken input: every operator reads it whole, in time that grows with its length."""

import random
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text, language_id, secret_scan, toxicity, url_filter
from millrace.llm.common import Workspace, bounded_sample


@contextmanager
def within(seconds):
    start = time.monotonic()
    yield
    assert time.monotonic() - start < seconds


# --- html


@pytest.mark.parametrize(
    "page, found",
    [
        ("<div>" * 100_000 + "x" + "</div>" * 100_000, 1),
        ("<a " * 300_000 + "'>", 0),
        ('<a x="' * 100_000 + ">y", 1),
        ('<a x="' * 100_001 + ">y", 1),
        ("<b>" + "<div>" * 50_000 + "</b>" * 50_000, 0),
        ("<div>" * 50_000 + "<dd></dd>" * 50_000, 0),
        ("</" * 200_000 + ">", 0),
        ("<" * 1_000_000, 1),
        ("<script>" + "</script " * 100_000, 0),
        ("<p>x" * 100_000, 100_000),
    ],
)
def test_pages_are_read_once(page, found):
    with within(10):
        assert len(html_text.blocks(page)) == found


def test_tags_and_references_as_browsers_read_them():
    text = lambda page: [t for _, t in html_text.blocks(page)]
    assert text("AT&<b>amp;</b>T") == ["AT&amp;T"] and text("AT&amp;T &lt;b>") == ["AT&T <b>"]
    assert text('<p title="a>b">c</p><p x=">d</p>') == ["c", "d"]
    assert text("<p>a</3 b>c") == ["ac"] and text("<p>a<b") == ["a"] and text("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == ["a", "b", "c", "d"]
    assert text("<dl><dt>a<dd>b<dt>c</dl>") == ["a", "b", "c"]


def test_classes_inside_an_article_drop_only_what_the_text_is_without():
    page = '<article><h2 class="social">a</h2><p class="related-work">b</p><div class="advert">c</div><div class="comments">d</div><p>e</p></article>'
    assert html_text.main_text(page, None) == "a\n\nb\n\ne"


def test_empty_table_of_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.extract(empty).count() == 0


# --- secrets


def test_running_sums(spark):
    rng = random.Random(5)
    for n in (0, 1, 127, 128, 129, 700):
        values = [rng.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "a array<int>").select(secret_scan.running(F.col("a")).alias("s")).first()["s"]
        assert got == [sum(values[: i + 1]) for i in range(n)]


def test_long_texts_are_scanned_whole(spark):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    texts = ["eyJ" * 1_000_000, "token=abcdef " * 300_000, "eyJaaaaaaaaa." * 200_000, "password" + " " * 1_000_000, "AKIA" * 300_000]
    versions = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with within(60):
        rows = secret_scan.findings_by_path(versions, secret_scan.scan_blobs(versions, None, rules), rules, ["doc_id"]).select("doc_id", F.size("found").alias("n"), F.slice("found", -1, 1).alias("last")).collect()
    found = {r["doc_id"]: r for r in rows}
    assert [found[i]["n"] for i in range(5)] == [0, 300_000, 66_666, 0, 1]
    assert [(s["start"], s["stop"]) for s in found[1]["last"]] == [(13 * 299_999, 13 * 299_999 + 12)]


def test_order_of_kinds_is_that_of_the_rules_asked_for(spark):
    versions = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    rules = (secret_scan.Rule("one", "a", 0, 0), secret_scan.Rule("two", "ab", 0, 0))
    ledger = secret_scan.scan_blobs(versions, None, rules)
    for asked in (rules, rules[::-1]):
        assert [s["kind"] for s in secret_scan.findings_by_path(versions, ledger, asked, ["doc_id"]).first()["found"]] == [r.kind for r in asked]


# --- urls


def test_hosts_of_many_dots(spark):
    rules = [("block", "a.b", "/"), ("allow", "x.a.b", "/"), ("block", "", "/z"), ("block", "c", "")]
    urls = ["http://" + "." * 200_000 + "x.a.b/", "http://" + "q." * 100_000 + "a.b/y", "http://" + "." * 100_000 + "/z", "http://b/", "http://a.b", "http://c?" + "." * 100_000]
    want = ["x.a.b/", "a.b/", "/z", None, None, "c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    with within(30):
        for got in (url_filter.filter_urls(pages, rules), url_filter.filter_urls_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))):
            assert [r["rule"] for r in got.orderBy("page_id").collect()] == want


# --- languages and toxicity


def test_one_word_of_a_million_letters(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    rows = [(1, long, "xx"), (2, "the cat and the dog", "en"), (3, "der hund und die katze", "de")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with within(60):
        model = language_id.Model.fit(labelled)
        asked = spark.createDataFrame([(1, long[:500_000] + "zz"), (2, "the dog"), (3, "die und")], "doc_id long, text string")
        assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(asked, model, "doc_id").collect()} == {1: "xx", 2: "en", 3: "de"}


def test_ngrams_are_counted_as_one_by_one(spark):
    words = [("en", "abcab", 3), ("en", "b", 1), ("de", "\U0001d4b3y", 2), ("de", "abcab", 5)]
    want = {}
    for lang, word, n in words:
        want[lang, 0, word] = n
        for k in range(1, language_id.LONGEST + 1):
            for g in language_id.grams(word, k):
                want[lang, k, g] = want.get((lang, k, g), 0) + n
    got = language_id._counts(spark.createDataFrame(words, "lang string, gram string, count long")).collect()
    assert {(r["lang"], r["n"], r["gram"]): r["count"] for r in got} == want and len(got) == len(want)


def test_numerals_are_no_letters(spark):
    model = language_id.Model.fit(spark.createDataFrame([(1, "one two", "en")], "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "²½ Ⅷ ① ٣ 12_"), (2, "²a½")], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language_id.predict(asked, model, "doc_id").collect()} == {1: ("und", False), 2: ("en", True)}
    assert language_id.letter_runs("x²日本Ⅷé") == ["x", "日本", "é"]


def test_sample_leaves_out_only_the_text_that_is_too_long(spark):
    rows = [(i, "x" * (1000 if i == 7 else 10)) for i in range(40)] + [(None, "x" * 10), (3, "x" * 10)]
    held = bounded_sample(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "test"), "doc_id", "text", 1600)
    assert sorted(r["doc_id"] for r in held.collect() if r["doc_id"] is not None) == sorted([*[i for i in range(40) if i != 7], 3])
    few = bounded_sample(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "test"), "doc_id", "text", 200)
    assert few.count() == 20


def test_toxicity_fits_beside_a_text_that_is_too_long(spark):
    rng = random.Random(4)
    plain, bad = ["calm", "river", "stone", "light", "green"], ["vileness", "scumbag", "hateful"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(30)) + (" " + " ".join(bad) * 3 if i % 2 else "")) for i in range(200)] + [(200, "z " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(201)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_chars=1 << 20)
    got = toxicity.score_documents(docs.filter("doc_id < 200").unionByName(spark.createDataFrame([(None, None), (300, "")], docs.schema)), model).collect()
    assert len(got) == 202 and all(0 <= r["score"] <= 1 for r in got)
    mean = lambda k: sum(r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2 == k) / 100
    assert mean(1) > mean(0)
