"""BPE, HTML extraction, URL filter."""

import html
import math
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest
from brute import WORDS, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dietlens.llm import bpe, html_text, url_filter
from dietlens.session import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_library(vocabulary, library):
    rng = random.Random(1)
    parts = list(" \n\t  aàb'sé.,1²３　\x85\xa0\x1c​日本😀́ABtheing") + ["<|endoftext|>", "'ll", " the", "  ", "aaaa", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "  ", "   ", "a" * 5000, "ab" * 3000, " " * 999, "\n " * 77, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    ids, ends = bpe.Encoder(vocabulary).encode(texts)
    at = 0
    for k, text in enumerate(texts):
        assert ids[at : ends[k]].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at = ends[k]


def test_memory_bound_changes_nothing(vocabulary, monkeypatch):
    texts = [f"some words {k} and others {k * 7}" for k in range(200)]
    want = bpe.Encoder(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "MAX_UNITS", 10)
    encoder = bpe.Encoder(vocabulary)
    assert [i for t in texts for i in encoder.encode([t])[0].tolist()] == want


def test_round_trip_of_tables(vocabulary, library, odd_docs, no_docs, docs):
    for table in (odd_docs, docs):
        rows = bpe.encode(table.withColumn("whole", F.col("text")), vocabulary, keep=["doc_id", "whole"], decoded="back")
        for r in rows.collect():
            text = r.whole or ""
            assert r.ids == library.encode(text, add_special_tokens=False).ids and r.back == text
    again = bpe.decode(bpe.encode(odd_docs, vocabulary, keep=["doc_id", "text"]), vocabulary, keep=["text"])
    assert all(r.decoded == (r.text or "") for r in again.collect())
    assert bpe.encode(no_docs, vocabulary, decoded="back").count() == 0


def test_broken_ids_decode_like_the_library(vocabulary, library, spark):
    ids = [[40, 220, 1849, 95, 100, 200], [50256, 11], [], [188, 188, 40]]
    got = bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id int, ids array<int>"), vocabulary)
    assert {r.doc_id: r.decoded for r in got.collect()} == {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(ids)}


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div id=main><h1>Title   here</h1>
<p>This is a long paragraph about something &eacute;tonnant, with <b>bold</b> text and a <a href=z>link</a> in it. It goes on.</p>
<p>Short.<div class="ad">Buy now!</div><ul><li>First point of the article.<li>Second point of the article.</ul>
<p>Another longer closing paragraph, which says more about it.</p><script>if (a < b) x("</p>");</script>
<section class="comments"><h2>Comments</h2><p>Great post, I liked it a lot and will come back.</p></section></div>
<aside><p>Related stories are listed here for you.</p></aside><form><label>Mail</label><input></form><footer>&copy; All rights reserved.</footer>"""
TEXT = """Title here
This is a long paragraph about something étonnant, with bold text and a link in it. It goes on.
Short.
First point of the article.
Second point of the article.
Another longer closing paragraph, which says more about it."""


def article(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_articles_of_all_pages(pages):
    model = html_text.train(pages)
    for r in html_text.extract(pages, model, keep=["page_id", "html"]).collect():
        assert r.text == article(r.html)
    assert model.extract(PAGE) == TEXT


def test_held_out_pages_without_article_tags(pages):
    """Fitted on half of the pages; on the others the article is a plain element."""
    model = html_text.train(pages.filter("page_id % 2 = 0"))
    held = pages.filter("page_id % 2 = 1").collect()
    right = sum(model.extract(r.html.replace("article>", "section>")) == article(r.html) for r in held)
    assert right >= 0.9 * len(held)


def test_marginals_equal_enumeration():
    model = html_text.Model({})
    page = html_text.Page("<div class=ad><p>One two.</p></div><p>Three <a>four</a></p>")
    n, states = len(page.parent), range(3)
    total, content = 0.0, [0.0] * n
    for code in range(3**n):
        chosen = [code // 3**k % 3 for k in range(n)]
        p = 1.0
        for node, state in enumerate(chosen):
            p *= model.step[chosen[page.parent[node]]][state] if node else 1.0
            for sign in page.signs[node]:
                p *= model.sign.get(sign, (1.0,) * 3)[state]
        total += p
        for node in range(n):
            content[node] += p * (chosen[node] == html_text.CONTENT)
    assert list(states) and model.marginals(page) == pytest.approx([c / total for c in content])


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "just text, no markup at all."), (None, "u", "<p>" * 3000), (5, "u", "<article><p>a&nbsp;&amp;b &lt;c&gt;&bogus;"),
        (6, "u", "<article><p>One.<!-- <p>no</p>"), (6, "u", "<article><p>One.<!-- <p>no</p>"), (7, "u", "<a \"" * 20_000), (8, "u", "<article><p>x < y and <b>z</p></article>"),
    ]
    table = materialize(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"))
    model = html_text.train(table)
    got = html_text.extract(table, model).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by_id[1] == by_id[2] == by_id[None] == ""
    assert by_id[5] == "a &b <c>&bogus;" and by_id[6] == "One." and by_id[8] == "x < y and z"
    assert html_text.extract(table.filter("false"), html_text.train(table.filter("false"))).count() == 0


def test_quoted_values_of_any_length():
    value = "<p>hidden > text</p>" * 1_000
    for quote in "'\"":
        page = html_text.Page(f"<article><div class=a data-state={quote}{value}{quote} id=b><p>One two.</p></div></article>")
        assert list(page.text.values()) == ["One two."] and len(page.parent) == 5
    assert list(html_text.Page("<p title=\"open>One.</p><p>Two's.</p>").text.values()) == ["One.", "Two's."]
    started = time.monotonic()
    for unit in ("<a \"", "<a '>\"", "<a \">\"\" '", "<a '\">' "):
        html_text.Page(unit * 100_000 + ">")
    assert time.monotonic() - started < 30


def test_end_tag_of_head_may_be_left_out():
    def texts(source):
        return list(html_text.Page(source).text.values())

    head = "<html><head><meta charset=utf-8><title>x</title><style>p {}</style><noscript><p>No.</p></noscript> <template><p>No.</template>\n"
    for rest in ("<h1>One</h1><p>Two.", "</head><body><h1>One</h1><p>Two.", "</head><h1>One</h1><p>Two.", "<body><h1>One</h1><p>Two.", "One<p>Two.", "<link><h1>One</h1><svg><text>No</text></svg><p>Two."):
        assert texts(head + rest) == ["One", "Two."]
    assert texts("<head><title>x</title><textarea>No.</textarea>One<p>Two.") == ["One", "Two."]
    assert html_text.Model({}).extract("<html><head><title>x</title><h1>Head</h1><article><p>One two three.</p></article>").endswith("One two three.")


def generated(rng):
    """A page and the text of its article, block by block."""
    said = []

    def say(words):
        said.append(words)
        return words

    def some(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    def paragraph():
        return f"<p>{say(some(rng.randrange(8, 60)).capitalize() + '.')}</p>"

    def part():
        kind = rng.randrange(8)
        if kind < 3:
            return paragraph()
        if kind == 3:
            tag, end = rng.choice(["ul", "ol"]), rng.choice(["", "</li>"])
            return f"<{tag}>" + "".join(f"<li>{say(some(rng.randrange(1, 4)))}{end}" for _ in range(rng.randrange(1, 9))) + f"</{tag}>"
        if kind == 4:
            head = f"<thead><tr><th>{say('Head')}</th></tr></thead>"
            rows = ["".join(f"<td>{say(some(1) + str(rng.randrange(99)))}</td>" for _ in range(3)) for _ in range(rng.randrange(1, 5))]
            return f"<table>{head}<tbody>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</tbody></table>"
        if kind == 5:
            return f"<dl><dt>{say(some(1))}<dd>{say(some(3))}</dl>"
        if kind == 6:
            return f"<h2>{say(some(2))}</h2><p>{say(some(2).capitalize() + '.')}</p>"
        return f"<ul><li><a href=x>{say(some(2))}</a></li><li><a href=y>{say(some(1))}</a></li></ul>"

    links = "".join(f"<li><a href=/{k}>{some(1)}</a>" for k in range(rng.randrange(1, 9)))
    around = [
        f"<nav><ul>{links}</ul></nav>", f"<div class='site-menu'><ul>{links}</ul></div>", f"<aside><p>{some(20)}.</p></aside>", f"<div id=cookie-notice>{some(9)}.</div>",
        f"<header><p>{some(5)}</p></header>", f"<div class=sidebar><table><tr><td>{some(2)}</td></tr></table></div>", f"<form><p>{some(6)}</p></form>",
    ]
    behind = [f"<section class=comments><ul><li>{some(25)}.</li></ul><p>{some(15)}.</p></section>", f"<footer><p>{some(12)}.</p><ul>{links}</ul></footer>", f"<div class=ad>{some(4)}.</div>"]
    rng.shuffle(around)
    inside = [paragraph()] + [part() for _ in range(rng.randrange(1, 12))]
    inside.insert(rng.randrange(len(inside)), f"<div class=advert>{some(6)}.</div>")
    page = f"<html><head><title>{some(3)}</title></head><body>{''.join(around[:4])}<article>{''.join(inside)}</article>{''.join(behind)}</body></html>"
    return page, "\n".join(said)


def test_articles_keep_lists_tables_and_short_paragraphs():
    rng = random.Random(5)
    made = [generated(rng) for _ in range(300)]
    total = Counter()
    for source, _ in made[:150]:
        page = html_text.Page(source)
        total.update(html_text.counts(page, html_text.labels(page)))
    plain = [(f"<article><h1>One</h1><p>{prose(k, 40)}.</p></article>", None) for k in range(200)]
    few = Counter()
    for source, _ in plain:
        page = html_text.Page(source)
        few.update(html_text.counts(page, html_text.labels(page)))
    for model in (html_text.Model(total), html_text.Model(few), html_text.Model(total + few)):  # `few` has never seen a list
        assert [k for k, (source, text) in enumerate(made[150:]) if model.extract(source) != text] == []
    items = "<article><ul><li>Milk</li><li>Two eggs</li><li>Salt</li><li>Rye</li><li>Oil</li></ul></article>"
    assert html_text.Model(few).extract(items) == "Milk\nTwo eggs\nSalt\nRye\nOil"


@pytest.mark.parametrize("source", [
    "<a><div>" + "<span>" * 20_000 + "</a>" * 20_000, "<div>" * 100_000 + "</p>" * 100_000, "<![CDATA[" * 100_000 + ">", "<ul><li>" * 100_000,
    "<b><i>" * 100_000 + "</b></i>" * 100_000, "<td><table>" * 50_000, "<p><b>" * 150_000, "<!--" * 200_000, "<p>" + "x " * 1_000_000,
])
def test_long_pages_take_time_in_proportion(source):
    started = time.monotonic()
    html_text.Model({}).extract(source)
    assert time.monotonic() - started < 15


def test_hosts_are_cut_into_words():
    cut = url_filter.Segmenter({"cheap": 50, "win": 40, "the": 1000, "paper": 60, "pa": 20, "per": 30, "a": 900}).cut
    assert cut("cheapcasinowin") == ("cheap", "casino", "win") and cut("thepaper") == ("the", "paper")
    assert url_filter.Segmenter({"abc": 5}, ()).cut("abcabc") == ("abc", "abc")  # the only word costs nothing
    assert cut("") == () and "".join(cut("zqxj" * 50)) == "zqxj" * 50


URLS = [
    ("http://a.net", "a.net", "", None), ("http://a.NET/x?y", "a.net", "/x", "net/"), ("https://w.example.net/en/1", "w.example.net", "/en/1", "example.net/en/"),
    ("https://example.com/de/#f", "example.com", "/de/", "example.com/de/"), ("x://myexample.com/de/", "myexample.com", "/de/", None),
    ("http://b.org/fr/1", "b.org", "/fr/1", "org/fr/"), ("b.org/fr/1", "", "", None), (None, "", "", None), ("", "", "", None), ("http://b.org?x=/fr/", "b.org", "", None),
    ("http://É.org/fr\n/a://b", "É.org", "/fr\n/a://b", None), ("://net/", "net", "/", "net/"),
]


def test_parts_and_rules(spark):
    table = spark.createDataFrame([(k, u[0], "<p>some words", "x") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    verdicts = {r.name: r.verdict for r in url_filter.RULES}
    for r in url_filter.judge(table).collect():
        _, host, path, rule = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == verdicts.get(rule, "allow")
    assert url_filter.judge(table.filter("false")).count() == 0


def test_classifier_on_held_out_urls(spark):
    """`cheapwin` and `spinnow` hold no seed word; they go along with seed words in the URLs of the first half."""
    bad = [f"http://{h}.example.org/{k}" for k in range(40) for h in ("casino-cheapwin", "spinnow-bets", "mega-poker")]
    good = [f"http://{h}.example.org/{k}" for k in range(40) for h in ("garden-paper", "river", "letters-home", "blog-news", "market")]
    held = ["http://spinnow.example.org/9", "http://casinomega.example.org/9", "http://gardenriver.example.org/9", "http://home.example.org/9"]
    words = "<p>casino cheapwin spinnow mega poker garden paper river letters home blog news market bets"
    rows = [(k, u, words) for k, u in enumerate([*held, *bad, *good])]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=()).collect()}
    assert [got[k] for k in range(4)] == ["block", "block", "allow", "allow"]


def test_rare_and_long_words_of_names_count(spark):
    """More than 50,000 words and tokens are more frequent than those that matter, and one word has 30 letters."""
    def name(k):
        return "".join(chr(97 + k // 26**i % 26) for i in range(4))

    filler = [name(7 * k) for k in range(51_000)]
    long = "pneumonoultramicroscopicsilico"
    paths = [" ".join(filler[k : k + 100]) for k in range(0, len(filler), 100)]
    rows = [(f"http://river.example.org/{p.replace(' ', '/')}", f"<p>{p}") for p in paths for _ in range(4)]
    rows += [("http://casino-quiltzebra.org/", f"<p>quilt zebra {long} quilt zebra"), (f"http://casino{long}.org/", None), (f"http://zebra{long}quilt.org/", None)]
    rows += [("http://casino-quiltzebra.org/", None), (None, None), ("http://" + long * 40 + ".org", None)]
    counted = Counter(w for _, page in rows for w in re.findall("[a-z]{2,}", (page or "").replace("<p>", "")))
    cut = url_filter.Segmenter(counted).cut
    assert cut(f"zebra{long}quilt") == ("zebra", long, "quilt")
    tokens = []
    for url, _ in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        names = host.split(".")
        parts = [("host", n) for x in names[:-1] for n in x.split("-")] + [("path", n) for n in path.split("/")]
        tokens.append([f"{kind}:{w}" for kind, n in parts for w in cut(n)] + ([f"top:{names[-1]}"] if url else []))
    is_bad = [any(t.split(":")[1] in url_filter.SEEDS and t[:3] != "top" for t in found) for found in tokens]
    bad, good = (Counter(t for found, b in zip(tokens, is_bad) if b == side for t in found) for side in (True, False))
    kinds = len(bad | good)
    assert kinds > 50_000 and len(counted) > 50_000
    odds = {t: math.log((bad[t] + 1) / (bad.total() + kinds + 1) * (good.total() + kinds + 1) / (good[t] + 1)) for t in bad | good}
    prior = math.log((sum(is_bad) + 1) / (len(rows) - sum(is_bad) + 1))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.score for r in url_filter.judge(table).collect()}
    assert got == pytest.approx({k: prior + sum(odds[t] for t in found) for k, found in enumerate(tokens)})
