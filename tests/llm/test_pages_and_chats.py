"""Main-text extraction, chat formatting, and the pipeline."""

import html as entities
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlens.llm import chats, html
from murmurlens.llm.common import table

TABLES = "/root/testdata/sf0.01"
PAGE = """<html><head><title>T</title></head><body><header class="site-header"><a href="/">Site</a> <p>Welcome to the site.</p></header>
<div id="cookie-banner">We use cookies to make it better. <button>OK</button></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=x>One two three</a></li></ul></div><article><h1>The real &amp; title</h1>
<p>First paragraph of the real story, it is long enough to be seen as one. It has sentences.<p>Second   paragraph &lt;with&gt; an
<a href=x>inline link</a> and <b>bold</b>text.<br>New line here.<div class="advert">Buy this now.</div></article>
<section class="comments"><div class="comment"><p>I liked this story very much.</p></div></section>
<form><label>Mail</label><input><p>Subscribe to our list.</p></form><footer>Copyright</footer><script>var x = "<p>no</p>";</script></body></html>"""
STORY = "The real & title\n\nFirst paragraph of the real story, it is long enough to be seen as one. It has sentences.\n\nSecond paragraph <with> an inline link and boldtext. New line here."


@pytest.fixture(scope="module")
def model(spark):
    return html.train(table(spark, TABLES, "pages"))


def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?(b|a|i|em|strong)\b[^>]*>", "", re.sub(r"<br>", " ", inner))
    blocks = [re.sub(r"\s+", " ", entities.unescape(x)).strip() for x in re.split(r"<[^>]*>", inner)]
    return "\n\n".join(x for x in blocks if x)


def test_pages_of_the_table(spark, model):
    pages = table(spark, TABLES, "pages")
    found = {r.page_id: r for r in html.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        assert found[row.page_id].text == article_of(row.html)
        assert found[row.page_id].n_chars == len(found[row.page_id].text) and found[row.page_id].url == row.url


def test_boilerplate_of_other_kinds(spark, model):
    assert html.extract_texts(model, [PAGE]) == [STORY]


def test_awkward_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", "<"), (4, "u", "<p"), (5, "u", "</div></p><p>"), (6, "u", "plain"), (7, "u", "<div>" * 3000 + "x")]
    rows += [(8, "u", PAGE.replace("<p>First", "<p>" + "First long one. " * 30_000)), (3, "u", "<"), (9, "u", "<script>never closed")]
    pages = spark.createDataFrame([(*row, 5, "x") for row in rows], "page_id long, url string, html string, n_chars int, text string")
    found = html.extract(pages, model).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows) and by[1].text == by[2].text == by[9].text == "" and by[None].text == STORY
    assert by[8].n_chars > 400_000
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize("extra", [
    "<svg class='icon'/>", "<div><svg><svg><path d=x></svg><text>no</text></svg></div>", "<svg><title/><style/><text>no</text></svg>",
    "<div><select><option>no</div>", "<div><object><p>no</div>", "<div><noscript>no<br></div>", "<div><iframe src=x></iframe></div>",
])
def test_elements_without_text_end_with_their_parent(model, extra):
    assert html.extract_texts(model, [PAGE.replace("</a> <p>Welcome", f"</a> {extra}<p>Welcome")]) == [STORY]
    page = html.Page(f"<body>{extra}<p>after</p></body>")
    assert [text for _, text in page.runs] == ["after"] and len(page.tags) == len(page.parents) <= 5


def test_unclosed_element_without_text_at_the_end():
    page = html.Page("<body><p>before</p><svg><g><text>no")
    assert [text for _, text in page.runs] == ["before"] and page.tags[-1] == "svg" and len(page.marks) == 4


def test_few_article_pages_are_all_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(html, "fit", lambda pages: pages)
    pages = spark.range(2000).selectExpr("id AS page_id", "IF(id % 100 = 7, concat('<ARTICLE>', id, '</article>'), '<p>x</p>') AS html")
    assert len(set(html.train(pages, sample=20))) == 20


LONG = "This is a long sentence of the story, with words enough to tell it from a menu. It goes on, and on. "
PARTS = [LONG * 2 + str(i) for i in range(4)]


@pytest.mark.parametrize("page, blocks", [
    ("<html><body>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</body></html>", PARTS),
    ("<h1>The headline of a story about a river in the north</h1>" + "".join(f"<p>{x}" for x in PARTS), ["The headline of a story about a river in the north", *PARTS]),
    (LONG * 3, [LONG * 3]),
    (f"<html><body>{LONG}<br>{LONG}</body></html>", [f"{LONG}{LONG}"]),
    (f"<article><p title=it's>{PARTS[0]}</p><p>we don't know. {PARTS[1]}</p><p title='a>b' class=\"x'y\">{PARTS[2]}</p></article>", [PARTS[0], f"we don't know. {PARTS[1]}", PARTS[2]]),
    (f"<article><p title=it's>{PARTS[0]}</p><p>{PARTS[1]}</p></article>", PARTS[:2]),
    (f"<article><p>{PARTS[0]} foo <del>bar</del> baz <ruby>x<rt>y</rt></ruby></p><p>{PARTS[1]}</p></article>", [f"{PARTS[0]} foo bar baz xy", PARTS[1]]),
    ("<body><table><tr><td><a href=/>Home</a> <a href=/b>News</a></td><td>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</td></tr></table></body>", PARTS),
])
def test_pages_without_a_container(model, page, blocks):
    clean = [re.sub(r"\s+", " ", block).strip() for block in blocks]
    assert html.extract_texts(model, [page]) == ["\n\n".join(clean)]


def test_a_page_of_boilerplate_alone_stays_empty(model):
    page = "<body><nav><a href=/>Home</a></nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><footer>All rights</footer><div class=ad>Buy</div></body>"
    assert html.extract_texts(model, [page]) == [""]


@pytest.mark.parametrize("hostile", [
    "<b 'a\" c d e ", "<b x=\"", "<b x='y\"", "<", "<!", "<!--", "</", "<b ", "<b>", "</b>", "<p><b>", "<div>", "<li><b>", "<script", "<title>", "<a b='c' =\"\n",
])
def test_time_grows_with_the_page(hostile):
    """A megabyte of each is read in seconds; it used to take the better part of an hour."""
    page = hostile * (1_000_000 // len(hostile))
    for html_ in (page, page + ">", "<div>" * 20_000 + "</i>" * 100_000):
        started = time.process_time()
        html.Page(html_)
        assert time.process_time() - started < 30


def best_by_brute_force(value, children):
    """The largest sum over all sets of elements that are whole subtrees with whole subtrees cut out."""
    parent = {k: i for i, kids in enumerate(children) for k in kids}
    best = 0.0
    for kept in itertools.product((False, True), repeat=len(value)):
        ok = True
        for i in range(len(value)):
            path, at = [], i
            while True:
                path.append(kept[at])
                if at not in parent:
                    break
                at = parent[at]
            path = path[::-1]
            if sum(a != b for a, b in zip([False, *path], path)) > 2:
                ok = False
                break
        if ok:
            best = max(best, sum(v for v, k in zip(value, kept) if k))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_decoding_is_optimal(seed):
    random_ = np.random.default_rng(seed)
    n = int(random_.integers(2, 11))
    children = [[] for _ in range(n)]
    for i in range(1, n):
        children[random_.integers(0, i)].append(i)
    score, own = random_.normal(size=n) * 3, random_.integers(0, 50, n).astype(float)
    kept = html.decode_tree(score, own, children)
    value = score * np.log1p(own) + 0.05 * score
    assert value[kept].sum() == pytest.approx(best_by_brute_force(value, children))


def test_answers_never_contradict(spark, model):
    page = html.Page(PAGE)
    x, children, own = html.describe(page)
    kept = html.decode_tree(html.raw_scores(model, x), own, children)
    for i in range(1, len(kept)):
        above, path = page.parents[i], [kept[i]]
        while above >= 0:
            path.append(kept[above])
            above = page.parents[above]
        changes = sum(a != b for a, b in zip(path, path[1:]))
        assert changes <= 2


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")]
    rows += [(3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 5, "user", "a"), (4, 9, "assistant", "x<|im_end|>")]
    rows += [(5, None, None, None), (5, 1, "user", "q"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "z"), (7, 0, "user", "w " * 50_000)]
    source = spark.createDataFrame([(*row, "x") for row in rows], "conv_id long, turn long, role string, text string, n string")
    found = {r.conv_id: r for r in chats.format_chats(source).collect()}
    assert set(found) == {2, 4, 5, None, 7} and found[2].turns == 3 and found[5].turns == 2
    assert found[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert found[4].rendered.count("<|im_end|>") == 2
    assert chats.format_chats(source.limit(0)).count() == 0


def test_rows_without_a_conversation_are_on_their_own(spark):
    """A third of all rows may have no id: each is a conversation, equal and prefix ones are dropped as others."""
    rows = [(None, i, "user", f"alone {i % 40}") for i in range(80)] + [(None, 0, "user", "a"), (None, 3, None, "b")]
    rows += [(1, 0, "user", "a"), (1, 1, "bot", "c"), (2, 0, "user", "b")]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in chats.format_chats(source).collect()]
    named = {r[0]: r[1] for r in found if r[0] is not None}
    assert named == {1: 2, 2: 1}  # the nameless "a" begins 1, the nameless "b" equals 2
    alone = [r for r in found if r[0] is None]
    assert len(alone) == len(set(alone)) == 40 and {r[1] for r in alone} == {1}


def test_pipeline_against_its_parts(spark, awkward):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "packing"]
    docs = awkward
    for _, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, TABLES)
        assert docs.columns == awkward.columns
        left, right = (Counter(map(tuple, x.select("doc_id", "text").collect())) for x in (before, docs))
        assert not right - left
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)
    assert not {100, 101, 102, 104, 108} & set(ids) and len(ids) == len(set(ids)) and 5 in ids and 106 not in ids and 107 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_keeps_one_row_of_every_group(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{name}{i}" for i in range(30)) for name in "abcd")
    rows = [(3, one), (7, one), (7, two), (9, two + " end"), (None, one), (None, three), (None, three), (None, three + " end"), (8, four), (8, four)]
    rows += [(10, None), (10, " \t"), (None, ""), (11, "short"), (None, "short")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, key string")
    found = corpus_pipeline.ngram_jaccard(spark, docs, TABLES)
    assert found.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in found.collect())
    third = [x for x in kept if x[0] is None and x[1] in (three, three + " end")]
    assert len(third) == 1
    assert kept == Counter([(3, one), (7, two), *third, (8, four), (10, None), (10, " \t"), (None, ""), (11, "short")])


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
