"""Wrappers: the expression covers every page, does not depend on their order, and decides what is read."""

import json
import random
import re

from corpusloom.llm import htmltext as ht

KIND = "page_id long, url string, html string"


def wrapper(pages):
    node = ht.Node()
    for p in pages:
        ht.learn(node, p)
    return node


def stream(kids):
    """The page as the expression's tokens, each in brackets of its own."""
    out = []
    for kid in kids:
        if isinstance(kid, str):
            out += ["#"] if kid.strip() else []
        else:
            out += [f"<{kid.kind}>", *stream(kid.kids), f"</{kid.tag}>"]
    return out


def accepts(expression, page):
    own = "".join(x if x in ("(", ")", ")?", ")+") else f"(?:{re.escape(chr(1) + x + chr(2))})" for x in expression.split(" ") if x)
    return re.fullmatch(own.replace("(" + "(?:", "(?:(?:"), "".join(chr(1) + x + chr(2) for x in stream(ht.parse(page).kids))) is not None


def random_page(rng, depth=0):
    tags = ["div", "p", "ul", "h2", "span", "div class=a", "section id=s7"]
    if depth > 3 or rng.random() < 0.2:
        return rng.choice(["", "word", "two words", "&amp;"])
    out = []
    for _ in range(rng.randint(0, 4)):
        t = rng.choice(tags)
        out.append(f"<{t}>{random_page(rng, depth + 1)}</{t.split()[0]}>")
        if rng.random() < 0.3:
            out.append("text")
    return "".join(out)


def test_expression_covers_every_page_in_any_order():
    rng = random.Random(4)
    for _ in range(120):
        pages = [random_page(rng) for _ in range(rng.randint(1, 7))]
        node = wrapper(pages)
        expression = ht.written(node)
        assert all(accepts(expression, p) for p in pages), (expression, pages)
        mixed = pages[:]
        rng.shuffle(mixed)
        cut = rng.randint(0, len(mixed))
        parts = wrapper(mixed[:cut])
        parts.merge(ht.Node.load(json.loads(json.dumps(wrapper(mixed[cut:]).dump()))))
        same = lambda n: json.dumps(n.dump(), sort_keys=True)
        assert same(parts) == same(node)


def test_expression_of_lists():
    page = lambda n, extra="": "<ul>" + "<li><a>x</a></li>" * n + "</ul>" + extra
    assert accepts(ht.written(wrapper([page(3)])), page(9)) and not accepts(ht.written(wrapper([page(3)])), page(3, "<p>x</p>"))
    assert ht.written(wrapper([page(3), page(5, "<p>x</p>")])) == "<ul> ( <li> <a> # </a> </li> )+ </ul> ( <p> # </p> )?"


def site(n, body):
    return [f"<html><body>{body(i)}</body></html>" for i in range(n)]


def test_the_expression_decides_where_no_element_names_the_article():
    """Boxes without class: the wrapper tells template text from text that changes."""
    pages = site(6, lambda i: f"<div><a href=/>Home</a> <a href=/x>More</a></div><div>We like visitors very much and say so on every page of ours, day after day after day.</div><div><h1>Title {i}</h1><p>Body of {i} goes here and on and on for {i * 7} words.</p><p>It ends {i}.</p></div><div>All rights kept by us, all of them, wherever you may read this text of ours.</div>")
    rule = ht.rules(wrapper(pages))
    assert ht.extract(pages[2], rule) == "Title 2\n\nBody of 2 goes here and on and on for 14 words.\n\nIt ends 2."
    assert "visitors" in ht.extract(pages[2], {})  # without the wrapper's rules it is not told apart


def test_template_text_inside_the_main_box_goes():
    pages = site(6, lambda i: f"<div><h1>T {i}</h1><span>Print this page</span><p>Body {i} is here.</p></div>")
    assert ht.extract(pages[3], ht.rules(wrapper(pages))) == "T 3\n\nBody 3 is here."


def test_class_words_do_not_delete_the_article():
    pages = site(6, lambda i: f"<div class='page-header-wrap'><article><h1 class='header'>Title {i}</h1><p class='notice-text'>One {i}</p><p class='ad'>Buy {i}</p><div class='ad'>Buy more {i}</div><p>Two {i}</p></article></div><div class=header><h1>Our site</h1></div>")
    assert ht.extract(pages[1], ht.rules(wrapper(pages))) == "Title 1\n\nOne 1\n\nTwo 1"
    pages = site(6, lambda i: f"<div class='with-sidebar'><h1>Title {i}</h1><p>One {i} and more words than elsewhere.</p></div><div class='sidebar'><p>Side {i}</p></div>")
    assert ht.extract(pages[1], ht.rules(wrapper(pages))) == "Title 1\n\nOne 1 and more words than elsewhere."


def test_article_with_comments_and_own_header():
    page = "<article><header><h1>A</h1><span>by me</span></header><p>T</p><section class=comments><article class=comment><p>Long comment text, longer than the article.</p></article></section></article>"
    assert ht.extract(page, ht.rules(wrapper([page]))) == "A\n\nT"


def test_odd_pages():
    deep = "<div>" * 5000 + "low" + "</div>" * 5000 + "<p>after</p>"
    many = "".join(f"<x{i}>t{i}</x{i}>" for i in range(1500))
    quote = "<p title=\"open>one</p><p>two 'quoted' < 3</p>"
    for page, want in ((deep, "low\n\nafter"), (many, "".join(f"t{i}" for i in range(1500))), ("<", "<"), ("a < b", "a < b"), ("<p>x<p>y</p></p>z", "x\n\ny\n\nz"), ("<script>var a='<p>no</p>'", ""), ("&lt;b&gt; &nbsp; c", "<b> c")):
        assert ht.extract(page, ht.rules(wrapper([page]))) == want
    assert "two 'quoted' < 3" in ht.extract(quote, ht.rules(wrapper([quote])))
    assert len(wrapper([many]).kids) == 1500


def test_rows_that_repeat_long_pages_and_clashing_names(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "http://a/1", long, "h", "r"), (1, "http://a/1", long, "h", "r"), (2, None, "<p>x</p>", "h", "r"), (None, "http://a/2", None, None, None), (3, "http://a/3", " ", None, None)]
    got = ht.extract_pages(spark.createDataFrame(rows, KIND + ", host string, rules string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 999_999), (1, 999_999), (2, 1), (3, 0)]


def test_extraction_equals_articles_of_the_table(spark):
    """The given pages' articles, read by a small independent reader of their flat markup."""
    import html

    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in ht.extract_pages(d).collect()}
    for r in d.collect():
        body = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body[1])] if body else []
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)


def test_wrappers_of_hosts_split_over_tasks_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one = {r.host: (r.rules, r.wrapper, r.pages) for r in ht.infer_wrappers(d.coalesce(1)).collect()}
    many = {r.host: (r.rules, r.wrapper, r.pages) for r in ht.infer_wrappers(d.repartition(7), held=3, salts=2).collect()}
    assert one == many and sum(n for *_, n in one.values()) == d.where("html <> ''").count()
